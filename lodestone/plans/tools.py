"""Named tools over DataFrames, guarded SQL, and what a call may pass."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

WRITES = frozenset("CREATE MERGE DELETE DETACH SET REMOVE DROP INSERT UPDATE ALTER CALL LOAD TRUNCATE".split())
REFLECTS = frozenset("REFLECT TRY_REFLECT JAVA_METHOD".split())
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
MOST_ROWS = 1000


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    category: str = "general"
    enabled: bool = True

    @property
    def parameters(self) -> dict[str, bool]:
        """Names of the arguments, and whether a call must give them."""
        return {k: p.default is p.empty for k, p in inspect.signature(self.run).parameters.items() if k != "rows"}


class Tools:
    def __init__(self) -> None:
        self._held: dict[str, Tool] = {}

    def add(self, tool: Tool) -> None:
        if tool.name in self._held:
            raise ValueError(f"there is a tool named {tool.name} already")
        self._held[tool.name] = tool

    def names(self, category: str | None = None) -> list[str]:
        return sorted(t.name for t in self._held.values() if t.enabled and category in (None, t.category))

    def call(self, name: str, rows: DataFrame, **arguments) -> DataFrame:
        """Runs a tool; arguments that it doesn't have are left out, ones that it needs must be there."""
        tool = self._held.get(name)
        if tool is None or not tool.enabled:
            raise KeyError(name)
        missing = [k for k, must in tool.parameters.items() if must and k not in arguments]
        if missing:
            raise TypeError(f"{name} needs {', '.join(missing)}")
        return tool.run(rows, **{k: v for k, v in arguments.items() if k in tool.parameters})


def read_only(statement: str) -> bool:
    """Whether no word of a statement writes or calls into the JVM; what stands in quotes or comments is no word of it."""
    bare = _QUOTED.sub(" ", statement)
    words = "".join(c if c.isalnum() or c == "_" else " " for c in bare.upper()).split()
    return not (WRITES | REFLECTS) & set(words)


def run_sql(spark: SparkSession, statement: str) -> DataFrame:
    """A reading statement over registered views; one whose outermost part is no limit gets one of MOST_ROWS rows. The
    statement is parsed first: commands, which Spark would run at once, are refused whatever their words."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    kinds = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    if not read_only(statement) or any(k.isInstance(plan) for k in kinds):
        raise PermissionError("only statements that read are run")
    out = spark.sql(statement)
    return out if plan.nodeName() in ("GlobalLimit", "LocalLimit") else out.limit(MOST_ROWS)
