"""Chat formatting with minimum-cost role repair.

A conversation is legal if it is [system] user assistant user assistant ... and ends with an assistant's turn. Its turns,
in order, are repaired at the least cost. For each turn dynamic programming over the automaton's states chooses to

- keep it where it is legal (0), or relabel it to the role that is due (RELABEL; a role that is none of the three is
  relabelled always, at UNKNOWN),
- merge it into the turn before, which has its (possibly new) role then (MERGE, and RELABEL if its own role differs),
- put an empty turn of the role that is due before it (INSERT).

At the end an empty assistant's turn may be added (INSERT). Costs of choices add up along a conversation, so a stretch
of turns is a matrix of least costs between states: conversations are cut into stretches of STRETCH turns, whose
matrices are found apart, and combined in order to give the state that each stretch starts and ends in; the choices
inside are then traced back stretch by stretch. Only their numbering orders a whole conversation in one task, by a window
whose sort spills; no task holds one in memory.

Ties are settled towards keeping, then merging, then inserting. Null roles are unknown; a null text is empty. Turns
are ordered by number (nulls first), then role and text; turns that repeat are all kept. A null conv_id is a
conversation of its own. The result has one row a turn: conv_id, position (from 1), turn, role (as found), new_role,
action (keep, merge), inserted (roles of empty turns put before it), appended (of those after the last), rendered.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The roles, and the states of the automaton by the turn that came last.
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
MERGE, RELABEL, INSERT, UNKNOWN = 1, 3, 2, 3
STRETCH = 256
#: Most stretches, but for first ones, whose states are broadcast.
FEW = 10_000
_FAR = 10**9
#: Roles that may follow each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _options(role: int) -> list[tuple[int, int, int, int, tuple[int, ...]]]:
    """(from, to, cost, whether it merges, roles inserted before) for a turn of a role (0: unknown)."""
    out = []

    def take(start: int, state: int, base: int, inserted: tuple[int, ...]) -> None:
        for new in NEXT[state]:
            out.append((start, new, base + (0 if new == role else RELABEL if role else UNKNOWN), 0, inserted))

    for state in range(STATES):
        take(state, state, 0, ())
        if state != START:
            out.append((state, state, MERGE + (0 if state == role else RELABEL if role else UNKNOWN), 1, ()))
        for new in NEXT[state]:
            if new != SYSTEM:
                take(state, new, INSERT, (new,))
    return out


def _table(role: int) -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, tuple[int, ...]]]]:
    """Least costs between states for one turn, and the choice made."""
    cost = np.full((STATES, STATES), _FAR, np.int64)
    how: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = {}
    for a, b, c, merges, inserted in _options(role):
        if c < cost[a, b]:
            cost[a, b] = c
            how[a, b] = (merges, inserted)
    return cost, how


TURN = [_table(role) for role in range(STATES)]
#: Cost of ending in each state, and what is appended.
FINISH = np.array([2 * INSERT, 2 * INSERT, INSERT, 0])
APPENDED = (("user", "assistant"), ("user", "assistant"), ("assistant",), ())


def _number(roles: list[str | None]) -> list[int]:
    return [ROLES.index(r) + 1 if r in ROLES else 0 for r in roles]


def stretch_costs(roles: list[str | None]) -> np.ndarray:
    """Least costs from each state before the turns to each state after them."""
    cost = np.where(np.eye(STATES, dtype=bool), 0, _FAR)
    for r in _number(roles):
        cost = np.minimum((cost[:, :, None] + TURN[r][0][None, :, :]).min(1), _FAR)
    return cost


def trace(roles: list[str | None], start: int, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """(state after, merges, roles inserted before) of each turn on a cheapest way between two states."""
    numbers = _number(roles)
    best = [np.where(np.arange(STATES) == start, 0, _FAR)]
    for r in numbers:
        best.append(np.minimum((best[-1][:, None] + TURN[r][0]).min(0), _FAR))
    out, state = [], end
    for i in range(len(numbers) - 1, -1, -1):
        cost, how = TURN[numbers[i]]
        before = int(np.argmin(best[i] + cost[:, state]))
        merges, inserted = how[before, state]
        out.append((state, merges, inserted))
        state = before
    return out[::-1]


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text)


def alone(roles: tuple) -> tuple[int, int]:
    """State after all turns of a conversation, and its cost."""
    cost = stretch_costs(list(roles))[START] + FINISH
    return int(np.argmin(cost)), int(cost.min())


def chain(maps: list[np.ndarray]) -> tuple[list[tuple[int, int]], int]:
    """States before and after each stretch of a conversation, and its cost, from the stretches' matrices in order."""
    best = [np.where(np.arange(STATES) == START, 0, _FAR)]
    for m in maps:
        best.append(np.minimum((best[-1][:, None] + m).min(0), _FAR))
    state, out = int(np.argmin(best[-1] + FINISH)), []
    for i in range(len(maps) - 1, -1, -1):
        before = int(np.argmin(best[i] + maps[i][:, state]))
        out.append((before, state))
        state = before
    return out[::-1], int((best[-1] + FINISH).min())


@lru_cache(maxsize=20_000)
def _chosen(roles: tuple, start: int, end: int, last: bool, cost: int) -> tuple:
    if start < 0:  # the whole conversation
        start, last = START, True
        end, cost = alone(roles)
    found = trace(list(roles), start, end)
    appended = [[] for _ in found[:-1]] + [[*APPENDED[found[-1][0]]] if last else []]
    return [ROLES[s - 1] for s, _, _ in found], [bool(m) for _, m, _ in found], [[ROLES[x - 1] for x in i] for _, _, i in found], appended, cost


_CHOICE = "struct<new_role:array<string>,merged:array<boolean>,inserted:array<array<string>>,appended:array<array<string>>,cost:bigint>"


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """See above. `rendered` joined in order of position gives the conversation's text."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Spark sorts each conversation's turns on disk if need be; numbering them holds none of them
    conversation = W.partitionBy("conv_id")
    number = F.row_number().over(conversation.orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("position", number).withColumn("stretch", F.floor((F.col("position") - 1) / STRETCH))
    ordered = F.array_sort(F.collect_list(F.struct("position", "turn", "role", "text")))
    # up to STRETCH turns a row, where the numbering has them already
    stretches = rows.groupBy("conv_id", "stretch").agg(ordered.alias("turns")).withColumn("last", F.max("stretch").over(conversation))

    @F.pandas_udf("array<bigint>")
    def costs(roles: pd.Series) -> pd.Series:
        return pd.Series([stretch_costs(list(r)).ravel() for r in roles])

    @F.pandas_udf("struct<ways:array<struct<start:int,end:int>>,cost:bigint>")
    def states(maps: pd.Series) -> pd.DataFrame:
        found = [chain([np.array(m["costs"]).reshape(STATES, STATES) for m in x]) for x in maps]
        return pd.DataFrame({"ways": [[{"start": a, "end": b} for a, b in w] for w, _ in found], "cost": [c for _, c in found]})

    @F.pandas_udf(_CHOICE)
    def choices(roles: pd.Series, start: pd.Series, end: pd.Series, last: pd.Series, cost: pd.Series) -> pd.DataFrame:
        found = [_chosen(tuple(r), *x) for r, *x in zip(roles, start, end, last, cost)]
        return pd.DataFrame(found, columns=["new_role", "merged", "inserted", "appended", "cost"])

    # only conversations of several stretches need their states found stretch by stretch
    long = rows.where(f"position > {STRETCH}").select("conv_id").distinct().select(F.struct("conv_id").alias("key"))
    # each of these conversations has one stretch more than it has rows here
    few = rows.where(f"position > {STRETCH} and position % {STRETCH} = 1").limit(FEW + 1).count() <= FEW
    keyed = rows.select(F.struct("conv_id").alias("key"), "conv_id", "stretch", "position", "role")
    keyed = keyed.join(F.broadcast(long) if few else long, "key", "left_semi")
    maps = keyed.groupBy("key", "stretch").agg(F.array_sort(F.collect_list(F.struct("position", "role")))["role"].alias("roles")).select("key", "stretch", costs("roles").alias("costs"))
    ways = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("stretch", "costs"))).alias("maps")).select("key", states("maps").alias("w"))
    ways = ways.select("key", F.posexplode("w.ways").alias("own", "way"), F.col("w.cost").alias("total")).select("key", F.col("own").cast("long").alias("own"), "way.start", "way.end", "total")
    stretches = stretches.withColumn("at", F.struct("conv_id"))
    stretches = stretches.join(F.broadcast(ways) if few else ways, (F.col("at") == F.col("key")) & (F.col("stretch") == F.col("own")), "left")
    given = [F.coalesce("start", F.lit(-1)), F.coalesce("end", F.lit(-1)), F.col("last") == F.col("stretch"), F.coalesce("total", F.lit(0).cast("long"))]
    chosen = stretches.select("conv_id", "turns", choices(F.col("turns.role"), *given).alias("c"))
    flat = chosen.select("conv_id", F.explode(F.arrays_zip("turns", "c.new_role", "c.merged", "c.inserted", "c.appended")).alias("x"), F.col("c.cost").alias("cost"))
    flat = flat.select("conv_id", "x.turns.*", "x.new_role", "x.merged", "x.inserted", "x.appended", "cost")
    empty = lambda roles: F.transform(roles, lambda r: F.concat(_render(r, F.lit("")), F.lit("\n")))
    body = F.when(F.col("merged"), F.concat(F.lit("\n"), F.col("text"))).otherwise(F.concat(F.when(F.col("position") > 1, F.lit("\n")).otherwise(F.lit("")), F.array_join(empty(F.col("inserted")), ""), _render(F.col("new_role"), F.col("text"))))
    tail = F.array_join(F.transform("appended", lambda r: F.concat(F.lit("\n"), _render(r, F.lit("")))), "")
    action = F.when(F.col("merged"), "merge").otherwise("keep")
    return flat.select("conv_id", "position", "turn", "role", "new_role", action.alias("action"), "inserted", "appended", "cost", F.concat(body, tail).alias("rendered"))
