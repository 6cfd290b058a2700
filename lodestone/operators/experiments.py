"""Experiments over many configurations: what they have in common is computed once, what is finished isn't computed again.

A stage's result is a table under a key of its name, the settings that it depends on, and the keys of the stages before it.
Configurations that agree on these read one table, in this run or a later one. Finished configurations are rows of a
results table, by layer and configuration; a run takes only those without a row. Both are folders that outlive the session.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.files import left_to_do, save_done
from lodestone.sources.shared import exists, renamed

# The switches of the retrieval configurations that are compared.
SWITCHES = ("rerank", "use_hybrid", "use_expansion", "use_hyde", "use_raptor", "use_graph", "use_global", "apply_diversity")
_DEEP = frozenset(SWITCHES)
RETRIEVAL = {
    "dense_only": frozenset(), "dense_rerank": frozenset({"rerank"}), "hybrid_basic": frozenset({"rerank", "use_hybrid"}),
    "fast_profile": frozenset({"rerank", "use_hybrid", "use_expansion", "apply_diversity"}), "deep_profile": _DEEP, "deep_no_hyde": _DEEP - {"use_hyde"},
    "deep_no_bm25": _DEEP - {"use_hybrid"}, "deep_no_raptor": _DEEP - {"use_raptor"}, "deep_no_graph": _DEEP - {"use_graph"}, "deep_no_expansion": _DEEP - {"use_expansion"},
    "deep_no_diversity": _DEEP - {"apply_diversity"}, "deep_no_global": _DEEP - {"use_global"}, "deep_no_domain_boost": _DEEP,
    "hybrid_no_rerank": frozenset({"use_hybrid", "use_expansion"}), "expansion_only": frozenset({"use_expansion"}),
}


class Stages:
    """Results of stages, kept under a folder. `made` counts those that this object has computed."""

    def __init__(self, spark: SparkSession, folder: str, inputs: str = ""):
        """inputs: what tells one state of the data from another, such as their version."""
        self.spark, self.folder, self.inputs, self.made = spark, folder, inputs, 0
        self.keys: dict[int, str] = {}

    def get(self, name: str, settings: dict, before: Iterable[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: read if it is there, else computed, written aside and renamed. before: results of other stages."""
        key = hashlib.md5(json.dumps([name, self.inputs, sorted(settings.items()), [self.keys[id(x)] for x in before]]).encode()).hexdigest()
        path = f"{self.folder}/stage-{key}"
        if not exists(self.spark, path):
            aside = f"{path}-{uuid.uuid4().hex}"
            make().write.parquet(aside)
            renamed(self.spark, aside, path)
            self.made += 1
        out = self.spark.read.parquet(path)
        self.keys[id(out)] = key
        self._held = [*getattr(self, "_held", []), out]  # ids stay those of living frames
        return out


def run(spark: SparkSession, folder: str, layer: str, configs: dict[str, dict], result: Callable[[str, dict], DataFrame]) -> DataFrame:
    """(layer, config_id, ...) of all configurations, computing those that have no row yet. result(config_id, settings) gives a
    configuration's row without these two columns. Configurations are a list that a person wrote; results are kept one by one."""
    path = f"{folder}/results"
    wanted = spark.createDataFrame([(layer, c) for c in configs], "layer string, config_id string")
    done = spark.read.parquet(path) if exists(spark, path) else None
    left = [r.config_id for r in (left_to_do(wanted, done) if done is not None else wanted).collect()]
    for config_id in configs:
        if config_id in left:
            save_done(result(config_id, configs[config_id]).select(F.lit(layer).alias("layer"), F.lit(config_id).alias("config_id"), "*").coalesce(1), path)
    return spark.read.parquet(path).join(F.broadcast(wanted), ["layer", "config_id"], "left_semi")
