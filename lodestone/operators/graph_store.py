"""A knowledge graph kept as tables that batches are merged into and topics are deleted from.

mentions (topic, chunk_id, label, name) are the edges from chunks to entities, counts (topic, label, name, chunks) how many
chunks of a topic hold an entity. Both are kept by topic. A batch reads and writes the topics that it names alone: what is
there is joined with it as sets, so that a batch applied twice, or again after a failure half way, changes nothing.
Counts of a changed topic are made anew from its mentions; those of other topics stay as they are. An entity is there as
long as some topic counts it, so that deleting chunks or topics leaves no orphan.

Written topics go to new folders, and a manifest, which is written last under the next number, says which folder holds
each topic: a reader sees the store before a batch or after it. One writer at a time. A null topic, name or label, or chunk
without an id, isn't kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import exists, folder

_MENTIONS = "topic string, chunk_id long, label string, name string"
_COUNTS = "topic string, label string, name string, chunks long"
_MANIFEST = "topic string, at string"


class GraphStore:
    """The graph under a folder; a new one under the shared folder if none is given."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{folder(spark)}/lodestone-graph-{uuid.uuid4().hex}"
        self.version = 0
        while exists(spark, f"{self.path}/manifest-{self.version + 1}/_SUCCESS"):
            self.version += 1

    def _manifest(self) -> dict[str, str]:
        """Folders by topic; there is one row a topic."""
        if not self.version:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest-{self.version}").collect()
        return {r.topic: r["at"] for r in rows}

    def _read(self, kind: str, schema: str, topics: set[str] | None = None) -> DataFrame:
        held = self._manifest()
        folders = sorted({at for t, at in held.items() if topics is None or t in topics})
        if not folders:
            return self.spark.createDataFrame([], schema)
        wanted = self.spark.createDataFrame([(t, at.rsplit("/", 1)[-1]) for t, at in held.items() if topics is None or t in topics], "topic string, part string")
        rows = self.spark.read.schema(schema).parquet(*(f"{at}/{kind}" for at in folders)).withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -3))
        # a folder may hold topics that were written again since
        return rows.join(F.broadcast(wanted), ["topic", "part"], "left_semi").drop("part")

    def mentions(self) -> DataFrame:
        return self._read("mentions", _MENTIONS)

    def entities(self) -> DataFrame:
        """(label, name, chunks, topics): entities with the numbers of chunks and topics that hold them."""
        counts = self._read("counts", _COUNTS)
        return counts.groupBy("label", "name").agg(F.sum("chunks").alias("chunks"), F.count("*").alias("topics"))

    def _replaced(self, rows: DataFrame, topics: set[str]) -> None:
        """Writes the topics anew from rows; those without a row are gone."""
        at = f"{self.path}/part-{uuid.uuid4().hex}"
        rows.select("topic", "chunk_id", "label", "name").write.parquet(f"{at}/mentions")
        written = self.spark.read.schema(_MENTIONS).parquet(f"{at}/mentions")
        counts = written.groupBy("topic", "label", "name").agg(F.count_distinct("chunk_id").alias("chunks"))
        counts.write.parquet(f"{at}/counts")
        there = {r.topic for r in self.spark.read.schema(_COUNTS).parquet(f"{at}/counts").select("topic").distinct().collect()}
        manifest = {t: a for t, a in self._manifest().items() if t not in topics} | dict.fromkeys(there, at)
        self.spark.createDataFrame(sorted(manifest.items()), _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest-{self.version + 1}")
        self.version += 1

    def merge(self, batch: DataFrame) -> None:
        """Adds mentions (topic, chunk_id, label, name) that aren't there yet."""
        kept = batch.select("topic", "chunk_id", "label", "name").where("topic is not null and chunk_id is not null and label is not null and name is not null")
        topics = {r.topic for r in kept.select("topic").distinct().collect()}  # the topics of one batch
        if topics:
            self._replaced(self._read("mentions", _MENTIONS, topics).unionByName(kept).distinct(), topics)

    def new_chunks(self, chunks: DataFrame) -> DataFrame:
        """Chunks (topic, chunk_id, ...) whose topic has no mention of theirs: what an incremental build still has to read."""
        return chunks.join(self.mentions().select("topic", "chunk_id").distinct(), ["topic", "chunk_id"], "left_anti")

    def delete_chunks(self, chunks: DataFrame) -> None:
        """Takes the mentions of chunks (topic, chunk_id) out."""
        gone = chunks.select("topic", "chunk_id").distinct()
        topics = {r.topic for r in gone.select("topic").distinct().collect()} & set(self._manifest())
        if topics:
            self._replaced(self._read("mentions", _MENTIONS, topics).join(gone, ["topic", "chunk_id"], "left_anti"), topics)

    def delete_topics(self, topics: list[str]) -> None:
        """Takes topics out of the manifest; nothing is read or written but that."""
        manifest = {t: a for t, a in self._manifest().items() if t not in topics}
        self.spark.createDataFrame(sorted(manifest.items()), _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest-{self.version + 1}")
        self.version += 1

    def rebuild(self, topics: list[str], made) -> None:
        """Purges topics and builds them again from made(topics), mentions of these topics."""
        self._replaced(made(topics).where(F.col("topic").isin(*topics)).distinct(), set(topics))
