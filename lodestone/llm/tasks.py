"""Small helpers that every operator shares: shared folders, cut lineage, and per-slice work inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.llm.bytesio import Texts, slices

#: Rows in an Arrow batch; batches are cut further by bytes.
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir. Where that is unset, a local session, as
    in tests, sets a temporary one for itself; on a cluster, whose executors would not see it, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/lodestone-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: later steps read it again and need none of what made it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def by_slice(
    df: DataFrame, schema: T.StructType | str, work: Callable[[pa.RecordBatch, Texts], pa.RecordBatch | None], text: str = "text"
) -> DataFrame:
    """mapInArrow over slices of bounded bytes: work gets a slice's rows and its texts, and returns the rows that it makes."""
    small_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(batch.schema.get_field_index(text))):
                out = work(batch.slice(texts.first, texts.n), texts)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(each, schema)


def unused(name: str, df: DataFrame) -> str:
    """The name, with underscores until no column of df has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame) -> int:
    """Number of partitions that a scan has, as a measure of its size."""
    return df.rdd.getNumPartitions()
