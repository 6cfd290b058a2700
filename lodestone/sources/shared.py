"""Tables that later steps read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session, as in tests, sets a
    temporary one for itself; on a cluster, whose executors would not see it, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a table of the shared folder, at a new path if none is given, so that what made them is neither computed
    again nor kept in lineage."""
    spark = df.sparkSession
    path = path or f"{folder(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _path(spark, path)
    return files.exists(at)


def renamed(spark: SparkSession, source: str, target: str) -> None:
    """Gives a folder its final name; if another session was first, its folder stays and this one goes."""
    files, at = _path(spark, source)
    _, to = _path(spark, target)
    if files.exists(to) or not files.rename(at, to):
        files.delete(at, True)
