"""Quality of extracted text. A document's pages are rows (doc, page, text); checks are aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.shared import written

# Thresholds and weights of the checks.
GARBLED = "�□■●◆▪▫◊○"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
TABLES = (r"\|\s*\|\s*\|", r"(\d+\s+){5,}", r"[-+|]{10,}")
WEIGHTS = {"critical": 30, "high": 15, "medium": 8, "low": 3}
ESCALATE = 55


def page_flags(text: Column) -> dict[str, Column]:
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    word = F.regexp_extract(bare, r"(\S+)$", 1)
    open_end = ~F.substring(bare, -1, 1).isin(*'.!?"\')]}') & word.rlike(r"[\p{L}\p{N}]$") & (F.length(word) >= 3)
    return {
        "empty": F.length(bare) < 50,
        "control": text.rlike(CONTROL),
        "garbled": F.length(text) - F.length(F.translate(text, GARBLED, "")),
        "chars": F.length(text),
        "lines": F.size(F.split(text, "\n")),
        "cut": (bare != "") & open_end,
        "table": text.rlike("|".join(f"(?:{p})" for p in TABLES)),
    }


def repeated_lines(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """Lines of more than 10 characters that a document's pages repeat (more than 3 and a third of its pages), by document."""
    lines = pages.select(doc, F.explode(F.split(text, "\n")).alias("line")).select(doc, F.trim("line").alias("line")).where(F.length("line") > 10)
    counted = lines.groupBy(doc, "line").agg(F.count("*").alias("n"))
    sizes = pages.groupBy(doc).agg(F.count("*").alias("pages"))
    often = counted.join(sizes, doc).where(F.col("n") > F.greatest(F.lit(3.0), F.col("pages") * 0.3))
    return often.groupBy(doc).agg(F.count("*").alias("repeated"), F.sum("n").alias("repeated_total"))


def report(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """Per document: a severity for each check (null: passed), the weirdness score, and whether to extract it again."""
    flags = page_flags(F.col(text))
    sums = pages.select(doc, *(c.cast("long").alias(k) for k, c in flags.items())).groupBy(doc).agg(F.count("*").alias("pages"), *(F.sum(k).alias(k) for k in flags))
    rows = sums.join(repeated_lines(pages, doc, text), doc, "left").na.fill(0, ["repeated", "repeated_total"])
    share = lambda a, b: F.col(a) / F.col(b)
    empty, garble, again, cut = share("empty", "pages"), F.when(F.col("chars") > 0, share("garbled", "chars")).otherwise(0.0), share("repeated_total", "lines"), share("cut", "pages")
    checks = {
        "empty_pages": F.when(empty > 0.5, "critical").when(empty > 0.2, "high").when(F.col("empty") > 0, "medium"),
        "encoding": F.when(F.col("control") > 0, "high"),
        "garbled_text": F.when(garble > 0.1, "critical").when(garble > 0.02, "high"),
        "repeated_content": F.when(again >= 0.2, "high").when(again > 0.1, "medium"),
        "truncation": F.when(cut > 0.3, "medium"),
        "table_artifacts": F.when(F.col("table") > 0, "low"),
    }
    rows = rows.select(doc, "pages", "chars", *(c.alias(k) for k, c in checks.items()))
    points = sum((sum((F.when(F.col(k) == s, w).otherwise(0) for s, w in WEIGHTS.items()), F.lit(0)) for k in checks), F.lit(0))
    points = F.least(F.lit(100), points + F.when(F.col("chars") / F.col("pages") < 50, 20).otherwise(0))
    of = lambda s: sum((F.coalesce((F.col(k) == s).cast("int"), F.lit(0)) for k in checks), F.lit(0))
    rows = rows.withColumn("weirdness", points.cast("long"))
    return rows.withColumn("escalate", (F.col("weirdness") >= ESCALATE) | (of("critical") > 0) | (of("high") >= 3)).drop("chars")


def quality_score(density: Column, garble: Column, control: Column, scanned: Column, tables: Column, equations: Column, repeated: Column) -> Column:
    """0 to 100 for a sample of a document."""
    score = (
        100
        - F.when(density < 500, 40).when(density < 1000, 20).when(density < 2000, 10).otherwise(0)
        - F.when(garble > 0.1, 50).when(garble > 0.05, 30).when(garble > 0.01, 15).otherwise(0)
        - F.when(control, 20).otherwise(0) - F.when(scanned, 25).otherwise(0) - F.when(tables, 5).otherwise(0) - F.when(equations, 5).otherwise(0)
        - F.when(repeated > 10, 15).when(repeated > 5, 8).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def tier(score: Column) -> Column:
    return F.when(score > 80, "high").when(score > 50, "medium").when(score > 20, "low").otherwise("terrible")


def extractor(tier_: Column, structured: Column) -> Column:
    return F.when((tier_ == "high") & ~structured, "text").when(tier_.isin("high", "medium"), "layout").when(tier_ == "low", "model").otherwise("vision")


def stratified(rows: DataFrame, size: Column, limits: tuple[int, int], each: int, id_col: str) -> DataFrame:
    """A sampling operator: up to `each` rows of the large, middle and small ones, in order of a hash."""
    kind = F.when(size >= limits[1], "large").when(size >= limits[0], "middle").otherwise("small")
    best = W.partitionBy("class").orderBy(F.md5(F.col(id_col).cast("string")), id_col)
    return rows.withColumn("class", kind).withColumn("pick", F.row_number().over(best)).where(F.col("pick") <= each)


def missing(got: Column, expected: Column) -> Column:
    """The severity of missing pages: critical beyond a tenth of what is expected; null where none is missing."""
    return F.when(expected - got > expected * 0.1, "critical").when(expected > got, "high")


def at_ranks(rows: DataFrame, group: str, order: list[str], ranks: dict[str, Column]) -> DataFrame:
    """For each group, the first order column's value at places (from 0, as expressions of n, the group's rows) in that order,
    as columns, and n. Rows are dealt by ranges of group and order, numbered in each range and offset by the ranges before,
    so that no task orders a whole group."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # written, as two readings of ranges made by sampling need not agree
    dealt = written(rows.select(group, *order).repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_range")
    sizes = sizes.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).withColumn("n", F.sum("_n").over(W.partitionBy(group)))
    numbered = dealt.withColumn("_k", F.row_number().over(W.partitionBy(group, "_range").orderBy(*order)) - 1).join(sizes, [group, "_range"])
    at = lambda place: F.max(F.when(F.col("_before") + F.col("_k") == place, F.col(order[0])))
    return numbered.groupBy(group).agg(F.max("n").alias("n"), *(at(place).alias(name) for name, place in ranks.items()))
