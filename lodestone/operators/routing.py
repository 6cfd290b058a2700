"""Pages to extractors, and extracted pages back together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import quality
from lodestone.sources.shared import written

# Extractors from the cheapest on, and when a figure page keeps its text.
PATH = ("text", "layout", "model", "ocr", "vision")
FIGURE, TEXT = 0.20, 300


def next_extractor(now: Column) -> Column:
    """The one after an extractor, null after the last."""
    path = F.array(*map(F.lit, PATH))
    at = F.array_position(path, now)
    return F.when((at > 0) & (at < len(PATH)), F.element_at(path, (at + 1).cast("int")))


def for_vision(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """Pages (doc, page, text) with figures (doc, page, area, page_area) that a vision model is to read: all but those whose
    largest figure is small while the text is long."""
    largest = figures.groupBy("doc", "page").agg(F.max(F.col("area") / F.col("page_area")).alias("largest"))
    return pages.join(largest, ["doc", "page"]).where(~((F.col("largest") < FIGURE) & (F.length(F.trim("text")) >= TEXT)))


def with_charts(pages: DataFrame, charts: DataFrame) -> DataFrame:
    """Pages (doc, page, text) as prose, and for each chart (doc, page, json, text) two rows more, in order of page."""
    kinds = F.explode(F.array(F.struct(F.lit(1).alias("part"), F.lit("chart_data").alias("content_type"), F.col("json").alias("text")), F.struct(F.lit(2).alias("part"), F.lit("prose").alias("content_type"), F.col("text").alias("text"))))
    more = charts.select("doc", "page", kinds.alias("x")).select("doc", "page", "x.part", "x.content_type", "x.text")
    rows = pages.select("doc", "page", F.lit(0).alias("part"), F.lit("prose").alias("content_type"), "text").unionByName(more)
    return rows.withColumn("position", F.row_number().over(W.partitionBy("doc").orderBy("page", "part"))).drop("part")


def merged(found: dict[str, DataFrame], wanted: DataFrame, by_page: bool = True) -> DataFrame:
    """Wanted (doc, page, extractor) pages with the text that their extractor gave; text of the others does not count. Without
    by_page, wanted are documents (doc, extractor), with all pages that their extractor gave."""
    rows = None
    for name, pages in found.items():
        part = pages.select("doc", "page", "text", F.lit(name).alias("extractor"))
        rows = part if rows is None else rows.unionByName(part)
    return wanted.join(rows, ["doc", "page", "extractor"], "left") if by_page else wanted.join(rows, ["doc", "extractor"])


#: Escalations after a document's first extractor.
MOST = 3


def escalated(start: DataFrame, extractors: dict, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, extractor) through extractors until one passes the checks: (doc, tried, extractor, escalations, passed), tried
    in order, and the pages (doc, page, text, extractor) that the last one gave.

    extractors: by names of PATH, functions from documents (doc) to their pages (doc, page, text). In a round each extractor sees
    the documents that have come to it, and no others; those whose pages fail go on to the next one of PATH, up to `most` times.
    So there are most + 1 rounds whatever the number of documents, each a table in the shared folder. A document of which an
    extractor gives no page fails there. Documents repeat once; a null document or an extractor that isn't of PATH isn't tried.
    """
    open_ = start.where("doc is not null").select("doc", "extractor").dropDuplicates(["doc"]).where(F.col("extractor").isin(*PATH))
    open_ = open_.select("doc", "extractor", F.array("extractor").alias("tried"))
    done = pages = None
    for k in range(most + 1):
        open_ = written(open_)
        found = merged({name: f(open_.where(F.col("extractor") == name).select("doc")) for name, f in extractors.items()}, open_.select("doc", "extractor"), by_page=False)
        found = written(found)
        report = quality.report(found, "doc", "text").select("doc", "escalate")
        judged = open_.join(report, "doc", "left").withColumn("escalate", F.coalesce("escalate", F.lit(True))).withColumn("next", next_extractor(F.col("extractor")))
        goes = F.col("escalate") & F.col("next").isNotNull() & F.lit(k < most)
        judged = written(judged.withColumn("goes", goes))
        ended = judged.where("not goes").select("doc", "tried", "extractor", (F.size("tried") - 1).alias("escalations"), (~F.col("escalate")).alias("passed"))
        own = found.join(ended.select("doc"), "doc", "left_semi")
        done, pages = (ended, own) if done is None else (done.unionByName(ended), pages.unionByName(own))
        open_ = judged.where("goes").select("doc", F.col("next").alias("extractor"), F.concat("tried", F.array("next")).alias("tried"))
    return done, pages


def counts(done: DataFrame) -> DataFrame:
    """(extractor, documents, passed): what ended with each extractor."""
    return done.groupBy("extractor").agg(F.count("*").alias("documents"), F.count_if("passed").alias("passed"))
