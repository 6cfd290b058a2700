"""Files as tables: scans of landing folders, text of plain files and Word documents, manifests, checkpointed results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of files that are taken in.
ENDINGS = ("pdf", "txt", "md", "docx")
MANIFEST = "hash string, path string, topic string, size long, chunks long, at timestamp"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, topic, name, size, hash, content) of the files of a folder of topic folders, or of all below it."""
    pattern = "*.{" + ",".join(ENDINGS) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    rows = reader.option("recursiveFileLookup", "true").load(folder) if recursive else reader.load(f"{folder}/*")
    name = F.element_at(F.split("path", "/"), -1)
    topic = F.element_at(F.split("path", "/"), -2)
    return rows.select("path", topic.alias("topic"), name.alias("name"), F.col("length").alias("size"), F.md5("content").alias("hash"), "content")


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content the manifest doesn't have, each content once."""
    return files.join(manifest.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def stale(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose file is gone."""
    return manifest.join(files.select("hash"), "hash", "left_anti")


def manifest_rows(files: DataFrame, chunks: Column) -> DataFrame:
    return files.select("hash", "path", "topic", "size", chunks.cast("long").alias("chunks"), F.current_timestamp().alias("at"))


def docx_markdown(content: bytes) -> str:
    """A Word document's paragraphs and tables as Markdown: headings, bold and italic runs, tables with escaped bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")

    def run(r: ElementTree.Element) -> str:
        t = "".join(x.text or "" for x in r.iter(f"{_WORD}t"))
        marks = r.find(f"{_WORD}rPr")
        for tag, mark in (("b", "**"), ("i", "*")):
            if t.strip() and marks is not None and marks.find(f"{_WORD}{tag}") is not None:
                t = f"{mark}{t}{mark}"
        return t

    def paragraph(p: ElementTree.Element) -> str:
        t = "".join(run(r) for r in p.iter(f"{_WORD}r")).strip()
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        level = re.fullmatch(r"Heading\s?(\d)", style.get(f"{_WORD}val", "")) if style is not None else None
        return f"{'#' * int(level[1])} {t}" if level and t else t

    out = []
    for child in body if body is not None else ():
        if child.tag == f"{_WORD}p":
            out.append(paragraph(child))
        elif child.tag == f"{_WORD}tbl":
            rows = [[" ".join(paragraph(p) for p in cell.iter(f"{_WORD}p")).replace("|", "\\|") for cell in row.iter(f"{_WORD}tc")] for row in child.iter(f"{_WORD}tr")]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            out.append("\n".join([*lines[:1], "|" + " --- |" * len(rows[0]), *lines[1:]]) if rows else "")
    return "\n\n".join(x for x in out if x)


def texts(files: DataFrame, pdf_text=None) -> DataFrame:
    """(hash, path, topic, text): plain files with bad UTF-8 left out, Word documents as Markdown; PDF files by the function
    given (bytes to text), else null; null, too, for files that can't be read."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                ending = path.rpartition(".")[2].lower()
                try:
                    out.append(docx_markdown(content) if ending == "docx" else bytes(content).decode("utf-8", "ignore") if ending in ("txt", "md") else pdf_text(content) if pdf_text else None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    out.append(None)
            yield f[["hash", "path", "topic"]].assign(text=out)

    return files.select("hash", "path", "topic", "content").mapInPandas(each, "hash string, path string, topic string, text string")


def save_done(results: DataFrame, folder: str) -> None:
    """Adds results (layer, config_id, ...) to a folder, one subfolder a layer."""
    results.write.mode("append").partitionBy("layer").parquet(folder)


def left_to_do(configs: DataFrame, done: DataFrame) -> DataFrame:
    """Configurations without a result."""
    return configs.join(done.select("layer", "config_id").distinct(), ["layer", "config_id"], "left_anti")


def without(rows: DataFrame, **gone: DataFrame | list) -> DataFrame:
    """The rows of a store without those that a delete names: for each column a list of values or a table of them. Nulls
    aren't named by any."""
    for column, values in gone.items():
        if isinstance(values, list):
            rows = rows.where(~F.coalesce(F.col(column).isin(*values), F.lit(False))) if values else rows
        else:
            rows = rows.join(values.select(column), column, "left_anti")
    return rows
