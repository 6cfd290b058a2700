"""Documents into retrieval chunks: sections by headings, paragraphs, greedy packing with overlap, long pieces by sentence.

Headings and paragraphs are rows, found with window functions; packing depends on the order of paragraphs and is a fold
over one section's paragraphs, which Spark's `aggregate` runs inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Heading patterns with their levels, and sizes in characters.
HEADINGS = ((r"^(?:Chapter|CHAPTER)\s+\d+[:\.\s]", 1), (r"^(?:PART|Part)\s+[IVX\d]+[:\.\s]", 1), (r"^\d+\.\s+[A-Z][A-Za-z]", 2), (r"^\d+\.\d+\s+[A-Z][A-Za-z]", 3), (r"^\d+\.\d+\.\d+\s+[A-Z][A-Za-z]", 4))
MARKDOWN = r"^#{1,4}\s+"
SIZE, OVERLAP, LEAST, MOST = 2500, 300, 100, 4000


def heading_level(line: Column) -> Column:
    """Level of a heading line, null for any other."""
    line = F.trim(line)
    out = None
    for pattern, level in HEADINGS:
        out = F.when(line.rlike(pattern), level) if out is None else out.when(line.rlike(pattern), level)
    return out.when(line.rlike(MARKDOWN), F.length(F.regexp_extract(line, "^(#+)", 1)))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, heading, level, chapter, body): the lines between headings; a heading without lines has no section.
    Headings of level 1 and 2 are chapters."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line")).withColumn("level", heading_level(F.col("line")))
    by = W.partitionBy(id_col).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(by))
    lines = lines.withColumn("chapter", F.last(F.when(F.col("level") <= 2, F.trim("line")), True).over(by))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    rows = lines.groupBy(id_col, "section").agg(
        F.max(F.when(F.col("level").isNotNull(), F.trim("line"))).alias("heading"), F.max("level").alias("level"), F.max_by("chapter", "n").alias("chapter"), F.count_if(F.col("level").isNull()).alias("lines"), body.alias("body")
    )
    return rows.where("lines > 0").select(id_col, "section", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("chapter", F.lit("")).alias("chapter"), "body")


def paragraphs(text: Column) -> Column:
    """Trimmed paragraphs of a text, those that are empty left out."""
    bare = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(bare, lambda p: p != "")


def packed(parts: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Paragraphs in chunks of up to `size` characters (separators not counted); each next chunk begins with the whole last
    paragraphs of the one before that fit in `overlap`. A chunk shorter than `least` is not kept; as the last one it is
    added to the chunk before, or lost where there is none."""
    join = lambda xs: F.array_join(xs, "\n\n")
    strings = "array<string>"

    def tail(xs: Column) -> Column:
        kept = F.aggregate(
            F.reverse(xs), F.struct(F.array().cast(strings).alias("p"), F.lit(0).alias("n"), F.lit(True).alias("go")),
            lambda s, p: F.when(s["go"] & (s["n"] + F.length(p) <= overlap), F.struct(F.concat(F.array(p), s["p"]).alias("p"), (s["n"] + F.length(p)).alias("n"), F.lit(True).alias("go"))).otherwise(
                F.struct(s["p"].alias("p"), s["n"].alias("n"), F.lit(False).alias("go"))
            ),
        )
        return kept

    def step(s: Column, p: Column) -> Column:
        full = (s["n"] + F.length(p) > size) & (F.size(s["now"]) > 0)
        done = F.when(F.length(join(s["now"])) >= least, F.concat(s["done"], F.array(join(s["now"])))).otherwise(s["done"])
        kept = tail(s["now"])
        new = F.struct(done.alias("done"), F.concat(kept["p"], F.array(p)).alias("now"), (kept["n"] + F.length(p)).alias("n"))
        return F.when(full, new).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(p)).alias("now"), (s["n"] + F.length(p)).alias("n")))

    def finish(s: Column) -> Column:
        last = join(s["now"])
        n = F.size(s["done"])
        merged = F.concat(F.slice(s["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(s["done"], -1), F.lit("\n\n"), last)))
        return F.when(F.size(s["now"]) == 0, s["done"]).when(F.length(last) >= least, F.concat(s["done"], F.array(last))).when(n > 0, merged).otherwise(s["done"])

    zero = F.struct(F.array().cast(strings).alias("done"), F.array().cast(strings).alias("now"), F.lit(0).alias("n"))
    return F.aggregate(parts, zero, step, finish)


def prefix(title: Column, chapter: Column, heading: Column) -> Column:
    """The line of context that stands before a chunk; empty without any."""
    bare = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"^#+\s*", ""))
    title = F.when(F.length(title) > 60, F.concat(F.substring(title, 1, 60), F.lit("..."))).otherwise(title)
    parts = [F.when(x != "", F.concat(F.lit(f"[{name}: "), x, F.lit("]"))) for name, x in (("Document", F.coalesce(title, F.lit(""))), ("Chapter", F.substring(bare(chapter), 1, 50)), ("Section", bare(heading)))]
    line = F.concat_ws(" ", *parts)
    return F.when(line != "", F.concat(line, F.lit("\n\n"))).otherwise("")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(id, section, chunk_index, content) of whole documents."""
    rows = sections(docs, id_col, text_col).select(id_col, "section", "heading", "chapter", paragraphs(F.col("body")).alias("parts"))
    rows = rows.select(id_col, "section", "heading", "chapter", packed(F.col("parts"), size, overlap, least).alias("packed"))
    rows = rows.select(id_col, "section", "heading", "chapter", F.posexplode("packed").alias("chunk_index", "body"))
    return rows.select(id_col, "section", "chunk_index", F.concat(prefix(F.lit(""), F.col("chapter"), F.col("heading")), F.col("body")).alias("content"))


def split_long(rows: DataFrame, text_col: str, most: int = MOST) -> DataFrame:
    """Chunks longer than `most` as runs of whole sentences, with their number in sub_chunk; a sentence longer than that
    stays whole."""
    text = F.col(text_col)
    zero = F.struct(F.array().cast("array<string>").alias("runs"), F.lit("").alias("now"))
    fold = lambda s, x: F.when(
        (s["now"] != "") & (F.length(s["now"]) + 1 + F.length(x) > most), F.struct(F.concat(s["runs"], F.array(s["now"])).alias("runs"), x.alias("now"))
    ).otherwise(F.struct(s["runs"].alias("runs"), F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(" "), x)).alias("now")))
    pieces = F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(sentences(text), zero, fold, lambda s: F.concat(s["runs"], F.array(s["now"]))))
    flat = rows.select(*(c for c in rows.columns if c != text_col), F.posexplode(pieces).alias("sub_chunk", text_col))
    return flat.select(*rows.columns, "sub_chunk")


# Signs of an equation, and of the list of its symbols.
EQUATION = r"(?m)(?:^\s*[A-Za-z_]+\s*=\s*|[Σ∑∫∂√±×÷∞≤≥≈∝∈∉∀∃π]|\\(?:frac|sum|int|sqrt|alpha|beta|gamma|sigma|phi)\b|\$\$.+\$\$|\$[^$]+\$)"
WHERE = r"(?im)\A\s*(?:where|in which|such that|with|and)\s*[:\-]?\s*$"


def with_symbols(paragraphs: Column, most: int) -> Column:
    """Paragraphs, an equation and the list of its symbols behind it as one where both have up to `most` characters."""
    fold = lambda s, p: F.when(
        s["open"] & (p.rlike(WHERE) | (F.lower(F.ltrim(p)).startswith("where") & F.contains(p, F.lit("=")))) & (F.length(F.element_at(s["out"], -1)) + 2 + F.length(p) <= most),
        F.struct(F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.concat(F.element_at(s["out"], -1), F.lit("\n\n"), p))).alias("out"), F.lit(False).alias("open")),
    ).otherwise(F.struct(F.concat(s["out"], F.array(p)).alias("out"), p.rlike(EQUATION).alias("open")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))
    return F.aggregate(paragraphs, start, fold, lambda s: s["out"])


def table_rows(lines: Column, header: int, size: int) -> Column:
    """The number of the piece that each line of a table goes to, where a piece with its header has up to `size` characters
    (a line too long alone is a piece)."""
    fold = lambda s, n: F.when(
        (s["used"] + n + 1 > size) & (s["rows"] > 0), F.struct((header + n + 1).alias("used"), F.lit(1).alias("rows"), (s["piece"] + 1).alias("piece"), F.concat(s["out"], F.array(s["piece"] + 1)).alias("out"))
    ).otherwise(F.struct((s["used"] + n + 1).alias("used"), (s["rows"] + 1).alias("rows"), s["piece"].alias("piece"), F.concat(s["out"], F.array(s["piece"])).alias("out")))
    start = F.struct(F.lit(header).alias("used"), F.lit(0).alias("rows"), F.lit(0).alias("piece"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.transform(lines, F.length), start, fold, lambda s: s["out"])


# Sizes and overlaps that are tried against each other, with and without the line of context.
SIZES, OVERLAPS = (400, 600, 800, 1000, 1200, 1500, 1800, 2000, 2500), (0, 50, 100, 150, 200, 300, 400)


def matrix(sizes=SIZES, overlaps=OVERLAPS) -> list[tuple[int, int]]:
    """(size, overlap) of all configurations whose overlap is less than half of the size."""
    return [(s, o) for s in sizes for o in overlaps if 2 * o < s]


def packed_sizes(lengths: Column, configs: list[tuple[int, int]], least: int = LEAST) -> Column:
    """What packed() makes of paragraphs of the given lengths for each (size, overlap): an array of struct(size, overlap,
    chunks, chars), from one fold over the lengths that carries a state for each configuration."""
    ints = "array<int>"
    span = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b) + 2 * F.greatest(F.size(xs) - 1, F.lit(0))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)

    def state(size, overlap, now, chunks, chars) -> Column:
        return F.struct(size.cast("int").alias("size"), overlap.cast("int").alias("overlap"), now.cast(ints).alias("now"), chunks.cast("int").alias("chunks"), chars.cast("int").alias("chars"))

    def kept(now: Column, overlap: Column) -> Column:
        """The longest run of last paragraphs that fits in the overlap."""
        n = F.aggregate(
            F.reverse(now), F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("go")),
            lambda s, p: F.struct(
                (s["k"] + F.when(s["go"] & (s["n"] + p <= overlap), 1).otherwise(0)).alias("k"), (s["n"] + F.when(s["go"] & (s["n"] + p <= overlap), p).otherwise(0)).alias("n"), (s["go"] & (s["n"] + p <= overlap)).alias("go")
            ),
        )["k"]
        return F.slice(now, F.size(now) - n + 1, n)

    def one(s: Column, p: Column) -> Column:
        full = (total(s["now"]) + p > s["size"]) & (F.size(s["now"]) > 0)
        long = full & (span(s["now"]) >= least)
        now = F.concat(F.when(full, kept(s["now"], s["overlap"])).otherwise(s["now"]), F.array(p))
        return state(s["size"], s["overlap"], now, s["chunks"] + F.when(long, 1).otherwise(0), s["chars"] + F.when(long, span(s["now"])).otherwise(0))

    def last(s: Column) -> Column:
        end, any_ = span(s["now"]), F.size(s["now"]) > 0
        own = any_ & (end >= least)
        chars = s["chars"] + F.when(own, end).when(any_ & (s["chunks"] > 0), end + 2).otherwise(0)
        return F.struct(s["size"].alias("size"), s["overlap"].alias("overlap"), (s["chunks"] + F.when(own, 1).otherwise(0)).alias("chunks"), chars.alias("chars"))

    zero = F.array(*(state(F.lit(a), F.lit(b), F.array(), F.lit(0), F.lit(0)) for a, b in configs))
    return F.aggregate(lengths, zero, lambda states, p: F.transform(states, lambda s: one(s, p)), lambda states: F.transform(states, last))


def swept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", configs: list[tuple[int, int]] | None = None, least: int = LEAST) -> DataFrame:
    """(config_id, size, overlap, prefixed, chunks, chars): the chunks that whole documents make under each configuration,
    without and with the line of context, and their characters. Texts are read once; what leaves a section is a row of
    numbers for each configuration, summed before it is shuffled."""
    parts = sections(docs, id_col, text_col).select("heading", "chapter", F.transform(paragraphs(F.col("body")), F.length).alias("lengths"))
    line = F.length(prefix(F.lit(""), F.col("chapter"), F.col("heading")))
    rows = parts.select(line.alias("line"), F.explode(packed_sizes(F.col("lengths"), configs or matrix(), least)).alias("x"))
    sums = rows.groupBy("x.size", "x.overlap").agg(F.sum("x.chunks").alias("chunks"), F.sum("x.chars").alias("bare"), F.sum(F.col("x.chunks") * F.col("line")).alias("lines"))
    rows = sums.select("size", "overlap", F.explode(F.array(F.lit(False), F.lit(True))).alias("prefixed"), "chunks", "bare", "lines")
    name = F.concat(F.lit("c"), "size", F.lit("_o"), "overlap", F.lit("_p"), F.col("prefixed").cast("int"))
    return rows.select(name.alias("config_id"), "size", "overlap", "prefixed", "chunks", (F.col("bare") + F.when(F.col("prefixed"), F.col("lines")).otherwise(0)).alias("chars"))
