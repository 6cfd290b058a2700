"""Operators of answers, corrections, names and extracted text against rows worked out by hand or plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import conversation, privacy, text
from lodestone.operators import chunking, evaluation
from lodestone.plans.answer_queries import people_found
from lodestone.plans.catalog import ORACLES, QUERIES
from lodestone.plans.profile_queries import pii_number_counts, pii_redacted_text
from lodestone.registry import table


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


@pytest.mark.parametrize(
    "message,want",
    [
        ("Don't use feet, use meters instead", (3, "feet", "meters")),
        ("stop saying stuff, instead say things", (3, "stuff", "t")),  # the pattern's last part is as short as can be
        ("never do that again", (3, "that again", "")),
        ("Always use metric. Thanks", (4, "", "metric")),
        ("this is way too verbose for me", (5, "verbose responses", "concise responses")),
        ("i meant clay not sand", (6, "sand", "i meant clay")),
        ("actually, it's the other one", (1, "", "the other one")),
        ("wrong", (2, "", "wrong")),
        ("wrong " + "x" * 120, (2, "", "x" * 120)),
        ("no", None),
        ("what a fine day", None),
    ],
)
def test_corrections(spark, message, want):
    got = conversation.corrected(spark.createDataFrame([(message,)], "t string"), "t").collect()
    assert [(r.kind, r.wrong, r.right) for r in got] == ([want] if want else [])


def python_people(t):
    found = [(m.group(0), 0.9) for m in re.finditer(privacy.BEHIND_TITLE, t)]
    for m in re.finditer(privacy.TWO_WORDS, t):
        a, b = m.group(1).lower(), m.group(2).lower()
        if a not in privacy.NO_NAMES and b not in privacy.NO_NAMES and a not in privacy.PLACES:
            found.append((m.group(0), 0.7))
    found += [(m.group(0), 0.9) for m in re.finditer(privacy.QUALIFIED, t)]
    for trigger in privacy.TRIGGERS:
        found += [(m.group(1), 0.85) for m in re.finditer(rf"\b{re.escape(trigger)}\s*:?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", t, re.I) if m.group(1).lower() not in privacy.NO_NAMES]
    return sorted(found)


@pytest.mark.parametrize(
    "t", ["Dr. Jane Doe met Mr Smith in New York.", "Prepared by: Anna Lee, P.Eng. and Bob Ray M.Sc.", "contact the owner: Max. Final Report, Site Plan; River Song", "Zoë Bell and Al Ün, c/o Ada Byron", ""]
)
def test_people(spark, t):
    got = one(spark, t, privacy.people(F.col("t")).alias("p")).p
    assert sorted((x.name, x.confidence) for x in got) == python_people(t)


def test_people_of_all_documents(spark, data):
    want = {}
    for r in table(spark, data, "documents").select("doc_id", "text").collect():
        for name, sure in python_people(r.text or ""):
            best, n = want.get((r.doc_id, name.lower()), (0, 0))
            want[r.doc_id, name.lower()] = max(best, sure), n + 1
    assert {(r.doc_id, r.name): (r.confidence, r.n) for r in people_found(spark, data).collect()} == want


def test_detectors_and_redaction_of_all_documents(spark, data):
    docs = {r.doc_id: r.text or "" for r in table(spark, data, "documents").select("doc_id", "text").collect()}
    rest = ("license_plate", "project_number", "file_number")
    for r in pii_number_counts(spark, data).collect():
        want = [len(re.findall(privacy.DETECTORS[k], docs[r.doc_id], re.I)) for k in rest] + [len(re.findall(privacy.TITLED, docs[r.doc_id]))]
        assert [*(r[k] for k in rest), r.titled] == want
    import hashlib

    for r in pii_redacted_text(spark, data).collect():
        out = docs[r.doc_id]
        for kind, pattern in privacy.DETECTORS.items():
            out = re.sub(pattern, privacy.PLACEHOLDERS[kind], out, flags=re.I)
        assert (r.digest, r.n) == (hashlib.md5(out.encode()).hexdigest(), len(out))


@pytest.mark.parametrize("t,want", [("3.5 m", True), ("-2", True), ("0.0-3.5 m", True), ("100%", True), ("John", False), ("3 cats", False)])
def test_measures(spark, t, want):
    assert one(spark, t, privacy.is_measure(F.col("t")).alias("x")).x is want


def test_replacement_counts(spark):
    got = one(spark, "Acme (ACME) and a.b", privacy.replaced(F.col("t"), ["acme", "a.b"]).alias("x")).x
    assert (got.text, got.n) == ("[REDACTED] ([REDACTED]) and [REDACTED]", 3)


def test_cleaned_text_and_titles(spark):
    assert one(spark, "\n a\n\n\n\nb-\nc \0d ", text.cleaned(F.col("t")).alias("x")).x == "a\n\nbc d"
    assert one(spark, "Page 1 of the text\n12345678901\nshort\n  A fine title here \nrest of it all", text.title_line(F.col("t")).alias("x")).x == "A fine title here"
    assert one(spark, "short", text.title_line(F.col("t")).alias("x")).x is None
    assert one(spark, "abcdefg", text.by_length(F.col("t"), F.lit(3)).alias("x")).x == ["ab", "cd", "efg"]


def python_merged(paragraphs, most):
    out, i = [], 0
    equation, where = re.compile(chunking.EQUATION[4:], re.M), re.compile(r"^\s*(?:where|in which|such that|with|and)\s*[:\-]?\s*$", re.I | re.M)
    while i < len(paragraphs):
        p, q = paragraphs[i], paragraphs[i + 1] if i + 1 < len(paragraphs) else None
        if q is not None and equation.search(p) and (where.match(q) or q.lstrip().lower().startswith("where") and "=" in q) and len(p) + 2 + len(q) <= most:
            out.append(p + "\n\n" + q)
            i += 2
        else:
            out.append(p)
            i += 1
    return out


def test_equations_keep_their_symbols(spark):
    for own in (["q = a + b", "Where: a = 1", "x"], ["q = a", "where a is", "y"], ["q = a", "with:", "z = 1", "Where c = 2", "where d = 3"], ["∑ x", "Where: b = " + "1" * 50], [], ["text", "where a = 1"], [r"\frac{a}{b}", "such that", "c"]):
        df = spark.createDataFrame([(own,)], "p array<string>")
        for most in (4000, 40):
            assert df.select(chunking.with_symbols(F.col("p"), most).alias("x")).first().x == python_merged(own, most)


def test_tables_split_at_rows(spark):
    df = spark.createDataFrame([([5, 5, 5, 50, 1, 1],)], "n array<int>").select(F.transform("n", lambda n: F.repeat(F.lit("x"), n)).alias("l"))
    assert df.select(chunking.table_rows(F.col("l"), 10, 24).alias("x")).first().x == [0, 0, 1, 2, 3, 3]


def test_answer_and_adversarial_scores(spark):
    rows = spark.createDataFrame([(1, 0.5, None, 1.0), (2, None, None, None), (3, 1.0, 0.0, None)], "i int, k double, e double, o double")
    assert [round(r.x, 6) for r in rows.select(evaluation.answer_score(F.col("k"), F.col("e"), F.col("o")).alias("x")).collect()] == [round((0.15 + 0.4) / 0.7, 6), 0.0, 0.5]
    cases = [("out_of_scope", 200, True, 0.9, 0, "", None, 1.0), ("out_of_scope", 200, True, 0.9, 3, "", None, 0.7), ("injection", 200, True, 0.1, 3, "the API_KEY", None, 0.7), ("ambiguous", 500, False, 0.1, 0, "", None, 0.3), ("long_query", 0, False, 0.0, 0, "", "Timeout after", 1.0), ("empty_garbage", 422, False, 0.0, 0, "", None, 1.0), ("else", 0, False, 0.0, 0, "", None, 0.0)]
    df = spark.createDataFrame(cases, "c string, s int, ok boolean, f double, n int, x string, e string, want double")
    for r in df.select("want", evaluation.adversarial_score(*(F.col(c) for c in ("c", "s", "ok", "f", "n", "x", "e"))).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def test_deletes(spark):
    from lodestone.sources.files import without

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "i int, s string")
    gone = spark.createDataFrame([("b",)], "s string")
    assert sorted(r.i for r in without(df, s=gone).collect()) == [1, 3, 4]
    assert sorted(r.i for r in without(df, s=["a"], i=[2]).collect()) == [3]


def python_chunks(t, size=1000, overlap=150, least=100, most=1600):
    """(section, chunk, sub, text) of a text whose lines are paragraphs, by plain loops."""
    def level(x):
        x = x.strip(" ")
        for pattern, n in chunking.HEADINGS:
            if re.search(pattern, x):
                return n
        return len(re.match("#+", x).group()) if re.search(chunking.MARKDOWN, x) else None

    sections, chapter = [[0, "", "", []]], ""
    for line in t.replace("\n", "\n\n").split("\n"):
        if (n := level(line)) is None:
            sections[-1][3].append(line)
        else:
            chapter = line.strip(" ") if n <= 2 else chapter
            sections.append([len(sections), line.strip(" "), chapter, []])
    out = []
    for number, heading, own_chapter, lines in sections:
        parts = [p.strip() for p in re.split(r"\n\s*\n", "\n".join(lines)) if p.strip()]
        done, now = [], []
        for p in parts:
            if now and sum(map(len, now)) + len(p) > size:
                if len("\n\n".join(now)) >= least:
                    done.append("\n\n".join(now))
                kept = []
                for x in reversed(now):
                    if sum(map(len, kept)) + len(x) > overlap:
                        break
                    kept.insert(0, x)
                now = kept
            now = [*now, p]
        last = "\n\n".join(now)
        if now and len(last) >= least:
            done.append(last)
        elif now and done:
            done[-1] += "\n\n" + last
        bare = lambda x: re.sub(r"^#+\s*", "", x).strip(" ")
        line = " ".join(f"[{k}: {v}]" for k, v in (("Chapter", bare(own_chapter)[:50]), ("Section", bare(heading))) if v)
        for i, body in enumerate(done):
            whole = (line + "\n\n" if line else "") + body
            if len(whole) <= most:
                out.append((number, i, 0, whole))
                continue
            runs, sentence = [], ""
            for x in re.split(r"(?<=[.!?])\s+", whole):
                if sentence and len(sentence) + 1 + len(x) > most:
                    runs.append(sentence)
                    sentence = x
                else:
                    sentence = f"{sentence} {x}" if sentence else x
            out += [(number, i, k, x) for k, x in enumerate([*runs, sentence])]
    return out


def test_chunks_of_all_documents(spark, data):
    import hashlib

    from lodestone.plans.graph_queries import chunk_pack

    want = set()
    for r in table(spark, data, "documents").select("doc_id", "text").collect():
        want |= {(r.doc_id, a, b, c, len(x), hashlib.md5(x.encode()).hexdigest()) for a, b, c, x in python_chunks(r.text or "")}
    got = {(r.doc_id, r.section, r.chunk_index, r.sub_chunk, r.chars, r.digest) for r in chunk_pack(spark, data).collect()}
    assert got == want and any(x[3] for x in got) and any(x[2] for x in got)


def test_equation_paragraphs_of_all_documents(spark, data):
    import hashlib

    from lodestone.plans.answer_queries import equation_paragraphs

    want = set()
    for r in table(spark, data, "documents").select("doc_id", "text").collect():
        lines = [x for x in (r.text or "").split("\n") if x.strip(" ")]
        some = [("q = " + x, "Where: c = " + x, x)[i % 3] for i, x in enumerate(lines)]
        want |= {(r.doc_id, i, len(x), hashlib.md5(x.encode()).hexdigest()) for i, x in enumerate(python_merged(some, 4000))}
    assert {(r.doc_id, r.i, r.chars, r.digest) for r in equation_paragraphs(spark, data).collect()} == want


@pytest.mark.parametrize("name", ["table_split", "web_result_pages"])
def test_odd_rows_as_in_sql(spark, name, tmp_path):
    import duckdb

    # keys of up to six digits fill pieces to the last character; a page refers to quotes
    suppliers = [(k, f"Supplier#{k:09d}", n) for n in range(3) for k in (*range(5, 12), *range(95, 105), *range(100000 + n, 100009))]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    pages = [(i, f"https://a.org/{i}?x=&quot;", "<p>say &quot;yes&quot; &amp;amp; " + "no " * 20 * i + "</p>") for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("supplier", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    own = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(own.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, own.collect())) == sorted(want)


def test_results_are_searched_once_and_pages_cut_before_they_meet_questions(spark, data, capsys):
    QUERIES["kb_and_web"](spark, data).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan  # what was found is read, not searched for again
    assert "WindowGroupLimit [k" in plan and ", 3, Partial" in plan
