"""Escalation of extractors against a loop over documents, and result pages against those read by hand."""

import random

from pyspark.sql import functions as F

from lodestone.functions import results
from lodestone.operators import quality, routing


def test_escalation_equals_a_loop(spark):
    r = random.Random(2)
    good, bad = "A clean page of text that ends as it should, and is long enough to pass.", "\x01\x02 □□□□□□□□□□ " * 5
    # the extractor from which on a document's pages are clean; none for some
    clean = {f"d{i}": r.choice([*routing.PATH, None]) for i in range(40)}
    start = {d: r.choice(routing.PATH) for d in clean}
    pages = spark.createDataFrame([(d, p, routing.PATH.index(c) if c else 99) for d, c in clean.items() for p in range(3)], "doc string, page int, at int")
    seen = {name: [] for name in routing.PATH}

    def extract(name):
        def own(docs):
            seen[name].append(docs)
            text = F.when(F.col("at") <= routing.PATH.index(name), good).otherwise(bad)
            return pages.join(docs, "doc", "left_semi").where(~((F.col("doc") == "d7") & F.lit(name == "layout"))).select("doc", "page", text.alias("text"))

        return own

    begun = spark.createDataFrame([*start.items(), *list(start.items())[:3], (None, "text"), ("zz", "none")], "doc string, extractor string")
    done, kept = routing.escalated(begun, {name: extract(name) for name in routing.PATH}, most=2)
    got = {x.doc: (x.tried, x.passed, x.escalations) for x in done.collect()}
    want = {}
    for d, name in start.items():
        tried = [name]
        passes = lambda n: clean[d] is not None and routing.PATH.index(clean[d]) <= routing.PATH.index(n) and not (d == "d7" and n == "layout")  # noqa: B023, E731
        while not passes(tried[-1]) and len(tried) <= 2 and tried[-1] != routing.PATH[-1]:
            tried.append(routing.PATH[routing.PATH.index(tried[-1]) + 1])
        want[d] = (tried, passes(tried[-1]), len(tried) - 1)
    assert got == want
    texts = {(x.doc, x.page): x.text for x in kept.collect()}
    assert all(texts[d, p] == (good if passed else bad) for d, (_, passed, _) in want.items() for p in range(3) if d != "d7")
    assert {x.extractor: x.passed for x in routing.counts(done).collect()} == {n: sum(p for t, p, _ in want.values() if t[-1] == n) for n in {t[-1] for t, _, _ in want.values()}}
    assert not quality.report(kept.where(F.col("text") == good), "doc", "text").where("escalate").count()


def read(spark, value, function, limit=5):
    row = spark.createDataFrame([(value,)], "t string").select(function(F.col("t"), limit).alias("r")).first()
    return [tuple(x) for x in row.r]


def test_html_results(spark):
    page = """<article class="result a"><a href='https://x.org/?a=1&amp;b=2' rel=z>One <b>&lt;two&gt;</b></a>
<p class="content">Some&nbsp; text &amp; more</p></article><article class=other><a href="https://no">n</a></article>
<article class="my-result"><a href="/local">local</a></article><article class="result">no link</article>
<ARTICLE CLASS="result"><A HREF="http://y">Y</A></ARTICLE>"""
    assert read(spark, page, results.from_html) == [("One <two>", "https://x.org/?a=1&b=2", "Some text & more"), ("Y", "http://y", "")]
    assert read(spark, page, results.from_html, 1) == [("One <two>", "https://x.org/?a=1&b=2", "Some text & more")]
    assert read(spark, None, results.from_html) == [] == read(spark, "", results.from_html)


def test_json_results(spark):
    page = '{"results": [{"title": " T ", "url": "u", "content": "' + "c" * 400 + '"}, {"url": null, "score": 3}]}'
    assert read(spark, page, results.from_json) == [("T", "u", "c" * 300), ("", "", "")]
    assert read(spark, "no json", results.from_json) == [] == read(spark, None, results.from_json)


def test_stages_are_shared_and_finished_sets_are_skipped(spark, tmp_path):
    from lodestone.operators import experiments

    at, calls = f"file://{tmp_path}/store", []

    def once(version):
        stages = experiments.Stages(spark, at, version)

        def result(name, settings):
            calls.append(name)
            base = stages.get("base", {"x": settings["x"]}, [], lambda: spark.range(settings["x"]).withColumnRenamed("id", "n"))
            twice = stages.get("twice", {}, [base], lambda: base.selectExpr("2 * n AS n"))
            return twice.selectExpr(f"sum(n) + {settings['y']} AS total")

        configs = {"a": {"x": 3, "y": 0}, "b": {"x": 3, "y": 1}, "c": {"x": 5, "y": 0}}
        return stages, {r.config_id: r.total for r in experiments.run(spark, at, "layer", configs, result).collect()}

    stages, found = once("v1")
    assert found == {"a": 6, "b": 7, "c": 20} and stages.made == 4 and calls == ["a", "b", "c"]
    stages, found = once("v1")
    assert found == {"a": 6, "b": 7, "c": 20} and stages.made == 0 and len(calls) == 3
    other = experiments.run(spark, at, "layer", {"d": {}}, lambda name, settings: spark.range(1).selectExpr("id + 9 AS total"))
    assert [(r.config_id, r.total) for r in other.collect()] == [("d", 9)]
    fresh = experiments.Stages(spark, at, "v2")
    fresh.get("base", {"x": 3}, [], lambda: spark.range(1))
    assert fresh.made == 1  # other inputs are other stages
    assert len(experiments.RETRIEVAL) == 15


def test_three_digits(spark):
    from lodestone.functions.display import three_digits

    values = [0.0, 1.0, 17.0, 99.95, 999.5, 12350.0, 12450.0, 104999.0, 999999.0, 0.5, 0.0123456, 0.000123456, 0.0000123456, -3.14159, -1234.5, 1e9, 1e-7, 100.0, 10.04, 0.09996]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", three_digits(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [f"{v:.3g}" for v in values]


def test_titles_and_sources(spark):
    from lodestone.functions.display import citation_source, citation_title

    show = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("o")).first().o
    assert show(citation_title, "Soil  Mechanics - libgen.li") == "Soil Mechanics" and show(citation_title, "A B [ PDFdrive ] __") == "A B" and show(citation_title, "(z-lib.org)") == "(z-lib.org)"
    assert show(citation_source, "/x/1234567890-soil_mechanics(2014).pdf") == "Soil Mechanics" and show(citation_source, "") == "Unknown Source" and show(citation_source, "a/[12]Deep Piles.tar.gz") == "Deep Piles.tar"
