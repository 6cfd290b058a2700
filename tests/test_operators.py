"""Operators on rows computed by hand."""

import io
import zipfile

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import conversation, entities, privacy, scores, text, units
from lodestone.operators import chunking, clusters, graph, matching, ranking, sessions, vectors
from lodestone.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_keep_inner_marks_and_drop_stop_words(spark):
    assert value(spark, text.tokens(F.lit("The CH-4 value is 1.5 of a x-ray b"))) == ["ch-4", "value", "1.5", "x-ray"]
    assert value(spark, text.tokens(F.lit("a of pH b"), keep=("a",))) == ["a", "ph"]


def test_titles(spark):
    assert value(spark, text.clean_title(F.lit("/x/9781234567890-soil_mechanics-basics_2014.pdf"))) == "Soil Mechanics Basics"
    assert value(spark, text.clean_title(F.lit(""))) == "Unknown Source"


def test_levenshtein_ratio(spark):
    assert value(spark, text.levenshtein_ratio(F.lit("abcd"), F.lit("abxd"))) == 0.75
    assert value(spark, text.levenshtein_ratio(F.lit(" "), F.lit(""))) == 1.0


def test_score_scale(spark):
    for raw, want in ((0.05, 0.125), (0.12, 0.31), (0.3, 0.725), (0.5, 0.92), (0.9, 0.98)):
        assert value(spark, scores.normalized(F.lit(raw))) == pytest.approx(want)


def test_expertise_levels(spark):
    level = lambda *x: value(spark, conversation.expertise(*map(F.lit, x)))
    assert level(0.0, 0, 0, 0) == "junior"
    assert level(0.3, 0, 1, 0) == "senior"
    assert level(0.0, 0, 1, 0) == "junior"
    assert level(0.3, 2, 2, 0) == "senior"
    assert level(0.3, 1, 1, 3) == "management"


def test_redaction_takes_detectors_in_order(spark):
    got = value(spark, privacy.redacted(F.lit("Mail a.b@c.org or call 555-123-4567, File #A-123")))
    assert "a.b@c.org" not in got and "[EMAIL]" in got and "[PHONE]" in got and "555-123-4567" not in got
    assert value(spark, privacy.redacted_terms(F.lit("Acme and ACME Corp"), ["Acme", "Acme Corp"])) == "[REDACTED] and [REDACTED]"


def test_units(spark):
    rows = spark.createDataFrame([(1.0, "m", "ft"), (100.0, "Celsius", "f"), (5.0, "kg", "kg"), (1.0, "m", "kg")], "v double, a string, b string")
    assert [r.converted for r in units.converted(rows, "v", "a", "b").orderBy("a", "b").collect()] == [212.0, 5.0, 3.28084, None]


def plain_pack(parts, size, overlap, least):
    out, now = [], []
    for p in parts:
        if now and sum(map(len, now)) + len(p) > size:
            if len("\n\n".join(now)) >= least:
                out.append("\n\n".join(now))
            tail, n = [], 0
            for q in reversed(now):
                if n + len(q) > overlap:
                    break
                tail, n = [q, *tail], n + len(q)
            now = [*tail, p]
        else:
            now.append(p)
    if now:
        last = "\n\n".join(now)
        if len(last) >= least:
            out.append(last)
        elif out:
            out[-1] += "\n\n" + last
    return out


@pytest.mark.parametrize("sizes", [[10, 20, 30, 5], [5], [50, 3], [8] * 30, [100, 100], []])
def test_packing_equals_a_plain_loop(spark, sizes):
    parts = [chr(97 + i % 26) * n for i, n in enumerate(sizes)]
    rows = spark.createDataFrame([(parts,)], "p array<string>")
    assert rows.select(chunking.packed(F.col("p"), 40, 16, 10).alias("x")).first().x == plain_pack(parts, 40, 16, 10)


def test_sections_follow_headings(spark):
    body = "intro\n# One\na\nb\n## Two\n1.1 Deep part\nc"
    got = chunking.sections(spark.createDataFrame([(1, body)], "doc_id long, text string")).orderBy("section").collect()
    assert [(r.heading, r.level, r.chapter, r.body) for r in got] == [("", 0, "", "intro"), ("# One", 1, "# One", "a\nb"), ("1.1 Deep part", 3, "## Two", "c")]


def test_long_chunks_split_at_sentences(spark):
    rows = spark.createDataFrame([(1, "One two. Three four! Five six? Seven.")], "id long, content string")
    got = chunking.split_long(rows, "content", 20).orderBy("sub_chunk").collect()
    assert [r.content for r in got] == ["One two. Three four!", "Five six? Seven."]


def test_summary_is_cut_at_a_sentence(spark):
    cut = lambda x, n: value(spark, clusters.summary(F.array(*map(F.lit, x)), n))
    assert cut(["short", "text"], 50) == "short text"
    assert cut(["One sentence here. Another one follows"], 25) == "One sentence here."
    assert cut(["aaaa bbbb cccc dddd"], 12) == "aaaa bbbb..."
    assert cut(["a" * 30], 10) == "a" * 10 + "..."


def test_threshold_clusters_are_greedy_in_order(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.id: r.cluster for r in clusters.by_threshold(rows, F.lit(1), 0.7).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_threshold_clusters_are_the_same_at_every_lot(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    r = np.random.default_rng(4)
    x = np.concatenate([np.repeat(r.normal(size=(3, 6)), 30, axis=0), r.normal(size=(60, 6))])[r.permutation(150)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(150):
        for g in (0, 1):
            if i % 5 != 0 or g == 0:
                want[g, i] = next((s for s in range(i) if want.get((g, s)) == s and unit[s] @ unit[i] >= 0.7), i)
    rows = spark.createDataFrame([(g, i, x[i].tolist()) for g, i in want], "g int, vec_id long, embedding array<double>").repartition(3)
    for lot in (7, 5000):
        assert {(r.group, r.id): r.cluster for r in clusters.by_threshold(rows, F.col("g"), 0.7, lot=lot).collect()} == want


def test_components_and_hops_cover_all_rows(spark, tmp_path):
    from lodestone.plans import graph_queries

    lines = [(1, 1), (1, 2), (2, 2), (3, 3), (4, 3), (5, 7), (6, 7), (6, 4), (7, 5), (7, 5)]
    spark.createDataFrame([(o, p, 1.0, 0.0) for o, p in lines], "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in range(1, 9)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    near = {}
    for o, p in lines:
        near.setdefault(f"o{o}", set()).add(f"p{p}")
        near.setdefault(f"p{p}", set()).add(f"o{o}")

    def within(seed, most):
        found, front = {seed: 0}, {seed}
        for k in range(1, most + 1):
            front = {y for x in front for y in near.get(x, ())} - set(found)
            found |= {x: k for x in front}
        return found

    got = {r.id: r.community for r in graph_queries.connected_components(spark, str(tmp_path)).collect()}
    assert got == {x: min(within(x, 99)) for x in near}
    hops = {(r.seed, r.id): r.hops for r in graph_queries.hop_scores_all(spark, str(tmp_path)).collect()}
    assert hops == {(f"p{p}", x): k for p in range(1, 9) for x, k in within(f"p{p}", 2).items()}


def test_hops_deal_edges_once(spark, tmp_path):
    from lodestone.plans import graph_queries

    big = 2**62 + 5
    for folder, last in (("few", 9), ("big", big)):
        spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2), (2, last), (None, 1)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/{folder}/lineitem.parquet")
        spark.createDataFrame([(1,), (2,), (2,), (7,), (last,)], "p_partkey long").write.parquet(f"{tmp_path}/{folder}/part.parquet")
        df = graph_queries.hop_scores_all(spark, f"{tmp_path}/{folder}")
        want = {("p1", "p1", 0), ("p1", "o1", 1), ("p1", "p2", 2), ("p2", "p2", 0), ("p2", "o1", 1), ("p2", "o2", 1), ("p2", "p1", 2), ("p2", f"p{last}", 2), ("p7", "p7", 0)}
        want |= {(f"p{last}", f"p{last}", 0), (f"p{last}", "o2", 1), (f"p{last}", "p2", 2)}
        got = [(r.seed, r.id, r.hops) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want  # a part that is there twice is one seed
    with_one = graph.hops(graph_queries._edges(spark, f"{tmp_path}/few"), spark.createDataFrame([("p1",)], "id string"), 3)
    assert {(r.id, r.hops) for r in with_one.collect()} == {("p1", 0), ("o1", 1), ("p2", 2), ("o2", 3)}


def test_jaccard_of_long_neighbours(spark, tmp_path):
    from lodestone.plans import search_queries

    long = " ".join(f"w{k}" for k in range(1000))
    rows = [(1, long, "en", len(long)), (2, long + " x", "en", len(long) + 2), (3, "w1 y", "en", None), (4, "w1", "de", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.jaccard for r in search_queries.jaccard_pairs(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): round(1000 / 1001, 6), (2, 3): round(1 / 1002, 6)}


def test_diversity_respects_sources(spark):
    rows = spark.createDataFrame([(1, i, 1.0 - i / 10, "s" if i < 4 else "t", [f"w{i}", "x"]) for i in range(6)], "query_id long, doc_id long, score double, source string, words array<string>")
    got = ranking.diverse(rows, 4, per_source=2).orderBy("pick").collect()
    assert got[0].doc_id == 0 and len(got) == 4 and sum(r.doc_id < 4 for r in got) == 2


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], "query_id long, doc_id long, rank int, score double")
    b = spark.createDataFrame([(1, 11, 1, 5.0)], "query_id long, doc_id long, rank int, score double")
    got = {r.doc_id: r for r in ranking.fused({"dense": (a, 0.7), "sparse": (b, 0.3)}).collect()}
    assert got[11].rrf_score == pytest.approx(0.7 / 62 + 0.3 / 61, abs=1e-8) and got[11].score == 0.8 and got[11].rank == 1


def test_gate_falls_back(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1), (2, 3, 0.1), (2, 4, 0.2)], "query_id long, doc_id long, score double")
    assert sorted(r.doc_id for r in ranking.gated(rows, "score", 0.5, 1).collect()) == [1, 4]


def test_nearest_leaves_the_query_out(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    good = vectors.valid(rows, 2)
    got = vectors.nearest(good, good.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2]
    assert vectors.nearest(good, good.where("false"), 5).count() == 0


def test_positions(spark):
    rows = spark.createDataFrame([(1, "ab12cd345e6")], "id long, t string")
    assert [(r.found, r.at) for r in matching.positions(rows, "id", "t", r"\d+").orderBy("at").collect()] == [("12", 2), ("345", 6), ("6", 10)]
    near = graph.near_each_other(rows, "id", "t", "[a-z]+", r"\d+", 2).collect()
    assert {(r.a, r.b) for r in near} == {("ab", "12"), ("cd", "12"), ("cd", "345"), ("e", "6")}


def test_nearest_in_tiles_is_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 7)
    monkeypatch.setattr(vectors, "BLOCK", 5)
    v = np.random.default_rng(3).integers(-2, 3, (120, 4)) + 0.5  # many copies, which tie
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(rows, rows.where("vec_id % 9 = 0"), 10).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 120, 9):
        near = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(120) if i != q)[:10]
        assert [got.pop((q, k)) for k in range(1, 11)] == [i for _, i in near]
    assert not got


def test_words_end_at_letters_of_other_scripts_as_in_sql(spark):
    rows = spark.createDataFrame([(1, "éAIR 12 FRANÇAIS"), (2, None)], "id long, t string")
    found = [(r.found, r.at) for r in matching.positions(rows, "id", "t", r"\b[A-Z]{3,}\b").orderBy("at").collect()]
    assert found == [("AIR", 1), ("FRAN", 8), ("AIS", 13)]
    names = entities.extracted(rows.withColumn("t", F.lit("éISO 123")), "id", "t").where("label = 'Standard' and id = 1").collect()
    assert [r.name for r in names] == ["ISO 123"]


def test_communities(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z")], "src string, dst string")
    assert {r.id: r.community for r in graph.communities(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_clamped_sum_holds_at_each_step(spark):
    steps = F.array(*map(F.lit, [0.3] * 5 + [-0.3]))
    assert value(spark, sessions.clamped_sum(steps)) == pytest.approx(0.7)


def word_file(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "soil").mkdir()
    (tmp_path / "soil" / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "soil" / "b.md").write_text("# head")
    (tmp_path / "soil" / "c.docx").write_bytes(word_file('<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p><w:p/>'))
    (tmp_path / "soil" / "d.bin").write_bytes(b"x")
    found = files.scan(spark, str(tmp_path))
    assert {(r.name, r.topic) for r in found.collect()} == {("a.txt", "soil"), ("b.md", "soil"), ("c.docx", "soil")}
    got = {r.path.rpartition("/")[2]: r.text for r in files.texts(found).collect()}
    assert got == {"a.txt": "plain  text", "b.md": "# head", "c.docx": "# Title\n\n**bold**"}
    known = files.manifest_rows(found.where("name = 'a.txt'"), F.lit(1))
    assert {r.name for r in files.new_files(found, known).collect()} == {"b.md", "c.docx"}
    assert files.stale(known, found.where("name != 'a.txt'")).count() == 1


def test_streams(spark, tmp_path):
    from lodestone.streaming import events

    at = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01 00:02:00"])
    frame = pd.DataFrame({"user": [1, 1, 1, 1], "id": [1, 2, 3, 4], "at": at, "action": list("abab")})
    spark.createDataFrame(frame).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, id long, at timestamp, action string").parquet(str(tmp_path / "in")).withWatermark("at", "1 hour")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert [(r.id, r["count"], r.allowed) for r in sorted(run(events.rate_limit(stream, "user", 2, 60), "limited"))] == [(1, 1, True), (2, 2, True), (3, 3, False), (4, 1, True)]
    assert sorted((r.previous, r.next) for r in run(events.transitions(stream, "user"), "moves")) == [("a", "b"), ("a", "b"), ("b", "a")]


@pytest.mark.parametrize(("given", "want"), [('say {"a": 1} now', '{"a": 1}'), ("{'a': None, b: True, 'c': [1, 2,],}", '{"a": null, "b": true, "c": [1, 2]}'), ('{"a": [1, {"b": "x', '{"a": [1, {"b": "x"}]}'), ("nothing", None), (None, None)])
def test_json_repair(given, want):
    from lodestone.functions.json_text import repaired

    assert repaired(given) == want


def test_json_repair_column(spark):
    from lodestone.functions.json_text import repair_json

    rows = spark.createDataFrame([('{"a":1}',), ("{'a': 1",), ("x",), (None,)], "t string")
    assert [r.x for r in rows.select(repair_json(F.col("t")).alias("x")).collect()] == ['{"a":1}', '{"a": 1}', None, None]


def test_detectors_know_letters_beyond_ascii(spark):
    count = lambda t, k: value(spark, F.size(privacy.found(F.lit(t), k)))
    assert count("see File AB-123 and éFile AB-123", "file_number") == 1
    assert count("plate ABC 123", "license_plate") == 1
    assert value(spark, privacy.names(F.lit("Dr. Jane Doe met Mr Poe"))) == ["Dr. Jane Doe", "Mr Poe"]


def test_tools_and_guard(spark, tmp_path):
    from lodestone.plans.tools import Tool, Tools, read_only, run_sql
    from lodestone.sources import lexicon

    tools = Tools()
    tools.add(Tool("first", lambda rows, n, by="id": rows.orderBy(by).limit(n), "search"))
    assert tools.call("first", spark.range(5), n=2, other=1).count() == 2
    assert tools.names("search") == ["first"] and tools.names("none") == []
    with pytest.raises(TypeError):
        tools.call("first", spark.range(5))
    with pytest.raises(ValueError):
        tools.add(Tool("first", lambda rows: rows))
    assert read_only("select offset from settings") and not read_only("drop table x")
    spark.range(1500).createOrReplaceTempView("many_rows")
    assert run_sql(spark, "select * from many_rows").count() == 1000 and run_sql(spark, "select * from many_rows limit 1200").count() == 1200
    with pytest.raises(PermissionError):
        run_sql(spark, "insert into many_rows values (1)")
    (tmp_path / "lexicon.json").write_text('{"synonyms": [["a", "b"]], "topics": null, "unknown": 1}')
    assert lexicon.load(spark, str(tmp_path / "lexicon.json")) == lexicon.Lexicon(synonyms=[["a", "b"]])
    assert lexicon.load(spark, None).topics == ["general"]


def test_page_routing(spark):
    from lodestone.operators import routing

    assert [value(spark, routing.next_extractor(F.lit(x))) for x in ("text", "vision", "none")] == ["layout", None, None]
    pages = spark.createDataFrame([("d", 1, "x" * 400), ("d", 2, "x" * 400), ("d", 3, "short")], "doc string, page int, text string")
    figures = spark.createDataFrame([("d", 1, 10.0, 100.0), ("d", 2, 30.0, 100.0), ("d", 2, 1.0, 100.0), ("d", 3, 1.0, 100.0)], "doc string, page int, area double, page_area double")
    assert sorted(r.page for r in routing.for_vision(pages, figures).collect()) == [2, 3]
    charts = spark.createDataFrame([("d", 1, "{}", "a chart")], "doc string, page int, json string, text string")
    assert [(r.page, r.content_type, r.text[:7]) for r in routing.with_charts(pages, charts).orderBy("position").collect()] == [(1, "prose", "xxxxxxx"), (1, "chart_data", "{}"), (1, "prose", "a chart"), (2, "prose", "xxxxxxx"), (3, "prose", "short")]
    wanted = spark.createDataFrame([("d", 1, "text"), ("d", 2, "ocr")], "doc string, page int, extractor string")
    assert {r.page: (r.text or "")[:1] for r in routing.merged({"text": pages, "ocr": pages.limit(0)}, wanted).collect()} == {1: "x", 2: ""}


def test_components_leave_fewer_edges_each_round(spark, monkeypatch):
    r = np.random.default_rng(5)
    place = r.permutation(300)
    pairs = [(int(place[i]), int(place[i + 1])) for i in range(299) if i % 60] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (5, None)]
    sizes, own = [], graph.written

    def seen(df):
        out = own(df)
        if df.columns == ["high", "low"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", seen)
    got = {x.id: x.community for x in graph.communities(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    least = {v: v for p in pairs for v in p if v is not None and len(set(p)) == 2 and None not in p}
    for _ in least:
        before = dict(least)
        for a, b in pairs:
            if a is not None and b is not None and a != b:
                least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    assert got == least
    assert sizes[-1] == 0 and all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
