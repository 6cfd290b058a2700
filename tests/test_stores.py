"""Stores: the lexical index, the graph, upserts, corrections, trees, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS, TERM, TOKEN
from lodestone.operators import corrections, graph_store, lexical, ordering, profile, trees, upserts


def test_an_index_is_built_once_for_its_files(spark, tmp_path, monkeypatch):
    docs = [(1, "en", "Red-hot 3.5 mm bolts and bolts"), (2, "en", None), (3, "de", "the"), (4, "de", "x y2 Zed")]
    path = f"{tmp_path}/docs"
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(path)
    posted, stats = lexical.stored(spark.read.parquet(path), F.col("lang"), "lang")
    want = {(t, i, w): (n, sum(c.values())) for i, t, s in docs for c in [Counter(w for w in re.findall(TOKEN, (s or "").lower()) if len(w) > 1 and w not in STOP_WORDS)] for w, n in c.items()}
    assert {(r.topic, r.doc_id, r.term): (r.tf, r.dl) for r in posted.collect()} == want
    plain = lexical.index(spark.read.parquet(path), F.col("lang"))[1]
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, plain.collect()))

    def never(*_):
        raise AssertionError("built again")

    built = lexical.index
    monkeypatch.setattr(lexical, "index", never)
    assert lexical.stored(spark.read.parquet(path), F.col("lang"), "lang")[0].count() == len(want)
    monkeypatch.setattr(lexical, "index", built)
    spark.createDataFrame([(9, "en", "new words")], "doc_id long, lang string, text string").write.mode("append").parquet(path)
    assert lexical.stored(spark.read.parquet(path), F.col("lang"), "lang")[0].count() == len(want) + 2


def test_term_counts(spark, monkeypatch):
    monkeypatch.setattr(profile, "MOST", 5)
    texts = ["The aaa red-Hot bolt x the bolt", None, "", "red-hot BOLT b2 of steel"]
    got = {r.term: r.n for r in profile.counted(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), (1, 2, 3)).collect()}
    want = Counter()
    for t in texts:
        w = [x.lower() for x in re.findall(TERM, t or "")]
        ok = [x not in STOP_WORDS and len(x) >= 2 for x in w]
        want.update(x for x in w if len(x) >= 3 and x not in STOP_WORDS and len(set(x)) > 1)
        for n in (2, 3):
            want.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1) if ok[i] and ok[i + n - 1])
    assert got == want


def test_positions_in_groups_over_many_tasks(spark):
    rows = [(g, k) for g in ("a", None, "b") for k in range(200 if g == "a" else 7)] + [("c", None)]
    random.Random(1).shuffle(rows)
    got = ordering.numbered(spark.createDataFrame(rows, "g string, k long").repartition(9), ["g"], ["k"]).collect()
    assert {(r.g, r.k): r.position for r in got} == {(g, k): (k or 0) + 1 for g, k in rows}


@pytest.mark.parametrize("budget", [1, 5000, 10**9])
def test_batches_equal_a_loop(spark, budget):
    r = random.Random(budget)
    rows = [(t, i, None if r.random() < 0.05 else "x" * r.randint(0, 200)) for t in "ab" for i in range(r.randint(20, 60))]
    got = upserts.batched(spark.createDataFrame(rows, "topic string, id long, text string").repartition(3), "topic", "id", "text", [], upsert=16, budget=budget).collect()
    want = {}
    for topic in "ab":
        own = sorted((i, max(1, len(s or "") // 4)) for t, i, s in rows if t == topic)
        for b in range(0, len(own), 16):
            sub, n, most = 0, 0, 0
            for i, tok in own[b : b + 16]:
                if n and (n + 1) * max(most, tok) ** 2 > budget:
                    sub, n, most = sub + 1, 0, 0
                n, most = n + 1, max(most, tok)
                want[topic, i] = (b // 16, sub)
    assert {(x.topic, x.id): (x.batch, x.sub_batch) for x in got} == want
    costs = defaultdict(list)
    for x in got:
        costs[x.topic, x.batch, x.sub_batch].append(x.tokens)
    assert all(len(v) == 1 or len(v) * max(v) ** 2 <= budget for v in costs.values())


def test_confidence_equals_a_loop_over_sessions(spark):
    r = random.Random(5)
    events = sorted((r.randrange(3), r.randrange(4), 1000 * k + r.randrange(400), r.choice(["use", "use", "good", "bad", "bad"]), k) for k in range(400))
    events.sort(key=lambda e: e[2])
    confidence, active, open_, want = defaultdict(lambda: 80), defaultdict(lambda: True), defaultdict(list), {}
    for session, correction, t, kind, k in events:
        if kind == "use":
            open_[session].append((correction, t))
            continue
        moved = {c for c, at in open_[session] if at > t - 3000}
        open_[session] = [(c, at) for c, at in open_[session] if c not in moved]
        for c in moved:
            confidence[c] = min(100, confidence[c] + 5) if kind == "good" else max(0, confidence[c] - 15)
            active[c] = active[c] and not (kind == "bad" and confidence[c] < 30)
            want[k, c] = (confidence[c] / 100, active[c])
    at = F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts")
    rows = spark.createDataFrame(events, "session long, correction long, t long, kind string, id long").repartition(4)
    feedback = rows.where("kind <> 'use'").select("session", F.col("id").alias("feedback_id"), at, (F.col("kind") == "good").alias("positive"))
    moves = corrections.touched(rows.where("kind = 'use'").select("session", "correction", at), feedback, 3000)
    got = corrections.confidences(moves, F.date_trunc("hour", F.col("ts").cast("timestamp"))).collect()
    assert {(x.feedback_id, x.correction): (x.confidence, x.active) for x in got} == want
    assert any(not a for _, a in want.values())


def test_corrections_merge_greedily(spark):
    rows = [(1, ["use metric units please"], ["please use metric tables", "be brief", "cite each source", "never"]), (2, [], ["a b c d", "B a c e", None, "x y"]), (3, ["1", "2", "3", "4"], ["5"]), (4, None, None)]
    got = {r.id: r.kept for r in spark.createDataFrame(rows, "id long, firm array<string>, learned array<string>").select("id", corrections.merged(F.col("firm"), F.col("learned")).alias("kept")).collect()}
    assert got == {1: ["use metric units please", "be brief", "cite each source"], 2: ["a b c d", "x y"], 3: ["1", "2", "3"], 4: []}


def test_tree_nodes_are_means_and_descent_finds_the_nearest(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(230, 5))
    nodes = trees.built(spark.createDataFrame([(i % 2, i, x[i].tolist()) for i in range(230)], "topic int, leaf long, v array<double>").repartition(4))
    rows = nodes.collect()
    for n in rows:
        own = [i for i in range(230) if i % 2 == n.topic][n.node * 10**n.level : (n.node + 1) * 10**n.level]
        assert n.n == len(own) and np.allclose(n.v, x[own].mean(0))
    assert {(n.topic, n.level) for n in rows if n.parent is None} == {(0, 2), (1, 2)}
    queries = spark.createDataFrame([(0, x[0].tolist()), (500, x[7].tolist())], "vec_id long, v array<double>")
    wide = trees.descended(nodes, queries, 4, beam=100).collect()  # a beam that leaves nothing out
    for q, v in ((0, x[0]), (500, x[7])):
        score = {i: round(float(x[i] @ v / np.linalg.norm(x[i]) / np.linalg.norm(v)), 6) for i in range(230) if i != q}
        assert [w.leaf for w in sorted(wide, key=lambda w: w["rank"]) if w.query_id == q] == sorted(score, key=lambda i: (-score[i], i))[:4]


def test_graph_store_merges_once_and_leaves_no_orphans(spark):
    store = graph_store.GraphStore(spark)
    rows = [("a", 1, "L", "x"), ("a", 2, "L", "x"), ("a", 2, "L", "y"), ("b", 3, "L", "x"), ("b", 3, "M", "z"), (None, 4, "L", "q"), ("a", None, "L", "q")]
    batch = lambda xs: spark.createDataFrame(xs, "topic string, chunk_id long, label string, name string")
    names = lambda s: {(r.label, r.name): (r.chunks, r.topics) for r in s.entities().collect()}
    store.merge(batch(rows))
    whole = {("L", "x"): (3, 2), ("L", "y"): (1, 1), ("M", "z"): (1, 1)}
    assert names(store) == whole
    store.merge(batch(rows[:3]))
    assert names(store) == whole and store.mentions().count() == 5
    assert names(graph_store.GraphStore(spark, store.path)) == whole  # a new session finds the last version
    store.delete_chunks(batch([("a", 2, "", "")]))
    assert names(store) == {("L", "x"): (2, 2), ("M", "z"): (1, 1)}
    assert [r.chunk_id for r in store.new_chunks(batch([("a", 1, "", ""), ("a", 2, "", "")])).collect()] == [2]
    store.rebuild(["a"], lambda topics: batch([("a", 5, "L", "new"), ("b", 6, "L", "no")]))
    assert names(store) == {("L", "new"): (1, 1), ("L", "x"): (1, 1), ("M", "z"): (1, 1)}
    store.delete_topics(["b"])
    assert names(store) == {("L", "new"): (1, 1)}
    store.delete_topics(["a"])
    assert names(store) == {} and store.mentions().count() == 0


def test_tokens_are_those_of_the_pattern():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1.-. \nÉK­İ\x00\ud800_") for _ in range(rng.randrange(25))) for _ in range(3000)] + ["The end. A-b.c- the 3.5."]
    count = lexical.counter()
    for t in texts:
        assert dict(count(t)) == Counter(w for w in re.findall(TOKEN, t.lower()) if len(w) > 1 and w not in STOP_WORDS)


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_a_search_hands_on_the_best_of_each_task_alone(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng = random.Random(2)
    docs = [(i, rng.choice(["en", "de", None]), " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(9)))) for i in range(400)]
    asked = [(q, " ".join(f"w{rng.randrange(14)}" for _ in range(4))) for q in range(9)]
    queries = spark.createDataFrame([*asked, (99, None)], "query_id long, text string")
    plain = {}

    def found(rows):
        posted, stats = lexical.index(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3, "doc_id"), F.col("lang"))
        out = {(r.query_id, r.topic, r["rank"]): (r.doc_id, r.score) for r in lexical.search(queries, posted, stats, 4).collect()}
        handed = []
        with monkeypatch.context() as m:
            summed = lexical._summed
            m.setattr(lexical, "_summed", lambda *a: handed.append(summed(*a)))
            plain.update({(r.query_id, r.topic, r["rank"]): (r.doc_id, r.score) for r in lexical.search(queries, posted, stats, 4).collect()})
        return out, handed[0], posted.rdd.getNumPartitions()

    out, handed, tasks = found(docs)
    assert out == plain and len({q for q, _, _ in out}) == 9
    assert handed.count() <= tasks * 9 * 2 * 4 < lexical.flat(lexical.packed(spark.createDataFrame(docs, "doc_id long, lang string, text string"), F.col("lang"))).count()
    plain.clear()
    out, handed, _ = found([*docs, *docs[:3]])  # ids that repeat count together, wherever their rows are
    assert out == plain and handed is None


@pytest.mark.parametrize("name", ["mrr_ndcg", "macro_average_by_tier", "live_hits", "context_blocks", "mmr_rerank"])
def test_hits_meet_their_documents_without_a_shuffle_of_texts(spark, data, name):
    from lodestone.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # less than the documents, as it is where they are many
    try:
        plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "documents.parquet" in physical and not re.search(r"Exchange hashpartitioning\(doc_id", physical), physical
