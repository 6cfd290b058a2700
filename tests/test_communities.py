"""Leiden's communities, fuzzy names and chunk sweeps against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, communities, fuzzy
from lodestone.plans.graph_queries import _edges


def sequential(pairs, resolution, seed):
    """The quality of local moving and contraction, one vertex after another."""
    r, near = random.Random(seed), collections.defaultdict(dict)
    for a, b in pairs:
        if a != b:
            near[a][b] = near[b][a] = 1.0
    m = sum(len(n) for n in near.values()) / 2
    own, graph, degree = {v: v for v in near}, {v: dict(n) for v, n in near.items()}, {v: float(len(n)) for v, n in near.items()}
    moved_any = True
    while moved_any:
        moved_any, moved = False, True
        com, total = {v: v for v in graph}, dict(degree)
        while moved:
            moved = False
            order = list(graph)
            r.shuffle(order)
            for v in order:
                k = collections.Counter()
                for u, w in graph[v].items():
                    k[com[u]] += w
                total[com[v]] -= degree[v]
                gain = lambda c: k.get(c, 0) - resolution * degree[v] * total[c] / (2 * m)  # noqa: B023, E731
                best = max([com[v], *k], key=lambda c: (round(gain(c), 9), c == com[v]))  # noqa: B023
                total[best] += degree[v]
                if best != com[v]:
                    com[v], moved, moved_any = best, True, True
        own = {v: com[x] for v, x in own.items()}
        new, sums = collections.defaultdict(collections.Counter), collections.Counter()
        for v, n in graph.items():
            sums[com[v]] += degree[v]
            for u, w in n.items():
                if com[u] != com[v]:
                    new[com[v]][com[u]] += w
        graph, degree = {v: dict(new[v]) for v in sums}, sums
    return quality(near, own, resolution)


def quality(near, own, resolution):
    total, inside, m2 = collections.Counter(), 0, sum(len(n) for n in near.values())
    for v, n in near.items():
        total[own[v]] += len(n)
        inside += sum(own[u] == own[v] for u in n)
    return inside / m2 - resolution * sum(x * x for x in total.values()) / m2**2


def connected(near, own):
    groups = collections.defaultdict(set)
    for v, c in own.items():
        groups[c].add(v)
    for group in groups.values():
        seen, todo = set(), [min(group)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [u for u in near[v] if u in group]
        if seen != group:
            return False
    return all(c == min(g) for c, g in groups.items())


def test_quality_and_connection_on_the_order_graph(spark, data):
    edges = _edges(spark, data)
    labels = communities.written(communities.leiden(edges))
    pairs = [(r.src, r.dst) for r in edges.collect()]
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    found = communities.modularity(edges, labels)
    for level, resolution in communities.RESOLUTIONS.items():
        own = {r.id: r.community for r in labels.where(F.col("level") == level).collect()}
        assert set(own) == set(near) and connected(near, own)
        assert abs(found[level] - quality(near, own, resolution)) < 1e-9
        assert found[level] >= sequential(pairs, resolution, 0) - 1e-9


def test_cliques_are_communities(spark):
    pairs = [(10 * c + i, 10 * c + j) for c in range(8) for i in range(6) for j in range(i)] + [(10 * c, 10 * ((c + 1) % 8) + 1) for c in range(8)]
    edges = spark.createDataFrame([*pairs, *pairs[:9], (3, 3), (None, 5)], "src long, dst long")
    got = {r.id: r.community for r in communities.leiden(edges, {"fine": 1.0}, 1).collect()}
    assert got == {10 * c + i: 10 * c for c in range(8) for i in range(6)}
    sizes = communities.described(communities.leiden(edges, {"fine": 1.0}, 1), spark.createDataFrame([(10 * c + i,) for c in range(8) for i in range(c)], "id long")).collect()
    assert {(r.community, r.chunks, r.entities) for r in sizes} == {(10 * c, min(c, 6), 6 - min(c, 6)) for c in range(3, 8)}


def test_no_edges(spark):
    assert communities.leiden(spark.createDataFrame([], "src long, dst long")).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_names_are_all_within_the_distance(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab") for _ in range(n))
    terms = ["", "a", "ab"] + [word(r.randint(1, 22)) for _ in range(60)]
    words = ["", "b", None] + [word(r.randint(0, 25)) for _ in range(60)]
    for t in terms[10:40]:  # some that are near
        w = list(t)
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(w))
            w[k : k + r.randint(0, 1)] = r.choice(["", "a", "b"])
        words.append("".join(w).upper())
    a = spark.createDataFrame([(t,) for t in [*terms, None]], "term string")
    b = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(x.term, x.word): x.distance for x in fuzzy.near(a, b).collect()}
    low = {w.lower() for w in words if w is not None}
    want = {(t, w): d for t in set(terms) for w in low if (d := edits(t, w)) <= 2}
    assert got == want
    plan = fuzzy.near(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lookup_falls_back_to_parts(spark):
    names = spark.createDataFrame([("Part", "Red Widget"), ("Part", "red bolt"), ("Type", "ECONOMY"), ("Part", None)], "label string, name string")
    words = spark.createDataFrame([("widgett",), ("cono",), ("reds",), ("zzzzzz",), (None,)], "word string")
    got = sorted(tuple(r) for r in fuzzy.lookup(names, words).collect())
    assert got == [("cono", 1, "Type", "ECONOMY", -1, 1.0), ("reds", 1, "Part", "Red Widget", 1, 0.75), ("reds", 2, "Part", "red bolt", 1, 0.75), ("widgett", 1, "Part", "Red Widget", 1, round(1 - 1 / 7, 6))]


@pytest.mark.parametrize("size, overlap", [(400, 150), (1000, 0), (2500, 400)])
def test_sweep_counts_what_packing_makes(spark, size, overlap):
    r = random.Random(size)
    text = lambda: "\n\n".join("x" * r.choice([3, 40, 90, 130, 260, 700, 3000]) for _ in range(r.randint(0, 25)))
    docs = spark.createDataFrame([(i, ("Chapter 1: One\n\n" if i % 2 else "") + text()) for i in range(30)] + [(98, ""), (99, None)], "doc_id long, text string")
    made = chunking.chunks(docs, size=size, overlap=overlap).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")).first()
    got = {(x.size, x.overlap, x.prefixed): (x.chunks, x.chars) for x in chunking.swept(docs).collect()}
    assert len(got) == 114 and got[size, overlap, True] == (made.n, made.chars)


def test_sweep_reads_texts_once(spark, data):
    plan = chunking.swept(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_lookup_builds_nothing_in_the_driver(spark):
    names = spark.createDataFrame([("A", "green ball"), ("B", "cube")], "label string, name string")
    found = fuzzy.lookup(names, spark.createDataFrame([("gren",), ("ub",)], "word string"))
    assert {(r.word, r.label) for r in found.collect()} == {("gren", "A"), ("ub", "B")}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
