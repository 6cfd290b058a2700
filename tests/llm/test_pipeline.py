"""The corpus pipeline, each stage against plain Python on its own input."""

import hashlib

import corpus_pipeline
import pytest
from tests_llm_helpers import brute_components, brute_hits


@pytest.fixture(scope="module")
def steps(spark, data):
    from lodestone.llm.tasks import written

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], data)))
    return out


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_columns(steps):
    assert all(s.schema == steps[0].schema for s in steps[1:4])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "encode"]


def test_language_keeps_clean_documents(steps):
    assert pairs(steps[1]) == [x for x in pairs(steps[0]) if any(map(str.isalpha, x[1]))]


def test_one_of_each_group(steps):
    rows = pairs(steps[1])
    keep = {c for _, n, c in brute_components(rows)}
    assert pairs(steps[2]) == [x for x in rows if x[0] in keep] and len(keep) < len(rows)


def test_contaminated_documents_go(spark, data, steps):
    rows = pairs(steps[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    bad = {w[0] for w in brute_hits(rows, items) if w[5]}
    assert pairs(steps[3]) == [x for x in rows if x[0] not in bad] and bad


def test_ids(vocabulary, steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    want = []
    for i, t in pairs(steps[3]):
        x = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, steps[4].collect()), key=str) == sorted(want, key=str)


def test_awkward_rows(spark, data, awkward, nothing):
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, awkward, data).schema == awkward.schema
        assert stage(spark, nothing, data).count() == 0
    kept = awkward
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, data)
    assert kept.count() > 5
