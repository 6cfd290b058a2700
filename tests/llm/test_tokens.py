"""BPE coding, token counts and token files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe_codec, token_counts, token_store
from lodestone.llm.bpe import word_bpe
from lodestone.llm.bytesio import slices


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip(awkward, awkward_texts, vocabulary, library):
    want = []
    for i, t in awkward_texts:
        x = ids(library, t)
        want.append((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(bpe_codec.round_trip_digests(awkward, vocabulary)) == sorted(want, key=str)
    encoded = bpe_codec.encode(awkward, vocabulary)
    got = sorted(((r.doc_id, r.text) for r in bpe_codec.decode(encoded, vocabulary).collect()), key=str)
    assert got == sorted(((i, library.decode(ids(library, t), skip_special_tokens=False)) for i, t in awkward_texts), key=str)


def test_chunks_are_reused(vocabulary):
    codec = bpe_codec.ChunkCodec(word_bpe(vocabulary))
    text = " ".join(f"word{i} tail" for i in range(4000))
    for part in slices(pa.array([text, "something before " + text, text]), 10_000_000):
        codec.encode(part)
    assert codec.reused > codec.encoded


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aAbé'É .,1²<|>endoftxtstar\ńß", max_size=60), max_size=6))
def test_any_text(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    codec = bpe_codec.chunk_codec(path)
    library = Tokenizer.from_file(path)
    for part in slices(pa.array(texts, pa.string())):
        got, n = codec.encode(part)
        assert [x.tolist() for x in np.split(got, np.cumsum(n)[:-1])] == [ids(library, t) for t in texts]


def test_counts(awkward, awkward_texts, vocabulary, library):
    got = rows_of(token_counts.token_counts(awkward, vocabulary, 7).select("doc_id", "n_bytes", "n_tokens", "over_limit"))
    assert got == sorted(((i, len((t or "").encode()), n := len(ids(library, t)), n > 7) for i, t in awkward_texts), key=str)


def test_every_prefix(vocabulary, library):
    texts = ["Straße, don't 12!! naïve wordings", "", "abc"]
    for part in slices(pa.array(texts)):
        counts = token_counts.PrefixCounts(word_bpe(vocabulary), part)
        for row, t in enumerate(texts):
            for k in range(len(t) + 1):
                assert counts.at(row, len(t[:k].encode())) == len(ids(library, t[:k])), (t[:k], k)
        for budget in range(12):
            for t, size in zip(texts, counts.fitting(budget)):
                fits = [len(t[:k].encode()) for k in range(len(t) + 1) if len(ids(library, t[:k])) <= budget]
                assert size in fits and size >= max(f for f in fits if f <= size)


def test_budget_inside_long_units(vocabulary, library):
    r = np.random.default_rng(5)
    pieces = ["word", "日本語", "中文字", "'ll", "'re", "'", "<", ">", "!!", "12", "é", "e\u0301", "<|endoftext|>", "<|startoftext|>", "ไทย", "a" * 30]
    texts = ["".join(pieces[k] for k in r.integers(0, len(pieces), 12)) + "'" for _ in range(30)] + ["日本語中文" * 30, "'" + "abcdefghij" * 12]
    for part in slices(pa.array(texts)):
        counts = token_counts.PrefixCounts(word_bpe(vocabulary), part)
        sizes = [[len(ids(library, t[:k])) for k in range(len(t) + 1)] for t in texts]
        for budget in (0, 1, 2, 5, 9, 20, 33):
            want = [len(t[: max(k for k, n in enumerate(own) if n <= budget)].encode()) for t, own in zip(texts, sizes)]
            assert counts.fitting(budget).tolist() == want


def test_long_unit_is_never_tried_whole(vocabulary, library, monkeypatch):
    tried = []
    real = token_counts.PrefixCounts._tokens
    monkeypatch.setattr(token_counts.PrefixCounts, "_tokens", lambda self, texts: (tried.append(sum(map(len, texts))), real(self, texts))[1])
    for text in ('{"a":1,<b>\'c\'},' * 14000, "日本語の文" * 13400, "'" + "abcdefgh" * 25000):
        assert len(text.encode()) >= 200_000
        for part in slices(pa.array([text])):
            size = int(token_counts.PrefixCounts(word_bpe(vocabulary), part).fitting(2048)[0])
        cut = text.encode()[:size].decode()
        assert len(ids(library, cut)) <= 2048 < len(ids(library, text[: len(cut) + 1]))
    assert max(tried) < 2_000_000 and sum(tried) < 100_000_000


def test_prefix_table(awkward, vocabulary, library):
    for r in token_counts.prefix_table(awkward.where("doc_id in (2, 7, 11)"), vocabulary).collect():
        text = awkward.where(f"doc_id = {r.doc_id}").first().text.encode()
        assert [len(ids(library, text[:e].decode())) for e in r.ends] == r.counts


def test_files(awkward, awkward_texts, vocabulary, library):
    got = token_store.stored_digests(awkward, vocabulary, 1).collect()
    at, want = 0, []
    for i, t in sorted(awkward_texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        x = [*ids(library, t), 1]
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_grammar_is_exact_and_random_access(spark):
    r = np.random.default_rng(1)
    lengths = np.array([1, 500, 3, 4000, 1, 1000])
    seq = r.integers(0, 6, lengths.sum())
    symbols, counts, rules = token_store.repair(seq, lengths, 10, rounds=5, rules=8, least=10)
    assert len(rules) and len(symbols) < len(seq)
    sizes, _ = token_store.expansions(rules, 10)
    block = token_store.Block(symbols.astype("<u2").tobytes(), 2, rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), 10)
    ends = np.cumsum(counts)
    starts = np.cumsum(lengths) - lengths
    for i in range(len(lengths)):
        assert block.decode(ends[i] - counts[i], ends[i]).tolist() == seq[starts[i] : starts[i] + lengths[i]].tolist()


def test_empty_tables(nothing, vocabulary):
    assert bpe_codec.round_trip_digests(nothing, vocabulary).count() == 0
    assert token_counts.token_counts(nothing, vocabulary, 5).count() == 0
    assert token_store.stored_digests(nothing, vocabulary, 1).count() == 0


def pairs_left(symbols, counts):
    """How often each pair of neighbours occurs within documents, of aaa one."""
    found, at = {}, 0
    for n in counts.tolist():
        own, i = symbols[at : at + n].tolist(), 0
        last = None
        for i in range(len(own) - 1):
            pair = (own[i], own[i + 1])
            if pair[0] == pair[1] and last == (pair, i - 1):
                last = None
                continue
            found[pair] = found.get(pair, 0) + 1
            last = (pair, i)
        at += n
    return found


@pytest.mark.parametrize("seed", range(5))
def test_no_frequent_pair_is_left_and_any_place_decodes(seed):
    r = np.random.default_rng(seed)
    phrases = [r.integers(0, 30, r.integers(2, 12)) for _ in range(20)]
    docs = [np.concatenate([phrases[k] for k in r.integers(0, 20, r.integers(1, 60))]) for _ in range(80)] + [np.full(1001, 7), np.array([3])]
    ids, lengths = np.concatenate(docs), np.array([len(d) for d in docs])
    symbols, counts, rules = token_store.repair(ids, lengths, 30, least=6)
    assert max(pairs_left(symbols, counts).values()) < 6 and len(symbols) < len(ids) / 3
    sizes, _ = token_store.expansions(rules, 30)
    block = token_store.Block(symbols.astype("<u4").tobytes(), 4, rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), 30)
    heads = np.append(0, np.cumsum(counts))
    for k, doc in enumerate(docs):
        assert block.decode(heads[k], heads[k + 1]).tolist() == doc.tolist()
        for first, count in ((0, 1), (int(r.integers(0, len(doc))), int(r.integers(0, 40))), (len(doc) - 1, 5), (len(doc), 2)):
            assert block.ids(heads[k], heads[k + 1], first, count).tolist() == doc[first : first + count].tolist()


def test_fetch_from_files(spark, awkward, awkward_texts, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    path = f"file://{tmp_path}/store"
    token_store.write(awkward, vocabulary, 1, path, block=2000)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in awkward_texts}
    asked = [(8, 0, 5), (8, 70000, 30), (1, 0, 3), (4, 10, 10), (10, 2, 1000), (999, 0, 1)]
    got = token_store.fetch(spark, path, spark.createDataFrame(asked, "doc_id long, first long, count long")).collect()
    assert sorted((r.doc_id, r.first, list(r.ids)) for r in got) == sorted((i, a, want[i][a : a + n]) for i, a, n in asked if i in want)
