"""N-gram Jaccard join: sets of word 5-grams, linked where 100 * intersection >= 75 * union.

1. Every text becomes its set of 64-bit shingle hashes; equal sets are one node (a 64-bit hash of the set).
2. Shingles that many texts hold are counted. One global order puts rare shingles first and these last, by count, so
   that what many texts share is seldom met. A set's prefix is its first n - ceil(3n/4) + 1 shingles: two linked sets
   share one in both prefixes. Which shingles occur once only is known from a bitmap of fixed size; these are left out.
3. Prefix entries meet by ranges of hash. Prefixes are longer by k = n/8 shingles, so that linked sets share k + 1 (the
   lesser k of the two): a pair with fewer, counting for shingles of many what both could share, is no candidate.
   A shingle of up to MANY sets gives all pairs of them that fit in size. A shingle of more gives a star from its most
   central set; what the star leaves in other components is paired after that, in lots. So large groups of near copies
   cost about their size, and no link between components is missed.
4. Pairs are verified by a prefix-tree join: sets of the same probe are sorted in global order into a trie, in which
   sets share the overlap counted along their common path; a subtree ends where even all the rest couldn't reach the
   bound.
5. Components are found over the verified links.

What is broadcast has a fixed bound: a bitmap of 2^27 bits and a table of HOT bytes, in which a shingle of many sets finds the
level of its count by leading bits of its hash. A rare shingle that meets such a cell sorts among those of many and is met
only in the shorter prefix. Where cells fill up that costs more candidates and changes no result.

Texts without words, null texts included, have an empty set and are linked with nothing; a null id takes part, and a
component without any id has a null one. Repeated rows fall in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytesio import Texts, Words, mix, slices, spaced, windows
from lodestone.llm.components import components
from lodestone.llm.tasks import by_slice, partitions, small_batches, unused, written

SIZE = 5
#: Sets that share a shingle are all paired up to so many; from there on, the shingle counts as one of many.
MANY = 16
#: Cells of the table of counts, a power of two.
HOT = 1 << 22
#: Levels of a count for each doubling.
FINE = 12
BITS = 27
#: Candidates of a probe that are verified together.
TOGETHER = 256
#: Bytes of text whose entries a task gathers before it hands them on.
GATHER = 6 << 20
#: The most rows of a shared shingle that one task pairs with as many others, and the salts of its rows before that.
LOT, SALTS = 512, 16
#: Shingles of a set that are looked up at once on a path of the trie.
STRIDE = 64
#: Ranges of hash, as a power of two, by which the order comes to the driver.
COARSE = 10
_U = np.uint64


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap that a set of n can be linked with: ceil(3n / 4)."""
    return (3 * n + 3) // 4


def extra(n: np.ndarray) -> np.ndarray:
    """How many shingles two linked sets share at least in prefixes that are longer by one less."""
    return 1 + n // 8


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each row (hash and row, sorted by row and hash), sizes, and nodes (0 for an empty set)."""
    h, row, _ = windows(Words(texts, spaced()), SIZE)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    n = np.bincount(row, minlength=texts.n)
    node = np.zeros(texts.n, _U)
    full = np.flatnonzero(n)
    if len(full):
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), np.searchsorted(row, full))
            node[full] = mix(sums + n[full].astype(_U)) | _U(1)
    return h, row, n, node.view(np.int64)


def nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: the id, n_shingles and node (null for an empty set)."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType())])

    def work(rows: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        _, _, n, node = shingles(texts)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(node, mask=n == 0)], names=schema.names)

    return by_slice(docs.select(id_col, text_col), schema, work, text_col)


def _pack(x: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as steps, byte plane by byte plane, which the shuffle's compression shortens."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _gathered(docs: DataFrame, text_col: str, schema: str, entries, emit) -> DataFrame:
    """mapInArrow that collects entries(texts), tuples of arrays, over GATHER bytes of text and then emits them."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for texts in slices(batch.column(0)):
                kept.append(entries(texts))
                size += len(texts.data) + texts.n
                if size >= GATHER:
                    yield emit([np.concatenate(x) for x in zip(*kept)])
                    kept, size = [], 0
        if kept:
            yield emit([np.concatenate(x) for x in zip(*kept)])

    return docs.select(text_col).mapInArrow(each, schema)


def _by_range(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ranges (by leading bits) of sorted hashes, and where each starts and ends."""
    bucket = (h >> _U(64 - bits)).astype(np.int64)
    found, at = np.unique(bucket, return_index=True)
    return found, at, np.append(at[1:], len(h))


def _low(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(32 - bits)).astype(np.uint32)


class Order:
    """The global order of shingles, and which of them may occur in more than one text. cells: levels of counts of more than
    `many`, by leading bits of hash; 0 where there is none."""

    def __init__(self, bitmap: np.ndarray, cells: np.ndarray, many: int):
        self.bitmap, self.cells, self.bits = bitmap, cells, len(cells).bit_length() - 1
        self.levels = np.append(0, many * 2.0 ** (np.arange(255) / FINE)).astype(np.int64)

    def shared(self, h: np.ndarray) -> np.ndarray:
        at = h >> _U(64 - BITS)
        return self.bitmap[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1 == 1

    def weight(self, h: np.ndarray) -> np.ndarray:
        """0 for a rare shingle; else about its count, or that of one whose cell it meets."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.shared(h))
        out[maybe] = self.levels[self.cells[h[maybe] >> _U(64 - self.bits) if self.bits else np.zeros(len(maybe), np.int64)]]
        return out


def _order(docs: DataFrame, text_col: str, bits: int) -> Order:
    """Counts all shingles of all texts by range of hash."""
    return shared_order(docs, text_col, bits, lambda texts: (shingles(texts)[0],), MANY)


def shared_order(docs: DataFrame, text_col: str, bits: int, entries: Callable[[Texts], tuple[np.ndarray]], many: int) -> Order:
    """Counts the hashes that entries(texts) gives, by range of hash; those of more than `many` have a level."""

    def emit(found) -> pa.RecordBatch:
        h = np.sort(found[0])
        bucket, start, end = _by_range(h, bits)
        low = _low(h, bits)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([_pack(low[a:b]) for a, b in zip(start, end)], pa.binary())], names=["bucket", "low"])

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low = np.sort(np.concatenate([_unpack(x.as_py()) for x in table.column("low")]))
        head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.diff(np.append(head, len(low)))
        low = low[head]
        bitmap = np.zeros(1 << (BITS - bits), bool)
        bitmap[low[n > 1] >> np.uint32(32 - (BITS - bits))] = True
        hot = n > many
        levels = np.zeros(1 << max(0, fine - bits), np.uint8)
        at = low[hot] >> np.uint32(32 - (fine - bits)) if fine > bits else np.zeros(int(hot.sum()), np.uint32)
        np.maximum.at(levels, at, (1 + np.minimum(254, FINE * np.log2(n[hot] / many))).astype(np.uint8))
        return pa.table([[key[0].as_py()], [np.packbits(bitmap, bitorder="little").tobytes()], [levels.tobytes()]], schema=ranged)

    def combine(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Ranges of one coarse range."""
        bitmap = np.zeros((1 << (bits - coarse), width), np.uint8)
        levels = np.zeros(1 << max(0, fine - coarse), np.uint8)
        for bucket, own, of in zip(*(table.column(c).to_pylist() for c in ("bucket", "bitmap", "levels"))):
            bitmap[bucket & ((1 << (bits - coarse)) - 1)] = np.frombuffer(own, np.uint8)
            put(levels, first(bucket, bits) - first(key[0].as_py(), coarse), of)
        return pa.table([[key[0].as_py()], [bitmap.tobytes()], [levels.tobytes()]], schema=ranged)

    def first(bucket: int, of: int) -> int:
        """The first cell of a range by so many leading bits."""
        return bucket << (fine - of) if fine >= of else bucket >> (of - fine)

    def put(cells: np.ndarray, at: int, levels: bytes) -> None:
        cells[at : at + len(levels)] = np.maximum(cells[at : at + len(levels)], np.frombuffer(levels, np.uint8))

    fine = max(1, HOT).bit_length() - 1
    width = 1 << (BITS - bits - 3)
    coarse = min(bits, COARSE)
    ranged = pa.schema([("bucket", pa.int64()), ("bitmap", pa.binary()), ("levels", pa.binary())])
    fields = "bucket long, bitmap binary, levels binary"
    ranges = _gathered(docs, text_col, "bucket long, low binary", entries, emit).groupBy("bucket").applyInArrow(count, fields)
    ranges = ranges.withColumn("range", F.shiftright("bucket", bits - coarse)).groupBy("range").applyInArrow(combine, fields)
    whole, cells = np.zeros(1 << (BITS - 3), np.uint8), np.zeros(1 << fine, np.uint8)
    size = width << (bits - coarse)
    # at most 2^COARSE rows, of 2^27 bits and HOT bytes in all
    for r in ranges.toLocalIterator():
        whole[r.bucket * size : (r.bucket + 1) * size] = np.frombuffer(r.bitmap, np.uint8)
        put(cells, first(r.bucket, coarse), r.levels)
    return Order(whole, cells, many)


def _ranked(order: Order, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The permutation that puts each row's shingles in global order, and their weights in that order."""
    weight = order.weight(h)
    at = np.lexsort((h, weight, row))
    return at, weight[at]


_MEET = "kind int, a long, b long, n long, need long, pivot long"


def _meetings(docs: DataFrame, text_col: str, order, bits: int) -> DataFrame:
    """kind 0: pairs of nodes, a being the probe, with the shingles of few sets that they share in a range and how many
    such they need (0: a star, whose centre is a); kind 1: a shingle of many sets and one of these, whose size stands in
    `need`, with the star's centre as pivot."""

    def entries(texts: Texts):
        h, row, n, node = shingles(texts)
        at, weight = _ranked(order.value, h, row)
        h, row = h[at], row[at]
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        # how much of a set is held by many: the original of many copies comes first
        central = np.bincount(row, weights=np.log2(1.0 + weight), minlength=texts.n) / np.maximum(n, 1)
        # shingles of many sets are met only in the shorter prefix, in which linked sets share one at least
        longer = place < np.minimum(n, n - needed(n) + extra(n))[row]
        hot = np.bincount(row[longer & (weight > 0)], minlength=texts.n)
        keep = longer & ((weight == 0) | (place < (n - needed(n) + 1)[row])) & order.value.shared(h)
        h, row = h[keep], row[keep]
        return h, node[row], n[row].astype(np.uint32), hot[row].astype(np.uint32), np.minimum(central[row] * 2000, 65535).astype(np.uint16)

    def emit(found) -> pa.RecordBatch:
        at = np.argsort(found[0], kind="stable")
        h, node, n, hot, central = (x[at] for x in found)
        bucket, start, end = _by_range(h, bits)
        low = _low(h, bits)
        cut = [(_pack(low[a:b]), node[a:b].astype("<i8").tobytes(), n[a:b].astype("<u4").tobytes(), hot[a:b].astype("<u4").tobytes(), central[a:b].astype("<u2").tobytes()) for a, b in zip(start, end)]
        columns = list(zip(*cut)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(bucket), *(pa.array(x, pa.binary()) for x in columns)], names=["bucket", "low", "node", "n", "hot", "central"])

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        whole = [np.concatenate([f(x.as_py()) for x in table.column(c)]) for c, f in (("low", _unpack), ("node", lambda x: np.frombuffer(x, "<i8")), ("n", lambda x: np.frombuffer(x, "<u4")), ("hot", lambda x: np.frombuffer(x, "<u4")), ("central", lambda x: np.frombuffer(x, "<u2")))]
        at = np.lexsort((whole[1], whole[0]))
        low, node, n, hot, central = (x[at] for x in whole)
        one = np.ones(len(low), bool)
        one[1:] = (low[1:] != low[:-1]) | (node[1:] != node[:-1])
        low, node, n, hot, central = (x[one].astype(np.int64) for x in (low, node, n, hot, central))
        head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(np.append(head, len(low)))
        rows: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 5]

        def pairs(x: np.ndarray, y: np.ndarray, star: bool = False) -> None:
            fits = 4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])
            x, y = x[fits], y[fits]
            none = np.zeros(len(x), np.int64)
            need = none if star else np.maximum(1, extra(np.minimum(n[x], n[y])) - np.minimum(hot[x], hot[y]))
            rows.append((none, node[x], node[y], need, none))

        few = (size > 1) & (size <= MANY)
        for s in np.unique(size[few]).tolist():
            of = head[few & (size == s)]
            i, j = np.triu_indices(s, 1)
            pairs((of[:, None] + i).ravel(), (of[:, None] + j).ravel())
        for start, s in zip(head[size > MANY].tolist(), size[size > MANY].tolist()):
            own = np.arange(start, start + s)
            best = own[np.lexsort((node[own], -central[own]))[0]]
            pairs(np.full(s - 1, best), own[own != best], True)
            rows.append((np.ones(s, np.int64), np.full(s, (key[0].as_py() << 32) | int(low[start])), node[own], n[own], np.full(s, node[best])))
        whole = np.stack([np.concatenate(x) for x in zip(*rows)])
        at = np.lexsort(whole[::-1])
        whole = whole[:, at]
        head = np.flatnonzero(np.concatenate([[True], (whole[:, 1:] != whole[:, :-1]).any(0)])) if whole.shape[1] else np.zeros(0, np.int64)
        times = np.diff(np.append(head, whole.shape[1]))
        kind, a, b, need, pivot = whole[:, head]
        return pa.table({"kind": pa.array(kind.astype(np.int32)), "a": pa.array(a), "b": pa.array(b), "n": pa.array(times), "need": pa.array(need), "pivot": pa.array(pivot)})

    found = _gathered(docs, text_col, "bucket long, low binary, node binary, n binary, hot binary, central binary", entries, emit)
    return found.groupBy("bucket").applyInArrow(meet, _MEET)


def marked(keys: DataFrame) -> np.ndarray:
    """A bitmap of 2^24 bits of the 64-bit numbers in the first column: bit mix(x) >> 40 is set for each x."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << 24, bool)
        for batch in batches:
            bitmap[mix(batch.column(0).to_numpy().view(_U)) >> _U(40)] = True
        for i, part in enumerate(np.packbits(bitmap).reshape(64, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()])], names=["part", "bits"])

    def either(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"part": [key[0].as_py()], "bits": [both.tobytes()]})

    whole = np.zeros((64, 1 << 15), np.uint8)
    for r in keys.mapInArrow(bits, "part long, bits binary").groupBy("part").applyInArrow(either, "part long, bits binary").collect():
        whole[r.part] = np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(whole.ravel()).astype(bool)


def _sets(docs: DataFrame, text_col: str, wanted: DataFrame, order) -> DataFrame:
    """node and its set in global order, for the wanted nodes; a bitmap of fixed size sorts out most others at once."""
    held = docs.sparkSession.sparkContext.broadcast(marked(wanted))

    def work(rows: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        h, row, n, node = shingles(texts)
        keep = held.value[mix(node.view(_U)) >> _U(40)] & (n > 0)
        _, first = np.unique(node, return_index=True)
        once = np.zeros(texts.n, bool)
        once[first] = True
        keep &= once
        of = keep[row]
        h, row = h[of], row[of]
        at, _ = _ranked(order.value, h, row)
        h = h[at].astype("<u8")
        heads = (np.cumsum(n * keep) - n * keep)[keep]
        sets = [h[a : a + k].tobytes() for a, k in zip(heads.tolist(), n[keep].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(sets, pa.binary())], names=["node", "set"])

    found = by_slice(docs.select(text_col), "node long, set binary", work, text_col)
    return found.dropDuplicates(["node"]).join(wanted, "node", "left_semi")


def trie_overlaps(probe: np.ndarray, sets: list[np.ndarray], whole: list[bool] | None = None) -> list[int]:
    """The overlap of each set with the probe, -1 where it is too small for a link. All are in one global order.

    The sets, sorted, are the leaves of a trie in depth-first order: a set shares its first `common` shingles, and the
    overlap counted along them, with the set before. A path is looked up STRIDE shingles at a time; where it can't reach
    the bound any more it is left, and so is each next set that shares it up to there. Where `whole` says so, a set is
    counted to its end.
    """
    members = np.sort(probe)
    order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
    out = [-1] * len(sets)
    path = np.zeros(1, np.int64)  # overlap after each number of shingles on the current path
    before: np.ndarray | None = None
    for i in order:
        s, n = sets[i], len(sets[i])
        common = 0
        if before is not None:
            most = min(len(before), n)
            differ = np.flatnonzero(before[:most] != s[:most])
            common = min(int(differ[0]) if len(differ) else most, len(path) - 1)
        least = 0 if whole and whole[i] else -(-3 * (n + len(probe)) // 7)  # of overlap o: 100 o >= 75 (n + m - o)
        before = s
        if path[common] + n - common < least:
            path = path[: common + 1]
            continue
        steps, total, at, short = [path[: common + 1]], int(path[common]), common, False
        while at < n and not short:  # only what the path needs is looked up
            part = s[at : at + STRIDE]
            place = np.searchsorted(members, part)
            place[place == len(members)] = 0
            tail = total + np.cumsum(members[place] == part) if len(members) else np.full(len(part), total)
            under = np.flatnonzero(tail + (n - at - 1 - np.arange(len(part))) < least)
            if len(under):
                tail, short = tail[: under[0] + 1], True
            steps.append(tail)
            total, at = int(tail[-1]), at + len(part)
        path = np.concatenate(steps)
        if not short and int(path[-1]) >= least:
            out[i] = int(path[-1])
    return out


def _verify(pairs: DataFrame, sets: DataFrame, order) -> DataFrame:
    """Of pairs (a, b, star): linked; and for stars added, missing and hot: shingles of b that a hasn't, the other way
    round, and how many of those added are of many sets. Candidates of a probe a are dealt to groups of about TOGETHER.
    Other pairs that aren't linked are left out."""
    counted = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(counted, "a").select("a", "b", "star", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / TOGETHER)).alias("lot"))
    other = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "lot", "b", "star", "set")
    own = dealt.select("a", "lot").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "lot", F.lit(None).cast("long").alias("b"), F.lit(False).alias("star"), "set")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("star", pa.bool_()), ("added", pa.int64()), ("missing", pa.int64()), ("hot", pa.int64())])

    def each(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        probe, near = np.zeros(0, "<u8"), []
        for b, star, s in zip(table.column("b").to_pylist(), table.column("star").to_pylist(), table.column("set").to_pylist()):
            s = np.frombuffer(s, "<u8")
            if b is None:
                probe = s
            else:
                near.append((b, star, s))
        rows = []
        for (b, star, s), both in zip(near, trie_overlaps(probe, [s for _, _, s in near], [star for _, star, _ in near])):
            linked = both >= 0 and 100 * both >= 75 * (len(s) + len(probe) - both)
            if star:
                new = s[~np.isin(s, probe)]
                rows.append((key[0].as_py(), b, linked, True, len(s) - both, len(probe) - both, int((order.value.weight(new) > 0).sum())))
            elif linked:
                rows.append((key[0].as_py(), b, True, False, 0, 0, 0))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)

    return other.unionByName(own).groupBy("a", "lot").applyInArrow(each, "a long, b long, linked boolean, star boolean, added long, missing long, hot long")


def _left_over(many: DataFrame, labels: DataFrame, stars: DataFrame) -> DataFrame:
    """Pairs of sets in different components that share a shingle of many sets and may be linked.

    Let a pair's sets differ from the centre of their star by added shingles X and Y and by missing ones A and B. They
    differ from each other by |X| + |Y| - 2 |X and Y| + |A| - |B| at least, and by a seventh of their sizes at most if
    they are linked. A shingle of few sets in both X and Y would have made them a pair before; so X and Y share at most
    as many as the lesser of them has of shingles of many sets.

    The sets of a shingle that aren't in its largest component meet all its sets lot by lot, LOT sets by LOT sets.
    """
    info = stars.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "added", "missing", "hot")
    at = many.join(labels, "node", "left").select("shingle", "node", "size", "pivot", F.coalesce("label", "node").alias("label"))
    by_label = at.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("shingle").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("labels > 1")
    lots = mixed.select("shingle", "main", F.ceil((F.col("n") - F.col("most")) / LOT).alias("rests"), F.ceil(F.col("n") / LOT).alias("nears"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    key = F.xxhash64("node")
    at = at.withColumn("salt", F.pmod(key, F.lit(SALTS)).cast("int")).join(lots, ["shingle", "salt"]).drop("salt").join(info, ["pivot", "node"], "left")
    zero = lambda c: F.when(F.col("node") == F.col("pivot"), 0).otherwise(F.col(c))
    side = lambda x: [F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("size").alias(f"n{x}"), zero("added").alias(f"x{x}"), zero("missing").alias(f"m{x}"), zero("hot").alias(f"h{x}")]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = at.where("label != main").select("shingle", *side("a"), F.pmod(key, "rests").alias("i"), every("nears").alias("j"))
    near = at.select("shingle", *side("b"), (F.col("label") == F.col("main")).alias("in_main"), F.pmod(key, "nears").alias("j"), every("rests").alias("i"))
    apart = "7 * (greatest(0, xa + xb - 2 * least(ha, hb)) + abs(ma - mb)) > na + nb"
    met = rest.join(near, ["shingle", "i", "j"]).where(f"la != lb and (in_main or a < b) and 4 * least(na, nb) >= 3 * greatest(na, nb) and not coalesce({apart}, false)")
    return met.select("a", "b").distinct()


def links(docs: DataFrame, text_col: str = "text", bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between different sets that leave no component of the link graph apart, and the components' labels. bits: the
    power of two of ranges of hash, by the number of partitions if not given."""
    bits = int(np.clip(np.ceil(np.log2(4 * partitions(docs))), 8, BITS - 3)) if bits is None else bits
    order = docs.sparkSession.sparkContext.broadcast(_order(docs, text_col, bits))
    met = written(_meetings(docs, text_col, order, bits))
    many = met.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("node"), F.col("need").alias("size"), "pivot")
    met_pairs = met.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    pairs = written(met_pairs.where("n >= need").select("a", "b", (F.col("need") == 0).alias("star")))
    done = pairs.select("a", "b")
    ends = done.select(F.col("a").alias("node")).union(done.select("b")).union(many.select("node")).distinct()
    sets = written(_sets(docs, text_col, ends, order))
    checked = written(_verify(pairs, sets, order))
    edges, stars = checked.where("linked").select("a", "b"), checked.where("star")
    labels = components(edges)
    # all pairs of sets that share a shingle of many sets and are in different components: once is enough
    left = _left_over(many, labels, stars).join(done, ["a", "b"], "left_anti").join(done.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    left = written(left.withColumn("star", F.lit(False)))
    if left.limit(1).count():
        new = written(_verify(left, sets, order)).select("a", "b")
        if new.limit(1).count():
            edges = edges.unionByName(new)
            labels = components(edges)
    order.destroy()  # all that needs it is written
    return edges, labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_shingles, and component_id, the least id that links lead to."""
    docs = docs.select(id_col, text_col)
    rows = written(nodes(docs, id_col, text_col))
    _, labels = links(docs, text_col)
    full = rows.where("node is not null").join(labels, "node", "left").select(id_col, "n_shingles", F.coalesce("label", "node").alias("label"))
    # a component may hold a third of all rows: its rows meet its least id in SALTS tasks
    least = full.groupBy("label").agg(F.min(id_col).alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    full = full.withColumn("salt", F.pmod(F.xxhash64(id_col, "label"), F.lit(SALTS)).cast("int"))
    empty = rows.where("node is null").select(id_col, "n_shingles", F.col(id_col).alias("component_id"))
    return full.join(least, ["label", "salt"]).select(id_col, "n_shingles", "component_id").unionByName(empty)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, but of each component one row alone: that of its least id (null ids last).
    Rows with an empty set all stay."""
    key = unused("_row_of_component", docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())])

    def work(rows: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        _, _, n, node = shingles(texts)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(node, mask=n == 0)], names=schema.names)

    _, labels = links(docs, text_col)
    rows = nodes(docs, id_col, text_col).where("node is not null").join(labels, "node", "left")
    first = rows.groupBy(F.coalesce("label", "node")).agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), F.col("node"))).alias("first"))
    kept = first.select(F.xxhash64("first.id", "first.node").alias(key))
    keyed = by_slice(docs, schema, work, text_col)
    full = keyed.where(F.col(key).isNotNull()).withColumn(key, F.xxhash64(id_col, key))
    return full.join(kept, key, "left_semi").dropDuplicates([key]).drop(key).unionByName(keyed.where(F.col(key).isNull()).drop(key))
