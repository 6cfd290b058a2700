"""Token ids of many texts by a word-end BPE vocabulary file, computed for each distinct word once.

The vocabulary's normaliser and splitter never join text across white space, so a text's ids are those of its
words in turn. Words are cut further into letters, digits and marks where they hold nothing but ASCII and the
letters U+00C0 to U+00FF; runs of letters are merged for all distinct words of a length together. Every other
word goes to the tokenizers library as it stands.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from lodestone.llm.bytesio import Texts, hashes, mix

_U = np.uint64
#: Letter runs over this many bytes go to the library.
LONGEST = 40
#: Distinct units that a worker keeps from one slice to the next.
KEPT = 250_000
_NONE = np.int32(2**31 - 1)


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from U+0100 on."""
    out, spare = [], 0
    for b in range(256):
        prints = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        out.append(chr(b) if prints else chr(256 + spare))
        spare += not prints
    return out


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, end = whole["model"], whole["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.vocab, self.end = vocab, end
        #: Spellings of tokens, and their beginnings; filled when first asked for.
        self.whole: set[str] = set()
        self.beginnings: set[str] = set()
        self.size = max(max(vocab.values()), *(x["id"] for x in whole["added_tokens"])) + 1
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.rank = order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        spelled = [b""] * self.size
        for token, i in vocab.items():
            spelled[i] = token.encode()
        for x in whole["added_tokens"]:
            spelled[x["id"]] = x["content"].encode()
        #: Every token as the library writes it when it decodes.
        self.spelled = spelled
        mark = np.zeros(256, np.uint8)  # 0: anything else; 1: letter; 2: digit; 3: mark; 4: white space
        mark[[*range(65, 91), *range(97, 123)]] = 1
        mark[48:58] = 2
        mark[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<>"]] = 3
        mark[[32, *range(9, 14)]] = 4
        self.kind = mark
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, _U)
        self.heads = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, units: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of equally long words as bytes: pairs of row numbers and their ids, one row each."""
        ids = self.inner[units]
        ids[:, -1] = self.last[units[:, -1]]
        rows, out = np.arange(len(units)), []
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            if rank.shape[1]:
                at = rank.argmin(1)
                least = rank[np.arange(len(rank)), at]
                more = least < _NONE
            else:
                more = np.zeros(len(rows), bool)
            if not more.all():
                out.append((rows[~more], ids[~more]))
                if not more.any():
                    return out
                rows, ids, rank, at, least = rows[more], ids[more], rank[more], at[more], least[more]
            n, width = ids.shape
            every = np.arange(n)
            keep = np.ones((n, width), bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            ids[every, at] = self.made[least]
            keep = np.ones((n, width - 1), bool)
            keep[every, at] = False
            rank = rank[keep].reshape(n, width - 2)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            rank[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])

    def units(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, hashes and kinds of a slice's units (1: letters, 0: for the library), and its lower-cased bytes."""
        data = texts.data
        n = len(data)
        kind = self.kind[data]
        lower = self.lower[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
        if len(lead):
            after = data[lead + 1]
            good = (after >= 0x80) & (after != 0x97) & (after != 0xB7) & (after <= 0xBF)
            lead, after = lead[good], after[good]
            kind[lead] = kind[lead + 1] = 1
            capital = after < 0x9F
            lower[lead[capital] + 1] += 32
        first = np.zeros(n + 1, bool)
        first[texts.offsets] = True
        space = kind == 4
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        edge[1:n] = (space[1:] != space[:-1]) | first[1:n]
        at = np.flatnonzero(edge)
        # a word with anything else in it is one unit
        odd = np.logical_or.reduceat(kind == 0, at[:-1]) if n else np.zeros(0, bool)
        wholly = np.repeat(odd, np.diff(at))
        cut = edge
        cut[1:n] |= ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~wholly[1:]
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        real = ~space[starts] if n else np.zeros(0, bool)
        starts, ends = starts[real], ends[real]
        letters = (kind[starts] == 1) & ~wholly[starts] & (ends - starts <= LONGEST)
        h = hashes(np.where(wholly, data, lower) if odd.any() else lower, starts, ends)
        # what goes to the library is hashed apart from the same bytes as letters
        h[~letters] = mix(h[~letters])
        return starts, ends, h, letters, lower

    def _learn(self, texts: Texts, starts, ends, h, letters, lower) -> None:
        """Adds distinct units, given by one place each, to what is known."""
        counts = np.zeros(len(h), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        length = ends - starts
        for size in np.unique(length[letters]):
            of = np.flatnonzero(letters & (length == size))
            for rows, ids in self.merge(lower[starts[of][:, None] + np.arange(size)]):
                parts.append((of[rows], ids))
                counts[of[rows]] = ids.shape[1]
        rest = np.flatnonzero(~letters)
        if len(rest):
            words = [texts.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[rest], ends[rest])]
            for i, found in zip(rest, self.library.encode_batch_fast(words, add_special_tokens=False)):
                ids = np.array(found.ids, np.int64)
                counts[i] = len(ids)
                parts.append((np.array([i]), ids[None, :]))
        heads = np.zeros(len(h) + 1, np.int64)
        np.cumsum(counts, out=heads[1:])
        flat = np.zeros(heads[-1], np.int32)
        for of, ids in parts:
            flat[heads[of][:, None] + np.arange(ids.shape[1])] = ids
        known = np.concatenate([self.known, h])
        order = np.argsort(known, kind="stable")
        all_heads = np.concatenate([self.heads[:-1], heads[:-1] + self.heads[-1]])
        all_counts = np.concatenate([np.diff(self.heads), counts])
        self.ids = gather(np.concatenate([self.ids, flat]), all_heads[order], all_counts[order])
        self.known = known[order]
        self.heads = np.zeros(len(known) + 1, np.int64)
        np.cumsum(all_counts[order], out=self.heads[1:])

    def look_up(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of a slice's units and the place of each in what is known."""
        starts, ends, h, letters, lower = self.units(texts)
        distinct, one, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if len(self.known) + new.sum() > KEPT:  # keep what this slice has, too
            stay = np.zeros(len(self.known), bool)
            stay[at[~new]] = True
            counts = np.diff(self.heads)[stay]
            self.ids = gather(self.ids, self.heads[:-1][stay], counts)
            self.known = self.known[stay]
            self.heads = np.concatenate([[0], np.cumsum(counts)])
        if new.any():
            one = one[new]
            self._learn(texts, starts[one], ends[one], distinct[new], letters[one], lower)
        return starts, ends, np.searchsorted(self.known, distinct)[which] if len(distinct) else np.zeros(0, np.int64)

    def reach(self, piece: str, room: int) -> int:
        """Characters of the longest prefix of a pre-token that `room` tokens may cover: an upper bound, as any tokens will do
        and the last may go beyond it."""
        normal = self.library.normalizer.normalize_str if self.library.normalizer else str
        chars = [normal(c) for c in piece]
        if len(piece) <= 64 or normal(piece) != "".join(chars):  # short, or characters that combine
            return len(piece)
        if not self.beginnings:
            end = self.end
            for x in self.vocab:
                x = x.removesuffix(end)
                self.whole.add(x)
                self.beginnings.update(x[:k] for k in range(1, len(x) + 1))
        letters = _byte_letters()
        spelt = ["".join(letters[b] for b in c.encode()) for c in chars]
        text = "".join(spelt)
        n = len(text)
        least = [room + 1] * (n + 1)  # tokens that cover exactly so much
        least[0], far = 0, 0
        for i in range(n):
            if least[i] < room:
                k = i + 1
                while k <= n and text[i:k] in self.beginnings:
                    if text[i:k] in self.whole:
                        least[k] = min(least[k], least[i] + 1)
                    k += 1
                far = max(far, k - 1)
        ends = np.cumsum([len(x) for x in spelt])
        return int(np.searchsorted(ends, far, "right"))

    def counts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and numbers of tokens of a slice's units."""
        starts, ends, place = self.look_up(texts)
        return starts, ends, np.diff(self.heads)[place]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice in turn, and how many each row has."""
        starts, _, place = self.look_up(texts)
        n = np.diff(self.heads)[place]
        ids = gather(self.ids, self.heads[:-1][place], n)
        row = np.searchsorted(texts.offsets, starts, "right") - 1
        return ids, np.bincount(row, weights=n, minlength=texts.n).astype(np.int64)


def gather(flat: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs flat[head : head + count], one after another."""
    total = int(counts.sum())
    to = np.cumsum(counts) - counts
    return flat[np.arange(total) + np.repeat(heads - to, counts)]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """A worker reads a vocabulary file once."""
    return WordBpe(path)
