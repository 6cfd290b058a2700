"""Main text of web pages: page structure first, then a suffix array over each host's pages, which every page passes.

A page is cut into blocks at block-level tags. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms
and comments, known by element, role or class, are never text. Where a page has an <article> or <main>, the blocks in it
are its text; else the blocks left are open. An <article> inside an element that only looks like furniture by its class
or name counts where the page has no other and less open text; so does what stands in a form and in nothing else of these,
as some servers wrap whole pages in one. A page's stream is the tokens of all of these blocks, and
every page's goes through its host's array. What can be a template's testifies there: open blocks, and those inside an
article that stand in a classed element or a container (div, section) of their own. All text is held against it:

- pages are parsed once and written; of pages with equal texts one stream is kept, so that copies of a page don't make
  its text boilerplate;
- a host's streams are dealt to lots of about GROUP_BYTES, which bound memory and change no result. In a lot they are
  concatenated into a suffix array (prefix doubling, and common-prefix lengths from its ranks), whose intervals of
  common prefixes of LONG tokens or more are the substrings that pages share; those that MIN_PAGES streams of the host
  share are repeated. Where a host has several lots, these hand the intervals as hashes to ranges of hash, where all
  lots of the host meet;
- an open block loses the tokens that repeated substrings cover, and its unique runs stay, whatever the other blocks at
  its place (path of elements and classes) are;
- a classed block of an article goes if it is itself nearly all covered and the blocks at its place are nearly all
  covered on MIN_PAGES streams or more (a line such as "read on" that a template puts there);
- a block in a container without a class goes on the same terms, but only pages of whose article half or more is covered by
  nothing count and lose: near copies of an article are not its template;
- the plain blocks of an article lose nothing and don't testify: a passage that many articles quote is text. How much of
  them is covered counts for the half.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one
space. Null and empty pages, and pages without such blocks, give the empty string. A null url is a host of its own.
Repeated rows are answered each. Elements may nest to any depth: a place is a hash, and an end tag finds its element at
once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytesio import mix, slices
from lodestone.llm.tasks import small_batches, written

_U = np.uint64
LONG = 8
MIN_PAGES = 3
GROUP_BYTES = 4 << 20
#: Most hosts of more than GROUP_BYTES that are broadcast.
LARGE_HOSTS = 100_000

#: Lots whose substrings one task counts.
JUDGED = 8

#: Kinds of blocks: plain ones of an article, classed ones of an article, open ones, ones of an article in a container.
PLAIN, CLASSED, OPEN, BOXED = range(4)

_PLACE = [("host", pa.string()), ("lot", pa.int64())]
_GIVEN = pa.schema([("bucket", pa.int64()), *_PLACE, *((c, pa.binary()) for c in ("keys", "streams", "n"))])
_FOUND = pa.schema([*_PLACE, ("keys", pa.binary())])
_CELL = pa.struct([(c, pa.int64()) for c in ("place", "covered", "tokens", "blocks")])
_ANSWER = pa.schema([("host", pa.string()), ("stream", pa.int64()), ("bits", pa.binary()), ("places", pa.list_(pa.int64())), ("cells", pa.list_(_CELL))])

# Element names and class words of page furniture.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav noscript ol optgroup option p pre script search section select style summary table tbody td template tfoot th thead title tr ul video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript template iframe svg math object canvas"
FURNITURE = frozenset("nav header footer aside form button select option menu dialog search label fieldset datalist head audio video map".split())
BOXES = frozenset("center div section".split())
ROLES = frozenset("banner navigation complementary contentinfo search form dialog alertdialog alert menu menubar toolbar tooltip tablist".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies share sharing social related recommended newsletter subscribe subscription signup signin login paywall search popup modal overlay pagination pager widget toolbar copyright skip".split()
)
#: Words that beside these don't make a name say something else: "site-footer" is a footer, "notice-of-appeal" no notice.
NEUTRAL = frozenset(
    "site page web main top bottom left right upper lower inner outer center side box bar wrap wrapper container content area block section module region zone slot unit list item items link links button buttons icon icons text title head header body post entry article story user reader readers global local primary secondary mobile desktop sticky fixed float mini mega drop dropdown hidden js ui col row grid flex small large form view info group panel card inline btn img image holder placement position to".split()
)
#: Marks of readers' comments: what stands in these is never an article of its own.
COMMENTS = frozenset({"comment", "comments", "disqus", "replies"})
_TAG = r"(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*"
_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW.replace(' ', '|')})\b{_TAG}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9-]*)(?P<rest>{_TAG})>|<[!?][^>]*>|</[^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)



def _marks(classes: str) -> set[str]:
    """Marks of furniture among class and id names: of a name made of these and of neutral words alone."""
    out: set[str] = set()
    for name in classes.split():
        words = set(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()))
        if words & MARKED and all(w in MARKED or w in NEUTRAL or len(w) == 1 for w in words):
            out |= words & MARKED
    return out


def _furniture(name: str, rest: str, in_main: bool) -> tuple[bool, bool, str]:
    """Whether an element is page furniture, whether it can hold no article either (comments, hidden parts), its classes."""
    found = name in FURNITURE and not (name == "header" and in_main)
    closed = False
    classes = ""
    if rest:
        for m in _ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                classes += " " + value
            elif key == "role":
                found |= value.strip().lower() in ROLES
            elif key == "style":
                closed |= bool(_HIDDEN.search(value))
            elif key == "hidden":
                closed = True
            else:
                closed |= value.strip().lower() == "true"
        marked = _marks(classes)
        if name in ("article", "main", "body", "html"):
            marked &= COMMENTS
        closed |= bool(marked & COMMENTS)
        found |= bool(marked)
    return found or closed, closed, classes.strip()


@lru_cache(maxsize=1 << 16)
def _below(place: bytes, name: str, classes: str) -> bytes:
    """The place of an element with these classes below another."""
    return blake2b(place + f"{name}.{classes}".encode("utf-8", "surrogatepass"), digest_size=8).digest()


def blocks(html: str) -> list[tuple[int, str, int]]:
    """(place, text, kind) of a page's blocks that may be text."""
    out: list[tuple[int, str, int]] = []
    rescued: list[tuple[int, str, int]] = []  # blocks of articles inside furniture
    formed: list[tuple[int, str, int]] = []  # open blocks, and those in a form alone
    forms: list[int] = []  # places in open_ of forms outside other furniture
    within: list[int] = []  # places in open_ of furniture inside these
    # open elements: name, then whether they are in furniture, in an article, the kind of their blocks in an article, whether
    # they are in what no article can stand in, in an article inside furniture, in furniture inside that; and their place
    top = ("", False, False, PLAIN, False, False, False, b"")
    open_ = [top]
    where: dict[str, list[int]] = {}  # places in open_ of each name
    solid: list[int] = [0]  # places in open_ of block elements
    pieces: list[str] = []
    any_main = bad_paragraph = False

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            _, bad, main, own, _, inside, again, place = open_[-1]
            if text and not bad_paragraph and (not bad or forms and not within):
                formed.append((int.from_bytes(place, "little", signed=True), text, OPEN))
            if text and not bad_paragraph and (not bad or inside and not again):
                kind = own if main or inside else OPEN
                (rescued if bad else out).append((int.from_bytes(place, "little", signed=True), text, kind))

    at = 0
    for m in _PIECE.finditer(html):
        if m.start() > at:
            pieces.append(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                flush()
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
            bad_paragraph = False
        if name in VOID:
            continue
        if name == "p":
            bad_paragraph = not m["end"] and bool(m["rest"]) and _furniture(name, m["rest"], True)[0]
            continue
        if m["end"]:
            held = where.get(name)
            # a stray inline end inside a block closes nothing outside it
            if held and (name in BLOCK or held[-1] > solid[-1]):
                i = held[-1]
                if name not in BLOCK:
                    flush()  # an inline element is held only as furniture, and what it holds is its own
                for x in open_[i:]:
                    where[x[0]].pop()
                del open_[i:]
                for places in (solid, forms, within):
                    while places and places[-1] >= i:
                        places.pop()
        elif not m["rest"].endswith("/"):
            _, bad, main, _, closed, inside, again, place = open_[-1]
            furniture, shut, classes = _furniture(name, m["rest"], main or inside)
            if name not in BLOCK and not furniture:
                continue
            if furniture:
                flush()
            article = name in ("article", "main")
            if furniture and (forms or not bad):
                (within if forms or name != "form" or shut or _marks(classes) else forms).append(len(open_))
            inside = inside or (article and bad and not closed and not furniture)
            again = again or (inside and furniture)
            bad = bad or furniture
            main = main or (article and not bad)
            any_main |= main
            where.setdefault(name, []).append(len(open_))
            if name in BLOCK:
                solid.append(len(open_))
            own = PLAIN if article else CLASSED if classes else BOXED if name in BOXES else PLAIN
            open_.append((name, bad, main, own, closed or shut, inside, again, _below(place, name, classes)))
    if at < len(html):
        tail = html[at:]
        cut = re.search(r"<[a-zA-Z/!][^<>]*\Z", tail)  # a tag that the page's end cuts off
        pieces.append(tail[: cut.start()] if cut else tail)
    flush()
    if any_main:
        return [x for x in out if x[2] != OPEN]
    size = lambda found: sum(len(x[1]) for x in found)
    if size(rescued) > size(out):
        return rescued
    return formed if size(formed) > 2 * size(out) else out


def suffix_array(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes, each up to its page's end, in order (ties by place), and how many tokens each shares with the one
    before it. Prefix doubling: ranks of the first 1, 2, 4 ... tokens until they tell all apart that differ at all;
    common prefixes are then read off the ranks from the longest step down."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.append(page[1:] != page[:-1], True)
    ends = np.flatnonzero(last)
    left = ends[np.searchsorted(ends, np.arange(n))] + 1 - np.arange(n)
    rank = (np.unique(tokens, return_inverse=True)[1] + 1).astype(np.int32)  # 0: beyond a page's end
    levels, step, most = [rank], 1, int(left.max())
    order = np.argsort(rank, kind="stable")
    while step < most and int(rank.max()) < n:
        key = rank.astype(np.int64) * (n + 1)
        on = np.flatnonzero(left > step)
        key[on] += rank[on + step]
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1]))
        step *= 2
        levels.append(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    room = np.minimum(left[a], left[b])
    common = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        more = np.flatnonzero((room >> k) > 0)
        more = more[levels[k][a[more]] == levels[k][b[more]]]
        common[more + 1] += 1 << k
        room[more] -= 1 << k
        on = more[room[more] > 0]
        a[on] += 1 << k
        b[on] += 1 << k
    return order, common


def runs(tokens: np.ndarray, page: np.ndarray, long: int = LONG) -> np.ndarray:
    """For each suffix the number of its interval of the suffix array in which all share `long` tokens or more; -1 for a
    suffix that its page's end cuts short."""
    order, common = suffix_array(tokens, page)
    out = np.full(len(tokens), -1, np.int64)
    if len(tokens) >= long:
        whole = np.zeros(len(tokens), bool)
        whole[: len(tokens) - long + 1] = page[: len(tokens) - long + 1] == page[long - 1 :]
        some = whole[order]
        # suffixes too short never share so much with a neighbour, so they part no interval
        number = np.cumsum(common < long) - 1
        out[order[some]] = np.unique(number[some], return_inverse=True)[1]
    return out


def met(rank: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first suffix of each run of rank on each page, in order of run and page; and their runs."""
    at = np.flatnonzero(rank >= 0)
    at = at[np.lexsort((at, page[at], rank[at]))]
    first = np.ones(len(at), bool)
    first[1:] = (rank[at[1:]] != rank[at[:-1]]) | (page[at[1:]] != page[at[:-1]])
    return at[first], rank[at[first]]


def cover(rank: np.ndarray, hit: np.ndarray, long: int = LONG) -> np.ndarray:
    """Whether one of the runs that `hit` names covers each token."""
    out = np.zeros(len(rank) + long + 1, np.int64)
    at = np.flatnonzero(rank >= 0)
    at = at[hit[rank[at]]]
    np.add.at(out, at, 1)
    np.add.at(out, at + long, -1)
    return np.cumsum(out)[: len(rank)] > 0


def repeated(tokens: np.ndarray, page: np.ndarray, long: int = LONG, pages: int = MIN_PAGES) -> np.ndarray:
    """Whether a substring of `long` tokens or more that occurs on `pages` pages covers each token."""
    rank = runs(tokens, page, long)
    return cover(rank, np.bincount(met(rank, page)[1], minlength=1) >= pages, long)


def _nearly_all(covered: int, tokens: int) -> bool:
    return 10 * covered >= 9 * tokens


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Lot:
    """Streams of a host, and the substrings of LONG tokens that they share. Of each stream the blocks that can be a
    template's are one stretch of tokens, its plain ones another."""

    def __init__(self, host: str, streams: list[int], found: list[list[tuple[int, str, int]]]):
        self.host = _U(_hash(host) & (1 << 64) - 1)
        with np.errstate(over="ignore"):
            self.stream = mix(np.array(streams, np.int64).view(_U) ^ self.host)
        #: (place, kind) of the blocks that can be a template's.
        self.blocks = [[(p, k) for p, _, k in x if k != PLAIN] for x in found]
        texts, part = [], []
        for i, x in enumerate(found):
            for plain in (False, True):
                own = [t for _, t, k in x if (k == PLAIN) == plain]
                texts += own
                part += [2 * i + plain] * len(own)
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        self.words, self.tokens = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.array(part, np.int64)
        part = np.repeat(block, n)
        self.page = part // 2
        #: First tokens of the parts of all streams, and of all blocks, each with one more.
        self.parts = np.searchsorted(part, np.arange(2 * len(found) + 1))
        self.at, self.first_block = np.append(0, np.cumsum(n)), np.searchsorted(block, np.arange(2 * len(found) + 1))
        self.rank = runs(self.tokens, part)
        self.first, self.run = met(np.where(part % 2 == 0, self.rank, -1), self.page)
        self.n_runs = int(self.rank.max(initial=-1)) + 1

    def own(self) -> np.ndarray:
        """Runs that MIN_PAGES streams of this lot have in blocks that testify."""
        return np.bincount(self.run, minlength=max(1, self.n_runs)) >= MIN_PAGES

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The runs in blocks that testify, and the hash of each."""
        new = np.ones(len(self.run), bool)
        new[1:] = self.run[1:] != self.run[:-1]
        at = self.tokens[self.first[new][:, None] + np.arange(LONG)]
        used, place = np.unique(at, return_inverse=True)
        words = np.array([_hash(w) for w in self.words.take(pa.array(used)).to_pylist()], np.int64).view(_U)
        place = place.reshape(at.shape)
        out = np.full(len(at), self.host)
        with np.errstate(over="ignore"):
            for k in range(LONG):
                out = mix(out * _U(31) ^ words[place[:, k]])
        return self.run[new], out

    def covered(self, keys: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each stream, which tokens of the blocks that testify, and of its plain ones, repeated substrings cover: this
        lot's own, or those of these hashes."""
        hit = self.own()
        if keys is not None:
            run, gram = self.grams()
            hit = np.zeros(max(1, self.n_runs), bool)
            hit[run] = np.isin(gram, keys)
        whole = cover(self.rank, hit)
        cuts = self.parts.tolist()
        return [(whole[a:b], whole[b:c]) for a, b, c in zip(cuts[::2], cuts[1::2], cuts[2::2])]

    def judged(self, covered: list[tuple[np.ndarray, np.ndarray]]) -> tuple[dict[int, np.ndarray], list[tuple[np.ndarray, list[int]] | None]]:
        """By place, tokens covered, tokens and blocks; and for each stream that may lose something, its tokens covered and
        the places of its blocks that go if these are a template's."""
        sums: dict[int, np.ndarray] = {}
        out: list[tuple[np.ndarray, list[int]] | None] = []
        for i, (mine, (tokens, plain)) in enumerate(zip(self.blocks, covered)):
            if not mine:
                out.append(None)
                continue
            # half of the article or more is the page's own
            whole = 2 * (int(tokens.sum()) + int(plain.sum())) <= len(tokens) + len(plain)
            starts = self.at[self.first_block[2 * i] : self.first_block[2 * i] + len(mine) + 1] - self.parts[2 * i]
            places: set[int] = set()
            loses = False
            for (place, kind), a, b in zip(mine, starts.tolist(), starts[1:].tolist()):
                n = int(tokens[a:b].sum())
                if kind == OPEN:
                    loses |= n > 0
                elif kind == CLASSED or whole:
                    sums[place] = sums.get(place, 0) + np.array([n, b - a, 1])
                    if _nearly_all(n, b - a):
                        places.add(place)
            out.append((tokens, sorted(places)) if loses or places else None)
        return sums, out


def _finished(found: list[tuple[int, str, int]], covered: np.ndarray | None, templates: set[int]) -> str:
    """A page's text. covered: tokens of its stream; templates: its places whose blocks are nearly all covered."""
    out, at = [], 0
    for place, text, kind in found:
        if kind == PLAIN:
            out.append(text)
            continue
        words = text.split(" ")
        own = covered[at : at + len(words)] if covered is not None else np.zeros(len(words), bool)
        at += len(words)
        if kind != OPEN:
            if not (place in templates and _nearly_all(int(own.sum()), len(words))):
                out.append(text)
        elif left := [w for w, x in zip(words, own.tolist()) if not x]:
            out.append(" ".join(left))
    return " ".join(out)


def _stream(found: list[tuple[int, str, int]]) -> int:
    return _hash("\n".join(t for _, t, _ in found))


def main_texts(pages: list[str | None], host: str = "") -> list[str]:
    """Texts of all pages of one host, in one lot."""
    parsed = [blocks(x or "") for x in pages]
    one: dict[int, bytes] = {}
    for found in parsed:
        key = _stream(found)
        one[key] = min(one.get(key, packed(found)), packed(found))
    streams = list(one)
    lot = Lot(host, streams, [unpacked(x) for x in one.values()])
    sums, answers = lot.judged(lot.covered())
    templates = {p for p, (c, t, n) in sums.items() if n >= MIN_PAGES and _nearly_all(c, t)}
    by = dict(zip(streams, answers))
    return [_finished(found, a[0], templates.intersection(a[1])) if (a := by[_stream(found)]) else _finished(found, None, set()) for found in parsed]


def packed(found: list[tuple[int, str, int]]) -> bytes:
    """Blocks of a page, compressed."""
    head = np.array([len(found), *(p for p, _, _ in found), *(k for _, _, k in found)], "<i8").tobytes()
    whole = head + "\n".join(t for _, t, _ in found).encode("utf-8", "surrogatepass")
    return len(whole).to_bytes(4, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[tuple[int, str, int]]:
    whole = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(whole[:8], "little")
    if not n:
        return []
    places, kinds = np.frombuffer(whole, "<i8", 2 * n, 8).reshape(2, n).tolist()
    return list(zip(places, whole[8 + 16 * n :].decode("utf-8", "surrogatepass").split("\n"), kinds))


def _handed_out(lot: Lot, key: tuple[pa.Scalar, ...], bits: int) -> pa.Table:
    """To each range of hash, the lot's substrings by the streams that hold them (MIN_PAGES of them at most)."""
    (held, hashes), run = lot.grams(), lot.run
    gram = np.zeros(max(1, lot.n_runs), _U)
    gram[held] = hashes
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    k = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    some = k < MIN_PAGES
    keys, page = gram[run[some]], lot.page[lot.first[some]]
    bucket = (keys >> _U(64 - bits)).astype(np.int64)
    order = np.lexsort((page, bucket))
    keys, page, bucket = keys[order], page[order], bucket[order]
    out: dict[str, list] = {x: [] for x in _GIVEN.names}
    for b in np.unique(bucket).tolist():
        x, y = np.searchsorted(bucket, [b, b + 1])
        which, n = np.unique(page[x:y], return_counts=True)
        values = (b, key[0].as_py(), key[1].as_py(), keys[x:y].tobytes(), lot.stream[which].tobytes(), n.astype("<u4").tobytes())
        for name, v in zip(_GIVEN.names, values):
            out[name].append(v)
    return pa.table(out, _GIVEN)


def _judged(table: pa.Table) -> pa.Table:
    """For one range of hash, to each lot those of its substrings that MIN_PAGES streams of the host share."""
    at = lambda name, kind="<u8": [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    keys = at("keys")
    key = np.concatenate(keys)
    stream = np.concatenate([np.repeat(x, n) for x, n in zip(at("streams"), at("n", "<u4"))])
    order = np.lexsort((stream, key))
    k, x = key[order], stream[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    found, n = np.unique(k[new], return_counts=True)
    found = found[n >= MIN_PAGES]
    return pa.table({"host": table.column("host"), "lot": table.column("lot"), "keys": [np.intersect1d(x, found).tobytes() for x in keys]}, _FOUND)


_ANSWERED = "host string, stream long, bits binary, places array<bigint>, cells array<struct<place:bigint,covered:bigint,tokens:bigint,blocks:bigint>>"


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page: id, url, host, its stream's hash, the bytes of its text, and its blocks, packed."""
    small_batches(pages.sparkSession, 200)
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("stream", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("blocks", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(3)):
                streams, sizes, packs = [], [], []
                for i in range(part.n):
                    found = blocks(part.bytes(i).decode("utf-8", "replace"))
                    streams.append(_stream(found))
                    sizes.append(sum(len(t.encode("utf-8", "surrogatepass")) for _, t, _ in found))
                    packs.append(packed(found))
                own = batch.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(streams, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packs, pa.binary())], names=schema.names)

    return written(rows.mapInArrow(each, schema))


def _once(rows: DataFrame) -> DataFrame:
    """Rows (host, stream, blocks) of which a task hands on each stream once, so that copies of a page don't fill a lot; where
    copies differ in places, each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int, int]] = set()
        for batch in batches:
            keep = []
            for i, (host, stream, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                key = (host, stream, hash(data))
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(each, rows.schema)


def _answers(rows: DataFrame) -> DataFrame:
    """Per host and stream that may lose text (see _ANSWERED): which tokens of its blocks that testify repeated substrings
    of the host cover, packed as bits, and places; and rows without a stream, which sum a lot's blocks by place."""
    sizes = rows.select("host", "stream", "bytes").groupBy("host", "stream").agg(F.max("bytes").alias("bytes")).groupBy("host").agg(F.ceil(F.sum("bytes") / GROUP_BYTES).alias("lots"))
    # only hosts of more than a group's bytes are dealt to lots; the others are lot -1, which has all evidence of its
    # host. Where large ones are few (counted first) they are broadcast
    large = sizes.where("lots > 1")
    n = large.agg(F.count("*").alias("hosts"), F.coalesce(F.sum("lots"), F.lit(0)).alias("lots")).first()
    few = n.hosts <= LARGE_HOSTS
    bits = max(6, int(np.ceil(np.log2(max(1, n.lots / JUDGED)))))
    joined = _once(rows.select("host", "stream", "blocks")).join(F.broadcast(large) if few else large, "host", "left")
    lot = F.coalesce(F.pmod(F.xxhash64("stream"), "lots"), F.lit(-1).cast("long"))
    dealt = joined.select("host", lot.alias("lot"), "stream", "blocks")
    dealt = dealt if few else dealt.repartition("host", "lot")  # rows that a join has by host would stay so

    def lot_of(key: tuple[pa.Scalar, ...], table: pa.Table) -> tuple[Lot, list[int]]:
        one: dict[int, bytes] = {}  # of copies, the least
        for stream, data in zip(table.column("stream").to_pylist(), table.column("blocks").to_pylist()):
            one[stream] = min(one.get(stream, data), data)
        streams = sorted(one)
        return Lot(key[0].as_py(), streams, [unpacked(one[x]) for x in streams]), streams

    def hand_out(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _GIVEN.empty_table() if key[1].as_py() < 0 else _handed_out(lot_of(key, table)[0], key, bits)

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ANSWER.empty_table()
        lot, streams = lot_of(key, table)
        keys = None if key[1].as_py() < 0 else np.concatenate([np.zeros(0, _U), *(np.frombuffer(x.as_py(), "<u8") for x in found.column("keys"))])
        sums, answers = lot.judged(lot.covered(keys))
        out = [(x, np.packbits(a[0], bitorder="little").tobytes(), a[1], None) for x, a in zip(streams, answers) if a]
        if sums:
            out.append((None, None, None, [dict(zip(("place", "covered", "tokens", "blocks"), (p, *v.tolist()))) for p, v in sums.items()]))
        return pa.table([[key[0].as_py()] * len(out), *([x[k] for x in out] for k in range(4))], schema=_ANSWER)

    by_lot = dealt.groupBy("host", "lot")
    if not n.hosts:
        return written(by_lot.applyInArrow(lambda key, table: answer(key, table, _FOUND.empty_table()), _ANSWERED))
    given = by_lot.applyInArrow(hand_out, "bucket long, host string, lot long, keys binary, streams binary, n binary")
    found = given.groupBy("bucket").applyInArrow(_judged, "host string, lot long, keys binary")
    return written(by_lot.cogroup(found.groupBy("host", "lot")).applyInArrow(answer, _ANSWERED))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: the id, url, text and n_chars (its code points)."""
    rows = _parsed(pages, id_col, url_col, html_col)
    answers = _answers(rows)
    sums = answers.where("stream is null").select("host", F.explode("cells").alias("c")).select("host", "c.*")
    sums = sums.groupBy("host", "place").agg(F.sum("covered").alias("covered"), F.sum("tokens").alias("tokens"), F.sum("blocks").alias("blocks"))
    lost = answers.where("stream is not null")
    places = lost.select("host", "stream", F.explode("places").alias("place"))
    templates = places.join(sums.where(f"blocks >= {MIN_PAGES} and 10 * covered >= 9 * tokens").select("host", "place"), ["host", "place"], "left_semi")
    templates = templates.groupBy("host", "stream").agg(F.collect_list("place").alias("templates"))  # places of one page
    # written, so that its size is known: where few pages lose text, these go to all others' tasks and no text is shuffled
    lost = written(lost.select("host", "stream", "bits").join(templates, ["host", "stream"], "left"))
    ready = rows.select("id", "url", "host", "stream", "blocks").join(lost, ["host", "stream"], "left")
    schema = T.StructType([*rows.select("id", "url").schema.fields, T.StructField("text", T.StringType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for found, bits, places in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                covered = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
                texts.append(_finished(unpacked(found), covered, set(places or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=schema.names)

    whole = ready.select("id", "url", "blocks", "bits", "templates").mapInArrow(finish, schema)
    return whole.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
