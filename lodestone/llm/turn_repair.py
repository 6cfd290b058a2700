"""Conversation structure repair by a generalised LR parser with weighted edits.

Roles of a conversation, by their initials, are to be a sentence of the grammar

    Conversation -> (nothing) | Turns | s Turns        Turns -> u a | Turns u a

Its LR tables are built from the rules. The parser follows all repairs at once: stacks are nodes (state, what lies
beneath), of which there is one each, so that alternatives share what lies beneath and make a graph. Before and after each
turn any stack may take in an inserted turn; at a turn each stack keeps it where its initial can be shifted, shifts it
under another role, or deletes it. Stacks that come out equal are merged: the least (cost, audit) stays, audit being the
edits' initials in order. As an audit tells the role of each of its turns, it tells the whole repair; and no audit of the
same turns and cost is the beginning of another, so that least parts make up the least whole.

Costs: keep 0, rerole 2, delete 3, insert 2, and 1 for a truncated turn that isn't deleted. Blank turns and duplicates
must go. A turn's first fault counts: blank (no character but white space), duplicate (role and text seen earlier in
the conversation), truncated (the last character but white space is none of . ! ?).

Where a text was seen first is an aggregate by conversation, role and digest, joined to the turns. Turns are then dealt
and sorted by ranges of (conversation, turn, role, text), so that a conversation may lie in many tasks: each cuts it into
stretches of up to STRETCH turns. One that lies whole in a stretch is parsed there. Of others each stretch is parsed
from every stack that there can be; the ways between stacks are chained in order, as a stream of a few rows for STRETCH
turns that forgets what all stacks have in common. Stretches are a table in the shared folder. Only the digest of a
conversation's repaired text, which has to see the text in order, is one task's work for each conversation; it
streams, and holds one stretch at a time.

Null roles and texts are one space; null conv_ids are one conversation. Turns go by number (nulls first), then by role and
text; turns that repeat are all there, and duplicates but for the first. Roles other than these three, by their initials,
can't be kept. An empty conversation is legal. Long texts only end a stretch early. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.tasks import partitions, written

# The grammar's rules, the first being the one that accepts; the roles that edits give; costs.
RULES = (("Start", ("Conversation",)), ("Conversation", ()), ("Conversation", ("Turns",)), ("Conversation", ("s", "Turns")), ("Turns", ("u", "a")), ("Turns", ("Turns", "u", "a")))
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
END = "$"
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Turns, and characters of their texts, after which a stretch ends.
STRETCH, CHARACTERS = 256, 2 << 20

Best = tuple[int, str]


class Tables:
    """LR(0) states of a grammar with reductions by FOLLOW sets, and the stacks that sentences can lead to."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.names = {left for left, _ in rules}
        follow = self._follow()
        start = self._closure({(0, 0)})
        states, self.goto, todo = {start: 0}, {}, [start]
        while todo:
            items = todo.pop()
            for symbol in sorted({rules[r][1][at] for r, at in items if at < len(rules[r][1])}):
                new = self._closure({(r, at + 1) for r, at in items if at < len(rules[r][1]) and rules[r][1][at] == symbol})
                if new not in states:
                    states[new] = len(states)
                    todo.append(new)
                self.goto[states[items], symbol] = states[new]
        self.reduce: dict[tuple[int, str], list[int]] = {}
        for items, n in states.items():
            for r, at in sorted(items):
                if at == len(rules[r][1]) and r:
                    for t in follow[rules[r][0]]:
                        self.reduce.setdefault((n, t), []).append(r)
        self.final = self.goto[0, rules[0][1][0]]
        self._stacks()

    def _closure(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            r, at = todo.pop()
            right = self.rules[r][1]
            for k, (left, _) in enumerate(self.rules):
                if at < len(right) and right[at] == left and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        return frozenset(items)

    def _follow(self) -> dict[str, set]:
        """By repetition until nothing is added: what a name can begin with, and what can follow it."""
        empty = {left for left, right in self.rules if not right}
        first = {n: set() for n in self.names}
        follow = {n: set() for n in self.names} | {self.rules[0][0]: {END}}
        size = -1
        while size != (size := sum(map(len, first.values())) + sum(map(len, follow.values())) + len(empty)):
            for left, right in self.rules:
                if all(x in empty for x in right):
                    empty.add(left)
                for x in right:
                    first[left] |= first.get(x, {x})
                    if x not in empty:
                        break
                after = set(follow[left])
                for x in reversed(right):
                    if x in self.names:
                        follow[x] |= after
                    own = first.get(x, {x})
                    after = after | own if x in empty else set(own)
        return follow

    def _reduced(self, stack: tuple[int, ...], ahead: str) -> set[tuple[int, ...]]:
        """The stack, and all that reductions make of it where `ahead` comes next."""
        found, todo = {stack}, [stack]
        while todo:
            s = todo.pop()
            for r in self.reduce.get((s[-1], ahead), ()):
                left, right = self.rules[r]
                s2 = s[: len(s) - len(right)]
                s2 += (self.goto[s2[-1], left],)
                if s2 not in found:
                    found.add(s2)
                    todo.append(s2)
        return found

    def _shifted(self, stack: tuple[int, ...], ahead: str) -> set[tuple[int, ...]]:
        """The stacks after `ahead` is shifted; where a state only has one reduction, whatever comes, it is made at once."""
        out = set()
        for s in self._reduced(stack, ahead):
            if (s[-1], ahead) in self.goto:
                s = (*s, self.goto[s[-1], ahead])
                while len(only := {tuple(v) for (n, _), v in self.reduce.items() if n == s[-1]}) == 1 and len(next(iter(only))) == 1 and not any(n == s[-1] for n, _ in self.goto):
                    left, right = self.rules[next(iter(only))[0]]
                    s = s[: len(s) - len(right)]
                    s += (self.goto[s[-1], left],)
                out.add(s)
        return out

    def _stacks(self) -> None:
        """Numbers the stacks (0 is the empty one) and tells where each initial leads and which may end. The grammar's
        stacks are of bounded depth, so that there are few."""
        number, todo = {(0,): 0}, [(0,)]
        self.step: list[dict[str, tuple[int, ...]]] = []
        self.ends: list[bool] = []
        terminals = sorted({x for _, right in self.rules for x in right} - self.names)
        for stack in todo:
            own = {}
            for t in terminals:
                to = sorted(self._shifted(stack, t))
                for s in to:
                    if s not in number:
                        number[s] = len(number)
                        todo.append(s)
                if to:
                    own[t] = tuple(number[s] for s in to)
            self.step.append(own)
            self.ends.append(any(s[-1] == self.final for s in self._reduced(stack, END)))


TABLES = Tables()
STACKS = len(TABLES.step)


def _insertions(tops: dict[int, Best]) -> dict[int, Best]:
    """The tops, and those that inserted turns lead to."""
    out, todo = dict(tops), list(tops)
    while todo:
        at = todo.pop()
        cost, audit = out[at]
        for t in ROLES:
            for to in TABLES.step[at].get(t, ()):
                new = (cost + INSERT, audit + "I")
                if to not in out or new < out[to]:
                    out[to] = new
                    todo.append(to)
    return out


def parse(initials: tuple[str, ...], faults: bytes, start: int = 0) -> dict[int, Best]:
    """The least (cost, audit) of the turns' repairs from a stack to each stack."""
    tops: dict[int, Best] = {start: (0, "")}
    for initial, fault in zip(initials, faults):
        new: dict[int, Best] = {}

        def take(to: int, cost: int, audit: str) -> None:
            if to not in new or (cost, audit) < new[to]:
                new[to] = (cost, audit)

        for at, (cost, audit) in _insertions(tops).items():
            take(at, cost + DELETE, audit + "D")
            if fault in (BLANK, DUPLICATE):
                continue
            more = TRUNCATED if fault == CUT else 0
            for to in TABLES.step[at].get(initial, ()):
                take(to, cost + KEEP + more, audit + "K")
            for t in ROLES:
                for to in TABLES.step[at].get(t, ()):
                    take(to, cost + REROLE + more, audit + "R")
        tops = new
    return _insertions(tops)


@lru_cache(maxsize=50_000)
def whole(initials: tuple[str, ...], faults: bytes) -> Best:
    """The least (cost, audit) of a whole conversation."""
    return min(best for at, best in parse(initials, faults).items() if TABLES.ends[at])


def replay(audit: str, roles: list[str], texts: list[str], start: int = 0) -> tuple[list[tuple[str, str]], int]:
    """The repaired turns (role, text) that an audit tells of, and the stack they lead to."""
    at, place, out = start, 0, []
    for edit in audit:
        if edit == "D":
            place += 1
            continue
        due = roles[place][:1] if edit == "K" else next(t for t in ROLES if t in TABLES.step[at])
        at = TABLES.step[at][due][0]
        out.append((roles[place] if edit == "K" else ROLES[due], "" if edit == "I" else texts[place]))
        place += edit != "I"
    return out, at


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns (conv_id, turn, role, text, dropped) with faults by crc32 of 'conv_id:turn' modulo 20: 0 drops a turn, 1 empties
    its text, 2 takes its full stops, 3 repeats it, 4 sets its role to user. A dropped turn stays as a row without role
    and text, so that its conversation is known."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col))) % 20
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def _seen(turns: DataFrame) -> DataFrame:
    """The turns with `again`: whether role and text were seen in a turn of a lower number."""
    keyed = turns.withColumn("key", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    first = keyed.where("not dropped").groupBy(F.col("conv_id").alias("of"), F.col("key").alias("same")).agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    met = keyed.join(first, (F.col("same") == F.col("key")) & F.col("of").eqNullSafe(F.col("conv_id")) & ~F.col("dropped"), "left")
    again = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return met.select("conv_id", "turn", "role", "text", "dropped", again.alias("again"))


_WAYS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")


def _schema(conv: T.StructField) -> T.StructType:
    """A stretch: its place (part, seq), whether it is a whole conversation, its turns, what is counted in it, its first and
    last turn number and initial, and the ways through it."""
    text = T.StringType()
    return T.StructType([
        T.StructField("conv_id", conv.dataType), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("whole", T.BooleanType()),
        T.StructField("roles", T.ArrayType(text)), T.StructField("texts", T.ArrayType(text)), *(T.StructField(c, T.LongType()) for c in _COUNTS),
        T.StructField("least", T.LongType()), T.StructField("most", T.LongType()), T.StructField("head", text), T.StructField("tail", text), T.StructField("ways", _WAYS),
    ])


class _Stretch:
    def __init__(self, conv, first: bool):
        self.conv, self.first = conv, first
        self.roles, self.texts, self.numbers, self.faults, self.size = [], [], [], bytearray(), 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.size += len(text)
        if turn is not None:
            self.numbers.append(turn)

    def row(self, part: int, seq: int, whole_conversation: bool) -> dict:
        initials = tuple(r[:1] for r in self.roles)
        faults = bytes(self.faults)
        if whole_conversation:
            cost, audit = whole(initials, faults)
            ways = [(0, -1, cost, audit)]
        else:
            ways = [(s, e, c, a) for s in range(STACKS) for e, (c, a) in sorted(parse(initials, faults, s).items())]
        counts = (len(self.roles), *(faults.count(k) for k in (BLANK, DUPLICATE, CUT)), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), len(set(self.numbers)))
        return {
            "conv_id": self.conv, "part": part, "seq": seq, "whole": whole_conversation, "roles": self.roles, "texts": self.texts, **dict(zip(_COUNTS, counts)),
            "least": min(self.numbers, default=None), "most": max(self.numbers, default=None), "head": initials[0] if initials else None, "tail": initials[-1] if initials else None,
            "ways": [dict(zip(("start", "end", "cost", "audit"), w)) for w in ways],
        }


def _text_faults(batch: pa.RecordBatch) -> list[int]:
    """Blank, truncated or neither, by the text alone."""
    text = pc.utf8_rtrim(batch.column("text"), characters=" \t\n\x0b\x0c\r")
    blank = pc.equal(pc.binary_length(text), 0)
    ended = pc.or_(pc.or_(pc.ends_with(text, "."), pc.ends_with(text, "!")), pc.ends_with(text, "?"))
    return [BLANK if b else NONE if e else CUT for b, e in zip(blank.to_pylist(), ended.to_pylist())]


def stretches(turns: DataFrame) -> DataFrame:
    """The stretches of turns (conv_id, turn, role, text, dropped), as a table in the shared folder. Dropped turns only say that
    there is such a conversation."""
    schema = _schema(turns.schema["conv_id"])
    order = ["conv_id", "turn", "role"]
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions(turns))
    # a text's beginning sorts as the text does, and keeps what is sampled for the ranges small
    dealt = _seen(turns).repartitionByRange(n, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text", "dropped")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, seq = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        own: _Stretch | None = None
        before = None
        opening = True  # the first conversation may have begun in the task before
        rows, size = [], 0

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, arrow)

        for batch in batches:
            faults = _text_faults(batch)
            for (conv, turn, role, text, dropped, again), fault in zip(zip(*(c.to_pylist() for c in batch.columns)), faults):
                if own is None or conv != own.conv:
                    if own is not None:
                        rows.append(own.row(part, seq, own.first and not opening))
                        size += own.size
                        seq += 1
                        opening = False
                    own, before = _Stretch(conv, True), None
                elif len(own.roles) >= STRETCH or own.size > CHARACTERS:
                    rows.append(own.row(part, seq, False))
                    size += own.size
                    seq += 1
                    own = _Stretch(conv, False)
                if len(rows) >= 500 or size > CHARACTERS:
                    yield emitted()
                    rows, size = [], 0
                if not dropped:
                    if fault != BLANK and (again or before == (turn, role, text)):
                        fault = DUPLICATE
                    before = (turn, role, text)
                    own.add(turn, role, text, fault)
        if own is not None:
            rows.append(own.row(part, seq, False))
            yield emitted()

    return written(dealt.mapInArrow(each, schema))


class _Way:
    """The least repair up to a stack after some stretches; before: the way that it goes on from."""

    def __init__(self, before: _Way | None, start: int, end: int, cost: int, audit: str, key: tuple):
        self.before, self.start, self.end, self.cost, self.audit, self.key = before, start, end, cost, audit, key
        self.depth = before.depth + 1 if before else 0


def _since(a: _Way, b: _Way) -> tuple[str, str]:
    """The audits of two ways of the same depth, from where they part."""
    x, y = [], []
    while a is not b:
        x.append(a.audit)
        y.append(b.audit)
        a, b = a.before, b.before
    return "".join(reversed(x)), "".join(reversed(y))


def _better(a: _Way, b: _Way) -> bool:
    if a.cost != b.cost:
        return a.cost < b.cost
    x, y = _since(a, b)
    return x < y


class Chain:
    """Ways through a conversation's stretches, one after another. What all ways have in common is handed on and forgotten."""

    def __init__(self):
        self.root = _Way(None, 0, 0, 0, "", ())
        self.tops = {0: self.root}

    def add(self, ways: list[tuple[int, int, int, str]], key: tuple) -> list[tuple]:
        new: dict[int, _Way] = {}
        for start, end, cost, audit in ways:
            if start in self.tops:
                w = _Way(self.tops[start], start, end, self.tops[start].cost + cost, audit, key)
                if end not in new or _better(w, new[end]):
                    new[end] = w
        self.tops = new
        return self._settled(list(new.values()))

    def _settled(self, tops: list[_Way]) -> list[tuple]:
        """Decisions (key, start, audit) up to the way that all tops come from."""
        level = {id(w): w for w in tops}
        while len(level) > 1:
            level = {id(w.before): w.before for w in level.values()}
        last, out = next(iter(level.values())), []
        w = last
        while w is not self.root:
            out.append((w.key, w.start, w.audit))
            w = w.before
        self.root = last
        last.before = None
        return out[::-1]

    def end(self) -> tuple[list[tuple], int]:
        """The decisions that were still open, and the cost."""
        best = None
        for w in self.tops.values():
            if TABLES.ends[w.end] and (best is None or _better(w, best)):
                best = w
        return self._settled([best]), best.cost


_DECISIONS = T.StructType([
    T.StructField("of_part", T.IntegerType()), T.StructField("of_seq", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("audit", T.StringType()),
    T.StructField("cost", T.LongType()), T.StructField("joins", T.LongType()), T.StructField("met", T.LongType()),
])


def _decisions(cut: DataFrame) -> DataFrame:
    """For stretches of conversations that lie in several: the stack that each starts from and its audit; and, for the last,
    the conversation's cost, illegal pairs between stretches (joins), and turn numbers that two stretches share (met)."""
    light = cut.select("conv_id", "part", "seq", "ways", "head", "tail", "least", "most")
    sorted_ = light.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(_DECISIONS)
        chain, conv, tail, most, joins, met = None, None, None, None, 0, 0

        def rows(decided: list[tuple], cost: int | None = None) -> pa.RecordBatch:
            found = [dict(zip(arrow.names, (*key, start, audit, 0, 0, 0))) for key, start, audit in decided]
            if cost is not None:
                found.append(dict(zip(arrow.names, (*last, None, None, cost, joins, met))))
            return pa.RecordBatch.from_pylist(found, arrow)

        for batch in batches:
            for x in batch.to_pylist():
                if chain is None or x["conv_id"] != conv:
                    if chain is not None:
                        yield rows(*chain.end())
                    chain, conv, tail, most, joins, met = Chain(), x["conv_id"], None, None, 0, 0
                last = (x["part"], x["seq"])
                decided = chain.add([(w["start"], w["end"], w["cost"], w["audit"]) for w in x["ways"]], last)
                if decided:
                    yield rows(decided)
                joins += x["head"] is not None and tail is not None and tail + x["head"] not in LEGAL
                met += x["least"] is not None and most == x["least"]
                tail = x["tail"] if x["tail"] is not None else tail
                most = x["most"] if x["most"] is not None else most
        if chain is not None:
            yield rows(*chain.end())

    found = sorted_.mapInArrow(each, _DECISIONS)
    return found.groupBy("of_part", "of_seq").agg(F.max("start").alias("start"), F.max("audit").alias("audit"), *(F.sum(c).alias(c) for c in ("cost", "joins", "met")))


def repair(turns: DataFrame) -> DataFrame:
    """Repaired stretches of turns (conv_id, turn, role, text, dropped): conv_id, part and seq (their order), roles and texts
    as found, counts of faults, least and most turn number, start (the stack before), audit, and cost (on one of a
    conversation's stretches, with the other sums of a conversation)."""
    found = stretches(turns)
    kept = ["conv_id", "part", "seq", "whole", "roles", "texts", *_COUNTS, "least", "most"]
    whole_ = found.where("whole").select(*kept, F.lit(0).alias("start"), F.col("ways")[0]["audit"].alias("audit"), F.col("ways")[0]["cost"].alias("cost"), F.lit(0).cast("long").alias("joins"), F.lit(0).cast("long").alias("met"))
    cut = found.where("not whole")
    decided = written(_decisions(cut))
    cut = cut.select(*kept).join(decided, (F.col("part") == F.col("of_part")) & (F.col("seq") == F.col("of_seq"))).drop("of_part", "of_seq")
    return whole_.unionByName(cut.select(whole_.columns))


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """The repaired turns in order of (part, seq, place): conv_id, part, seq, place, role, text."""

    @F.udf("array<struct<role:string,text:string>>")
    def replayed(audit, roles, texts, start):
        return replay(audit, roles, texts, start)[0]

    return repaired.select("conv_id", "part", "seq", F.posexplode(replayed("audit", "roles", "texts", "start")).alias("place", "x")).select("conv_id", "part", "seq", "place", "x.role", "x.text")


def digests(repaired: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    sums = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([repaired.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in sums), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        own, out = None, []

        def row() -> dict:
            least, most = own["least"], own["most"]
            gaps = 0 if least is None else most - least + 1 - own["turns"]
            return {"conv_id": own["conv_id"], "gaps": gaps, **{c: own[c] for c in sums[1:]}, "audit": "".join(own["audit"]), "repaired_sha256": own["sha"].hexdigest()}

        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if own is None or own["conv_id"] != x["conv_id"]:
                    if own is not None:
                        out.append(row())
                    own = {"conv_id": x["conv_id"], "least": None, "most": None, "audit": [], "sha": hashlib.sha256(), "any": False, **dict.fromkeys((*sums, "turns"), 0)}
                for c in ("blank", "duplicate", "truncated", "illegal", "turns", "cost"):
                    own[c] += x[c]
                own["illegal"] += x["joins"]
                own["turns"] -= x["met"]
                if x["least"] is not None:
                    own["least"] = x["least"] if own["least"] is None else own["least"]
                    own["most"] = x["most"]
                own["audit"].append(x["audit"])
                lines = [f"{role}:{text}" for role, text in replay(x["audit"], x["roles"], x["texts"], x["start"])[0]]
                if lines:
                    own["sha"].update((("\n" if own["any"] else "") + "\n".join(lines)).encode())
                    own["any"] = True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if own is not None:
            yield pa.RecordBatch.from_pylist([*out, row()], arrow)

    columns = ["conv_id", "part", "seq", "roles", "texts", "blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "start", "audit", "cost", "joins", "met"]
    alone = repaired.where("whole").select(columns).mapInArrow(each, schema)
    several = repaired.where("not whole").select(columns).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(each, schema)
    return alone.unionByName(several)
