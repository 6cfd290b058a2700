"""Conversation repair against plain Python that tries all repairs, and against SQL."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from lodestone.llm import oracles, turn_repair
from lodestone.llm.queries import op13_turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, part string, seq string, start string, key string, first string, n string, audit string"
FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def legal(s):
    rest = s[1:] if s[:1] == "s" else s
    return (rest != "" or s == "") and rest == "ua" * (len(rest) // 2)


def cheapest(initials, faults):
    """The first of all repairs by (cost, audit), from the cheapest on, with the roles they give."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(initials) and legal(out):
            return cost, audit, out
        if (i, out) in seen or len(out) > 2 * len(initials) + 2 or not any(legal(out + x) for x in ("", "a", "ua", "uaua")):
            continue
        seen.add((i, out))
        for r in "ua":
            heapq.heappush(heap, (cost + 2, audit + "I", i, out + r))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if faults[i] in (0, 3):
                more = int(faults[i] == 3)
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + (initials[i] or "-")))
                for r in "ua":
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, out + r))


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit, roles = cheapest(initials, faults)
        lines, place, k = [], 0, 0
        names = {"u": "user", "a": "assistant"}
        for edit in audit:
            if edit != "D":
                lines.append((own[place][1] if edit == "K" else names[roles[k]]) + ":" + ("" if edit == "I" else own[place][2]))
                k += 1
            place += edit != "I"
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for c in range(60):
        for t in range(r.randint(1, 9)):
            out.append((c, t + r.choice([0, 0, 0, 5]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(["Yes.", "no", "What?", "", " \t", None, "a\nb!", "é…", f"x{c}{t}."])))
    for t in range(40):  # a long conversation, and one without an id
        out.append((77, t // 2, "user" if t % 2 else "assistant", f"t{t}."))
        out.append((None, None if t % 7 == 0 else t, ["user", "assistant"][t % 2], f"n{t % 5}."))
    return out + [(88, None, None, None), (89, 1, "user", "x" * 300_000 + "."), (90, 3, "assistant", "same."), (90, 3, "assistant", "same."), (90, 3, "assistant", "same.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f", "g") for r in rows], SCHEMA)


def found(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=str)


@pytest.mark.parametrize("stretch, characters", [(256, 2 << 20), (3, 2 << 20), (1, 10)])
def test_equal_to_trying_all(spark, rows, monkeypatch, stretch, characters):
    monkeypatch.setattr(turn_repair, "STRETCH", stretch)
    monkeypatch.setattr(turn_repair, "CHARACTERS", characters)
    repaired = turn_repair.repair(turn_repair.damaged(frame(spark, rows).repartition(3)))
    assert found(turn_repair.digests(repaired)) == brute(rows)
    turns = {}
    for r in turn_repair.repaired_turns(repaired).orderBy("conv_id", "part", "seq", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    shas = {r[0]: r[-1] for r in brute(rows)}
    assert all(hashlib.sha256("\n".join(v).encode()).hexdigest() == shas[k] for k, v in turns.items())
    assert all(legal("".join(x[0] for x in v)) for v in turns.values())


def test_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(f"SELECT {', '.join(FIELDS)} FROM ({oracles.TURN_REPAIR})").fetchall()
    assert sorted(got, key=str) == brute(rows)


def test_given_table_and_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(FIELDS)} FROM ({oracles.TURN_REPAIR})").fetchall()
    assert found(op13_turn_repair(spark, data)) == sorted(want, key=str)


def test_empty(spark):
    assert found(turn_repair.digests(turn_repair.repair(turn_repair.damaged(frame(spark, []))))) == []


def test_parser_against_all_short_conversations():
    for k in range(4):
        for initials in itertools.product(["s", "u", "a", "x"], repeat=k):
            for faults in itertools.product([0, 1, 3], repeat=k):
                if k < 3 or sum(map(ord, initials)) % 3 == 0:
                    assert turn_repair.whole(initials, bytes(faults)) == cheapest(initials, faults)[:2]


def test_chain_of_stretches_is_the_whole():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(5, 14)
        initials, faults = tuple(r.choice("suax") for _ in range(n)), bytes(r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        chain, at, decided = turn_repair.Chain(), 0, []
        while at < n:
            m = r.randint(1, 4)
            ways = [(s, e, *best) for s in range(turn_repair.STACKS) for e, best in turn_repair.parse(initials[at : at + m], faults[at : at + m], s).items()]
            decided += chain.add(ways, (at,))
            at += m
        rest, cost = chain.end()
        assert (cost, "".join(a for _, _, a in decided + rest)) == turn_repair.whole(initials, faults)
