"""Conversation repair against a search of all edits, turn by turn."""
import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from cases import CLASH
from pyspark.sql import functions as F

from srcgraph.llm import conversation_repair as C
from srcgraph.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(20000)  # of the plain search


def bare(t):
    return t.strip(" \t\n\x0b\x0c\r")


def plain(turns):
    """The contract's columns for one conversation's (turn, role, text) in order: every cheapest way is followed letter by letter."""
    seen, rows, count = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in turns:
        fault = "blank" if not bare(text) else "duplicate" if (role, text) in seen else "truncated" if bare(text)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        rows.append((role, text, fault))

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, audit, output) of the rest; ``inserted``: insertions here so far."""
        ways = []
        if i == len(rows) and state in "0a":
            ways.append((0, "", ()))
        to = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[to]
        if inserted < 3:
            c, a, o = best(i, to, inserted + 1)
            ways.append((c + 3, "I" + a, ((name, ""), *o)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, o = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, o))
            if fault not in ("blank", "duplicate"):
                late = 3 if fault else 0
                if role[:1] == to or (role[:1] == "s" and state == "0"):
                    c, a, o = best(i + 1, role[:1], 0)
                    ways.append((c + late, "K" + a, ((role, text), *o)))
                c, a, o = best(i + 1, to, 0)
                ways.append((c + 3 + late, "R" + a, ((name, text), *o)))
        return min(ways, default=(10 ** 9, "", ()))

    cost, audit, out = best(0, "0", 0)
    at = [t for t, _, _ in turns if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
    return (max(at) - min(at) + 1 - len(set(at)) if at else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def conversation(r, n):
    roles = r.choice([["user", "assistant"], ["user", "assistant", "system"], ["user"], ["assistant", "user", "tool", "system", " ", ""]])
    ends = r.choice([["."], [".", "!", ""], [""]])
    out = []
    for i in range(n):
        text = r.choice(["", " \n", "ok."]) if r.random() < 0.15 else f"t{r.randrange(n + 1)} x{i}" + r.choice(ends) + r.choice(["", " "])
        role = ("user", "assistant")[i % 2] if r.random() < 0.6 else r.choice(roles)
        out.append((None if r.random() < 0.03 else i * r.choice([1, 1, 2]), role, text))
        if r.random() < 0.1:
            out += [out[-1]] * r.randint(1, 3)
    return out


def ordered(turns):
    return sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))


def test_pieces_alone():
    r = random.Random(1)
    for n in [1, 2, 3, 5, 8, 13] * 40:
        turns = conversation(r, n)
        seen, p = set(), C.Piece()
        for _, role, text in turns:
            p.add(role[:1], not bare(text) or bare(text)[-1] not in ".!?", not bare(text) or (role, text) in seen, 1)
            seen.add((role, text))
        assert C.whole(p) == plain(turns)[5:7]


@pytest.mark.parametrize("bits", [2, 7])
def test_repair(spark, bits, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    r = random.Random(2)
    by = {i: conversation(r, n) for i, n in enumerate([1, 2, 3, 4, 6, 9, 17, 40] * 6 + [300])}
    by[None] = conversation(r, 12)
    # turns are told apart, so that the order is fixed but for equal rows
    by = {k: ordered({(t, role): (t, role, x) for t, role, x in v if t is not None}.values()) for k, v in by.items()}
    by = {k: [x for j, x in enumerate(v) if j == 0 or x[0] != v[j - 1][0] for _ in range(1 + (j % 7 == 3))] for k, v in by.items()}
    rows = [(k, *t) for k, v in by.items() for t in v]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).select("*", *[F.lit("own").alias(c) for c in (*CLASH, "conv", "d1", "seq", "audit")])
    ids = spark.createDataFrame([(k,) for k in [*by, 900, 900]], "conv_id long")
    got = {x[0]: tuple(x)[1:] for x in C.repair(df, ids).collect()}
    want = {k: plain(v) for k, v in by.items()} | {900: plain([])}
    assert got == want
    turns = C.repaired_turns(df).orderBy("conv_id", "no").collect()
    text = {}
    for x in turns:
        text.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    assert all(hashlib.sha256("\n".join(text.get(k, [])).encode()).hexdigest() == v[-1] for k, v in want.items())


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 3, "user", "a."), (1, 3, "assistant", "b."), (2, None, None, "x"), (None, 1, "user", None),
            (None, None, "system", "s."), (3, 5, "user", "q?"), (3, 5, "user", "q?"), (3, 5, "user", "q?")] + [(4, i, "user", "same.") for i in range(700)]
    got = {x.conv_id: x for x in C.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].audit, got[1].cost) == (0, 1, 0, "DKDK", 8) or got[1].cost <= 8
    assert (got[3].duplicate, got[3].audit, got[3].cost) == (2, "KDDI", 11)
    assert (got[4].duplicate, got[4].audit, got[4].cost) == (699, "K" + "D" * 699 + "I", 4 * 699 + 3)
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0], x[1])):
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        v = by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        v += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = {x[0]: tuple(x)[1:] for x in Q.REGISTRY["op12_conversation_repair"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {c: plain(v) for c, v in by.items()}
