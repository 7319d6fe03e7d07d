"""Periodic runs against a plain search of every period."""
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from cases import awkward, table
from pyspark.sql import functions as F

from srcgraph.llm import queries as Q
from srcgraph.llm.periodic_runs import periodic_runs, runs_of, solve, word_numbers, z_function


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def plain(w):
    """(start, length, period) of every run, by comparing all words with those q further on, for each q."""
    number = {}
    v, best = np.array([number.setdefault(x, len(number)) for x in w], np.int64), {}
    for q in range(1, len(w) // 3 + 1):
        differ = np.flatnonzero(np.concatenate([[True], v[:-q] != v[q:], [True]]))
        long_ = np.flatnonzero(np.diff(differ) - 1 + q >= max(24, 3 * q))
        for i, j in zip(differ[long_].tolist(), (differ[long_ + 1] - 1).tolist()):
            best.setdefault((i, j + q - i), q)
    return sorted((a, n, q) for (a, n), q in best.items())


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(r, n):
    """Random words with stretches of several periods, nested and side by side."""
    w = []
    while len(w) < n:
        kind = r.randrange(4)
        if kind == 0:
            w += [f"n{r.randrange(50)}" for _ in range(r.randint(1, 40))]
        elif kind == 1:
            block = [f"a{r.randrange(3)}" for _ in range(r.randint(1, max(1, n // 5)))]
            w += (block * r.randint(2, 12))[:n]
        elif kind == 2:
            inner = ["x"] * r.randint(1, 30) + ["y"]
            w += inner * r.randint(1, 8)
        else:
            w += w[-r.randint(1, max(1, len(w))):] * r.randint(1, 4)
    return w[:n]


def cases(seed, sizes):
    r = random.Random(seed)
    return [periodic(r, n) for n in sizes] + [["a"] * 300, ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, ["a", "b"] * 11 + ["a"]]


def test_z_function():
    r = random.Random(2)
    for _ in range(50):
        a = [r.randrange(2) for _ in range(r.randint(1, 30))]
        assert z_function(a) == [next((k for k in range(len(a) - i) if a[k] != a[i + k]), len(a) - i) for i in range(len(a))]


def test_one_tile():
    for w in cases(5, [30, 80, 200, 500, 900] * 12):
        n = word_numbers([x.encode() for x in w])
        assert runs_of(solve(n, 1, len(w) // 3)) == plain(w)


@pytest.mark.parametrize("tile", [128, 256])
def test_tiles_of_long_texts(spark, tile):
    texts = cases(7, [300, 700, 1500, 2500] * 2) + [["b"] * 3000, (["c"] * 700 + ["d"]) * 5, [f"e{i % 900}" for i in range(3000)]]
    rows = [(i, "\n".join(w), "en", "a", 1) for i, w in enumerate(texts)] + awkward(8)
    df = table(spark, rows, clash=True).withColumn("runs", F.lit("own")).withColumn("_key", F.lit(1))
    got = periodic_runs(df, [F.col("doc_id"), F.col("_key")], tile=tile)
    assert got.columns == ["doc_id", "_key", "n_words", "runs", "collapsed"]
    want = sorted((str(r[0]), len(w), str(plain(w)), collapsed(w, plain(w))) for r in rows for w in [words(r[1])])
    assert sorted((str(r.doc_id), r.n_words, str([tuple(x) for x in r.runs]), r.collapsed) for r in got.collect()) == want


def test_empty_table(spark):
    assert periodic_runs(table(spark, []), [F.col("doc_id")]).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in Q.REGISTRY["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = words(d.text)
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain(w)
        planted += bool(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 5
