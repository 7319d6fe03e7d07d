import tracemalloc

import numpy as np

from srcgraph.llm import ngram_lm as N


def _parts(n_parts, n, seed=0):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n_parts):
        t = np.unique(np.stack([r.integers(0, 40, n), r.integers(0, 40, n), r.integers(0, 40, n)]), axis=1)
        t[1, t[1] == 39] = N.NONE - 1  # the greatest id
        t[2, t[2] == 39] = N.NONE
        t = t[:, np.lexsort(t[::-1])]
        out.append((*t, r.integers(1, 9, t.shape[1])))
    return out


def test_shard_sums_are_those_of_a_dictionary():
    parts = _parts(9, 3000)
    want = {}
    for x, y, z, c in parts:
        for k, n in zip(zip(x.tolist(), y.tolist(), z.tolist()), c.tolist()):
            want[k] = want.get(k, 0) + n
    xy, z, c = N._sums([N._pack(list(p)) for p in parts])
    got = [((int(a) >> 32, int(a) & 0xFFFFFFFF, int(b)), int(n)) for a, b, n in zip(xy, z, c)]
    assert got == sorted(want.items())


def test_shard_sums_hold_distinct_tuples_only(monkeypatch):
    """Many parts that repeat the same tuples take the memory of a few of them, not of all together."""
    monkeypatch.setattr(N, "PASS_TOKENS", 1 << 14)
    raw = N._pack(list(_parts(1, 1 << 16)[0]))
    one = sum(v.nbytes for v in N._unpack(raw))
    tracemalloc.start()
    N._sums([raw] * 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * one
