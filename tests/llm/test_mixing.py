"""Source mixing against a plain statement of budgets and prefixes."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from cases import awkward, table

from srcgraph.llm.mixing import mix, plan_mix, repeat_by_times


def fill(children, budget, weight):
    """{child: budget}; children: {child: cap}. Those that can take less than their share take all, again and again."""
    left, open_, out = budget, {c for c in children if weight(c) > 0}, dict.fromkeys(children, 0)
    while open_:
        rate = left / sum(weight(c) for c in open_)
        full = [c for c in open_ if children[c] <= rate * weight(c) + 1e-9]
        if not full:
            out.update({c: int(rate * weight(c) + 1e-9) for c in open_})
            break
        for c in full:
            out[c] = children[c]
            left -= children[c]
            open_.discard(c)
    return out


def dom(source):
    return "d" + str(int(hashlib.md5((source or "").encode()).hexdigest()[:8], 16) % 4)


def brute(rows, share, epochs, seed, weights):
    n = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    leaves = defaultdict(list)
    for r in rows:
        leaves[dom(r[3]), r[2], r[3]].append(r)
    cap = {k: epochs * sum(n(r[1]) for r in v) for k, v in leaves.items()}
    w = lambda level: lambda c: weights.get(level, {}).get(c, 1.0)

    def below(prefix):
        return {k[len(prefix)] for k in cap if k[:len(prefix)] == prefix}

    def can_place(prefix):
        """All that a subtree can take: what its children can, but for those of weight 0."""
        if len(prefix) == 3:
            return cap[prefix]
        level = ("domain", "lang", "source")[len(prefix)]
        return sum(can_place((*prefix, c)) for c in below(prefix) if w(level)(c) > 0)

    def caps(prefix):
        return {c: can_place((*prefix, c)) for c in below(prefix)}

    total = sum(n(r[1]) for r in rows)
    out, budgets = Counter(), {}
    for d, bd in fill(caps(()), int(total * share), w("domain")).items():
        for l, bl in fill(caps((d,)), bd, w("lang")).items():
            budgets.update({(d, l, s): b for s, b in fill(caps((d, l)), bl, w("source")).items()})
    for k, b in budgets.items():
        size = cap[k] // epochs
        whole = b // size if size else 0
        rest, done = b - whole * size, 0
        key = lambda r: hashlib.md5(f"{seed}|{whole + 1}|{'' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: B023, E731
        order = sorted(leaves[k], key=key)
        begin = {}
        for r in order:
            begin.setdefault(key(r), done)
            done += n(r[1])
        for r in order:
            times = whole + (begin[key(r)] < rest)
            if times:
                out[r, times] += 1
    return out, budgets


def test_what_a_weight_of_0_leaves_goes_to_the_siblings(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, words(100), "de", "a", 1), (2, words(100), "en", "a", 1), (3, words(1000), "de", "b", 1), (4, words(1000), "en", "b", 1)]
    df = table(spark, rows)
    plan = plan_mix(df, budget=600, max_epochs=1, weights={"lang": {"en": 0.0}}, domain=df["source"]).collect()
    assert {(r.p_domain, r.p_lang): r.budget for r in plan if r.budget} == {("a", "de"): 100, ("b", "de"): 500}


@pytest.mark.parametrize("share,epochs,weights", [(0.5, 4, {}), (1.3, 2, {"lang": {"en": 3.0, "de": 0.0}}), (9.0, 2, {}), (0.0, 1, {})])
def test_mix(spark, share, epochs, weights):
    rows = awkward(8)
    want, budgets = brute(rows, share, epochs, 3, weights)
    got = mix(table(spark, rows, clash=True), seed=3, budget_share=share, max_epochs=epochs, weights=weights)
    assert Counter(((r.doc_id, r.text, r.lang, r.source, r.n_chars), r.mix_times) for r in got.collect()) == want
    plan = plan_mix(table(spark, rows), seed=3, budget_share=share, max_epochs=epochs, weights=weights).collect()
    assert {(p.p_domain, p.p_lang, p.p_source): p.budget for p in plan} == budgets
    again = repeat_by_times(got, ["doc_id", "text"])
    assert again.count() == sum(t * k for (_, t), k in want.items())


def test_shortage_goes_to_siblings_first(spark):
    """Source b cannot fill its half, so a takes the rest; language de gets no more for it."""
    rows = [(i, "w " * 10, "en", "a", 1) for i in range(10)] + [(100, "w " * 10, "en", "b", 1)] + [(200 + i, "w " * 10, "de", "c", 1) for i in range(10)]
    from pyspark.sql import functions as F
    plan = plan_mix(table(spark, rows), budget=100, max_epochs=1, domain=F.lit("one"))
    assert {(p.p_lang, p.p_source): p.budget for p in plan.collect()} == {("en", "a"): 40, ("en", "b"): 10, ("de", "c"): 50}


def test_many_buckets(spark, monkeypatch):
    from srcgraph.llm import mixing
    rows = [(i, "w " * random.Random(i).randint(0, 9), "en", "a", 1) for i in range(800)]
    want, _ = brute(rows, 0.37, 1, 1, {})
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 7)
    got = mix(table(spark, rows), budget_share=0.37, max_epochs=1)
    assert Counter(((r.doc_id, r.text, r.lang, r.source, r.n_chars), r.mix_times) for r in got.collect()) == want


def test_empty(spark):
    assert mix(table(spark, [])).count() == 0
    assert mix(table(spark, [(1, None, None, None, None)])).count() == 0
