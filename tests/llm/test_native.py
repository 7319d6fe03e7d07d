"""Line dedup, quality rules and exact dedup against plain statements of their rules."""
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from cases import CLASH, SCHEMA, awkward, table
from pyspark.sql import functions as F

from srcgraph.llm.exact_dedup import exact_dedup
from srcgraph.llm.line_dedup import dedup_lines
from srcgraph.llm.quality_rules import quality_rules

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACES))


def freq(rows, by=lambda r: None):
    n = Counter()
    for r in rows:
        n.update({(by(r), key(x)) for x in (r[1] or "").split("\n") if key(x)})
    return n


@pytest.mark.parametrize("min_docs", [2, 10])
def test_line_dedup(spark, min_docs):
    rows = awkward()
    n = freq(rows)
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if n[None, key(x)] < min_docs]
        want[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = dedup_lines(table(spark, rows, clash=True), min_docs)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want
    assert {"own " + c for c in CLASH if c not in ("n_lines", "kept_text")} <= set(got.first().asDict().values())


def test_line_dedup_empty_table(spark):
    assert dedup_lines(table(spark, [])).count() == 0


def base(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    rep = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep))


def test_quality_rules(spark):
    rows = awkward(2) + [(900, "a b c d e f g h " * 9 + "\n| x |\n| x |", "en", "a", 3), (901, "w " * 19, "en", "a", 3),
                         (902, " ".join(f"u{i}" for i in range(50)) + "\n# <b> &", "en", "a", 1)]
    n, hosts = freq(rows, lambda r: r[3]), Counter(r[3] for r in rows)
    want = Counter()
    for r in rows:
        b = base(r[1])
        gone = sum(len(re.findall(r"[^ \t-\r]+", x)) for x in (r[1] or "").split("\n")
                   if key(x) and n[r[3], key(x)] > 3 and n[r[3], key(x)] > hosts[r[3]] * 0.1)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        want[(r[0], *b, gone, failed, not failed and b[0] - gone >= 20 and gone <= b[0] * 0.1)] += 1
    got = quality_rules(table(spark, rows, clash=True), max_docs=3, max_share=0.1, max_removed=0.1)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_removed_words,
                    r.base_failed, r.kept) for r in got.collect()) == want
    assert len({w[-1] for w in want}) == 2 and any(w[6] for w in want) and any(w[5] for w in want)
    assert quality_rules(table(spark, [])).count() == 0


def exact_want(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return Counter((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)


def shown(df):
    return Counter((r.doc_id, r.keep_id, r.group_size) for r in df.collect())


@pytest.mark.parametrize("digits", [64, 1])
def test_exact_dedup(spark, tmp_path, digits):
    """With one hexadecimal digit nearly all digests collide, so the check of full bytes must part the texts."""
    rows = awkward(3)
    path = str(tmp_path / "d.parquet")
    table(spark, rows, clash=True).repartition(3).write.parquet(path)
    got = exact_dedup(spark, path, max_files=1, digest=lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, digits)).cache()
    assert shown(got) == exact_want(rows)
    assert got.where("kept").count() == len({r[1] or "" for r in rows})
    if digits == 64:
        assert {r.digest for r in got.collect()} == {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows}


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    path, state = str(tmp_path / "d.parquet"), str(tmp_path / "state")
    table(spark, [(1, "a", None, None, 1), (2, "b", None, None, 1)]).write.parquet(path)
    assert shown(exact_dedup(spark, path, state)) == Counter({(1, 1, 1): 1, (2, 2, 1): 1})
    table(spark, [(7, "a", None, None, 1), (8, "c", None, None, 1)]).write.mode("append").parquet(path)
    assert shown(exact_dedup(spark, path, state)) == Counter({(1, 7, 2): 1, (7, 7, 2): 1, (2, 2, 1): 1, (8, 8, 1): 1})


def test_exact_dedup_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "e.parquet"))
    assert exact_dedup(spark, str(tmp_path / "e.parquet")).count() == 0
