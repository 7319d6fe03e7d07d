"""The removal of quality rules: the text that is left, by the plain rule."""
from collections import Counter

from cases import awkward, table
from test_native import base, freq, key

from srcgraph.llm.quality_rules import quality_rules


def test_over_limit_lines_are_removed(spark):
    rows = awkward(2) + [(900, "Menu\r\n\nx\n menu ", "en", "a", 3)]
    n, hosts = freq(rows, lambda r: r[3]), Counter(r[3] for r in rows)
    over = lambda r, x: key(x) and n[r[3], key(x)] > 3 and n[r[3], key(x)] > hosts[r[3]] * 0.1
    want = Counter((r[0], "\n".join(x for x in (r[1] or "").split("\n") if not over(r, x))) for r in rows)
    got = quality_rules(table(spark, rows, clash=True), max_docs=3, max_share=0.1).collect()
    assert Counter((r.doc_id, r.kept_text) for r in got) == want
    assert all(r.n_words - r.n_removed_words == base(r.kept_text)[0] for r in got)
    assert sum(r.n_removed_words > 0 for r in got) > 10 and any(r.n_removed_words == 0 for r in got)
