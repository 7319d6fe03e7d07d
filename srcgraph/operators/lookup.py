"""COL17, COL18, JOIN8: which symbols call / inherit from a given name.

The test is a substring test on the edge target (``pattern in target``), so it also
matches path text of the key; ``exact=True`` compares the name after the last ``:``.
For a table of patterns (JOIN8) there is no equi key. A pattern table whose size is
checked to be small is broadcast (nested loop over a few patterns). A larger one is
matched exactly with an equi-join: a pattern's first GRAM characters (all, if it has fewer) are its
key, each target is cut into its distinct substrings of those lengths (GRAM at most), and what the
keys bring together is tested in full.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_PATTERNS = 256
GRAM = 8


def _sources(edges: DataFrame, edge_type: str, pattern: str, exact: bool) -> DataFrame:
    e = edges.where(F.col("type") == edge_type)
    cond = (F.substring_index("target", ":", -1) == F.lit(pattern)) if exact else F.col("target").contains(pattern)
    return e.where(cond).select("repo_id", "source")


def calls_to(edges: DataFrame, target_symbol: str, exact: bool = False) -> DataFrame:
    """COL17: sources of ``calls`` edges whose target contains ``target_symbol``."""
    return _sources(edges, "calls", target_symbol, exact)


def inherits_from(edges: DataFrame, base_class: str, exact: bool = False) -> DataFrame:
    """COL18: sources of ``inherits`` edges whose target contains ``base_class``."""
    return _sources(edges, "inherits", base_class, exact)


def pattern_lookup(edges: DataFrame, patterns: DataFrame, max_broadcast: int = BROADCAST_MAX_PATTERNS) -> DataFrame:
    """JOIN8: ``(pattern, type, repo_id, source)`` for every edge of ``type`` whose target
    contains ``pattern``. ``patterns(pattern, type)``; an empty pattern is in every target."""
    pats = patterns.select("pattern", "type").where(F.col("pattern").isNotNull()).distinct()
    e = edges.select("repo_id", "source", "target", "type")
    if pats.count() <= max_broadcast:
        j = e.join(F.broadcast(pats), (e["type"] == pats["type"]) & e["target"].contains(pats["pattern"]))
        return j.select(pats["pattern"], pats["type"], e["repo_id"], e["source"])
    keyed = pats.withColumn("gram", F.substring("pattern", 1, GRAM)).withColumn("len", F.length("gram"))
    lens = keyed.select("type", "len").distinct()  # GRAM + 1 lengths of each edge type at most
    t = e.join(F.broadcast(lens), "type").where(F.length("target") >= F.col("len"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("target") - F.col("len") + 1),
                                         lambda i: F.substring(F.col("target"), i, F.col("len"))))
    # one row per edge and distinct substring: duplicate edges stay duplicate matches
    t = t.select("repo_id", "source", "type", "target", "len", F.explode(grams).alias("gram"))
    j = t.join(keyed, ["type", "len", "gram"]).where(F.col("target").contains(F.col("pattern")))
    return j.select("pattern", "type", "repo_id", "source")
