"""Quality rules (9): cross-document line frequency per host, after a document's own counts.

Native: DataFrame functions only. Base counts are made inside the row. Repeated 8-word windows are
found by hashing windows (each window hash is put together from two of half the width), and only
where a text repeats one are they sorted by hash to get the places. Lines are hashed to 128 bits,
their distinct documents counted per host, and the lines above the limits removed from their
documents. Only fixed-width rows are shuffled, and a text only where kept_text is read; counts are
pre-aggregated, and the join of line occurrences with frequent lines is one that AQE can split.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.session import materialize

from .common import SPACE_CLASS, hash_pair, line_key, of, rows, strip, text_of, unrow, words

# Fixed value: the symbols that the contract counts.
SYMBOLS = "#*$%&|<>"
WIDTH = 8


def _tail(a: str, n: int) -> F.Column:
    return F.slice(F.col(a), 1, F.greatest(F.size(a) - n, F.lit(0)))


def _shift(a: str, n: int) -> F.Column:
    return F.slice(F.col(a), n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def base_counts(d: DataFrame, t: str) -> DataFrame:
    """d with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of its text column ``t``."""
    keep = [c for c in d.columns]
    bare = F.col(t)
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    d = d.select(*keep, words(F.col(t)).alias("w"), F.filter(F.split(t, "\n", -1), lambda x: F.length(strip(x)) > 0).alias("ls"),
                 (F.char_length(t) - F.char_length(bare)).cast("long").alias("n_symbols"))
    d = d.select(*keep, "n_symbols", F.size("w").cast("long").alias("n_words"),
                 F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
                 F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    done = [*keep, "n_symbols", "n_words", "word_chars", "n_dup_lines"]
    for n in (1, 2, 4):  # hashes of 2, 4 and then 8 words
        d = d.select(*done, F.zip_with(_tail("h", n), _shift("h", n), lambda a, b: F.xxhash64(a, b)).alias("h"))
    d = d.select(*done, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h"))
                 .otherwise(F.array().cast("array<bigint>")).alias("h"))
    d = d.select(*done, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))).alias("s"))
    same = F.zip_with(_tail("s", 1), _shift("s", 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.select(*done, F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))).alias("p"))
    gaps = F.zip_with(_tail("p", 1), _shift("p", 1), lambda a, b: F.least(F.lit(WIDTH), b - a).cast("long"))
    return d.select(*done, F.when(F.size("p") == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(gaps, F.lit(WIDTH).cast("long"), lambda x, y: x + y)).alias("n_repeat_words"))


def over_limit_lines(docs: DataFrame, max_docs: int, max_share: float, host: str, text: str) -> DataFrame:
    """(host, h1, h2, n_docs) of lines in more than ``max_docs`` documents and ``max_share`` of their host's."""
    keys = F.array_distinct(F.transform(F.split(text_of(text), "\n", -1), line_key))
    k = docs.select(F.col(host).alias("host"), F.explode(keys).alias("k")).where(F.length("k") > 0)
    h1, h2 = hash_pair(F.col("k"))
    n = (k.select("host", h1.alias("h1"), h2.alias("h2")).groupBy("host", "h1", "h2")
         .agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs))
    sizes = docs.groupBy(F.col(host).alias("host2")).agg(F.count(F.lit(1)).alias("of"))
    return (n.join(sizes, F.col("host").eqNullSafe(F.col("host2")))
            .where(F.col("n_docs") > F.col("of") * F.lit(max_share)).select("host", "h1", "h2", "n_docs"))


def quality_rules(docs: DataFrame, max_docs: int = 10, max_share: float = 0.01, min_words: int = 20,
                  max_repeat: int = 30, max_removed: float = 0.5, doc_id: str = "doc_id", host: str = "source",
                  text: str = "text") -> DataFrame:
    """``docs`` with the base counts, n_removed_words, kept_text, base_failed and kept.

    Base: n_words < ``min_words`` or 100 * n_repeat_words > ``max_repeat`` * n_words. Method: the lines
    (stripped, A-Z lower-cased, at least one character) that more than ``max_docs`` documents of a host and
    more than ``max_share`` of its documents hold are removed, the others stay as kept_text, joined by \\n, also of
    documents that are not kept; a document is depleted, and not kept, when
    fewer than ``min_words`` words are left or more than ``max_removed`` of its words went. A null text is
    empty (no words, so base_failed). A null host is a host of its own. Every row is a document: repeated
    rows count as often as they stand there. New columns replace input columns of the same name.
    """
    d = rows(docs)
    cols = [f"_c{i}" for i in range(len(docs.columns))]
    d = d.select(*cols, F.coalesce(of(docs.columns, text), F.lit("")).alias("t"))
    # written, so that both sides of the join are plain exchanges: AQE can then split a hot line's occurrences
    over = materialize(over_limit_lines(docs, max_docs, max_share, host, text).drop("n_docs"), "over-limit-lines")
    at = (docs.select(F.col(doc_id).alias("id"), F.col(host).alias("ho"), text_of(text).alias("t"))
          .select("id", "ho", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
          .select("id", "ho", "th", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") > 0))
    h1, h2 = hash_pair(F.col("k"))
    at = at.select("id", "ho", "th", "pos", F.regexp_count("k", F.lit(f"[^{SPACE_CLASS[1:]}+")).alias("n"),
                   h1.alias("a1"), h2.alias("a2"))
    gone = (at.join(over, F.col("ho").eqNullSafe(F.col("host")) & (F.col("a1") == F.col("h1")) & (F.col("a2") == F.col("h2")))
            .groupBy("id", "ho", "th").agg(F.collect_set(F.struct("pos", "n")).alias("x"))
            .select(F.col("id").alias("id2"), F.col("ho").alias("ho2"), F.col("th").alias("th2"),
                    F.aggregate("x", F.lit(0).cast("long"), lambda s, y: s + y["n"]).alias("gone"), F.col("x.pos").alias("drops")))
    b = base_counts(d.select(*cols, F.xxhash64("t").alias("th"), "t"), "t")
    j = b.join(gone, of(docs.columns, doc_id).eqNullSafe(F.col("id2")) & of(docs.columns, host).eqNullSafe(F.col("ho2"))
               & (F.col("th") == F.col("th2")), "left").withColumns({"gone": F.coalesce("gone", F.lit(0).cast("long")),
                                                                    "lines": F.split("t", "\n", -1)})
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("gone") < min_words) | (F.col("gone") > F.col("n_words") * F.lit(max_removed))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept_text = F.when(F.col("drops").isNull(), F.col("t")).otherwise(
        F.array_join(F.transform(left, lambda p: F.get(F.col("lines"), p)), "\n"))
    return unrow(j, docs.columns, n_words=F.col("n_words"), word_chars=F.col("word_chars"), n_symbols=F.col("n_symbols"),
                 n_dup_lines=F.col("n_dup_lines"), n_repeat_words=F.col("n_repeat_words"),
                 n_removed_words=F.col("gone"), kept_text=kept_text, base_failed=failed, kept=~failed & ~depleted)
