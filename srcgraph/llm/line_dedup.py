"""Line dedup (2): lines that stand in many documents are dropped everywhere.

Lines are exploded with their position and key (stripped, A-Z lower-cased), hashed to 128 bits,
and the documents of each hash are counted. Positions of frequent lines go back to their document,
where the rest is joined in order.

What is shuffled: per distinct line of a document one fixed-width row, pre-aggregated before the
exchange; per line occurrence (id, text hash, position, line hash) for the join with the frequent
hashes; and each document once. A hot line is one row per map task in the count, and a skewed
inner join with nothing above that needs the key together, which AQE splits. Frequent hashes are
joined, not broadcast by hand: their number grows with the corpus.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.session import materialize

from .common import hash_pair, line_key, of, rows, text_of, unrow


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """(h1, h2, n_docs) of the keys that at least ``min_docs`` rows hold."""
    keys = F.array_distinct(F.transform(F.split(text_of(text), "\n", -1), line_key))
    k = docs.select(F.explode(keys).alias("k")).where(F.char_length("k") >= max(1, min_chars))
    h1, h2 = hash_pair(F.col("k"))
    return (k.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
            .where(F.col("n_docs") >= min_docs))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped (they replace input columns of those names).

    A text is split at \\n; a null or empty text is one empty line. A key of at least ``min_chars``
    code points (and at least one) that occurs in ``min_docs`` or more documents loses all its lines.
    Every row is a document of its own: repeated rows count as often as they stand in the table.
    A document that loses all its lines keeps the empty text. An empty table gives an empty result.
    """
    d = rows(docs)
    cols = [f"_c{i}" for i in range(len(docs.columns))]
    body = F.coalesce(of(docs.columns, text), F.lit(""))
    # a document's drops depend on its text alone, so (id, text hash) names them, also for null or repeated ids
    d = d.select(*cols, of(docs.columns, doc_id).alias("id"), F.xxhash64(body).alias("th"))
    # written, so that both sides of the join are plain exchanges: AQE can then split a hot line's occurrences
    freq = materialize(frequent_lines(docs, min_docs, min_chars, text).select("h1", "h2"), "frequent-lines")
    at = (docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t"))
          .select("id", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
          .select("id", "th", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= max(1, min_chars)))
    h1, h2 = hash_pair(F.col("k"))
    at = at.select("id", "th", "pos", h1.alias("h1"), h2.alias("h2"))
    drops = (at.join(freq, ["h1", "h2"]).groupBy("id", "th").agg(F.collect_set("pos").alias("drops"))
             .select(F.col("id").alias("id2"), F.col("th").alias("th2"), "drops"))
    j = (d.join(drops, d["id"].eqNullSafe(drops["id2"]) & (d["th"] == drops["th2"]), "left")
         .select(*cols, F.coalesce("drops", F.array().cast("array<int>")).alias("drops"),
                 F.split(body, "\n", -1).alias("lines")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.size("drops") == 0, F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(left, lambda p: F.get(F.col("lines"), p)), "\n"))
    return unrow(j, docs.columns, kept_text=kept, n_lines=F.size("lines").cast("long"),
                 n_dropped=F.size("drops").cast("long"))
