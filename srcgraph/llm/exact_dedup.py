"""Exact dedup (8): a streaming query over the table's files with keyed state on disk.

Native: DataFrame and SQL functions only. The stream groups by the SHA-256 of the normalised text
in the RocksDB state store, without watermark, so no key ever expires. A key's state is the group's
size and its best locator: (doc_id, file, row in the file) of the row that stays. No text is held in
the state. Every hit (a row whose digest has two rows or more) then has its full bytes compared with
the content at the locator; rows that differ there (a digest collision) are grouped by their text.

A checkpoint folder may be given to go on with the state of earlier runs as files arrive. State and
checkpoint live in the shared folder; the state's local working copy is restored from there when an
executor is lost. Partial aggregation sends one row per digest and task, so a hot group of copies is
a handful of rows. Texts are shuffled once to meet the hits, and the texts of hits once more.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.session import materialize, scratch_path

from .common import text_of

_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else each state partition sets aside some MB of disk before it holds anything
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _located(df: DataFrame, doc_id: str, text: str, normalise, digest) -> DataFrame:
    t = normalise(text_of(text))
    return df.select(F.col(doc_id).alias("doc_id"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.row_index").alias("pos"), digest(t).alias("digest"), t.alias("t"))


def keyed_state(spark: SparkSession, path: str, checkpoint: str, doc_id: str, text: str, normalise, digest,
                max_bytes: int, max_files: int | None = None) -> DataFrame:
    """Run the stream over all files not seen yet; its whole state: digest, keep (doc_id, file, pos), n."""
    src = spark.readStream.schema(spark.read.parquet(path).schema)
    src = src.option("maxFilesPerTrigger", max_files) if max_files else src.option("maxBytesPerTrigger", max_bytes)
    path = path.rstrip("/")
    # as a pattern, since a stream takes a single file's path only in this form
    rows = _located(src.parquet(f"{path[:-1]}[{path[-1]}]"), doc_id, text, normalise, digest)
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "pos")).alias("keep"),
                                       F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k, None) for k in _CONF}
    try:
        for k, v in _CONF.items():
            spark.conf.set(k, v)
        (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.format("statestore").load(checkpoint)
    names = {f.dataType.typeName(): f.name for f in kept.schema["value"].dataType.fields}
    value = F.col("value")
    return kept.select(F.col("key").getField(kept.schema["key"].dataType.fields[0].name).alias("digest"),
                       value[names["struct"]].alias("keep"), value[names["long"]].alias("n"))


def exact_dedup(spark: SparkSession, path: str, checkpoint: str | None = None, doc_id: str = "doc_id",
                text: str = "text", normalise: Callable[[Column], Column] = lambda c: c,
                digest: Callable[[Column], Column] = _sha, max_bytes: int = 1 << 40,
                max_files: int | None = None) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, digest, file, pos,
    keep_file and keep_pos.

    Texts are equal when their bytes after ``normalise`` are; null is the empty text. Of a group the row with
    the largest doc_id stays (a null id is the smallest); of equal ids the one with the largest (file, pos), so
    exactly one row of a group is kept also for repeated rows. Other columns of the table are not read. An
    empty table gives an empty result. ``max_bytes`` bounds a micro-batch, ``max_files`` does so by files.
    """
    checkpoint = checkpoint or scratch_path(spark, f"exact-dedup-{uuid.uuid4().hex}")
    if not spark.read.parquet(path).take(1):
        return spark.createDataFrame([], "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, digest string, "
                                         "file string, pos bigint, keep_file string, keep_pos bigint")
    state = materialize(keyed_state(spark, path, checkpoint, doc_id, text, normalise, digest, max_bytes, max_files),
                        "exact-dedup-state")
    here = _located(spark.read.parquet(path), doc_id, text, normalise, digest)
    narrow = here.drop("t").join(state, "digest")
    hits = narrow.where("n > 1").select("file", "pos", "digest", F.col("keep"))
    full = here.select("file", "pos", "doc_id", "t").join(hits, ["file", "pos"])
    is_rep = (F.col("file") == F.col("keep.file")) & (F.col("pos") == F.col("keep.pos"))
    rep = full.where(is_rep).select(F.col("digest").alias("d2"), F.col("t").alias("rep"))
    # full bytes: alt is null where they equal the content at the locator, else the text itself
    checked = full.where(~is_rep).join(rep, F.col("digest") == F.col("d2"), "left").select(
        "doc_id", "file", "pos", "digest", F.when(F.col("t") == F.col("rep"), None).otherwise(F.col("t")).alias("alt"))
    checked = materialize(checked.unionByName(
        hits.where(is_rep).select(F.col("keep.doc_id").alias("doc_id"), "file", "pos", "digest",
                                  F.lit(None).cast("string").alias("alt"))), "exact-dedup-checked")
    groups = (checked.groupBy("digest", "alt").agg(F.max(F.struct("doc_id", "file", "pos")).alias("keep"),
                                                   F.count(F.lit(1)).alias("n"))
              .withColumnsRenamed({"digest": "d2", "alt": "alt2"}))
    many = checked.join(groups, (F.col("digest") == F.col("d2")) & F.col("alt").eqNullSafe(F.col("alt2")))
    cols = ["doc_id", "file", "pos", "digest", "keep", "n"]
    out = narrow.where("n = 1").select(*cols).unionByName(many.select(*cols))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                      ((F.col("file") == F.col("keep.file")) & (F.col("pos") == F.col("keep.pos"))).alias("kept"),
                      "digest", "file", "pos", F.col("keep.file").alias("keep_file"), F.col("keep.pos").alias("keep_pos"))
