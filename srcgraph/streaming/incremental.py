"""GRF9 as a stream: source files arrive as parquet files in a folder; each micro-batch is
analysed and merged into the stored graph (``foreachBatch``).

The stored graph is versioned and bucketed (``sources.graph_versions``): a batch reads and rewrites
the buckets of its own files and appends the rest. A batch that is retried after its version was
complete finds its own marker and does nothing; one that failed before writes the same number
again, and readers, who go by markers, never see it half done. A stream with a new checkpoint goes
on from the latest version. The stream checkpoint lives in the shared checkpoint folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analyze import build_graph
from ..sources.files import SOURCE_FILE_SCHEMA, supported_files
from ..sources.graph_versions import expire_versions, merge_version, version


def merge_once(files: DataFrame, root: str, made_by: str, mode: str = "line", replace_files: bool = False,
               keep: int | None = None) -> int:
    """Analyse ``files`` and merge them into the latest version unless that version is this very batch's; the
    version's number. With ``replace_files`` what was stored of these files goes; with ``keep`` only the newest
    versions stay."""
    spark = files.sparkSession
    last = version(spark, root)
    if last.made_by == made_by:
        return last.number
    replaced = supported_files(files).select("repo_id", F.col("path").alias("file")) if replace_files else None
    v = merge_version(build_graph(files, mode=mode, store=True, default=False), root, made_by, replaced, all_replaced=replace_files)
    if keep:
        expire_versions(spark, root, keep)
    return v


def merge_stream(spark: SparkSession, source_dir: str, graph_root: str, checkpoint: str,
                 mode: str = "line", available_now: bool = True, replace_files: bool = False, keep: int | None = None):
    """Start the stream: every new parquet file of ``(repo_id, path, content)`` in
    ``source_dir`` is merged into the graph under ``graph_root``."""
    stream = spark.readStream.schema(SOURCE_FILE_SCHEMA).parquet(source_dir)

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        merge_once(batch, graph_root, f"{checkpoint}#{batch_id}", mode, replace_files, keep)

    w = stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
