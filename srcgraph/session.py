"""Spark session defaults and the shared checkpoint folder."""
from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "srcgraph") -> SparkSession:
    """A session with AQE on and the UI off. On a cluster pass ``master=None`` and let the
    cluster's own configuration decide partitions and memory."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM runs every task
            b = b.config("spark.driver.memory", "16g")
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a fresh folder under the system temp directory; on
    any other master that is an error, since executors and driver do not share local folders.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="srcgraph-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


_TABLES: dict[tuple[str, str], str] = {}
_RESULTS: dict[tuple[str, str], object] = {}


def remembered(spark: SparkSession, key: str, make):
    """``make()`` once per application, for results that stand on written tables; ``clear_tables`` forgets them."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _RESULTS:
        _RESULTS[at] = make()
    return _RESULTS[at]


def clear_tables(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` wrote in this application and forget the results over them; call it
    when no result is read any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "tables"))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _TABLES.clear()
    _RESULTS.clear()


PART_ROWS = 8192
PART_BYTES = 1 << 24


def dealt(df: DataFrame, *keys: str, text: str | None = None, like: DataFrame | None = None) -> DataFrame:
    """``df`` dealt by the hash of ``keys`` over partitions of about ``PART_ROWS`` rows (those of ``like``, where counting it is
    cheaper) and about ``PART_BYTES`` bytes of its column ``text``.

    Rows that grow when they are parsed come from small compressed files: neither the number of splits nor AQE's merging by
    compressed bytes follows their number. These partitions do, and windows and groups by ``keys`` need no further exchange.
    """
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)
    rows, octets = (df if like is None else like).agg(F.count(F.lit(1)), size).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(1, math.ceil(rows / PART_ROWS), math.ceil(octets / PART_BYTES), min(cores, math.ceil(rows / 512)))
    return df.repartition(n, *keys)


OPEN_FILES = 64


def write_by(df: DataFrame, column: str, path: str) -> None:
    """Write ``df`` as parquet, a folder per value of ``column``. A task keeps a file open for each of at most ``OPEN_FILES``
    values, so that its rows need not be sorted; Spark sorts what comes with further values."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, OPEN_FILES)
    try:
        df.write.mode("overwrite").partitionBy(column).parquet(path)
    finally:
        conf.set(name, before)


def materialize(df, name: str, key: str | None = None, partition_by: str | None = None):
    """Write ``df`` as parquet into the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor recomputes from the written files, not from the
    whole plan) and keeps later plans small. With ``key`` the table is written once per
    application and reused.
    """
    import uuid

    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if key is not None and (app, key) in _TABLES:
        return spark.read.schema(df.schema).parquet(_TABLES[(app, key)])
    path = scratch_path(spark, f"tables/{name}-{uuid.uuid4().hex}")
    if partition_by:
        write_by(df, partition_by, path)
    else:
        df.write.mode("overwrite").parquet(path)
    if key is not None:
        _TABLES[(app, key)] = path
    # with the schema given, an empty partitioned table can be read too, and no footer has to be
    return spark.read.schema(df.schema).parquet(path)
