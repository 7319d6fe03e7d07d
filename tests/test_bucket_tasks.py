"""A bucket of a stored graph that is larger than AQE's partition size is the work of several tasks."""
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from srcgraph.sources import graph_versions as V


@pytest.mark.parametrize("size, several", [("16k", True), ("64m", False)])
def test_large_buckets_are_dealt(spark, tmp_path, size, several):
    edges = spark.range(40000, numPartitions=8).select(
        F.lit("r").alias("repo_id"), F.sha2(F.col("id").cast("string"), 256).alias("file"), F.lit("s").alias("source"),
        F.sha2((F.col("id") + 1).cast("string"), 256).alias("target"), F.lit("calls").alias("type"))
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, size)
    try:
        assert V._write_segment(edges, str(tmp_path), 0, "edges", 2) == [0, 1]
    finally:
        spark.conf.unset(name)
    ver = V.Version(0, "seed", 0, 2)
    ver.segments["edges"] = {0: [0], 1: [0]}
    for b in (0, 1):
        files = list(Path(f"{tmp_path}/segments/{V._name(0)}/edges/bucket={b}").glob("*.parquet"))
        assert (len(files) > 1) == several
    assert Counter(map(tuple, V.read_table(spark, str(tmp_path), ver, "edges").collect())) == Counter(map(tuple, edges.collect()))
