"""SNK1 / SRC8: storing and reloading graphs as parquet tables.

``nodes`` and ``edges`` are written as two parquet tables partitioned by nothing (the
key ``repo_id`` is a column; partitioning by it would make one directory per repository,
which does not scale to millions of repositories). Reloading applies the defaults of
missing fields (``''`` for text, 1 for complexity) and dedupes nodes first-wins.
"""
from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import scratch_path


def save_graph(g: G.Graph, name: str, path: str | None = None) -> str:
    """SNK1: write ``nodes``/``edges`` under ``path`` (default: the checkpoint folder)."""
    spark = g.nodes.sparkSession
    path = path or scratch_path(spark, f"graphs/{name}-{uuid.uuid4().hex}")
    g.nodes.select(*G.NODE_COLS, "gen", "pos").write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.select(*G.EDGE_COLS).write.mode("overwrite").parquet(f"{path}/edges")
    return path


def load_graph(spark: SparkSession, path: str) -> G.Graph:
    """SRC8: reload; missing text -> ``''``, missing complexity -> 1; first row of a key wins."""
    n = spark.read.parquet(f"{path}/nodes")
    n = n.select("repo_id", F.coalesce("file", F.lit("")).alias("file"),
                 F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.lit("")).alias("kind"),
                 F.coalesce("complexity", F.lit(1)).alias("complexity"), F.coalesce("gen", F.lit(0)).alias("gen"), "pos")
    return G.Graph(G.first_rows(n), spark.read.parquet(f"{path}/edges"))
