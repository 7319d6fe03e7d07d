"""AGG1-AGG6, AGG10, WIN1-WIN4, SRT1-SRT4: per-repository statistics and top-k lists.

Counts are hash aggregations with a map-side partial step, so a hot repository sends one
partial row per task through the shuffle. Top-k lists use ``row_number``/``dense_rank``
``<= k``; Spark plans these as a window group limit, which also cuts each group to ``k``
rows before the exchange, so a hot repository never sends all its rows to one task.
Ties are broken explicitly (value desc, then key asc) because rows have no order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import HIGH_COMPLEXITY_THRESHOLD, TOP_K
from ..functions.text import display_name


def _count_if(cond):
    return F.count_if(cond).cast("long")


STAT_COLS = ["total_symbols", "classes", "functions", "modules",
             "total_edges", "inheritance_edges", "call_edges", "import_edges"]


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG1: one row per repository; a repository with only nodes or only edges gets zeros.

    Nodes and edges are unioned as ``(repo_id, is_node, label)`` rows and counted in one
    group-by (map-side partial aggregation, one exchange, no join).
    """
    rows = (nodes.select("repo_id", F.lit(True).alias("is_node"), F.col("kind").alias("label"))
            .unionByName(edges.select("repo_id", F.lit(False).alias("is_node"), F.col("type").alias("label"))))
    n, lab = F.col("is_node"), F.col("label")
    return rows.groupBy("repo_id").agg(
        _count_if(n).alias("total_symbols"),
        _count_if(n & (lab == "class")).alias("classes"),
        _count_if(n & (lab == "function")).alias("functions"),
        _count_if(n & (lab == "module")).alias("modules"),
        _count_if(~n).alias("total_edges"),
        _count_if(~n & (lab == "inherits")).alias("inheritance_edges"),
        _count_if(~n & (lab == "calls")).alias("call_edges"),
        _count_if(~n & (lab == "imports")).alias("import_edges"))


def doc_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG2: the report's names for the same counts."""
    g = graph_stats(nodes, edges)
    return g.select("repo_id", F.col("total_symbols").alias("total_nodes"), "total_edges",
                    "classes", "functions", "modules", "call_edges",
                    F.col("inheritance_edges").alias("inherit_edges"), "import_edges")


def call_counts(edges: DataFrame) -> DataFrame:
    """AGG3 (part): calls per target ``(repo_id, target, calls)``."""
    return (edges.where(F.col("type") == "calls").groupBy("repo_id", "target")
            .agg(F.count(F.lit(1)).alias("calls")))


def call_hotspots(edges: DataFrame, k: int = TOP_K) -> DataFrame:
    """AGG3 + WIN2: the ``k`` most-called targets per repository (count desc, target asc)."""
    w = Window.partitionBy("repo_id").orderBy(F.col("calls").desc(), F.col("target"))
    return (call_counts(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("repo_id", "rank", "target", display_name("target").alias("func_name"), "calls"))


def base_classes(edges: DataFrame) -> DataFrame:
    """AGG4: distinct targets of ``inherits`` edges."""
    return edges.where(F.col("type") == "inherits").select("repo_id", F.col("target").alias("base")).distinct()


def high_complexity(nodes: DataFrame, k: int = TOP_K, threshold: int = HIGH_COMPLEXITY_THRESHOLD) -> DataFrame:
    """WIN1 + SRT2: functions with complexity above ``threshold``, top ``k`` per repository
    (complexity desc, then file, name)."""
    w = Window.partitionBy("repo_id").orderBy(F.col("complexity").desc(), F.col("file"), F.col("name"))
    return (nodes.where((F.col("kind") == "function") & (F.col("complexity") > threshold))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("repo_id", "rank", "file", "name", "complexity"))


def first_n(df: DataFrame, n: int, part: list[str], order: list) -> DataFrame:
    """WIN4: first ``n`` rows per group in the given order (``row_number <= n``)."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def classes_per_file(nodes: DataFrame, files: int = 10, per_file: int = 5) -> DataFrame:
    """WIN3: first ``files`` files (sorted) having classes, first ``per_file`` classes of each
    in graph order."""
    cls = nodes.where(F.col("kind") == "class")
    wf = Window.partitionBy("repo_id").orderBy("file")
    wc = Window.partitionBy("repo_id", "file").orderBy("gen", "pos", "name")
    return (cls.withColumn("file_rank", F.dense_rank().over(wf)).where(F.col("file_rank") <= files)
            .withColumn("class_rank", F.row_number().over(wc)).where(F.col("class_rank") <= per_file)
            .select("repo_id", "file_rank", "file", "class_rank", "name"))


def cap_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """SRT1: the first ``n`` nodes per repository in graph order (file, then position)."""
    w = Window.partitionBy("repo_id").orderBy("file", "gen", "pos", "name")
    return nodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def distinct_imports(edges: DataFrame) -> DataFrame:
    """AGG5: distinct imported modules ``(repo_id, module)`` (text before ``:``, empty dropped)."""
    from ..functions.paths import import_target_module
    return (edges.where(F.col("type") == "imports")
            .select("repo_id", import_target_module("target").alias("module"))
            .where(F.col("module") != "").distinct())


def analyzed_modules(nodes: DataFrame) -> DataFrame:
    """AGG6: distinct module names of files that have at least one node."""
    from ..functions.paths import module_name_of_file
    return (nodes.where(F.col("file").isNotNull() & (F.col("file") != ""))
            .select("repo_id", "file").distinct()
            .select("repo_id", module_name_of_file("file").alias("module")).distinct())
