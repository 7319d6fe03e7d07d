"""JOIN1-JOIN4, COL11-COL13, COL16, SRT3, RPT7: the three report diagrams as tables.

Drawing pictures is a single-machine job and is not built; each diagram is a node table
``(repo_id, diagram, key, label, shape, style, fillcolor)`` and an edge table
``(repo_id, diagram, source, target, label, color, style)`` that any renderer can draw.
Caps are ``row_number() <= n`` per repository (window group limit, also applied before
the exchange); edge filters are semi-joins on ``(repo_id, key)``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CALL_DIAGRAM_NODES, FULL_DIAGRAM_NODES, USAGE_ENTRIES
from ..functions.text import escape_key, file_label
from .graph import node_key
from .stats import cap_nodes


def complexity_band(c) -> F.Column:
    """COL11: ``red`` above 10, ``yellow`` above 5, else ``lightgreen``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 10, "red").when(c > 5, "yellow").otherwise("lightgreen")


def node_style(nodes: DataFrame) -> DataFrame:
    """COL12 (full graph): label ``name\\n(file)``; class box/lightblue, function
    ellipse/lightgreen, anything else a note without fill."""
    k = F.col("kind")
    return nodes.select(
        "repo_id", escape_key(node_key("file", "name")).alias("key"),
        F.concat(F.col("name"), F.lit("\n("), file_label("file"), F.lit(")")).alias("label"),
        F.when(k == "class", "box").when(k == "function", "ellipse").otherwise("note").alias("shape"),
        F.when(k.isin("class", "function"), "filled").alias("style"),
        F.when(k == "class", "lightblue").when(k == "function", "lightgreen").alias("fillcolor"))


def edge_style(edges: DataFrame) -> DataFrame:
    """COL13 (full graph): inherits blue dashed, calls green, others plain; label = type."""
    t = F.col("type")
    return edges.select(
        "repo_id", escape_key("source").alias("source"), escape_key("target").alias("target"),
        t.alias("label"),
        F.when(t == "inherits", "blue").when(t == "calls", "green").alias("color"),
        F.when(t == "inherits", "dashed").alias("style"))


def _keys(nodes: DataFrame) -> DataFrame:
    return nodes.select("repo_id", node_key("file", "name").alias("key"))


def induced_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """JOIN1: edges whose two ends are both in ``keys(repo_id, key)`` (two semi-joins)."""
    src = keys.select("repo_id", F.col("key").alias("source"))
    tgt = keys.select("repo_id", F.col("key").alias("target"))
    return edges.join(src, ["repo_id", "source"], "left_semi").join(tgt, ["repo_id", "target"], "left_semi")


def full_diagram(nodes: DataFrame, edges: DataFrame, max_nodes: int = FULL_DIAGRAM_NODES):
    """SRT1 + JOIN1 + COL12/COL13: first ``max_nodes`` nodes in graph order and the edges
    between them."""
    kept = cap_nodes(nodes, max_nodes)
    dn = node_style(kept).withColumn("diagram", F.lit("ccg"))
    de = edge_style(induced_edges(edges, _keys(kept))).withColumn("diagram", F.lit("ccg"))
    return dn, de


def class_hierarchy(nodes: DataFrame, edges: DataFrame):
    """JOIN2: class nodes and the ``inherits`` edges between class nodes. A repository
    without a class or without any ``inherits`` edge has no diagram (no rows)."""
    cls = nodes.where(F.col("kind") == "class")
    inh = edges.where(F.col("type") == "inherits")
    has = (cls.select("repo_id").distinct()
           .join(inh.select("repo_id").distinct(), "repo_id", "left_semi"))
    cls = cls.join(has, "repo_id", "left_semi")
    dn = cls.select("repo_id", F.lit("class_hierarchy").alias("diagram"),
                    node_key("file", "name").alias("key"),
                    F.concat(F.col("name"), F.lit("\n["), file_label("file"), F.lit("]")).alias("label"),
                    F.lit("box").alias("shape"), F.lit("filled").alias("style"), F.lit("lightblue").alias("fillcolor"))
    keys = _keys(cls).hint("merge")  # as many as classes: never broadcast
    de = induced_edges(inh, keys).select(
        "repo_id", F.lit("class_hierarchy").alias("diagram"), "source", "target",
        F.lit("inherits").alias("label"), F.lit("blue").alias("color"), F.lit("bold").alias("style"))
    return dn, de


def call_endpoint_keys(edges: DataFrame) -> DataFrame:
    """SET1: distinct (escaped) ends of ``calls`` edges."""
    c = edges.where(F.col("type") == "calls")
    return (c.select("repo_id", escape_key("source").alias("key"))
            .union(c.select("repo_id", escape_key("target").alias("key"))).distinct())


def cap_call_nodes(edges: DataFrame, max_nodes: int = CALL_DIAGRAM_NODES) -> DataFrame:
    """SRT3: at most ``max_nodes`` call ends per repository (by key; the original keeps an
    arbitrary subset)."""
    w = Window.partitionBy("repo_id").orderBy("key")
    return (call_endpoint_keys(edges).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= max_nodes).drop("rank"))


def call_subgraph(edges: DataFrame, max_nodes: int = CALL_DIAGRAM_NODES) -> DataFrame:
    """JOIN3: ``calls`` edges whose two (escaped) ends are among the kept call ends."""
    kept = cap_call_nodes(edges, max_nodes)
    c = edges.where(F.col("type") == "calls").select(
        "repo_id", escape_key("source").alias("source"), escape_key("target").alias("target"))
    return induced_edges(c, kept)


def call_node_attributes(nodes: DataFrame, edges: DataFrame, max_nodes: int = CALL_DIAGRAM_NODES) -> DataFrame:
    """JOIN4 + COL11: label ``name\\n(file)\\ncx=N`` and colour band of every kept call end
    that is a known node (unknown keys are skipped: inner equi-join)."""
    kept = cap_call_nodes(edges, max_nodes)
    n = nodes.select("repo_id", escape_key(node_key("file", "name")).alias("key"), "name", "file", "complexity")
    j = kept.join(n, ["repo_id", "key"])
    return j.select("repo_id", F.lit("call_graph").alias("diagram"), "key",
                    F.concat(F.col("name"), F.lit("\n("), file_label("file"), F.lit(")\ncx="),
                             F.col("complexity").cast("string")).alias("label"),
                    F.lit("ellipse").alias("shape"), F.lit("filled").alias("style"),
                    complexity_band("complexity").alias("fillcolor"))


def call_diagram(nodes: DataFrame, edges: DataFrame, max_nodes: int = CALL_DIAGRAM_NODES):
    dn = call_node_attributes(nodes, edges, max_nodes)
    de = call_subgraph(edges, max_nodes).select(
        "repo_id", F.lit("call_graph").alias("diagram"), "source", "target",
        F.lit(None).cast("string").alias("label"), F.lit("green").alias("color"),
        F.lit(None).cast("string").alias("style"))
    return dn, de


DN_COLS = ["repo_id", "diagram", "key", "label", "shape", "style", "fillcolor"]
DE_COLS = ["repo_id", "diagram", "source", "target", "label", "color", "style"]


def diagram_tables(nodes: DataFrame, edges: DataFrame):
    """RPT7: node and edge tables of the three diagrams (``ccg``, ``class_hierarchy``,
    ``call_graph``)."""
    a = full_diagram(nodes, edges)
    b = class_hierarchy(nodes, edges)
    c = call_diagram(nodes, edges)
    dn = a[0].select(*DN_COLS).unionByName(b[0].select(*DN_COLS)).unionByName(c[0].select(*DN_COLS))
    de = a[1].select(*DE_COLS).unionByName(b[1].select(*DE_COLS)).unionByName(c[1].select(*DE_COLS))
    return dn, de


def usage_entry_modules(nodes: DataFrame, n: int = USAGE_ENTRIES) -> DataFrame:
    """COL16: module nodes whose lower-cased name contains ``main`` or ``app``; first ``n``
    in graph order, as ``(repo_id, rank, file_label, name)``."""
    low = F.lower("name")
    m = nodes.where((F.col("kind") == "module") & (low.contains("main") | low.contains("app")))
    w = Window.partitionBy("repo_id").orderBy("file", "gen", "pos", "name")
    return (m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("repo_id", "rank", file_label("file").alias("file_label"), "name"))
