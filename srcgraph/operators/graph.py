"""GRF1-GRF10, SET1-SET3: the property graph ``nodes`` / ``edges`` of many repositories.

``nodes``: ``repo_id, file, name, kind, complexity, gen, pos`` -- unique on ``(repo_id, file, name)``;
``gen`` counts the merges before the node came, ``pos`` is its place in its file.
``edges``: ``repo_id, file, source, target, type`` -- a multiset (duplicates are kept).

Node rules: the first row of a key decides ``kind`` (GRF2); the last row that carries a
complexity decides ``complexity``, default 1 (GRF3). Rows are ordered by ``pos``
``(n, sub, e, i)`` inside a file; endpoint rows (GRF7) come after every symbol of the file.
The group-by on ``(repo_id, file, name)`` is satisfied by a hash partitioning on
``(repo_id, path)``, so when symbols come straight from the line windows no extra
exchange is planned.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAXINT = 2147483647

NODE_COLS = ["repo_id", "file", "name", "kind", "complexity"]
EDGE_COLS = ["repo_id", "file", "source", "target", "type"]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def node_key(file_col, name_col):
    """GRF1: ``file:name``."""
    return F.concat_ws(":", F.col(file_col) if isinstance(file_col, str) else file_col,
                       F.col(name_col) if isinstance(name_col, str) else name_col)


def inherit_edges(bases: DataFrame) -> DataFrame:
    """GRF5: ``child -> parent`` in the same file, from ``(repo_id, path, n, i, class_name, base)``."""
    return bases.select("repo_id", F.col("path").alias("file"), "n", "i",
                        node_key("path", "class_name").alias("source"), node_key("path", "base").alias("target"),
                        F.lit("inherits").alias("type"))


def call_edges(calls: DataFrame) -> DataFrame:
    """GRF4: ``caller -> callee`` in the same file, from ``(repo_id, path, n, i, caller, callee)``."""
    return calls.select("repo_id", F.col("path").alias("file"), "n", "i",
                        node_key("path", "caller").alias("source"), node_key("path", "callee").alias("target"),
                        F.lit("calls").alias("type"))


def import_edges(imports: DataFrame) -> DataFrame:
    """GRF6: ``file path -> module text``; neither end is a node key."""
    return imports.select("repo_id", F.col("path").alias("file"), "n", F.lit(0).alias("i"),
                          F.col("path").alias("source"), F.col("module").alias("target"),
                          F.lit("imports").alias("type"))


def endpoint_rows(calls: DataFrame | None, bases: DataFrame | None) -> DataFrame | None:
    """GRF7: every end of a ``calls`` edge (target, then source; kind ``function``) and of an
    ``inherits`` edge (source, then target; kind ``class``) as a symbol row without complexity,
    placed after all symbols of its file. GRF2/GRF3 then keep them only where the key is new.
    """
    parts = []

    def rows(df, first, second, kind, grp):
        pos = lambda which: F.struct(F.lit(_MAXINT).alias("n"), F.lit(grp).alias("sub"),
                                     F.col("n").cast("int").alias("e"),
                                     (F.col("i").cast("int") * 2 + which).alias("i"))
        a = df.select("repo_id", "path", pos(0).alias("pos"), F.col(first).alias("name"),
                      F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("complexity"))
        b = df.select("repo_id", "path", pos(1).alias("pos"), F.col(second).alias("name"),
                      F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("complexity"))
        return a.unionByName(b)

    if calls is not None:
        parts.append(rows(calls, "callee", "caller", "function", 0))
    if bases is not None:
        parts.append(rows(bases, "class_name", "base", "class", 1))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


KINDS = ["class", "function", "module"]


def kind_code(c):
    """The three kinds that the extractors make as small ints (fixed-width aggregation buffers). Stored graphs
    may hold any other kind; they never go through this code (see ``first_rows``, ``merge_graph``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "class", 0).when(c == "function", 1).when(c == "module", 2)


def kind_name(c):
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col(c) if isinstance(c, str) else c) + 1)


def pos_key(pos_col):
    """The position ``(n, sub, e, i)`` as one order-preserving long: symbols ``n*4+sub``, line-parser module rows
    of merged mode (``n = MAXINT-1``) from ``2^61``, endpoint rows (``n = MAXINT``) from ``2^62`` with 30 bits each
    for line and item -- more than a text of 1 GiB can hold, and a column value cannot be longer than 2 GiB."""
    n = pos_col.getField("n").cast("long")
    sub = pos_col.getField("sub").cast("long")
    e = pos_col.getField("e").cast("long")
    i = pos_col.getField("i").cast("long")
    return (F.when(n == _MAXINT, F.lit(1 << 62) + sub * F.lit(1 << 60) + e * F.lit(1 << 30) + i)
            .when(n == _MAXINT - 1, F.lit(1 << 61) + sub * F.lit(1 << 34) + e)
            .otherwise(n * 4 + sub))


ENDPOINT_POS = 1 << 62
#: Graph order inside a repository: file, then the merge that brought the node, then its position.
GRAPH_ORDER = ["file", "gen", "pos", "name"]


def dedupe_nodes(symbol_rows: DataFrame, default: bool = True) -> DataFrame:
    """GRF2 + GRF3: one node per ``(repo_id, file, name)`` of freshly extracted rows.

    ``kind`` = kind of the lowest position; ``complexity`` = complexity of the highest
    position among rows that carry one, else 1 (null without ``default``); ``pos`` = lowest
    position as a long. All buffers are fixed-width (hash aggregation with a map-side
    partial step).
    """
    d = symbol_rows.select("repo_id", "path", "name", kind_code("kind").alias("kc"), "complexity",
                           pos_key(F.col("pos")).alias("pk"))
    agg = (d.groupBy("repo_id", F.col("path").alias("file"), "name")
           .agg(F.min_by("kc", "pk").alias("kc"),
                F.expr("max_by(complexity, pk) FILTER (WHERE complexity IS NOT NULL)").alias("cx"),
                F.min("pk").alias("pos")))
    return agg.select("repo_id", "file", "name", kind_name("kc").alias("kind"),
                      (F.coalesce("cx", F.lit(1)) if default else F.col("cx")).alias("complexity"),
                      F.lit(0).alias("gen"), "pos")


def first_rows(nodes: DataFrame) -> DataFrame:
    """The first row of every key, whole, of a stored node table that may hold a key twice (any kind)."""
    first = F.min_by(F.struct("kind", "complexity", "gen", "pos"), F.struct("gen", "pos")).alias("r")
    return nodes.groupBy("repo_id", "file", "name").agg(first).select("repo_id", "file", "name", "r.*")


def append_edges(*edge_sets: DataFrame) -> DataFrame:
    """GRF8 / SET2: edges are a multiset: ``UNION ALL``, never a dedupe."""
    out = edge_sets[0].select(*EDGE_COLS)
    for e in edge_sets[1:]:
        out = out.unionByName(e.select(*EDGE_COLS))
    return out


def _next_gen(nodes: DataFrame) -> int:
    return int(nodes.agg(F.max("gen")).first()[0] or 0) + 1


def join_nodes(stored: DataFrame, new: DataFrame, take_new_complexity: bool, gen: int | None = None) -> DataFrame:
    """Stored nodes keep kind, order and place; new keys come after them, as generation ``gen`` (by default the
    next one) + their own."""
    gen = _next_gen(stored) if gen is None else gen
    key = ["repo_id", "file", "name"]
    n = new.select(*key, F.col("kind").alias("k2"), F.col("complexity").alias("c2"), F.col("gen").alias("g2"), F.col("pos").alias("p2"))
    j = stored.select(*key, "kind", "complexity", "gen", "pos").join(n, key, "full")
    old = F.col("gen").isNotNull()
    cx = F.coalesce("c2", "complexity", F.lit(1)) if take_new_complexity else F.when(old, F.col("complexity")).otherwise(F.col("c2"))
    return j.select(*key, F.when(old, F.col("kind")).otherwise(F.col("k2")).alias("kind"), F.coalesce(cx, F.lit(1)).alias("complexity"),
                    F.when(old, F.col("gen")).otherwise(F.col("g2") + gen).alias("gen"),
                    F.when(old, F.col("pos")).otherwise(F.col("p2")).alias("pos"))


def add_nodes(stored: DataFrame, new: DataFrame, take_new_complexity: bool, gen: int) -> DataFrame:
    """``join_nodes`` of tables that share no key: nothing is joined, whatever complexity would be taken."""
    cx = F.coalesce("complexity", F.lit(1)).alias("complexity")
    row = lambda d, g: d.select("repo_id", "file", "name", "kind", cx, g.alias("gen"), "pos")
    return row(stored, F.col("gen")).unionByName(row(new, F.col("gen") + gen))


def graph_union(a: Graph, b: Graph) -> Graph:
    """SET2: union of two stored graphs: a key of ``a`` keeps its row whole, edges are appended."""
    return Graph(join_nodes(a.nodes, b.nodes, False), append_edges(a.edges, b.edges))


def merge_graph(base: Graph, new: Graph, replace_files: bool = False) -> Graph:
    """GRF9: merge freshly analysed files into a stored graph.

    ``new.nodes`` carries a null complexity where only an edge names the node. A stored node keeps its kind and
    place and takes the new complexity when a new *symbol* names it again; new nodes follow the stored ones of
    their file. Edges are appended, so analysing a file twice duplicates its edges -- unless
    ``replace_files=True``, which first drops the stored nodes and edges of files present in the new batch
    (idempotent re-runs).
    """
    nodes, edges = base.nodes, base.edges
    if replace_files:
        files = new.nodes.select("repo_id", "file").unionByName(new.edges.select("repo_id", "file")).distinct()
        nodes = nodes.join(files, ["repo_id", "file"], "left_anti")
        edges = edges.join(files, ["repo_id", "file"], "left_anti")
    return Graph(join_nodes(nodes, new.nodes, True), append_edges(edges, new.edges))


def call_endpoints(edges: DataFrame) -> DataFrame:
    """SET1: distinct ends of ``calls`` edges ``(repo_id, key)``."""
    c = edges.where(F.col("type") == "calls")
    return (c.select("repo_id", F.col("source").alias("key"))
            .union(c.select("repo_id", F.col("target").alias("key"))).distinct())
