"""GRF10: source files -> graph, as one lazily planned job.

``mode="line"`` is the exact line parser (LIN*). ``mode="scoped"`` uses indentation scopes
(SCP*): every function and class incl. nested ones, calls, imports and bases, no
complexity. ``mode="merged"`` (SCP7) takes symbols, calls, imports and bases from
``scoped``, the function complexity from ``line`` by ``(file, name)``, and module nodes from
``line``. ``mode="auto"`` (SCP7) chooses per file: ``scoped`` for a file whose tokens make a syntax tree
(``pysource.parses``), ``line`` for one in which an open string or bracket or a line without an owner would mislead it.

With ``chunk_lines`` the line parser reads files of at least ``chunk_bytes`` by chunks of that many lines
(``operators.chunks``): the same graph, but one file is the work of many tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pysource import parses
from ..operators import chunks as K
from ..operators import graph as G
from ..operators import lines as L
from ..session import dealt
from ..sources.files import supported_files


CHUNK_BYTES = 1 << 22
SYM_COLS = ["repo_id", "path", "pos", "name", "kind", "complexity"]


def _edges(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("tag") == "edge").select("repo_id", F.col("path").alias("file"), "source", "target", "type")


def line_rows(files: DataFrame, chunk_lines: int | None = None, chunk_bytes: int = CHUNK_BYTES,
              lent: bool = False) -> DataFrame:
    """LIN1-LIN8: the line parser's rows, each file by the form that its length asks for; of a file that is read whole
    only those of functions and modules where no others are asked for (``lent``)."""
    whole = L.function_module_rows if lent else lambda f: L.line_graph_rows(L.line_windows(L.line_features(L.source_lines(f))))
    if chunk_lines is None:
        return whole(files)
    long_ = F.octet_length("content") >= chunk_bytes
    return whole(files.where(~long_)).unionByName(K.chunk_graph_rows(K.chunk_windows(files.where(long_), chunk_lines)))


def tagged_rows(files: DataFrame, mode: str = "line", filter_ext: bool = True, chunk_lines: int | None = None,
                chunk_bytes: int = CHUNK_BYTES, ends: bool = True) -> DataFrame:
    """All symbol and edge rows of ``files`` as one DataFrame with a ``tag`` column
    (``sym``, ``edge``; in ``merged`` mode also ``lfunc``: line-parser function rows that
    only lend their complexity). One pass per parser; nothing is computed twice. Without ``ends`` the scoped parser's
    edges come without the rows of their ends, which ``scoped.edge_end_rows`` makes from them."""
    if filter_ext:
        files = supported_files(files)
    if mode == "auto":  # every file goes to one of two parsers; only their short rows meet
        good = parses(F.col("content"))
        return tagged_rows(files.where(good), "scoped", False).unionByName(
            tagged_rows(files.where(~good), "line", False, chunk_lines, chunk_bytes))
    line = line_rows(files, chunk_lines, chunk_bytes, mode == "merged") if mode != "scoped" else None
    if mode == "line":
        return line
    from ..operators.scoped import scoped_graph_rows, scoped_item_rows
    sc = scoped_graph_rows(files) if ends else scoped_item_rows(files)
    if mode == "scoped":
        return sc
    if mode != "merged":
        raise ValueError(f"unknown mode {mode!r}")
    # of the line parser's rows, read once: functions lend their complexity; module nodes come after every scoped symbol
    # and set no complexity
    mod = F.col("kind") == "module"
    late = F.struct(F.lit(2147483646).alias("n"), F.col("pos.sub"), F.col("pos.n").alias("e"), F.col("pos.i"))
    lent = (line.where((F.col("tag") == "sym") & F.col("kind").isin("function", "module"))
            .withColumn("tag", F.when(mod, "sym").otherwise("lfunc")).withColumn("pos", F.when(mod, late).otherwise(F.col("pos")))
            .withColumn("complexity", F.when(~mod, F.col("complexity"))))
    return sc.unionByName(lent)


def dedupe_merged(rows: DataFrame, default: bool = True) -> DataFrame:
    """GRF2/GRF3 for ``merged`` mode in one hash group-by: kind from the first ``sym`` row;
    the complexity is that of the last ``sym`` row carrying one, where a function takes the
    line parser's (last) complexity of the same ``(file, name)``."""
    d = rows.select("repo_id", "path", "name", "tag", "complexity", G.kind_code("kind").alias("kc"),
                    G.pos_key(F.col("pos")).alias("pk"))
    agg = (d.groupBy("repo_id", F.col("path").alias("file"), "name")
           .agg(F.expr("min_by(kc, pk) FILTER (WHERE tag = 'sym')").alias("kc"),
                F.expr("max_by(complexity, pk) FILTER (WHERE tag = 'lfunc')").alias("lcx"),
                F.expr("max_by(kc, pk) FILTER (WHERE tag = 'sym' AND complexity IS NOT NULL)").alias("last_kc"),
                F.expr("min(pk) FILTER (WHERE tag = 'sym')").alias("pos")))
    other = F.lit(1) if default else F.when(F.col("last_kc").isNotNull(), 1)
    cx = F.when(F.col("last_kc") == 1, F.coalesce("lcx", F.lit(1))).otherwise(other)
    return agg.where(F.col("kc").isNotNull()).select("repo_id", "file", "name", G.kind_name("kc").alias("kind"),
                                                      cx.alias("complexity"), F.lit(0).alias("gen"), "pos")


def build_graph(files: DataFrame, mode: str = "line", filter_ext: bool = True,
                store: bool = False, default: bool = True, chunk_lines: int | None = None,
                chunk_bytes: int = CHUNK_BYTES) -> G.Graph:
    """Nodes and edges of every repository in ``files(repo_id, path, content)``.

    With ``store=True`` the tagged rows are written once (one job into the shared
    checkpoint folder) and nodes and edges are read back from them, so plans that use both
    never analyse the source text twice. Without ``default`` a node that only an edge names
    has a null complexity (what ``merge_graph`` takes).
    """
    if chunk_lines is None:  # no window holds more than a file, no task more than its part of them
        files = dealt(files, "repo_id", "path", text="content")
    ends = not (store and mode in ("scoped", "merged"))
    rows = tagged_rows(files, mode, filter_ext, chunk_lines, chunk_bytes, ends)
    if store:
        from ..session import materialize
        # one job analyses the text; rows are split by tag on disk (edges and symbols are
        # then read separately), and the deduplicated nodes are written once as well
        rows = materialize(rows, f"graph_rows_{mode}", partition_by="tag")
    syms, edges = rows.where(F.col("tag") != "edge"), _edges(rows)
    if not ends:  # a call is written as one row; the two rows of its ends are made as it is read
        from ..operators.scoped import edge_end_rows
        syms = syms.unionByName(edge_end_rows(rows.where(F.col("tag") == "edge")))
    nodes = dedupe_merged(syms, default) if mode == "merged" else G.dedupe_nodes(syms.select(*SYM_COLS), default)
    if store:
        nodes = materialize(nodes, f"graph_nodes_{mode}")
    return G.Graph(nodes, edges)


def build_requested(files: DataFrame, requests: DataFrame, mode: str = "line", **how) -> G.Graph:
    """COL19: the graph of the repositories whose request asks for deep analysis (``analyze_deep``); the files of
    the others are left out before anything is read from them."""
    deep = requests.where("analyze_deep").select("repo_id")
    return build_graph(files.join(deep, "repo_id", "left_semi"), mode, **how)


def merge_files(base: G.Graph, new_files: DataFrame, mode: str = "line",
                replace_files: bool = False, store: bool = False) -> G.Graph:
    """GRF9: analyse ``new_files`` (once, with ``store``) and merge them into the stored graph ``base``."""
    return G.merge_graph(base, build_graph(new_files, mode, store=store, default=False), replace_files=replace_files)
