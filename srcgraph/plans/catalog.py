"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Every query reads the driver tables through the fixtures (F1-F6), so its work grows with
them. Output columns are plain (no structs) so that they compare with the DuckDB oracle.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lines as L
from ..operators import stats as S
from ..sources import fixtures as FX
from ..sources.files import supported_files
from ..session import dealt, materialize, remembered
from .analyze import build_graph

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(key: str):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = fn
        return fn
    return deco


def _f1(spark, sf):
    """F1 written once per application into the checkpoint folder (small plans downstream)."""
    return materialize(FX.f1_source_files(spark, sf), "f1", key=f"f1:{sf}")


def _f3(spark, sf):
    f3 = FX.f3_file_entries(spark, sf)
    return materialize(dealt(f3, "repo_id", "path"), "f3", key=f"f3:{sf}")


def _repos(spark, sf):
    """Repositories, written once: else the URL check is pushed below the distinct, onto every row of the table."""
    return materialize(FX.repos(spark, sf), "repos", key=f"repos:{sf}")


def _files(spark, sf):
    return dealt(supported_files(_f1(spark, sf)), "repo_id", "path", text="content")


def _win(spark, sf):
    return L.line_windows(L.line_features(L.source_lines(_files(spark, sf))))


def _feats(spark, sf):
    return L.line_features(L.source_lines(_files(spark, sf)))


def _graph(spark, sf, mode="line"):
    return build_graph(_f1(spark, sf), mode=mode)


def _stored(spark, sf, mode="merged"):
    """The graph of F1 written once per application: plans that read it in several places analyse no text again."""
    return remembered(spark, f"graph:{sf}:{mode}", lambda: build_graph(_f1(spark, sf), mode=mode, store=True))


# ---- LIN: line-level extraction -------------------------------------------------------

@register("source_lines")
def q_source_lines(spark, sf):
    return L.source_lines(_files(spark, sf))


@register("class_symbols")
def q_class_symbols(spark, sf):
    return L.class_symbols(_feats(spark, sf))


@register("class_bases")
def q_class_bases(spark, sf):
    return L.class_bases(_feats(spark, sf)).select("repo_id", "path", "n", "class_name", "base")


@register("function_scopes")
def q_function_scopes(spark, sf):
    return L.function_segments(_win(spark, sf)).select(
        "repo_id", "path", "name", "body_lines",
        F.col("pos.n").alias("close_line"), F.col("pos.sub").alias("close_kind"))


@register("estimate_complexity")
def q_estimate_complexity(spark, sf):
    return L.function_segments(_win(spark, sf)).select("repo_id", "path", "name", "complexity")


@register("import_lines")
def q_import_lines(spark, sf):
    return L.import_lines(_feats(spark, sf))


@register("module_symbols")
def q_module_symbols(spark, sf):
    return L.import_lines(_feats(spark, sf)).select(
        "repo_id", "path", "n", F.split_part("module", F.lit("."), F.lit(1)).alias("name"))


@register("symbol_order")
def q_symbol_order(spark, sf):
    return L.line_symbols(_win(spark, sf)).select(
        "repo_id", "path", "name", "kind", "complexity",
        F.col("pos.n").alias("pos_n"), F.col("pos.sub").alias("pos_sub"))


@register("function_segments")
def q_function_segments(spark, sf):
    return _win(spark, sf).select("repo_id", "path", "n", F.col("seg").cast("long").alias("seg"))


# ---- GRF: graph building --------------------------------------------------------------

@register("node_key")
def q_node_key(spark, sf):
    return _graph(spark, sf).nodes.select("repo_id", G.node_key("file", "name").alias("key"))


@register("dedupe_nodes")
def q_dedupe_nodes(spark, sf):
    return _graph(spark, sf).nodes.select("repo_id", "file", "name", "kind")


@register("last_complexity")
def q_last_complexity(spark, sf):
    return _graph(spark, sf).nodes.select("repo_id", "file", "name", "complexity")


@register("inherit_edges")
def q_inherit_edges(spark, sf):
    return _graph(spark, sf).edges.where(F.col("type") == "inherits")


@register("import_edges")
def q_import_edges(spark, sf):
    return _graph(spark, sf).edges.where(F.col("type") == "imports")


@register("complete_endpoints")
def q_complete_endpoints(spark, sf):
    n = _graph(spark, sf).nodes
    return n.where(F.col("pos") >= F.lit(G.ENDPOINT_POS)).select(*G.NODE_COLS)


@register("append_edges")
def q_append_edges(spark, sf):
    return _graph(spark, sf).edges


@register("build_graph")
def q_build_graph(spark, sf):
    return _graph(spark, sf).nodes.select(*G.NODE_COLS)


# ---- AGG / WIN ------------------------------------------------------------------------

@register("high_complexity")
def q_high_complexity(spark, sf):
    return S.high_complexity(_graph(spark, sf).nodes)


@register("graph_stats")
def q_graph_stats(spark, sf):
    g = _graph(spark, sf)
    return S.graph_stats(g.nodes, g.edges)


@register("doc_stats")
def q_doc_stats(spark, sf):
    g = _graph(spark, sf)
    return S.doc_stats(g.nodes, g.edges)


@register("call_hotspots")
def q_call_hotspots(spark, sf):
    return S.call_hotspots(FX.f5_edges(spark, sf))


@register("base_classes")
def q_base_classes(spark, sf):
    return S.base_classes(_graph(spark, sf).edges)


@register("distinct_imports")
def q_distinct_imports(spark, sf):
    return S.distinct_imports(_graph(spark, sf).edges)


@register("analyzed_modules")
def q_analyzed_modules(spark, sf):
    return S.analyzed_modules(_graph(spark, sf).nodes)


@register("classes_per_file")
def q_classes_per_file(spark, sf):
    return S.classes_per_file(_graph(spark, sf).nodes)


@register("cap_nodes")
def q_cap_nodes(spark, sf):
    from ..functions.constants import FULL_DIAGRAM_NODES
    return S.cap_nodes(_graph(spark, sf).nodes, FULL_DIAGRAM_NODES).select("repo_id", "rank", *G.NODE_COLS[1:])


@register("sort_by_complexity")
def q_sort_by_complexity(spark, sf):
    n = _graph(spark, sf).nodes.where(F.col("kind") == "function")
    return n.orderBy("repo_id", F.col("complexity").desc(), "file", "name").select("repo_id", "file", "name", "complexity")


@register("calls_to")
def q_calls_to(spark, sf):
    from ..operators.lookup import calls_to
    return calls_to(FX.f5_edges(spark, sf), "part:7")


@register("inherits_from")
def q_inherits_from(spark, sf):
    from ..operators.lookup import inherits_from
    return inherits_from(FX.f5_edges(spark, sf), "nation:1")


@register("pattern_lookup")
def q_pattern_lookup(spark, sf):
    from ..operators.lookup import pattern_lookup
    pats = FX.table(spark, sf, "nation").select(
        F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("pattern"),
        F.lit("inherits").alias("type"))
    return pattern_lookup(FX.f5_edges(spark, sf), pats)


# ---- file tree (SRC7, SRT5, STR4, COL5, COL6, AGG9, AGG10, STR2) -------------------------

def _tree(spark, sf):
    from ..operators.tree import file_tree
    return file_tree(_f3(spark, sf))


@register("file_tree")
def q_file_tree(spark, sf):
    return _tree(spark, sf).select("repo_id", "path", "type", "depth")


@register("tree_order")
def q_tree_order(spark, sf):
    return _tree(spark, sf).select("repo_id", "path", "sort_key")


@register("tree_lines")
def q_tree_lines(spark, sf):
    from ..operators.tree import tree_lines
    return tree_lines(_tree(spark, sf)).select("repo_id", "sort_key", "text")


@register("entry_point_files")
def q_entry_point_files(spark, sf):
    from ..operators.tree import entry_point_files, file_rows
    return entry_point_files(file_rows(_f3(spark, sf))).select("repo_id", "path")


@register("entry_point_count")
def q_entry_point_count(spark, sf):
    from ..operators.tree import entry_point_count
    return entry_point_count(_tree(spark, sf))


@register("package_flags")
def q_package_flags(spark, sf):
    from ..operators.tree import package_flags
    return package_flags(_f3(spark, sf))


@register("package_manager")
def q_package_manager(spark, sf):
    from ..operators.tree import package_manager
    return package_manager(_f3(spark, sf))


@register("readme_pick")
def q_readme_pick(spark, sf):
    from ..operators.tree import readme_pick
    return readme_pick(_f3(spark, sf))


@register("first_n_rows")
def q_first_n_rows(spark, sf):
    """WIN4: the first five entry-point files of each repository in tree order."""
    from ..operators.tree import entry_point_files, file_rows
    return S.first_n(entry_point_files(file_rows(_f3(spark, sf))), 5, ["repo_id"], ["sort_key"]).select("repo_id", "rank", "path")


# ---- imports and dependencies (COL7-COL10, JOIN5, JOIN6, IMP1-IMP4, AGG7, AGG8) ---------

def _discovery(spark, sf):
    """Discovery over F1 (its tables are written), once per application."""
    from .discovery import discover
    return remembered(spark, f"discovery:{sf}", lambda: discover(_f1(spark, sf), _f3(spark, sf)))


def _repo_names(spark, sf):
    """COL4: ``(repo_id, repo_name)`` from the accepted URLs."""
    from ..functions.paths import repo_name_from_url
    from .report import accepted
    return accepted(_repos(spark, sf)).select("repo_id", repo_name_from_url("repo_url").alias("repo_name"))


def _classes(spark, sf):
    """Imports of the final graph, classified."""
    from ..operators.deps import classify_imports
    g = _discovery(spark, sf).graph
    return classify_imports(g.edges, g.nodes, _f3(spark, sf), _repo_names(spark, sf))


@register("module_name_of_file")
def q_module_name_of_file(spark, sf):
    from ..functions.paths import module_name_of_file
    return _f3(spark, sf).select("repo_id", "path", module_name_of_file("path").alias("module"))


@register("import_target_module")
def q_import_target_module(spark, sf):
    from ..functions.paths import import_target_module
    return (_graph(spark, sf).edges.where(F.col("type") == "imports")
            .select("repo_id", "file", import_target_module("target").alias("module")))


@register("relative_import_base")
def q_relative_import_base(spark, sf):
    from ..functions.paths import relative_import_base
    e = S.distinct_imports(_graph(spark, sf).edges)
    return e.select("repo_id", "module", relative_import_base("module").alias("base"))


@register("candidate_paths")
def q_candidate_paths(spark, sf):
    from ..functions.paths import candidate_init, candidate_py, relative_import_base
    e = S.distinct_imports(_graph(spark, sf).edges).withColumn("base", relative_import_base("module"))
    return e.where(F.col("base") != "").select("repo_id", "module", candidate_py("base").alias("cand_py"),
                                               candidate_init("base").alias("cand_init"))


@register("unanalyzed_imports")
def q_unanalyzed_imports(spark, sf):
    return _classes(spark, sf).where(~F.col("class").isin("analyzed", "skipped")).select("repo_id", "module")


@register("resolve_module_files")
def q_resolve_module_files(spark, sf):
    return _classes(spark, sf).where(F.col("potential_file").isNotNull()).select("repo_id", "module", "potential_file")


@register("stdlib_imports")
def q_stdlib_imports(spark, sf):
    return _classes(spark, sf).where(F.col("class") == "stdlib").select("repo_id", "module")


@register("internal_imports")
def q_internal_imports(spark, sf):
    return _classes(spark, sf).where(F.col("class") == "internal").select("repo_id", "module", "potential_file")


@register("external_imports")
def q_external_imports(spark, sf):
    return _classes(spark, sf).where(F.col("class") == "external").select("repo_id", "module")


@register("potential_files")
def q_potential_files(spark, sf):
    from ..operators.deps import potential_files
    return potential_files(_classes(spark, sf))


@register("dependency_report")
def q_dependency_report(spark, sf):
    from ..operators.deps import dependency_report
    return dependency_report(_classes(spark, sf), _discovery(spark, sf).graph.nodes)


@register("dependency_lists")
def q_dependency_lists(spark, sf):
    from ..operators.deps import dependency_lists
    return dependency_lists(_classes(spark, sf))


@register("discovery_complete")
def q_discovery_complete(spark, sf):
    return q_dependency_report(spark, sf).select("repo_id", "discovery_complete")


@register("cap_import_lists")
def q_cap_import_lists(spark, sf):
    from ..operators.deps import first_sorted_lists
    return first_sorted_lists(_classes(spark, sf))


# ---- discovery loop (ITR1-ITR3, JOIN9, SET3) --------------------------------------------

@register("discover_modules")
def q_discover_modules(spark, sf):
    return _discovery(spark, sf).reached.select("repo_id", "path", "round")


@register("discovery_rounds")
def q_discovery_rounds(spark, sf):
    return _discovery(spark, sf).rounds.select("repo_id", "discovery_rounds", "files_reached")


@register("seed_choice")
def q_seed_choice(spark, sf):
    from .discovery import seed_files
    s = seed_files(_f1(spark, sf), _f3(spark, sf))
    return s.groupBy("repo_id").agg(F.bool_or("from_entry").alias("seeded_with_entry_points"),
                                    F.count(F.lit(1)).alias("seed_files"))


@register("new_files_only")
def q_new_files_only(spark, sf):
    return _discovery(spark, sf).reached.where(F.col("round") >= 1).select("repo_id", "path", "round")


@register("analyzed_update")
def q_analyzed_update(spark, sf):
    return _discovery(spark, sf).reached.select("repo_id", "path")


# ---- URLs (COL1-COL4) -------------------------------------------------------------------

def _urls(spark, sf):
    from ..functions.urls import url_checks
    return url_checks(FX.f2_repo_urls(spark, sf))


@register("validate_repo_url")
def q_validate_repo_url(spark, sf):
    return _urls(spark, sf)


@register("normalize_repo_url")
def q_normalize_repo_url(spark, sf):
    return _urls(spark, sf).where("valid").select("req_id", "normalized_url")


@register("url_error_message")
def q_url_error_message(spark, sf):
    return _urls(spark, sf).where(~F.col("valid")).select("req_id", "error")


@register("repo_name_from_url")
def q_repo_name_from_url(spark, sf):
    from ..functions.paths import repo_name_from_url
    return _urls(spark, sf).where("valid").select("req_id", repo_name_from_url("normalized_url").alias("repo_name"))


# ---- text (STR1, STR3, COL14, COL15) ----------------------------------------------------

@register("summarize_text")
def q_summarize_text(spark, sf):
    from ..functions.text import summarize_text
    return FX.f4_readmes(spark, sf).select("doc_id", "repo_id", summarize_text("text").alias("summary"))


@register("escape_key")
def q_escape_key(spark, sf):
    from ..functions.text import escape_key
    return _graph(spark, sf).nodes.select("repo_id", escape_key(G.node_key("file", "name")).alias("key"))


@register("display_name")
def q_display_name(spark, sf):
    from ..functions.text import display_name
    return FX.f5_edges(spark, sf).select("repo_id", "target", display_name("target").alias("name"))


@register("file_label")
def q_file_label(spark, sf):
    from ..functions.text import file_label
    return _f3(spark, sf).select("repo_id", "path", file_label("path").alias("label"))


# ---- sources and sinks (SRC1-SRC8, SNK1) -------------------------------------------------

def _checkout(spark, sf):
    """Every file of every checkout (F3) with its text (F1; other files are empty)."""
    f3 = _f3(spark, sf)
    # the texts are far larger than their compressed files: they are neither broadcast nor merged into few tasks
    d = f3.join(_f1(spark, sf).hint("merge"), ["repo_id", "path"], "left")
    return (dealt(d, "repo_id", "path", like=f3)
            .select("repo_id", "path", F.coalesce("content", F.lit("")).alias("content")))


@register("scan_source_files")
def q_scan_source_files(spark, sf):
    from ..sources.files import scan_source_files
    return scan_source_files(_checkout(spark, sf)).select("repo_id", "path", F.length("content").alias("chars"))


@register("prune_ignored_dirs")
def q_prune_ignored_dirs(spark, sf):
    from ..sources.files import prune_ignored_dirs
    return prune_ignored_dirs(_f3(spark, sf)).select("repo_id", "path")


@register("scan_unpruned")
def q_scan_unpruned(spark, sf):
    from ..sources.files import scan_unpruned
    return scan_unpruned(_checkout(spark, sf)).select("repo_id", "path", F.length("content").alias("chars"))


@register("scan_file_list")
def q_scan_file_list(spark, sf):
    from ..operators.tree import entry_point_files
    from ..sources.files import scan_file_list
    wanted = entry_point_files(_tree(spark, sf))
    return scan_file_list(_checkout(spark, sf), wanted).select("repo_id", "path", F.length("content").alias("chars"))


@register("extension_filter")
def q_extension_filter(spark, sf):
    from ..sources.files import extension_filter
    return extension_filter(_f3(spark, sf)).select("repo_id", "path")


@register("decode_tolerant")
def q_decode_tolerant(spark, sf):
    """SRC6 (rows-only): document text as bytes with an invalid byte appended, decoded."""
    from ..functions.text import decode_tolerant
    d = FX.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))).alias("bytes"))
    return d.select("doc_id", decode_tolerant("bytes").alias("content"))


@register("graph_to_json")
def q_graph_to_json(spark, sf):
    """SNK1: one JSON object per node and per edge (both lists of the serialised graph)."""
    g = _graph(spark, sf)
    return (g.nodes.select("repo_id", F.lit("node").alias("list"), F.to_json(F.struct("file", "name", "kind", "complexity")).alias("json"))
            .unionByName(g.edges.select("repo_id", F.lit("edge").alias("list"), F.to_json(F.struct("source", "target", "type")).alias("json"))))


@register("load_base_graph")
def q_load_base_graph(spark, sf):
    """SRC8: write the graph (SNK1, parquet) and load it back with the defaults."""
    from ..sources.graph_store import load_graph, save_graph
    path = save_graph(_graph(spark, sf), "f1_graph")
    return load_graph(spark, path).nodes.select(*G.NODE_COLS)


# ---- report columns (COL11-COL13, COL16, COL19) -----------------------------------------

@register("complexity_band")
def q_complexity_band(spark, sf):
    from ..operators.diagrams import complexity_band
    n = _graph(spark, sf).nodes.where(F.col("kind") == "function")
    return n.select("repo_id", "file", "name", "complexity", complexity_band("complexity").alias("color"))


@register("node_style")
def q_node_style(spark, sf):
    from ..operators.diagrams import node_style
    return node_style(_graph(spark, sf).nodes)


@register("edge_style")
def q_edge_style(spark, sf):
    from ..operators.diagrams import edge_style
    return edge_style(_graph(spark, sf).edges)


@register("usage_entry_modules")
def q_usage_entry_modules(spark, sf):
    from ..operators.diagrams import usage_entry_modules
    return usage_entry_modules(_graph(spark, sf).nodes)


@register("depth_switch")
def q_depth_switch(spark, sf):
    """COL19: statistics of every request; one that does not ask for deep analysis has an empty graph."""
    from .analyze import build_requested
    req = FX.run_requests(spark, sf)
    g = build_requested(_f1(spark, sf), req)
    out = req.join(S.graph_stats(g.nodes, g.edges), "repo_id", "left")
    return out.select("repo_id", F.col("analyze_deep").alias("analyze"),
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in S.STAT_COLS])


# ---- scoped extraction (SCP1-SCP7, JOIN7, GRF4) ------------------------------------------

def _sfeats(spark, sf):
    from ..operators.scoped import scoped_features
    return scoped_features(_files(spark, sf))


@register("scoped_symbols")
def q_scoped_symbols(spark, sf):
    from ..operators.scoped import scoped_symbols
    return scoped_symbols(_sfeats(spark, sf)).select("repo_id", "path", F.col("pos.n").alias("n"), "name", "kind")


@register("scope_ranges")
def q_scope_ranges(spark, sf):
    from ..operators.scoped import enclosing_function
    return enclosing_function(_sfeats(spark, sf))


@register("scoped_calls")
def q_scoped_calls(spark, sf):
    from ..operators.scoped import scoped_calls
    return scoped_calls(_sfeats(spark, sf)).select("repo_id", "path", "caller", "callee")


@register("calls_in_scope")
def q_calls_in_scope(spark, sf):
    from ..operators.scoped import scoped_calls
    return scoped_calls(_sfeats(spark, sf)).select("repo_id", "path", "n", "i", "caller")


@register("callee_name")
def q_callee_name(spark, sf):
    from ..operators.scoped import callee_name
    f = _sfeats(spark, sf).select("repo_id", "path", "n", F.explode("calls").alias("call"))
    return f.select("repo_id", "path", "n", "call", callee_name("call").alias("callee"))


@register("scoped_imports")
def q_scoped_imports(spark, sf):
    from ..operators.scoped import scoped_imports
    return scoped_imports(_sfeats(spark, sf)).select("repo_id", "path", "n", "module")


@register("scoped_bases")
def q_scoped_bases(spark, sf):
    from ..operators.scoped import scoped_bases
    return scoped_bases(_sfeats(spark, sf)).select("repo_id", "path", "n", "class_name", "base")


@register("scoped_wrapped")
def q_scoped_wrapped(spark, sf):
    """SCP1-SCP6 on F8: every symbol, call, base and import of files whose constructs span lines."""
    from ..operators import scoped as SC
    f = materialize(SC.scoped_features(FX.f8_wrapped_sources(spark, sf)), "f8-features")  # four readers, one analysis
    rows = [SC.scoped_symbols(f).select("repo_id", "path", F.col("pos.n").alias("n"), F.col("kind").alias("what"), F.col("name").alias("a"), F.lit("").alias("b")),
            SC.scoped_calls(f).select("repo_id", "path", "n", F.lit("call").alias("what"), F.col("caller").alias("a"), F.col("callee").alias("b")),
            SC.scoped_bases(f).select("repo_id", "path", "n", F.lit("base").alias("what"), F.col("class_name").alias("a"), F.col("base").alias("b")),
            SC.scoped_imports(f).select("repo_id", "path", "n", F.lit("import").alias("what"), F.col("module").alias("a"), F.lit("").alias("b"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@register("parser_choice")
def q_parser_choice(spark, sf):
    """SCP7: the default ``merged`` mode: scoped symbols and calls, line complexity."""
    return _graph(spark, sf, "merged").nodes.select(*G.NODE_COLS)


def _f11(spark, sf):
    return materialize(FX.f11_long_sources(spark, sf), "f11", key=f"f11:{sf}")


@register("chunked_lines")
def q_chunked_lines(spark, sf):
    """LIN4/LIN5/WIN5 by chunks of 128 lines on F11: function number and state of every line."""
    from ..operators.chunks import chunk_windows
    return chunk_windows(_f11(spark, sf), 128).select("repo_id", "path", "n", "kind", F.col("seg").cast("long").alias("seg"),
                                                      "closer", "body")


@register("chunked_graph")
def q_chunked_graph(spark, sf):
    """GRF10 on F11, its files of 32 KB or more by chunks of 128 lines: nodes and edges as one long table."""
    g = build_graph(_f11(spark, sf), store=True, chunk_lines=128, chunk_bytes=1 << 15)
    nodes = g.nodes.select("repo_id", "file", F.col("kind").alias("what"), F.col("name").alias("a"), F.lit("").alias("b"), "complexity")
    edges = g.edges.select("repo_id", "file", F.col("type").alias("what"), F.col("source").alias("a"), F.col("target").alias("b"),
                           F.lit(0).alias("complexity"))
    return nodes.unionByName(edges)


@register("parser_per_file")
def q_parser_per_file(spark, sf):
    """SCP7 per file on F9: nodes and edges of the graph, each file analysed by the parser that its tokens allow."""
    g = build_graph(FX.f9_mixed_sources(spark, sf), mode="auto", store=True)
    nodes = g.nodes.select("repo_id", "file", F.col("kind").alias("what"), F.col("name").alias("a"), F.lit("").alias("b"), "complexity")
    edges = g.edges.select("repo_id", "file", F.col("type").alias("what"), F.col("source").alias("a"), F.col("target").alias("b"),
                           F.lit(0).alias("complexity"))
    return nodes.unionByName(edges)


@register("call_edges")
def q_call_edges(spark, sf):
    return _graph(spark, sf, "scoped").edges.where(F.col("type") == "calls")


@register("hotspot_rank")
def q_hotspot_rank(spark, sf):
    return S.call_hotspots(_graph(spark, sf, "merged").edges)


# ---- diagrams (JOIN1-JOIN4, SRT3, SET1, RPT7) ---------------------------------------------

@register("induced_subgraph")
def q_induced_subgraph(spark, sf):
    from ..operators.diagrams import full_diagram
    g = _stored(spark, sf)
    return full_diagram(g.nodes, g.edges)[1].select("repo_id", "source", "target", "label", "color", "style")


@register("class_hierarchy")
def q_class_hierarchy(spark, sf):
    from ..operators.diagrams import class_hierarchy
    g = _stored(spark, sf)
    return class_hierarchy(g.nodes, g.edges)[1].select("repo_id", "source", "target")


@register("call_subgraph")
def q_call_subgraph(spark, sf):
    from ..operators.diagrams import call_subgraph
    return call_subgraph(_stored(spark, sf).edges)


@register("call_node_attributes")
def q_call_node_attributes(spark, sf):
    from ..operators.diagrams import call_node_attributes
    g = _stored(spark, sf)
    return call_node_attributes(g.nodes, g.edges).select("repo_id", "key", "label", "fillcolor")


@register("cap_call_nodes")
def q_cap_call_nodes(spark, sf):
    from ..operators.diagrams import cap_call_nodes
    return cap_call_nodes(_stored(spark, sf).edges)


@register("call_endpoints")
def q_call_endpoints(spark, sf):
    return G.call_endpoints(_stored(spark, sf).edges)


@register("diagram_tables")
def q_diagram_tables(spark, sf):
    from ..operators.diagrams import diagram_tables
    g = _stored(spark, sf)
    return diagram_tables(g.nodes, g.edges)[0]


@register("diagram_edges")
def q_diagram_edges(spark, sf):
    """RPT7: the edge tables of the diagrams."""
    from ..operators.diagrams import diagram_tables
    g = _stored(spark, sf)
    return diagram_tables(g.nodes, g.edges)[1]


# ---- imports by package (COL7, COL9, COL10 as options) ------------------------------------

@register("package_imports")
def q_package_imports(spark, sf):
    """IMP1-IMP4 keyed by importer on F10, of which a third of the files is not analysed."""
    from ..operators.deps import classify_importers
    files = materialize(FX.f10_package_sources(spark, sf), "f10", key=f"f10:{sf}")
    g = build_graph(files.where("p_partkey % 3 <> 0"), store=True)
    return classify_importers(g.edges, g.nodes, files.select("repo_id", "path"))


@register("package_discovery")
def q_package_discovery(spark, sf):
    """ITR1 with imports resolved by package on F10: the files reached from the entry points, with their pass."""
    from .discovery import discover
    files = materialize(FX.f10_package_sources(spark, sf), "f10", key=f"f10:{sf}").drop("p_partkey")
    return discover(files, by_package=True).reached.select("repo_id", "path", "round")


@register("package_entry_modules")
def q_package_entry_modules(spark, sf):
    """COL16 on F10, where every file imports a module named like an application."""
    from ..operators.diagrams import usage_entry_modules
    return usage_entry_modules(build_graph(FX.f10_package_sources(spark, sf)).nodes)


@register("package_report_usage")
def q_package_report_usage(spark, sf):
    """RPT3 on F10: the list of entry modules instead of the sentence for none."""
    from .report import ReportInputs, report_usage
    g = build_graph(FX.f10_package_sources(spark, sf))
    return report_usage(ReportInputs(g.nodes.select("repo_id").distinct(), g, None, None))


# ---- incremental merge (GRF9, SET2, streaming) ------------------------------------------

def _f6(spark, sf):
    k = F.col("p_partkey")
    f = materialize(FX.f1_source_files(spark, sf, with_key=True), "f1k", key=f"f1k:{sf}")
    return f.where(k % 2 == 0).drop("p_partkey"), f.where((k % 2 == 1) | (k % 10 == 0)).drop("p_partkey")


def _merged(spark, sf):
    from .analyze import merge_files
    stored, new = _f6(spark, sf)
    return merge_files(build_graph(stored), new)


@register("merge_graph")
def q_merge_graph(spark, sf):
    return _merged(spark, sf).nodes.select(*G.NODE_COLS)


@register("merge_order")
def q_merge_order(spark, sf):
    """GRF9: the place of every node in its file after the merge (stored nodes first, in stored order)."""
    from pyspark.sql import Window
    w = Window.partitionBy("repo_id", "file").orderBy(*G.GRAPH_ORDER[1:])
    return _merged(spark, sf).nodes.select("repo_id", "file", "name", F.row_number().over(w).alias("place"))


@register("graph_union")
def q_graph_union(spark, sf):
    """SET2 on two stored graphs: nodes and edges as one long table."""
    stored, new = _f6(spark, sf)
    g = G.graph_union(build_graph(stored, store=True), build_graph(new, store=True))
    none = F.lit(None).cast("string")
    return (g.nodes.select("repo_id", "file", F.lit("node").alias("row"), "name", "kind", "complexity", none.alias("source"), none.alias("target"))
            .unionByName(g.edges.select("repo_id", "file", F.lit("edge").alias("row"), none.alias("name"), F.col("type").alias("kind"),
                                        F.lit(None).cast("int").alias("complexity"), "source", "target")))


@register("merge_edges")
def q_merge_edges(spark, sf):
    """GRF9: the edges after the merge; files analysed again have theirs twice."""
    return _merged(spark, sf).edges.select(*G.EDGE_COLS)


def _streamed(spark, sf):
    """The root of a stored graph into which the new batch came as a stream of parquet files."""
    import uuid

    from ..session import scratch_path
    from ..sources.graph_versions import seed_graph
    from ..streaming.incremental import merge_stream

    def run():
        stored, new = _f6(spark, sf)
        base = scratch_path(spark, f"tables/stream-{uuid.uuid4().hex}")
        seed_graph(build_graph(stored, store=True), f"{base}/graph")
        new.write.parquet(f"{base}/incoming")
        merge_stream(spark, f"{base}/incoming", f"{base}/graph", f"{base}/_checkpoint").awaitTermination()
        return f"{base}/graph"
    return remembered(spark, f"streamed:{sf}", run)


@register("stream_merge")
def q_stream_merge(spark, sf):
    """GRF9 through Structured Streaming: the new batch arrives as parquet files and is merged
    by ``foreachBatch``; the result is the last graph version (equals ``merge_graph``)."""
    from ..sources.graph_versions import read_version
    return read_version(spark, _streamed(spark, sf)).nodes.select(*G.NODE_COLS)


@register("stream_edges")
def q_stream_edges(spark, sf):
    """GRF9 through Structured Streaming: the edges of the last version (equal ``merge_edges``)."""
    from ..sources.graph_versions import read_version
    return read_version(spark, _streamed(spark, sf)).edges.select(*G.EDGE_COLS)


def _replaced(spark, sf):
    """The root of a stored graph of half the files into which all files came in three batches that replace what
    was stored of theirs; two versions are kept."""
    import uuid

    from ..session import scratch_path
    from ..sources.graph_versions import seed_graph
    from ..streaming.incremental import merge_once

    def run():
        root = scratch_path(spark, f"tables/replaced-{uuid.uuid4().hex}")
        files = materialize(FX.f1_source_files(spark, sf, with_key=True), "f1k", key=f"f1k:{sf}")
        seed_graph(build_graph(files.where("p_partkey % 2 = 0").drop("p_partkey"), mode="merged", store=True), root)
        for i in range(3):
            merge_once(files.where(F.col("p_partkey") % 3 == i).drop("p_partkey"), root, f"batch {i}", "merged", True, keep=2)
        return root
    return remembered(spark, f"replaced:{sf}", run)


@register("stored_stats")
def q_stored_stats(spark, sf):
    """AGG1 kept up to date by signed counts per merge."""
    from ..sources.graph_versions import stored_stats
    return stored_stats(spark, _replaced(spark, sf))


@register("stored_hotspots")
def q_stored_hotspots(spark, sf):
    """AGG3 kept up to date by signed counts per merge."""
    from ..sources.graph_versions import stored_hotspots
    return stored_hotspots(spark, _replaced(spark, sf))


@register("stored_edges")
def q_stored_edges(spark, sf):
    """GRF9 with replaced files: every file's edges once, although half the files were analysed twice."""
    from ..sources.graph_versions import read_version
    return read_version(spark, _replaced(spark, sf)).edges.select(*G.EDGE_COLS)


# ---- report (RPT1-RPT6, SNK2, SNK3, JOIN10) ------------------------------------------------

def _report_inputs(spark, sf, graph=True):
    """Inputs of the report; without ``graph`` the graph is planned but not written, for sections that read none of it."""
    from ..operators.tree import readme_pick
    from .report import ReportInputs
    tree = materialize(_tree(spark, sf), "tree", key=f"tree:{sf}")  # several sections read it, some more than once
    rp = _repos(spark, sf)
    readmes = FX.repo_readmes(spark, sf, readme_pick(tree))
    g = _stored(spark, sf) if graph else _graph(spark, sf, "merged")
    return ReportInputs(rp, g, tree, readmes)


@register("report_overview")
def q_report_overview(spark, sf):
    from .report import accepted_inputs, report_overview
    return report_overview(accepted_inputs(_report_inputs(spark, sf, False)))


@register("report_installation")
def q_report_installation(spark, sf):
    from .report import accepted_inputs, report_installation
    return report_installation(accepted_inputs(_report_inputs(spark, sf, False)))


@register("report_usage")
def q_report_usage(spark, sf):
    from .report import accepted_inputs, report_usage
    return report_usage(accepted_inputs(_report_inputs(spark, sf)))


@register("report_architecture")
def q_report_architecture(spark, sf):
    from .report import accepted_inputs, report_architecture
    return report_architecture(accepted_inputs(_report_inputs(spark, sf)))


@register("report_api")
def q_report_api(spark, sf):
    from .report import accepted_inputs, report_api
    return report_api(accepted_inputs(_report_inputs(spark, sf)))


@register("report_structure")
def q_report_structure(spark, sf):
    from .report import accepted_inputs, report_structure
    return report_structure(accepted_inputs(_report_inputs(spark, sf, False)))


@register("write_markdown")
def q_write_markdown(spark, sf):
    """SNK2: write every repository's document and read the written lines back."""
    import uuid

    from ..session import scratch_path
    from .report import report_rows, write_markdown
    out = scratch_path(spark, f"reports-{uuid.uuid4().hex}")
    write_markdown(report_rows(_report_inputs(spark, sf)), out)
    return spark.read.text(out).select("repo_id", F.col("value").alias("text"))


@register("report_join")
def q_report_join(spark, sf):
    from .report import report_join
    i = _report_inputs(spark, sf)
    return report_join(i.repos, i.tree, i.graph, i.readmes)


@register("run_summary")
def q_run_summary(spark, sf):
    """SNK3: the result row of every requested run: error rows for refused URLs, else discovery over the
    accepted repositories' files, final classification and statistics."""
    from ..operators.deps import classify_imports
    from ..operators.tree import entry_point_count
    from .discovery import discover
    from .report import accepted, run_summary
    repos = _repos(spark, sf)
    ids = accepted(repos).select("repo_id")
    only = lambda df: df.join(ids, "repo_id", "left_semi")
    paths = only(_f3(spark, sf))
    d = discover(only(_f1(spark, sf)), paths)
    classes = classify_imports(d.graph.edges, d.graph.nodes, paths, _repo_names(spark, sf))
    return run_summary(repos, d.rounds, d.graph, classes, entry_point_count(_tree(spark, sf)))


@register("scan_directory")
def q_scan_directory(spark, sf):
    """SRC1 raw form: F1 written as checkout folders, read back with the ``srcdir`` source
    (names starting with ``_`` kept, ignored directories pruned, ``.py`` only)."""
    import uuid

    from ..session import scratch_path
    from ..sources.directory import register as register_srcdir
    from ..sources.directory import write_checkout
    root = scratch_path(spark, f"checkout-{uuid.uuid4().hex}")
    write_checkout(_checkout(spark, sf), root)
    register_srcdir(spark)
    d = spark.read.format("srcdir").option("path", root).load()
    return d.select("repo_id", "path", F.length("content").alias("chars"))
