"""RPT1-RPT7, SNK2, SNK3, JOIN10: the per-repository report as rows of text.

Every section is a DataFrame of ``(repo_id, section, sub, key, text)``; the document of a
repository is its rows in ``(section, sub, key)`` order. Nothing is concatenated per
repository: ``write_markdown`` sorts all rows globally (range partitioning spreads a big
repository over many tasks) and writes them with ``partitionBy("repo_id")``, so each
repository gets a folder whose part files, read in name order, are its document.
Diagrams are tables (RPT7); the report names them instead of embedding pictures.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.constants import API_CLASSES_PER_FILE, API_FILES, TOP_K
from ..functions.paths import repo_name_from_url
from ..functions.text import display_name, file_label, summarize_text
from ..operators import stats as S
from ..operators.diagrams import diagram_tables, usage_entry_modules
from ..operators.graph import Graph
from ..operators.tree import package_manager, tree_lines
from ..session import materialize

ROW_COLS = ["repo_id", "section", "sub", "key", "text"]


@dataclass
class ReportInputs:
    repos: DataFrame        # (repo_id, repo_url)
    graph: Graph
    tree: DataFrame         # file_tree output
    readmes: DataFrame      # (repo_id, text) of the picked README; missing -> no README


def accepted(repos: DataFrame) -> DataFrame:
    """``(repo_id, repo_url)`` of the repositories whose URL passes the check, with the normalised URL."""
    from ..functions.urls import validate_repo_url
    v = repos.select("repo_id", validate_repo_url("repo_url").alias("v"))
    return v.where("v.valid").select("repo_id", F.col("v.normalized_url").alias("repo_url"))


def accepted_inputs(inp: ReportInputs) -> ReportInputs:
    """What the sections are made from: a refused URL ends a run before anything is written for it."""
    repos = accepted(inp.repos)
    ids = repos.select("repo_id")
    only = lambda df: df.join(ids, "repo_id", "left_semi")
    return ReportInputs(repos, Graph(only(inp.graph.nodes), only(inp.graph.edges)), only(inp.tree), inp.readmes)


def _rows(df: DataFrame, section: int, sub, key, text) -> DataFrame:
    c = lambda x: F.lit(x) if isinstance(x, (int, str)) else x
    return df.select("repo_id", F.lit(section).alias("section"), c(sub).cast("int").alias("sub"),
                     c(key).cast("string").alias("key"), c(text).cast("string").alias("text"))


def _fixed(repos: DataFrame, section: int, lines: list[str], start: int = 0) -> DataFrame:
    """The same lines for every repository."""
    arr = F.array(*[F.struct(F.lit(i + start).alias("sub"), F.lit(t).alias("text")) for i, t in enumerate(lines)])
    x = repos.select("repo_id", F.explode(arr).alias("l"))
    return x.select("repo_id", F.lit(section).alias("section"), F.col("l.sub").cast("int").alias("sub"),
                    F.lit("").alias("key"), F.col("l.text").alias("text"))


def _head(on, lines: list[str], start: int) -> list[tuple]:
    """Fixed lines of a row where ``on`` holds, for ``_lines``."""
    return [(on, start + i, "", t) for i, t in enumerate(lines)]


def _lines(df: DataFrame, section: int, items: list[tuple]) -> DataFrame:
    """Report rows from one pass over a small table: every row gives the items ``(on, sub, key, text)`` whose ``on``
    holds, so headings and closing lines come with the first row instead of from the table again."""
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    arr = F.array(*[F.struct(c(on).alias("on"), c(sub).cast("int").alias("sub"), c(key).alias("key"), c(text).alias("text"))
                    for on, sub, key, text in items])
    x = df.select("repo_id", F.explode(F.filter(arr, lambda i: i["on"])).alias("l"))
    return x.select("repo_id", F.lit(section).alias("section"), "l.sub", "l.key", "l.text")


def report_overview(inp: ReportInputs) -> DataFrame:
    """RPT1: title, source line, README summary (STR1)."""
    r = inp.repos.join(inp.readmes, "repo_id", "left")
    name = repo_name_from_url("repo_url")
    url = F.col("repo_url")
    head = F.array(
        F.concat(F.lit("# "), name, F.lit(C.REPORT_TITLE_TAIL)),
        F.concat(F.lit(C.REPORT_SOURCE_HEAD), url, F.lit("]("), url, F.lit(")*\n")),
        F.lit(C.REPORT_RULE), F.lit(C.REPORT_OVERVIEW),
        F.concat(summarize_text("text"), F.lit("\n")))
    x = r.select("repo_id", F.posexplode(head).alias("sub", "text"))
    return x.select("repo_id", F.lit(1).alias("section"), F.col("sub").cast("int"), F.lit("").alias("key"), "text")


def report_installation(inp: ReportInputs) -> DataFrame:
    """RPT2: clone lines, then install commands by COL6."""
    pm = package_manager(inp.tree)
    r = inp.repos.join(pm, "repo_id", "left")
    url = F.col("repo_url")
    clone = F.array(*[F.lit(x) for x in C.REPORT_INSTALLATION],
                    F.concat(F.lit("git clone "), url),
                    F.concat(F.lit("cd "), F.replace(F.substring_index(url, "/", -1), F.lit(".git"), F.lit(""))),
                    F.lit("```\n"))
    p = F.col("package_manager")
    texts = {k: F.array(*[F.lit(x) for x in v]) for k, v in C.REPORT_INSTALL.items()}
    install = (F.when(p == "requirements", texts["requirements"]).when(p == "setup", texts["setup"])
        .when(p == "pyproject", texts["pyproject"])
        .otherwise(F.array().cast("array<string>")))
    x = r.select("repo_id", F.posexplode(F.concat(clone, install)).alias("sub", "text"))
    return x.select("repo_id", F.lit(2).alias("section"), F.col("sub").cast("int"), F.lit("").alias("key"), "text")


def report_usage(inp: ReportInputs) -> DataFrame:
    """RPT3: first three entry modules (COL16) or the fallback sentence."""
    x = inp.repos.select("repo_id").join(usage_entry_modules(inp.graph.nodes), "repo_id", "left")
    first, none = F.col("rank") == 1, F.col("rank").isNull()
    return _lines(x, 3, _head(first, C.REPORT_USAGE, -1) + _head(none, C.REPORT_NO_USAGE, 0) + [
        (~none, F.col("rank") + 1, "", F.concat(F.lit("- `"), F.col("file_label"), F.lit("`: "), F.col("name"))),
        (first, 100, "", "")])


def report_architecture(inp: ReportInputs) -> DataFrame:
    """RPT4: six counts (AGG2) and the first ten base classes (AGG4, sorted)."""
    st = S.doc_stats(inp.graph.nodes, inp.graph.edges)
    st = inp.repos.join(st, "repo_id", "left").na.fill(0)
    items = zip(C.REPORT_COUNTS, ["total_nodes", "classes", "functions", "modules", "call_edges", "inherit_edges"])
    arr = F.array(F.lit(C.REPORT_ARCHITECTURE),
                  *[F.concat(F.lit(f"- **{t}**: "), F.col(c).cast("string")) for t, c in items], F.lit(""))
    counts = st.select("repo_id", F.posexplode(arr).alias("sub", "text")).select(
        "repo_id", F.lit(4).alias("section"), F.col("sub").cast("int"), F.lit("").alias("key"), "text")
    bases = S.first_n(S.base_classes(inp.graph.edges), TOP_K, ["repo_id"], ["base"])
    first = F.col("rank") == 1
    return counts.unionByName(_lines(bases, 4, _head(first, C.REPORT_BASES, 10) + [
        (F.lit(True), 20, F.format_string("%05d", "rank"), F.concat(F.lit("- `"), display_name("base"), F.lit("`"))),
        (first, 30, "", "")]))


def report_diagrams(inp: ReportInputs) -> DataFrame:
    """RPT7 in the text: one sub-section per non-empty diagram table."""
    dn, de = diagram_tables(inp.graph.nodes, inp.graph.edges)
    n = dn.groupBy("repo_id", "diagram").agg(F.count(F.lit(1)).alias("nodes"))
    e = de.groupBy("repo_id", "diagram").agg(F.count(F.lit(1)).alias("edges"))
    d = n.join(e, ["repo_id", "diagram"], "left").na.fill(0, ["edges"])
    order = F.when(F.col("diagram") == "class_hierarchy", 1).when(F.col("diagram") == "call_graph", 2).otherwise(3)
    title = (F.when(F.col("diagram") == "class_hierarchy", "Class Hierarchy")
             .when(F.col("diagram") == "call_graph", "Call Graph").otherwise("Full Code Context Graph"))
    body = F.concat(F.lit("#### "), title, F.lit("\n\nDiagram table `"), F.col("diagram"), F.lit("`: "),
                    F.col("nodes").cast("string"), F.lit(" nodes, "), F.col("edges").cast("string"), F.lit(" edges.\n"))
    head = _fixed(inp.repos, 5, [C.REPORT_DIAGRAMS])
    return head.unionByName(_rows(d, 5, order, "", body))


def report_api(inp: ReportInputs) -> DataFrame:
    """RPT5: classes by file (WIN3), high-complexity functions (WIN1), hot spots (WIN2)."""
    nodes, edges = inp.graph.nodes, inp.graph.edges
    head = _fixed(inp.repos, 6, [C.REPORT_API])
    every, first = F.lit(True), F.col("rank") == 1
    top = F.col("class_rank") == 1
    classes = _lines(S.classes_per_file(nodes, API_FILES, API_CLASSES_PER_FILE), 6,
                     _head(top & (F.col("file_rank") == 1), [C.REPORT_CLASSES], 1) + [
        (top, 2, F.format_string("%05d.0", "file_rank"), F.concat(F.lit("#### "), file_label("file"), F.lit("\n"))),
        (every, 2, F.format_string("%05d.%d", "file_rank", "class_rank"), F.concat(F.lit("- **`"), F.col("name"), F.lit("`**"))),
        (top, 2, F.format_string("%05d.9", "file_rank"), "")])
    complex_ = _lines(S.high_complexity(nodes), 6, _head(first, C.REPORT_COMPLEX, 3) + [
        (every, 5, F.format_string("%05d", "rank"), F.concat(F.lit("- `"), F.col("name"), F.lit("` in `"), file_label("file"),
                                                             F.lit("` (complexity: "), F.col("complexity").cast("string"), F.lit(")"))),
        (first, 6, "", "")])
    spots = _lines(S.call_hotspots(edges), 6, _head(first, C.REPORT_HOTSPOTS, 7) + [
        (every, 9, F.format_string("%05d", "rank"), F.concat(F.lit("- `"), F.col("func_name"), F.lit("` (called "),
                                                             F.col("calls").cast("string"), F.lit(" times)"))),
        (first, 10, "", "")])
    return head.unionByName(classes).unionByName(complex_).unionByName(spots)


def report_structure(inp: ReportInputs) -> DataFrame:
    """RPT6: the file tree block (STR4 in SRT5 order)."""
    head = _fixed(inp.repos, 7, [C.REPORT_STRUCTURE, "```"])
    lines = _rows(tree_lines(inp.tree), 7, 2, F.col("sort_key"), F.col("text"))
    no_tree = inp.repos.join(inp.tree.select("repo_id").distinct(), "repo_id", "left_anti")
    empty = _rows(no_tree, 7, 2, "", "<empty>")
    tail = _rows(inp.repos, 7, 3, "", "```\n")
    foot = _fixed(inp.repos, 8, [C.REPORT_RULE, "*Generated with srcgraph.*"])
    return head.unionByName(lines).unionByName(empty).unionByName(tail).unionByName(foot)


def report_rows(inp: ReportInputs) -> DataFrame:
    """All sections of all repositories whose URL is accepted. The file tree, which two sections read, is written once."""
    inp = accepted_inputs(inp)
    inp = replace(inp, tree=materialize(inp.tree, "report_tree"))
    parts = [report_overview(inp), report_installation(inp), report_usage(inp), report_architecture(inp),
             report_diagrams(inp), report_api(inp), report_structure(inp)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*ROW_COLS))
    return out


def write_markdown(rows: DataFrame, out_dir: str) -> None:
    """SNK2: one folder per repository under ``out_dir`` holding its document in order."""
    (rows.orderBy("repo_id", "section", "sub", "key")
     .select("repo_id", "text")
     .write.mode("overwrite").partitionBy("repo_id").text(out_dir))


def run_summary(repos: DataFrame, rounds: DataFrame, graph: Graph, classes: DataFrame, entry_counts: DataFrame,
                summaries: DataFrame | None = None) -> DataFrame:
    """SNK3: one result row per repository of ``repos(repo_id, repo_url)``, whatever became of its run.

    ``status`` is ``ok`` or ``error``; ``error_code`` is ``invalid_url`` (with the check's message) or
    ``repo_map_failed`` (an accepted URL without any file, so without a row in ``rounds``). The other columns
    of an error row are null. External and standard-library modules are cut to twenty; the complete lists are
    the rows of ``deps.dependency_lists``.
    """
    from ..functions.urls import validate_repo_url
    from ..operators.deps import dependency_report, first_sorted_lists
    v = repos.select("repo_id", validate_repo_url("repo_url").alias("v"))
    st = S.graph_stats(graph.nodes, graph.edges)
    r = (v.join(rounds.select("repo_id", "discovery_rounds"), "repo_id", "left").join(entry_counts, "repo_id", "left")
         .join(st, "repo_id", "left").join(dependency_report(classes, graph.nodes), "repo_id", "left")
         .join(first_sorted_lists(classes), "repo_id", "left"))
    if summaries is not None:
        r = r.join(summaries, "repo_id", "left")
    valid, mapped = F.col("v.valid"), F.col("discovery_rounds").isNotNull()
    ok = valid & mapped
    n = lambda c: F.when(ok, F.coalesce(c, F.lit(0)).cast("long"))
    cols = [F.when(ok, "ok").otherwise("error").alias("status"),
            F.when(~valid, "invalid_url").when(~mapped, "repo_map_failed").alias("error_code"),
            F.when(~valid, F.col("v.error")).when(~mapped, "no files").alias("message"),
            n("total_symbols").alias("symbol_count"), *[n(c).alias(c) for c in S.STAT_COLS],
            n("total_imports").alias("total_imports"), n("external_dependencies").alias("external_count"),
            F.when(ok, F.coalesce("first_external", F.lit(""))).alias("external_dependencies"),
            F.when(ok, F.coalesce("first_stdlib", F.lit(""))).alias("stdlib_imports"),
            n("unanalyzed_internal").alias("unanalyzed_internal_count"),
            F.when(ok, F.coalesce("discovery_complete", F.lit(True))).alias("discovery_complete"),
            F.when(ok, F.col("discovery_rounds")).alias("discovery_iterations"),
            n("entry_points").alias("priority_files_count")]
    if summaries is not None:
        cols.append(F.when(ok, F.col("readme_summary")).alias("readme_summary"))
    return r.select("repo_id", *cols)


def report_join(repos: DataFrame, tree: DataFrame, graph: Graph, readmes: DataFrame) -> DataFrame:
    """JOIN10: per repository the map (URL check, README summary, package manager, entry
    points) joined with the statistics. A repository whose URL fails the check is a failed
    map: its fields are empty and ``error`` is ``repo_map_failed: <reason>``."""
    from ..functions.urls import validate_repo_url
    from ..operators.tree import entry_point_count
    v = repos.select("repo_id", "repo_url", validate_repo_url("repo_url").alias("v"))
    ok = F.col("v.valid")
    st = S.graph_stats(graph.nodes, graph.edges).select("repo_id", "total_symbols")
    j = (v.join(readmes, "repo_id", "left").join(package_manager(tree), "repo_id", "left")
         .join(entry_point_count(tree), "repo_id", "left").join(st, "repo_id", "left"))
    return j.select(
        "repo_id",
        F.when(ok, F.col("v.normalized_url")).alias("normalized_url"),
        F.when(ok, summarize_text("text")).otherwise(F.lit("")).alias("readme_summary"),
        F.when(ok, F.col("package_manager")).alias("package_manager"),
        F.when(ok, F.coalesce("entry_points", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("priority_files"),
        F.when(ok, F.coalesce("total_symbols", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("symbol_count"),
        F.when(~ok, F.concat(F.lit("repo_map_failed: "), F.col("v.error"))).alias("error"))
