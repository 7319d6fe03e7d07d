"""ITR1-ITR3, JOIN9, SET3: iterative discovery of the files reachable from the entry points.

Per repository: the seed is the set of entry-point files (COL5), or every supported file
when there is none (ITR3). Then up to ``max_rounds`` passes: classify the imports of the
files added last (against the modules analysed so far), take the potential files of the
unanalysed internal imports, drop files already analysed (JOIN9); stop when nothing is new.

Spark form: every candidate file is analysed once (``line`` mode, one scan of ``content``);
the passes then run on the small per-file tables (imports, module names, paths) only, so a
pass never re-reads the source text. The frontier of a pass is classified against all
files reached so far; files reached earlier never gain new targets (their imports can only
move to ``analyzed`` as the set grows), so a frontier-only pass equals the full
reclassification. Each pass is checkpointed into ``spark.checkpoint.dir`` (reliable
storage, survives executor loss) to keep the plan short. Repositories that are done add
no rows, so one loop serves all of them; the loop itself is bounded by ``max_rounds``.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MAX_DISCOVERY_ROUNDS, STDLIB_MODULES
from ..functions.paths import candidate_init, candidate_py, folded_module_name, module_name_of_file, relative_import_base
from ..operators import graph as G
from ..operators.deps import importer_modules, module_suffixes, resolve_importers
from ..operators.tree import entry_point_files, file_rows
from ..session import checkpoint_dir
from ..sources.files import extension_filter, prune_ignored_dirs
from .analyze import build_graph


@dataclass
class Discovery:
    reached: DataFrame      # (repo_id, path, round)
    rounds: DataFrame       # (repo_id, seeded_with_entry_points, discovery_rounds, files_reached)
    graph: G.Graph          # graph of the reached files


def seed_files(files: DataFrame, all_paths: DataFrame) -> DataFrame:
    """ITR3: entry-point files of the tree, or every pruned supported file if there are none.

    ``(repo_id, path, from_entry)``.
    """
    ep = entry_point_files(file_rows(all_paths)).select("repo_id", "path").distinct()
    has_ep = ep.select("repo_id").distinct().withColumn("has_ep", F.lit(True))
    everything = prune_ignored_dirs(extension_filter(files.select("repo_id", "path")))
    fallback = everything.join(has_ep, "repo_id", "left_anti")
    return (ep.withColumn("from_entry", F.lit(True))
            .unionByName(fallback.withColumn("from_entry", F.lit(False))))


def _checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _root_targets(frontier: DataFrame, reached: DataFrame, imports: DataFrame, with_nodes: DataFrame, all_paths: DataFrame) -> DataFrame:
    """Files behind the unanalysed internal imports of the frontier, looked for from the repository's root."""
    # modules analysed so far: files reached that produced at least one node
    analyzed = (reached.join(with_nodes, ["repo_id", "path"], "left_semi")
                .select("repo_id", module_name_of_file("path").alias("module")).distinct())
    sfx = module_suffixes(analyzed).select("repo_id", F.col("suffix").alias("base"))
    mods = (frontier.join(imports, ["repo_id", "path"]).select("repo_id", "module").distinct()
            .withColumn("base", relative_import_base("module"))
            .where(F.col("base") != ""))
    mods = (mods.join(sfx, ["repo_id", "base"], "left_anti")
            .join(analyzed, ["repo_id", "module"], "left_anti")
            .where(~F.split_part("module", F.lit("."), F.lit(1)).isin(*STDLIB_MODULES)))
    py = all_paths.select("repo_id", F.col("path").alias("cand_py"), F.lit(True).alias("has_py"))
    ini = all_paths.select("repo_id", F.col("path").alias("cand_init"), F.lit(True).alias("has_init"))
    mods = (mods.withColumn("cand_py", candidate_py("base")).withColumn("cand_init", candidate_init("base"))
            .join(py, ["repo_id", "cand_py"], "left").join(ini, ["repo_id", "cand_init"], "left"))
    return mods.select("repo_id", F.when(F.col("has_py"), F.col("cand_py")).when(F.col("has_init"), F.col("cand_init")).alias("path"))


def _package_targets(frontier: DataFrame, reached: DataFrame, imports: DataFrame, with_nodes: DataFrame, all_paths: DataFrame) -> DataFrame:
    """Files behind the frontier's imports as resolved by package; those without dots pass JOIN5 and the standard library first."""
    analyzed = (reached.join(with_nodes, ["repo_id", "path"], "left_semi")
                .select("repo_id", folded_module_name("path").alias("module")).where(F.col("module") != "").distinct())
    sfx = module_suffixes(analyzed).select("repo_id", F.col("suffix").alias("resolved"))
    mods = frontier.join(imports, ["repo_id", "path"]).select("repo_id", "module", "level", "resolved", F.col("target").alias("path"))
    plain = (mods.where(F.col("level") == 0).join(sfx, ["repo_id", "resolved"], "left_anti")
             .where(~F.split_part("module", F.lit("."), F.lit(1)).isin(*STDLIB_MODULES)))
    return plain.select("repo_id", "path").unionByName(mods.where(F.col("level") > 0).select("repo_id", "path"))


def discover(files: DataFrame, all_paths: DataFrame | None = None,
             max_rounds: int = MAX_DISCOVERY_ROUNDS, by_package: bool = False) -> Discovery:
    """ITR1: reached files per repository, passes used, and the graph of the reached files.

    ``files(repo_id, path, content)`` are the readable files; ``all_paths(repo_id, path)``
    lists every file of the checkout (defaults to the paths of ``files``). The repository-
    name prefix rule only changes how an import is classified, never which file it names,
    so it plays no part here. A listed file without readable content is reached (and
    counted) but adds no node, as an unreadable file does. With ``by_package`` imports are
    resolved against the importing file's package and to the longest prefix that has a file
    (``deps.resolve_importers``), once, before the passes.
    """
    if all_paths is None:
        all_paths = files.select("repo_id", "path")
    all_paths = all_paths.select("repo_id", "path").distinct()
    g = build_graph(files, mode="line", store=True)
    # per-file tables used by the passes (small: a few rows per file)
    imports = importer_modules(g.edges)
    if by_package:
        imports = resolve_importers(imports, all_paths).where(F.col("path").isNotNull()).withColumnRenamed("path", "target")
    imports = _checkpoint(imports.withColumnRenamed("file", "path"))
    with_nodes = _checkpoint(g.nodes.select("repo_id", F.col("file").alias("path")).distinct())
    seed = seed_files(files, all_paths)
    from_entry = seed.groupBy("repo_id").agg(F.bool_or("from_entry").alias("seeded_with_entry_points"))
    reached = _checkpoint(seed.select("repo_id", "path", F.lit(0).alias("round")))
    frontier = reached
    for rnd in range(1, max_rounds + 1):
        found = (_package_targets if by_package else _root_targets)(frontier, reached, imports, with_nodes, all_paths)
        new = found.where(F.col("path").isNotNull()).distinct().join(reached, ["repo_id", "path"], "left_anti")
        new = _checkpoint(new.withColumn("round", F.lit(rnd)))
        if new.isEmpty():
            break
        reached = _checkpoint(reached.unionByName(new))
        frontier = new
    per_repo = reached.groupBy("repo_id").agg(F.max("round").alias("last"), F.count(F.lit(1)).alias("files_reached"))
    # every repository has a row: one without a seed makes one pass that finds nothing
    rounds = (all_paths.select("repo_id").distinct().join(per_repo, "repo_id", "left").join(from_entry, "repo_id", "left").select(
        "repo_id", F.coalesce("seeded_with_entry_points", F.lit(False)).alias("seeded_with_entry_points"),
        F.least(F.coalesce("last", F.lit(0)) + 1, F.lit(max_rounds)).cast("int").alias("discovery_rounds"),
        F.coalesce("files_reached", F.lit(0)).cast("long").alias("files_reached")))
    rg = G.Graph(g.nodes.join(reached.select("repo_id", F.col("path").alias("file")), ["repo_id", "file"], "left_semi"),
                 g.edges.join(reached.select("repo_id", F.col("path").alias("file")), ["repo_id", "file"], "left_semi"))
    return Discovery(reached, rounds, rg)
