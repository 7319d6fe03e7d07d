"""IMP1-IMP4, JOIN5, JOIN6, AGG5-AGG8: classifying the imports of every repository.

Order of tests per distinct imported module (per repository):
bare-dot import -> skipped; already analysed -> ``analyzed``; import root in the fixed
standard-library list -> ``stdlib``; relative, starts with the repository name, or maps to
an existing file -> ``internal`` (with its potential file); else ``external``.

JOIN5 (``a == base or a.endswith('.' + base)`` over all analysed modules ``a``) is a theta
test; it is rewritten as an equi anti-join: every analysed module is exploded into its
dotted suffixes once, then ``(repo_id, base)`` is looked up by hash. JOIN6 (file exists)
is two left equi-joins with the unpruned file table. All joins are keyed by
``(repo_id, module)`` or ``(repo_id, path)``, never by the repository alone.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import STDLIB_MODULES, SUMMARY_LIST_LEN
from ..functions.paths import (absolute_module, candidate_init, candidate_py, folded_module_name, import_level,
                               import_target_module, module_name_of_file, relative_import_base)


def analyzed_module_names(nodes: DataFrame) -> DataFrame:
    """AGG6: ``(repo_id, module)`` of files with at least one node (COL7 on the path)."""
    return (nodes.where(F.col("file").isNotNull() & (F.col("file") != ""))
            .select("repo_id", "file").distinct()
            .select("repo_id", module_name_of_file("file").alias("module")).distinct())


def imported_modules(edges: DataFrame) -> DataFrame:
    """AGG5: distinct imported modules ``(repo_id, module)``; COL8 + empty dropped."""
    return (edges.where(F.col("type") == "imports")
            .select("repo_id", import_target_module("target").alias("module"))
            .where(F.col("module") != "").distinct())


def module_suffixes(analyzed: DataFrame) -> DataFrame:
    """JOIN5 helper: ``(repo_id, suffix)`` -- the module itself and its text after every ``.``."""
    parts = F.split(F.col("module"), "\\.")
    sfx = F.transform(F.sequence(F.lit(1), F.size(parts)),
                      lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return analyzed.select("repo_id", F.explode(sfx).alias("suffix")).distinct()


def classify_imports(edges: DataFrame, nodes: DataFrame, all_paths: DataFrame,
                     repo_names: DataFrame | None = None) -> DataFrame:
    """IMP1-IMP4 + JOIN5 + JOIN6: ``(repo_id, module, class, potential_file)``.

    ``all_paths(repo_id, path)`` lists every file of the repository, ignored directories
    included (the existence test looks at the whole checkout). ``repo_names(repo_id,
    repo_name)`` gives the names for the prefix test; by default the name is ``repo_id``.
    ``class`` is one of ``skipped`` (bare dots), ``analyzed``, ``stdlib``, ``internal``,
    ``external``.
    """
    mods = imported_modules(edges).withColumn("base", relative_import_base("module"))
    analyzed = analyzed_module_names(nodes)
    sfx = module_suffixes(analyzed)
    hit_base = sfx.select("repo_id", F.col("suffix").alias("base"), F.lit(True).alias("hit_b"))
    hit_mod = analyzed.select("repo_id", F.col("module"), F.lit(True).alias("hit_m"))
    m = (mods.join(hit_base, ["repo_id", "base"], "left")
         .join(hit_mod, ["repo_id", "module"], "left"))
    paths = all_paths.select("repo_id", "path").distinct()
    m = m.withColumn("cand_py", candidate_py("base")).withColumn("cand_init", candidate_init("base"))
    py = paths.select("repo_id", F.col("path").alias("cand_py"), F.lit(True).alias("has_py"))
    ini = paths.select("repo_id", F.col("path").alias("cand_init"), F.lit(True).alias("has_init"))
    m = m.join(py, ["repo_id", "cand_py"], "left").join(ini, ["repo_id", "cand_init"], "left")
    if repo_names is None:
        m = m.withColumn("repo_name", F.col("repo_id"))
    else:
        m = m.join(repo_names, "repo_id", "left")
    has_py = F.coalesce("has_py", F.lit(False))
    has_init = F.coalesce("has_init", F.lit(False))
    root = F.split_part(F.col("module"), F.lit("."), F.lit(1))
    named = F.coalesce(F.col("module").startswith(F.col("repo_name")), F.lit(False))
    internal = F.col("module").startswith(".") | named | has_py | has_init
    cls = (F.when(F.col("base") == "", "skipped")
           .when(F.coalesce("hit_b", F.lit(False)) | F.coalesce("hit_m", F.lit(False)), "analyzed")
           .when(root.isin(*STDLIB_MODULES), "stdlib")
           .when(internal, "internal")
           .otherwise("external"))
    pot = F.when(cls == "internal", F.when(has_py, F.col("cand_py")).when(has_init, F.col("cand_init")))
    return m.select("repo_id", "module", cls.alias("class"), pot.alias("potential_file"))


def importer_modules(edges: DataFrame) -> DataFrame:
    """AGG5 per importing file: distinct ``(repo_id, file, module)``; COL8 + empty dropped."""
    return (edges.where(F.col("type") == "imports")
            .select("repo_id", "file", import_target_module("target").alias("module"))
            .where(F.col("module") != "").distinct())


def resolve_importers(mods: DataFrame, all_paths: DataFrame) -> DataFrame:
    """COL7, COL9 and COL10 by package: ``(repo_id, file, module, level, resolved, path)``.

    Dots are levels up from the importing file (``absolute_module``), ``pkg/__init__.py`` is ``pkg``, and ``path`` is
    the file of the longest prefix of ``resolved`` that a file stands for (``a.b`` of ``a/b.py`` before that of
    ``a/b/__init__.py``), so a name taken from a package leads to the package. It is null where no prefix has one.
    Prefixes are looked up by hash, a module once however many files import it.
    """
    m = mods.select("repo_id", "file", "module", import_level("module").alias("level"),
                    absolute_module("module", "file").alias("resolved"))
    names = (all_paths.where(F.col("path").endswith(".py")).select("repo_id", "path", folded_module_name("path").alias("prefix"))
             .where(F.col("prefix") != ""))
    names = names.groupBy("repo_id", "prefix").agg(F.min_by("path", F.struct(F.col("path").endswith("/__init__.py"), "path")).alias("path"))
    parts = F.split("resolved", "\\.")
    wanted = m.where(F.col("resolved") != "").select("repo_id", "resolved").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("prefix")))
    found = (wanted.select("repo_id", "resolved", F.inline(cut)).join(names, ["repo_id", "prefix"])
             .groupBy("repo_id", "resolved").agg(F.max_by("path", "depth").alias("path")))
    return m.join(found, ["repo_id", "resolved"], "left").select("repo_id", "file", "module", "level", "resolved", "path")


def classify_importers(edges: DataFrame, nodes: DataFrame, all_paths: DataFrame,
                       repo_names: DataFrame | None = None) -> DataFrame:
    """IMP1-IMP4 keyed by importer: ``(repo_id, file, module, resolved, class, potential_file)``.

    As ``classify_imports``, but with modules resolved by ``resolve_importers``. ``analyzed``: the file found has a
    node or, for an import without dots, JOIN5 holds for a folded module name. An import with dots is never
    ``stdlib`` or ``external``; one that leads above the root is ``internal`` without a file, one that names the
    root itself is ``skipped``.
    """
    m = resolve_importers(importer_modules(edges), all_paths)
    files = nodes.where(F.col("file") != "").select("repo_id", F.col("file").alias("path")).distinct()
    sfx = module_suffixes(files.select("repo_id", folded_module_name("path").alias("module")).where(F.col("module") != "").distinct())
    m = (m.join(files.withColumn("hit_file", F.lit(True)), ["repo_id", "path"], "left")
         .join(sfx.select("repo_id", F.col("suffix").alias("resolved"), F.lit(True).alias("hit_name")), ["repo_id", "resolved"], "left"))
    m = m.withColumn("repo_name", F.col("repo_id")) if repo_names is None else m.join(repo_names, "repo_id", "left")
    absolute = F.col("level") == 0
    done = F.coalesce("hit_file", F.lit(False)) | (absolute & F.coalesce("hit_name", F.lit(False)))
    root = F.split_part(F.col("module"), F.lit("."), F.lit(1))
    named = F.coalesce(F.col("module").startswith(F.col("repo_name")), F.lit(False))
    cls = (F.when(F.col("resolved") == "", "skipped").when(done, "analyzed")
           .when(absolute & root.isin(*STDLIB_MODULES), "stdlib")
           .when(~absolute | named | F.col("path").isNotNull(), "internal").otherwise("external"))
    return m.select("repo_id", "file", "module", "resolved", cls.alias("class"), F.when(cls == "internal", F.col("path")).alias("potential_file"))


def potential_files(classes: DataFrame) -> DataFrame:
    """IMP4: distinct files behind unanalysed internal imports ``(repo_id, path)``."""
    return (classes.where(F.col("potential_file").isNotNull())
            .select("repo_id", F.col("potential_file").alias("path")).distinct())


def dependency_lists(classes: DataFrame) -> DataFrame:
    """AGG7: the complete lists as rows ``(repo_id, list, item)``: ``unanalyzed_internal``,
    ``external_dependencies``, ``stdlib_imports`` and ``potential_files_to_analyze``. Nothing is cut."""
    names = F.create_map(*[F.lit(x) for x in ("internal", "unanalyzed_internal", "external", "external_dependencies",
                                              "stdlib", "stdlib_imports")])
    mods = classes.select("repo_id", names[F.col("class")].alias("list"), F.col("module").alias("item")).where(F.col("list").isNotNull())
    files = potential_files(classes).select("repo_id", F.lit("potential_files_to_analyze").alias("list"), F.col("path").alias("item"))
    return mods.unionByName(files)


def first_sorted_lists(classes: DataFrame, names=("external", "stdlib"),
                       n: int = SUMMARY_LIST_LEN) -> DataFrame:
    """SRT4: per repository the first ``n`` sorted modules of the classes that a run result cuts, as ``a|b|c``.

    ``row_number() <= n`` per ``(repo_id, class)`` is planned as a window group limit (also
    applied before the exchange), so at most ``n`` rows per group reach the final step.
    """
    from pyspark.sql import Window
    d = classes.where(F.col("class").isin(*names)).select("repo_id", "class", "module").distinct()
    w = Window.partitionBy("repo_id", "class").orderBy("module")
    d = d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return d.groupBy("repo_id").agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("class") == c, F.col("module")))), "|").alias(f"first_{c}")
        for c in names])


def dependency_report(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG7 + AGG8: one row per repository with the size of every list of ``dependency_lists``."""
    c = F.col("class")
    counts = classes.groupBy("repo_id").agg(
        F.count(F.lit(1)).cast("long").alias("total_imports"),
        F.count_if(c == "internal").cast("long").alias("unanalyzed_internal"),
        F.count_if(c == "external").cast("long").alias("external_dependencies"),
        F.count_if(c == "stdlib").cast("long").alias("stdlib_imports"),
        F.count_distinct("potential_file").cast("long").alias("potential_files_to_analyze"))
    amods = analyzed_module_names(nodes).groupBy("repo_id").agg(F.count(F.lit(1)).cast("long").alias("analyzed_modules"))
    cols = ["total_imports", "analyzed_modules", "unanalyzed_internal", "external_dependencies",
            "stdlib_imports", "potential_files_to_analyze"]
    return counts.join(amods, "repo_id", "full").select(
        "repo_id", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in cols],
        (F.coalesce(F.col("unanalyzed_internal"), F.lit(0)) == 0).alias("discovery_complete"))
