"""SRC7, SRT5, STR4, COL5, COL6, AGG9, AGG10, STR2: repository file trees from a flat table.

A tree has no StructType (recursion), so it is kept flat: ``file_entries(repo_id, path,
type, depth, sort_key)`` with the root ``.`` at depth 0. Directories are found by prefix
expansion of each file path (``transform(sequence(...))`` + ``explode`` + ``distinct``).
An ignored directory and everything below it is left out.

Order (SRT5): at every level directories come before files, then the lower-cased name,
then the name itself. ``sort_key`` encodes that order as one string: per level the type
flag, the lower-cased name, the name, each ended by ``\\x01`` (smaller than any name
character), so plain string order equals the element-wise order and a parent sorts
before its children. Sorting by ``(repo_id, sort_key)`` is a range-partitioned global sort,
which splits a hot repository over many tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ENTRY_POINT_NAMES, IGNORE_DIRS, README_CANDIDATES

SEP = "\x01"


def _level_key(is_file, seg):
    return F.concat(F.when(is_file, F.lit("1")).otherwise(F.lit("0")), F.lower(seg), F.lit(SEP), seg, F.lit(SEP))


def file_tree(files: DataFrame) -> DataFrame:
    """SRC7: ``(repo_id, path, type, depth, sort_key)`` of all files and directories."""
    segs = F.split(F.col("path"), "/")
    d = files.select("repo_id", "path", segs.alias("segs"))
    # keep files that are not below an ignored directory
    d = d.where(~F.arrays_overlap(F.slice("segs", 1, F.greatest(F.size("segs") - 1, F.lit(0))),
                                  F.array(*[F.lit(x) for x in IGNORE_DIRS])))
    lv = F.transform(F.sequence(F.lit(1), F.size("segs")),
                     lambda i: F.struct(i.alias("depth"),
                                        F.array_join(F.slice(F.col("segs"), 1, i), "/").alias("path"),
                                        (i == F.size(F.col("segs"))).alias("is_file")))
    e = d.select("repo_id", F.explode(lv).alias("e")).select(
        "repo_id", F.col("e.path").alias("path"), F.col("e.depth").alias("depth"), F.col("e.is_file").alias("is_file"))
    e = e.distinct()
    segs2 = F.split(F.col("path"), "/")
    key = F.array_join(F.transform(F.sequence(F.lit(1), F.size(segs2)),
                                   lambda i: _level_key((i == F.size(segs2)) & F.col("is_file"),
                                                        F.element_at(segs2, i))), "")
    entries = e.select("repo_id", "path", F.when(F.col("is_file"), "file").otherwise("dir").alias("type"),
                       F.col("depth").cast("int").alias("depth"), key.alias("sort_key"))
    roots = files.select("repo_id").distinct().select(
        "repo_id", F.lit(".").alias("path"), F.lit("dir").alias("type"), F.lit(0).alias("depth"),
        F.lit("").alias("sort_key"))
    return roots.unionByName(entries)


def file_rows(files: DataFrame) -> DataFrame:
    """The file rows of ``file_tree``, made row by row: no directory is expanded, nothing is shuffled."""
    segs = F.split(F.col("path"), "/")
    d = files.select("repo_id", "path", segs.alias("segs"))
    d = d.where(~F.arrays_overlap(F.slice("segs", 1, F.greatest(F.size("segs") - 1, F.lit(0))),
                                  F.array(*[F.lit(x) for x in IGNORE_DIRS])))
    key = F.array_join(F.transform("segs", lambda s, i: _level_key(i + 1 == F.size("segs"), s)), "")
    return d.select("repo_id", "path", F.lit("file").alias("type"), F.size("segs").alias("depth"), key.alias("sort_key"))


def tree_lines(tree: DataFrame) -> DataFrame:
    """STR4: one text line per entry: two spaces per level, ``/`` after directories."""
    return tree.select("repo_id", "sort_key",
                       F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("path"),
                                F.when(F.col("type") == "dir", F.lit("/")).otherwise(F.lit(""))).alias("text"))


def entry_point_files(tree: DataFrame) -> DataFrame:
    """COL5: files named like an entry point, any depth; ``sort_key`` gives tree order. Takes ``file_tree`` or
    ``file_rows``."""
    return (tree.where((F.col("type") == "file") &
                       F.substring_index("path", "/", -1).isin(*ENTRY_POINT_NAMES))
            .select("repo_id", "path", "sort_key"))


def entry_point_count(tree: DataFrame) -> DataFrame:
    """AGG10: number of entry-point files per repository (0 when none)."""
    ep = entry_point_files(tree).groupBy("repo_id").agg(F.count(F.lit(1)).alias("entry_points"))
    repos = tree.select("repo_id").distinct()
    return repos.join(ep, "repo_id", "left").select("repo_id", F.coalesce("entry_points", F.lit(0)).cast("long")
                                                    .alias("entry_points"))


def package_flags(tree: DataFrame) -> DataFrame:
    """AGG9: root-level ``requirements.txt`` / ``setup.py`` / ``pyproject.toml`` present; a tree or just the paths."""
    p = F.col("path")
    return tree.groupBy("repo_id").agg(
        F.bool_or(p == "requirements.txt").alias("has_requirements"),
        F.bool_or(p == "setup.py").alias("has_setup_py"),
        F.bool_or(p == "pyproject.toml").alias("has_pyproject"))


def package_manager(tree: DataFrame) -> DataFrame:
    """COL6: ``requirements`` > ``setup`` > ``pyproject`` > none."""
    f = package_flags(tree)
    pm = (F.when(F.col("has_requirements"), "requirements").when(F.col("has_setup_py"), "setup")
          .when(F.col("has_pyproject"), "pyproject").otherwise("none"))
    return f.select("repo_id", pm.alias("package_manager"))


def readme_pick(tree_or_files: DataFrame) -> DataFrame:
    """STR2: the first existing README at the root, in order of preference ``(repo_id, readme)``."""
    rank = F.array_position(F.array(*[F.lit(x) for x in README_CANDIDATES]), F.col("path"))
    return (tree_or_files.where(F.col("path").isin(*README_CANDIDATES))
            .groupBy("repo_id").agg(F.min_by("path", rank).alias("readme")))
