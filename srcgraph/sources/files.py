"""SRC1-SRC6: tables of source files ``(repo_id, path, content)``.

The main input form is a parquet table (or any DataFrame) with one row per file; ``path``
is relative to the repository root, ``/``-separated. Directory pruning and the suffix test
only read ``repo_id``/``path``, so when they run first Catalyst keeps ``content`` out of
every plan that needs paths only, and parquet pushes the ``endswith`` part down.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import has_supported_ext, in_ignored_dir
from ..functions.text import decode_tolerant

SOURCE_FILE_SCHEMA = "repo_id string, path string, content string"


def read_source_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC1 (table form): read ``(repo_id, path, content)`` from parquet with a fixed schema."""
    return spark.read.schema(SOURCE_FILE_SCHEMA).parquet(path)


def prune_ignored_dirs(files: DataFrame) -> DataFrame:
    """SRC2: drop files below a directory named like an ignored directory."""
    return files.where(~in_ignored_dir("path"))


def extension_filter(files: DataFrame) -> DataFrame:
    """SRC5: keep files whose suffix is supported (``.py``); ``endswith`` reaches the scan."""
    return files.where(F.col("path").endswith(".py") & has_supported_ext("path"))


def supported_files(files: DataFrame) -> DataFrame:
    return extension_filter(files)


def scan_source_files(files: DataFrame, prune: bool = True) -> DataFrame:
    """SRC1: all supported files of every repository, with directory pruning."""
    out = extension_filter(files)
    return prune_ignored_dirs(out) if prune else out


def scan_unpruned(files: DataFrame) -> DataFrame:
    """SRC3: the same scan without directory pruning."""
    return scan_source_files(files, prune=False)


def scan_file_list(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """SRC4: only the listed ``(repo_id, path)``; other suffixes skipped (semi-join, no duplicates)."""
    return extension_filter(files).join(wanted.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
