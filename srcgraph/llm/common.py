"""Helpers shared by the training-data operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of all contracts, [\x20\x09-\x0D], as characters and as a class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[ \\t-\\r]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def text_of(name: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` does that on pure ASCII and is much faster than ``translate``.
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Array of the maximal runs of characters outside SPACES."""
    s = strip(c)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, f"{SPACE_CLASS}+", -1))


def line_key(line: Column) -> Column:
    """A line's key: stripped at both ends, A-Z lower-cased."""
    return ascii_lower(strip(line))


def hash_pair(c: Column) -> tuple[Column, Column]:
    """128 bits in two longs: the second hash starts from another seed."""
    return F.xxhash64(c), F.xxhash64(F.lit(40503), c)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def rows(docs: DataFrame) -> DataFrame:
    """Every column under a name of its own (``of``), so that no input column clashes with an operator's, and columns
    that a query does not read are pruned before any shuffle."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])


def of(columns: list[str], name: str) -> Column:
    """A column of ``rows``, by its name in the input."""
    return F.col(f"_c{[c.lower() for c in columns].index(name.lower())}")


def unrow(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The input's columns again; those in ``new`` replace input columns of the same name or follow."""
    lower = {k.lower() for k in new}
    return df.select(*[of(columns, c).alias(c) for c in columns if c.lower() not in lower],
                     *[v.alias(k) for k, v in new.items()])
