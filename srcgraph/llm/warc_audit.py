"""WARC (10): Merkle fixity audit of replicas of an archive.

A record table is (archive, pos, record): the records of an archive in order. Leaves hash a record's
bytes; a node of level l + 1 stands for FANOUT consecutive nodes of level l, so for an ordered range of
offsets, and hashes their places, byte lengths and hashes in order. Each level is a FANOUT-th of the one
below, and a group never has more than FANOUT rows. The audit compares the roots of two replicas and goes
down, level by level, only into nodes that differ; byte offsets are summed along that path.

``parse_warc`` turns files (plain or one gzip member a record) into a record table, one file's bytes at a
time; ``warc_records`` builds response records from a page table without Python.
"""
from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcgraph.session import materialize

BITS = 4
FANOUT = 1 << BITS


def warc_records(pages: DataFrame, archive: Column, pos: Column, url: str = "url", html: str = "html",
                 keep: tuple[Column, ...] = ()) -> DataFrame:
    """(archive, pos, record) with a WARC/1.1 response record per row, and ``keep``; null url and html are empty."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(archive.alias("archive"), pos.cast("long").alias("pos"),
                        F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("record"), *keep)


def _gzip_member(raw: bytes, at: int) -> tuple[int, bytes]:
    z, end, parts = zlib.decompressobj(16 + zlib.MAX_WBITS), at, []
    try:
        while not z.eof and end < len(raw):
            parts.append(z.decompress(raw[end:end + 65536]))
            end = min(len(raw), end + 65536) - len(z.unused_data)
    except zlib.error:
        return len(raw), raw[at:]  # damaged: nothing behind can be found again, the rest is one record
    return end, b"".join(parts)


def warc_members(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, bytes of the record) of each record of a file.

    A damaged head or gzip member has no end that can be trusted: the rest of the file is then one record.
    """
    at = 0
    while at < len(raw):
        if raw[at:at + 2] == b"\x1f\x8b":
            end, rec = _gzip_member(raw, at)
        else:
            head = raw.find(b"\r\n\r\n", at)
            m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", raw[at:head + 2]) if head >= 0 else None
            end = min(len(raw), head + 8 + int(m[1])) if m else len(raw)
            rec = raw[at:end]
        yield at, rec
        at = end


def parse_warc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, pos, offset, record) of all WARC files under ``path``; archive is the file's name."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["archive"], b["content"]):
                for i, (at, rec) in enumerate(warc_members(raw)):
                    yield pd.DataFrame({"archive": [name], "pos": [i], "offset": [at], "record": [rec]})

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInPandas(
        parse, "archive string, pos long, offset long, record binary")


def warc_gz(records: list[bytes]) -> bytes:
    """A .warc.gz file's bytes: one gzip member per record."""
    return b"".join(gzip.compress(r, mtime=0) for r in records)


def leaves(records: DataFrame, name: str) -> DataFrame:
    """(archive, pos, len, hash) of the records, written. A null record is the empty one, a null pos is -1.

    Rows that repeat (archive, pos) are one leaf that hashes their number and the sums of their hashes, so
    their order does not matter and a hot position is pre-aggregated.
    """
    r = F.coalesce(F.col("record"), F.lit("").cast("binary"))
    leaf = records.select("archive", F.coalesce("pos", F.lit(-1).cast("long")).alias("pos"),
                          F.octet_length(r).cast("long").alias("len"), F.sha2(r, 256).alias("hash"))
    lanes = [F.conv(F.substring("hash", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)") for i in range(4)]
    leaf = (leaf.groupBy("archive", "pos").agg(
        F.sum("len").alias("len"), F.count(F.lit(1)).alias("n"), F.min("hash").alias("one"),
        *[F.sum(x).alias(f"l{i}") for i, x in enumerate(lanes)])
        .select("archive", "pos", "len", F.when(F.col("n") == 1, F.col("one")).otherwise(
            F.sha2(F.concat_ws("|", "n", "l0", "l1", "l2", "l3").cast("binary"), 256)).alias("hash")))
    return materialize(leaf, f"merkle-{name}-0")


def tree(leaf: DataFrame, name: str, height: int) -> list[DataFrame]:
    """The levels of the Merkle trees of all archives, leaves first: (archive, pos, len, hash), each written."""
    out = [leaf]
    for level in range(1, height + 1):
        kids = F.sort_array(F.collect_list(F.struct("pos", "len", "hash")))  # FANOUT at most
        line = F.transform("kids", lambda y: F.concat_ws(":", y["pos"], y["len"], y["hash"]))
        up = (out[-1].groupBy("archive", F.shiftright("pos", BITS).alias("up"))
              .agg(F.sum("len").alias("len"), kids.alias("kids"))
              .select("archive", F.col("up").alias("pos"), "len",
                      F.sha2(F.array_join(line, "|").cast("binary"), 256).alias("hash")))
        out.append(materialize(up, f"merkle-{name}-{level}"))
    return out


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    y = b.select(F.col("archive").alias("archive_b"), F.col("pos").alias("pos_b"), F.col("len").alias("len_b"),
                 F.col("hash").alias("hash_b"))
    j = a.join(y, F.col("archive").eqNullSafe(F.col("archive_b")) & (F.col("pos") == F.col("pos_b")), "full")
    return j.select(F.when(F.col("pos").isNull(), F.col("archive_b")).otherwise(F.col("archive")).alias("archive"),
                    F.coalesce("pos", "pos_b").alias("pos"), F.col("len").alias("len_a"), F.col("hash").alias("hash_a"),
                    "len_b", "hash_b")


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """The records in which two replicas differ, from trees of equal height.

    archive, pos, offset (in a's archive; where the record would start if a lacks it), len_a, len_b, hash_a,
    hash_b, status: changed, missing (b lacks it) or extra (a lacks it).
    """
    differs = ~F.col("hash_a").eqNullSafe(F.col("hash_b"))
    bad = _pairs(a[-1], b[-1]).withColumn("offset", F.lit(0).cast("long")).where(differs)
    for x, y in zip(a[-2::-1], b[-2::-1]):
        up = materialize(bad.select(F.col("archive").alias("up_archive"), F.col("pos").alias("up"),
                                    F.col("offset").alias("start")), "merkle-differing")
        of = F.col("archive").eqNullSafe(F.col("up_archive")) & (F.shiftright("pos", BITS) == F.col("up"))
        kin = _pairs(x.join(up, of, "left_semi"), y.join(up, of, "left_semi")).withColumn("mine", F.shiftright("pos", BITS))
        elder = Window.partitionBy("archive", "mine").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        kin = kin.withColumn("before", F.coalesce(F.sum("len_a").over(elder), F.lit(0).cast("long"))).where(differs)
        bad = (kin.join(up, F.col("archive").eqNullSafe(F.col("up_archive")) & (F.col("mine") == F.col("up")))
               .withColumn("offset", F.col("start") + F.col("before")))
    return bad.select("archive", "pos", "offset", "len_a", "len_b", "hash_a", "hash_b",
                      F.when(F.col("hash_a").isNull(), "extra").when(F.col("hash_b").isNull(), "missing")
                      .otherwise("changed").alias("status"))


def audit_replicas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Build both replicas' trees and audit them (see ``audit``). Two empty replicas agree; against an empty
    one every record is missing or extra."""
    la, lb = leaves(a, "a"), leaves(b, "b")
    top = max(int(x.agg(F.coalesce(F.max(F.abs("pos")), F.lit(0))).first()[0]) for x in (la, lb))
    height = 1
    while top >> (BITS * height):
        height += 1
    return audit(tree(la, "a", height), tree(lb, "b", height))
