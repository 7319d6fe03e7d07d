"""Fixity audit of replicas."""
import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from srcgraph.llm.queries import op10_warc_audit
from srcgraph.llm.warc_audit import audit_replicas, parse_warc, warc_gz, warc_members, warc_records

SCHEMA = "archive string, pos long, record binary"


def replica(spark, rows):
    return spark.createDataFrame([(a, p, bytearray(r) if r is not None else None) for a, p, r in rows], SCHEMA)


def found(spark, a, b):
    return Counter((r.archive, r.pos, r.offset, r.status) for r in audit_replicas(replica(spark, a), replica(spark, b)).collect())


def test_audit_finds_each_damage(spark):
    a = [("x", i, b"r%d" % i * (i % 7 + 1)) for i in range(700)] + [("y", i, b"z") for i in range(3)]
    at = lambda arch, pos: sum(len(r) for n, p, r in a if n == arch and p < pos)
    assert not found(spark, a, a)
    b = [(n, p, b"damaged" if (n, p) in {("x", 0), ("x", 15), ("x", 256), ("y", 2)} else r) for n, p, r in a if (n, p) != ("x", 699)]
    b += [("x", 5000, b"new"), ("w", 0, b"only here")]
    want = {("x", 0, 0, "changed"), ("x", 15, at("x", 15), "changed"), ("x", 256, at("x", 256), "changed"), ("y", 2, 2, "changed"),
            ("x", 699, at("x", 699), "missing"), ("x", 5000, at("x", 5000), "extra"), ("w", 0, 0, "extra")}
    assert found(spark, a, b) == Counter(want)


def test_audit_awkward(spark):
    a = [("x", 0, None), ("x", 1, b""), (None, 0, b"n"), ("x", None, b"q"), ("r", 1, b"1"), ("r", 1, b"2"), ("r", 1, b"3")]
    assert not found(spark, a, a[::-1])
    assert not found(spark, a, [("x", 0, b"") if r == ("x", 0, None) else r for r in a])
    b = [r if r != ("r", 1, b"2") else ("r", 1, b"4") for r in a if r[0] is not None]
    assert {(k[0], k[1], k[3]) for k in found(spark, a, b)} == {("r", 1, "changed"), (None, 0, "missing")}
    assert not found(spark, [], [])
    assert {k[3] for k in found(spark, a, [])} == {"missing"} and {k[3] for k in found(spark, [], a)} == {"extra"}


def test_records_of_pages(spark):
    pages = spark.createDataFrame([("u", "hé"), (None, None)], "url string, html string").withColumn("record", F.lit("own"))
    got = warc_records(pages, F.lit("a"), F.monotonically_increasing_id()).collect()
    assert sorted(bytes(r.record) for r in got)[1].endswith(b"URI: u\r\nContent-Length: 3\r\n\r\nh\xc3\xa9\r\n\r\n")


@pytest.mark.parametrize("packed", [False, True])
def test_files(spark, tmp_path, packed):
    recs = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n + b"\r\n\r\n" for n in (0, 5, 70_000, 200_000)]
    raw = warc_gz(recs) if packed else b"".join(recs)
    (tmp_path / "f.warc").write_bytes(raw)
    (tmp_path / "empty.warc").write_bytes(b"")
    got = parse_warc(spark, str(tmp_path)).orderBy("pos").collect()
    assert [bytes(r.record) for r in got] == recs and {r.archive for r in got} == {"f.warc"}
    cuts = [0]
    for r in recs[:-1]:
        cuts.append(cuts[-1] + len(gzip.compress(r, mtime=0) if packed else r))
    assert [r.offset for r in got] == cuts
    hurt = raw[:cuts[2] + 12] + b"????" + raw[cuts[2] + 16:]  # a damaged head ends what can be told apart
    assert [r for _, r in warc_members(hurt)][:2] == recs[:2]


def test_query_damages_records_of_long_urls(spark, tmp_path):
    urls = ["u" * 5000 + str(i) for i in range(40)] + [f"short{i}" for i in range(40)] + [None]
    want = sum(hashlib.md5((u or "").encode()).hexdigest().startswith("0") for u in urls)
    assert any(hashlib.md5(u.encode()).hexdigest().startswith("0") for u in urls[:40])
    spark.createDataFrame([(u, "body") for u in urls], "url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = op10_warc_audit(spark, str(tmp_path)).collect()
    assert len(got) == want and {r.status for r in got} == {"changed"}
