"""SRC6: bytes decoded as UTF-8 with invalid ones dropped, as Python does with errors="ignore"."""
import random

from srcgraph.functions.text import decode_tolerant

PIECES = [b"a", b"\xef\xbf\xbd", b"\xef\xbf", b"\xef", b"\xbd", b"\x1a", b"0", b"1", b"\x1a1", "\u00e9\u20ac\U0001f600".encode(), b"\xff",
          b"\xed\xa0\x80", b"\xc0\xaf", b"\xf0\x9f", b"\n", b"\xc3"]


def test_only_invalid_bytes_go(spark):
    rng = random.Random(5)
    data = [b"", b"plain", b"\xef\xbf\xbd", b"\xff"] + [b"".join(rng.choices(PIECES, k=rng.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)] + [(-1, None)], "i int, b binary")
    got = {r.i: r.t for r in df.select("i", decode_tolerant("b").alias("t")).collect()}
    assert got.pop(-1) is None
    assert got == {i: b.decode("utf-8", errors="ignore") for i, b in enumerate(data)}
