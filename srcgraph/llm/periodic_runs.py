"""Periodic runs (13): stretches of words that repeat with a period, found in tiles per octave of periods.

A run is a stretch of words with smallest period q, no neighbouring word of which keeps the period, of length
max(MIN_LENGTH, POWER * q) or more. Words are maximal runs of bytes outside white space, numbered within their text, so
equal numbers are equal words.

Octave P holds the periods P to 2P - 1. Its block is B = max(P, 8) words, its grid every B-th word of a tile. A run of the octave
has a grid word x whose block comes again q words on (its length is at least 2B + q). Blocks are compared by
hashes that double in length from octave to octave, all of a tile at once; where one comes again, the boundary
Z-functions of x (of the words from x on, and of the words before x backwards) give for every period of the octave how
far it holds to both sides. A period with a divisor that holds as far is not the smallest and is left out.

Texts of up to ``tile`` words are one tile for all octaves and are finished where they stand. Longer ones are
exploded into tiles that overlap by 4B: tiles of ``tile`` words carry the octaves up to tile / 16, every octave above has
tiles of its own of 16P words. Tiles are dealt to tasks by text, octave and number and solved alone; a
tile cuts a run into fragments. Fragments are shuffled by text and period and stitched where they overlap by a period or
more: two maximal stretches of one period overlap by less. As the overlap of tiles is 4B, a run's fragments overlap by more, and
a piece too short to be found lies wholly in the neighbour.

Cost: a pass over a tile per octave, n log n in all; Z-functions only where a block comes again. Texts up to ``tile`` words are not
shuffled; of longer ones word numbers are, and the text once to be collapsed. Null, empty and blank texts have no
word and no run; repeated rows are rows (tiles of equal texts are solved once); an empty table gives an empty
result; the columns in ``keep`` are passed on unread, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from srcgraph.session import materialize

from .common import text_of, words

MIN_LENGTH, POWER = 24, 3
LEAST_BLOCK = 8
TILE = 1 << 14
RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))


def word_numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def z_function(a: list[int]) -> list[int]:
    """For each place, how many values from it on equal those from the beginning on."""
    n = len(a)
    z, l, r = [n] * n, 0, 0
    for i in range(1, n):
        k = min(z[i - l], r - i) if i < r else 0
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        if i + k > r:
            l, r = i, i + k
    return z


def _further(w: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on (step 1), or before them (step -1), are equal in pairs; a < b."""
    n, size = 0, 64
    while True:
        k = min(size, len(w) - b - n if step > 0 else a - n)
        if k <= 0:
            return n
        x, y = (w[a + n:a + n + k], w[b + n:b + n + k]) if step > 0 else (w[a - n - k:a - n][::-1], w[b - n - k:b - n][::-1])
        off = np.flatnonzero(x != y)
        if len(off):
            return n + int(off[0])
        n, size = n + k, size * 2


def stretches_at(w: np.ndarray, x: int, octave: int) -> list[tuple[int, int, int, bool]]:
    """(period, begin, end, whether it is the smallest) of the longest stretches around word x with a period of the octave that holds for a
    block from x on, by the two Z-functions at x. Where the period is not the smallest, begin and end are within the block's surroundings."""
    block = max(octave, LEAST_BLOCK)
    on = z_function(w[x:x + 4 * block].tolist())
    periods = [q for q in range(octave, min(2 * octave, len(on))) if on[q] >= block]
    if not periods:
        return []
    back, ahead = min(x, 2 * block), min(2 * octave, len(w) - x)
    # the words before x backwards, a word that no text has, and the words before x + ahead backwards
    z = z_function(w[x - back:x][::-1].tolist() + [-1] + w[x - back:x + ahead][::-1].tolist())
    found = []
    for q in periods:
        end = x + q + on[q]
        if any(on[d] + d >= q + on[q] for d in _divisors(q)):
            found.append((q, x, end, False))
            continue
        if end == x + len(on):
            end += _further(w, end - q, end, 1)
        k = z[back + 1 + ahead - q] if q < ahead else 0
        if k == back:
            k += _further(w, x - back, x - back + q, -1)
        found.append((q, x - k, end, True))
    return found


def _divisors(q: int) -> list[int]:
    """The divisors of q that are q over a prime; a period that is a multiple of a shorter one is a multiple of one of these or equals it."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return out + ([q // rest] if rest > 1 else [])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _doubled(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of blocks of twice the length; ``by`` is the length so far."""
    return _mix(h[:-by] * np.uint64(0x9E3779B97F4A7C15) + h[by:]) if len(h) > by else h[:0]


def solve(w: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """(period, begin, end) of the stretches in a tile with a smallest period in the octaves ``low`` to ``high``.

    Every maximal stretch of at least 2B + q words is among them."""
    found: list[tuple[int, int, int]] = []
    h, block = _mix(w.astype(np.uint64) + np.uint64(1)), 1
    while block < max(low, LEAST_BLOCK) and len(h):
        h, block = _doubled(h, block), block * 2
    octave = low
    while octave <= high:
        need = max(octave, LEAST_BLOCK)
        if need > block:
            h, block = _doubled(h, block), block * 2
        if len(h) <= octave:
            break
        x = np.arange(0, len(h) - octave, block)  # grid words with a place for the shortest period
        again = np.zeros(len(x), bool)
        if octave >= block:  # the periods of a grid word are the words of the next block
            ext = np.concatenate([h[octave:], np.zeros(-(len(h) - octave) % block, np.uint64)]).reshape(-1, block)
            again = (ext[:len(x)] == h[x][:, None]).any(axis=1)
        else:
            for q in range(octave, 2 * octave):
                some = x[x + q < len(h)]
                again[:len(some)] |= h[some] == h[some + q]
        done: dict[int, int] = {}  # per period, how far it is known to hold
        for i in x[again].tolist():
            hits = octave + np.flatnonzero(h[i + octave:i + 2 * octave] == h[i])
            if all(done.get(q, -1) >= i + q + block for q in hits.tolist()):
                continue
            for q, begin, end, smallest in stretches_at(w, i, octave):
                if smallest and done.get(q, -1) < end:
                    found.append((q, begin, end))
                done[q] = max(done.get(q, -1), end)
        octave *= 2
    return sorted(found)


def runs_of(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs among whole stretches, in order."""
    return sorted((a, b - a, q) for q, a, b in fragments if b - a >= max(MIN_LENGTH, POWER * q))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0))


def _tiles(n: int, tile: int) -> Iterator[tuple[int, int, int, int]]:
    """(lowest octave, highest octave, begin, end) of the tiles of a text of n words; every run fits its overlaps."""
    low, high = 1, max(LEAST_BLOCK, tile // 16)
    while low * POWER <= n:
        size, lap = max(tile, 16 * high), 4 * max(high, LEAST_BLOCK)
        for begin in range(0, n, size - lap):
            yield low, high, begin, min(n, begin + size)
            if begin + size >= n:
                break
        low, high = high * 2, high * 2


def _result(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "length": b, "period": q} for a, b, q in r] for r in runs],
                    pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))


def periodic_runs(docs: DataFrame, keep: list[Column], text: str = "text", tile: int = TILE) -> DataFrame:
    """``keep`` with n_words, runs (start, length and period of each, by start, then period) and collapsed, the words that are left joined
    by single spaces, for the whole text of every row."""
    if tile < 16 * LEAST_BLOCK or tile & (tile - 1):
        raise ValueError(f"a tile is a power of two of at least {16 * LEAST_BLOCK} words")
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_run_text"))
    own = [f.name for f in src.schema.fields[:-1]]
    names = [f"_k{i}" for i in range(len(own))]
    src = src.toDF(*names, "_run_text")
    fields = src.schema.fields[:-1]
    out = StructType([*fields, StructField("_n", LongType()), StructField("_runs", RUNS), StructField("_left", StringType())])
    bytes_of_tile = 2 * tile  # a text of as many bytes has at most ``tile`` words

    def rows_of(b: pa.RecordBatch, n_own: int, solve_one) -> pa.RecordBatch:
        n, runs, left = [], [], []
        for i in range(b.num_rows):
            words = b.column(n_own)[i].as_py().encode().split()
            r = solve_one(b, i, words)
            n.append(len(words))
            runs.append(r)
            left.append(collapse(words, r).decode())
        return pa.RecordBatch.from_arrays([*b.columns[:len(fields)], pa.array(n, pa.int64()), _result(runs), pa.array(left, pa.string())],
                                          names=out.names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b, i, words):
            return runs_of(solve(word_numbers(words), 1, len(words) // POWER)) if len(words) >= MIN_LENGTH else []

        for b in batches:
            for at in range(0, b.num_rows, 256):
                yield rows_of(b.slice(at, 256), len(fields), one)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w = word_numbers(b.column(1)[i].as_py().encode().split())
                for low, high, begin, end in _tiles(len(w), tile):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1), *[pa.array([v], pa.int64()) for v in (low, high, begin)],
                         pa.array([w[begin:end].astype("<i4").tobytes()], pa.binary())], ["key", "low", "high", "begin", "w"])

    def solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                low, high, begin = (b.column(c)[i].as_py() for c in (1, 2, 3))
                got = solve(np.frombuffer(b.column(4)[i].as_py(), "<i4").astype(np.int64), low, high)
                cols = [np.array([f[c] for f in got], np.int64) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(got), pa.string()), pa.array(cols[0]),
                                                  pa.array(cols[1] + begin), pa.array(cols[2] + begin)], ["key", "period", "a", "b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b, i, words):
            return [(r["start"], r["length"], r["period"]) for r in b.column(len(fields) + 1)[i].as_py() or []]

        for b in batches:
            for at in range(b.num_rows):
                yield rows_of(b.slice(at, 1), len(fields), one)

    small = src.where(F.octet_length("_run_text") <= bytes_of_tile).mapInArrow(whole, out)
    huge = src.where(F.octet_length("_run_text") > bytes_of_tile).withColumn("_key", F.sha2("_run_text", 256))
    tiles = huge.select(F.col("_key").alias("key"), F.col("_run_text").alias("t")).mapInArrow(
        explode, "key string, low long, high long, begin long, w binary").dropDuplicates(["key", "low", "begin"])
    found = materialize(tiles.mapInArrow(solve_tiles, "key string, period long, a long, b long"), "run-fragments")
    runs = stitch(found).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("found"))
    huge = huge.join(runs, F.col("_key") == F.col("key"), "left").select(*names, "_run_text", "found").mapInArrow(joined, out)
    return small.unionByName(huge).toDF(*own, "n_words", "runs", "collapsed")


def stitch(fragments: DataFrame) -> DataFrame:
    """fragments: (key, period, a, b). (key, start, length, period) of the runs that they make up: fragments of a key and period
    that overlap by the period or more are one stretch. A group is one period's fragments of one text, which are as many as its tiles at most
    times its stretches in a tile."""
    w = Window.partitionBy("key", "period").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("a") + F.col("period") > reach)).cast("long")
    marked = fragments.distinct().withColumn("new", new)
    marked = marked.withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = marked.groupBy("key", "period", "no").agg(F.min("a").alias("start"), (F.max("b") - F.min("a")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(MIN_LENGTH), POWER * F.col("period"))).select("key", "start", "length", "period")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first, then the shortest period; null for none."""
    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        first = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"]))
        return F.when((x > y) | ((x == y) & first), a).otherwise(b)

    none = F.lit(None).cast(RUNS.elementType)
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull(), r).otherwise(better(best, r)))


def planted_runs(text: str, doc_id: str) -> Column:
    """The text with a periodic tail in a tenth of the rows: with h = crc32 of the id and g = h / 10 rounded down, where h % 10 = 0 word i
    from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def parts(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        return F.when(n > 0, F.struct(ws.alias("w"), a.alias("a"), (F.floor((n - a) / (3 + g % 8)) + 1).cast("int").alias("p")))

    def changed(s: Column) -> Column:
        tail = F.transform(s["w"], lambda x, i: F.when(i < s["a"], x).otherwise(F.get(s["w"], s["a"] + (i - s["a"]) % s["p"])))
        return F.when(s.isNotNull(), F.concat_ws(" ", tail))

    # the words and then the numbers are bound as the one element of an array, so that each is made once a text
    new = F.transform(F.transform(F.array(words(text_of(text))), parts), changed)
    return F.when(h % 10 == 0, F.coalesce(F.get(new, F.lit(0)), F.col(text))).otherwise(F.col(text))
