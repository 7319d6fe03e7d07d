"""LM scoring (4): an Elias-Fano n-gram trie of order 3 over all training texts.

Words are 64-bit hashes. The vocabulary is the sorted sequence of hashes in Elias-Fano code, cut by the hashes'
leading bits into parts of bounded size; a word's id is its place. N-grams are counted by Spark: tasks count the
tuples (x, y, z) of their texts, compress them per shard (a hash of x, and for frequent x of a part of the y as well) and send them
to the shards, each of which sums them and writes one trie:

  level 1   contexts x, increasing ids; pointers to their successors
  level 2   successors y of each x; quantised discounted probability, back-off weight of (x, y), pointers
  level 3   successors z of each (x, y); quantised discounted probability

Successor ids are coded relative to their context: the last value of the context before is added, so that a level
is one increasing sequence, and a look-up is a successor search for base + id whose place must lie in the context's
range. Pointers are Elias-Fano coded too. All arrays of a shard are in one file, memory-mapped by the scoring tasks
and shared by them through the page cache.

Smoothing: p(w | x y) = a3 + b3 * (a2 + b2 * p1(w)); a is the discounted relative frequency of a kept n-gram (at
least ``min_counts`` occurrences), rounded down to a step of its code; b is the rest of its context's mass, so pruned
n-grams and discounts go to the shorter context; p1 is the base distribution. As the steps round down, probabilities
sum to at most 1 (short of it by the rounding).

No text, n-gram table or model goes through the driver; it sees one number per vocabulary part and shard. Files go to
the shared folder, each under its final name only when whole, so a lost task can be run again. Where that folder is
not a mounted file system, tasks fetch the parts they use into their local folder first.
"""
from __future__ import annotations

import json
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from srcgraph.session import materialize, scratch_path

from .common import ascii_lower, text_of, words
from .elias_fano import EliasFano

END = -1  # the end token's hash
NONE = 0xFFFFFFFF  # no third word
MAX_VOCABULARY = NONE - 2  # ids fit 32 bits
STEPS = 65535
PASS_TOKENS = 1 << 20


@dataclass
class Model:
    folder: str
    bits: int = 0  # leading hash bits that name a vocabulary part
    starts: list[int] = field(default_factory=lambda: [0])  # first id of each part, and the size of the vocabulary
    tokens: int = 0
    docs: int = 0
    shards: int = 0
    per_shard: int = 1 << 22
    bos_left: float = 1.0  # back-off weight of the beginning of a text

    @property
    def size(self) -> int:
        return self.starts[-1]


def _write(folder: str, name: str, meta: dict, arrays: list[np.ndarray]) -> None:
    from pyarrow import fs
    path = folder.removeprefix("file://").removeprefix("file:") if folder.startswith("file:") else folder
    store, path = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    head = json.dumps(meta | {"arrays": [[str(a.dtype), len(a)] for a in arrays]}).encode()
    tmp = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        f.write(len(head).to_bytes(8, "little") + head + bytes(-len(head) % 8))
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    store.move(tmp, f"{path}/{name}")


@lru_cache(maxsize=None)
def _read(folder: str, name: str) -> tuple[dict, list[np.ndarray]]:
    path = folder.removeprefix("file://").removeprefix("file:") if folder.startswith("file:") else folder
    path = f"{path}/{name}"
    if not path.startswith("/"):
        from pyarrow import fs
        store, there = fs.FileSystem.from_uri(f"{folder}/{name}")
        path = os.path.join(tempfile.gettempdir(), f"{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}-{name}")
        if not os.path.exists(path):
            fs.copy_files(there, f"{path}.{os.getpid()}", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            os.replace(f"{path}.{os.getpid()}", path)
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    meta, at, arrays = json.loads(raw[8:8 + n].tobytes()), 8 + n + -n % 8, []
    for kind, size in meta["arrays"]:
        nbytes = np.dtype(kind).itemsize * size
        arrays.append(raw[at:at + nbytes].view(kind))
        at += nbytes + -nbytes % 8
    return meta, arrays


def _ef(meta: dict, arrays: list[np.ndarray], i: int) -> EliasFano:
    return EliasFano(meta["n"][i], meta["l"][i], *arrays[4 * i:4 * i + 4])


def _efs(codes: list[EliasFano]) -> tuple[dict, list[np.ndarray]]:
    return {"n": [e.n for e in codes], "l": [e.l for e in codes]}, [a for e in codes for a in e.arrays]


class Vocabulary:
    """Ids and counts of word hashes."""

    def __init__(self, m: Model):
        self.m = m

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The ids of hashes; the vocabulary's size + 1 for words that it lacks."""
        u, back = np.unique(h.view(np.uint64), return_inverse=True)
        out = np.full(len(u), self.m.size + 1, np.int64)
        part = (u >> np.uint64(64 - self.m.bits)).astype(np.int64) if self.m.bits else np.zeros(len(u), np.int64)
        edge = np.searchsorted(part, np.arange(len(self.m.starts)))
        for p in range(len(self.m.starts) - 1):
            if edge[p] < edge[p + 1] and self.m.starts[p] < self.m.starts[p + 1]:
                meta, arrays = _read(self.m.folder, f"words-{p}")
                place, found = _ef(meta, arrays, 0).successor(u[edge[p]:edge[p + 1]])
                out[edge[p]:edge[p + 1]][found] = place[found] + self.m.starts[p]
        return out[back]

    def _gather(self, ids: np.ndarray, name: str, column: int, other: float, kind: type) -> np.ndarray:
        out = np.full(len(ids), other, kind)
        part = np.searchsorted(self.m.starts, ids, "right") - 1
        for p in np.unique(part[ids < self.m.size]):
            on = part == p
            out[on] = _read(self.m.folder, f"{name}-{p}")[1][column][ids[on] - self.m.starts[p]]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        c = self._gather(ids, "words", 4, 0, np.int64)
        c[ids == self.m.size] = self.m.docs  # the beginning of a text
        return c

    def left(self, ids: np.ndarray) -> np.ndarray:
        """Back-off weights of single words."""
        b = self._gather(ids, "left", 0, 1.0, np.float32).astype(np.float64)
        b[ids == self.m.size] = self.m.bos_left
        return b


def base_probability(c: np.ndarray, m: Model) -> np.ndarray:
    return (c + 0.1) / (m.tokens + 0.1 * (m.size + 1))


def _mix(k: np.ndarray) -> np.ndarray:
    k = (k ^ (k >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    k = (k ^ (k >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return k ^ (k >> np.uint64(33))


def _shard_of(vocab: Vocabulary, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The shard of each (x, y): by x, and where x's count is more than an eighth of a shard also by a part of the y."""
    m = vocab.m
    parts = (1 + vocab.counts(x) // max(1, m.per_shard // 8)).astype(np.uint64)
    part = _mix(y.astype(np.uint64) + np.uint64(1)) % parts
    return (_mix((x.astype(np.uint64) << np.uint64(24)) ^ part) % np.uint64(m.shards)).astype(np.int64)


def _passes(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, starts) of runs of rows of about PASS_TOKENS words."""
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + PASS_TOKENS)))
        to = min(to, len(off) - 1)
        yield at, to - at, flat[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


def _sequences(vocab: Vocabulary, w: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in one array, each as (beginning, words, end); and the places of the beginnings."""
    n = np.diff(start)
    first = start[:-1] + 2 * np.arange(len(n))
    a = np.full(len(w) + 2 * len(n), END, np.int64)
    is_word = np.ones(len(a), bool)
    is_word[first] = is_word[first + n + 1] = False
    a[is_word] = w
    ids = vocab.ids(a)
    ids[first] = vocab.m.size
    return ids, first


def _pack(columns: list[np.ndarray]) -> bytes:
    """Sorted tuples: the first column as differences, all as planes of bytes, compressed."""
    x, *rest = columns
    cols = [np.diff(x, prepend=x[:1] * 0), *rest]
    return zlib.compress(b"".join(c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in cols), 1)


def _unpack(raw: bytes) -> list[np.ndarray]:
    b = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, 4, -1)
    cols = [np.ascontiguousarray(c.T).view("<u4").ravel().astype(np.int64) for c in b]
    return [np.cumsum(cols[0]), *cols[1:]]


def _count(m: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocab = Vocabulary(m)
    for b in batches:
        for _, _, w, start in _passes(b.column(0)):
            a, first = _sequences(vocab, w, start)
            last = np.append(first[1:], len(a)) - 1
            at = np.ones(len(a), bool)
            at[last] = False
            at = np.flatnonzero(at)  # a tuple begins at every place but a text's end
            x, y = a[at], a[at + 1]
            z = np.append(a, NONE)[at + 2]
            z[np.isin(at + 1, last, assume_unique=True)] = NONE
            pair, back = np.unique((x << 32) | y, return_inverse=True)
            key, c = np.unique((back << 32) | z, return_counts=True)
            shard = _shard_of(vocab, pair >> 32, pair & 0xFFFFFFFF)[key >> 32]
            pair = pair[key >> 32]
            x, y, z = pair >> 32, pair & 0xFFFFFFFF, key & 0xFFFFFFFF
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(m.shards + 1))
            rows = [(s, _pack([v[order[edge[s]:edge[s + 1]]] for v in (x, y, z, c)])) for s in range(m.shards) if edge[s] < edge[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                             ["shard", "counts"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, count) of runs of texts, with their ends."""
    for b in batches:
        for _, n, w, _ in _passes(b.column(0)):
            h, c = np.unique(w, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h, END), pa.int64()), pa.array(np.append(c, n), pa.int64())], ["h", "c"])


def _discounted(c: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return c - np.asarray(discounts)[np.minimum(c, 3) - 1]


def _code(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(lowest log10, codes, coded probabilities): log10 p rounded down to one of STEPS + 1 steps up to 0."""
    if not len(p):
        return 0.0, np.zeros(0, np.uint16), np.zeros(0)
    lp = np.log10(p)
    low = float(lp.min())
    code = np.floor((1 - lp / min(low, -1e-9)) * STEPS).clip(0, STEPS).astype(np.uint16)
    return low, code, _decode(low, code)


def _decode(low: float, code: np.ndarray) -> np.ndarray:
    return 10 ** (low * (1 - code / STEPS))


def _relative(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ids (from 1 on) of consecutive ranges, plus the last value of the range before: one increasing sequence."""
    if not len(ids):
        return ids
    size = np.diff(start)
    last = np.where(size > 0, ids[np.maximum(start[1:] - 1, 0)] + 1, 0)
    base = np.concatenate([[0], np.cumsum(last)[:-1]])
    return ids + 1 + np.repeat(base, size)


def _summed(tuples: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((x, y) as one number, z, count) of all tuples, sorted, equal ones added up."""
    xy, z, c = (np.concatenate(v) for v in zip(*tuples))
    tuples.clear()
    order = np.lexsort((z, xy))
    xy, z = xy[order], z[order]
    c = c[order]
    new = np.flatnonzero(np.concatenate([[True], (xy[1:] != xy[:-1]) | (z[1:] != z[:-1])]))
    return xy[new], z[new], np.add.reduceat(c, new)


def _sums(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_summed`` of packed parts. They are added up as they are read, each time as many as there are distinct tuples so
    far (``PASS_TOKENS`` at least), so what is held at once follows the distinct tuples, 16 to 20 bytes each."""
    held: list = []
    most = n = 0
    for raw in parts:
        x, y, z, c = _unpack(raw)
        held.append(((x << 32 | y).view(np.uint64), z.astype(np.uint32), c))
        n += len(c)
        if n > most:
            held = [_summed(held)]
            n = len(held[0][0])
            most = 2 * max(n, PASS_TOKENS)
    return _summed(held)


def _build_shard(m: Model, shard: int, parts: list[bytes], min_counts: tuple[int, int], discounts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Write a shard's trie; returns the contexts of level 1 and the mass that their successors here hold."""
    vocab = Vocabulary(m)
    xy, z, c = _sums(parts)
    two = np.flatnonzero(np.concatenate([[True], xy[1:] != xy[:-1]]))
    n, xy = len(xy), xy[two]
    c2 = np.add.reduceat(c, two)
    keep2 = c2 >= min_counts[0]
    of = np.cumsum(keep2) - 1  # a bigram's place among the kept
    bi = np.repeat(np.arange(len(two)), np.diff(np.append(two, n)))
    keep3 = keep2[bi] & (z != NONE) & (c >= max(min_counts))
    xy, c2 = xy[keep2], c2[keep2]
    x2, y2 = (xy >> np.uint64(32)).astype(np.int64), (xy & np.uint64(NONE)).astype(np.int64)
    z3, c3, up3 = z[keep3].astype(np.int64), c[keep3], of[bi[keep3]]
    del xy, z, c, bi, of, keep2, keep3, two
    low2, code2, a2 = _code(_discounted(c2, discounts) / vocab.counts(x2))
    low3, code3, a3 = _code(_discounted(c3, discounts) / c2[up3])
    rest = np.floor(np.clip(1 - np.bincount(up3, a3, len(x2)), 0, 1) * STEPS).astype(np.uint16)
    one = np.flatnonzero(np.concatenate([[True], np.diff(x2) != 0])) if len(x2) else np.zeros(0, np.int64)
    start2 = np.append(one, len(x2))
    start3 = np.concatenate([[0], np.cumsum(np.bincount(up3, minlength=len(x2)))]).astype(np.int64)
    meta, arrays = _efs([EliasFano.build(v) for v in (x2[one], start2, _relative(y2, start2), start3, _relative(z3, start3))])
    _write(m.folder, f"trie-{shard}", meta | {"low": [low2, low3]}, [*arrays, code2, rest, code3])
    return x2[one], (np.add.reduceat(a2, one) if len(one) else a2)


class Trie:
    """One shard's levels."""

    def __init__(self, m: Model, shard: int):
        meta, arrays = _read(m.folder, f"trie-{shard}")
        self.one, self.ptr2, self.two, self.ptr3, self.three = (_ef(meta, arrays, i) for i in range(5))
        self.code2, self.rest, self.code3 = arrays[20:]
        self.low2, self.low3 = meta["low"]

    @staticmethod
    def _children(pointers: EliasFano, level: EliasFano, node: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places in ``level`` of ids among the successors of nodes (in order, repeated), or -1.

        Each node's range and base (the last value before it) are read once; every id is then one successor
        search relative to its context."""
        out = np.full(len(node), -1, np.int64)
        if not len(node):
            return out
        new = np.concatenate([[True], node[1:] != node[:-1]])
        u, of = node[new], np.cumsum(new) - 1
        begin, end = (pointers.access(u + i).astype(np.int64) for i in (0, 1))
        base = np.zeros(len(u), np.uint64)
        on = begin > 0
        base[on] = level.access(begin[on] - 1)
        some = np.flatnonzero((begin < end)[of])
        of = of[some]
        at, found = level.successor(base[of] + ids[some].astype(np.uint64) + np.uint64(1))
        out[some] = np.where(found & (at >= begin[of]) & (at < end[of]), at, -1)
        return out

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Nodes of level 2 of pairs in order of x, or -1."""
        node = np.full(len(x), -1, np.int64)
        new = np.concatenate([[True], x[1:] != x[:-1]])
        k, found = self.one.successor(x[new].astype(np.uint64))
        of = np.cumsum(new) - 1
        on = np.flatnonzero(found[of])
        node[on] = self._children(self.ptr2, self.two, k[of[on]], y[on])
        return node

    def triples(self, node: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Places in level 3 of the successors z of nodes of level 2 (in order), or -1."""
        return self._children(self.ptr3, self.three, node, z)


@lru_cache(maxsize=None)
def _trie(folder: str, shards: int, shard: int) -> Trie:
    return Trie(Model(folder, shards=shards), shard)


def _groups(shard: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its rows in order) for each shard that has any."""
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    for g in np.split(order, cut):
        if len(g):
            yield int(shard[g[0]]), rows[g]


def score_texts(m: Model, w: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_tokens, n_known, base_score and score of texts given as word hashes."""
    vocab, size = Vocabulary(m), m.size
    a, first = _sequences(vocab, w, start)
    at = np.ones(len(a), bool)
    at[first] = False
    at = np.flatnonzero(at)  # every token but the beginnings
    doc = np.repeat(np.arange(len(first)), np.diff(start) + 1)
    y, x = a[at], a[at - 1]
    c = vocab.counts(y)
    p1 = base_probability(c, m)
    p = p1
    if m.shards and size:
        pair, back = np.unique((x << 32) | y, return_inverse=True)
        px, py = pair >> 32, pair & 0xFFFFFFFF
        known = np.flatnonzero((px <= size) & (py < size))
        shard, node = np.full(len(pair), -1, np.int64), np.full(len(pair), -1, np.int64)
        shard[known] = _shard_of(vocab, px[known], py[known])
        a2, rest = np.zeros(len(pair)), np.ones(len(pair))
        for s, g in _groups(shard[known], known):
            if len(g):
                t = _trie(m.folder, m.shards, s)
                node[g] = t.pairs(px[g], py[g])
                hit = g[node[g] >= 0]
                a2[hit] = _decode(t.low2, t.code2[node[hit]])
                rest[hit] = t.rest[node[hit]] / STEPS
        # the pair before a token, for every token but a text's first
        before = np.where(x == size, -1, np.concatenate([[-1], back[:-1]]))
        node_before = np.where(before >= 0, node[np.maximum(before, 0)], -1)
        on = np.flatnonzero((node_before >= 0) & (y < size))
        tri, again = np.unique((before[on] << 32) | y[on], return_inverse=True)
        tp, tz, a3 = tri >> 32, tri & 0xFFFFFFFF, np.zeros(len(tri))
        for s, g in _groups(shard[tp], np.arange(len(tp))):
            t = _trie(m.folder, m.shards, s)
            place = t.triples(node[tp[g]], tz[g])
            a3[g[place >= 0]] = _decode(t.low3, t.code3[place[place >= 0]])
        p = a2[back] + vocab.left(x) * p1
        p *= np.where(node_before >= 0, rest[np.maximum(before, 0)], 1.0)
        p[on] += a3[again]
    total = lambda v: np.bincount(doc, v, len(first))
    return np.diff(start) + 1, total(c > 0).astype(np.int64), total(np.log10(p1)), total(np.log10(p))


def _hashes(text: str) -> Column:
    return F.transform(words(ascii_lower(text_of(text))), lambda x: F.xxhash64(x))


def train(docs: DataFrame, text: str = "text", min_counts: tuple[int, int] = (2, 2), discounts: tuple[float, float, float] = (0.75, 1.1, 1.4),
          words_per_part: int = 1 << 22, tokens_per_shard: int = 1 << 22) -> Model:
    """Learn from every row of ``docs`` (null text: empty) and write the model to the shared folder.

    ``min_counts``: the least count of a bigram and of a trigram that the trie keeps. ``discounts`` are taken off
    counts of 1, 2, and 3 or more. ``words_per_part`` and ``tokens_per_shard`` bound what one task holds; the numbers
    of parts and shards follow from them and the corpus.
    """
    spark = docs.sparkSession
    m = Model(scratch_path(spark, f"ngram-lm-{uuid.uuid4().hex}"))
    w = docs.select(_hashes(text).alias("w"))
    counts = materialize(w.mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-words")
    n_words, m.tokens, m.docs = (int(v or 0) for v in counts.agg(
        F.count(F.lit(1)), F.sum("c"), F.max(F.when(F.col("h") == END, F.col("c")))).first())
    if n_words > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} distinct words")
    if not n_words:
        return m
    m.bits = max(0, (n_words // words_per_part).bit_length())
    m.shards, m.per_shard = m.tokens // tokens_per_shard + 1, tokens_per_shard
    part = F.shiftrightunsigned("h", 64 - m.bits) if m.bits else F.lit(0).cast("long")

    def write_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h, c = pdf["h"].to_numpy().view(np.uint64), pdf["c"].to_numpy()
        order = np.argsort(h)
        meta, arrays = _efs([EliasFano.build(h[order])])
        _write(m.folder, f"words-{key[0]}", meta, [*arrays, c[order]])
        return pd.DataFrame({"part": [key[0]], "n": [len(pdf)]})

    sizes = dict(counts.withColumn("part", part).groupBy("part").applyInPandas(write_words, "part long, n long").collect())
    m.starts = [0, *np.cumsum([sizes.get(p, 0) for p in range(1 << m.bits)]).tolist()]
    plain = Model(**asdict(m))

    def build(table: pa.Table) -> pa.Table:
        ids, mass = _build_shard(plain, table["shard"][0].as_py(), table["counts"].to_pylist(), min_counts, discounts)
        return pa.table({"id": pa.array(ids, pa.int64()), "mass": pa.array(mass, pa.float64())})

    tuples = w.mapInArrow(lambda it: _count(plain, it), "shard long, counts binary")
    mass = materialize(tuples.groupBy("shard").applyInArrow(build, "id long, mass double"), "lm-mass")
    held = mass.groupBy("id").agg(F.sum("mass").alias("mass"))
    starts = m.starts
    bos = held.where(F.col("id") == m.size).select("mass").first()
    m.bos_left = max(0.0, 1 - bos[0]) if bos else 1.0

    def write_left(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(key[0])
        left = np.ones(starts[p + 1] - starts[p], np.float32)
        ids = pdf["id"].to_numpy()
        on = ids >= 0
        left[ids[on] - starts[p]] = np.clip(1 - pdf["mass"].to_numpy()[on], 0, 1)
        _write(plain.folder, f"left-{p}", {}, [left])
        return pd.DataFrame({"part": [p]})

    edges = spark.createDataFrame([(p, a, b) for p, (a, b) in enumerate(zip(starts, starts[1:])) if a < b], "part long, a long, b long")
    # each part's own rows, and one row that stands for the part itself
    placed = held.where(F.col("id") < m.size).join(F.broadcast(edges), (F.col("id") >= F.col("a")) & (F.col("id") < F.col("b")))
    placed = placed.select("part", "id", "mass").unionByName(edges.select("part", F.lit(-1).cast("long").alias("id"), F.lit(0.0).alias("mass")))
    placed.groupBy("part").applyInPandas(write_left, "part long").collect()
    return m


def score(docs: DataFrame, m: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` with n_tokens, n_known, train_tokens, base_score and score of the whole text of every row.

    A null or empty text has one token, its end. With nothing learnt every token has probability 1.
    """
    src = docs.select(*keep, _hashes(text).alias("_lm_words"))
    fields = src.schema.fields[:-1]
    out = StructType([*fields, *[StructField(n, LongType()) for n in ("n_tokens", "n_known", "train_tokens")],
                      *[StructField(n, DoubleType()) for n in ("base_score", "score")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, w, start in _passes(b.column(len(fields))):
                tokens, known, base, own = score_texts(m, w, start)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, n) for c in b.columns[:len(fields)]], pa.array(tokens), pa.array(known),
                     pa.array(np.full(n, m.tokens, np.int64)), pa.array(base), pa.array(own)], names=out.names)

    return src.mapInArrow(run, out)
