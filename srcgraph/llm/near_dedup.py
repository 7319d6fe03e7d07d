"""MinHash near-dedup (5): banded minima of universal hashes, signature check, exact check, components.

1. Each text's set of 5-word shingles (64-bit hashes) gets K minima of multiply-add-shift hashes, a digest and
   R-row band hashes. Rows with the same digest have the same set: they are one class and meet in no pair.
2. Classes that share a band hash are candidates. They are not all paired: in the first rounds every member of
   a bucket meets one pivot of it, and components are formed. Then only members of different components whose
   buckets hold several components are left to compare. Each orders its shingles from rare to common; two sets
   with i shingles in common have one among the first n - i + 1 of both, so a pair is made where the first
   shingle that two prefixes share stands early enough in both for the overlap that their sizes ask for. In each
   shingle's group, members of its largest component meet only those outside it. No link is left out.
3. Candidates pass the size bound, then the signature check (8 bits of each minimum; the limit lies 4
   standard errors under the wanted similarity), and are linked when 100 * |A & B| >= 75 * |A | B| on full sets.
4. Components by alternating large-star and small-star; the least doc_id of a component stays.

A pair at the limit escapes all 40 bands of 5 rows with probability 2e-5, one at 0.8 with 1e-7.
Whole texts are shuffled once, to meet the classes that have a candidate; sets exist for those classes only.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.session import materialize

from .common import ascii_lower, of, rows, text_of, unrow, words
from .components import connected_components

WIDTH, BANDS, ROWS = 5, 40, 5
K = BANDS * ROWS
WORDS = -(-K // 64)
SIMILARITY = 75
MIN_MATCHES = int(K * (0.75 - 4 * (0.75 * 0.25 / K) ** 0.5))
_CHUNK, SLICE = 1 << 15, 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(w: np.ndarray, start: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of consecutive word lists (word hashes ``w``, list i at start[i]:start[i + 1]).

    Returns them with their own starts. A list shorter than ``width`` but not empty has one shingle, the whole.
    """
    n = np.diff(start)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_start = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(n)), many)
    first = start[:-1][doc] + (np.arange(out_start[-1]) - out_start[:-1][doc])
    size = np.minimum(n, width)[doc]
    h = size.astype(np.uint64)
    for i in range(width):
        here = np.minimum(first + i, max(len(w) - 1, 0))
        h = np.where(size > i, _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[here]), h) if len(w) else h
    return h, out_start


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    start = col.offsets.to_numpy().astype(np.int64)
    w = col.values.to_numpy(zero_copy_only=False).view(np.uint64)[start[0]:start[-1]]
    return w, start - start[0]


def _slices(batches: Iterator[pa.RecordBatch], words_at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE words (one row at least), so that the arrays made of one stay small."""
    for b in batches:
        off = b.column(words_at).offsets.to_numpy().astype(np.int64)
        at = 0
        while at < b.num_rows:
            to = min(max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def _functions(seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    a = r.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 1 << 63, K, dtype=np.uint64)


def minima(h: np.ndarray, start: np.ndarray, seed: int) -> np.ndarray:
    """K minima (uint32) per list: min over the list of (a * h + b) >> 32; lists without a shingle get 2^32 - 1."""
    a, b = _functions(seed)
    sig = np.full((len(start) - 1, K), 0xFFFFFFFF, dtype=np.uint32)
    doc = np.repeat(np.arange(len(start) - 1), np.diff(start))
    for at in range(0, len(h), _CHUNK):
        x, d = h[at:at + _CHUNK], doc[at:at + _CHUNK]
        cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        low = np.empty((len(cut), K), dtype=np.uint64)
        y = np.empty_like(x)
        for k in range(K):
            np.multiply(x, a[k], out=y)
            np.add(y, b[k], out=y)
            np.right_shift(y, np.uint64(32), out=y)
            low[:, k] = np.minimum.reduceat(y, cut)
        sig[d[cut]] = np.minimum(sig[d[cut]], low.astype(np.uint32))
    return sig


def bit_planes(sig: np.ndarray) -> np.ndarray:
    """The low 8 bits of K minima a row as 8 planes of WORDS longs (int64), so that they can be compared bit by bit."""
    bits = np.unpackbits((sig & np.uint32(255)).astype(np.uint8)[:, :, None], axis=2).transpose(0, 2, 1)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, 0), (0, WORDS * 64 - K))), axis=2)
    return np.ascontiguousarray(packed).view(np.int64).reshape(len(sig), -1)


def signatures(docs: DataFrame, doc_id: str, text: str, seed: int) -> DataFrame:
    """Per row: doc_id, th (text hash), n (set size), d1 and d2 (digest; null for n = 0), bands, sig."""
    t = text_of(text)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("th"),
                      F.transform(words(ascii_lower(t)), lambda x: F.xxhash64(x)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 2):
            w, start = _lists(b.column(2))
            h, hs = shingle_hashes(w, start)
            sig = minima(h, hs, seed)
            n, digest = np.zeros(len(hs) - 1, np.int64), np.zeros((len(hs) - 1, 2), np.int64)
            for i in range(len(n)):
                u = np.unique(h[hs[i]:hs[i + 1]])
                n[i] = len(u)
                digest[i] = np.frombuffer(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), np.int64)
            band = np.full((len(n), BANDS), 0, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for r in range(ROWS):
                band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
            none = n == 0
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS),
                                             pa.array(band.view(np.int64).ravel()))
            small = bit_planes(sig)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n), pa.array(digest[:, 0], mask=none), pa.array(digest[:, 1], mask=none),
                 bands, pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 8 * WORDS), pa.array(small.ravel()))],
                ["doc_id", "th", "n", "d1", "d2", "bands", "sig"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, th long, n long, d1 long, d2 long, bands array<long>, sig array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """texts: (node, t); (node, s) with the distinct shingle hashes of t, in order."""
    src = texts.select("node", F.transform(words(ascii_lower(F.col("t"))), lambda x: F.xxhash64(x)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            h, hs = shingle_hashes(*_lists(b.column(1)))
            sets = [np.unique(h[hs[i]:hs[i + 1]]).view(np.int64) for i in range(len(hs) - 1)]
            start = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(start), pa.array(flat))],
                                             ["node", "s"])

    return src.mapInArrow(run, "node long, s array<long>")


def _alike(a: str, b: str) -> Column:
    """Whether at least MIN_MATCHES of the K minima agree: a minimum differs where any of its bit planes does."""
    differ = F.lit(0)
    for w in range(WORDS):
        planes = [F.get(a, F.lit(p * WORDS + w)).bitwiseXOR(F.get(b, F.lit(p * WORDS + w))) for p in range(8)]
        differ = differ + F.bit_count(reduce(Column.bitwiseOR, planes))
    return differ <= K - MIN_MATCHES


def _both(pairs: DataFrame, side: DataFrame, *cols: str) -> DataFrame:
    """pairs (a, b, ...) with the columns of ``side`` (by node) for both ends, as a_col and b_col."""
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols]), end)
    return pairs


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: sizes, then signatures, then full sets."""
    p = _both(pairs.select("a", "b"), sets, "n", "sig")
    p = p.where((100 * F.least("a_n", "b_n") >= SIMILARITY * F.greatest("a_n", "b_n"))
                & _alike("a_sig", "b_sig"))
    return _similar(_both(materialize(p.select("a", "b", "a_n", "b_n"), "near-candidates"), sets, "s"))


def _similar(p: DataFrame) -> DataFrame:
    common = F.size(F.array_intersect("a_s", "b_s"))
    return p.where(100 * common >= SIMILARITY * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def prefixes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes: (node, label). (x, place, node, label, n, early): each shingle that a node shares with another one of ``nodes`` and that is among
    its n - ceil(0.75 n) + 1 rarest, its place among them, and all of these (``early``), from rare to common.

    Shingles that no other node holds are the rarest and take places, but can be in no pair: a heavily edited text is left without any."""
    own = sets.select("node", "n", "s").join(nodes, "node")
    each = own.select("node", F.explode("s").alias("x"))
    shared = each.groupBy("x").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    early = each.join(shared, "x").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("early"))
    r = own.select("node", "label", "n").join(early, "node").withColumn("alone", F.col("n") - F.size("early"))
    long_ = F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1 - F.col("alone")
    r = r.withColumn("early", F.slice(F.col("early.x"), F.lit(1), F.greatest(long_, F.lit(0)).cast("int")))
    return r.select("node", "label", "n", "alone", "early", F.posexplode("early").alias("i", "x")).select(
        "x", (F.col("alone") + F.col("i")).alias("place"), "node", "label", "n", "early")


def cross_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes: (node, label). The pairs (a, b) of nodes of different labels that may be similar enough by their prefixes, each once."""
    p = materialize(prefixes(nodes, sets), "near-prefixes")
    most = p.groupBy("x", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("x").agg(
        F.max_by("label", F.struct("k", "label")).alias("major"), F.count(F.lit(1)).alias("labels"))
    p = p.join(most.where("labels > 1").select("x", "major"), "x")
    o = p.where("label <> major").select("x", *[F.col(c).alias(f"b_{c}") for c in ("node", "label", "n", "place", "early")])
    size = F.col("n") + F.col("b_n")
    need = F.ceil(size * SIMILARITY / (100 + SIMILARITY))
    far = (100 * F.least("n", "b_n") >= SIMILARITY * F.greatest("n", "b_n")) & (F.col("n") - F.col("place") >= need) & (F.col("b_n") - F.col("b_place") >= need)
    once = (F.col("label") != F.col("b_label")) & ((F.col("label") == F.col("major")) | (F.col("label") < F.col("b_label")))
    pairs = p.join(o, "x").where(once & far & (F.get(F.array_intersect("early", "b_early"), F.lit(0)) == F.col("x")))
    return pairs.select(F.col("node").alias("a"), F.col("b_node").alias("b"))


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, label) after new links (a, b): the components of the labels they join, handed down to the nodes."""
    if not links.take(1):
        return labels
    if labels is None:
        return connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ends = links.select("a", "b")
    for end, to in (("a", "u"), ("b", "v")):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("label").alias(to)), end, "left")
        ends = ends.withColumn(to, F.coalesce(to, end))
    joined = connected_components(ends.select("u", "v"))
    up = joined.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = joined.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return materialize(old.unionByName(fresh), "near-labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7,
                    pivot_rounds: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, th (xxhash64 of the text), n_shingles, component_id, kept.

    Texts are A-Z lower-cased; words are runs outside white space. Fewer than five words are one shingle; a
    null, empty or blank text has none, links with nothing and is kept. component_id is the least doc_id of
    the component, kept is doc_id = component_id (null ids: least of nothing else, equal to each other), so
    rows that repeat the kept id all have kept = true. Ids may be of any type that can be ordered. Other columns
    are not read; an empty table gives an empty result.
    """
    signed = materialize(signatures(docs, doc_id, text, seed), "near-rows")
    some = signed.where("n > 0")
    classes = some.groupBy("d1", "d2").agg(
        F.min(F.struct("doc_id", "th")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("sig").alias("sig"))
    # a class's number is fixed by being written
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    bucket = classes.select("node", F.posexplode("bands").alias("k", "h"))
    shared = materialize(bucket.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "near-buckets")
    members = materialize(bucket.join(shared, "h"), "near-members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi")
    wanted = materialize(wanted.select("node", F.col("rep.doc_id").alias("i"), F.col("rep.th").alias("h"), "n", "sig", "bands"), "near-wanted")
    full = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))
    texts = full.join(wanted.select("node", "i", "h"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    sets = materialize(shingle_sets(texts.dropDuplicates(["id", "th"]).select("node", "t"))
                       .join(wanted.select("node", "n", "sig", "bands"), "node"), "near-sets")
    labels = None
    for r in range(pivot_rounds + 1):
        m = _labelled(members, labels)
        if labels is not None:  # only buckets with several components have anything left to compare
            live = m.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
            m = materialize(m.join(live.select("h"), "h"), "near-live")
            if not m.take(1):
                break
        if r < pivot_rounds:
            order = F.struct(F.xxhash64(F.lit(r), "node"), "node", "label")
            pivot = m.groupBy("h").agg(F.min(order).alias("p")).select("h", F.col("p.node").alias("b"), F.col("p.label").alias("b_label"))
            pairs = m.join(materialize(pivot, "near-pivots"), "h").where("label <> b_label")
            links = linked(pairs.select(F.col("node").alias("a"), "b").distinct(), sets)
        else:
            pairs = cross_pairs(m.select("node", "label").distinct(), sets)
            both = _both(pairs, sets, "n", "sig", "s").where(_alike("a_sig", "b_sig"))
            links = _similar(both)
        links = materialize(links, "near-links")
        labels = _merge(labels, links)
    owner = _labelled(classes.select("node", F.col("rep.doc_id").alias("id")), labels)
    least = owner.groupBy("label").agg(F.min("id").alias("component_id"))
    owner = materialize(owner.select("node", "label").join(least, "label").select("node", "component_id"), "near-owner")
    owner = classes.select("d1", "d2", "node").join(owner, "node").drop("node")
    out = signed.select("doc_id", "th", F.col("n").alias("n_shingles"), "d1", "d2").join(owner, ["d1", "d2"], "left")
    cid = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", "n_shingles", cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose document stays, in ``docs``' columns; of rows that repeat id and text the least stays, its columns compared in
    order."""
    d = rows(docs).select("*", of(docs.columns, doc_id).alias("id"),
                          F.xxhash64(F.coalesce(of(docs.columns, text), F.lit(""))).alias("h"))
    stay = near_duplicates(docs, doc_id, text, **how).where("kept").select("doc_id", "th").distinct()
    j = d.join(stay, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")), "left_semi")
    own = [c for c in d.columns if c not in ("id", "h")]
    return unrow(j.groupBy("id", "h").agg(F.min(F.struct(*own)).alias("least")).select("least.*"), docs.columns)
