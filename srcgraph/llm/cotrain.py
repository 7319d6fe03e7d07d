"""Quality classifier (7): co-training of a text view and a page-metadata view.

The text view sees only the text: shares of hashed byte pairs and a few measures of form. The metadata view sees
only columns about the page: source, language and length. Each is a sparse logistic regression. In every round both
views score all unlabelled documents, and each hands those it is most sure of to the other view's training set: per
class, those above the log odds that a share of the documents, more with every round, reaches. Both are calibrated
(Platt) on labelled rows kept out of training, and combined as views that are independent given the class: the log
odds add up, less the prior's.

Labels are given over the whole table; only the rows that enter a fit are bounded, by samples chosen by a hash:
``sample_rows`` labelled documents (hash of the id) and, drawn anew in each round among all that the views have
labelled, ``pool_rows`` others (hash of the row). Their features reach the driver in a few kilobytes a row. A round is
a pass over all texts, of which only ids, row hashes and binned log odds are shuffled, and a scan for the sample's
texts; scoring is one more pass without a shuffle.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from srcgraph.session import materialize

from .langid import fit_ftrl

PAIRS = 1 << 12
FORM = 12
TEXT_DIMS = PAIRS + FORM + 1  # and a bias
META_DIMS = (1 << 12) + 1
PAIR_SCALE = 20.0
PIECE = 1 << 20
BINS = 100  # a unit of log odds

Pick = Callable[[list[np.ndarray], tuple[float, float]], list[tuple[list, list[int]]]]


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the text view."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = np.zeros(PAIRS, np.int64)
    for at in range(0, max(len(raw) - 1, 0), PIECE):
        b = raw[at:at + PIECE + 1].astype(np.int64)
        n += np.bincount((b[:-1] * 257 + b[1:] * 31) & (PAIRS - 1), minlength=PAIRS)
    ids = np.flatnonzero(n)
    x = PAIR_SCALE * n[ids] / max(n.sum(), 1)
    words = (text or "").split()
    lines = (text or "").split("\n")
    size, count = max(len(raw), 1), max(len(words), 1)
    seen = np.bincount(raw, minlength=256)
    form = [np.log1p(len(words)) / 8, min(len(raw) / count, 40) / 10, len(set(words)) / count,
            sum(a == b for a, b in zip(words, words[1:])) / count, seen[list(b"#*$%&|<>")].sum() / size * 5,
            seen[ord("|")] / count, seen[48:58].sum() / size * 5, seen[65:91].sum() / size * 5,
            len(lines) / count, min(count / len(lines), 100) / 50, (seen[ord(".")] + seen[ord(",")]) / count,
            len(set(lines)) / len(lines)]
    return np.concatenate([ids, PAIRS + np.arange(FORM), [PAIRS + FORM]]), np.concatenate([x, form, [1.0]])


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the metadata view."""
    size = "none" if n_chars is None else str(max(int(n_chars), 0).bit_length())
    names = [f"source={source}", f"lang={lang}", f"size={size}", f"lang={lang},size={size}"]
    ids, x = np.unique([zlib.crc32(s.encode()) % (META_DIMS - 1) for s in names] + [META_DIMS - 1], return_counts=True)
    return ids, x.astype(np.float64)


def _logit(w: np.ndarray, ids: np.ndarray, x: np.ndarray) -> float:
    d = x @ w[ids]
    return float(d[1] - d[0])


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of the best sigmoid(a * z + b) by Newton steps, with a weak pull to a = 1, b = 0."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


@dataclass
class Views:
    text: np.ndarray
    meta: np.ndarray
    text_platt: tuple[float, float]
    meta_platt: tuple[float, float]
    prior: float

    def scores(self, text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> tuple[float, float, float]:
        """Calibrated probabilities of the text view, of the metadata view, and of both together."""
        a = self.text_platt[0] * _logit(self.text, *text_features(text)) + self.text_platt[1]
        b = self.meta_platt[0] * _logit(self.meta, *meta_features(source, lang, n_chars)) + self.meta_platt[1]
        p = [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (a, b, a + b - self.prior)]
        return float(p[0]), float(p[1]), float(p[2])


def least_bin(counts: dict[int, int], quota: float, sure: float) -> int:
    """The least bin of log odds, none under ``sure``, from which on the rows are taken: whole bins until ``quota`` is reached."""
    low, total = math.ceil(BINS * math.log(sure / (1 - sure))), 0
    for b in sorted((b for b in counts if b >= low), reverse=True):
        total += counts[b]
        if total >= quota:
            return b
    return low


def _bin(z: float) -> int:
    return int(math.floor(BINS * min(abs(z), 30.0))) * (1 if z >= 0 else -1)


def _cuts(bins: list[dict[int, int]], shares: tuple[float, float], sure: float) -> list[list[tuple[int, int, int]]]:
    """Per view, for each class (sign of its log odds, least bin, rows from there on), from the numbers of rows by bin."""
    out = []
    for of in bins:
        n, own = sum(of.values()), []
        for sign, part in zip((-1, 1), shares):
            mine = {sign * b: c for b, c in of.items()}
            cut = least_bin(mine, max(1.0, part * n), sure)
            own.append((sign, cut, sum(c for b, c in mine.items() if b >= cut)))
        out.append(own)
    return out


def _pick_from(pool: list[tuple], sure: float) -> Pick:
    def pick(w: list[np.ndarray], shares: tuple[float, float]) -> list[tuple[list, list[int]]]:
        bins = [[_bin(_logit(w[v], *r[v])) for r in pool] for v in (0, 1)]
        cuts = _cuts([dict(Counter(b)) for b in bins], shares, sure)
        out: list[tuple[list, list[int]]] = [([], []), ([], [])]
        for v in (0, 1):
            for label, (sign, cut, _) in enumerate(cuts[v]):
                for i in [i for i, b in enumerate(bins[v]) if sign * b >= cut]:
                    out[1 - v][0].append(pool[i][1 - v])
                    out[1 - v][1].append(label)
        return out
    return pick


def co_train(rows: list[tuple], y: np.ndarray, pool: list[tuple] | Pick, rounds: int = 4, share: float = 0.05, sure: float = 0.9,
             seed: int = 1) -> Views | None:
    """rows and pool: (text view, metadata view) features; or pool gives, for both views' weights and the classes' shares
    of its rows, per view the features and labels that the other view hands to it. None where fewer than two classes are labelled."""
    if len(np.unique(y)) < 2:
        return None
    held = np.arange(len(rows)) % 4 == 3
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(rows), bool)
    base = np.flatnonzero(~held)
    dims = (TEXT_DIMS, META_DIMS)
    extra: list[tuple[list, list[int]]] = [([], []), ([], [])]  # per view: features with the other view's label
    positive = float(y[base].mean())
    pick = pool if callable(pool) else _pick_from(pool, sure)

    def fit(v: int) -> np.ndarray:
        more, labels = extra[v]
        known = [rows[i][v] for i in base] + more
        return fit_ftrl(lambda i: known[i], np.concatenate([y[base], np.array(labels, np.int64)]).astype(np.int64),
                        2, dims[v], l1=1e-3, l2=1e-3, epochs=3, seed=seed)

    w = [fit(0), fit(1)]
    for k in range(1, rounds + 1):
        extra = pick(w, (k * share * (1 - positive), k * share * positive))
        w = [fit(0), fit(1)]
    at = np.flatnonzero(held) if held.any() else base
    cal = [platt(np.array([_logit(w[v], *rows[i][v]) for i in at]), y[at]) for v in (0, 1)]
    rate = np.clip(y[at].mean(), 1e-3, 1 - 1e-3)
    return Views(w[0], w[1], cal[0], cal[1], float(np.log(rate / (1 - rate))))


def _features(sample: DataFrame) -> list[tuple]:
    """(y, (text view, metadata view)) of a bounded sample with columns id, y, t, source, lang, n_chars, in the order of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                ids, x = text_features(r["t"])
                out.append((r["u"], r["y"], r["source"], r["lang"], r["n_chars"], ids.astype(np.int16).tobytes(), x.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_pydict(dict(zip(("u", "y", "source", "lang", "n_chars", "ids", "x"), map(list, zip(*out)))) if out else
                                             {k: [] for k in ("u", "y", "source", "lang", "n_chars", "ids", "x")},
                                             schema=pa.schema([("u", pa.int64()), ("y", pa.int32()), ("source", pa.string()), ("lang", pa.string()),
                                                               ("n_chars", pa.int64()), ("ids", pa.binary()), ("x", pa.binary())]))

    got = sample.mapInArrow(run, "u long, y int, source string, lang string, n_chars long, ids binary, x binary")
    return [(r["y"], ((np.frombuffer(r["ids"], np.int16).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(np.float64)),
                      meta_features(r["source"], r["lang"], r["n_chars"]))) for r in got.orderBy("u").collect()]


def _binned(d: DataFrame, w: list[np.ndarray]) -> DataFrame:
    """(id, k, b0, b1) of every row of ``d``: the bins of both views' log odds."""
    shared = d.sparkSession.sparkContext.broadcast(w)
    src = d.select("id", "k", "t", "source", "lang", "n_chars")
    out = StructType([*src.schema.fields[:2], StructField("b0", IntegerType()), StructField("b1", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta = shared.value
        for b in batches:
            t, *page = (c.to_pylist() for c in b.columns[2:])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([_bin(_logit(text, *text_features(x))) for x in t], pa.int32()),
                                              pa.array([_bin(_logit(meta, *meta_features(*x))) for x in zip(*page)], pa.int32())], names=out.names)

    return src.mapInArrow(run, out)


def _pick_over(d: DataFrame, have: DataFrame, pool_rows: int, sure: float, seed: int) -> Pick:
    """Labels over all rows of ``d`` without a label in ``have``; about ``pool_rows`` of those labelled enter the fit."""
    d = d.withColumn("k", F.xxhash64("id", "t", "source", "lang", "n_chars"))
    drawn = count(1)

    def pick(w: list[np.ndarray], shares: tuple[float, float]) -> list[tuple[list, list[int]]]:
        z = materialize(_binned(d, w).join(have.select("id"), "id", "left_anti").select("k", "b0", "b1"), "co-training-odds")
        bins: list[dict[int, int]] = [{}, {}]
        both = z.select(F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"b{v}").alias("b")) for v in (0, 1)])).alias("x"))
        for v, b, n in both.groupBy("x.v", "x.b").agg(F.count(F.lit(1)).alias("n")).collect():  # by the bins, 6,000 a view at most
            bins[v][b] = n
        draw, labels = next(drawn), []
        for v, cuts in enumerate(_cuts(bins, shares, sure)):
            given = F.lit(None).cast("int")
            for label, (sign, cut, n) in enumerate(cuts):
                rate = min(1.0, 0.5 * pool_rows * shares[label] / sum(shares) / max(n, 1))
                u = F.pmod(F.xxhash64(F.lit(seed), F.lit(draw), F.lit(2 * v + label), "k"), F.lit(1 << 30))
                given = F.when((F.lit(sign) * F.col(f"b{v}") >= cut) & (u < F.lit(int(rate * (1 << 30)))), F.lit(label)).otherwise(given)
            labels.append(given)
        # labels[v] goes to the other view; y holds both, 3 for none. The expected size is given, the limit binds it
        z = z.select("k", *[F.coalesce(x, F.lit(3)).alias(f"l{v}") for v, x in enumerate(labels)]).where("l0 < 3 or l1 < 3")
        chosen = z.select("k", (4 * F.col("l1") + F.col("l0")).cast("int").alias("y")).distinct().limit(int(1.25 * pool_rows))
        got = _features(d.join(F.broadcast(chosen), "k").dropDuplicates(["k"]).withColumnRenamed("k", "u")
                        .select("u", "y", "t", "source", "lang", "n_chars"))
        out: list[tuple[list, list[int]]] = [([], []), ([], [])]
        for y, views in got:
            for to, label in enumerate((y // 4, y % 4)):
                if label < 3:
                    out[to][0].append(views[to])
                    out[to][1].append(label)
        return out
    return pick


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          sample_rows: int = 4000, pool_rows: int = 4000, seed: int = 1, sure: float = 0.9) -> Views | None:
    """Fit on ``docs`` and ``labels`` (doc_id, label 0 or 1; null labels and ids are left out, of several for one id the least counts).

    Every row of ``docs`` without a label, also one without an id, may get a pseudo-label in each round."""
    have = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("y"))
    part = F.pmod("u", F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / max(have.count(), 1)) * (1 << 30)))
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    # the sample's expected size is given, the limit binds it; it is a few bytes a row before texts are met
    chosen = have.withColumn("u", F.xxhash64(F.lit(seed), "id")).where(part).limit(int(1.25 * sample_rows))
    seen = d.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    rows = _features(seen.select("u", "y", "t", "source", "lang", "n_chars"))
    return co_train([r for _, r in rows], np.array([y for y, _ in rows], np.int64), _pick_over(d, have, pool_rows, sure, seed), sure=sure, seed=seed)


def score(docs: DataFrame, model: Views | None, keep: list[Column], text: str = "text", min_score: float = 0.5) -> DataFrame:
    """``keep`` with p_text, p_meta, score and kept (score >= ``min_score``) of every row.

    A null text is scored as the empty one; null metadata are values of their own. Without a model (fewer than two
    labelled classes) the probabilities are null and everything is kept. Repeated rows are rows; an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text).alias("_t"), F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("n_chars").cast("long").alias("_n"))
    fields = src.schema.fields[:-4]
    out = StructType([*fields, *[StructField(n, DoubleType()) for n in ("p_text", "p_meta", "score")], StructField("kept", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = shared.value, len(fields)
        for b in batches:
            own = [m.scores(*r) if m else (None, None, None) for r in zip(*(c.to_pylist() for c in b.columns[k:]))]
            kept = [s[2] is None or s[2] >= min_score for s in own]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *[pa.array([s[i] for s in own], pa.float64()) for i in range(3)],
                                              pa.array(kept, pa.bool_())], names=out.names)

    return src.mapInArrow(run, out)
