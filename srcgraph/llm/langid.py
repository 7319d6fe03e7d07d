"""Language ID (3): sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of 1 to 4 characters of the lower-cased text (runs of anything but letters are one
space), hashed to 2^18 columns (fewer with more than 64 languages, so that weights are at most 2^24); a value is the n-gram's
share of the text's n-grams times its inverse document frequency. Document frequencies are counted by Spark over all
training rows, per language. The weights are fitted by follow-the-regularised-leader with L1 and L2 penalties on a
bounded, hash-chosen sample of whole training texts (``sample_rows`` in all, and at most SAMPLE_FEATURES distinct n-grams of
texts together: where texts are long, the sample is that much smaller, whatever their length), and a temperature is fitted
on a part of the sample kept out of training. Most weights end at exactly 0. The MAX_CLASSES most frequent labels are learnt.

A text is ``known`` if its n-grams are as common as those of held-out training texts are, each in the language that uses it most. That does
not depend on the number of languages, and a mixture of known languages is known. Ties between languages go to the first in order.

Prediction is one pass over whole texts, without a shuffle; long texts go through in pieces that count every n-gram once.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from srcgraph.session import materialize

DIMS = 1 << 18
ORDERS = (1, 2, 3, 4)
MAX_CLASSES = 1000
MAX_WEIGHTS = 1 << 24
SAMPLE_FEATURES = 1 << 24
SCALE = 20.0  # brings feature vectors to a length of about 1
PIECE = 1 << 18
DEVIATIONS = 6.0  # how far under the held-out texts' mean a known text may lie
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def dims_for(n_classes: int) -> int:
    """The greatest power of two up to DIMS with which the weights of all classes are at most MAX_WEIGHTS; 64 at least."""
    dims = DIMS
    while dims > 64 and dims * n_classes > MAX_WEIGHTS:
        dims //= 2
    return dims


def ngram_ids(text: str, dims: int = DIMS) -> Iterator[np.ndarray]:
    """Feature numbers of the text's n-grams, piece by piece. A piece holds the n-grams that begin in it; it reads on
    by the longest n-gram less one, so that pieces together hold what the whole text does."""
    longest, shift = max(ORDERS), np.uint64(64 - (dims.bit_length() - 1))
    whole = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    for at in range(0, len(whole), PIECE):
        part = whole[at:at + PIECE + longest - 1]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h, out = np.zeros(len(c), np.uint64), []
        for n in range(1, longest + 1):
            h = (h[:max(len(c) - n + 1, 0)] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:] + np.uint64(n)) if n > 1 else c + np.uint64(1)
            if n in ORDERS:
                out.append(((h[:PIECE] * np.uint64(0xFF51AFD7ED558CCD)) >> shift).astype(np.int64))
        yield np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _counts(text: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(x, return_counts=True) for x in ngram_ids(text, dims)]
    if len(parts) == 1:
        return parts[0]
    ids, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return ids, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def document_frequencies(train: DataFrame, label: str, text: str, classes: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """How many training texts of each class hold each feature (dims, classes), and how many texts each class has. At most
    MAX_WEIGHTS sums reach the driver."""
    number = {c: i for i, c in enumerate(classes)}
    width = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros((dims + 1) * width, np.int64), np.zeros(dims, bool)
        for b in batches:
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for ids in ngram_ids(t, dims):
                    seen[ids] = True
                at = np.flatnonzero(seen)
                df[at * width + number[c]] += 1
                df[dims * width + number[c]] += 1
                seen[at] = False
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["f", "n"])

    sums = train.select(label, text).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((dims + 1) * width, np.int64)
    df[sums["f"].to_numpy()] = sums["n"].to_numpy()
    df = df.reshape(dims + 1, width)
    return df[:dims], df[dims]


@dataclass
class Model:
    """classes in order; table[f, c] = weight times inverse document frequency; bias[c]; temperature; common[f]: the logarithm of the
    share of texts that hold an n-gram in the language that uses it most; usual: mean and deviation of held-out texts' mean of common, and
    deviation of single n-grams."""
    classes: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    common: np.ndarray
    usual: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def _sums(self, text: str) -> tuple[np.ndarray, float, int]:
        total, common, n = np.zeros(len(self.classes)), 0.0, 0
        for ids in ngram_ids(text, len(self.table)):
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            common += float(self.common[ids].sum(dtype=np.float64))
            n += len(ids)
        return self.bias + total / max(n, 1), common / max(n, 1), n

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.classes or not has_letter(text):
            return UNKNOWN, 0.0, False
        z, common, n = self._sums(text)
        z = z / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        i = int(np.argmax(p))
        mean, between, within = self.usual
        # n-grams of up to four characters overlap, so four of them count as one
        return self.classes[i], float(p[i]), bool(common >= mean - DEVIATIONS * (between ** 2 + 4 * within ** 2 / n) ** 0.5)


def _nothing() -> Model:
    return Model([], np.zeros((DIMS, 0), np.float32), np.zeros(0), 1.0, np.zeros(DIMS, np.float32))


def fit_ftrl(row: Callable[[int], tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, dims: int, alpha: float = 0.5,
             beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 4, seed: int = 1) -> np.ndarray:
    """Weights (dims, n_classes) by FTRL-proximal, per-coordinate rates, with elastic-net penalties; ``row`` gives row i's features and values."""
    z, n = np.zeros((dims, n_classes)), np.zeros((dims, n_classes))

    def weights(ids: np.ndarray) -> np.ndarray:
        a, b = z[ids], n[ids]
        return np.where(np.abs(a) <= l1, 0.0, -(a - np.sign(a) * l1) / ((beta + np.sqrt(b)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(labels)):
            ids, x = row(i)
            w = weights(ids)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - s * w
            n[ids] += g * g
    return weights(np.arange(dims))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, from 1/20 to 20."""
    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    grid = np.geomspace(0.05, 20, 61)
    return float(min(grid, key=loss)) if len(labels) else 1.0


def train(docs: DataFrame, label: str = "lang", text: str = "text", id_col: str = "doc_id", sample_rows: int = 4000,
          seed: int = 1) -> Model:
    """Fit on all rows of ``docs`` whose label and text are not null. About ``sample_rows`` rows, as many per
    label as there are up to an equal part, chosen by a hash of id and text, serve the fit (a fifth of them the
    temperature and what is usual); frequencies are counted over all rows."""
    spark = docs.sparkSession
    docs = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in docs.groupBy(F.col(label)).count().orderBy(F.desc("count"), label).limit(MAX_CLASSES).collect()}
    classes = sorted(sizes)
    if not classes:
        return _nothing()
    dims = dims_for(len(classes))
    per_class = sample_rows / len(classes)
    rates = spark.createDataFrame([(c, min(1.0, per_class / sizes[c])) for c in classes], "c string, rate double")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    docs = docs.select(F.col(label).cast("string").alias("c"), F.col(text).alias("t"), u.alias("u")).join(F.broadcast(rates), "c")
    by_class, n_docs = document_frequencies(docs, "c", "t", classes, dims)
    idf = np.log((1 + n_docs.sum()) / (1 + by_class.sum(axis=1))) + 1
    common = _common(by_class, n_docs).astype(np.float32)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, t, v in zip(*(b.column(i).to_pylist() for i in range(3))):
                if has_letter(t):
                    ids, k = _counts(t, dims)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c]), pa.array([v]), pa.array([len(ids)], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int32())),
                         pa.array([k.tolist()], pa.list_(pa.int32()))], ["c", "u", "size", "ids", "k"])

    got = materialize(docs.where("u < rate").select("c", "t", "u").mapInArrow(featurise, "c string, u double, size long, ids array<int>, k array<int>"),
                      "langid-sample")
    # the expected number of rows is sample_rows; both limits bound what reaches the driver
    order = got.select("u", "size").orderBy("u").limit(int(sample_rows * 1.25)).toArrow()
    fits = np.flatnonzero(np.cumsum(order["size"].to_numpy()) <= SAMPLE_FEATURES)
    if not len(order):
        return _nothing()
    sample = got.where(F.col("u") <= float(order["u"][int(fits[-1]) if len(fits) else 0].as_py())).orderBy("u").toArrow().combine_chunks()
    y = np.searchsorted(classes, sample["c"].to_pylist())
    ids, k = (sample[c].chunk(0) for c in ("ids", "k"))
    start, ids, k = ids.offsets.to_numpy(), ids.values.to_numpy(), k.values.to_numpy()

    def features(i: int) -> tuple[np.ndarray, np.ndarray]:
        f, x = ids[start[i]:start[i + 1]], k[start[i]:start[i + 1]].astype(np.float64)
        return np.append(f, dims), np.append(SCALE * x / x.sum() * idf[f], 0.1)  # the last column is the bias

    held = np.arange(len(y)) % 5 == 4
    fit, out = np.flatnonzero(~held), np.flatnonzero(held)
    w = fit_ftrl(lambda i: features(fit[i]), y[fit], len(classes), dims + 1, seed=seed)
    logits = np.array([x @ w[f] for f, x in map(features, out)]).reshape(-1, len(classes))
    t = fit_temperature(logits, y[out])
    look = out if len(out) else fit
    usual = _usual(((by_class[ids[start[i]:start[i + 1]]], k[start[i]:start[i + 1]], y[i]) for i in look), n_docs)
    return Model(classes, (SCALE * w[:dims] * idf[:, None]).astype(np.float32), 0.1 * w[dims], t, common, usual)


def _common(by_class: np.ndarray, n_docs: np.ndarray) -> np.ndarray:
    return np.log((by_class + 0.5) / (n_docs + 1)).max(axis=1)


def _usual(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], n_docs: np.ndarray) -> tuple[float, float, float]:
    """Mean and deviation over texts of their mean of ``common``, and the deviation of single n-grams inside texts. A row is the frequencies of a text's
    n-grams, how often it holds them, and its class; the text itself is taken out of the frequencies."""
    means, inside = [], []
    for df, n, c in rows:
        own = np.arange(len(n_docs)) == c
        v = _common(df - own, n_docs - own)
        m = float((v * n).sum() / n.sum())
        means.append(m)
        inside.append(float(((v - m) ** 2 * n).sum() / n.sum()))
    return float(np.mean(means)), float(np.std(means)), float(np.mean(inside)) ** 0.5


def predict(docs: DataFrame, model: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` with lang_pred, score and known for the whole text of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text).alias("_langid_text"))
    fields = src.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(len(fields)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(fields)], *[pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]],
                names=[*[f.name for f in fields], "lang_pred", "score", "known"])

    return src.mapInArrow(run, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                                           StructField("known", BooleanType())]))


def identify(docs: DataFrame, learn: Column, keep: list[Column], label: str = "lang", text: str = "text", id_col: str = "doc_id",
             **how) -> DataFrame:
    """Train on the rows where ``learn`` holds and predict every row.

    Null texts and texts without a letter are ``und`` with score 0 and not known, as is everything where nothing can be learnt
    (an empty table, no labels). Rows with a null label or text are not learnt from. Repeated rows are rows.
    """
    return predict(docs, train(docs.where(learn), label, text, id_col, **how), keep, text)
