"""Token counts (11) of whole texts; huge ones as overlapping chunks that are spliced where they are proven to agree.

Texts of up to ``chunk`` bytes are encoded whole, where they stand. A longer one is cut into chunks of ``chunk``
characters, each with ``overlap`` characters of the next. Chunks are rows, so a huge text's work is spread over all tasks, and
equal chunks of equal texts are encoded once. Each chunk is encoded with offsets and reports, for the overlaps at
its two ends, where words (the pre-tokeniser's pieces, inside which all merges happen) begin and how many
tokens lie before. Neighbours are then spliced at a word boundary that both report.

Why such a boundary is stable: the pre-tokeniser matches from left to right without looking back, so what it finds
from a boundary on depends on the text from there on alone. The first chunk is right from its beginning up to
``margin`` characters before its end (no match looks further ahead, and no added token is longer). If it is right up to
a boundary that the next chunk reports as well, that chunk is right from there on. By induction all are.

Where two neighbours share no boundary (one word as long as the overlap), the text is cut again with chunks and
overlaps ``WIDEN`` times as long, until the splices hold; a text that fits one chunk needs none. Tokenisers for which the proof
does not hold (a normaliser, a prefix space, added tokens that take spaces along) encode whole texts.

Shuffled: the chunks of huge texts once per round, and rows of a key and a count. An empty table gives an empty result,
null and empty texts have no token, repeated rows are rows, and the columns in ``keep`` are passed on unread, whatever their names.
"""
from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from srcgraph.session import materialize

CHUNK, OVERLAP, WIDEN = 1 << 16, 1 << 9, 4
BATCH_CHARS = 1 << 20
LOOK_AHEAD = 3  # characters from a match's beginning that its alternatives may look at, beyond the one after its end


@lru_cache(maxsize=2)
def _tokenizer(raw: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(raw)
    t.no_truncation()
    t.no_padding()
    return t


def margin(raw: str) -> int | None:
    """How far before a chunk's end its words are certain; None where texts must not be cut."""
    j = json.loads(raw)
    pre, added = j.get("pre_tokenizer") or {}, j.get("added_tokens") or []
    plain = (j.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added))
    return max([LOOK_AHEAD, *[len(a["content"]) for a in added]]) + 1 if plain else None


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about BATCH_CHARS bytes, one row at least."""
    at, total, held = 0, 0, []
    for i in range(len(texts)):
        t = texts[i].as_py()
        held.append(t)
        total += len(t)
        if total >= BATCH_CHARS:
            yield at, held
            at, total, held = i + 1, 0, []
    if held:
        yield at, held


def _cut(size: int, lap: int):
    """(key, text) -> (key, no, last, part): the chunks of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for no, begin in enumerate(range(0, max(len(text), 1), size)):
                    end = begin + size + lap
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([no], pa.int64()), pa.array([end >= len(text)]), pa.array([text[begin:end]])],
                        ["key", "no", "last", "part"])
                    if end >= len(text):
                        break

    return run


def _encode(raw: str, size: int, lap: int, sure: int):
    """(key, no, last, part) -> the chunk's tokens, and the word boundaries of its two overlaps with the tokens before each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(raw)
        for b in batches:
            for at, texts in _runs(b.column(3)):
                n, ends = [], [[], [], [], []]
                for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
                    n.append(len(e))
                    word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
                    before = np.flatnonzero((word != np.concatenate([[-2], word[:-1]])) | (word < 0))
                    begin = np.array([o[0] for o in e.offsets], np.int64)[before] if len(before) else before
                    head = begin < lap
                    tail = (begin >= size) & (begin <= size + lap - sure) & (not b.column(2)[at + i].as_py())
                    for to, v in zip(ends, (begin[head], before[head], begin[tail] - size, before[tail])):
                        to.append(v)
                lists = [pa.array(v, pa.list_(pa.int64())) for v in ends]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), b.column(1).slice(at, len(n)), b.column(2).slice(at, len(n)),
                                                  pa.array(n, pa.int64()), *lists],
                                                 ["key", "no", "last", "n", "head_at", "head_n", "tail_at", "tail_n"])

    return run


def _spliced(texts: DataFrame, raw: str, size: int, lap: int, sure: int) -> DataFrame:
    """texts: (key, text). (key, n_tokens), with null for texts that have neighbours without a common boundary."""
    chunks = texts.mapInArrow(_cut(size, lap), "key string, no long, last boolean, part string").dropDuplicates(["key", "no"])
    done = materialize(chunks.mapInArrow(_encode(raw, size, lap, sure), "key string, no long, last boolean, n long, head_at array<long>, "
                                         "head_n array<long>, tail_at array<long>, tail_n array<long>"), "token-chunks")
    behind = done.select("key", (F.col("no") - 1).alias("no"), F.col("head_at").alias("next_at"), F.col("head_n").alias("next_n"))
    pairs = done.where("not last").join(behind, ["key", "no"])
    at = F.get(F.array_intersect("tail_at", "next_at"), F.lit(0))
    here = F.element_at("tail_n", F.array_position("tail_at", F.col("at")).cast("int"))
    there = F.element_at("next_n", F.array_position("next_at", F.col("at")).cast("int"))
    # up to the splice the first of two counts, from there on the second
    seams = pairs.withColumn("at", at).select("key", F.when(F.col("at").isNotNull(), here - F.col("n") - there).alias("n"))
    parts = done.select("key", "n").unionByName(seams)
    return parts.groupBy("key").agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"))


def count_long(texts: DataFrame, raw: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """texts: (key, text), rows of equal key having equal text. (key, n_tokens) for every key, in as many rounds as widening takes."""
    sure = margin(raw)
    if sure is None or overlap > chunk:
        raise ValueError("this tokeniser's texts cannot be cut, or the overlap is longer than a chunk")
    counted, todo, size, lap = None, texts, chunk, overlap
    while True:
        got = materialize(_spliced(todo, raw, size, lap, sure), "token-splices")
        whole = got.where("n_tokens is not null")
        counted = whole if counted is None else counted.unionByName(whole)
        if not got.where("n_tokens is null").take(1):
            return counted
        todo = todo.join(got.where("n_tokens is null").select("key"), "key", "left_semi").select("key", "text")
        size, lap = size * WIDEN, lap * WIDEN


def count_tokens(docs: DataFrame, tokenizer_file: str, keep: list[Column], text: str = "text", chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """``keep`` with n_bytes (of the UTF-8 text) and n_tokens for the whole text of every row, without added special tokens;
    special strings inside texts are tokens as the file says."""
    with open(tokenizer_file, encoding="utf-8") as f:
        raw = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    c = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(*keep, F.octet_length(c).cast("long").alias("_tok_bytes"), c.alias("_tok_text"))
    names = [f"_k{i}" for i in range(len(keep))]
    own = src.schema.fields[:len(keep)]
    src = src.toDF(*names, "_tok_bytes", "_tok_text")
    fields = src.schema.fields[:-1]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(shared.value)
        for b in batches:
            for at, texts in _runs(b.column(len(fields))):
                n = [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*[x.slice(at, len(n)) for x in b.columns[:len(fields)]], pa.array(n, pa.int64())],
                                                 names=[*[f.name for f in fields], "_tok_n"])

    out = StructType([*fields, StructField("_tok_n", LongType())])
    if margin(raw) is None:
        return src.mapInArrow(whole, out).toDF(*[f.name for f in own], "n_bytes", "n_tokens")
    small = src.where(F.col("_tok_bytes") <= chunk).mapInArrow(whole, out)
    huge = src.where(F.col("_tok_bytes") > chunk).withColumn("_tok_key", F.sha2("_tok_text", 256))
    counts = count_long(huge.select(F.col("_tok_key").alias("key"), F.col("_tok_text").alias("text")), raw, chunk, overlap)
    huge = huge.drop("_tok_text").join(counts, F.col("_tok_key") == F.col("key")).select(*[f.name for f in fields], F.col("n_tokens").alias("_tok_n"))
    return small.unionByName(huge).toDF(*[f.name for f in own], "n_bytes", "n_tokens")
