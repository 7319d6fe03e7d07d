"""SentencePiece encoding and decoding (6) on the tokenizers library.

The model file's protobuf is parsed here; from it are rebuilt the normaliser (its precompiled character map, space
rules, dummy prefix), the metaspace marker, the model (unigram with the pieces' scores, or merges in the order
of the scores for a BPE model) and the byte fallback. Batches are encoded with several threads. Every row is encoded
by sentencepiece itself too, and the result says whether both agree (``parity``), and whether decoding gives the
normalised text back (``round_trip``). No shuffle: one pass over whole texts, the model's bytes are broadcast (a
vocabulary file of fixed size). Batches are cut by characters, so memory does not grow with the table.
"""
from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

# Numbers of the public sentencepiece_model.proto.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
BATCH_CHARS = 1 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values come as their bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[at:at + n]
        at += n


@dataclass
class SpModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape: bool = True

    @property
    def lossless(self) -> bool:
        """Normalising changes nothing but spaces into markers."""
        return not self.charsmap and not self.trim_spaces

    @property
    def marks_begin_words(self) -> bool:
        """No piece has a marker behind another character, so words can be encoded one by one."""
        return not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED))


def parse_model(raw: bytes) -> SpModel:
    m = SpModel()
    for number, value in _fields(raw):
        if number == 1:
            d = dict(_fields(value))
            m.pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
        elif number == 2:
            d = dict(_fields(value))
            m.kind, m.byte_fallback, m.suffix = d.get(3, UNIGRAM), bool(d.get(35, 0)), bool(d.get(24, 0))
        elif number == 3:
            d = dict(_fields(value))
            m.charsmap = d.get(2, b"")
            m.dummy_prefix, m.trim_spaces, m.escape = (bool(d.get(i, 1)) for i in (3, 4, 5))
    if m.kind not in (UNIGRAM, BPE) or m.suffix or not m.escape:
        raise ValueError("only unigram and BPE models with a leading metaspace marker can be rebuilt")
    return m


def merges_of(m: SpModel) -> list[tuple[str, str]]:
    """Every way to put a piece together from two others, best piece first."""
    ids = {p: i for i, (p, _, t) in enumerate(m.pieces) if t in (NORMAL, USER_DEFINED)}
    found = []
    for p, score, t in m.pieces:
        if t in (NORMAL, USER_DEFINED) and len(p) > 1:
            found += [(-score, ids[p], ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
    return [x[4:] for x in sorted(found)]


def build(m: SpModel, prefix: bool = True):
    """A tokenizers.Tokenizer that does what the model does; ``prefix`` False: for the later parts of a cut text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unk = next(i for i, x in enumerate(m.pieces) if x[2] == UNKNOWN)
    if m.kind == UNIGRAM:
        low = min((s for _, s, t in m.pieces if t == NORMAL), default=0.0) - 10.0
        score = {NORMAL: lambda s: s, USER_DEFINED: lambda s: 0.0}
        model = models.Unigram([(p, score.get(t, lambda s: low)(s)) for p, s, t in m.pieces], unk_id=unk, byte_fallback=m.byte_fallback)
    else:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges_of(m), unk_token=m.pieces[unk][0],
                           fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    norm = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim_spaces:
        norm += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    norm += [normalizers.Prepend(MARK)] if m.dummy_prefix and prefix else []
    t.normalizer = normalizers.Sequence([*norm, normalizers.Replace(" ", MARK)])
    # no pre-tokeniser: the model sees the whole marked text, as in sentencepiece (and is faster so)
    strip = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return t


def cut(text: str, size: int = BATCH_CHARS) -> list[str]:
    """A text in parts of about ``size`` characters, each but the first beginning with a space that follows none."""
    parts, at = [], 0
    while len(text) - at > size:
        i = text.find(" ", at + size)
        while i >= 0 and text[i - 1] == " ":
            i = text.find(" ", i + 1)
        if i < 0:
            break
        parts.append(text[at:i])
        at = i
    return [*parts, text[at:]]


@lru_cache(maxsize=2)
def codec(raw: bytes, threads: int) -> "Codec":
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    return Codec(raw)


class Codec:
    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = parse_model(raw)
        from tokenizers import decoders

        self.first, self.later = build(self.model), build(self.model, prefix=False)
        # decodes to the marked text; the markers are then replaced in the whole text instead of piece by piece
        self.later.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        # a marker that is put together from bytes stays one: it begins with this byte
        self.mark_byte = next((i for i, (p, _, t) in enumerate(self.model.pieces) if t == BYTE and p == f"<0x{MARK.encode()[0]:02X}>"), -1)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.cuts = self.model.lossless and self.model.marks_begin_words

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; texts go to the library in batches of about BATCH_CHARS characters."""
        batch: list[str] = []
        for t in [*texts, None]:
            if batch and (t is None or sum(map(len, batch)) + len(t) > BATCH_CHARS):
                for e in self.first.encode_batch_fast(batch, add_special_tokens=False):
                    yield e.ids
                batch = []
            if t is not None and len(t) > BATCH_CHARS and self.cuts:
                one, *more = cut(t)
                yield [i for x, part in [(self.first, one), *[(self.later, p) for p in more]]
                       for i in x.encode(part, add_special_tokens=False).ids]
            elif t is not None:
                batch.append(t)

    def decode(self, ids: list[list[int]]) -> list[str]:
        texts = [t.replace(MARK, " ") for t in self.later.decode_batch(ids, skip_special_tokens=False)]
        if self.model.dummy_prefix:
            texts = [t[1:] if t.startswith(" ") else t for t in texts]
        rare = [i for i, x in enumerate(ids) if self.mark_byte in x]
        for i, t in zip(rare, self.first.decode_batch([ids[i] for i in rare], skip_special_tokens=False)):
            texts[i] = t
        return texts

    def normalised(self, text: str) -> str:
        """What decoding should give back."""
        return text.replace(MARK, " ") if self.model.lossless else self.sp.decode(self.sp.encode(text))


def encode(docs: DataFrame, model_file: str, keep: list[Column], text: str = "text", threads: int = 2, check: bool = True) -> DataFrame:
    """``keep`` with ids (array<int>), parity and round_trip for the whole text of every row.

    A null or empty text has no ids. With ``check`` False parity and round_trip are null. Repeated rows are rows;
    an empty table gives an empty result.
    """
    with open(model_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_sp_text"))
    fields = src.schema.fields[:-1]
    out = StructType([*fields, StructField("ids", ArrayType(IntegerType())), StructField("parity", BooleanType()),
                      StructField("round_trip", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(raw.value, threads)
        for b in batches:
            for at, n in _slices(b.column(len(fields))):
                texts = b.column(len(fields)).slice(at, n).to_pylist()
                ids = list(c.encode(texts))
                parity = [x == y for x, y in zip(ids, c.sp.encode(texts, num_threads=threads))] if check else [None] * n
                back = [x == c.normalised(t) for x, t in zip(c.decode(ids), texts)] if check else [None] * n
                yield pa.RecordBatch.from_arrays(
                    [*[x.slice(at, n) for x in b.columns[:len(fields)]], pa.array(ids, pa.list_(pa.int32())), pa.array(parity, pa.bool_()),
                     pa.array(back, pa.bool_())], names=out.names)

    return src.mapInArrow(run, out)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of about BATCH_CHARS bytes."""
    size = np.diff(texts.offsets.to_numpy()) if hasattr(texts, "offsets") else np.array([len(t or "") for t in texts.to_pylist()])
    at = total = 0
    for i, s in enumerate(size):
        total += int(s)
        if total >= BATCH_CHARS or i == len(size) - 1:
            yield at, i + 1 - at
            at, total = i + 1, 0


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids`` in the column ``text`` (which replaces one of that name); null ids: null."""
    with open(model_file, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def back(x):
        import pandas as pd
        c = codec(raw.value, 2)
        got = c.decode([[] if i is None else [int(j) for j in i] for i in x])
        return pd.Series([None if i is None else t for i, t in zip(x, got)])

    return encoded.withColumn(text, back(F.col(ids)))
