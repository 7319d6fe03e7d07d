"""Token counts against the library on whole texts."""
import random

import public_tokenizers as P
import pytest
from cases import awkward, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from srcgraph.llm import queries as Q
from srcgraph.llm.token_counts import count_long, count_tokens, margin

FILE = P.path("byte_bpe_50k.json")


def long_texts(seed=3):
    """Runs of white space, contractions, specials, accents, emoji and words longer than any overlap."""
    r = random.Random(seed)
    bits = ["we're", "they'll", " ", "  ", "\n\n", "\t \r\n", "<|endoftext|>", "<|endof", "text|>", "'", "''s", "é日本語", "🙂👍🏽", "x" * 70, "12345",
            "...!!!", "hello", "world", " ", "  ", "á", "_", "'re", "<", "|"]
    texts = ["".join(r.choice(bits) + r.choice(["", "", " "]) for _ in range(r.randint(50, 400))) for _ in range(25)]
    return texts + ["a" * 5000, " " * 4000, "ab " * 900, "'" * 3000, "é" * 2500, "<|endoftext|>" * 200]


def whole(texts, file=FILE):
    t = Tokenizer.from_file(file)
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


@pytest.mark.parametrize("chunk,overlap", [(100, 24), (64, 64), (333, 40)])
def test_spliced_counts(spark, chunk, overlap):
    texts = long_texts()
    raw = open(FILE, encoding="utf-8").read()
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] * 2, "key string, text string").repartition(5)
    got = {r.key: r.n_tokens for r in count_long(df, raw, chunk, overlap).collect()}
    assert [got[str(i)] for i in range(len(texts))] == whole(texts) and len(got) == len(texts)


def test_awkward_table(spark):
    rows = awkward(11) + [(500 + i, t, "en", "a", 1) for i, t in enumerate(long_texts(4))]
    df = table(spark, rows, clash=True).withColumn("n_tokens", F.lit("own")).withColumn("key", F.lit(1)).withColumn("_tok_text", F.lit(2))
    got = count_tokens(df, FILE, [F.col("doc_id"), F.col("key"), F.col("_tok_text")], chunk=500, overlap=60)
    want = sorted((str(r[0]), len((r[1] or "").encode()), n) for r, n in zip(rows, whole([r[1] for r in rows])))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert got.columns == ["doc_id", "key", "_tok_text", "n_bytes", "n_tokens"]
    assert count_tokens(table(spark, []), FILE, [F.col("doc_id")]).count() == 0


def test_tokenisers_that_cannot_be_cut(spark):
    other = P.path("word_bpe_49k.json")
    assert margin(open(other, encoding="utf-8").read()) is None
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(long_texts(5))]
    got = count_tokens(table(spark, rows), other, [F.col("doc_id")], chunk=100, overlap=20)
    assert [r.n_tokens for r in got.orderBy("doc_id").collect()] == whole([r[1] for r in rows], other)


def test_query(spark):
    got = Q.REGISTRY["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(docs)
    assert sorted(r.doc_id for r in got) == ids
    by = {r.doc_id: r for r in got}
    assert [by[i].n_tokens for i in ids] == whole([docs[i] for i in ids])
    assert all(r.over_limit == (r.n_tokens > 1024) and r.n_bytes == len((docs[r.doc_id] or "").encode()) for r in got)
