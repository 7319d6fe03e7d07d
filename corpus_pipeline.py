"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. Docs have the columns of documents, and may have more. All but the last return them. What a stage keeps does not depend on row order.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.llm import langid, sp_codec
from srcgraph.llm.common import fold, of, rows, unrow
from srcgraph.llm.line_dedup import dedup_lines
from srcgraph.llm.mixing import mix, repeat_by_times
from srcgraph.llm.near_dedup import drop_near_duplicates
from srcgraph.session import scratch_path

TOKENIZER = os.environ.get("SP_MODEL_FILE", "/opt/tokenizers/piece_bpe_32k.model")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows: texts whose n-grams are as common as in held-out texts of the languages learnt, however
    many these are. Texts without a letter go.

    It learns from the rows with a label whose crc32(doc_id) mod 3 is not 1. Where there is nothing to learn from
    (no labels), no language is known, so nothing is kept."""
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    r = rows(docs)
    told = langid.predict(r.withColumn("text", of(docs.columns, "text")), model, [F.col(c) for c in r.columns])
    return unrow(told.where("known"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that at least ten documents hold; n_chars is that of the new text."""
    c = docs.columns
    d = dedup_lines(rows(docs).withColumns({"doc_id": of(c, "doc_id"), "text": of(c, "text")}))
    text = F.when(of(c, "text").isNull(), None).otherwise(F.col("kept_text"))
    new = {"text": text, "n_chars": F.coalesce(F.char_length(text), of(c, "n_chars")).cast(docs.schema["n_chars"].dataType)}
    return unrow(d, c, **new).select(*[F.col(f"`{x}`") for x in c])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return drop_near_duplicates(docs)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: domains, languages and sources alike, as many tokens as there are, no document more than twice.

    A document that is to be read twice stands there twice."""
    c, r = docs.columns, rows(docs)
    mixed = mix(r.withColumns({x: of(c, x) for x in ("doc_id", "text", "lang", "source")}), budget_share=1.0, max_epochs=2, seed=1)
    return unrow(repeat_by_times(mixed, r.columns), c)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens; parity and round_trip say that sentencepiece agrees and that ids give the text back."""
    e = sp_codec.encode(docs, TOKENIZER, [F.col("doc_id"), F.col("source"), F.col("lang")])
    return e.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("sources", sources), ("tokens", tokens)]

#: Language ID, MinHash and tokens cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
