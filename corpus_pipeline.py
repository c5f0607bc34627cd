"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents. Between stages the rows are written as
Parquet in the shared folder and read back. Every stage takes texts of any
length, null and empty ones, repeated rows and empty tables; all but the last
carry columns of any name along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batida.llm import byte_bpe, decontamination, ngram_join, secrets, toxicity
from batida.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.5; null and empty texts stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the least doc_id.

    Word n-grams of 5 and a similarity of 0.8. Rows without a doc_id stay, as
    do texts that are null or without words, which link with nothing; of rows
    that repeat a doc_id the one with the least text, then the least digest of
    the whole row, stays. Columns of any kind are carried along, maps too.
    """
    found = ngram_join.join(docs, n=5, percent=80)
    first = found.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    # a row's digest is of its JSON, which has maps and other kinds that can't be ordered
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct("text", F.sha2(F.to_json(row), 256).alias("digest"))
    kept = docs.join(first, "doc_id", "left_semi").select("doc_id", row.alias("row"), order.alias("order"))
    kept = kept.groupBy("doc_id").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null texts and rows without a doc_id leak nothing and stay."""
    leaked = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows. Null texts stay null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every document; a null text has no ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(docs.select("doc_id", "text", "lang", "source"), path, public_tokenizers.PATTERN, decoded=False).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: No SQL: stages learn from labels, follow links and run an external tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        # a stage's table goes once the next one is written
        docs = before = materialize(stage(spark, docs, sf_dir), instead_of=before)
    return STAGES[-1][1](spark, docs, sf_dir)
