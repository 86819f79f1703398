"""From raw documents to token ids: toxic texts out, one of each group of near copies, secrets out, sources mixed, encoded.

Each stage takes what the one before it kept, as Parquet. Documents that are not rejected pass the filtering stages
unchanged; a secret in a text is replaced by a mark; the mix takes runs of words, so a document may come back as
several rows, or as none where its source is above its target.

Cases: a null or empty text is scored as a window without words, links with nothing, holds no secret, and takes nothing in the
mix, so it ends there; rows of one doc_id are one document, of which the row of the least text stays, and rows of null
doc_id all stay; equal texts are one group, of which the least doc_id stays; a null source is a source of its own; an
empty table stays empty; labels without both classes reject all or nothing, by their share; further columns are carried
through, and ``n_chars``, where there is one, is kept up to date.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytebpe, mixing, secrets, shingles, textkit, toxicity
from graphloom.plans.staging import stage, unstage


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.small_batches(spark)
    return toxicity.accept(docs, toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.small_batches(spark)
    return shingles.one_of_each_class(docs)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.small_batches(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.small_batches(spark)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.small_batches(spark)
    return bytebpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids_too=True)


STAGES = [("toxicity", toxic_out), ("n-gram Jaccard join", near_copies_out), ("secret scans", secrets_out), ("mixing sources", mixed), ("byte-level BPE", encoded)]
#: The first stage's network can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs, before = stage(function(spark, docs, sf_dir)), docs
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
