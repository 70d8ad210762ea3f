"""From documents to packed training sequences, one operator a stage.

Every stage but the last takes and returns the columns of documents; a column of another name, whatever it
is, stays as it is. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import language, minhash, packing, repeats, toxicity
from logloom.llm.common import checkpointed, learnable


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are likelier toxic than not (a score of 0.5 or more).

    A null or empty text is scored like any other; rows without an id are scored but not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.where(learnable(F.col("doc_id"))), labels.where(learnable(F.col("doc_id"))))
    scored = model.scored(docs.select(F.struct(*named(docs)).alias("record"), "text"))
    return scored.where("score < 0.5").select("record.*")


def in_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of no known language (null texts and such without a letter too), or of none as likely as not (a score below 0.5).

    Rows without an id are judged but not learned from."""
    model = language.fit(docs.where(learnable(F.col("doc_id"))))
    found = docs.select(F.struct(*named(docs)).alias("record"), language.predicted(F.col("text"), model, spark).alias("found"))
    return found.where((F.col("found.lang") != "und") & (F.col("found.score") >= 0.5)).select("record.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles 0.8 alike, and what they reach), the document of the smallest id.

    Rows that repeat an id with another text are documents of their own; of rows that repeat both one stays."""
    return minhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a character that a cut goes through goes whole.

    A document of which nothing is left stays as an empty text; rows without an id stay whole. The number of
    characters follows the text where there is such a column."""
    left = repeats.without_repeats(docs, characters=True)
    cut, text = F.size("spans") > 0, F.col("kept").cast("string")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return left.select(*[F.when(cut, new[c]).otherwise(F.col(f"record.`{c}`")).alias(c) if c in new else F.col(f"record.`{c}`") for c in docs.columns])


def named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; a null or empty text is the end id alone."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", clean), ("language", in_language), ("simhash", one_of_each), ("repeats", without_repeats), ("packing", packed)]
#: Trained models and tokenizers aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpointed(docs) if k else docs, sf_dir)
    return docs
