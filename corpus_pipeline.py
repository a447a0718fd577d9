"""A corpus pipeline of the training-data operators: quality, near copies, benchmark leaks, secrets, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import decontamination, factorization, packing, secrets, simhash
from coppice.llm.queries import vocabulary
from coppice.registry import table
from coppice.sources.shared import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    scored = factorization.classify(docs, table(spark, sf_dir, "labels"), keep=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 1").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return simhash.deduplicate(docs.select(COLUMNS))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars as the texts are then."""
    out = secrets.redact(secrets.scan(docs.select(COLUMNS)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of tokens."""
    return packing.sequences(docs, vocabulary())


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", leaks), ("secrets", masked), ("packing", packed)]

#: The classifier, SimHash and the tokenizer can't be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn from documents, each written as Parquet to the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
