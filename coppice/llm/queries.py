"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table
from ..sources.shared import shared_dir
from . import chains, collocations, decontamination, factorization, licenses, logbloom, media, packing, resampling, secrets, simhash, sql, suffixes, warc


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbloom.scores(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def vocabulary() -> str:
    """Path of the public tokenizer's vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media(table(spark, sf_dir, "documents"), hashes=False)).drop("intact")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(spark, sf_dir, "documents"), vocabulary())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    records = lambda kind, payload: warc.read(spark, path, payload).where(F.col("record_type") == kind)
    # of what a response holds, else of what a revisit says of its response
    answers = records("response", True).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    visits = records("revisit", False).select("page_id", F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", F.col("headers")["warc-refers-to-page-id"].cast("long").alias("refers_to"))
    return answers.unionByName(visits)


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.deduplicate(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_media_columns": op4_media_columns,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_toxicity_chain": op10_toxicity_chain,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_suffix_dedup": op13_suffix_dedup,
}

SQL: dict[str, str] = dict(sql.SQL)
