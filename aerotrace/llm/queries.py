"""Queries of the training-data operators over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from . import avi, dedup, langid, mixing, pii, toxicity, urls
from .packing import packed_documents
from .simhash import simhash_components
from .tokens import token_digests


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), end_id=2)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.text_media(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), end_id=1)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with dedup.DigestIndex(spark) as index:
        return dedup.deduplicate_backwards(documents(spark, sf_dir), index)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(documents(spark, sf_dir), key="production-key-1")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_tokens": op2_tokens,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_language": op5_language,
    "op6_media": op6_media,
    "op7_packing": op7_packing,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
}
SQL: dict[str, str] = {"op9_mixing": mixing.SQL, "op10_exact_dedup": dedup.SQL}
