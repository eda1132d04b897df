"""Shared folders, materialised tables and label splits for the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The C library's way to give freed memory back, where it has one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Words are runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/aerotrace/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null. Pure ASCII takes the faster built-in with the same result."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids have null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sampled(labels: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About `bound` rows of labels at most, chosen by a seeded hash of the key; all of them if there are fewer."""
    n = labels.count()
    if n <= bound:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def bounded(rows: DataFrame, key: str, text: str, chars: int, seed: int) -> DataFrame:
    """Of a sample's rows about as many as have `chars` characters of text together, chosen by a seeded hash of the key."""
    n, least = rows.agg(F.sum(F.length(text)), F.min(F.xxhash64(F.col(key), F.lit(seed)))).first()
    if (n or 0) <= chars:
        return rows
    return rows.where((F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * chars / n)) | (F.xxhash64(F.col(key), F.lit(seed)) == least))


def packed(docs: DataFrame) -> Column:
    """All columns as one struct, so that names of an operator's own can't clash with them; unpack with whole.*"""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def release() -> None:
    """At the end of a task: freed Arrow memory goes back to the system, as idle workers are kept."""
    pa.default_memory_pool().release_unused()


def trim() -> None:
    """After learning on the driver: what was freed goes back to the system."""
    release()
    if TRIM:
        TRIM(0)
