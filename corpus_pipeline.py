"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import decontamination, near_dedup, packing, quality_rules, secrets


def _key(*columns: str) -> Column:
    """A hash of the columns in which nulls are values, too; rows with one key are alike in all of them."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def _free(docs: DataFrame, name: str = "_row") -> str:
    """A column name that docs hasn't, in either case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep. Each row is judged by its own text, whatever its doc_id, which may be null."""
    row = _free(docs)
    keyed = docs.withColumn(row, _key("doc_id", "text", "lang", "source"))
    kept = quality_rules.judged(keyed.select(F.col(row).alias("doc_id"), "lang", "source", "text")).where("kept")
    return keyed.join(kept.select(F.col("doc_id").alias(row)).distinct(), row, "left_semi").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the least doc_id; all its texts that differ stay, identical ones once. Rows with a null doc_id are linked with nothing and all stay."""
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns)
    row = _free(docs)
    one = named.withColumn(row, _key("doc_id", "text")).dropDuplicates([row]).select(docs.columns)
    return one.union(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into whose text no benchmark item leaks, whatever their doc_id, which may be null."""
    row = _free(docs)
    keyed = docs.withColumn(row, _key("text"))
    found = decontamination.leaks(keyed.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars counts the text that is left."""
    return secrets.mask_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", apply_quality_rules),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the estimates of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
