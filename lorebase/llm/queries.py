"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, language_id, near_dedup, packing, parity_join, perplexity, quality_rules, secrets, sharding, sql, substring_dedup, tool_calls, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted: labelled as good and not as toxic."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return perplexity.classified(_table(spark, sf_dir, "documents"), trusted)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = language_id.fit(docs.where(~held_out & F.col("lang").isNotNull()))
    out = language_id.identify(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: A question is asked of the one who answers; texts of over 400 characters aren't taken.
SCHEMAS = {"ask": {"type": "object", "required": ["n_chars", "text"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "n_chars": {"type": "integer", "minimum": 1}}}}


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no tool calls, so each user's turn is read as a call, which depends on the call at half its turn; the assistant's next turn is its result."""
    turns = _table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    arguments = F.to_json(F.struct(F.col("text"), F.length("text").alias("n_chars")))
    half = F.expr("turn div 2")
    calls = turns.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("ask").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") > 0, F.array(name(half))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return tool_calls.linked(calls, results, SCHEMAS)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"), 24)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_perplexity, op3_language_id, op4_quality_rules, op5_secrets, op6_packing, op7_tool_calls, op8_decontamination, op9_substring_dedup, op10_sharding, op11_alignment, op12_parity_join, op13_whitening, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": sql.NEAR_DEDUP, "op7_tool_calls": sql.TOOL_CALLS, "op9_substring_dedup": sql.SUBSTRING_DEDUP, "op12_parity_join": sql.PARITY_JOIN}
