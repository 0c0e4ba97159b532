"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import bpe, chat, language, mixing, pii, quality, sharding, simhash, topk, toxicity
from bitloom.llm.common import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work on whole texts."""
    return spread(table(spark, sf_dir, "documents"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.dedup_classes(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.QUOTING).alias("text"))
    return chat.digest(chat.format_conversations(turns.unionByName(quoting)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as they are taken, in (pass, block, draw) order of their source."""
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "pass", "block", "draw")


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_pii": op3_pii,
        "op4_toxicity": op4_toxicity,
        "op5_exact_topk": op5_exact_topk,
        "op6_bpe": op6_bpe,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_language": op8_language,
        "op9_mixing": op9_mixing,
        "op10_hilbert_sharding": op10_hilbert_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk": topk.ORACLE, "op7_chat_formatting": chat.ORACLE}
