"""From raw documents to token counts: quality rules, near-duplicates, personal data, source mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import bpe, mixing, pii, quality, queries, simhash
from bitloom.llm.common import cut, drop, stage
from bitloom.sources.shipping import ship


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ship(spark)
    return quality.keep_good(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, that of the smallest id. Links are those of the op1 query, and of one more
    fingerprint of the same kind."""
    ship(spark)
    return simhash.keep_first(docs)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind, disguised or not."""
    ship(spark)
    return pii.mask(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix of their sources takes them."""
    ship(spark)
    mixed, _ = mixing.mix(docs)
    return mixed.select(*[f"`{c}`" for c in docs.columns])


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    ship(spark)
    return bpe.digests(docs, queries.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: The vote model, SimHash and BPE are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again, as a rerun after a loss needs."""
    docs, held = queries.documents(spark, sf_dir), None
    for _, step in STAGES[:-1]:
        kept = cut(step(spark, docs, sf_dir))
        if held is not None:
            drop(held)
        docs = held = kept
    return STAGES[-1][1](spark, docs, sf_dir)
