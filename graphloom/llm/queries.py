"""The queries of this subpackage, with SQL where it can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import (
    covering_simhash,
    impact_index,
    jump_shards,
    langmix,
    mixture_tree,
    prefix_bpe,
    quality_gbdt,
    repetition,
    toxicity,
    warc,
)
from graphloom.llm.common import table


def op1_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gbdt.score(docs, quality_gbdt.train(spark, docs, table(spark, sf_dir, "labels")))


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.top_k(table(spark, sf_dir, "embeddings"))


def op5_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(spark, docs, table(spark, sf_dir, "labels")))


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.shard_rows(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_decode(table(spark, sf_dir, "documents"))


def op8_mixture_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_tree.taken(table(spark, sf_dir, "documents"))


def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langmix.identify(docs, langmix.learn(docs))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_quality_gbdt, op2_repetition_rules, op3_warc_transactions, op4_impact_top_k, op5_toxicity_lexicon,
            op6_jump_shards, op7_sentencepiece, op8_mixture_tree, op9_covering_simhash, op10_language_mixture,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_transactions": warc.SQL, "op4_impact_top_k": impact_index.SQL, "op8_mixture_tree": mixture_tree.SQL}
