"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sablespan.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.embeddings import embedding_components

    return embedding_components(table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.language import languages

    return languages(table(spark, sf_dir, "documents"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.private import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablespan.llm.conversations import damaged, repaired

    return repaired(damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from sablespan.llm.embeddings import EMBEDDINGS_SQL
    from sablespan.llm.hard_negatives import HARD_NEGATIVES_SQL
    from sablespan.llm.mixing import MIXING_SQL
    from sablespan.llm.topk import TOPK_SQL

    return {"op2_embedding_caps": EMBEDDINGS_SQL, "op3_mix_sources": MIXING_SQL, "op4_top_k": TOPK_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL}
