"""Queries of the corpus operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import codes, decontaminate, embeddings, exact, html_text, language, lm_score, minhash, mixing, suffix, toxicity, urls, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal(_table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(_table(spark, sf_dir, "pages"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(_table(spark, sf_dir, "documents"), digest=True)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_lm_score": op5_lm_score,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_html_text": op8_html_text,
        "op9_language_id": op9_language_id,
        "op10_toxicity": op10_toxicity,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.ORACLE,
        "op2_embedding_near_dedup": embeddings.ORACLE,
        "op3_decontaminate": decontaminate.ORACLE,
        "op5_lm_score": lm_score.ORACLE,
        "op6_minhash_near_dedup": minhash.ORACLE,
        "op7_url_filter": urls.oracle(),
        "op12_exact_dedup": exact.ORACLE,
        "op13_vector_codes": codes.oracle(),
    }
