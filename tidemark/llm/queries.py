"""The registered query of each operator, over its whole tables, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, embedding_whitening, html_text, jaccard_join, language_model, lexical_search, mixing, quality, quality_rules, secret_scan, token_files, topk_search, toxicity
from tidemark.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this installation keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


def op2_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.top_k(table(spark, folder, "embeddings"))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, folder, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_whitening.whitened_components(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_topk_search": op2_topk_search,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality": op4_quality,
    "op5_token_files": op5_token_files,
    "op6_decontamination": op6_decontamination,
    "op7_html_text": op7_html_text,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_quality_rules": op11_quality_rules,
    "op12_lexical_search": op12_lexical_search,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE = {
    "op2_topk_search": topk_search.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
