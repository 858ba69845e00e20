"""Registered queries of this subpackage: thin contracts over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, flac, language, line_dedup, lm, pieces, simhash, token_files, toxicity, url_filters
from ..shipping import ship
from .common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.classify(docs, labels, fold(docs["doc_id"], 3) == 1)


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm.score(docs, fold(docs["doc_id"], 5) == 1)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digest(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {"op1_language_id": op1_language_id, "op2_toxicity": op2_toxicity, "op3_sentencepiece": op3_sentencepiece, "op4_token_files": op4_token_files, "op5_lm_scoring": op5_lm_scoring, "op6_decontamination": op6_decontamination, "op7_media_flac": op7_media_flac, "op8_line_dedup": op8_line_dedup, "op9_simhash": op9_simhash, "op10_url_filters": op10_url_filters}


def oracle_sql() -> dict[str, str]:
    return {}
