"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last one adds ``piece_ids``. ``run`` writes each stage's
result to the shared folder and reads it back for the next one, so a lost executor
costs no more than the stage it was lost in; what a stage settled on its way is deleted
when its result is there.

Defined results, for every stage: rows without an id or with a shared one are judged by
their own text; a null or empty text is never toxic and holds no benchmark item, and all
of them are copies of each other; rows of one id and text stay or go together; of equally
good copies the one with the smallest id stays, null ids last; empty tables of documents,
labels or items give no rows, no toxic documents and no leaks; columns besides those of
``documents`` are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, line_dedup, pieces, simhash, toxicity
from waymark.llm.common import discard, materialize, scratch
from waymark.shipping import ship

VOCABULARY = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go (operator 2)."""
    ship(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that an earlier document holds are cut (operator 8); a document of
    which no word is left goes."""
    out = line_dedup.dedup(docs).where((F.col("removed_words") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: of those that operator 9 links,
    and of those whose shingles are alike."""
    ship(spark)
    return simhash.near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go (operator 6)."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids are added (operator 3)."""
    import public_tokenizers

    ship(spark)
    return pieces.encode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeats),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Learned lexicons, hashes and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            out = materialize(stage(spark, docs, sf_dir), name)
            keep.append(out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
