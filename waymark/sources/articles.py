"""Readers of article corpora, catalogs and complaint lists, and the store of compiled
plans: Parquet by version, with a pointer to the current one, and JSON reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import text as T

ARTICLE = "id string, original_query string, siis_response string"
ENTRY = "id string, deeplink string, description string, message string, qna_description string, originalType string, control_type int, validation map<string,string>"


def _records(spark: SparkSession, path: str, wrapper: str, fields: str) -> DataFrame:
    """(position, record) of a JSON file that holds an array, or an object around one."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(
        F.coalesce(
            F.from_json("value", f"struct<{wrapper}:array<struct<{_typed(fields)}>>>")[wrapper],
            F.from_json("value", f"array<struct<{_typed(fields)}>>"),
        ).alias("rows")
    )
    return parsed.select(F.posexplode("rows").alias("position", "record"))


def _typed(fields: str) -> str:
    return ",".join(":".join(f.split(" ", 1)) for f in fields.split(", "))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(position, id, original_query, title, content); a missing id is row_1, row_2, ...;
    an answer that is plain text is its content."""
    rows = _records(spark, path, "responses", ARTICLE).select("position", "record.*")
    answer = F.from_json("siis_response", "struct<title:string,content:string>")
    return rows.select(
        "position",
        F.coalesce("id", F.concat(F.lit("row_"), F.col("position") + 1)).alias("id"),
        "original_query",
        F.coalesce(answer["title"], F.lit("")).alias("title"),
        F.when(F.trim("siis_response").startswith("{"), F.coalesce(answer["content"], F.lit(""))).otherwise(F.coalesce("siis_response", F.lit(""))).alias("content"),
    )


def with_targets(entries: DataFrame) -> DataFrame:
    """Catalog entries with family, target, its words, and the text they are found by (the
    target counts twice)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = entries.withColumn("_t", G.target(text("description"))).withColumn("family", F.col("_t.family")).withColumn("target", F.col("_t.target")).drop("_t")
    found_by = F.concat_ws(" ", F.filter(F.array("target", "target", text("description"), text("message"), text("qna_description")), lambda x: x != ""))
    return rows.withColumns(
        {
            "is_placeholder": F.coalesce(F.col("originalType") == "placeholder", F.lit(False)),
            "target_words": F.array_distinct(T.content_tokens(F.col("target"))),
            "index_text": found_by,
        }
    )


def catalog(spark: SparkSession, path: str) -> DataFrame:
    rows = _records(spark, path, "deeplinks", ENTRY).select("position", "record.*")
    return with_targets(rows)


def complaints(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each line that is not blank."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def save_plans(plans: DataFrame, folder: str, version: str) -> None:
    """Writes a version, then a pointer to it that replaces the former one in one step;
    readers of the old version go on."""
    spark = plans.sparkSession
    plans.write.mode("overwrite").parquet(f"{folder}/plans/version={version}")
    pointer, jvm = f"{folder}/current-{uuid.uuid4().hex}", spark.sparkContext._jvm
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.parquet(pointer)
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # a pointer is found by its number, so the new one counts from the moment of its renaming
    at = 1 + max((int(f.getPath().getName()[8:]) for f in fs.globStatus(path(f"{folder}/current=*")) or ()), default=0)
    fs.rename(path(pointer), path(f"{folder}/current={at}"))
    for f in fs.globStatus(path(f"{folder}/current=*")):
        if int(f.getPath().getName()[8:]) < at - 1:  # the last one may still be read
            fs.delete(f.getPath(), True)


def load_plans(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """The plans of a version, by default the current one."""
    if version is None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        at = max(int(f.getPath().getName()[8:]) for f in fs.globStatus(path(f"{folder}/current=*")))
        version = spark.read.parquet(f"{folder}/current={at}").first()["version"]
    return spark.read.parquet(f"{folder}/plans/version={version}")


def save_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def fingerprint(*parts: Column, length: int = 16) -> Column:
    """The first letters of the SHA-1 of the parts, one to a line."""
    return F.substring(F.sha1(F.concat_ws("\n", *parts).cast("binary")), 1, length)
