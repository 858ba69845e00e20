"""Evaluation: rates, percentiles, sweeps, snapshot comparison and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, by: list[str], value: str, points=(0.5, 0.95), digits=4) -> DataFrame:
    """n, the exact (interpolated) percentiles and the least value of each group."""
    named = [F.round(F.percentile(value, F.lit(p)), digits).alias(f"p{round(100 * p)}") for p in points]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *named, F.round(F.min(value), digits).alias("least"))


def share(condition: Column, digits=4) -> Column:
    """The percentage of rows for which the condition holds."""
    return F.round(100.0 * F.count_if(condition) / F.count("*"), digits)


def sweep(lookups: DataFrame, floors: list[float], margins: list[float]) -> DataFrame:
    """(floor, margin, n, hits, recall, wrong, wrong_rate) over lookups(sim, margin,
    right) for every pair of settings."""
    grid = F.explode(F.array(*(F.struct(F.lit(f).alias("floor"), F.lit(m).alias("least")) for f in floors for m in margins))).alias("g")
    rows = lookups.select("sim", "margin", "right", grid).select("g.floor", "g.least", ((F.col("sim") >= F.col("g.floor")) & (F.col("margin") >= F.col("g.least"))).alias("hit"), "right")
    return rows.groupBy("floor", "least").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("hit")).alias("hits"),
        share(F.col("hit") & F.col("right")).alias("recall"),
        F.count_if(F.col("hit") & ~F.col("right")).alias("wrong"),
        share(F.col("hit") & ~F.col("right")).alias("wrong_rate"),
    )


def best_setting(swept: DataFrame, most_wrong=8.0) -> DataFrame:
    """The setting with the highest recall among those with few enough wrong answers."""
    fine = swept.where(F.col("wrong_rate") <= most_wrong)
    return fine.orderBy(F.desc("recall"), "wrong_rate", "floor", "least").limit(1)


def compare(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed, modified or unchanged."""
    both = old.select(F.col(key).alias("k0"), F.col(value).alias("v0")).join(new.select(F.col(key).alias("k1"), F.col(value).alias("v1")), F.col("k0") == F.col("k1"), "full_outer")
    change = F.when(F.col("k0").isNull(), "added").when(F.col("k1").isNull(), "removed").when(F.col("v0").eqNullSafe(F.col("v1")), "unchanged").otherwise("modified")
    return both.select(F.coalesce("k0", "k1").alias(key), change.alias("change"))


def keep_best(rows: DataFrame, by: list[str], key: Column, score: str, position: str, columns: list[str]) -> DataFrame:
    """One row for each key within a group: the best one by score, at the place of the
    first; an equal score does not replace an earlier row."""
    packed = F.struct(*columns)
    out = rows.groupBy(*by, key.alias("_key")).agg(F.min(position).alias("first_position"), F.max_by(packed, F.struct(F.col(score), -F.col(position))).alias("_best"))
    return out.select(*by, "first_position", "_best.*")


def ordered(rows: DataFrame, by: list[str], score: str, position: str) -> DataFrame:
    """Rows with their rank by falling score; ties stay in order of position."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), position)))


def goal_score(resolved: Column, generic: Column) -> Column:
    """From 0.55 up by resolved and down by generic actions, between 0 and 0.99."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), 0.55 + 0.04 * resolved - 0.05 * generic)), 4)
