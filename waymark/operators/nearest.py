"""Each query's two nearest plans among all aliases: exact, in blocks that any number of
machines share.

Queries and aliases are dealt into blocks, and each task multiplies one block of either as
matrices, so the work is all pairs but no pair is a row. The products only tell which
aliases can be a plan's nearest; their similarities are then summed in the order of the
elements, like :func:`retrieval.dot`. A task returns the plans that may be a query's two
best: a plan that two others pass within the task where its nearest alias is, they pass
everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..tables import settle

#: Rows of the two sides in one task at most, rows of aliases that a task is worth, and
#: queries that are multiplied at once.
QUERY_ROWS, ALIAS_ROWS, LEAST_ROWS, STRIP = 1 << 16, 1 << 14, 1 << 11, 256


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(flat) if flat else np.empty(0)).reshape(-1, size)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first element to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _own_pairs(asked: pa.Table, own: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(alias row, query row) of equal numbers, by query row."""
    codes = pc.index_in(own["alias"].combine_chunks(), asked["query"].combine_chunks().unique()).to_numpy(zero_copy_only=False)
    held = asked["query"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.argsort(held, kind="stable")
    rows = np.flatnonzero(~np.isnan(codes.astype(float)))
    first, last = (np.searchsorted(held[order], codes[rows], side) for side in ("left", "right"))
    count = last - first
    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    queries = order[at]
    by = np.argsort(queries, kind="stable")
    return np.repeat(rows, count)[by], queries[by]


def _kernel(size: int, digits: int, keyed: bool, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def compare(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows or not own.num_rows:
            return schema.empty_table()
        plans = own["plan"].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = plans.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        own, codes = own.take(pa.array(order)), codes[order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = np.append(starts[1:], len(codes))
        place = np.empty(len(plans.dictionary), np.int64)
        place[pc.array_sort_indices(plans.dictionary).to_numpy()] = np.arange(len(place))
        q, a = _matrix(asked["vector"], size), _matrix(own["vector"], size).astype(np.float64)
        left, right = _own_pairs(asked, own) if keyed else (np.empty(0, np.int64),) * 2
        longest = np.sqrt(np.square(a).sum(1).max())
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(q), STRIP):
            x = q[lo : lo + STRIP].astype(np.float64)
            sims = a @ x.T
            i, j = np.searchsorted(right, (lo, lo + STRIP))
            sims[left[i:j], right[i:j] - lo] = -np.inf
            # how far a product may be from the sum in order
            off = 4 * (size + 1) * np.finfo(float).eps * longest * np.sqrt(np.square(x).sum(1).max())
            many = 8 * len(starts) > len(codes)
            best = np.maximum.reduceat(sims, starts, axis=0) if many else np.stack([sims[s:e].max(axis=0) for s, e in zip(starts, ends)])
            second = np.partition(best, -2, axis=0)[-2] if len(best) > 1 else np.full(len(x), -np.inf)
            bar = np.maximum(best - off, second - 1.01 * 10.0**-digits - off)
            if many:
                rows, cols = np.nonzero(sims >= np.repeat(bar, ends - starts, axis=0))
            else:
                parts = [np.nonzero(sims[s:e] >= b) for s, e, b in zip(starts, ends, bar)]
                rows, cols = np.concatenate([s + r for s, (r, _) in zip(starts, parts)]), np.concatenate([c for _, c in parts])
            real = sims[rows, cols] > -np.inf
            rows, cols = rows[real], cols[real]
            exact = _sums(x[cols], a[rows])
            # the greatest of each plan, then of plans with one similarity the first two
            at = np.lexsort((-exact, codes[rows], cols))
            rows, cols, exact = codes[rows[at]], cols[at], exact[at]
            top = (np.diff(rows, prepend=-1) != 0) | (np.diff(cols, prepend=-1) != 0)
            rows, cols, exact = rows[top], cols[top], exact[top]
            at = np.lexsort((place[rows], exact, cols))
            rows, cols, exact = rows[at], cols[at], exact[at]
            same = (np.diff(exact, prepend=np.nan) == 0) & (np.diff(cols, prepend=-1) == 0)
            third = same & np.append(False, same[:-1])
            found.append((cols[~third] + lo, rows[~third], exact[~third]))
        cols, rows, exact = (np.concatenate(f) for f in zip(*found))
        return pa.table([asked["query"].combine_chunks().take(pa.array(cols)), plans.dictionary.take(pa.array(rows)), pa.array(exact)], schema=schema)

    return compare


def _regular(vector: Column, size: int) -> Column:
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == size) & sound, F.lit(False))


def _sparse_dot(a: Column, b: Column) -> Column:
    """The sum over the elements that both have; null without any."""
    products = F.filter(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(products) > 0, F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def two_nearest(queries: DataFrame, aliases: DataFrame, digits=4) -> DataFrame:
    """queries(query, vector) and aliases(plan, vector) to (query, plan, sim): for each query
    the plans that can be its two best by similarity rounded to ``digits``, then plan, with
    the similarity of their nearest aliases. An alias with the query's own number, if aliases
    have numbers (alias), is not one of its neighbours. Vectors that are null, of another
    length than most, or with elements that are no numbers are compared one by one."""
    from .retrieval import every_pair

    spark, keyed = queries.sparkSession, "alias" in aliases.columns
    ship(spark)
    if keyed:
        # of copies with one plan, two with different numbers stand for all: one is not the query
        own = aliases.where("alias is not null").groupBy("plan", "vector").agg(F.array_distinct(F.array(F.min("alias"), F.max("alias"))).alias("alias"))
        own = own.select("plan", "vector", F.explode("alias").alias("alias"))
    else:
        own = aliases.select("plan", "vector").distinct()
    own, asked = settle(own), settle(queries.where("query is not null") if keyed else queries)
    size = own.where(F.size("vector") > 0).agg(F.mode(F.size("vector"))).first()[0] or 1
    count = lambda df: df.agg(F.count("*"), F.count_if(_regular(F.col("vector"), size))).first()
    (n_own, good_own), (n_asked, good_asked) = count(own), count(asked)
    schema = asked.select("query").schema.add(own.schema["plan"]).add("sim", "double")

    rows_of = lambda df, n, good: df.where(_regular(F.col("vector"), size)) if good < n else df
    cores = max(spark.sparkContext.defaultParallelism, 1)
    high = max(1, -(-good_asked // QUERY_ROWS))
    wide = max(1, -(-good_own // ALIAS_ROWS), min(-(-8 * cores // high), -(-good_own // LEAST_ROWS)))
    block = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    tasks = lambda n, of: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)).alias("_task")
    left = rows_of(asked, n_asked, good_asked).withColumn("_block", block(asked, high)).select("query", "vector", tasks(wide, lambda j: F.col("_block") * wide + j))
    right = rows_of(own, n_own, good_own).withColumn("_block", block(own, wide)).select(*own.columns, tasks(high, lambda i: i * wide + F.col("_block")))
    parts = min(2 * high * wide, 4096)
    dealt = [df.repartition(parts, "_task").groupBy("_task") for df in (left, right)]
    from pyspark.sql.pandas.types import to_arrow_schema

    found = dealt[0].cogroup(dealt[1]).applyInArrow(_kernel(size, digits, keyed, to_arrow_schema(schema)), schema)
    if (n_own, n_asked) != (good_own, good_asked):
        odd = lambda df: df.where(~_regular(F.col("vector"), size))
        pairs = [every_pair(a, b.withColumnRenamed("vector", "_other")) for a, b in ((asked, odd(own)), (odd(asked), rows_of(own, n_own, good_own)))]
        for p in pairs:
            p = p.where("query <> alias") if keyed else p
            found = found.unionAll(p.select("query", "plan", _sparse_dot(F.col("vector"), F.col("_other")).alias("sim")))
    return found.groupBy("query", "plan").agg(F.max("sim").alias("sim"))
