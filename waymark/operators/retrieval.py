"""Retrieval: BM25 over postings, sparse n-gram cosine, dense vectors, hybrid ranking with
factors, and the exact-then-similar lookup with a floor and a margin.

Candidates always come from equi-joins on terms or grams where a score needs a shared
one; where a score gives something to every pair (the dense part, half a point for
nothing in common), the smaller side's bytes are counted before it is broadcast, and a
larger one is dealt out in blocks of that size, so no single task sees all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..tables import settle

K1, B = 1.5, 0.75
#: Bytes, as text, of what may be broadcast to all pairs.
BROADCAST_BYTES = 64 << 20


def postings(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(id, term, tf, len): how often each term occurs, and the document's length."""
    terms = docs.select(F.col(id_col), words.alias("ws")).select(id_col, F.size("ws").alias("len"), F.explode("ws").alias("term"))
    return terms.groupBy(id_col, "len", "term").agg(F.count("*").alias("tf"))


def idf(found: DataFrame, documents: int) -> DataFrame:
    """(term, df, idf)."""
    rate = F.log(1 + (F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return found.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", rate)


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, query_words: Column, doc_words: Column) -> DataFrame:
    """(query, doc, score) of every pair with a common term; query terms count as often
    as they occur. The documents are read once: postings are kept of the terms that a
    query has, before anything moves, and number and mean length are observed on the way."""
    asked = queries.select(F.col(query_id), F.explode(query_words).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("times"))
    asked = settle(asked)
    seen = Observation()
    rows = docs.select(F.col(doc_id), doc_words.alias("ws")).select("*", F.size("ws").alias("len"))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean"))
    terms = rows.select(doc_id, "len", F.explode("ws").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    found = settle(terms.groupBy(doc_id, "len", "term").agg(F.count("*").alias("tf")))
    count, mean = seen.get["n"], seen.get["mean"]
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(mean) or 1.0)))
    joined = asked.join(idf(found, count), "term").join(found, "term")
    return joined.groupBy(query_id, doc_id).agg(F.sum(F.col("times") * gain).alias("score"))


def top(scored: DataFrame, by: str, tie: str, k: int, score="score", digits=6) -> DataFrame:
    """The k best rows of each group, with their rank; equal (rounded) scores by tie."""
    order = Window.partitionBy(by).orderBy(F.round(score, digits).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gram_weights(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, gram, w): log(1 + count) of the character n-grams, of unit length."""
    grams = rows.select(F.col(id_col), F.explode(T.char_grams(F.col(text))).alias("gram")).groupBy(id_col, "gram").agg(F.log1p(F.count("*").cast("double")).alias("w"))
    norms = grams.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return grams.join(norms, id_col).select(id_col, "gram", (F.col("w") / F.col("norm")).alias("w"))


def gram_idf(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(gram, df, idf) of the n-grams of all texts, for weights that count rare grams more."""
    n = rows.count()
    grams = rows.select(F.col(id_col), F.explode(F.array_distinct(T.char_grams(F.col(text)))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1e-6)


def _cosine(q: DataFrame, d: DataFrame, query_id: str, doc_id: str, key: str) -> DataFrame:
    both = q.withColumnRenamed("w", "qw").join(d.withColumnRenamed("w", "dw"), key)
    return both.groupBy(query_id, doc_id).agg(F.sum(F.col("qw") * F.col("dw")).alias("cosine"))


def gram_cosine(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, text="text") -> DataFrame:
    """(query, doc, cosine) of every pair with a common gram."""
    return _cosine(gram_weights(queries, query_id, text), gram_weights(docs, doc_id, text), query_id, doc_id, "gram")


def hashed_cosine(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, text="text") -> DataFrame:
    """The same with hashed grams: pairs with a common bucket."""

    def weights(rows: DataFrame, id_col: str) -> DataFrame:
        return rows.select(id_col, F.posexplode(U.encode(F.col(text))).alias("bucket", "w")).where("w > 0").withColumn("w", F.col("w").cast("double"))

    return _cosine(weights(queries, query_id), weights(docs, doc_id), query_id, doc_id, "bucket")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def every_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of left with each of right, for scores that say something about every
    pair: the right side is broadcast if it is small, else dealt out in blocks that are,
    and left is copied to each."""
    right = settle(right)
    size = right.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*right.columns)))), F.lit(0))).first()[0]
    blocks = -(-size // BROADCAST_BYTES)
    if blocks <= 1:
        return left.join(F.broadcast(right), F.lit(True))
    salted = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)))
    copies = left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return copies.join(salted, "_block").drop("_block")


def best_and_margin(sims: DataFrame, digits=4) -> DataFrame:
    """(query, plan, sim, margin): the best plan, and how far the second best plan is
    behind (0 counts as the second where there is none); ties go to the lower plan."""
    order = Window.partitionBy("query").orderBy(F.round("sim", digits).desc(), F.col("plan").asc_nulls_last())
    ranked = sims.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    return ranked.groupBy("query").agg(
        F.max(F.when(F.col("rn") == 1, F.col("plan"))).alias("plan"),
        F.round(F.max(F.when(F.col("rn") == 1, F.col("sim"))), digits).alias("sim"),
        F.round(F.max(F.when(F.col("rn") == 1, F.col("sim"))) - F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("sim"))), F.lit(0.0)), digits).alias("margin"),
    )


def tier(sim: Column, margin: Column, floor: float, least_margin: float) -> Column:
    return F.when((sim >= floor) & (margin >= least_margin), "semantic").otherwise("miss")


def exact_lookup(queries: DataFrame, plans: DataFrame, key: str, order: str, plan: str) -> DataFrame:
    """queries with the plan of the same key (the last one in order, where several have
    it), null without one."""
    last = plans.groupBy(key).agg(F.max_by(plan, order).alias("hit"))
    return queries.join(last, key, "left")


def relevance(lexical: Column, cosine: Column, highest: Column, mode="hybrid") -> Column:
    """lexical, dense or both: 0.55 of the BM25 score over the query's highest, 0.45 of
    the cosine moved to 0..1."""
    lex = F.when(highest > 0, lexical / (highest + 1e-9)).otherwise(lexical)
    dense = (cosine + 1.0) / 2.0
    if mode == "lexical":
        return lex
    return dense if mode == "dense" else 0.55 * lex + 0.45 * dense


def overlap(target: Column, words: Column) -> Column:
    """The share of the target's different words that occur; 0 without a target."""
    own = F.array_distinct(target)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, words)) / F.size(own)).otherwise(0.0)


def factor(family: Column, polarity: Column, target: Column, leaf: Column, path: Column, name: Column, depth: Column) -> Column:
    """How far kind of operation and screen speak for an entry: words of its target are
    compared with those of the last screen, of the whole path and of the action's name."""
    switch = family.isin("enable", "disable")
    kind = (
        F.when((polarity != "none") & switch, F.when(family == polarity, 1.25).otherwise(0.55))
        .when(switch, 0.90)
        .when(family == "monitor", 1.10)
        .otherwise(1.0)
    )
    o, p, n = (overlap(target, w) for w in (leaf, path, name))
    screen = (
        F.when(F.size(target) == 0, F.when(depth >= 2, 0.40).otherwise(1.0))
        .when(F.greatest(o, n) >= 0.6, 1.35)
        .when(p >= 0.5, 1.15)
        .when((depth >= 2) & (F.greatest(o, p, n) < 0.2), 0.55)
        .otherwise(1.0)
    )
    return kind * screen


def accepted(score: Column, best_overlap: Column, family: Column, target: Column, floor=0.30) -> Column:
    """The precision gate: score above the floor, and a target that shares enough words."""
    need = F.when(family == "monitor", 0.34).otherwise(0.5)
    return (score >= floor) & (F.size(target) > 0) & (best_overlap >= need)
