"""Complaints to ranked plans: exact lookup by signature first, the nearest alias for the
rest, several intents in one complaint, and one answer for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import lexicon as L
from ..functions import text as T
from ..functions import unicode as U
from ..operators import metrics
from ..operators import retrieval as R
from ..shipping import ship
from ..sources.articles import fingerprint
from ..tables import once
from . import compile as C

FLOOR, MARGIN = 0.72, 0.02

#: (queries, texts, query id, text id) to (query id, text id, cosine); both have ``text``.
Encoder = Callable[[DataFrame, DataFrame, str, str], DataFrame]


def parts(queries: DataFrame, lexicon: L.Lexicon = L.STOCK) -> DataFrame:
    """queries(query_id, text) to (query_id, part_no, part, key): one row for each intent."""
    found = once(queries.select("query_id", "text"), ["text"], "_text", lambda q: _parts(q.withColumnRenamed("_text", "query_id"), lexicon).withColumnRenamed("query_id", "_text"))
    return found.drop("text")


def _parts(queries: DataFrame, lexicon: L.Lexicon) -> DataFrame:
    ship(queries.sparkSession)
    rows = queries.select("query_id", F.posexplode(G.intents(F.col("text"), lexicon)).alias("part_no", "part"))
    # accents are taken apart before words are looked up
    folded = rows.withColumn("_words", U.normal(T.stripped(F.col("part"))))
    return folded.withColumn("key", T.signature(F.col("_words"), lexicon)).drop("_words")


def lookup(asked: DataFrame, plans: DataFrame, aliases: DataFrame, floor=FLOOR, least=MARGIN, encoder: Encoder = R.gram_cosine) -> DataFrame:
    """asked with plan_id, sim, margin and tier: exact where a plan has the signature (the
    last one, by id), else the plan of the nearest alias if it is near and clear enough.
    encoder: what tells how near texts are (``gram_cosine``, ``hashed_cosine``, or another).
    Each different part is looked up once."""
    return once(asked.select("query_id", "part_no", "part", "key"), ["part", "key"], "query", lambda q: _lookup(q, plans, aliases, floor, least, encoder))


def _lookup(asked: DataFrame, plans: DataFrame, aliases: DataFrame, floor: float, least: float, encoder: Encoder) -> DataFrame:
    keyed = plans.select("plan_id", F.col("intent_signature").alias("key"))
    hit = R.exact_lookup(asked, keyed, "key", "plan_id", "plan_id").withColumnRenamed("hit", "exact")
    rest = hit.where("exact is null")
    cosine = encoder(rest.select("query", U.normal(F.col("part")).alias("text")), aliases.select(F.concat_ws("#", "plan_id", "alias_pos").alias("alias"), U.normal(F.col("text")).alias("text")), "query", "alias")
    sims = cosine.withColumn("plan", F.substring_index("alias", "#", 1)).groupBy("query", "plan").agg(F.max("cosine").alias("sim"))
    best = R.best_and_margin(sims)
    found = rest.join(best.hint("merge"), "query", "left").withColumn("tier", R.tier(F.coalesce("sim", F.lit(0.0)), F.coalesce("margin", F.lit(0.0)), floor, least))
    exact = hit.where("exact is not null").select("query", F.col("exact").alias("plan_id"), F.lit(1.0).alias("sim"), F.lit(1.0).alias("margin"), F.lit("exact").alias("tier"))
    similar = found.select("query", F.when(F.col("tier") == "semantic", F.col("plan")).alias("plan_id"), F.coalesce("sim", F.lit(0.0)).alias("sim"), F.coalesce("margin", F.lit(0.0)).alias("margin"), "tier")
    return exact.unionByName(similar)


def cold_plans(found: DataFrame, articles: DataFrame, catalog: DataFrame, lexicon: L.Lexicon = L.STOCK) -> DataFrame:
    """Plans compiled for what lookup() missed, from articles(query_id, title, content)
    that came with the complaints. They carry the missed part's signature: appended to the
    plans, they are found exactly the next time."""
    missed = found.where("plan_id is null").join(articles.select("query_id", "title", "content").hint("merge"), "query_id")
    # what was asked and answered alike is compiled once
    missed = missed.groupBy("part", "key", "title", "content").agg(F.min(F.concat_ws("#", "query_id", "part_no")).alias("id"))
    made = C.plans(missed.select("id", F.col("part").alias("original_query"), "title", "content"), catalog, lexicon)
    keyed = missed.select(F.col("id").alias("source_id"), F.col("key").alias("_key"), fingerprint(F.col("part"), length=10).alias("_id"))
    columns = made.columns
    out = made.drop("plan_id", "intent_signature").join(keyed.hint("merge"), "source_id")
    out = out.withColumn("plan_id", F.concat(F.lit("RT-"), F.col("_id"))).withColumnRenamed("_key", "intent_signature")
    return out.select(*columns).dropDuplicates(["plan_id"])


def answer(queries: DataFrame, plans: DataFrame, aliases: DataFrame, lexicon: L.Lexicon = L.STOCK, floor=FLOOR, least=MARGIN, encoder: Encoder = R.gram_cosine) -> DataFrame:
    """(query_id, contexts, plan_ids, tier, cache_hit, margin, fallback) of every query:
    goals without repeats, best first. Tier and hit are those of the first part; blank
    queries fall back to ``empty_query``, others without a plan to ``no_match``. Each
    different text is answered once."""
    answered = once(queries.select("query_id", "text"), ["text"], "_text", lambda q: _answer(q.withColumnRenamed("_text", "query_id"), plans, aliases, lexicon, floor, least, encoder).withColumnRenamed("query_id", "_text"))
    return answered.drop("text")


def _answer(queries: DataFrame, plans: DataFrame, aliases: DataFrame, lexicon: L.Lexicon, floor: float, least: float, encoder: Encoder) -> DataFrame:
    found = lookup(_parts(queries, lexicon), plans, aliases, floor, least, encoder)
    goal = found.join(plans.select("plan_id", "goal").hint("merge"), "plan_id")
    key = F.lower(T.squeezed(F.col("goal.goal")))
    best = metrics.keep_best(goal.withColumn("score", F.col("goal.score")), ["query_id"], key, "score", "part_no", ["goal", "plan_id", "score"])
    packed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("first_position").alias("p"), "goal", "plan_id")), _by_rank).alias("rows"))
    first = found.groupBy("query_id").agg(F.min_by("tier", "part_no").alias("tier"), F.min_by(F.when(F.col("plan_id").isNotNull(), F.col("margin")), F.when(F.col("plan_id").isNotNull(), F.col("part_no"))).alias("margin"))
    out = queries.join(first.hint("merge"), "query_id", "left").join(packed.hint("merge"), "query_id", "left")
    return out.select(
        "query_id", F.coalesce(F.transform("rows", lambda r: r["goal"]), F.array()).alias("contexts"),
        F.coalesce(F.transform("rows", lambda r: r["plan_id"]), F.array().cast("array<string>")).alias("plan_ids"),
        "tier", F.coalesce(F.col("tier").isin("exact", "semantic"), F.lit(False)).alias("cache_hit"), "margin",
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_query").when(F.col("rows").isNull(), "no_match").alias("fallback"),
    )


def _by_rank(a, b):
    """Best score first, then the earlier part."""
    return F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0)
