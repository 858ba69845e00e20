"""Articles to plans: steps out of marked-up text, a catalog entry for each action, and
goals that pass the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import lexicon as L
from ..functions import text as T
from ..functions import unicode as U
from ..operators import gates, metrics
from ..operators import retrieval as R
from ..shipping import ship
from ..sources.articles import fingerprint
from ..tables import once, settle


def first_of_each(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows without repeats: the first of each, and how often it occurs (copies)."""
    own = Window.partitionBy(*by)
    return rows.withColumns({"_copy": F.row_number().over(own.orderBy(*order)), "copies": F.count("*").over(own)}).where("_copy = 1").drop("_copy")


def actions(articles: DataFrame) -> DataFrame:
    """articles(id, title, content) to (id, action_no, action, steps, spans): one row for
    each run of steps on one screen branch, in the article's order."""
    rows = articles.withColumn("topic", G.topic_of(F.col("title"), F.col("content")))
    lines = G.instruction_lines(G.modes(G.sections(rows, topic="topic")))
    steps = lines.select("id", "section", "chunk", "action", "line_no", "line", F.posexplode(G.clauses(F.col("line"))).alias("step_no", "step"))
    steps = first_of_each(steps, ["id", "section", "chunk", "step"], ["line_no", "step_no"])
    whole = steps.groupBy("id", "section", "chunk", "action").agg(F.array_sort(F.collect_list(F.struct("line_no", "step_no", "step", "line"))).alias("found"))
    whole = whole.withColumn("groups", G.groups_by_screen(F.transform("found", lambda f: f["step"])))
    grouped = whole.select("*", F.size("groups").alias("_n"), F.posexplode("groups").alias("group_no", "steps"))
    leaf = F.element_at(F.concat(F.array(F.lit(None).cast("string")), G.path(F.col("steps"))), -1)
    label = T.title_case(F.array_join(F.slice(T.split_words(F.coalesce(leaf, F.concat(F.lit("Step "), F.col("group_no") + 1))), 1, 4), " "))
    before = F.aggregate(F.slice("groups", F.lit(1), F.col("group_no")), F.lit(0), lambda n, g: n + F.size(g))
    spans = F.transform(F.slice("found", before + 1, F.size("steps")), lambda f: F.struct(f["line_no"].alias("line_no"), f["line"].alias("text")))
    named = grouped.withColumn("action", F.trim(F.when(F.col("_n") == 1, F.col("action")).otherwise(F.concat_ws(" - ", "action", label))))
    order = Window.partitionBy("id").orderBy("section", "chunk", "group_no")
    return named.select("id", F.row_number().over(order).alias("action_no"), "action", "steps", spans.alias("spans"))


def evidence(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """What speaks for each catalog entry as the target of each action: (id, action_no, key,
    entry, position, family, polarity, target_words, lex, highest, cosine, boost, overlap);
    placeholders are left out."""
    path = G.path(F.col("steps"))
    asked = wanted.withColumn("key", F.concat_ws("#", "id", "action_no")).withColumn("path", path)
    asked = asked.withColumn("leaf", F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("string")), "path"), -1), F.lit("")))
    asked = asked.withColumns(
        {
            "polarity": T.polarity(F.array_join("steps", " ")),
            "query": F.concat_ws(" ", "action", "leaf", F.array_join("steps", " ")),
            "leaf_words": T.content_tokens(F.col("leaf")),
            "path_words": T.content_tokens(F.array_join("path", " ")),
            "name_words": T.content_tokens(F.col("action")),
        }
    )
    entries = catalog.where(~F.col("is_placeholder")).withColumnRenamed("id", "entry")
    lexical = R.bm25(asked, entries, "key", "entry", T.content_tokens(F.col("query")), T.content_tokens(F.col("index_text")))
    cosine = R.gram_cosine(asked.select("key", F.col("query").alias("text")), entries.select("entry", F.col("index_text").alias("text")), "key", "entry")
    lexical = lexical.withColumn("highest", F.max("score").over(Window.partitionBy("key")))
    # every entry is a candidate: one that shares nothing still has the dense part's half
    pairs = R.every_pair(asked.select("id", "action_no", "key", "path", "polarity", "leaf_words", "path_words", "name_words"), entries.select("entry", "position", "family", "target_words"))
    rows = pairs.join(lexical.withColumnRenamed("score", "lex"), ["key", "entry"], "left").join(cosine, ["key", "entry"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lex", "highest", "cosine")})
    words = ("leaf_words", "path_words", "name_words")
    boost = R.factor(F.col("family"), F.col("polarity"), F.col("target_words"), *map(F.col, words), F.size("path"))
    rows = rows.withColumn("boost", boost).withColumn("overlap", F.greatest(*(R.overlap(F.col("target_words"), F.col(w)) for w in words)))
    return rows.drop("path", *words)


def ranked(found: DataFrame, mode="hybrid", floor=0.30, keep=5) -> DataFrame:
    """(id, action_no, rank, entry, family, polarity, score, margin, overlap, accepted) of
    the best ``keep`` entries of each action."""
    rel = R.relevance(F.col("lex"), F.col("cosine"), F.col("highest"), mode)
    scored = found.withColumn("score", rel if mode == "hybrid_no_path" else rel * F.col("boost"))
    best = R.top(scored, "key", "position", max(2, keep))
    line = Window.partitionBy("key").orderBy("rank")
    best = best.withColumn("margin", F.coalesce(F.col("score") - F.lead("score").over(line), F.lit(0.0)))
    good = R.accepted(F.col("score"), F.col("overlap"), F.col("family"), F.col("target_words"), floor)
    return best.where(F.col("rank") <= keep).select("id", "action_no", "rank", "entry", "family", "polarity", "score", "margin", "overlap", good.alias("accepted"))


def resolve(wanted: DataFrame, catalog: DataFrame, mode="hybrid", floor=0.30, keep=5) -> DataFrame:
    """The best catalog entries of each action, as in ``ranked``."""
    return ranked(evidence(wanted, catalog), mode, floor, keep)


def link(entry: Column, leaf: Column, opens_settings: Column) -> Column:
    """The actionable link: the entry's, else the placeholder with copy of its own where
    the steps open the settings, else none."""
    kind = "struct<deeplink:string,description:string,message:string,classes:map<string,string>,originalType:string>"
    none = F.lit(None).cast("map<string,string>")
    own = F.struct(entry["deeplink"].alias("deeplink"), entry["description"].alias("description"), F.coalesce(entry["message"], F.lit("")).alias("message"), none.alias("classes"), entry["originalType"].alias("originalType"))
    message = F.when(leaf != "", F.concat(F.lit("Open "), leaf)).otherwise("Open the relevant Settings screen")
    generic = F.struct(F.lit(L.PLACEHOLDER).alias("deeplink"), T.describe_screen(leaf).alias("description"), message.alias("message"), none.alias("classes"), F.lit("placeholder").alias("originalType"))
    return F.when(entry.isNotNull(), own.cast(kind)).when(opens_settings, generic.cast(kind))


def validation(entry: Column, value: Column) -> Column:
    kind = "struct<deeplink:string,key:string,resultType:string,condition:string,value:string>"
    checks = entry["validation"]
    uri = F.try_element_at(checks, F.lit("deeplink"))
    key = F.coalesce(F.try_element_at(checks, F.lit("key")), F.when(entry["message"] != "", entry["message"]), F.lit("state"))
    found = F.struct(uri.alias("deeplink"), key.alias("key"), F.when(value.isin("True", "False"), "boolean").otherwise("str").alias("resultType"), F.lit("equal").alias("condition"), value.alias("value"))
    return F.when(uri.isNotNull(), found.cast(kind))


def _in_order(a: Column, b: Column) -> Column:
    """By category, then as in the article."""
    at = lambda x: x["rank"] * 1_000_000 + x["no"]
    return F.when(at(a) < at(b), -1).when(at(a) > at(b), 1).otherwise(0)


def goals(articles: DataFrame, catalog: DataFrame, mode="hybrid") -> DataFrame:
    """articles to (id, title, topic, contexts, build, gate): a goal for each article with
    actions, and what the gate says of it. Each different article is compiled once."""
    compiled = once(articles.select("id", "title", "content"), ["title", "content"], "_article", lambda a: _goals(a.withColumnRenamed("_article", "id"), catalog, mode).drop("title").withColumnRenamed("id", "_article"))
    return compiled.select("id", "title", "topic", "contexts", "build", "gate")


def _goals(articles: DataFrame, catalog: DataFrame, mode: str) -> DataFrame:
    found = settle(actions(articles))
    best = settle(resolve(found, catalog, mode).where("rank = 1").drop("rank"))
    entries = catalog.select(F.col("id").alias("entry"), F.struct("deeplink", "description", "message", "originalType", "validation").alias("e"))
    rows = found.join(best.hint("merge"), ["id", "action_no"], "left").join(entries, "entry", "left")
    path = G.path(F.col("steps"))
    rows = rows.withColumn("_path", path).withColumn("_hit", F.coalesce("accepted", F.lit(False)))
    text = F.array_join("steps", " ")
    opens = F.coalesce(F.lower(F.get("_path", F.lit(0))).startswith("settings"), F.lit(False)) | F.lower(text).contains("settings")
    leaf = F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("string")), "_path"), -1), F.lit(""))
    rows = rows.withColumns({"_opens": opens, "_leaf": leaf, "_entry": F.when(F.col("_hit"), F.col("e"))})
    kind = F.when(F.col("_hit") | F.col("_opens"), T.category(F.concat_ws(" ", "action", text), F.lit(True))).otherwise("manual")
    rows = rows.withColumn("category", kind)
    kept = F.col("category") != "manual"
    group = F.struct(
        F.transform("steps", T.sentence).alias("steps"),
        F.when(kept, validation(F.col("_entry"), T.toggle_value(text))).alias("validationDeeplink"),
        F.when(kept, link(F.col("_entry"), F.col("_leaf"), F.col("_opens"))).alias("actionableDeeplink"),
    )
    action = F.struct(T.title_case(F.col("action")).alias("actionName"), T.describe(F.col("action")).alias("description"), F.array(group).alias("stepGroups"), F.col("category").alias("category"))
    rows = rows.withColumn("_action", F.struct(gates.rank(F.col("category")).alias("rank"), F.col("action_no").alias("no"), action.alias("action")))
    switch = F.col("polarity").isin("enable", "disable") & F.col("family").isin("enable", "disable") & F.col("_hit")
    packed = rows.groupBy("id").agg(
        F.array_sort(F.collect_list("_action"), _in_order).alias("_actions"),
        F.count("*").alias("n_actions"),
        F.count_if(F.col("_hit")).alias("n_resolved"),
        F.round(F.coalesce(F.avg(F.when(F.col("_hit"), F.col("overlap"))), F.lit(0.0)), 4).alias("mean_target_overlap"),
        F.count_if(switch).alias("n_polarity_considered"),
        F.round(F.avg(F.when(switch, F.when(F.col("family") == F.col("polarity"), 1.0).otherwise(0.0))), 4).alias("polarity_agreement"),
    )
    topics = articles.select("id", "title", G.topic_of(F.col("title"), F.col("content")).alias("topic"))
    generic = F.col("n_actions") - F.col("n_resolved")
    context = F.struct(
        F.concat(F.lit("Follow these steps to perform this "), T.topic_title(F.col("topic")), F.lit(" Troubleshooting")).alias("goal"),
        T.title(F.col("topic")).alias("title"),
        F.transform("_actions", lambda a: a["action"]).alias("actions"),
        metrics.goal_score(F.col("n_resolved"), generic).alias("score"),
    )
    build = F.struct("n_actions", "n_resolved", generic.alias("n_generic"), F.round(F.col("n_resolved") / F.col("n_actions"), 4).alias("resolution_rate"), "mean_target_overlap", "polarity_agreement", "n_polarity_considered")
    out = packed.join(topics.hint("merge"), "id").select("id", "title", "topic", F.array(context).alias("contexts"), build.alias("build"))
    return gates.audit(with_unknown_links(out, catalog), unknown=F.col("_unknown")).drop("_unknown")


def with_unknown_links(answers: DataFrame, catalog: DataFrame) -> DataFrame:
    """answers(id, contexts) with those of their links that the catalog does not have (none
    if the catalog has no links at all)."""
    known = catalog.select("deeplink").where("deeplink is not null")
    if not known.limit(1).count():
        return answers.withColumn("_unknown", F.array().cast("array<string>"))
    asked = answers.select("id", F.explode(gates.links(F.col("contexts"))).alias("deeplink")).where(F.col("deeplink") != L.PLACEHOLDER)
    lost = asked.join(known, "deeplink", "left_anti").groupBy("id").agg(F.collect_list("deeplink").alias("_unknown"))
    return answers.join(lost.hint("merge"), "id", "left").withColumn("_unknown", F.coalesce("_unknown", F.array().cast("array<string>")))


def plans(articles: DataFrame, catalog: DataFrame, lexicon: L.Lexicon = L.STOCK, mode="hybrid") -> DataFrame:
    """Compiled plans that pass the gate, with identity, signature and domain."""
    ship(articles.sparkSession)
    rows = goals(articles, catalog, mode).where("gate.ok").join(articles.select("id", "original_query").hint("merge"), "id")
    seed = F.coalesce(F.when(F.trim("original_query") != "", F.col("original_query")), F.when(F.col("title") != "", F.col("title")), F.col("topic"))
    body = F.to_json(F.col("contexts")[0])
    # accents are taken apart before words are looked up
    rows = rows.withColumn("_seed", seed).withColumns({"_words": U.normal(F.col("_seed")), "_signed": U.normal(F.concat_ws(" ", "_seed", "title"))})
    seed, signed = F.col("_seed"), F.col("_signed")
    return rows.select(
        F.concat(F.lit("FG-"), fingerprint(F.col("id"), body, length=10)).alias("plan_id"), F.col("id").alias("source_id"),
        F.col("title").alias("source_title"), "topic", F.col("contexts")[0].alias("goal"),
        T.signature(signed, lexicon).alias("intent_signature"), T.domain(T.atoms(signed, lexicon), lexicon).alias("domain"),
        F.array_join(T.atoms(F.col("_words"), lexicon), " ").alias("keywords"), seed.alias("seed"), "build", fingerprint(body).alias("content_hash"), "gate",
    )


def aliases(compiled: DataFrame, lexicon: L.Lexicon = L.STOCK) -> DataFrame:
    """(plan_id, alias_pos, text): what a plan is found by; blank ones go."""
    compiled = compiled.withColumn("_words", U.normal(F.col("seed")))
    own = F.array("intent_signature", T.normalized(F.col("_words"), lexicon), "topic", "source_title", "keywords", "seed")
    more = F.concat(own, F.col("variations")) if "variations" in compiled.columns else own
    return compiled.select("plan_id", F.posexplode(more).alias("alias_pos", "text")).where(F.trim("text") != "")


def changed(articles: DataFrame, compiled: DataFrame) -> DataFrame:
    """Articles whose text no stored plan was compiled from, for an incremental build
    (stored plans carry ``source_hash``)."""
    hashed = articles.withColumn("source_hash", fingerprint(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    return hashed.join(compiled.select(F.col("source_id").alias("id"), "source_hash").distinct(), ["id", "source_hash"], "left_anti")
