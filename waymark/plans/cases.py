"""Registered queries over fixed cases: grammars, the compiler, the server, the readers and
the streams, applied to rows of the tables that each carry one of a few given inputs. Their
SQL states what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import text as T
from ..operators import gates
from ..shipping import ship
from ..sources import articles as A
from ..streaming import events as E
from ..tables import new_path, settle
from . import compile as C
from . import serve as S

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    """A SQL table of literal rows."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + f") AS v({names})"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text_case(name: str, function: Callable[[Column], Column], cases: list[tuple[str, str]]) -> None:
    """A function of a text: every order carries one of the inputs."""
    given = [a for a, _ in cases]

    def build(spark: SparkSession, sf: str) -> DataFrame:
        rows = _table(spark, sf, "orders").select("o_orderkey", F.get(T.strings(given), (F.col("o_orderkey") % len(given)).cast("int")).alias("given"))
        return rows.select("o_orderkey", function(F.col("given")).cast("string").alias("result"))

    _queries[name] = build
    _sql[name] = f"SELECT o_orderkey, [{', '.join(_quoted(b) for _, b in cases)}][o_orderkey % {len(cases)} + 1] AS result FROM orders"


_text_case("clause_cases", lambda c: F.array_join(G.clauses(c), " | "), [
    ("Navigate to Settings. Tap Apps. Select your email app. Tap Storage.", "Navigate to Settings. | Tap Apps. | Select your email app. | Tap Storage."),
    ("Select your preferred navigation type between Buttons and Swipe gestures.", "Select your preferred navigation type between Buttons and Swipe gestures."),
    ("Press and hold the Power button.", "Press and hold the Power button."),
    ("Go to Settings, tap Connections, and then tap Wi-Fi", "Go to Settings. | Tap Connections. | Tap Wi-Fi."),
    ("The weather is nice", ""),
    ("", ""),
    ("Set up the account and turn on sync", "Set up the account. | Turn on sync."),
    ("Clear dust and use a dry cloth.", "Clear dust, use a dry cloth."),
    ("You can try to restart the phone. Then wait.", ""),
])
_text_case("target_cases", lambda c: T.let(G.target(c), lambda t: F.concat_ws("::", t["family"], t["target"])), [
    ("Opens the Wi-Fi scanning settings page in device Settings on the device.", "open::Wi-Fi scanning"),
    ("Disables adaptive battery via device Settings on the device.", "disable::adaptive battery"),
    ("Diagnoses excessive battery drain to identify power-hungry apps.", "monitor::excessive battery drain"),
    ("Opens device settings.", "open::"),
    ("", "open::"),
    ("Updates screen timeout to a specified value", "update::screen timeout"),
    ("Switches the display mode under the device settings", "update::display mode"),
])
_text_case("path_cases", lambda c: F.array_join(G.path(F.split(c, " / ")), " > "), [
    ("Navigate to Settings. / Tap Connections. / Tap Wi-Fi option. / Toggle on Wi-Fi scanning.", "Settings > Connections > Wi-Fi > Wi-Fi scanning"),
    ("Open Settings. / Tap Display. / Go to Apps. / Tap Storage.", "Apps > Storage"),
    ("Wait a while.", ""),
    ("Open Settings. / Tap Display. / Tap Display. / Turn on Dark mode.", "Settings > Display > Dark mode"),
    ("Open Settings. / Go to Settings. / Tap Sound.", "Settings > Settings > Sound"),
])
_text_case("branch_cases", lambda c: F.array_join(F.transform(G.groups_by_screen(F.split(c, " / ")), lambda g: F.array_join(g, " / ")), " || "), [
    ("Open Settings. / Tap Display. / Tap Brightness. / Go to Apps. / Tap Storage.", "Open Settings. / Tap Display. / Tap Brightness. || Go to Apps. / Tap Storage."),
    ("Tap Display. / Tap Brightness. / Go to Apps. / Tap Storage.", "Tap Display. / Tap Brightness. / Go to Apps. / Tap Storage."),
    ("Open Settings. / Tap Display. / Tap Brightness. / Open Settings. / Tap Sound.", "Open Settings. / Tap Display. / Tap Brightness. / Open Settings. / Tap Sound."),
    ("Wait a while.", "Wait a while."),
])
_text_case("title_case_checks", T.is_title_case, [
    ("Check Email Access on a PC", "true"), ("24-Hour Mode", "true"), ("Clear The Cache", "true"), ("Use Wi-Fi (QR)", "true"), ("check it", "false"), ("Open settings page", "false"), ("", "false"),
])
_text_case("topic_titles", T.topic_title, [
    ("Battery drain issue on your phone", "Battery Drain"), ("fix", "Fix"), ("", "Device Settings"), ("USB port broken", "Usb Port Broken"), ("Screen flicker after update guide", "Screen Flicker After"),
])
_text_case("description_cases", T.describe, [
    ("", "It will fix the device settings"), ("Settings - Clear the App's Cache", "It will clear app cache"), ("Reset", "It will let you reset settings"), ("Back up data", "It will back up up data"),
    ("Sign in to account", "It will sign in account"), ("Wave at it", "It will let you fix settings"), ("Check the USB port for dust", "It will check port dust"),
])
_text_case("screen_copy", T.describe_screen, [
    ("", "It will open the relevant settings"), ("The Display", "It will open the display settings"), ("Wi-Fi", "It will open the wi-fi settings"),
    ("advanced network and connection sharing options menu", "It will open the advanced network settings"),
])
_text_case("toggle_values", T.toggle_value, [("Toggle on Wi-Fi scanning.", "True"), ("Turn off the sync.", "False"), ("Tap on Display.", "True"), ("Disable it, then enable it", "True")])
_text_case("cleaned_screens", G.clean_screen, [("the Display screen", "Display"), ("Wi-Fi settings on your device", "Wi-Fi settings"), ("device Battery page...", "Battery"), ("", "")])
_text_case("imperative_cases", lambda c: F.concat_ws("|", T.imperative(c), T.is_ui_step(c).cast("string")), [
    ("You can tap Apps.", "Tap Apps.|false"), ("please try to open Settings", "|false"), ("Simply check, then go", "Check, then go.|false"), ("Tap the app", "Tap the app.|true"), ("Apps are fun", "|false"),
])
_text_case("intent_cases", lambda c: F.array_join(G.intents(c), " | "), [
    ("screen flickers. battery drains fast. wifi keeps dropping.", "screen flickers. | battery drains fast. | wifi keeps dropping."),
    ("my phone screen is blank black dark", "my phone screen is blank black dark"),
    ("", ""),
    ("1. screen flickers 2. battery drains", "screen flickers | battery drains"),
    ("battery drains and camera is blurry", "battery drains | camera is blurry"),
])


# ---- the compiler and the server ------------------------------------------------------

_ARTICLES = [
    ("battery drains fast", "Battery drain", "# Troubleshooting Battery Drain\nIntro text.\n## Step 1: Limit background use\n- Navigate to Settings. Tap Battery. Tap Background usage limits.\n- Turn on Sleeping apps.\n## Step 2: Clean the port\n* Clear dust and use a dry cloth.\n"),
    ("wifi keeps dropping", "Wi-Fi not working", "## Reset network\nTo forget a network:\nGo to Settings, tap Connections, and then tap Wi-Fi.\nTo reset all settings:\nOpen Settings.\nTap Reset settings.\n| a | b |\n"),
    (None, "Prose only", "Nothing to replay here."),
    ("too dark", "Screen brightness", "Tap Display. Tap Brightness."),
    ("show more", "Show more", "## Show more\nOpen Settings. Tap Display. Tap Brightness.\nGo to Apps. Tap Storage.\nGo to Apps. Tap Storage."),
]
_ENTRIES = [
    ("1", "voiceassist://wifi", "Opens the Wi-Fi settings page in device Settings on the device.", "Wi-Fi", None, None, 0, None),
    ("2", "voiceassist://sleep_on", "Enables sleeping apps via device Settings on the device.", "Sleeping apps", None, None, 0, {"deeplink": "voiceassist://sleep", "key": "sleeping"}),
    ("3", "voiceassist://sleep_off", "Disables sleeping apps via device Settings on the device.", None, None, None, 0, None),
    ("4", "voiceassist://brightness", "Opens the brightness settings page.", None, None, None, 1, None),
    ("5", "voiceassist://dummy_positive", "Placeholder", None, None, "placeholder", 0, None),
]


def _catalog(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(k, *e) for k, e in enumerate(_ENTRIES)], "position int, " + A.ENTRY)
    return A.with_targets(rows)


def _case(key: Column, cases: list, at: int) -> Column:
    return F.get(F.array(*(F.lit(c[at]).cast("string") for c in cases)), (key % len(cases)).cast("int"))


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    columns = [_case(key, _ARTICLES, k).alias(c) for k, c in enumerate(("original_query", "title", "content"))]
    return _table(spark, sf, "supplier").select(key.cast("string").alias("id"), *columns)


_ACTIONS = [
    (0, 1, "Limit background use", "Navigate to Settings. / Tap Battery. / Tap Background usage limits. / Turn on Sleeping apps.", "1,1,1,2"),
    (0, 2, "Clean the port", "Clear dust, use a dry cloth.", "1"),
    (1, 1, "Reset network - forget a network", "Go to Settings. / Tap Connections. / Tap Wi-Fi.", "1,1,1"),
    (1, 2, "Reset network - reset all settings", "Open Settings. / Tap Reset settings.", "1,2"),
    (3, 1, "Screen brightness", "Tap Display. / Tap Brightness.", "1,1"),
    (4, 1, "Show more - Brightness", "Open Settings. / Tap Display. / Tap Brightness.", "1,1,1"),
    (4, 2, "Show more - Storage", "Go to Apps. / Tap Storage.", "1,1"),
]


def article_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Steps out of articles; span_lines: which of the action's lines, counted from its
    first, each step comes from."""
    lines = F.transform("spans", lambda s: s["line_no"])
    order = F.array_sort(F.array_distinct(lines))
    spans = F.array_join(F.transform(lines, lambda n: F.array_position(order, n)), ",")
    return C.actions(_articles(spark, sf)).select("id", F.col("action_no").cast("long").alias("action_no"), "action", F.array_join("steps", " / ").alias("steps"), spans.alias("span_lines"))


_queries["article_actions"] = article_actions
_sql["article_actions"] = f"SELECT s_suppkey::VARCHAR AS id, action_no::BIGINT AS action_no, action, steps, span_lines FROM supplier JOIN {_values(_ACTIONS, 'k, action_no, action, steps, span_lines')} ON s_suppkey % {len(_ARTICLES)} = k"


_GOALS = [
    (0, "Follow these steps to perform this Battery Drain Troubleshooting", "Battery drain", "Limit Background Use; Clean the Port", "auto; manual", "voiceassist://sleep_on; none", "voiceassist://sleep=True; none", 2, 1, 0.54, ""),
    (1, "Follow these steps to perform this Wi Fi Troubleshooting", "Wi fi", "Reset Network - Forget a Network; Reset Network - Reset All Settings", "auto; critical", "voiceassist://wifi; voiceassist://dummy_positive", "none; none", 2, 1, 0.54, ""),
    (3, "Follow these steps to perform this Screen Brightness Troubleshooting", "Screen brightness", "Screen Brightness", "auto", "voiceassist://brightness", "none", 1, 1, 0.59, ""),
    (4, "Follow these steps to perform this Show More Troubleshooting", "Show more", "Show More - Brightness; Show More - Storage", "auto; auto", "voiceassist://brightness; voiceassist://sleep_on", "none; voiceassist://sleep=True", 2, 2, 0.63, ""),
]


def compiled_goals(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.goals(_articles(spark, sf), _catalog(spark)).select("id", F.col("contexts")[0].alias("c"), "build", "gate")
    listed = lambda use: F.array_join(F.transform("c.actions", lambda a: F.coalesce(use(a), F.lit("none"))), "; ")
    check = lambda a: a["stepGroups"][0]["validationDeeplink"]
    return rows.select(
        "id", "c.goal", "c.title", listed(lambda a: a["actionName"]).alias("actions"), listed(lambda a: a["category"]).alias("categories"),
        listed(lambda a: a["stepGroups"][0]["actionableDeeplink"]["deeplink"]).alias("links"), listed(lambda a: F.concat(check(a)["deeplink"], F.lit("="), check(a)["value"])).alias("checks"),
        F.col("build.n_actions").alias("n_actions"), F.col("build.n_resolved").alias("n_resolved"), "c.score", F.array_join("gate.failures", ",").alias("failures"),
    )


_queries["compiled_goals"] = compiled_goals
_sql["compiled_goals"] = f"""SELECT s_suppkey::VARCHAR AS id, goal, title, actions, categories, links, checks, n_actions::BIGINT AS n_actions, n_resolved::BIGINT AS n_resolved, score::DOUBLE AS score, failures
  FROM supplier JOIN {_values(_GOALS, 'k, goal, title, actions, categories, links, checks, n_actions, n_resolved, score, failures')} ON s_suppkey % {len(_ARTICLES)} = k"""


_COMPLAINTS = [
    # text, tier, cache hit, goals, fallback, tier after plans for the misses were compiled
    ("Battery drains, battery drain!", "exact", True, 1, None, "exact"),
    ("wifi is dropping and battery drains", "exact", True, 2, None, "exact"),
    ("", None, False, 0, "empty_query", None),
    ("zzz qqq", "miss", False, 0, "no_match", "exact"),
    ("Wi-Fi not working", "semantic", True, 1, None, "semantic"),
]


def _plans(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(f"a{k}", *a) for k, a in enumerate(_ARTICLES)], "id string, original_query string, title string, content string")
    return settle(C.plans(rows, _catalog(spark)))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), _case(F.col("c_custkey"), _COMPLAINTS, 0).alias("text"))


def answered_complaints(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    plans = _plans(spark)
    out = S.answer(_asked(spark, sf), plans, C.aliases(plans), floor=0.2)
    return out.select("query_id", "tier", "cache_hit", F.size("contexts").cast("long").alias("n_contexts"), "fallback")


_queries["answered_complaints"] = answered_complaints
_sql["answered_complaints"] = f"""SELECT c_custkey AS query_id, tier, cache_hit, n_contexts::BIGINT AS n_contexts, fallback FROM customer
  JOIN {_values([(k, *c[1:5]) for k, c in enumerate(_COMPLAINTS)], 'k, tier, cache_hit, n_contexts, fallback')} ON c_custkey % {len(_COMPLAINTS)} = k"""


def cold_answers(spark: SparkSession, sf: str) -> DataFrame:
    """What complaints without a plan find once plans were compiled from articles that came
    with them."""
    ship(spark)
    plans, asked = _plans(spark), _asked(spark, sf)
    parts = S.parts(asked)
    missed = S.lookup(parts, plans, C.aliases(plans), floor=0.2)
    came = asked.select("query_id", F.lit("Brightness jumps").alias("title"), F.lit("## Set brightness\nOpen Settings. Tap Display. Tap Brightness.").alias("content"))
    cold = settle(S.cold_plans(missed, came, _catalog(spark)))
    out = S.answer(asked, plans.unionByName(cold), C.aliases(plans), floor=0.2)
    return out.select("query_id", "tier", F.exists("plan_ids", lambda p: p.startswith("RT-")).alias("compiled_on_a_miss"))


_queries["cold_answers"] = cold_answers
_sql["cold_answers"] = f"""SELECT c_custkey AS query_id, tier, cold AS compiled_on_a_miss FROM customer
  JOIN {_values([(k, c[5], c[1] == 'miss') for k, c in enumerate(_COMPLAINTS)], 'k, tier, cold')} ON c_custkey % {len(_COMPLAINTS)} = k"""


def plan_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """What each plan is found by, paraphrases of its complaint among it."""
    ship(spark)
    plans = _plans(spark).withColumn("variations", F.array(F.lit("one more"), F.lit(" ")))
    kinds = C.aliases(plans).groupBy("plan_id").agg(F.count("*").alias("n_aliases"), F.array_join(F.array_sort(F.collect_list("alias_pos")).cast("array<string>"), ",").alias("positions"))
    return kinds.join(plans.select("plan_id", "source_id"), "plan_id").select("source_id", "n_aliases", "positions")


_queries["plan_aliases"] = plan_aliases
_sql["plan_aliases"] = f"SELECT source_id, n_aliases::BIGINT AS n_aliases, positions FROM {_values([(f'a{k}', 7, '0,1,2,3,4,5,6') for k in (0, 1, 3, 4)], 'source_id, n_aliases, positions')}"


# ---- rules of the gate that sound answers never break ----------------------------------

_BROKEN = ["ACTIONNAME_CASE", "EMPTY_STEPGROUP", "EMPTY_STEPS", "DEEPLINK_NOT_IN_CATALOG", "DUMMY_DESC_LENGTH", "VALIDATION_URI_BAD", ""]


def gate_rare_codes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey") % len(_BROKEN)
    uri = F.when(n == 3, "voiceassist://lost").when(n == 4, "voiceassist://dummy_positive").otherwise("voiceassist://x/y")
    link = F.struct(uri.alias("deeplink"), F.when(n == 4, "Too short").otherwise("It will open the settings").alias("description"))
    check = F.when(n == 5, F.struct(F.lit("other://x").alias("deeplink")))
    steps = F.when(n == 2, F.array().cast("array<string>")).otherwise(T.strings(["Open settings."]))
    group = F.struct(steps.alias("steps"), link.alias("actionableDeeplink"), check.alias("validationDeeplink"))
    groups = F.filter(F.array(group), lambda g: n != 1)
    action = F.struct(F.when(n == 0, "open display").otherwise("Open Display").alias("actionName"), F.lit("It will access display settings").alias("description"), groups.alias("stepGroups"), F.lit("auto").alias("category"))
    context = F.struct(F.lit("Follow these steps to perform this Battery Drain Troubleshooting").alias("goal"), F.lit("Battery drain").alias("title"), F.array(action).alias("actions"), F.lit(0.5).alias("score"))
    rows = _table(spark, sf, "orders").select("o_orderkey", F.array(context).alias("contexts"))
    audited = gates.audit(rows, unknown=T.strings(["voiceassist://lost"]))
    return audited.select("o_orderkey", F.array_join("gate.failures", ",").alias("codes"), F.col("gate.ok").alias("ok"))


_queries["gate_rare_codes"] = gate_rare_codes
_sql["gate_rare_codes"] = f"SELECT o_orderkey, codes, codes = '' AS ok FROM (SELECT o_orderkey, [{', '.join(map(_quoted, _BROKEN))}][o_orderkey % {len(_BROKEN)} + 1] AS codes FROM orders)"


# ---- readers, store and streams ---------------------------------------------------------


def _write_json(rows: DataFrame, key: str, wrapper: str, path: str) -> None:
    """One JSON document of records for each key, each in a file of its own."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c != key)))).alias(wrapper))
    packed.select(F.to_json(F.struct(wrapper)).alias("value"), key).repartition(key).write.partitionBy(key).text(path)


def source_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Articles, catalog entries and complaints written as files and read by the readers."""
    rows = _table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    answer = F.to_json(F.struct(F.col("s_name").alias("title"), F.concat(F.lit("## "), "s_name").alias("content")))
    plain = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(answer)
    articles, catalog, complaints = (new_path(spark, t) for t in ("articles", "catalog", "complaints"))
    _write_json(rows.select(key.alias("id"), F.col("s_name").alias("original_query"), plain.alias("siis_response"), F.col("s_nationkey").alias("k")), "k", "responses", articles)
    entries = rows.select(key.alias("id"), F.concat(F.lit("voiceassist://"), key).alias("deeplink"), F.concat(F.lit("Enables "), "s_name", F.lit(" via device Settings.")).alias("description"), F.col("s_nationkey").alias("k"))
    _write_json(entries, "k", "deeplinks", catalog)
    rows.select(F.concat(F.lit("  "), "s_name", F.when(F.col("s_suppkey") % 2 == 0, "\n\n ").otherwise(""))).write.text(complaints)
    a = A.articles(spark, articles).select(F.lit("article").alias("kind"), "id", F.concat_ws("|", "title", "content").alias("value"))
    c = A.catalog(spark, catalog).select(F.lit("entry").alias("kind"), "id", F.concat_ws("|", "deeplink", "family", "target").alias("value"))
    t = A.complaints(spark, complaints).select(F.lit("complaint").alias("kind"), F.col("text").alias("id"), F.lit("").alias("value"))
    return a.unionAll(c).unionAll(t)


_queries["source_round_trip"] = source_round_trip
_sql["source_round_trip"] = """SELECT 'article' AS kind, s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 3 = 0 THEN '|' || s_name ELSE s_name || '|## ' || s_name END AS value FROM supplier
  UNION ALL SELECT 'entry', s_suppkey::VARCHAR, 'voiceassist://' || s_suppkey || '|enable|' || s_name FROM supplier UNION ALL SELECT 'complaint', s_name, '' FROM supplier"""


def plan_store(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a table in the plan store, the current one, and a report."""
    folder = new_path(spark, "store")
    rows = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("plan_id"), F.col("s_name").alias("title"))
    A.save_plans(rows, folder, "v1")
    A.save_plans(rows.where("plan_id % 2 = 0"), folder, "v2")
    A.save_report(rows.select("plan_id"), f"{folder}/report")
    count = lambda df, what: df.agg(F.count("*").alias("n"), F.sum("plan_id").alias("total")).withColumn("what", F.lit(what))
    out = count(A.load_plans(spark, folder), "current").unionAll(count(A.load_plans(spark, folder, "v1"), "v1"))
    return out.unionAll(count(spark.read.json(f"{folder}/report"), "report")).select("what", "n", "total")


_queries["plan_store"] = plan_store
_sql["plan_store"] = """SELECT 'current' AS what, count(*) AS n, sum(s_suppkey)::BIGINT AS total FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'v1', count(*), sum(s_suppkey)::BIGINT FROM supplier UNION ALL SELECT 'report', count(*), sum(s_suppkey)::BIGINT FROM supplier"""

_STREAM_PLANS = [("purchase", "p1"), ("view", "p2")]


def stream_static_join(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream, joined with plans by their type, batch by batch into a table."""
    folder = new_path(spark, "stream")
    schema = _table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumnRenamed("event_type", "signature")
    plans = spark.createDataFrame(_STREAM_PLANS, "signature string, plan string")
    E.run_to_end(E.with_plans(stream, plans), lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/checkpoint")
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("signature", "plan").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_queries["stream_static_join"] = stream_static_join
_sql["stream_static_join"] = f"""SELECT event_type AS signature, plan, count(*) AS n, round(sum(value), 4) AS total FROM events LEFT JOIN {_values(_STREAM_PLANS, 'signature, plan')} ON event_type = signature GROUP BY ALL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
