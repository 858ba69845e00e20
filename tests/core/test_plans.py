"""Articles to plans to answers, the store, and streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F
from waymark.operators import retrieval as R
from waymark.plans import compile as C
from waymark.plans import serve as S
from waymark.sources import articles as A
from waymark.streaming import events as E

ARTICLES = {
    "responses": [
        {"id": "a", "original_query": "battery drains fast", "siis_response": {"title": "Battery drain", "content": "# Troubleshooting Battery Drain\nIntro text.\n## Step 1: Limit background use\n- Navigate to Settings. Tap Battery. Tap Background usage limits.\n- Turn on Sleeping apps.\n## Step 2: Clean the port\n* Clear dust and use a dry cloth.\n"}},
        {"original_query": "wifi keeps dropping", "siis_response": {"title": "Wi-Fi not working", "content": "## Reset network\nTo forget a network:\nGo to Settings, tap Connections, and then tap Wi-Fi.\nTo reset all settings:\nOpen Settings.\nTap Reset settings.\n| a | b |\n"}},
        {"id": "c", "siis_response": {"title": "Prose only", "content": "Nothing to replay here."}},
        {"id": "d", "siis_response": "Tap Display. Tap Brightness."},
    ]
}
CATALOG = [
    {"id": "1", "deeplink": "voiceassist://wifi", "description": "Opens the Wi-Fi settings page in device Settings on the device.", "message": "Wi-Fi"},
    {"id": "2", "deeplink": "voiceassist://sleep_on", "description": "Enables sleeping apps via device Settings on the device.", "message": "Sleeping apps", "validation": {"deeplink": "voiceassist://sleep", "key": "sleeping"}},
    {"id": "3", "deeplink": "voiceassist://sleep_off", "description": "Disables sleeping apps via device Settings on the device."},
    {"id": "4", "deeplink": "voiceassist://brightness", "description": "Opens the brightness settings page.", "control_type": 1},
    {"id": "5", "deeplink": "voiceassist://dummy_positive", "description": "Placeholder", "originalType": "placeholder"},
]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "a.json").write_text(json.dumps(ARTICLES, indent=1))
    (folder / "c.json").write_text(json.dumps(CATALOG))
    return A.articles(spark, str(folder / "a.json")).cache(), A.catalog(spark, str(folder / "c.json")).cache()


def test_readers(loaded):
    articles, catalog = loaded
    assert [r.id for r in articles.orderBy("position").collect()] == ["a", "row_2", "c", "d"]
    assert [(r.family, r.target) for r in catalog.orderBy("position").collect()][:4] == [("open", "Wi-Fi"), ("enable", "sleeping apps"), ("disable", "sleeping apps"), ("open", "brightness")]


def test_actions(loaded):
    rows = {(r.id, r.action_no): r for r in C.actions(loaded[0]).collect()}
    assert rows["a", 1].action == "Limit background use"
    assert rows["a", 1].steps == ["Navigate to Settings.", "Tap Battery.", "Tap Background usage limits.", "Turn on Sleeping apps."]
    assert rows["row_2", 1].action == "Reset network - forget a network" and rows["row_2", 1].steps == ["Go to Settings.", "Tap Connections.", "Tap Wi-Fi."]
    assert rows["row_2", 2].steps == ["Open Settings.", "Tap Reset settings."]
    assert not any(k[0] == "c" for k in rows)


def test_plans_pass_the_gate(loaded):
    articles, catalog = loaded
    rows = {r.id: r for r in C.goals(articles, catalog).collect()}
    assert set(rows) == {"a", "row_2", "d"}
    assert rows["d"].gate.failures == ["ACTIONNAME_CASE"]  # it has no title to name its action by
    for i, r in rows.items():
        assert r.gate.ok or i == "d", r.gate.failures
        ranks = [["auto", "manual", "critical"].index(a.category) for a in r.contexts[0].actions]
        assert ranks == sorted(ranks)
    group = rows["a"].contexts[0].actions[0].stepGroups[0]
    assert group.actionableDeeplink.deeplink == "voiceassist://sleep_on" and group.validationDeeplink.value == "True"
    assert rows["a"].contexts[0].goal == "Follow these steps to perform this Battery Drain Troubleshooting"


def test_every_mode_and_partitioning_gives_the_same_best_entry(spark, loaded):
    articles, catalog = loaded
    found = C.actions(articles)
    results = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted((r.id, r.action_no, r.entry, round(r.score, 6)) for r in C.resolve(found, catalog).where("rank = 1").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
    for mode in ("lexical", "dense", "hybrid_no_path"):
        assert C.resolve(found, catalog, mode).where("rank = 1").count() == found.count()
    assert C.resolve(found, catalog).where("entry = '5'").count() == 0


def test_answers(spark, loaded):
    articles, catalog = loaded
    plans = C.plans(articles, catalog).cache()
    aliases = C.aliases(plans)
    asked = spark.createDataFrame([(1, "Battery drains, battery drain!"), (2, "wifi is dropping and battery drains"), (3, ""), (4, "zzz qqq"), (5, None)], "query_id long, text string")
    got = {r.query_id: r for r in S.answer(asked, plans, aliases, floor=0.2).collect()}
    assert len(got) == 5 and got[3].fallback == got[5].fallback == "empty_query" and got[4].fallback == "no_match"
    assert len(got[2].contexts) == 2 and got[2].contexts[0].score >= got[2].contexts[1].score
    assert len(got[1].contexts) == 1 and got[1].cache_hit
    assert len({c.goal for c in got[2].contexts}) == 2
    hashed = {r.query_id: r for r in S.answer(asked, plans, aliases, floor=0.2, encoder=R.hashed_cosine).collect()}
    assert {i: r.plan_ids for i, r in hashed.items()} == {i: r.plan_ids for i, r in got.items()}


def test_accents_are_taken_apart_before_words_are_looked_up(spark):
    asked = spark.createDataFrame([(1, "Écran: the ﬂash is blinking"), (2, "e\u0301cran: the flash is blinking")], "query_id long, text string")
    a, b = S.parts(asked).orderBy("query_id").collect()
    assert a.key == b.key == "display::flicker::trigger:none"


def test_unknown_links(spark, loaded):
    articles, catalog = loaded
    rows = C.goals(articles, catalog).select("id", "contexts")
    lost = lambda c: {r.id: r._unknown for r in C.with_unknown_links(rows, c).collect()}
    assert not any(lost(catalog).values()) and not any(lost(catalog.limit(0)).values())
    assert lost(catalog.where("id = '1'"))["a"] == ["voiceassist://sleep_on"]


def test_cold_plans_are_found_the_next_time(spark, loaded):
    articles, catalog = loaded
    plans = C.plans(articles, catalog).cache()
    asked = spark.createDataFrame([(1, "the brightness jumps strangely"), (2, "battery drains fast, battery drain")], "query_id long, text string")
    parts = S.parts(asked).cache()
    found = S.lookup(parts, plans, C.aliases(plans), floor=0.9).cache()
    assert {r.query_id: r.tier for r in found.collect()} == {1: "miss", 2: "exact"}
    came = spark.createDataFrame([(1, "Brightness jumps", "## Set brightness\nOpen Settings. Tap Display. Tap Brightness.")], "query_id long, title string, content string")
    cold = S.cold_plans(found, came, catalog)
    assert [r.plan_id[:3] for r in cold.collect()] == ["RT-"]
    again = S.lookup(parts, plans.unionByName(cold), C.aliases(plans), floor=0.9)
    assert {r.query_id: r.tier for r in again.collect()} == {1: "exact", 2: "exact"}


def test_store_and_increment(spark, loaded, tmp_path):
    articles, catalog = loaded
    plans = C.plans(articles, catalog).join(articles.select(F.col("id").alias("source_id"), A.fingerprint(F.col("title"), F.col("content")).alias("source_hash")), "source_id")
    A.save_plans(plans, str(tmp_path), "v1")
    A.save_plans(plans.limit(1), str(tmp_path), "v2")
    assert A.load_plans(spark, str(tmp_path)).count() == 1 and A.load_plans(spark, str(tmp_path), "v1").count() == plans.count()
    edited = articles.withColumn("content", F.when(F.col("id") == "d", F.concat("content", F.lit(" Tap More."))).otherwise(F.col("content")))
    assert {r.id for r in C.changed(edited, A.load_plans(spark, str(tmp_path), "v1")).collect()} == {"c", "d"}
    A.save_report(plans.select("plan_id", "build"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == plans.count()


@pytest.mark.parametrize("twin", [E.tumbling, E.sessions])
def test_streams_like_batches(spark, sf, tmp_path, twin):
    spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = []
    E.run_to_end(twin(stream, late="1 hour"), lambda df, n: out.extend(df.collect()), str(tmp_path / "cp"))
    want = {tuple(r) for r in twin(spark.read.schema(schema).parquet(str(tmp_path / "in"))).collect()}
    got = {tuple(r) for r in out}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_stream_with_static_plans(spark, tmp_path):
    spark.createDataFrame([("k1",), ("k2",)], "signature string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("signature string").parquet(str(tmp_path / "in"))
    plans = spark.createDataFrame([("k1", "p1")], "signature string, plan string")
    out = []
    E.run_to_end(E.with_plans(stream, plans), lambda df, n: out.extend(df.collect()), str(tmp_path / "cp"))
    assert sorted(tuple(r) for r in out) == [("k1", "p1"), ("k2", None)]
