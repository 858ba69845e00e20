"""Retrieval operators against plain Python, and both ways to form all pairs."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from waymark.functions import text as T
from waymark.operators import metrics
from waymark.operators import retrieval as R

DOCS = ["tap the wifi scan", "wifi wifi battery", "screen", "", "battery saver screen battery"]
QUERIES = ["wifi battery battery", "screen", "nothing here", ""]


def test_bm25(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "d long, text string")
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "q long, text string")
    words = T.tokens(F.col("text"))
    got = {(r.q, r.d): r.score for r in R.bm25(asked, docs, "q", "d", words, words).collect()}
    lists = [t.split() for t in DOCS]
    mean, df = sum(map(len, lists)) / len(lists), Counter(w for ws in lists for w in set(ws))
    want = {}
    for q, text in enumerate(QUERIES):
        for w in text.split():
            for d, ws in enumerate(lists):
                if w in ws:
                    f = ws.count(w)
                    idf = math.log(1 + (len(lists) - df[w] + 0.5) / (df[w] + 0.5))
                    want[q, d] = want.get((q, d), 0) + idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ws) / mean))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_gram_cosine(spark):
    rows = spark.createDataFrame([(1, "Wi-Fi"), (2, "wi-fi"), (3, "zzzzzz"), (4, "")], "a long, text string")
    got = {(r.a, r.b): round(r.cosine, 9) for r in R.gram_cosine(rows, rows.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert got[1, 2] == 1.0 and (1, 3) not in got and got[3, 3] == 1.0 and (4, 1) not in got


def test_hashed_cosine(spark):
    rows = spark.createDataFrame([(1, "Wi-Fi calling"), (2, "wi-fi  CALLING"), (3, "zzzzzz"), (4, "")], "a long, text string")
    got = {(r.a, r.b): round(r.cosine, 5) for r in R.hashed_cosine(rows, rows.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert got[1, 2] == 1.0 and got.get((1, 3), 0) < 0.2 and got[3, 3] == 1.0 and (4, 1) not in got


def test_gram_idf(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc abc")], "a long, text string")
    got = {r.gram: (r.df, r.idf) for r in R.gram_idf(rows, "a", "text").collect()}
    assert got["abc"][0] == 2 and got[" ab"][0] == 3 and abs(got["abc"][1] - math.log(4 / 3) - 1e-6) < 1e-12


@pytest.mark.parametrize("limit", [10**6, 12])
def test_every_pair(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "BROADCAST_BYTES", limit)
    left, right = spark.range(7).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b")
    got = sorted(tuple(r) for r in R.every_pair(left, right).select("a", "b").collect())
    assert got == [(a, b) for a in range(7) for b in range(5)]


def test_lookup_takes_the_last_plan(spark):
    plans = spark.createDataFrame([("k", 1), ("k", 5), ("j", 2)], "key string, plan long")
    got = {r.q: r.hit for r in R.exact_lookup(spark.createDataFrame([(1, "k"), (2, "x")], "q long, key string"), plans, "key", "plan", "plan").collect()}
    assert got == {1: 5, 2: None}


def test_factors(spark):
    rows = spark.createDataFrame(
        [("enable", "enable", ["wifi"], ["wifi"], ["wifi"], [], 1), ("disable", "enable", ["wifi"], [], ["wifi"], [], 1), ("enable", "none", ["wifi", "scan"], [], [], [], 2), ("monitor", "none", [], [], [], [], 3), ("open", "none", ["a"], [], [], ["a"], 0)],
        "f string, p string, t array<string>, l array<string>, w array<string>, n array<string>, d int",
    )
    got = [round(r.x, 6) for r in rows.select(R.factor(*map(F.col, "fptlwnd")).alias("x")).collect()]
    assert got == [round(x, 6) for x in (1.25 * 1.35, 0.55 * 1.15, 0.9 * 0.55, 1.1 * 0.4, 1.35)]


def test_margin_without_a_second_plan(spark):
    got = R.best_and_margin(spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.5), (2, "b", 0.5)], "query long, plan string, sim double")).collect()
    assert sorted((r.query, r.plan, r.margin) for r in got) == [(1, "a", 0.5), (2, "a", 0.0)]


def test_keep_best_and_compare(spark):
    rows = spark.createDataFrame([(1, "G ", 0.5, 0), (1, "g", 0.5, 1), (1, "g", 0.7, 2), (1, "h", 0.6, 3)], "q long, goal string, score double, at long")
    got = metrics.ordered(metrics.keep_best(rows, ["q"], F.lower(F.trim("goal")), "score", "at", ["goal", "score"]), ["q"], "score", "first_position").orderBy("rank").collect()
    assert [(r.goal, r.score, r.first_position) for r in got] == [("g", 0.7, 0), ("h", 0.6, 3)]
    old, new = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "b"), (3, None)], [(2, "c"), (3, None), (4, "d")]))
    assert {r.k: r.change for r in metrics.compare(old, new, "k", "v").collect()} == {1: "removed", 2: "modified", 3: "unchanged", 4: "added"}


def test_goal_scores_stay_in_range(spark):
    rows = spark.createDataFrame([(0, 30), (30, 0), (2, 1)], "r int, g int")
    assert [r.s for r in rows.select(metrics.goal_score(F.col("r"), F.col("g")).alias("s")).collect()] == [0.0, 0.99, 0.58]
