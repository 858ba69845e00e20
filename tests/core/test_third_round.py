"""Faults that the third review found, each on a small input that shows it."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from waymark.operators import nearest
from waymark.operators import retrieval as R
from waymark.plans import cases
from waymark.plans import compile as C
from waymark.plans import queries as Q
from waymark.plans import serve as S


def like_sql(spark, folder, name):
    """A query's rows, and those of its SQL, over the tables in a folder."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    got, want = Q.queries()[name](spark, str(folder)), con.execute(Q.oracle_sql()[name])
    columns, names = sorted(got.columns), [d[0] for d in want.description]
    plain = lambda v: round(v, 4) if isinstance(v, float) and math.isfinite(v) else v
    mine = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=repr)
    return mine, sorted(([plain(r[names.index(c)]) for c in columns] for r in want.fetchall()), key=repr)


ODD = ["ßheit nicht", "ŉa", "ᾳb", "ɤ", " tap ", "\u000btap", "a\u000b\u000bb", "firſt x", "end.\u0085", "end. ", "Also,\u000bgo", "ꟍ", "\r\nab", "", None]


@pytest.mark.parametrize("name", ["sentences", "step_dedupe"])
def test_letters_and_spaces_as_in_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    mine, theirs = like_sql(spark, tmp_path, name)
    assert mine == theirs and mine


@pytest.mark.parametrize("keyed", [True, False])
def test_nearest_plans_in_blocks(spark, monkeypatch, keyed):
    """Several blocks of either side, copies, plans without a second alias, against plain sums."""
    for name, rows in (("QUERY_ROWS", 40), ("ALIAS_ROWS", 64), ("LEAST_ROWS", 16), ("STRIP", 7)):
        monkeypatch.setattr(nearest, name, rows)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((150, 8)).astype(np.float32)
    vectors[100:] = vectors[rng.integers(0, 60, 50)]
    plans = [int(p) if p else None for p in rng.integers(0, 9, 150)]
    plans[7] = 77
    rows = [(k, p, [float(x) for x in v]) for k, (p, v) in enumerate(zip(plans, vectors))]
    own = spark.createDataFrame(rows, "alias long, plan int, vector array<float>")
    asked = own.selectExpr("alias as query", "vector").where("query % 2 = 0")
    found = nearest.two_nearest(asked, own if keyed else own.drop("alias"))
    got = {r.query: (r.plan, r.sim, r.margin) for r in R.best_and_margin(found).collect()}
    for q in range(0, 150, 2):
        best: dict = {}
        for a, p, v in rows:
            if a != q or not keyed:
                sim = 0.0
                for x, y in zip(rows[q][2], v):
                    sim += x * y
                best[p] = max(best.get(p, -math.inf), sim)
        first, second = sorted(best.items(), key=lambda b: (-round(b[1], 4), b[0] is None, b[0] or 0))[:2]
        assert got[q] == (first[0], round(first[1], 4), round(first[1] - second[1], 4))


@pytest.mark.parametrize("name", ["semantic_margin_lookup", "gate_sweep", "best_gate"])
def test_odd_vectors_as_in_sql(spark, tmp_path, name):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in v], int(p)) for k, (v, p) in enumerate(zip(rng.standard_normal((160, 4)).astype(np.float32) / 2, rng.integers(0, 4, 160)))]
    for k, vector in ((3, None), (50, rows[50][1][:3]), (61, []), (62, [0.5, None, 0.5, 0.1]), (100, rows[7][1])):
        rows[k] = (k, vector, rows[k][2])
    rows += [(160, rows[0][1], 9), (161, rows[0][1], 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    mine, theirs = like_sql(spark, tmp_path, name)
    assert mine == theirs and mine


def test_gate_is_set_by_all_rows(spark, tmp_path):
    """No number is one that 50 divides."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 50 <> 0")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    mine, theirs = like_sql(spark, tmp_path, "best_gate")
    assert mine == theirs and len(mine) == 1


def test_copies_are_compiled_and_answered_once(spark, monkeypatch):
    """Work and memory follow the different texts; every row still gets its result."""
    compiled, compared = [], []

    def actions(articles, real=C.actions):
        compiled.append(articles.count())
        return real(articles)

    def encoder(queries, texts, query_id, text_id):
        compared.append(queries.count())
        return R.gram_cosine(queries, texts, query_id, text_id)

    monkeypatch.setattr(C, "actions", actions)
    kinds = [("screen dark", "Screen brightness", "Tap Display. Tap Brightness."), ("wifi drops", "Network", "## Reset network\nOpen Settings. Tap Reset settings."), (None, None, None)]
    articles = spark.createDataFrame([(str(k), *kinds[k % 3]) for k in range(90)], "id string, original_query string, title string, content string")
    plans = C.plans(articles, cases._catalog(spark))
    got = plans.groupBy("source_title").agg(F.count("*").alias("n"), F.countDistinct("plan_id").alias("d")).collect()
    assert compiled == [3] and sorted((r.source_title, r.n, r.d) for r in got) == [("Network", 30, 30), ("Screen brightness", 30, 30)]
    one = plans.where("source_id in ('0', '1')").localCheckpoint()
    asked = spark.createDataFrame([(k, [None, "zzz qqq", "Screen brightness is odd", " "][k % 4]) for k in range(80)], "query_id long, text string")
    out = S.answer(asked, one, C.aliases(one), floor=0.2, encoder=encoder)
    assert compared[0] <= 2 and out.count() == 80
    assert {(r.query_id % 4, r.fallback) for r in out.collect()} == {(0, "empty_query"), (1, "no_match"), (2, None), (3, "empty_query")}
