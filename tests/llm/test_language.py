"""Language identification: held-out accuracy, the fusion against plain Python, odd rows."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from waymark.llm import language
from waymark.llm.common import fold


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    hidden = docs.withColumn("lang", F.when(fold(docs["doc_id"], 3) != 1, F.col("lang")))
    got = language.identify(hidden).select("doc_id", F.col("lang").alias("got"))
    rows = docs.join(got, "doc_id").where(fold(F.col("doc_id"), 3) == 1).select("lang", "got").collect()
    assert sum(r.lang == r.got for r in rows) / len(rows) > 0.99


def test_pages(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "pages"))
    got = language.identify(docs, pages)
    assert got.count() == docs.count() + pages.count()
    own = got.where("page_id is not null").select("lang", "declared").collect()
    assert sum(r.lang == r.declared for r in own) / len(own) > 0.99


def slow(rows, languages):
    """rows: (host, declared, segment, ll). Every row judged by counts over the others."""
    n = len(languages)
    soft = lambda x: np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum()
    smooth = lambda c, w: (c + language.PRIOR_ROWS * w) / (c.sum() + language.PRIOR_ROWS)
    cut = lambda h: (h.split(".")[-1], ".".join(h.split(".")[-2:]), h)
    out = []
    for k, (host, declared, segment, ll) in enumerate(rows):
        others = [(r, soft(r[3])) for j, r in enumerate(rows) if j != k]
        add = lambda keep: sum((p for r, p in others if keep(r)), np.zeros(n))  # noqa: E731, B023
        prior = (add(lambda r: True) + 1) / (len(others) + n)
        for level in range(3 if host is not None else 0):
            prior = smooth(add(lambda r: r[0] is not None and cut(r[0])[level] == cut(host)[level]), prior)  # noqa: B023
        logs = np.array(ll) + np.log(prior)
        for at, value in ((1, declared), (2, segment)):
            if value is not None:
                logs = logs + np.log((add(lambda r: r[at] == value) + 0.5) / (add(lambda r: r[at] is not None) + 1))  # noqa: B023
        post = soft(logs)
        out.append((languages[int(post.argmax())], round(float(post.max()), 5)))
    return out


def test_fusion(spark):
    rng = np.random.default_rng(1)
    languages = ["de", "en", "fr"]
    hosts = ["a.x.com", "b.x.com", "c.y.com", "z.de", "www.z.de", None]
    rows = []
    for _ in range(200):
        ll = rng.normal(0, 2, 3)
        rows.append((str(rng.choice(hosts[:5])) if rng.random() < 0.9 else None, str(rng.choice(languages)) if rng.random() < 0.6 else None,
                     "en" if rng.random() < 0.3 else None, (ll - ll.max()).tolist()))
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, host string, declared string, segment string, ll array<double>").repartition(3)
    got = [(r.lang, round(r.confidence, 5)) for r in sorted(language.fuse(table, languages).collect(), key=lambda r: r.k)]
    want = slow(rows, languages)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)


def test_wrong_declarations(spark):
    """Scraps of 12 words of held-out documents, a fifth declared wrongly, a fifth on a
    host of another language."""
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null and text is not null")
    hidden = docs.where(fold(docs["doc_id"], 3) != 1)
    rows, truth, wrong = [], {}, set()
    for r in docs.where(fold(docs["doc_id"], 3) == 1).select("doc_id", "text", "lang").collect():
        words = r.text.split()
        if len(words) < 30:
            continue
        at = rng.randrange(len(words) - 12)
        told = r.lang if rng.random() < 0.8 else rng.choice([x for x in ("en", "de", "fr", "es") if x != r.lang])
        host = r.lang if rng.random() < 0.8 else rng.choice(["en", "de", "fr", "es"])
        rows.append((r.doc_id, f"http://h{rng.randrange(40)}.{host}site.org/x", f"<html lang={told}><p>{' '.join(words[at : at + 12])}</p>"))
        truth[r.doc_id] = r.lang
        if told != r.lang:
            wrong.add(r.doc_id)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in language.identify(hidden, pages).where("page_id is not null").collect()}
    right = {i for i in truth if got[i] == truth[i]}
    print(f"all {len(right) / len(truth):.4f}, wrongly declared {len(right & wrong) / len(wrong):.4f} of {len(wrong)}")
    assert len(right) > 0.98 * len(truth) and len(right & wrong) > 0.95 * len(wrong)


def test_plain_text_of_markup():
    page = "<p>a<b>b</b></p><script>var x = '<p>no</p>';</script >c<!-- no <p> -->d<STYLE>no</STYLE>e &amp; f <br"
    assert language.plain(page).split() == ["a", "b", "c", "d", "e", "&", "f", "<br"]
    assert language.plain(None) == "" and language.plain("x < y") == "x  < y" and language.plain("<script>a<style>b").split() == ["a", "b"]
    start = time.perf_counter()
    assert language.plain("<script><!--<style>" * 100_000 + "end").split() == ["end"]
    assert time.perf_counter() - start < 5


def test_declared_language_and_host_decide_short_texts(spark):
    docs = [(k, "the cat and the dog sat there", "en") for k in range(40)] + [(100 + k, "der Hund und die Katze sitzen dort", "de") for k in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    rows = [(k, f"http://{'www.a.de' if k % 2 else 'b.com'}/x", f"<html lang='{'de' if k % 2 else 'en'}'><p>{'der Hund und die Katze' if k % 2 else 'the cat and the dog'}</p></html>") for k in range(60)]
    rows += [(1000, "http://www.a.de/y", "<html lang=de><p>0</p></html>"), (1001, "http://b.com/y", "<HTML LANG=EN><script>der die und</script></html>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identify(docs, pages).where("page_id is not null").collect()}
    assert got[1000].lang == "de" and got[1001].lang == "en" and got[1001].declared == "en"


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    lang = "en" if labelled else None
    rows = [(1, None, lang, "s"), (2, "", None, None), (3, "some words", lang, "s"), (3, "some words", lang, "s"), (None, "words " * 60000, None, ""), (5, "x", "fr" if labelled else None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as host", "2 as ll", "3 as page_id", "4 as declared")
    pages = spark.createDataFrame([(1, None, None), (None, "no address", ""), (3, "http:///", "<html lang=''>")], "page_id long, url string, html string")
    got = language.identify(docs, pages).collect()
    assert len(got) == 9 and all((r.lang is not None) == labelled for r in got)
    assert all(not labelled or 0 < r.confidence <= 1 and math.isfinite(r.confidence) for r in got)
    assert language.identify(docs.limit(0), pages.limit(0)).count() == 0
    assert language.identify(docs.limit(0), pages).count() == 3


def test_declared_language_after_a_long_prologue(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "s"), (2, "der Hund und die Katze", "de", "s")], "doc_id long, text string, lang string, source string")
    rows = [(k, "http://b.com/x", "<!-- " + "licence " * n + "-->\n<html lang='de'><p>0</p></html>") for k, n in enumerate((0, 600, 50000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.declared for r in language.identify(docs, pages).where("page_id is not null").collect()}
    assert got == {0: "de", 1: "de", 2: "de"}
