"""URL filters: parts, rules and features by plain Python; the trees on labelled URLs."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from waymark.llm import url_filters as U

ODD = [
    None, "", "no address", "://", "http://", "HTTP://WWW.Example.COM/en/7x?y#z", "ftp://a.b.example.com/en/", "http://example.com?en/7", "http://example.com#/en/7",
    "http://xexample.com/en/7", "http://net/de/1", "http://notnet/de/1", "x://y.net/de/8://z.org/es/", "http://example.net/de/8", "http://sub.example.net/de/80", "http://example.net/de/7",
    "http://ORG/es/", "http://münchen.org/es/ü", "http://İ.com/en/1", "http://a.com/EN/1", "http://a.com/en", "http://a.com/en/\nx", "http://user:pw@a.com/en/1", "a" * 5000 + "://com/en/" + "b" * 20000,
]


def slow(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:n], rest[n:]
        n = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        path = rest[:n]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for what, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return host, path, best and best[1], best and best[0]


def test_rules(spark, sf):
    urls = ODD + [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as path", "3 as rule", "4 as suffix")
    got = {r.page_id: r for r in U.judge(pages).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        host, path, rule, verdict = slow(url)
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert verdict or r.verdict == ("block" if r.block_score > 0.5 else "allow")


def test_features(spark):
    urls = [u for u in ODD if u is None or len(u) < 100] + ["http://a-b.example.com/x/y-z/12?q=1&r=2#f"]
    rows = U.with_parts(spark.createDataFrame(list(enumerate(urls)), "k long, url string"))
    for r in rows.select("k", "host", "path", *(c.alias(n) for n, c in U.lexical().items())).collect():
        u = urls[r.k] or ""
        counts = Counter(u)
        entropy = -sum(n / len(u) * math.log2(n / len(u)) for n in counts.values()) if u else 0.0
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        assert abs(r.entropy - entropy) < 1e-5, u
        assert r.n_chars == len(u) and r.depth == r.path.count("/") and r.host_labels == r.host.count(".")
        assert abs(r.digit_ratio - (sum(c in "0123456789" for c in u) / len(u) if u else 0)) < 1e-12
        assert r.n_params == (query.count("&") + 1 if query else 0) and r.n_hyphens == u.count("-") and r.has_fragment == ("#" in u)


def test_trees_learn(spark):
    """Labels that depend on features no single split tells, on URLs not trained on."""
    rng = random.Random(6)
    rows = []
    for k in range(4000):
        digits, deep = rng.random() < 0.5, rng.random() < 0.5
        path = "/".join((str(rng.randint(10**6, 10**8)) if digits else "word") for _ in range(rng.randint(5, 8) if deep else rng.randint(1, 2)))
        rows.append((k, f"http://site{rng.randint(1, 9)}.com/{path}", float(digits != deep)))
    data = U.with_parts(spark.createDataFrame(rows, "k long, url string, y double"))
    data = data.withColumns(U.lexical() | {f: F.lit(0.5) for f in U.FEATURES[-4:]})
    model = U.fit(data.where("k % 2 = 0").select(*U.FEATURES, "y").coalesce(1))
    out = data.where("k % 2 = 1").select("y", (model.margin() > 0).cast("double").alias("p"))
    assert out.where("y = p").count() / out.count() > 0.97


def plain_boosting(x, y, trees, depth=3, rate=0.4, l2=1.0, min_rows=20):
    """x: {feature: bins}. Trees on bins, grown node by node over the rows themselves."""
    margin = np.full(len(y), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    def grow(rows, g, h, left):
        best = None
        if left:
            for f in sorted(x):
                for c in sorted(set(x[f][rows]))[:-1]:
                    low = rows[x[f][rows] <= c]
                    high = rows[x[f][rows] > c]
                    if min(len(low), len(high)) >= min_rows:
                        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                        gain = round(part(low) + part(high) - part(rows), 6)
                        if gain > 1e-6 and (best is None or (gain, f, c) > best[:3]):
                            best = (gain, f, c, low, high)
        if best is None:
            value = rate * g[rows].sum() / (h[rows].sum() + l2)
            out[rows] = value
            return value
        return (best[1], int(best[2]), grow(best[3], g, h, left - 1), grow(best[4], g, h, left - 1))

    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        made.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
        margin = margin + out
    return made


def test_trees_like_plain_boosting(spark):
    rng = np.random.default_rng(12)
    n = 1500
    data = {f: rng.integers(0, 30, n).astype(float) for f in U.FEATURES}
    y = ((data["depth"] > 12) ^ (data["entropy"] > 20) ^ (rng.random(n) < 0.1)).astype(float)
    table = pa.table({**data, "y": y})
    sample = spark.createDataFrame(table).coalesce(1)
    cuts = U.grid(sample)
    bins = {f: np.searchsorted(cuts[f], data[f], side="left") for f in U.FEATURES}
    want = plain_boosting(bins, y, 4)

    def same(a, b):
        if isinstance(b, tuple):
            assert a[0] == b[0] and a[1] == cuts[b[0]][b[1]]
            same(a[2], b[2])
            same(a[3], b[3])
        else:
            assert abs(a - b) < 1e-6

    got = U.fit(sample, trees=4).trees
    assert len(got) == 4
    for a, b in zip(got, want, strict=True):
        same(a, b)


def test_rates_are_counted_out_of_fold(spark):
    rng = random.Random(9)
    rows = [(k, f"http://{rng.choice('ab')}.x{rng.randint(1, 3)}.com/{rng.choice(['en', 'de', ''])}/{rng.randint(1, 40)}", rng.choice([None, 0.0, 1.0])) for k in range(400)]
    parts = U.with_keys(U.with_parts(spark.createDataFrame(rows, "k long, url string, y double"))).withColumn("fold", F.expr("cast(k % 5 as int)"))
    table, overall = U.rates(parts)
    got = parts.join(table, "start", "left").select("*", *(c.alias(n) for n, c in U.rate_columns(overall).items())).collect()
    known = [r for r in got if r.y is not None]
    assert abs(overall - (sum(r.y for r in known) + 0.5) / (len(known) + 1)) < 1e-9
    for r in got:
        wider = overall
        for name, pseudo in zip(("suffix", "segment", "start"), U.PSEUDO_ROWS, strict=True):
            others = [q for q in known if q[name] == r[name] and (r.y is None or q.fold != r.fold)]
            wider = (sum(q.y for q in others) + pseudo * wider) / (len(others) + pseudo)
            assert abs(r[f"{name}_rate"] - wider) < 1e-5
            if name == "suffix":
                assert abs(r.suffix_rows - math.log1p(len(others))) < 1e-5


def test_held_out_urls(spark):
    """Labelled URLs of one part in five, parted by a hash, that nothing was learned from."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    held = F.pmod(F.xxhash64("url", F.lit(77)), F.lit(5)) == 0
    got = U.judge(pages, held_out=held).join(pages.select("page_id", held.alias("held")), "page_id").where("held and rule is not null")
    rows = [(r.rule, r.verdict == ("block" if r.block_score > 0.5 else "allow")) for r in got.collect()]
    by = {rule: [ok for x, ok in rows if x == rule] for rule, _ in rows}
    print({rule: f"{sum(ok)} of {len(ok)}" for rule, ok in by.items()})
    assert len(rows) > 100 and sum(ok for _, ok in rows) >= 0.97 * len(rows)
    assert all(sum(ok) >= 0.7 * len(ok) for ok in by.values() if len(ok) >= 10)


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "http://a.de/x"), (None, None), (1, "http://a.de/x")], "page_id long, url string")
    got = U.judge(pages).collect()
    assert [r.verdict for r in got] == ["allow"] * 3 and all(r.block_score == 0.5 for r in got)
    one = spark.createDataFrame([(k, "http://a.com/en/1") for k in range(30)] + [(99, "http://b.fr/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(one).collect()}[99] == "block"
    assert U.judge(pages.limit(0)).count() == 0
