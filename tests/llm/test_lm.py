"""Context-tree weighting against a plain recursive version; the base score by hand."""

import math
import pathlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from waymark.llm import ctw, lm
from waymark.llm.common import fold


class Slow:
    """Counts in a dictionary, probabilities by the textbook recursion."""

    def __init__(self, streams, depth):
        self.depth, self.n, self.memo = depth, {}, {}
        for s in streams:
            for at in range(depth, len(s)):
                j = 1
                for k in range(8):
                    bit = s[at] >> (7 - k) & 1
                    for d in range(depth + 1):
                        self.n.setdefault((s[at - d : at], j), [0, 0])[bit] += 1
                    j = j * 2 + bit
        self.child = {}
        for c, j in self.n:
            if c:
                self.child.setdefault((c[1:], j), []).append(c)

    def kt(self, c, j):
        a, b = self.n[c, j]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(self, c, j):
        if (c, j) not in self.memo:
            own = self.kt(c, j)
            if len(c) < self.depth:
                below = sum(self.weighted(x, j) for x in self.child[c, j])
                own = max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)
            self.memo[c, j] = own
        return self.memo[c, j]

    def one(self, past, j, d=0):
        c = past[len(past) - d :]
        if (c, j) not in self.n:
            return 0.5
        a, b = self.n[c, j]
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        beta = math.exp(self.kt(c, j) - math.log(2) - self.weighted(c, j))
        return beta * own + (1 - beta) * self.one(past, j, d + 1)

    def log2(self, s):
        total = 0.0
        for at in range(self.depth, len(s)):
            j = 1
            for k in range(8):
                bit = s[at] >> (7 - k) & 1
                p = self.one(s[at - self.depth : at], j)
                total += math.log2(p if bit else 1 - p)
                j = j * 2 + bit
        return total


TRAIN = ["the cat sat on the mat", "a cat and a dog", "the dog sat", "Ünï cödé the THE the", ""]
TEST = ["the cat", "zebra the dog", "", "ünï", "a  b\tc\n\nTHE"]


def words(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()


def stream(t, depth):
    return b"\n" * depth + b" ".join(words(t)) + b"\n"


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 5])
def test_core(depth):
    grams = np.concatenate([g for t in TRAIN for g in lm.grams_of(lm.words_of(t), depth)])
    tables = ctw.build(*np.unique(grams, return_counts=True), depth)
    slow = Slow([stream(t, depth) for t in TRAIN], depth)
    for t in TRAIN + TEST:
        got = sum(tables.log2(g).sum() for g in lm.grams_of(lm.words_of(t), depth))
        assert abs(got - slow.log2(stream(t, depth))) < 1e-8
    for past in (b"the c", b"zzzzz", b"\n" * 5):
        context = sum(b << (8 * (depth - 1 - k)) for k, b in enumerate(past[::-1][:depth]))
        whole = np.exp2(tables.log2(np.uint64(context << 8) | np.arange(256, dtype=np.uint64))).sum()
        assert abs(whole - 1) < 1e-9


def test_a_rare_byte_after_very_many_of_another():
    """However often one byte was seen, the other costs a finite number of bits."""
    depth = 2
    for n in (20_000_000, 10**9, 10**14):
        grams = np.array([0x616161, 0x616162], np.uint64)
        tables = ctw.build(grams, np.array([n, 1]), depth)
        tables.odds = [x.astype(np.float32) for x in tables.odds]
        common, rare, unseen = tables.log2(np.array([0x616161, 0x616162, 0x616163], np.uint64))
        assert -1e-6 < common <= 0 and math.isclose(rare, -math.log2(n), rel_tol=0.1) and -200 < unseen < rare


def test_kt_by_series():
    for a, b in ((0, 0), (3, 9), (5000, 1), (10**6, 12345), (4096, 4097)):
        want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        assert abs(ctw.kt_log(np.array([a]), np.array([b]))[0] - want) < 1e-6 * max(1, abs(want))


@pytest.mark.parametrize("held_nodes,hot_words,depth", [(10**9, 10**6, 3), (10**9, 3, 1), (0, 3, 3), (0, 10**6, 1), (10**9, 0, 0)])
def test_operator(spark, held_nodes, hot_words, depth):
    rows = [(i, (TRAIN + TEST)[i % 10]) for i in range(60)] + [(None, "the"), (70, None), (71, "cat"), (71, "cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as held_out", "3 as row").repartition(3)
    got = lm.score(docs, fold(F.col("doc_id"), 5) == 1, depth=depth, held_nodes=held_nodes, hot_words=hot_words).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    train = [t or "" for i, t in rows if not out(i)]
    c = Counter(w for t in train for w in [*words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    slow = Slow([stream(t, depth) for t in train], depth)
    texts = {i: t or "" for i, t in rows}
    for r in got:
        t = texts[r.doc_id]
        own = [*words(t), b"\n"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out(r.doc_id), len(own), n)
        assert r.n_known == sum(c[w] > 0 for w in own)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-9
        assert abs(r.score - slow.log2(stream(t, depth)) * math.log10(2)) < 1e-5  # probabilities are stored as 32-bit floats
        assert r.n_bytes == len(stream(t, 0)) and abs(r.bits_per_byte * r.n_bytes * math.log10(2) + r.score) < 1e-9


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lm.score(docs.limit(0), F.lit(False)).count() == 0
    got = sorted(lm.score(docs, F.lit(True)).collect())
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0), (0, 0, 0.0)]
    assert [round(r.bits_per_byte, 9) for r in got] == [8.0, 8.0]


def test_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = lm.score(docs, fold(docs["doc_id"], 5) == 1).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_a_tree_too_large_to_hold_adds_little_on_disk(spark, sf, monkeypatch):
    """Same scores; what is settled for them beyond the tree itself is no more than when
    workers hold the tree (a text's grams would be many times the text)."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    monkeypatch.setattr(lm, "CHUNK", 100_000, raising=False)
    monkeypatch.setattr(lm, "KEPT_GRAMS", 20_000, raising=False)
    settle, size = lm.materialize, {}

    def measured(df, tag="t", **options):
        out = settle(df, tag, **options)
        size[tag] = sum(p.stat().st_size for p in pathlib.Path(out._waymark_path.removeprefix("file://")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(lm, "materialize", measured)
    rows = {}
    for held_nodes in (10**9, 0):
        got = lm.score(docs, fold(docs["doc_id"], 5) == 1, held_nodes=held_nodes).collect()
        rows[held_nodes] = {r.doc_id: r for r in got}, size["scores"]
    (one, small), (other, large) = rows.values()
    assert one.keys() == other.keys() and large <= 1.1 * small
    assert all(abs(one[i].score - other[i].score) < 1e-9 * abs(one[i].score) for i in one)
    assert size["groups"] < 1.5 * size["nodes"]
