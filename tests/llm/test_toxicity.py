"""Toxicity: held-out accuracy, the automaton against plain edit distance, odd rows."""

import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from waymark.llm import toxicity
from waymark.llm.common import fold


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(4)
    terms = ["moron", "mormon", "idiot", "scum", "worthless", "disgusting", "abcabcabc", "aaaaa"]
    weights = {t: 6.0 + k / 10 for k, t in enumerate(terms)} | {"lowei*": 6.0, "weak*": 6.0}
    lex = toxicity.Lexicon(weights)
    words = set(terms) | {"loweiX".lower(), "lowei", "lowe", "weakest", "", "a", "xlowei"}
    for t in terms:
        for _ in range(250):
            w = list(t)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    w.insert(k, rng.choice("abcdeilmnorstuw"))
                elif k < len(w) and kind == 1:
                    w[k] = rng.choice("abcdeilmnorstuw")
                elif k < len(w):
                    del w[k]
            words.add("".join(w))
    for w in words:
        found = [(0, -weights[t], t) for t in weights if t.endswith("*") and w.startswith(t[:-1])]
        found += [(d, -weights[t], t) for t in terms if (d := distance(w, t)) <= lex.allowed(t)]
        want = min(found, default=None)
        assert lex.match(w) == (want and (want[2], want[0])), w


def test_clean_words_are_no_misspellings():
    lex = toxicity.Lexicon({"moron": 7.0}, frozenset(["oron"]))
    assert lex.match("oron") is None and lex.match("morom") == ("moron", 1) and lex.match("m0ron") == ("moron", 1)


def test_quotation_scores_lower():
    lex = toxicity.Lexicon({"moron": 7.0})
    abuse = toxicity.features(lex, "you are a moron and nothing else")
    quote = toxicity.features(lex, 'the word "moron" was quoted by them')
    assert abuse[1] > quote[1] and abuse[3] > quote[3] and abuse[4] < quote[4]
    model = toxicity.Model(lex, toxicity._logistic(__import__("numpy").zeros((0, toxicity.FEATURES)), __import__("numpy").zeros(0)), -4.0)
    assert model.score("you are a moron") > model.score('they said "moron" here') > model.score("you are here")
    assert model.score("you are a m0ron") > 0.5


@pytest.mark.parametrize("table", ["/root/testdata/sf0.1"])
def test_held_out(spark, table):
    docs, labels = (spark.read.parquet(f"{table}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels, fold(docs["doc_id"], 3) == 1)
    rows = got.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    right = sum(r.predicted == 1 and r.toxic == 1 for r in held)
    assert right / sum(r.predicted for r in held) > 0.95 and right / sum(r.toxic for r in held) > 0.85


def test_held_out_misspellings(spark):
    """Held-out toxic texts that are found as they are, with every known word of five
    letters or more misspelled by one letter."""
    rng = random.Random(12)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = fold(docs["doc_id"], 3) == 1
    model = toxicity.fit(toxicity.training_rows(docs, labels, held))
    rows = docs.where(held).join(labels.where("toxic = 1"), "doc_id").select("text").collect()
    found = [r.text for r in rows if model.score(r.text) >= toxicity.THRESHOLD]
    caught = changed = 0

    def misspelled(m):
        w = m.group()
        if len(w) < 5 or not model.lexicon.match(w.lower()):
            return w
        k = rng.randrange(1, len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeiou0") + w[k:], w[:k] + rng.choice("xzq1") + w[k + 1 :]])

    for text in found:
        other = toxicity._WORD.sub(misspelled, text)
        if other != text:
            changed += 1
            caught += model.score(other) >= toxicity.THRESHOLD
    print(f"{caught} of {changed} misspelled, {len(found)} of {len(rows)} as they are")
    assert changed > 30 and caught >= 0.6 * changed


def test_context_is_counted_in_words():
    lex = toxicity.Lexicon({"moron": 7.0})
    long = " ".join(["extraordinarily" * 2] * 5)
    near, far = (toxicity.features(lex, f"they quoted {long}{more} moron {long}") for more in ("", " on and on"))
    assert near[4] > far[4] == 0.0
    assert toxicity._terms("a" * 60) >= {"a" * 60}


def test_odd_rows(spark):
    bad, good = "you idiot you %s idiot", "a fine day for %s walks"
    docs = [(i, (bad if i % 3 == 0 else good) % " ".join(f"w{(i * 7 + k) % 501}" for k in range(30))) for i in range(240)]
    rows = [*docs, (None, "idiot"), (900, None), (901, ""), (902, "calm " * 60000), (903, "idiot " * 60000), (3, "idiot"), (3, "idiot")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as y", "3 as lid")
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i, _ in docs] + [(None, 1), (5, None), (6, 1)], "doc_id long, toxic int")
    got = toxicity.classify(table, labels, fold(F.col("doc_id"), 3) == 1).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[903].predicted == 1 and by[902].predicted == by[900].predicted == by[901].predicted == 0
    assert by[900].score == by[901].score
    kept = toxicity.reject(table, labels)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} >= {900, 901, 902}
    assert toxicity.classify(table.limit(0), labels, fold(F.col("doc_id"), 3) == 1).count() == 0
    none = toxicity.classify(table, labels.limit(0), fold(F.col("doc_id"), 3) == 1).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}


def test_misspelled_words_of_a_stem():
    """A family of which no form has most documents keeps its words beside the stem."""
    pos = {"idiot": (130, 130), "idiots": (100, 100), "idio*": (230, 230), "idiot*": (100, 100)}
    lex = toxicity.Lexicon(toxicity._choose(pos, {}, 400, 10000))
    assert "idio*" in lex.weights
    assert all(lex.match(w) and lex.match(w)[1] == 1 for w in ("idi0t", "1diot", "id1ots", "iddiot"))
    assert lex.match("idiotic") == ("idio*", 0) and lex.match("idiot")[1] == 0 and lex.match("idle") is None


def test_terms_are_passed_on_in_parts():
    """What a worker holds of the terms of toxic texts is bounded, however many a batch has."""
    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randrange(200)}" for _ in range(40)) for _ in range(300)] + [None, ""]
    own = max(len(toxicity._terms(t)) for t in texts[:-2])
    want, got = Counter(), Counter()
    for t in texts[:-2]:
        want.update((x, toxicity._signature(t)) for x in toxicity._terms(t))
    for b in toxicity._counted([pa.RecordBatch.from_pydict({"t": texts})], 1000):
        assert len(b) < 1000 + own
        for r in b.to_pylist():
            got[r["t"], r["s"]] += r["n"]
    assert got == want and len(want) > 5000
