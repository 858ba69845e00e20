"""Decontamination against brute-force word n-grams, planted paraphrases and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from waymark.llm import decontaminate as D


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def slow_leaks(docs, items, n=8, share=0.9):
    """Pairs where nearly all word n-grams of the item stand in the document."""
    grams = {}
    for i, t in items:
        ws = D.words_of(t)
        for k in range(max(1, len(ws) - n + 1)):
            grams.setdefault(tuple(ws[k : k + n]), set()).add(i)
    sizes = {i: len({tuple(D.words_of(t)[k : k + n]) for k in range(max(1, len(D.words_of(t)) - n + 1))}) for i, t in items}
    out = set()
    for d, t in docs:
        ws, seen = D.words_of(t), {}
        for k in range(max(1, len(ws) - 4)):
            for size in {n}:
                for i in grams.get(tuple(ws[k : k + size]), ()):
                    seen.setdefault(i, set()).add(tuple(ws[k : k + size]))
        out |= {(d, i) for i, s in seen.items() if len(s) >= share * sizes[i]}
    return out


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert D.lcs(a, b) == slow_lcs(a, b)


def test_svd_finds_the_space(spark):
    rng = np.random.default_rng(0)
    dense = rng.standard_normal((60, 5)) @ rng.standard_normal((5, 40)) + 0.01 * rng.standard_normal((60, 40))
    rows = spark.createDataFrame([(list(range(40)), [float(x) for x in r]) for r in dense], "ids array<int>, weights array<double>").repartition(3)
    v = D.randomised_svd(rows, 40, rank=5)
    true = np.linalg.svd(dense)[2][:5].T
    assert v.shape == (40, 5) and np.linalg.norm(true - v @ (v.T @ true)) < 1e-2


@pytest.mark.parametrize("table", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_precision(spark, table):
    docs, items = (spark.read.parquet(f"{table}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()}
    want = slow_leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert len(want) > 10 and len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.02 * len(want)


def test_paraphrases(spark, sf):
    rng = random.Random(3)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    clean = [(d, t) for d, t in docs if d not in {d for d, _ in slow_leaks(docs, items)}]
    planted, truth = [], set()
    for k, (i, t) in enumerate(items):
        words = t.split()
        if len(words) < 20:
            continue
        for at in rng.sample(range(len(words)), len(words) // 5):
            words[at] = rng.choice(["qux", "zorp", "blick", "fnord"])
        host = clean[k][1].split()
        at = rng.randrange(len(host) + 1)
        planted.append((100_000 + k, " ".join([*host[:at], *words, *host[at:]])))
        truth.add((100_000 + k, i))
    table = spark.createDataFrame(clean + planted, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and not {d for d, _ in got} - {d for d, _ in truth}
    kept = D.clean(table, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in clean + planted} - {d for d, _ in got}


def test_odd_rows(spark):
    item = "Quarble the frindle over nine wuthering mossbanks before dawn. Then spindle twelve."
    rows = [(1, None), (2, ""), (3, f"well {item} indeed"), (3, f"well {item} indeed"), (None, item), (5, "x " * 50000 + item), (6, "a plain text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item", "2 as id", "3 as start")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (None, item), (10, ""), (11, "too short"), (12, "A plain text!")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()), key=str)
    assert got == sorted([(d, i) for d in (3, 3, None, 5) for i in (7, 8)] + [(6, 12)], key=str)
    assert sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, items, items=1).collect()), key=str) == got
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
    assert sorted(r.doc_id for r in D.clean(docs, items).collect()) == [1, 2]


def test_rows_are_judged_by_their_own_text(spark):
    """Ids may be null or shared: a leaking row goes alone."""
    item = "Quarble the frindle over nine wuthering mossbanks before dawn. Then spindle twelve."
    rows = [(None, item), (None, "nothing of the kind"), (3, f"so {item}"), (3, "a clean row of the same id"), (4, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _wm_key", "2 as _wm_text", "3 as _wm_leak", "4 as leaks")
    got = D.clean(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)


def test_parts_of_long_items(spark):
    """A document that holds 120 words of a 400-word item."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    prose = [word() for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(prose) for _ in range(n))
    items = [(k, text(400)) for k in range(20)] + [(100 + k, text(30)) for k in range(20)]
    rows, truth = [(k, text(300)) for k in range(100)], set()
    for k in range(40):
        words, at = items[k % 20][1].split(), rng.randrange(281)
        rows.append((1000 + k, " ".join([text(rng.randint(0, 90)), *words[at : at + 120], text(rng.randint(0, 90))])))
        truth.add((1000 + k, k % 20))
    rows += [(2000 + k, f"{text(40)} {items[k][1]} {text(40)}") for k in range(40)]
    truth |= {(2000 + k, items[k][0]) for k in range(40)}
    got = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth and len(got) == len(truth)
    some = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), items=60, held=2).collect()
    assert {(r.doc_id, r.item_id) for r in some} == truth


def test_sampled_passages_come_from_all_parts_of_texts():
    words = list(range(500))
    starts = {D.passage(words, f"text {k}")[0] for k in range(2000)}
    assert starts == set(range(0, 481, D.STRIDE))
    assert D.passage(words[:20], "x") == words[:20] and D.passage([], "") == []
    assert all(len(D.passage(words[:n], f"text {k}")) > 16 for n in range(33, 80) for k in range(40))


def test_all_passages_take_part_in_the_fit(spark, monkeypatch):
    """The matrix of the space has every passage of every text, however many there are, and
    its products of terms are those of the passages one by one."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    items = [(k, " ".join(words[20 * k : 20 * k + 20])) for k in range(10)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 150))) for _ in range(300)] + [None, ""]
    held, svd = [], D.randomised_svd
    monkeypatch.setattr(D, "COMMON", 1.0)
    monkeypatch.setattr(D, "randomised_svd", lambda rows, *args: held.extend(rows.collect()) or svd(rows, *args))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    (space,) = D.fit(docs, [items], passages=50)
    got = np.zeros((len(space.terms),) * 2)
    for r in held:
        got[np.ix_(r.ids, r.ids)] += np.outer(r.weights, r.weights)
    split = [(t or "").split() for t in texts]
    df = {w: sum(w in s for s in split) for w in space.terms}
    idf = {w: np.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in df}
    parts = [[w for w in s[at : at + D.WINDOW] if w in df] for s in split for at in range(0, len(s), D.WINDOW)]
    parts = [p for p in parts if len(p) > 2]
    assert len(parts) > 500
    want = np.zeros_like(got)
    for own, scale in [(t.split(), 1.0) for _, t in items] + [(p, D.PASSAGE_WEIGHT * (50 / len(parts)) ** 0.5) for p in parts]:
        x = np.zeros(len(got))
        for w in own:
            x[space.terms[w]] += idf[w]
        x *= scale / np.linalg.norm(x)
        want += np.outer(x, x)
    assert np.allclose(got, want, atol=1e-9)


def test_words_part_and_strip_like_python():
    rng = random.Random(6)
    some = [*" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u3000", *"aZ09é.,!«»„…İΣσßΑ'^`\u0307\xad\u200b\u2060—·|<>", *map(chr, range(33, 127))]
    anywhere = lambda: chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)]))
    texts = ["".join(rng.choice(some) if rng.random() < 0.98 else anywhere() for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["", " ", "...", " a ", "ΑΣ", "ΑΣ. ΑΣ\xad Σ", None]
    words = D.Words(pa.array(texts))
    want = [[x.strip(D._MARKS) for x in (t or "").lower().split()] for t in texts]
    assert [words.of(k) for k in range(len(texts))] == want and words.sizes.tolist() == list(map(len, want))
    assert words.of(texts.index("ΑΣ. ΑΣ\xad Σ"), 1, 2) == ["ας\xad"]
    terms = sorted({w for ws in want for w in ws if w})[::3]
    _, text, place, number = words.known(pa.array(terms))
    assert [(k, p, terms[n]) for k, p, n in zip(text, place, number, strict=True)] == [(k, p, w) for k, ws in enumerate(want) for p, w in enumerate(ws) if w in set(terms)]
    assert D.Words(pa.array([None, ""], pa.string())).sizes.tolist() == [0, 0]


def test_only_windows_with_enough_rare_words_are_compared(spark, monkeypatch):
    """The costly comparison is for places that its first condition leaves, and what is
    found is what comparing every close window finds."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(5)) for _ in range(300)]
    items = [(k, f"{' '.join(rng.sample(words, 28))}. {' '.join(rng.sample(words, 4))}!") for k in range(30)] + [(99, "two words")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 150))) for _ in range(150)] + [None, "", "Two, WORDS"]
    texts += [f"{' '.join(rng.choices(words, k=rng.randint(0, 60)))}\n«{items[k][1].upper()}» {' '.join(rng.choices(words, k=rng.randint(0, 60)))}" for k in range(30)]
    monkeypatch.setattr(D, "COMMON", 1.0)
    (space,) = D.fit(spark.createDataFrame([(t,) for t in texts], "text string"), [items], passages=50)
    verify, shares, want = D.verify, [], set()
    for k, t in enumerate(texts):
        own = [x.strip(D._MARKS) for x in (t or "").lower().split()]
        if own == ["two", "words"]:
            want.add((k, 99))
        for start in range(0, len(own), D.STRIDE):
            x = space.vectors[[space.terms[w] for w in own[start : start + D.WINDOW] if w in space.terms]]
            if len(x) > 1:
                close = space.items @ x.sum(0) / np.linalg.norm(x.sum(0))
                want |= {(k, space.ids[e]) for e in np.flatnonzero(close >= 0.2).tolist() if verify(space, e, own, start)}

    def counted(space, entry, own, start):
        shares.append(len(space.rare[entry].intersection(own)) / len(space.rare[entry]))
        return verify(space, entry, own, start)

    monkeypatch.setattr(D, "verify", counted)
    got = [(row[0], row[1]) for row in D.held_items(space, D.Words(pa.array(texts)), 0.2)]
    assert set(got) == want and len(got) == len(want) > 30
    assert min(shares) >= D.RARE_SHARE
