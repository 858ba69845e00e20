"""Line dedup: planted passages go, clean texts stay, and every cut is repeated elsewhere."""

import difflib
import random
import re

from waymark.llm import line_dedup


def text_of(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return "".join(w + rng.choice(["", "", "", ".", ","]) + rng.choice([" "] * 12 + ["\n"]) for w in words).rstrip()


def test_planted_passages(spark):
    rng = random.Random(11)
    passages = [text_of(rng, n) for n in (56, 61, 75, 90, 130, 200, 58, 64) * 4]
    clean = {i: text_of(rng, rng.randint(20, 400)) for i in range(150)}
    texts, hosts = dict(clean), {}
    for k, p in enumerate(passages):
        for i in rng.sample(range(150), 5):
            if i in hosts:
                continue
            words = clean[i].split(" ")
            at = rng.randrange(len(words) + 1)
            texts[i], hosts[i] = " ".join([*words[:at], p, *words[at:]]), k
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    seen, whole, left_over = set(), 0, []
    for i in range(150):
        k = hosts.get(i)
        if k is None or k not in seen:
            seen.add(k)
            assert got[i].text == texts[i] and got[i].removed_words == 0
            continue
        gone = len(texts[i].split()) - len(got[i].text.split())
        left_over.append(len(passages[k].split()) - gone)
        assert re.sub(r"\s+", " ", got[i].text) in re.sub(r"\s+", " ", texts[i]) or got[i].removed_spans >= 1
    assert len(left_over) > 60
    assert sum(abs(x) <= 2 for x in left_over) / len(left_over) > 0.9
    assert sum(x > 20 for x in left_over) / len(left_over) < 0.03


def test_cuts_are_repeated_text(spark, sf):
    """What goes from a document of the table stands, word for word, in an earlier one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    n = 0
    for r in line_dedup.dedup(docs).collect():
        if not r.removed_spans:
            assert r.text == texts[r.doc_id]
            continue
        before = [" ".join(t.split()) for i, t in texts.items() if i < r.doc_id]
        words, left = texts[r.doc_id].split(), r.text.split()
        assert len(words) - len(left) >= 38
        matcher = difflib.SequenceMatcher(None, words, left, autojunk=False)
        gone = [words[a:b] for op, a, b, _, _ in matcher.get_opcodes() if op != "equal"]
        for g in gone:
            if len(g) > 16:
                parts = [" ".join(g[k : k + 4]) for k in range(0, len(g) - 3, 4)]
                assert sum(any(p in t for t in before) for p in parts) >= 0.8 * len(parts)
                n += 1
    assert n > 5


def test_odd_rows(spark):
    p = text_of(random.Random(2), 80)
    rows = [(None, p), (1, None), (2, ""), (3, "short"), (4, "a " * 50000), (5, p), (5, p), (6, p + "\n" + p), (7, " \n\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as th", "3 as c", "4 as removed_words")
    out = line_dedup.dedup(docs)
    assert out.columns == ["doc_id", "text", "id", "th", "c", "removed_words", "removed_spans"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert len(got) == len(rows)
    by = dict(got)
    assert by[None] == p and [t for i, t in got if i == 5] == [p, p] and by[1] is None and by[2] == "" and by[3] == "short" and by[7] == " \n\n "
    assert by[6].strip() == ""
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_every_passage_of_50_words_is_found(spark):
    """Prose of few initials, and passages of 52 words in foreign surroundings."""
    rng = random.Random(5)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "abdeghjkmnpqstvwyz"):
        word = lambda: rng.choice(letters) + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 8)))  # noqa: E731, B023
        passages = [" ".join(word() for _ in range(52)) for _ in range(300)]
        rows = []
        for k, p in enumerate(passages):
            for i in (k, 1000 + k):
                rows.append((i, " ".join([*(word() for _ in range(rng.randint(20, 60))), p, *(word() for _ in range(rng.randint(20, 60)))])))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
        texts = dict(rows)
        assert all(got[i].text == texts[i] for i in range(300))
        for k, p in enumerate(passages):
            assert got[1000 + k].removed_words >= 52 and p not in got[1000 + k].text


def test_patterns_over_and_over(spark):
    """One word, or a few, again and again, beside other words."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    rows = []
    for k, pattern in enumerate((["aa"], ["bb", "cc"], ["dd", "ee", "ff"], ["g", "h", "i", "j"])):
        for copy in range(2):
            body = (pattern * 900)[copy : copy + 700 + 100 * copy]
            rows.append((10 * copy + k, " ".join([*(word() for _ in range(30 + 7 * copy)), *body, *(word() for _ in range(25))])))
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(4):
        assert got[k].removed_words == 0 and 700 <= got[10 + k].removed_words <= 800, k


def test_all_that_repeats_is_cut(spark, sf):
    """Brute force: no 50 words in a row of what is left stand in an earlier document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    left = {r.doc_id: r.text.split() for r in line_dedup.dedup(docs).collect()}
    windows = lambda ws: [tuple(ws[k : k + 50]) for k in range(len(ws) - 49)]
    earlier, repeated, survived = set(), 0, 0
    for i in sorted(texts):
        repeated += any(w in earlier for w in windows(texts[i]))
        survived += any(w in earlier for w in windows(left[i]))
        earlier.update(windows(texts[i]))
    assert repeated > 10 and survived == 0
