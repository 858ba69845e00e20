"""SimHash against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from waymark.llm import simhash, vantage


def slow_fingerprint(text, size=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: (id, fp); the smallest id of each component."""
    fps = sorted({f for _, f in prints})
    x = np.array(fps, np.uint64)
    label = list(range(len(fps)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(x ^ x[a]) <= 2):
            ra, rb = root(a), root(int(b))
            label[max(ra, rb)] = min(ra, rb)
    low = {}
    for i, f in prints:
        r = root(fps.index(f))
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, f"{f:016x}", low.get(root(fps.index(f)))) for i, f in prints), key=str)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.components(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == slow_components(rows)


@pytest.mark.parametrize("leaf_rows,block_rows", [(8, 4096), (64, 16), (10**6, 10**6)])
def test_links_are_exact_and_connect(spark, leaf_rows, block_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = []
    for f in base[:30]:
        for _ in range(12):
            for _ in range(rng.integers(1, 4)):
                f ^= np.uint64(1) << np.uint64(rng.integers(64))
            near.append(f)
    fps = sorted({int(f) for f in [*base, *near]})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    points = spark.createDataFrame([(s, s) for s in signed], "node long, w0 long").repartition(3)
    found = vantage.links(points, ["w0"], 2, vantage.blocks(1, 2), leaf_rows=leaf_rows, block_rows=block_rows).collect()
    x = np.array(fps, np.uint64)
    at = {s: k for k, s in enumerate(signed)}

    def parts(pairs):
        label = list(range(len(fps)))
        for a, b in pairs:
            old, new = label[a], label[b]
            label = [new if v == old else v for v in label]
        groups = {}
        for k, v in enumerate(label):
            groups.setdefault(v, set()).add(k)
        return sorted(map(sorted, groups.values()))

    true = [(a, int(b)) for a in range(len(x)) for b in np.flatnonzero(np.bitwise_count(x ^ x[a]) <= 2)]
    assert all(bin(fps[at[r.a]] ^ fps[at[r.b]]).count("1") <= 2 for r in found)
    assert parts(true) == parts((at[r.a], at[r.b]) for r in found)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "one"), (None, "two words"), (5, "ONE"), (6, "É x " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as id", "3 as component_id")
    got = sorted((tuple(r) for r in simhash.components(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    assert simhash.components(docs.limit(0)).count() == 0


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def test_near_duplicates(spark):
    """Copies with a few words changed go, whatever their group's size; others stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 6)))
    vocabulary = [word() for _ in range(3000)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 500))) for _ in range(120)]
    rows, copies = [(k, t) for k, t in enumerate(base)], {}
    for k in range(0, 60):
        for c in range(40 if k == 0 else 3):
            words = base[k].split()
            for at in rng.sample(range(len(words)), max(1, len(words) // 120)):
                words[at] = word()
            i = 1000 + 100 * k + c
            if len(shingles(base[k]) & shingles(" ".join(words))) >= 0.8 * len(shingles(base[k]) | shingles(" ".join(words))):
                rows.append((i, " ".join(words)))
                copies[i] = k
    rows += [(9000 + k, base[k]) for k in range(100, 120)] + [(9500, ""), (9501, None), (9502, ""), (None, base[3]), (9600, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as w0", "3 as root", "doc_id as low").repartition(4)
    kept = simhash.near_duplicates(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id for r in kept.collect()}
    assert set(range(120)) <= got and 9600 in got and None not in got
    assert not got & set(range(9000, 9020)) and len(got & {9500, 9501, 9502}) == 1
    assert len(got & set(copies)) <= 0.02 * len(copies)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_different_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in simhash.near_duplicates(docs).collect()}
    sets = {i: shingles(t) for i, t in rows.items()}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i in rows:
        if i not in kept:
            assert any(like(i, j) for j in rows if j != i)
    found = [(a, b) for a in kept for b in kept if a < b and like(a, b)]
    assert len(found) <= 1


def slow_near_duplicates(rows):
    """rows: (id, text); the smallest id of each component, over all pairs."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    return {min(rows[k][0] for k in range(len(rows)) if label[k] == v) for v in set(label)}


@pytest.mark.parametrize("rows_each", [3, 7, 2048])
def test_dense_families_like_brute_force(spark, rows_each):
    """Families with many candidates each, of which about half are similar enough."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for k in range(30):
            words, n = list(base), rng.randint(1, 10)
            at = rng.randrange(len(words) - n)
            words[at : at + n] = [rng.choice(vocabulary) for _ in range(n)]
            rows.append((100 * family + k, " ".join(words)))
    want = slow_near_duplicates(rows)
    assert 12 < len(want) < len(rows) / 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in simhash.near_duplicates(docs, rows_each=rows_each).collect()}
    assert len(got ^ want) <= 1


@pytest.mark.parametrize("rows_each", [10, 2048])
def test_pairs_beside_texts_of_the_same_words(spark, rows_each):
    """200 pairs of near copies, each beside ten texts of their words in another order; and
    one group of near copies with a third of all rows."""
    rng = random.Random(23)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    rows = []
    for k in range(200):
        base = [rng.choice(vocabulary) for _ in range(80)]
        other = list(base)
        other[rng.randrange(80)] = rng.choice(vocabulary)
        rows += [(100 * k, " ".join(base)), (100 * k + 1, " ".join(other))]
        rows += [(100 * k + 2 + d, " ".join(rng.sample(base, 80))) for d in range(10)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(1200):
        words = list(base)
        words[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((100_000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in simhash.near_duplicates(docs, rows_each=rows_each).collect()}
    assert got == {i for i, _ in rows if i % 100 != 1 and i < 100_000} | {100_000}


def test_similar_links_like_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        pool = np.arange(40, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 30))) for _ in range(40)]
        sets += [np.setdiff1d(sets[rng.integers(40)], rng.choice(pool, 2)) for _ in range(20)]
        sets = [s if len(s) else pool[:1] for s in sets]
        left, right, roots = rng.random(len(sets)) < 0.7, rng.random(len(sets)) < 0.7, rng.integers(0, 50, len(sets)).tolist()

        def parts(links):
            label = list(roots)
            for a, b in links:
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
            return [label.index(v) for v in label]

        like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))  # noqa: E731, B023
        true = [(a, b) for a in np.flatnonzero(left) for b in np.flatnonzero(right) if like(a, b)]
        got = simhash.similar_links(list(range(len(sets))), sets, left.tolist(), right.tolist(), roots, 0.8)
        assert all(like(a, b) for a, b in got) and parts(got) == parts(true)


def test_one_block_of_new_text_shares_a_key():
    """Pairs of a similarity of 0.8 to 0.85 with a block appended, inserted or replaced."""
    rng = random.Random(22)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    found = []
    for k in range(900):
        base, n, at = text(250), rng.randint(38, 58), rng.randrange(200)
        other = (base + text(n), base[:at] + text(n) + base[at:], base[:at] + text(n // 2) + base[at + n // 2 :])[k % 3]
        a, b = " ".join(base), " ".join(other)
        if 0.8 <= len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.85:
            found.append(bool((simhash.near_keys(simhash.shingles(a, 5)) == simhash.near_keys(simhash.shingles(b, 5))).any()))
    assert len(found) > 400 and sum(found) >= 0.98 * len(found)


def test_what_the_fingerprints_link_is_one_document(spark):
    """The filter keeps one document of each component of the operator: texts that repeat
    the same words with different ends, and chains of such with texts of like shingles."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(1, "la la la la"), (2, "la la la la la"), (3, "la la")]
    for k in range(20):
        base = text(11) * 40
        first, second = base + text(40), base + text(40)
        rows += [(100 * k + 10, " ".join(first)), (100 * k + 11, " ".join(second)), (100 * k + 12, " ".join(second[:-2]))]
    rows += [(5000 + k, " ".join(text(80))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    component = {r.doc_id: r.component_id for r in simhash.components(docs).collect()}
    assert sum(component[100 * k + 11] == 100 * k + 10 for k in range(20)) >= 18 and component[2] == 1
    got = {r.doc_id for r in simhash.near_duplicates(docs).collect()}
    linked = {c for i, c in component.items() if i != c}
    assert len(linked) >= 19 and linked <= got and not got & {i for i, c in component.items() if i != c}
    assert not got & {100 * k + 12 for k in range(20)} and set(range(5000, 5100)) <= got
