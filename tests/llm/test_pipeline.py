"""The pipeline's stages and its result against brute force."""

import os

import corpus_pipeline as P
import public_tokenizers
import pytest
import sentencepiece
from waymark.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_result(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids"]
    kept = {r.doc_id: r for r in out.collect()}
    # toxic documents go (as far as their small sample of labels tells), clean ones stay
    bad = [i for i, y in toxic.items() if y == 1]
    print(f"{sum(i in kept for i in bad)} of {len(bad)} toxic documents are left")
    assert sum(i in kept for i in bad) <= 0.35 * len(bad)
    # every kept text is a part of the document it was
    for i, r in kept.items():
        assert r.n_chars == len(r.text)
        assert r.text == docs[i].text or len(r.text) < len(docs[i].text)
    # no benchmark item is left whole
    for i, r in kept.items():
        words = " ".join(D.words_of(r.text))
        assert not any(" ".join(D.words_of(t)) in words for _, t in items), i
    # no two kept documents are near duplicates
    sets = {i: shingles(r.text) for i, r in kept.items()}
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b and 0.8 * len(sets[b]) <= len(sets[a]) <= 1.25 * len(sets[b])}
    close = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(close) <= 1
    # documents that nothing speaks against stay as they are
    leaking = {i for i, r in docs.items() if any(" ".join(D.words_of(t)) in " ".join(D.words_of(r.text)) for _, t in items)}
    grams = {}
    for i, r in docs.items():
        for g in shingles(r.text):
            grams.setdefault(g, set()).add(i)
    alone = [i for i, r in docs.items() if toxic.get(i) == 0 and i not in leaking and all(len(grams[g]) == 1 for g in shingles(r.text))]
    assert len(alone) > 20 and sum(i in kept and kept[i].text == docs[i].text for i in alone) >= 0.98 * len(alone)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.VOCABULARY))
    assert all(r.piece_ids == library.encode(r.text) for r in kept.values())


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_odd_rows(spark, tmp_path, name, stage):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "some text of a few words", None, "s", 24), (2, "some text of a few words", None, "s", 24),
            (3, "long text " * 30000, "en", None, None), (4, "other words entirely here now", "en", "s", 29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 as id", "2 as score", "3 as node", "4 as removed_words", "5 as w0", "6 as root", "7 as start", "8 as th"
    )
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b c d e f g"), (2, "an item of the benchmark that nothing holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ["piece_ids"] if name == "sentencepiece" else []
    wanted = [c for c in docs.columns if not (name == "line_dedup" and c == "removed_words")]
    out = stage(spark, docs, str(tmp_path))
    assert [c for c in out.columns if c in wanted or c in extra] == wanted + extra
    ids = [r.doc_id for r in out.collect()]
    assert {2, 3, 4} <= set(ids) and len(ids) <= len(rows)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    for table, columns in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    assert {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()} >= {2, 3, 4}


def test_tables_go_to_the_clusters_folder(spark, tmp_path):
    from waymark.llm.common import discard, materialize, scratch, shared_dir

    conf = spark.sparkContext._conf
    before = conf.get("spark.checkpoint.dir")
    conf.set("spark.checkpoint.dir", f"file://{tmp_path}/")
    try:
        assert shared_dir(spark) == f"file://{tmp_path}"
        one = materialize(spark.range(5))
        with scratch(spark) as keep:
            two, three = materialize(spark.range(6)), materialize(spark.range(7))
            keep.append(three)
        assert one.count() == 5 and three.count() == 7 and len(list(tmp_path.iterdir())) == 2
        assert not os.path.exists(two._waymark_path.removeprefix("file://"))
        discard(one)
        discard(one)
        assert len(list(tmp_path.iterdir())) == 1
    finally:
        conf.set("spark.checkpoint.dir", before or "")
    assert shared_dir(spark) == (before or shared_dir(spark))
