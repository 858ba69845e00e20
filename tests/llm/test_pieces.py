"""SentencePiece transducer against the library, brute force and round trips."""

import itertools
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from waymark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OURS = pieces.Transducer(PATH)

ODD = ["", " ", "   ", "\n", "\n\n a", " lead", "Hello  world\n a", "日本 é\U0001f600\t x  ", "a" * 50, "x" + " " * 40 + "y",
       "<s> </s> <unk> <0x0A>", "def f(x):\n        return   x**2", "é ﬁ ½ ²", "▁a▁", "\x00\x01", "1234567890 3.14"]


@pytest.mark.parametrize("text", ODD)
def test_like_the_library(text):
    assert OURS.encode(text) == LIBRARY.encode(text)
    assert OURS.decode(OURS.encode(text)) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcdefgehinorstu  \n\tABéñ日.,!12▁"), max_size=60))
def test_like_the_library_on_any_text(text):
    assert OURS.encode(text) == LIBRARY.encode(text)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pieces.encode(docs, PATH).collect()
    assert [r.piece_ids for r in rows] == LIBRARY.encode([r.text for r in rows])
    assert all(r.exact for r in pieces.digest(docs, PATH).collect())


def field(number, kind, data):
    key = bytes([(number << 3 | kind) & 0x7F]) if number < 16 else bytes([(number << 3 | kind) & 0x7F | 0x80, number >> 4])
    return key + (bytes([len(data)]) + data if kind == 2 else data)


def test_unigram_by_brute_force(tmp_path):
    rng = random.Random(2)
    words = ["a", "b", "c", "ab", "bc", "abc", "ca", "▁", "▁a", "▁ab", "cab", "bb"]
    scores = {w: -rng.uniform(1, 6) for w in words}
    body = field(1, 2, field(1, 2, b"<unk>") + field(3, 0, b"\x02"))
    for w in words:
        body += field(1, 2, field(1, 2, w.encode()) + field(2, 5, struct.pack("<f", scores[w])))
    body += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(4, 0, b"\x00"))
    path = tmp_path / "toy.model"
    path.write_bytes(body)
    t = pieces.Transducer(str(path))
    for text in map("".join, itertools.product("abc ", repeat=5)):
        unit = "▁" + text.replace(" ", "▁")
        best = None
        for cuts in itertools.product((0, 1), repeat=len(unit) - 1):
            parts, start = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(unit[start:k])
                    start = k
            parts.append(unit[start:])
            if all(p in scores for p in parts):
                cost = -sum(t.scores[t.ids[p]] for p in parts)
                if best is None or cost < best - 1e-9:
                    best = cost
        mine = t.encode(text)
        assert abs(-sum(t.scores[i] for i in mine) - best) < 1e-5
        assert t.decode(mine) == text


def every_path(unit):
    """All ways through the lattice: pieces, and lone characters that have none."""
    if not unit:
        yield []
    for end in range(1, len(unit) + 1):
        if unit[:end] in OURS.ids or end == 1:
            for rest in every_path(unit[end:]):
                yield [unit[:end], *rest]


def test_shortest_path_of_all():
    """Exactly one path of the byte-pair lattice is finite, and it is the one found."""
    rng = random.Random(6)
    for _ in range(400):
        unit = "".join(rng.choice("aeinorst▁é日") for _ in range(rng.randint(1, 9)))
        finite = [p for p in every_path(unit) if sum(OURS.weight(a, b) for a, b in zip(["", *p], p, strict=False)) == 0]
        assert finite == [OURS.path(unit)]


def test_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, "x y")], "doc_id long, text string").selectExpr("*", "'z' as piece_ids", "'z' as decoded")
    (row,) = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert row.piece_ids == LIBRARY.encode("x y") and row.decoded == "x y"


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x y"), (3, "x y"), (None, "long text " * 30000), (5, "▁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as piece_idx")
    got = pieces.digest(docs, PATH).collect()
    assert len(got) == len(rows) and [r.exact for r in got] == [True] * 5 + [False] and got[0].n_pieces == 0
    both = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert both.columns == [*docs.columns, "piece_ids", "decoded"]
    assert pieces.digest(docs.limit(0), PATH).count() == 0


def test_workers_forget_the_texts_of_a_task(spark, monkeypatch):
    """Workers live on beside the stages that follow, so a task's units must not stay."""
    texts = [f"unit{k} " * 3 for k in range(500)]
    docs = spark.createDataFrame([], "text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = pieces.encode(docs, PATH)
    out = [r for b in run(iter([pa.RecordBatch.from_pydict({"text": texts})])) for r in b.column("piece_ids").to_pylist()]
    held = pieces.compiled(PATH)
    assert not (held.known or held.older or held.weights or held.pairs)
    assert out == LIBRARY.encode(texts)
