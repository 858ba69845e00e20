"""Token files against the tokenizer on whole texts."""

import gc
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.normalizers import Replace
from waymark.llm import token_files
from waymark.llm.common import lots

PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "Hello  WORLD\n\tit's they'll 12 345 ½",
    "café café ́x Ａｂｃ 日本語 text   nbsp em \x1c fs \x85 nel",
    "a<|endoftext|>b <|startoftext|> c <|END|>",
    "Σίσυφος ΣΑΣ İstanbul ǅ 한국어 한 \U0001f600 x‍y",
    "Été*** NAÏVE&&&, x's!!! don't... µm ß ÿ e\u0301. a\u0301*** b<|endoftext|>... $$$ ½. 1/2, <|x",
    "", " ", "\n\n", "!!!???,,,...  --__--", "'S 'T don'T",
]


def test_words_encode_like_whole_texts(spark, sf):
    tok = Tokenizer.from_file(PATH)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    enc = token_files.Encoder(PATH)
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_random_texts_of_all_planes():
    """Letters, marks and combining characters from everywhere, dotted capitals included."""
    rng = random.Random(4)
    tok, enc = Tokenizer.from_file(PATH), token_files.Encoder(PATH)
    pools = [[chr(c) for c in range(33, 127)], [chr(c) for c in range(0xC0, 0x250)], list("İıŞşĞİ.,!?;:)\u0307\u0301\u0327ΣσςǅßŉǰÅ\u212b\u2126\ufb1d\u0958\u1e9e"), list("éèñü¿¡«»„“”’"),
             [chr(c) for c in range(0x300, 0x370)], [chr(c) for c in range(0x370, 0x3000) if c not in range(0xD800, 0xE000)]]
    anywhere = lambda: chr(rng.choice([rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x110000)]))
    texts = []
    for _ in range(20_000):
        pool = rng.sample(pools, 2)
        letters = [rng.choice(rng.choice(pool)) if rng.random() < 0.97 else anywhere() for _ in range(rng.randint(1, 14))]
        texts.append("".join(c + rng.choice(["", "", "", "", " ", "\n", ".", ", "]) for c in letters))
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_one_id_may_hold_most_rows(spark, tmp_path):
    rows = [(7, f"word {k}") for k in range(300)] + [(k, "a b") for k in range(20)] + [(None, f"none {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = token_files.write(docs, PATH, 2, f"file://{tmp_path}/x", rows_per_file=50, sequence=16).collect()
    by_file = Counter(r.file for r in index)
    assert len(index) == len(rows) and len(by_file) >= 8 and max(by_file.values()) < 130
    ends = sorted((r.start, r.n_tokens, r.id) for r in index)
    assert all(a[0] + a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    ids = [i for _, _, i in ends]
    assert ids == [None] * 200 + sorted(i for i in ids if i is not None)


def check(docs, rows_per_file, sequence, tmp_path):
    tok = Tokenizer.from_file(PATH)
    index = token_files.write(docs, PATH, 2, f"file://{tmp_path}/x", rows_per_file=rows_per_file, sequence=sequence)
    got = {r.id: r for r in token_files.read_back(index, f"file://{tmp_path}/x").collect()}
    at, streams = 0, []
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        mine = got[r.doc_id]
        assert (mine.start, mine.n_tokens, mine.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        streams += ids
    whole = []
    for f in sorted({r.file for r in index.collect()}):
        reader = token_files.Reader(f"{tmp_path}/x/{f}")
        n = sum(len(reader.file.get_batch(k)) for k in range(reader.file.num_record_batches))
        assert reader.sequence == sequence
        for k in range(n):
            ids, mask = reader.row(k)
            assert len(ids) == sequence and not ids.flags.owndata and (k == n - 1 or mask.all())
            whole += ids[mask == 1].tolist()
        with pa.memory_map(f"{tmp_path}/x/{f}") as m:
            assert pa.ipc.open_file(m).schema.field("ids").type == pa.list_(pa.uint16(), sequence)
    assert whole == streams


def test_files(spark, sf, tmp_path):
    check(spark.read.parquet(f"{sf}/documents.parquet").repartition(3), 64, 128, tmp_path)


def test_one_file(spark, tmp_path):
    check(spark.createDataFrame(list(enumerate([*ODD, "long " * 60000, None])), "doc_id long, text string"), 10**6, 16, tmp_path)


def test_odd_rows(spark):
    rows = [(None, "a"), (None, None), (3, "b c"), (3, "b c"), (3, ""), (7, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as id", "3 as shard")
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.digest(docs, PATH).collect())
    assert [i for _, _, i in got] == [None, None, 3, 3, 3, 7]
    assert [s for s, _, _ in got] == [0, *np.cumsum([n for _, n, _ in got])[:-1]]
    assert token_files.digest(docs.limit(0), PATH).count() == 0


def test_words_of_letters_share_calls():
    """Many new words are encoded with few lines; a line that does not part into its words is
    encoded word by word."""
    rng = random.Random(9)
    tok, enc = Tokenizer.from_file(PATH), token_files.Encoder(PATH)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèñŉǆ") for _ in range(rng.randint(1, 15))) for _ in range(6400)]
    words += ["don't", "x2y", "12", "a-b", "İs", "éte"]
    lines = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            lines.extend(texts)
            return tok.encode_batch_fast(texts, **options)

    enc.tokenizer = Counting()
    want = [tok.encode(w, add_special_tokens=False).ids for w in words]
    assert [np.frombuffer(e, enc.dtype).tolist() for e in enc.encode(words)] == want
    assert len(lines) < 150
    other = token_files.Encoder(PATH)
    other.last[:] = False
    assert [np.frombuffer(e, other.dtype).tolist() for e in other.encode(words)] == want


def test_remembered_words_take_little_room(spark, sf, monkeypatch):
    """What a worker remembers is bounded, changes no ids, and is 60 bytes a word at most."""
    monkeypatch.setattr(token_files, "CACHE_WORDS", 2000)
    rng = random.Random(3)
    tok, enc = Tokenizer.from_file(PATH), token_files.Encoder(PATH)
    ends, parts = ["", ",", "...", "!?"], ["abcdefghijklmnopqrstuvwxyzàéîßüÿ", "abcXYZÀÉÎ", "aéñŉǆŁ"]
    texts = [" ".join("".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(1, 9))) + rng.choice(ends) for _ in range(200)) for _ in range(100)]
    texts += ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    rng.shuffle(texts)
    for _ in range(2):
        for at in range(0, len(texts), 7):
            own = texts[at : at + 7]
            for text, ids in zip(own, enc.encode(own), strict=True):
                assert np.frombuffer(ids, enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, text
            assert len(enc.words) == len(enc.word_ids) == len(enc.used) <= 2000
    assert enc.encode(["a", "", "a"]) == enc.encode(["a", "", "a"]) and enc.encode([]) == []
    monkeypatch.undo()
    words, before = ["".join(rng.choices(parts[0], k=8)) for _ in range(100_000)], pa.total_allocated_bytes()
    tracemalloc.start()
    enc = token_files.Encoder(PATH)
    enc.encode([" ".join(words)])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 60 * len(words)


def test_small_letters_need_no_pattern():
    """The shorter way gives the tokenizer's ids for words of its letters, and is not used
    where the tokenizer would treat them otherwise."""
    rng = random.Random(5)
    tok, enc = Tokenizer.from_file(PATH), token_files.Encoder(PATH)
    words = ["".join(rng.choice(sorted(token_files._SMALL)) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    assert enc.simple and [np.frombuffer(e, enc.dtype).tolist() for e in enc.encode(words)] == [tok.encode(w, add_special_tokens=False).ids for w in words]
    other = token_files.Encoder(PATH)
    other.tokenizer.normalizer = Replace("é", "e")
    assert other._plainly() == (None, {})


def test_long_texts_are_taken_in_smaller_lots():
    texts = pa.array(["a" * n for n in [3, 0, 4, 30, 1, 1, 1, 1, 1, 1, 9]] + [None, "é" * 5, "b"])
    for own in (texts, texts.slice(2), texts.slice(0, 0), pa.array([None, None], pa.string()), texts.cast(pa.large_string())):
        got = list(lots(own, 4, 10))
        assert [k for at, n in got for k in range(at, at + n)] == list(range(len(own)))
        sizes = [[len((t or "").encode()) for t in own.slice(at, n).to_pylist()] for at, n in got]
        assert all(len(x) == 1 or len(x) <= 4 and sum(x) <= 10 for x in sizes)
        assert all(len(x) == 4 or sum(x) + y[0] > 10 for x, y in zip(sizes, sizes[1:], strict=False))
