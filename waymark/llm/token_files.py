"""Token-id output: documents as token ids in Arrow files of equal-length sequences.

The ids of all documents, in ascending id order, are cut into sequences of
``SEQUENCE`` ids. A file is an Arrow IPC stream with a footer; its record batches
hold ``ids`` and ``mask`` as fixed-size lists, so any sequence is a view into the
memory-mapped file. Each file holds a range of documents and pads its last sequence
(mask 0). Files are written under a temporary name and moved into place, under a
name that depends on the data alone, so a repeated task writes the same file again.

Defined results: null text counts as empty (its ids are the end id alone); rows
with equal ids stand in the order of their texts' CRC and then of their token bytes,
null ids first; texts of any length are one document; an empty table gives no files and
no rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lots, materialize, new_path, trimmed

SEQUENCE = 1024
BATCH = 256
ROWS_PER_FILE = 65_536
#: Texts of a task, and bytes of them, that are encoded together, so that a word they share
#: is looked up once.
TEXTS, TEXT_BYTES = 2048, 16 << 20
#: Words that a worker remembers, in Arrow arrays; beyond that, half of them, the last used.
CACHE_WORDS = 400_000
#: Words of letters that are encoded as one line.
LINE_WORDS = 64

_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_{|}~"
#: Latin letters after which marks are a piece of their own: normalised and lower-cased
#: they still end in a letter (a capital I with a dot does not).
_LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and unicodedata.normalize("NFC", c).lower()[-1].isalpha())
#: Letters that stay as they are when normalised and lower-cased, and never part.
_SMALL = frozenset(map(chr, [*range(ord("a"), ord("z") + 1), *(k for k in range(0xDF, 0x100) if k != 0xF7)]))
_encoders: dict[str, Encoder] = {}


def _plain(text: str) -> bool:
    """Latin-1 only: lower-casing it first, as the tokenizer does later, changes nothing."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Token ids of whole texts, word by word: the tokenizer drops white space and
    never joins what it separates, so words between spaces and newlines are encoded
    on their own and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.last = self._ends()
        self.simple, self.signs = self._plainly()
        self._remember(pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64))
        self.now = 0

    def _ends(self) -> np.ndarray | None:
        """Which ids end a word, if the last id of every word says so."""
        import json

        from tokenizers.pre_tokenizers import ByteLevel

        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        if not suffix or any(c + suffix not in vocabulary for c in ByteLevel.alphabet()):
            return None
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        return out

    def _plainly(self):
        """The model after no more than a split at spaces, and the signs of the letters' bytes
        that it takes; None if words of these letters need more than that."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        signs = {ord(c): level.pre_tokenize_str(c)[0][0] for c in _SMALL}
        simple = Tokenizer(self.tokenizer.model)
        simple.pre_tokenizer = CharDelimiterSplit(" ")
        probe = " ".join(a + b for a in sorted(_SMALL) for b in sorted(_SMALL))
        got, want = (t.encode(x, add_special_tokens=False).ids for t, x in ((simple, probe.translate(signs)), (self.tokenizer, probe)))
        return (simple, signs) if got == want else (None, {})

    def _lines(self, tokenizer, words: list[str], known: dict[str, bytes], signs: dict[int, str] | None = None) -> list[str]:
        """Encodes words of letters many to a line, which saves most of a call's work;
        returns those of lines whose ids do not part into as many words."""
        parts, left = [words[at : at + LINE_WORDS] for at in range(0, len(words), LINE_WORDS)], []
        for at in range(0, len(parts), 64):
            some = parts[at : at + 64]
            lines = [" ".join(p) for p in some]
            if signs:
                lines = [x if x.isascii() else x.translate(signs) for x in lines]
            for part, e in zip(some, tokenizer.encode_batch_fast(lines, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype)
                ends = (np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize
                data = ids.tobytes()
                if len(ends) != len(part) or ends[-1] != len(data):
                    left += part
                    continue
                ends = ends.tolist()
                known.update((w, data[x:y]) for w, x, y in zip(part, [0, *ends[:-1]], ends, strict=True))
        return left

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of self.dtype."""
        if not texts:
            return []
        plain = [(t.lower() if _plain(t) and "<|" not in t else t).replace("\n", " ") for t in texts]
        split = pa.compute.split_pattern(pa.array(plain, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        ids = self._ids(words.dictionary).take(words.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(data if data is not None else b"")
        return [bytes(data[x:y]) for x, y in zip(ends, ends[1:], strict=False)]

    def _remember(self, words: pa.Array, ids: pa.Array, used: np.ndarray) -> None:
        if len(words) > CACHE_WORDS:
            keep = np.sort(np.argsort(used, kind="stable")[-(CACHE_WORDS // 2) :])
            words, ids, used = words.take(pa.array(keep)), ids.take(pa.array(keep)), used[keep]
        self.words, self.word_ids, self.used = words, ids, used

    def _ids(self, words: pa.Array) -> pa.Array:
        """The ids of different words: those remembered, and the others encoded."""
        self.now += 1
        places = pa.compute.index_in(words, value_set=self.words)
        self.used[places.drop_null().to_numpy()] = self.now
        new = words.filter(places.is_null())
        missing = new.to_numpy(zero_copy_only=False).tolist()
        known = self._learn(missing)
        ids = pa.concat_arrays([self.word_ids, pa.array([known[w] for w in missing], pa.large_binary())])
        at = places.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = np.arange(len(self.words), len(ids))
        out = ids.take(pa.array(at))
        self._remember(pa.concat_arrays([self.words, new]), ids, np.append(self.used, np.full(len(new), self.now)))
        return out

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of words that are not remembered."""
        pairs = {w: (stem, w[len(stem) :]) for w in missing if w and not w.isalnum() and (stem := w.rstrip(_MARKS)) != w and stem[-1:] in _LETTERS and "<|" not in w}
        own = set(missing).difference(pairs)
        parts = list(set().union(*pairs.values()).difference(own))
        places = pa.compute.index_in(pa.array(parts, pa.large_string()), value_set=self.words)
        known = dict(zip(parts, self.word_ids.take(places).to_numpy(zero_copy_only=False).tolist(), strict=True))
        words = [w for w, ids in known.items() if ids is None] + list(own)
        if self.last is not None:
            small, letters, others = [], [], []
            for w in words:
                (others if not w or not _LETTERS.issuperset(w) else small if self.simple and _SMALL.issuperset(w) else letters).append(w)
            words = others + self._lines(self.simple, small, known, self.signs) + self._lines(self.tokenizer, letters, known)
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            known.update((w, array(self.code, e.ids).tobytes()) for w, e in zip(part, found, strict=True))
        known.update((w, known[stem] + known[marks]) for w, (stem, marks) in pairs.items())
        return known

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _encoders[path] = cls(path)
        return _encoders[path]


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, id_col="doc_id", text="text", bounds=(), null_shards=1) -> DataFrame:
    """(id, ids binary, mix, shard): little-endian ids of each text and the end id, the
    text's CRC, and the range of ids that the row falls in. An id that fills several
    ranges is dealt out to them by the CRC; so are null ids to the ``null_shards`` first."""

    def place(key, mix: int) -> int:
        if key is None:
            return mix * null_shards >> 32
        lo, hi = bisect_left(bounds, key), bisect_right(bounds, key)
        return null_shards - 1 + lo + (mix * (hi - lo) >> 32)

    def run(batches):
        enc = Encoder.of(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            texts, keys = b.column(1), b.column(0).to_pylist()
            for at, n in lots(texts, TEXTS, TEXT_BYTES):
                own = [t or "" for t in texts.slice(at, n).to_pylist()]
                ids = [e + end for e in enc.encode(own)]
                mix = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in own]
                shards = list(map(place, keys[at : at + n], mix))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), pa.array(ids, pa.binary()), pa.array(mix, pa.int64()), pa.array(shards, pa.int32())], ["id", "ids", "mix", "shard"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(trimmed(run), f"id {kind}, ids binary, mix long, shard int")


def _schema(dtype: np.dtype, sequence: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.uint8(), sequence))])


class Writer:
    """Appends runs of ids to one file of equal-length sequences."""

    def __init__(self, sink, dtype: np.dtype, sequence=SEQUENCE, batch=BATCH):
        self.dtype, self.sequence, self.batch = dtype, sequence, batch
        self.schema = _schema(dtype, sequence)
        self.out = ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.size = 0

    def append(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.batch * self.sequence * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        whole = self.batch * self.sequence
        stop = len(flat) if last else len(flat) // whole * whole
        for at in range(0, stop, whole):
            part = flat[at : min(stop, at + whole)]
            rows = -(-len(part) // self.sequence)
            ids, mask = np.zeros(rows * self.sequence, self.dtype), np.zeros(rows * self.sequence, np.uint8)
            ids[: len(part)], mask[: len(part)] = part, 1
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        rest = flat[stop:].tobytes()
        self.held, self.size = ([rest] if rest else []), len(rest)

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class Reader:
    """Random access to a file's sequences; on a local file without copying."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.sequence = self.file.schema.field("ids").type.list_size
        self._at, self._batch = -1, None
        self.batch = len(self.file.get_batch(0)) if self.file.num_record_batches else 0

    def _numpy(self, batch: int) -> tuple[np.ndarray, np.ndarray]:
        if batch != self._at:
            got = self.file.get_batch(batch)
            self._batch = tuple(got.column(k).values.to_numpy(zero_copy_only=True) for k in range(2))
            self._at = batch
        return self._batch

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence k and its mask, as views."""
        ids, mask = self._numpy(k // self.batch)
        at = k % self.batch * self.sequence
        return ids[at : at + self.sequence], mask[at : at + self.sequence]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from position start of the file on."""
        parts, each = [], self.batch * self.sequence
        while n > 0:
            ids, _ = self._numpy(start // each)
            part = ids[start % each : start % each + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return pafs.LocalFileSystem(), uri


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str, id_col="doc_id", text="text",
          rows_per_file=ROWS_PER_FILE, sequence=SEQUENCE) -> DataFrame:
    """Writes the files and returns their index (id, file, shard, local_start, start,
    n_tokens): where each document's ids stand in its file and in the whole."""
    spark = docs.sparkSession
    rows, known = docs.agg(F.count("*"), F.count(id_col)).first()
    files = max(min(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-rows // rows_per_file), 1)
    bounds = docs.agg(F.percentile_approx(id_col, [k / files for k in range(1, files)], 10 * files).alias("b")).first()["b"] if files > 1 and known else []
    bounds = sorted(bounds or [])
    null_shards = 1 + (rows - known) * files // max(1, rows)
    ids = tokenized(docs, vocabulary, end_id, id_col, text, bounds, null_shards)
    ids = ids.repartitionById(len(bounds) + null_shards, F.col("shard")).sortWithinPartitions("id", "mix", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        enc = Encoder.of(vocabulary)
        writer = sink = None
        at = 0
        for b in batches:
            if not len(b):
                continue
            if writer is None:
                name = f"tokens-{b.column(2)[0].as_py():08d}.arrow"
                fs, path = filesystem(f"{folder}/{name}")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                held = f"{path}.{uuid.uuid4().hex}"
                sink = fs.open_output_stream(held)
                writer = Writer(sink, enc.dtype, sequence)
            sizes = []
            for ids_bytes in b.column(1):
                buf = ids_bytes.as_py()
                writer.append(buf)
                sizes.append(len(buf) // enc.dtype.itemsize)
            ends = np.cumsum(sizes) + at
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([name] * len(b)), b.column(2), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64())],
                ["id", "file", "shard", "local_start", "n_tokens"],
            )
            at = int(ends[-1])
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(held, path)

    kind = docs.schema[id_col].dataType.simpleString()
    index = ids.select("id", "ids", "shard").mapInArrow(trimmed(run), f"id {kind}, file string, shard int, local_start long, n_tokens long")
    index = materialize(index, "index")
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # one row a file
    base, total = [], 0
    for r in sizes:
        base.append((r["shard"], total))
        total += r["n"]
    bases = spark.createDataFrame(base, "shard int, base long")
    index = index.join(F.broadcast(bases), "shard")  # as many rows as files
    return index.select("id", "file", "shard", "local_start", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): the CRC of each document's ids, as unsigned
    little-endian 32-bit integers, as the files hold them."""

    def run(batches):
        reader, opened = None, None
        for b in batches:
            crcs = []
            for file, local, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if file != opened:
                    reader, opened = Reader(f"{folder}/{file}"), file
                crcs.append(zlib.crc32(reader.tokens(local, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    kind = index.schema["id"].dataType.simpleString()
    return index.select("id", "file", "local_start", "start", "n_tokens").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, vocabulary: str, end_id=2, id_col="doc_id", text="text") -> DataFrame:
    """Writes all documents' ids to files in the shared folder and reads them back."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_back(write(docs, vocabulary, end_id, folder, id_col, text), folder).withColumnRenamed("id", id_col)
