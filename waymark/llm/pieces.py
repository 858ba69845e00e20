"""SentencePiece encoding and decoding with weighted finite-state transducers.

A model file is compiled into three transducers: the normaliser (spaces become U+2581,
one is put before the text), the pieces (a trie whose final nodes give ids), and the byte
fallback (a character without a piece gives its UTF-8 bytes). They are composed with a
text's characters into a lattice, arc by arc as positions are reached, and the shortest
path in the tropical semiring (costs add up along a path, the least wins) is the encoding.

Weights. For a unigram model an arc costs minus the piece's score. For a byte-pair
model the states remember the last piece, and the arc to a next piece costs zero if
the two, merged on their own by the model's rules, stay the two they are, and infinity
if not: exactly one path is finite, and it is what merging the whole text gives, since
the first merge to cross a boundary between two pieces would cross it in the pair too.

No piece joins a character and a U+2581 after it, so a text is composed in units that
start where white space does; units are remembered.

Defined results: null text counts as empty, which has no pieces; a U+2581 in the text
comes back as a space, as the model file defines it; repeated rows give repeated
results; texts may be of any length; an empty table gives no rows; other columns are
kept by ``encode`` and ``decode``, but for one named like the column that they add, which
is replaced, and ignored by ``digest``.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import trimmed

SPACE = "▁"
#: Units that a worker remembers before it starts anew, with as many older ones to ask;
#: ``encode`` forgets them after each task, since workers live on beside later stages.
CACHE_UNITS = 400_000
_CACHE_PAIRS = 200_000

#: Kinds of pieces and models in the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Transducer:
    """The compiled model: encodes and decodes texts."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in message:
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.prefix = bool(normalizer.get(3, 1))
        if normalizer.get(2) or normalizer.get(4, 1) or trainer.get(24, 0) or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only identity normalisation, white space before words, and unigram or byte-pair models are compiled")
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        if any(self.kinds[i] == USER_DEFINED for i in usable):
            raise ValueError("user-defined pieces are not compiled")
        self.ids = {self.pieces[i]: i for i in usable}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece holds white space after a character")
        # units also end where no piece ever reaches across: at newlines, and between Latin letters and others
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        latin = "A-Za-zÀ-ÖØ-öø-ÿĀ-ɏ"
        mixed = any(len({bool(re.match(f"[{latin}]", c)) for c in p.lstrip(SPACE)}) > 1 for p in self.ids)
        if "\n" in joined:
            self.unit = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        elif mixed:
            self.unit = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        else:
            self.unit = re.compile(f"{SPACE}*[{latin}]+|{SPACE}*[^{latin}{SPACE}\n]+|{SPACE}+|\n")
        self.normaliser = {" ": SPACE}
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        # byte-pair states remember the last piece; without that, a piece's weight is its own
        self.remembers = self.kind == BPE
        self.least = 0.0 if self.remembers else -max((self.scores[i] for i in self.ids.values()), default=0.0)
        self.foreign = 10 - min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.out = [p.replace(SPACE, " ").encode() if k != BYTE else bytes([int(p[3:5], 16)]) for p, k in zip(self.pieces, self.kinds, strict=True)]
        for i, k in enumerate(self.kinds):
            if k == CONTROL:
                self.out[i] = b""
            elif k == UNKNOWN:
                self.out[i] = " ⁇ ".encode()
        self.code = "H" if len(self.pieces) <= 1 << 16 else "I"
        self.weights: dict[str, dict[str, float]] = {}
        self.pairs = 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop what was remembered of texts; what was compiled stays."""
        self.weights, self.pairs, self.known, self.older = {}, 0, {}, {}

    def normalised(self, text: str) -> str:
        """A text through the normaliser's arcs; they read one character each."""
        for read, written in self.normaliser.items():
            text = text.replace(read, written)
        return text

    # -- weights

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short text: best score first, then leftmost."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, last: str, piece: str) -> float:
        """What the arc of a piece costs after the last one (none at the start)."""
        if not self.remembers:
            i = self.ids.get(piece)
            return self.foreign if i is None else -self.scores[i]
        if not last:
            return 0.0 if self.merged(piece) == [piece] else math.inf
        return 0.0 if last + piece not in self.ids and self.merged(last + piece) == [last, piece] else math.inf

    # -- composition and shortest path

    def path(self, unit: str) -> list[str]:
        """Surfaces along the shortest path through the lattice of a unit."""
        if self.pairs > _CACHE_PAIRS:
            self.weights, self.pairs = {}, 0
        n, trie, weights, weight, least, remembers = len(unit), self.trie, self.weights, self.weight, self.least, self.remembers
        cost, back = [0.0] + [math.inf] * n, [""] * (n + 1)
        for start in range(n):
            here = cost[start]
            if here == math.inf:
                continue
            last = back[start] if remembers else ""
            known = weights.get(last)
            if known is None:
                known = weights[last] = {}
            node, end = trie, start
            while end < n:
                node = node.get(unit[end])
                end += 1
                if node is None:
                    if end > start + 1:
                        break
                    node = _NOWHERE  # no piece starts like this
                # pieces, and lone characters without one; no arc costs less than the least
                if ("" in node or end == start + 1) and here + least < cost[end]:
                    piece = unit[start:end]
                    w = known.get(piece)
                    if w is None:
                        w = known[piece] = weight(last, piece)
                        self.pairs += 1
                    if here + w < cost[end]:
                        cost[end], back[end] = here + w, piece
        out, end = [], n
        while end:
            out.append(back[end])
            end -= len(back[end])
        return out[::-1]

    def output(self, surface: str) -> list[int]:
        """The ids that an arc gives: the piece's, or those of the byte fallback."""
        i = self.ids.get(surface)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in surface.encode("utf-8", "replace")] if self.byte_fallback else [self.unknown]

    def _ids(self, unit: str) -> bytes:
        out = array(self.code)
        for surface in self.path(unit):
            got = self.output(surface)
            if got[0] != self.unknown or not out or out[-1] != self.unknown:
                out.extend(got)
        return out.tobytes()

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native-endian bytes of self.code."""
        if len(self.known) > CACHE_UNITS:
            self.older, self.known = self.known, {}
        put, find, normal = (SPACE if self.prefix else ""), self.unit.findall, self.normalised
        units = [find(put + normal(t)) if t else [] for t in texts]
        for u in set().union(*units).difference(self.known) if units else ():
            self.known[u] = self.older.get(u) or self._ids(u)
        get = self.known.__getitem__
        return [b"".join(map(get, us)) for us in units]

    def encode(self, text: str) -> list[int]:
        return array(self.code, self.encode_bytes([text])[0]).tolist()

    def decode(self, ids) -> str:
        out = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


_NOWHERE: dict = {}
_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _rows(batch: pa.RecordBatch, n: int = 512):
    for at in range(0, len(batch), n):
        yield batch.slice(at, n)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column, as views."""
    ends = column.offsets.to_numpy()
    flat = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)
    return [flat[lo:hi] for lo, hi in zip(ends - ends[0], (ends - ends[0])[1:], strict=False)]


def encode(docs: DataFrame, model: str, text="text", ids="piece_ids") -> DataFrame:
    """docs with the ids of its text's pieces added."""
    docs = docs.drop(ids) if ids != text else docs
    at = docs.columns.index(text)

    def run(batches):
        t = compiled(model)
        kind = np.dtype(np.uint16 if t.code == "H" else np.uint32)
        for whole in batches:
            for b in _rows(whole):
                data = t.encode_bytes([x or "" for x in b.column(at).to_pylist()])
                ends = np.cumsum([0, *(len(d) // kind.itemsize for d in data)]).astype(np.int32)
                flat = np.frombuffer(b"".join(data), kind).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*b.schema.names, ids])
        t.forget()

    return docs.mapInArrow(trimmed(run), StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, model: str, ids="piece_ids", text="decoded") -> DataFrame:
    """rows with the text of its ids added."""
    rows = rows.drop(text) if text != ids else rows
    at = rows.columns.index(ids)

    def run(batches):
        t = compiled(model)
        for whole in batches:
            for b in _rows(whole):
                out = [t.decode(ids.tolist()) for ids in _lists(b.column(at))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, text])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(text, StringType())]))


def digest(docs: DataFrame, model: str, id_col="doc_id", text="text") -> DataFrame:
    """(id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, exact) of every document,
    encoded and decoded in one pass."""

    def run(batches):
        t = compiled(model)
        kind = np.dtype(np.uint16 if t.code == "H" else np.uint32)
        fallback = np.zeros(len(t.pieces), bool)
        fallback[list(t.bytes.values())] = True
        for whole in batches:
            for b in _rows(whole, 256):
                texts = [x or "" for x in b.column(1).to_pylist()]
                ids = [np.frombuffer(x, kind) for x in t.encode_bytes(texts)]
                back = [t.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([int(fallback[x].sum()) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                        pa.array([x == y for x, y in zip(texts, back, strict=True)], pa.bool_()),
                    ],
                    ["id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "exact"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean")
    return out.withColumnRenamed("id", id_col)
