"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and all passages of the corpus make a TF-IDF matrix (document
frequencies are counted over the whole corpus; passages of the same terms are one row, by
their number) whose randomised SVD is computed in distributed steps: every step multiplies the partitions' sparse rows with a broadcast
block and adds up the results. All windows of all documents are then mapped into the
latent space and compared with all items by cosine; windows that come close are
checked in their surroundings by the longest common subsequence of words, by the
share of the item's rare words, and by whether the item's answer (its last sentence)
is there.

Items are taken in groups of about ``ITEMS`` of them, so what is broadcast (term
vectors and item vectors) is bounded whatever the size of the benchmark; ``HELD`` groups
at a time share their passes over the corpus. A long item is also looked for in parts of
``PART`` words.

Defined results: null and empty texts and items match nothing; items shorter than
``MIN_WORDS`` words are found in documents whose words are just theirs; repeated rows
give repeated results, items with the same text are found alike; an empty table gives no
rows; extra columns are ignored by ``leaks`` and kept by ``clean``, which judges every
row by its own text, whatever its id, so rows without an id or with a shared one stay or
go by themselves.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lots, materialize, trim_memory, trimmed

ITEMS = 4096
#: Texts of a task, and bytes of them, whose words are looked up together.
TEXTS, TEXT_BYTES = 512, 16 << 20
#: Groups whose spaces workers hold at a time.
HELD = 4
MIN_WORDS = 5
#: Words of the parts that a longer item is also looked for in; they overlap by half.
PART = 64
WINDOW, STRIDE = 32, 16
RANK, OVERSAMPLE, POWER = 128, 16, 2
#: All corpus passages take part in fitting the space; together they weigh as much as so
#: many, at most, so that the items keep their share of the space whatever the corpus.
PASSAGES = 4096
PASSAGE_WEIGHT = 0.2
#: Words in more than this share of documents are left out, but for the RAREST of an item.
COMMON, RAREST = 0.02, 6
COSINE = 0.45
VERBATIM, PARAPHRASE, RARE_SHARE, ANSWER_SHARE = 0.8, 0.5, 0.5, 0.5

_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿“”„‘’«»…–—·"
_ASCII_MARKS = "".join(c for c in _MARKS if c.isascii())


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without the marks around them."""
    return [w for w in (x.strip(_MARKS) for x in (text or "").lower().split()) if w]


class Words:
    """The words of texts, parted as by str.split() and without their marks; every different
    one is looked at once. ``place`` has each word's number, ``starts`` where texts begin."""

    def __init__(self, texts: pa.Array):
        split = pc.utf8_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        raw, place, starts = words.dictionary, words.indices.to_numpy(), split.offsets.to_numpy()
        full = pc.binary_length(raw).to_numpy() > 0
        if not full.all():
            good = full[place]
            place, starts = place[good], np.concatenate([[0], np.cumsum(good)])[starts]
        self.place, self.starts, self.sizes = place, starts, np.diff(starts)
        wide = pc.invert(pc.string_is_ascii(raw))
        others = [x.lower().strip(_MARKS) for x in raw.filter(wide).to_numpy(zero_copy_only=False)]
        narrow = pc.ascii_trim(pc.ascii_lower(raw), characters=_ASCII_MARKS)
        self.different = pc.replace_with_mask(narrow, wide, pa.array(others, pa.large_string()))

    def known(self, terms: pa.Array) -> tuple[np.ndarray, ...]:
        """(places, texts, places in the texts, numbers) of the words that are terms."""
        number = pc.index_in(self.different, value_set=terms).fill_null(-1).to_numpy()[self.place]
        at = np.flatnonzero(number >= 0)
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)[at]
        return at, text, at - self.starts[text], number[at]

    def of(self, text: int, first: int = 0, stop: int | None = None) -> list[str]:
        """A text's words from one to another; what is only marks is an empty word."""
        at, end = self.starts[text : text + 2]
        stop = end if stop is None else min(at + stop, end)
        return self.different.take(pa.array(self.place[at + first : stop])).to_pylist()


def answer_of(text: str) -> list[str]:
    """The words of an item's last sentence."""
    parts = [p for p in text.replace("?", ".").replace("!", ".").replace("\n", " ").split(".") if words_of(p)]
    return words_of(parts[-1]) if parts else []


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = masks.get(w)
        if m:
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


@dataclass
class Space:
    """The latent space and one group of items in it."""

    terms: dict[str, int]
    vectors: np.ndarray  # [terms, rank], scaled by idf
    items: np.ndarray  # [items, rank], of unit length
    ids: list
    words: list[list[str]]
    rare: list[frozenset]
    answers: list[list[str]]
    owner: list[int]  # the number of the item that an entry is, or is a part of
    short: dict[tuple, list]  # ids of the items of a few words

    @cached_property
    def names(self) -> pa.Array:
        return pa.array(list(self.terms), pa.large_string())

    @cached_property
    def rare_terms(self) -> list[frozenset]:
        return [frozenset(self.terms[w] for w in own) for own in self.rare]

    @cached_property
    def sizes(self) -> np.ndarray:
        """Words, and rare ones that have to be there, of each entry."""
        return np.array([(len(own), RARE_SHARE * max(1, len(rare))) for own, rare in zip(self.words, self.rare, strict=True)]).reshape(-1, 2)


def passage(found: list, text: str) -> list:
    """One window of a text; a hash picks it. (The fit takes all passages of all texts.)"""
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, -(-(len(found) - WINDOW) // STRIDE) + 1) * STRIDE
    return found[at : at + WINDOW]


def _blocks(z: np.ndarray, size: int = 512):
    for at in range(0, len(z), size):
        part = z[at : at + size]
        if part.any():
            yield at // size, part.astype("<f4").tobytes()


def _summed(rows: DataFrame, terms: int, rank: int, multiply) -> np.ndarray:
    """The sum over all partitions of multiply(term ids, weights, sizes of rows): [terms, rank]."""

    def partial(batches):
        total = None
        for b in batches:
            ids, weights = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            sizes = pc.list_value_length(b.column(0)).to_numpy(zero_copy_only=False)
            z = multiply(ids, weights.astype(np.float32), sizes[sizes > 0])
            total = z if total is None else total + z
        if total is not None:
            parts = list(_blocks(total))
            if parts:
                yield pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in parts], pa.int32()), "z": pa.array([z for _, z in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        z = sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) for x in table.column("z"))
        return pa.table({"block": table.column("block").slice(0, 1).cast(pa.int32()), "z": pa.array([z.astype("<f4").tobytes()], pa.binary())})

    out = np.zeros((terms, rank), np.float32)
    got = rows.select("ids", "weights").mapInArrow(partial, "block int, z binary").groupBy("block").applyInArrow(add, "block int, z binary")
    for r in got.collect():  # terms x rank numbers, bounded by ITEMS
        z = np.frombuffer(r["z"], "<f4").reshape(-1, rank)
        out[r["block"] * 512 : r["block"] * 512 + len(z)] = z
    return out


def randomised_svd(rows: DataFrame, terms: int, rank=RANK, oversample=OVERSAMPLE, power=POWER, seed=7) -> np.ndarray:
    """Right singular vectors [terms, rank] of the sparse matrix whose rows are
    rows(ids array<int>, weights array<double>), by random projection and power steps."""
    size = min(terms, rank + oversample)
    q = np.random.default_rng(seed).standard_normal((terms, size)).astype(np.float32)

    def through(q):
        def multiply(ids, weights, sizes):
            z = np.zeros((terms, size), np.float32)
            ends = np.cumsum(sizes)
            for at in range(0, len(sizes), 2048):
                n = sizes[at : at + 2048]
                first = ends[at] - n[0]
                i, w = ids[first : first + n.sum()], weights[first : first + n.sum(), None]
                y = np.add.reduceat(q[i] * w, np.cumsum(n) - n, axis=0)
                back, order = np.repeat(y, n, axis=0) * w, np.argsort(i, kind="stable")
                starts = np.flatnonzero(np.diff(i[order], prepend=-1))
                z[i[order][starts]] += np.add.reduceat(back[order], starts, axis=0)
            return z

        return multiply

    for _ in range(power):
        q = np.linalg.qr(_summed(rows, terms, size, through(q)))[0].astype(np.float32)
    z = _summed(rows, terms, size, through(q))  # AᵀAQ
    values, turn = np.linalg.eigh((q.T @ z).astype(np.float64))
    keep = np.argsort(values)[::-1][: min(rank, size)]
    return (q @ turn[:, keep].astype(np.float32))[:, values[keep] > 1e-6 * max(values.max(initial=0), 1e-9)]


def parts_of(words: list[str], answer: list[str], size=PART) -> list[tuple[list[str], list[str]]]:
    """(words, answer) of an item, and of its parts if it is long; the last part has the answer."""
    starts = [*range(0, len(words) - size, size // 2), len(words) - size] if len(words) > size else []
    return [(words, answer), *((words[at : at + size], answer if at == starts[-1] else []) for at in starts)]


def fit(docs: DataFrame, groups: list[list[tuple]], text="text", rank=RANK, passages=PASSAGES) -> list[Space]:
    """The spaces of groups of items [(id, text)], HELD of them at most."""
    named = [[(i, words_of(t), answer_of(t)) for i, t in group] for group in groups]
    number = {w: k for k, w in enumerate(sorted({w for group in named for _, ws, _ in group if len(ws) >= MIN_WORDS for w in ws}))}
    total = docs.count()

    terms = pa.array(list(number), pa.large_string())

    def count(batches):
        df = np.zeros(len(number), np.int64)
        none = lambda n: pa.nulls(n, pa.binary())
        for whole in batches:
            for at, n in lots(whole.column(0), TEXTS, TEXT_BYTES):
                words = Words(whole.column(0).slice(at, n))
                _, owner, place, flat = words.known(terms)
                base = np.cumsum([0, *(words.sizes // WINDOW + 1)])
                block = base[owner] + place // WINDOW
                df += np.bincount(np.unique(owner * len(number) + flat) % len(number), minlength=len(number))
                sizes = np.diff(np.flatnonzero(np.diff(block, prepend=-1, append=-1)))
                wide = sizes > 2
                if wide.any():
                    packed = flat[np.repeat(wide, sizes)].astype("<i4").tobytes(), sizes[wide].astype(np.uint8).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([int(wide.sum())], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], ["term", "n", "ids", "sizes"])
        own = np.flatnonzero(df)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(df[own]), none(len(own)), none(len(own))], ["term", "n", "ids", "sizes"])
        trim_memory()

    df = np.zeros(len(number), np.int64)
    packed, weight = docs.sparkSession.createDataFrame([], "ids binary, sizes binary"), 0.0
    if number:
        counted = materialize(docs.select(F.col(text).alias("text")).mapInArrow(count, "term int, n long, ids binary, sizes binary"), "counts")
        n = 0
        for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():  # as many rows as the groups have words, and one
            if r["term"] < 0:
                n = r["n"]
            else:
                df[r["term"]] = r["n"]
        weight = PASSAGE_WEIGHT * min(1.0, passages / max(1, n)) ** 0.5
        packed = counted.where("term < 0").select("ids", "sizes")
    return [_space(group, number, df, total, packed, weight, rank) for group in named]


def tallied(packed: DataFrame, at: np.ndarray) -> DataFrame:
    """(ids, n): the different passages as the sorted places (at) of their terms, 32-bit, and
    how many passages are alike. Those without a term that has a place are left out."""

    def run(batches):
        found = Counter()

        def flush():
            rows = list(found.items())
            for k in range(0, len(rows), 50_000):
                part = rows[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["ids", "n"])
            found.clear()

        for b in batches:
            for ids, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sizes = np.frombuffer(sizes, np.uint8)
                place, row = at[np.frombuffer(ids, "<i4")], np.repeat(np.arange(len(sizes)), sizes)
                good = place >= 0
                keys = np.sort(row[good] * len(at) + place[good])
                data = (keys % len(at)).astype("<i4").tobytes()
                ends = 4 * np.cumsum(np.bincount(keys // len(at), minlength=len(sizes)))
                found.update(data[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if y > x)
            if len(found) > 200_000:
                yield from flush()
        yield from flush()
        trim_memory()

    return packed.mapInArrow(run, "ids binary, n long").groupBy("ids").agg(F.sum("n").alias("n"))


def _space(group: list[tuple], number: dict[str, int], df: np.ndarray, total: int, packed: DataFrame, weight: float, rank: int) -> Space:
    """One group's space, from the document frequencies of its words and all passages, each
    of this weight."""
    spark = packed.sparkSession
    short: dict[tuple, list] = {}
    entries = []  # (item's number, id, words, answer)
    for k, (i, ws, answer) in enumerate(group):
        if len(ws) >= MIN_WORDS:
            entries += [(k, i, own, told) for own, told in parts_of(ws, answer)]
        elif ws:
            short.setdefault(tuple(ws), []).append(i)
    if not entries:
        return Space({}, np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32), [], [], [], [], [], short)
    keep = set()
    for _, _, ws, _ in entries:
        numbers = sorted({number[w] for w in ws}, key=lambda k: (df[k], k))
        keep.update(k for j, k in enumerate(numbers) if j < RAREST or df[k] <= COMMON * total)
    order = sorted(keep)
    at = np.full(len(number), -1)
    at[order] = np.arange(len(order))
    idf = np.log((total + 1) / (df[order] + 1)) + 1

    def weighed(places, scale):
        own = Counter(places)
        w = np.array([n * idf[k] for k, n in own.items()])
        norm = np.linalg.norm(w)
        return (list(own), (scale * w / norm).tolist()) if len(own) and norm else None

    rows = [weighed([int(at[k]) for w in ws if at[k := number[w]] >= 0], 1.0) for _, _, ws, _ in entries]

    def weigh(batches):
        for b in batches:
            alike = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            # n equal rows add as much to the products of terms as one of sqrt(n) times the weight
            got = [weighed(np.frombuffer(ids, "<i4").tolist(), weight * n**0.5) for ids, n in alike]
            if got:
                yield pa.RecordBatch.from_pydict({"ids": pa.array([i for i, _ in got], pa.list_(pa.int32())), "weights": pa.array([w for _, w in got], pa.list_(pa.float64()))})

    schema = "ids array<int>, weights array<double>"
    matrix = materialize(spark.createDataFrame([r for r in rows if r], schema).repartition(4).unionAll(tallied(packed, at).mapInArrow(weigh, schema)), "passages")
    v = randomised_svd(matrix, len(order), min(rank, len(order)))
    discard(matrix)
    items = np.stack([(np.array(r[1], np.float32) @ v[r[0]]) if r else np.zeros(v.shape[1], np.float32) for r in rows])
    norms = np.linalg.norm(items, axis=1, keepdims=True)
    items = np.where(norms > 1e-6, items / np.maximum(norms, 1e-6), 0).astype(np.float32)
    every = sorted(number, key=number.__getitem__)
    terms = {every[k]: j for j, k in enumerate(order)}
    return Space(
        terms, (v * idf[:, None]).astype(np.float32), items, [i for _, i, _, _ in entries], [ws for _, _, ws, _ in entries],
        [frozenset(w for w in ws if w in terms) for _, _, ws, _ in entries], [told for _, _, _, told in entries], [k for k, _, _, _ in entries], short,
    )


def verify(space: Space, item: int, words: list[str], start: int) -> tuple[float, float, float, str] | None:
    """(common subsequence share, rare share, answer share, kind) if the words (without
    their marks) around start hold the item; None if they do not."""
    own = space.words[item]
    n = len(own)
    region = words[max(0, start - n) : start + WINDOW + n]
    rare = len(space.rare[item].intersection(region)) / max(1, len(space.rare[item]))
    if rare < RARE_SHARE:
        return None
    region = [w for w in region if w]
    # the densest stretch of about the item's length, not words scattered over the whole region
    best, length = 0, n + max(4, n // 4)
    for at in range(0, max(1, len(region) - length + 1), max(1, n // 8)):
        best = max(best, lcs(own, region[at : at + length]))
    common = max(best, lcs(own, region[-length:])) / n
    answer = space.answers[item]
    told = len(set(answer).intersection(region)) / max(1, len(set(answer)))
    if common >= VERBATIM:
        return common, rare, told, "verbatim"
    if common >= PARAPHRASE and told >= ANSWER_SHARE:
        return common, rare, told, "paraphrase"
    return None


def _candidates(space: Space, words: Words, cosine: float):
    """(text, item, window start, cosine) of the windows that come close to an item and have
    enough of its rare words around them, as verify counts them. A window is two blocks of
    STRIDE words, and every block is added up once."""
    known, home, place, terms = words.known(space.names)
    owner = np.cumsum([0, *(words.sizes // STRIDE + 1)])[:-1]
    blocks = owner[home] + place // STRIDE
    starts = np.flatnonzero(np.diff(blocks, prepend=-1))
    if not len(starts):
        return
    used, counts = blocks[starts], np.diff(starts, append=len(blocks))
    sums = np.empty((len(used), space.vectors.shape[1]), np.float32)
    for at in range(0, len(starts), 4096):
        stop = starts[at + 4096] if at + 4096 < len(starts) else len(blocks)
        sums[at : at + 4096] = np.add.reduceat(space.vectors[terms[starts[at] : stop]], starts[at : at + 4096] - starts[at], axis=0)
    text_of = lambda blocks: np.searchsorted(owner, blocks, side="right") - 1
    wins = np.unique(np.concatenate([used, (used - 1)[used > owner[text_of(used)]]]))
    home = text_of(wins)
    first, second = (np.minimum(np.searchsorted(used, wins + k), len(used) - 1) for k in (0, 1))
    has_first = used[first] == wins
    has_second = (used[second] == wins + 1) & (text_of(wins + 1) == home)
    enough = np.flatnonzero(has_first * counts[first] + has_second * counts[second] >= 2)
    for at in range(0, len(enough), 8192):
        own = enough[at : at + 8192]
        x = sums[first[own]] * has_first[own, None] + sums[second[own]] * has_second[own, None]
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        close = (x / np.maximum(norm, 1e-6)) @ space.items.T
        r, c = np.nonzero(close >= cosine)
        k = home[own[r]]
        start, (n, need) = (wins[own[r]] - owner[k]) * STRIDE, space.sizes[c].T
        first_word = np.searchsorted(known, words.starts[k] + np.maximum(0, start - n))
        last_word = np.searchsorted(known, np.minimum(words.starts[k] + start + WINDOW + n, words.starts[k + 1]))
        for j in np.flatnonzero(last_word - first_word >= need):
            entry = int(c[j])
            if len(space.rare_terms[entry].intersection(terms[first_word[j] : last_word[j]].tolist())) >= need[j]:
                yield int(k[j]), entry, int(start[j]), float(close[r[j], entry])


def held_items(space: Space, words: Words, cosine: float):
    """(text, item id, cosine, common, rare, answer, kind, start) of every item that a text
    holds: whole, or failing that the part that is held best."""
    best: dict[tuple[int, int], list] = {}
    for k, entry, start, close in _candidates(space, words, cosine):
        best.setdefault((k, entry), []).append((close, start))
    found: dict[tuple[int, int], tuple] = {}
    for (k, entry), places in sorted(best.items()):
        owner = (k, space.owner[entry])
        whole = not entry or space.owner[entry - 1] != space.owner[entry]
        for close, start in sorted(places, key=lambda p: (-p[0], p[1])):
            n = len(space.words[entry])
            first = max(0, start - n)
            got = verify(space, entry, words.of(k, first, start + WINDOW + n), start - first)
            if got:
                rank = (not whole, -got[0], start)
                if owner not in found or rank < found[owner][0]:
                    found[owner] = (rank, (k, space.ids[entry], close, *got, start))
                break
    yield from (row for _, row in found.values())
    if space.short:
        for k in np.flatnonzero(words.sizes < 2 * MIN_WORDS).tolist():
            for i in space.short.get(tuple(w for w in words.of(k) if w), ()):
                yield k, i, 1.0, 1.0, 1.0, 1.0, "verbatim", 0


def search(docs: DataFrame, spaces: list[Space], item_type: str, id_col="doc_id", text="text", cosine=COSINE) -> DataFrame:
    """(id, item, cosine, common, rare, answer, kind, start) of every document and item
    that it holds; start counts words."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = docs.sparkSession.sparkContext.broadcast(spaces)  # bounded by ITEMS and HELD
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item {item_type}, cosine double, common double, rare double, answer double, kind string, start long"
    shape = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for whole in batches:
            for at, n in lots(whole.column(1), TEXTS, TEXT_BYTES):
                b = whole.slice(at, n)
                ids = b.column(0).to_pylist()
                words = Words(b.column(1))
                out = [(ids[k], *row) for own in held.value for k, *row in held_items(own, words, cosine)]
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(shape.names, map(list, zip(*out, strict=True)), strict=True)), schema=shape)

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(trimmed(run), schema)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text="text", item_col="item_id", item_text="text", items=ITEMS, held=HELD) -> DataFrame:
    """(doc id, item id, cosine, common, rare, answer, kind, start) of all leaks."""
    known = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).alias("i"), F.col(item_text).alias("t"))
    words = F.size(F.split("t", r"\s+"))
    parts = F.greatest(F.ceil((words - PART) / (PART // 2)) + 1, F.lit(0)) + 1
    groups = -(-known.agg(F.coalesce(F.sum(parts), F.lit(0))).first()[0] // items)
    kind, item = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    found = []
    for first in range(0, groups, held):
        some = []
        for g in range(first, min(groups, first + held)):
            own = known if groups == 1 else known.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g)
            some.append([(r["i"], r["t"]) for r in own.orderBy("i", "t").collect()])
        found.append(search(docs, fit(docs, some, text), item, id_col, text))
    if not found:
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, {item_col} {item}, cosine double, common double, rare double, answer double, kind string, start long")
    return reduce(DataFrame.unionAll, found).withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def clean(docs: DataFrame, benchmark: DataFrame, text="text") -> DataFrame:
    """docs without those whose text holds a benchmark item."""
    body = F.col(text)
    key = F.concat_ws(":", F.xxhash64(body), F.crc32(body.cast("binary")), F.length(body))
    rows = docs.select(key.alias("_wm_key"), body.alias("_wm_text"))
    found = materialize(leaks(rows, benchmark, "_wm_key", "_wm_text").select(F.col("_wm_key").alias("_wm_leak")).distinct(), "leaks")
    return docs.join(found, key == found["_wm_leak"], "left_anti")
