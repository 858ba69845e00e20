"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by an
exact search in vantage-point trees, and grouped into components; and a filter by these
links and by the Jaccard similarity of shingles, whose candidates share smallest hashes.

Defined results: null text counts as empty; texts without words have fingerprint
zero and link like any other; rows with a null id keep their fingerprint and
group, which is named by its smallest id that is not null (null if none); repeated
rows are kept; an empty table gives no rows; extra columns are ignored (the filter keeps
them, and of rows with the same id and text keeps all or none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vantage
from .common import connected_components, materialize, trim_memory

_CHUNK = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of what is not ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bit_counts(hashes, bits: np.ndarray) -> int:
    """Adds to bits how often each bit is set in the hashes; returns how many they are."""
    h = np.array(hashes, np.uint64)
    bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return len(h)


def fingerprint(words: list[bytes], size: int = 3, seed: int = 42) -> int:
    """The bits set in over half of the XXH64 of all shingles, repeats included."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    bits, n = np.zeros(64, np.int64), 0
    last = max(1, len(words) - size + 1)
    for at in range(0, last, _CHUNK):
        part = words[at : min(last, at + _CHUNK) + size - 1]
        grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        n += bit_counts([digest(g, seed) for g in grams], bits)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col="doc_id", text="text", size=3, seed=42) -> DataFrame:
    """(id, fp long) of every row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(words_of(t.as_py()), size, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def classes_of(prints: DataFrame, name: str, named: str, distance: int) -> DataFrame:
    """(fp, named) of prints(fp, name): every different fingerprint, and the smallest name in
    its component, by an exact search in the trees."""
    points = materialize(prints.groupBy("fp").agg(F.min(name).alias("low")), "points")
    masks = vantage.blocks(1, 2)
    found = vantage.links(points.select(F.col("fp").alias("node"), F.col("fp").alias("w0")), ["w0"], distance, masks)
    roots = connected_components(found)
    rows = points.join(roots, points.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rows = materialize(rows, "roots")
    lowest = rows.groupBy("root").agg(F.min("low").alias(named))
    return rows.join(lowest, "root").select("fp", named)


def components(docs: DataFrame, id_col="doc_id", text="text", size=3, seed=42, distance=2) -> DataFrame:
    """(id, fingerprint, component_id): documents whose fingerprints are linked by
    chains of at most ``distance`` differing bits."""
    prints = materialize(with_fingerprints(docs, id_col, text, size, seed), "fingerprints")
    return prints.join(classes_of(prints, "id", "component_id", distance), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Keys of a text, and smallest hashes joined in one key. A pair of Jaccard similarity s
#: shares a key with probability 1 - (1 - s ** NEAR_JOINED) ** NEAR_KEYS.
NEAR_KEYS, NEAR_JOINED = 8, 3
#: Texts with one key that one task compares, on each side; of more, blocks are compared.
NEAR_ROWS = 2048
#: Texts of such a key that all others are compared with first.
NEAR_PIVOTS = 16

_SALTS = np.random.default_rng(7).integers(1, 2**63, (2, NEAR_KEYS * NEAR_JOINED, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of the different shingles; a shorter text is one shingle."""
    words = words_of(text)
    grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64))


def near_keys(grams: np.ndarray) -> np.ndarray:
    """The smallest hashes of the shingles under seeded orders, a few to a key."""
    low = np.full(NEAR_KEYS * NEAR_JOINED, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), _CHUNK):
        low = np.minimum(low, ((grams[at : at + _CHUNK] ^ _SALTS[0]) * _SALTS[1]).min(1))
    return np.array([xxhash.xxh3_64_intdigest(k.tobytes(), n) for n, k in enumerate(low.reshape(NEAR_KEYS, -1))], np.uint64)


def similar_links(nodes: list, sets: list[np.ndarray], left: list[bool], right: list[bool], roots: list, similarity: float):
    """Links (a, b) that connect all texts of the left with all those of the right that are
    similar, one for each two groups that meet. Every pair is compared but those of one
    group (so far, or from the start if their roots are the same), and those whose sizes
    are too far apart."""
    sizes = np.array([len(s) for s in sets], np.int64)
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    label, other = np.unique(np.array(roots, np.int64), return_inverse=True)[1], np.flatnonzero(right)
    held = np.concatenate([ids[:0], *(ids[starts[k] : starts[k + 1]] for k in other)])
    begin = np.cumsum(sizes[other]) - sizes[other]
    mark = np.zeros(len(words), bool)
    out = []

    def common(part: np.ndarray) -> np.ndarray:
        """How many marked shingles each of other[part] has."""
        if 2 * len(part) > len(other):
            return np.add.reduceat(mark[held], begin, dtype=np.int64)[part]
        size = sizes[other[part]]
        at = np.cumsum(size) - size
        return np.add.reduceat(mark[held[np.repeat(begin[part] - at, size) + np.arange(size.sum())]], at, dtype=np.int64)

    for k in np.flatnonzero(left):
        own, n = ids[starts[k] : starts[k + 1]], sizes[k]
        todo = np.flatnonzero((label[other] != label[k]) & (sizes[other] >= similarity * n) & (similarity * sizes[other] <= n))
        if not len(todo):
            continue
        mark[own] = True
        # one text of each group first: the rest of a group that is met needs no look
        first = np.unique(label[other[todo]], return_index=True)[1]
        for part in (todo[first], np.delete(todo, first)):
            part = part[label[other[part]] != label[k]]
            if len(part):
                both = common(part)
                for r in other[part[both >= similarity * (n + sizes[other[part]] - both)]]:
                    if label[r] != label[k]:
                        out.append((nodes[k], nodes[r]))
                        label[label == label[r]] = label[k]
        mark[own] = False
    return out


def near_duplicates(docs: DataFrame, id_col="doc_id", text="text", size=5, similarity=0.8, rows_each=NEAR_ROWS, pivots=NEAR_PIVOTS, distance=2) -> DataFrame:
    """docs with one document left of each group of near duplicates: texts linked by
    chains of pairs whose fingerprints differ in at most ``distance`` bits, as
    ``components`` links them, or whose sets of ``size``-word shingles have a Jaccard
    similarity of at least ``similarity``. The first are found exactly, in the trees, and
    are one group from the start. Candidates for the others are all pairs of texts that
    share one of their ``near_keys``; none is dropped. The texts of a key meet in one task, the key's shard. A
    key of more than ``rows_each`` texts is compared with a few of them first, which links
    what is one dense group; then only pairs of different groups are left to compare, in
    blocks: those outside the largest group with each other and with all of it. Tasks emit
    links that connect groups only. The document with the smallest id stays, null ids last;
    rows with the same id and text are one document."""
    node = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    kind = docs.schema[id_col].dataType.simpleString()

    def keys(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            got = [near_keys(shingles(t, size)).view(np.int64) for t in texts]
            fps = np.array([fingerprint(words_of(t)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps), pa.array(got, pa.list_(pa.int64()))], ["id", "node", "fp", "keys"])
        trim_memory()

    named = docs.select(F.col(id_col).alias("id"), node.alias("node"), F.col(text).alias("text"))
    rows = materialize(named.mapInArrow(keys, f"id {kind}, node long, fp long, keys array<long>"), "keys")
    points = rows.groupBy("node").agg(F.min("id").alias("low"), F.min("fp").alias("fp"), F.min("keys").alias("keys"))
    points = materialize(points, "texts")
    points = materialize(points.join(classes_of(points, "node", "lead", distance), "fp").select("node", "low", "keys", "lead"), "points")
    asked = points.select("node", F.col("lead").alias("root"), F.explode("keys").alias("key"))
    mixed = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)"))
    shards = asked.groupBy("key").agg(F.count("*").alias("n"), mixed(1).alias("x"), mixed(2).alias("y")).where("n > 1")
    # keys that the same texts share are one shard
    shards = shards.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    members = materialize(asked.join(shards, "key").select("node", "root", "key", F.ceil(F.col("n") / rows_each).cast("int").alias("blocks")), "members")

    def hashes(batches):
        for b in batches:
            got = [shingles(t.as_py(), size).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["node", "grams"])
        trim_memory()

    lows = members.select(F.col("node").alias("n")).distinct().join(points.select("node", "low"), F.col("n") == F.col("node")).select("n", "low")
    texts = named.join(lows, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("low")))
    texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    sets = materialize(texts.mapInArrow(hashes, "node long, grams binary"), "grams")
    task = lambda *parts: F.xxhash64("key", *parts).alias("task")
    both, yes, no = ("l", "r"), F.lit(True), F.lit(False)
    sides = lambda l, r: (l.alias("l"), r.alias("r"))
    block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def compare(batches):
        last, held = None, []

        def links():
            found = similar_links(*map(list, zip(*held, strict=True)), similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("task", "node", "grams", "l", "r", "root"))
            for t, n, g, left, right, root in zip(*columns, strict=True):
                if t != last and held:
                    yield links()
                    held = []
                last = t
                held.append((n, np.frombuffer(g, np.uint64), left, right, root))
        if held:
            yield links()
        trim_memory()

    def linked(dealt: DataFrame, tag: str) -> DataFrame:
        rows = dealt.join(sets, "node").repartition("task").sortWithinPartitions("task")
        return materialize(rows.select("task", "node", "grams", *both, "root").mapInArrow(compare, "a long, b long").where("a <> b"), tag)

    # all texts of a key; of a large one, all with some
    few, many = members.where("blocks = 1"), members.where("blocks > 1").withColumn("i", block(F.col("blocks"), 3))
    some = many.groupBy("key", "blocks", block(F.lit(pivots), 5).alias("p")).agg(F.min(F.struct("node", "root")).alias("x"))
    some = some.select("key", "blocks", "x.*").withColumn("i", upto(F.col("blocks")))
    dealt = few.select(task(), "node", *sides(yes, yes), "root")
    dealt = dealt.unionAll(many.select(task("i"), "node", *sides(no, yes), "root"))
    dealt = dealt.unionAll(some.select(task("i"), "node", *sides(yes, no), "root"))
    close = linked(dealt, "close")
    roots = connected_components(close.unionAll(points.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))))
    if many.limit(1).count():
        # what these links leave apart in large keys: texts outside a key's largest group
        roots = materialize(roots, "roots")
        parts = many.drop("root").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        parts = materialize(parts, "parts")
        tally = parts.groupBy("key", "root").agg(F.count("*").alias("n"))
        tally = tally.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
        blocks_of = lambda n: F.ceil(n / rows_each).cast("int")
        tally = tally.select("key", F.col("top.root").alias("top"), blocks_of(F.col("top.n")).alias("inside"), blocks_of(F.col("n") - F.col("top.n")).alias("outside"))
        rows = parts.join(tally, "key")
        apart = rows.where("root <> top").withColumn("i", block(F.col("outside"), 7))
        again = apart.withColumn("j", upto(F.col("outside"))).select(
            task(F.least("i", "j"), F.greatest("i", "j"), F.lit(0)), "node", *sides(F.col("i") <= F.col("j"), F.col("i") >= F.col("j")), "root"
        )
        again = again.unionAll(apart.withColumn("j", upto(F.col("inside"))).select(task("i", "j", F.lit(1)), "node", *sides(yes, no), "root"))
        inside = rows.where("root = top").withColumn("j", block(F.col("inside"), 9)).withColumn("i", upto(F.col("outside")))
        again = again.unionAll(inside.select(task("i", "j", F.lit(1)), "node", *sides(no, yes), "root"))
        more = linked(again, "more")
        roots = connected_components(more.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named_points = points.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    named_points = materialize(named_points.select("node", "low", F.coalesce("root", "node").alias("root")), "groups")
    first = named_points.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node")).alias("f"))
    stay = first.select(F.col("f.node").alias("_wm_node"), F.col("f.low").alias("_wm_low"))
    return docs.join(stay, (node == F.col("_wm_node")) & docs[id_col].eqNullSafe(F.col("_wm_low")), "left_semi")
