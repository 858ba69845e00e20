"""Language-model scoring by context-tree weighting over bytes.

A text is the byte sequence of its words (A-Z lower-cased, split at ASCII white
space), one space between them and a newline at the end; the bytes before it are
newlines. The counts of all (context, byte) pairs of the training texts give the tree
(see ``ctw``); its code length of a text's bytes is the score. Subtrees under the three
most recent bytes are built apart from each other, then the levels above them.

Scoring looks nodes up in sorted tables. Tables of up to ``HELD_NODES`` nodes are read
by every worker from the shared folder. A larger tree is dealt out to groups of subtrees
there; a worker gathers the different grams of ``CHUNK`` bytes of texts, reads the groups
that have them one after the other, and then scores these texts, with the same result.
Nothing is written or moved for a text's grams.

The base score is the smoothed unigram model of the words. Counts of the ``HOT_WORDS``
most frequent words, at most, are read by every worker; all other words, each rare,
meet their counts in a join.

Defined results: null text counts as empty, one end token; repeated rows give repeated
results; without training texts every decision has probability one half and the base
score is 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ctw
from .common import discard, materialize
from .token_files import filesystem

DEPTH = 5
#: Grams, about, of the subtrees that are built in one group.
PART_ROWS = 100_000
HELD_NODES = 16_000_000
#: Nodes, about, of one group of a tree with more than that.
GROUP_NODES = 4_000_000
#: Bytes of texts whose grams are looked up together in such a tree, and grams whose
#: probabilities a worker keeps from one such lot to the next, at most.
CHUNK = 32 << 20
KEPT_GRAMS = 3_000_000
HOT_WORDS = 200_000
END = b"\n"
_PIECE = 4 << 20
_MEMO_BITS = 21
_LOG10_2 = math.log10(2)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams_of(words: list[bytes], depth: int):
    """The (context << 8 | byte) numbers of a text's bytes, in pieces."""
    data = END * depth + b" ".join(words) + END
    for start in range(depth, len(data), _PIECE):
        a = np.frombuffer(data, np.uint8)[start - depth : start + _PIECE].astype(np.uint64)
        n = len(a) - depth
        out = a[depth:].copy()
        for k in range(1, depth + 1):
            out |= a[depth - k : depth - k + n] << np.uint64(8 * (depth - k + 1))
        yield out


def _merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    at = ctw._groups(grams)
    return grams[at], (np.add.reduceat(counts[order], at) if len(at) else counts)


def counted(texts: DataFrame, depth=DEPTH) -> tuple[DataFrame, DataFrame]:
    """texts(text) to (gram, n) of all byte contexts and (word, n) of all words."""

    def run(batches):
        words, held, size = Counter(), [], 0
        grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold():
            nonlocal grams, counts, held, size
            if held:
                u, n = np.unique(np.concatenate(held), return_counts=True)
                grams, counts = _merged(np.concatenate([grams, u]), np.concatenate([counts, n]))
                held, size = [], 0

        def flush():
            nonlocal grams, counts
            fold()
            for at in range(0, len(grams), 100_000):
                g, c = grams[at : at + 100_000], counts[at : at + 100_000]
                yield pa.RecordBatch.from_pydict({"gram": g.view(np.int64), "word": pa.nulls(len(g), pa.binary()), "n": c})
            items = list(words.items())
            for at in range(0, len(items), 100_000):
                part = items[at : at + 100_000]
                yield pa.RecordBatch.from_pydict({"gram": pa.nulls(len(part), pa.int64()), "word": pa.array([w for w, _ in part], pa.binary()), "n": pa.array([n for _, n in part], pa.int64())})
            grams, counts = grams[:0], counts[:0]
            words.clear()

        for b in batches:
            for text in b.column(0):
                own = words_of(text.as_py())
                words.update(own)
                words[END] += 1
                for g in grams_of(own, depth):
                    held.append(g)
                    size += len(g)
                if size >= _PIECE:
                    fold()
            if len(words) > 300_000 or len(grams) > 3_000_000:
                yield from flush()
        yield from flush()

    both = materialize(texts.select("text").mapInArrow(run, "gram long, word binary, n long"), "counts")
    grams = both.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    words = both.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    out = materialize(grams, "grams"), materialize(words, "words")
    discard(both)
    return out


def _tree(table: pa.Table, depth: int, top: int):
    """The subtrees of grams below level top: [keys, n0, n1, ratio, place] of the levels
    top .. depth, and the weighted logs of the first."""
    low, weighted = ctw.leaves(table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy())
    levels, low[4], weighted = ctw.climb(*low[:3], weighted, depth - top)
    return [low, *levels][::-1], weighted


def _upper(table: pa.Table, steps: int):
    """The levels above some nodes, shallowest first, these nodes and their places in the
    last level, and the weighted logs of the first."""
    keys = table.column("node").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    n0, n1, w = (table.column(c).to_numpy()[order] for c in ("n0", "n1", "w"))
    levels, place, weighted = ctw.climb(keys[order], n0, n1, w, steps)
    return levels[::-1], keys[order], place, weighted


def _summary(level: list, weighted: np.ndarray) -> pa.Table:
    return pa.table({"node": level[0].view(np.int64), "n0": level[1], "n1": level[2], "w": weighted})


def _start(start: pa.Table, keys: np.ndarray) -> tuple:
    """What is decided above each of the keys."""
    node = start.column("node").to_numpy().view(np.uint64)
    order = np.argsort(node)
    at = order[np.searchsorted(node[order], keys)]
    return tuple(start.column(c).to_numpy()[at] for c in ("one", "zero", "rest"))


def _odds(first: int, levels: list, odds: list) -> pa.Table:
    return pa.table(
        {
            "depth": pa.array(np.repeat(np.arange(first, first + len(levels)), [len(level[0]) for level in levels]), pa.int32()),
            "node": np.concatenate([np.zeros(0, np.uint64), *(level[0] for level in levels)]).view(np.int64),
            "odds": np.concatenate([np.zeros(0), *odds]).astype(np.float32),
        }
    )


def _given(keys: np.ndarray, above: tuple) -> pa.Table:
    return pa.table({"node": keys.view(np.int64)} | {n: np.broadcast_to(x, len(keys)).astype(float) for n, x in zip(("one", "zero", "rest"), above, strict=True)})


_NODE, _GIVEN, _ODDS = "node long, n0 long, n1 long, w double", "node long, one double, zero double, rest double", "depth int, node long, odds float"
_MIXED = "depth int, node long, odds float, one double, zero double, rest double"


def build(grams: DataFrame, depth=DEPTH, rows_each=PART_ROWS) -> DataFrame:
    """(gram, n) to the tree's nodes (depth, node, odds). The subtrees under the three most
    recent bytes are built first, many of them to a group of about ``rows_each`` grams;
    then the levels between, apart for each most recent byte; then, on the driver, what is
    above these bytes: at most 256 * 255 nodes."""
    spark = grams.sparkSession
    low, high = min(3, depth), min(1, depth)
    steps = low - high
    # contexts have the most recent byte in the highest place
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // rows_each))
    bucket = lambda part: F.pmod(F.xxhash64(part), F.lit(n)).cast("int").alias("bucket")
    byte = lambda level: F.shiftrightunsigned("node", 8 * level).alias("byte")
    rows = grams.select(bucket(F.shiftrightunsigned("gram", 8 * (depth - low + 1))), "gram", "n")

    def deepest(table: pa.Table) -> pa.Table:
        levels, weighted = _tree(table, depth, low)
        return _summary(levels[0], weighted)

    def higher(table: pa.Table) -> pa.Table:
        levels, _, _, weighted = _upper(table, steps)
        return _summary(levels[0], weighted)

    nodes = materialize(rows.groupBy("bucket").applyInArrow(deepest, _NODE), "upper")
    few = nodes.select(byte(low), *nodes.columns).groupBy("byte").applyInArrow(higher, _NODE) if steps else nodes
    levels, keys, place, _ = _upper(few.toArrow(), high)
    odds, above = ctw.descend(levels, ctw.ROOT)
    out = [spark.createDataFrame(_odds(0, levels, odds), _ODDS)]
    given = spark.createDataFrame(_given(keys, tuple(x[place] for x in above) if high else above), _GIVEN)

    def between(table: pa.Table, start: pa.Table) -> pa.Table:
        levels, keys, place, _ = _upper(table, steps)
        odds, above = ctw.descend(levels, _start(start, levels[0][0]))
        made, passed = _odds(high, levels, odds), _given(keys, tuple(x[place] for x in above))
        return pa.concat_tables([made, passed], promote_options="default")

    if steps:
        own = nodes.select(byte(low), *nodes.columns).groupBy("byte")
        mixed = own.cogroup(given.select(byte(high), *given.columns).groupBy("byte")).applyInArrow(between, _MIXED)
        mixed = materialize(mixed, "between")
        out.append(mixed.where("depth is not null").select("depth", "node", "odds"))
        given = mixed.where("depth is null").select("node", "one", "zero", "rest")

    def finish(table: pa.Table, start: pa.Table) -> pa.Table:
        levels, _ = _tree(table, depth, low)
        return _odds(low, levels, ctw.descend(levels, _start(start, levels[0][0]))[0])

    given = given.select(bucket(F.shiftrightunsigned("node", 8)), *given.columns)
    out.append(rows.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(finish, _ODDS))
    made = materialize(reduce(DataFrame.unionAll, out), "nodes")
    discard(nodes)
    if steps:
        discard(mixed)
    return made


_loaded: dict[str, object] = {}


def _read(path: str, columns: list[str], where=None) -> pa.Table:
    import pyarrow.dataset as ds

    fs, at = filesystem(path)
    return ds.dataset(at, filesystem=fs, format="parquet", exclude_invalid_files=False, ignore_prefixes=["_", "."]).to_table(columns=columns, filter=where)


def _tables(path: str, depth: int) -> ctw.Tables:
    if path not in _loaded:
        import pyarrow.dataset as ds

        _loaded.clear()
        keys, odds = [], []
        for d in range(depth + 1):  # one at a time, to hold little more than what stays
            table = _read(path, ["node", "odds"], ds.field("depth") == d)
            node, odd = table.column("node").to_numpy().view(np.uint64), table.column("odds").to_numpy()
            order = np.argsort(node)
            keys.append(node[order])
            odds.append(odd[order])
            del table, node, odd, order
        pa.default_memory_pool().release_unused()
        _loaded[path] = ctw.Tables(keys, odds)
    return _loaded[path]


def _sorted_tables(table: pa.Table, depth: int) -> ctw.Tables:
    level = table.column("depth").to_numpy()
    node, odd = table.column("node").to_numpy().view(np.uint64), table.column("odds").to_numpy()
    keys, odds = [], []
    for d in range(depth + 1):
        own = np.flatnonzero(level == d)
        order = own[np.argsort(node[own])]
        keys.append(node[order])
        odds.append(odd[order])
    return ctw.Tables(keys, odds)


def _group(part, groups: int):
    """The group of the subtrees under some bytes, of arrays and of columns: products stay
    under 63 bits."""
    return part * 2_654_435_761 // 65_536 % groups


def dealt(nodes: DataFrame, depth: int, groups: int) -> DataFrame:
    """nodes by group: the subtrees under the three most recent bytes by a hash of these
    bytes, what is above them in group -1."""
    low = min(3, depth)
    part = reduce(lambda rest, d: F.when(F.col("depth") == d, F.shiftrightunsigned("node", 8 * (d - low + 1))).otherwise(rest), range(low, depth + 1), F.lit(None))
    of = F.pmod(F.shiftright(part * F.lit(2_654_435_761), 16), F.lit(groups)).cast("int")
    rows = nodes.select(F.when(F.col("depth") < low, -1).otherwise(of).alias("group"), "depth", "node", "odds")
    return materialize(rows.repartition("group").sortWithinPartitions("group", "depth", "node"), "groups", by=["group"])


class Shelf:
    """A tree that is read group by group; the probabilities of the grams that were
    learned are at hand."""

    def __init__(self, path: str, depth: int, groups: int):
        import pyarrow.dataset as ds

        fs, at = filesystem(path)
        kind = ds.partitioning(pa.schema([("group", pa.int32())]), flavor="hive")
        self.source = ds.dataset(at, filesystem=fs, format="parquet", partitioning=kind, exclude_invalid_files=False, ignore_prefixes=["_", "."])
        self.depth, self.low, self.groups = depth, min(3, depth), groups
        self.above = self._read(-1)
        self.grams, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def _read(self, group: int) -> ctw.Tables:
        import pyarrow.dataset as ds

        out = _sorted_tables(self.source.to_table(columns=["depth", "node", "odds"], filter=ds.field("group") == group), self.depth)
        pa.default_memory_pool().release_unused()
        return out

    def learn(self, grams: np.ndarray) -> None:
        """Look up what is not known yet of sorted, different grams."""
        if len(self.grams) > KEPT_GRAMS:
            self.grams, self.values = self.grams[:0], self.values[:0]
        new = grams[~self._has(grams)]
        values = np.empty(len(new))
        group = _group(new >> np.uint64(8 * (self.depth - self.low + 1)), self.groups)
        for g in np.unique(group):
            own, tables = np.flatnonzero(group == g), self._read(int(g))
            tables.keys[: self.low], tables.odds[: self.low] = self.above.keys[: self.low], self.above.odds[: self.low]
            values[own] = tables.log2(new[own])
        both = np.concatenate([self.grams, new])
        order = np.argsort(both, kind="stable")
        self.grams, self.values = both[order], np.concatenate([self.values, values])[order]

    def _has(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams), bool)
        return self.grams[np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)] == grams

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """Of grams that were learned last."""
        return self.values[np.searchsorted(self.grams, grams)]

    def ahead(self, batches, text: int):
        """The same batches, each when the grams of its texts are known."""
        held, size = [], 0

        def learned():
            found, some, n = np.zeros(0, np.uint64), [], 0
            for b in held:
                for t in b.column(text):
                    for g in grams_of(words_of(t.as_py()), self.depth):
                        some.append(g)
                        n += len(g)
                        if n >= _PIECE:
                            found, some, n = np.unique(np.concatenate([found, np.unique(np.concatenate(some))])), [], 0
            self.learn(np.unique(np.concatenate([found, *some])))
            yield from held
            held.clear()

        for b in batches:
            held.append(b)
            size += b.column(text).nbytes
            if size >= CHUNK:
                yield from learned()
                size = 0
        if held:
            yield from learned()


def _shelf(path: str, depth: int, groups: int) -> Shelf:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Shelf(path, depth, groups)
    return _loaded[path]


class _Memo:
    """log2 probabilities of grams met lately."""

    def __init__(self, tables: ctw.Tables | Shelf):
        self.tables = tables
        self.tags = np.full(1 << _MEMO_BITS, np.uint64(2**64 - 1))
        self.values = np.zeros(1 << _MEMO_BITS)

    def log2(self, grams: np.ndarray) -> np.ndarray:
        slot = lambda g: (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMO_BITS)
        at = slot(grams)
        miss = np.flatnonzero(self.tags[at] != grams)
        out = self.values[at]
        if len(miss):
            new, back = np.unique(grams[miss], return_inverse=True)
            found = self.tables.log2(new)
            out[miss] = found[back]
            at = slot(new)
            self.tags[at], self.values[at] = new, found
            # where two share a slot the tag and the value may differ: set them again in one order
            self.values[at] = np.where(self.tags[at] == new, found, self.values[at])
        return out


def score(docs: DataFrame, held_out: Column, id_col="doc_id", text="text", depth=DEPTH, held_nodes=HELD_NODES, hot_words=HOT_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte) of every document; learned from those that are not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text).alias("text"))
    grams, words = counted(rows.where("not held_out"), depth)
    nodes = build(grams, depth)
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    whole = n + 0.5 * (v + 1)
    # the least count that at most hot_words words reach: their number by count, from above
    least, seen = 1, 0
    for r in words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(hot_words).collect():
        seen += r["k"]
        if seen > hot_words:
            least = r["n"] + 1
            break
    hot = materialize(words.where(F.col("n") >= least), "hot")
    discard(grams)
    n_nodes = nodes.count()
    held, groups = n_nodes <= held_nodes, max(4, -(-n_nodes // GROUP_NODES))
    if not held:
        nodes, whole_tree = dealt(nodes, depth, groups), nodes
        discard(whole_tree)
    hot_path, node_path = hot._waymark_path, nodes._waymark_path

    def settle(memo, parts, bits):
        """Adds the log2 probabilities of the held grams to their texts' bits."""
        if parts:
            found = memo.log2(np.concatenate([g for _, g in parts]))
            at = np.cumsum([0, *(len(g) for _, g in parts[:-1])])
            for (k, _), s in zip(parts, np.add.reduceat(found, at), strict=True):
                bits[k] += float(s)
            parts.clear()

    def run(batches):
        held_grams: list[tuple[int, np.ndarray]] = []
        table = _read(hot_path, ["word", "n"])
        known = dict(zip(table.column("word").to_pylist(), (math.log10((c + 0.5) / whole) for c in table.column("n").to_pylist()), strict=True))
        tables = _tables(node_path, depth) if held else _shelf(node_path, depth, groups)
        memo = _Memo(tables)
        get = known.get
        for b in batches if held else tables.ahead(batches, 2):
            texts = b.column(2)
            for at in range(0, len(texts), 256):
                out = {k: [] for k in ("n_tokens", "hot", "known", "bits", "n_bytes", "tail", "tail_n")}
                for t in texts.slice(at, 256):
                    own = words_of(t.as_py())
                    scores = list(map(get, own))
                    tail = Counter(w for w, s in zip(own, scores, strict=True) if s is None)
                    end = get(END)
                    scores.append(end)
                    if end is None:
                        tail[END] += 1
                    good = [s for s in scores if s is not None]
                    out["n_tokens"].append(len(scores))
                    out["hot"].append(math.fsum(good))
                    out["known"].append(len(good))
                    out["tail"].append(list(tail))
                    out["tail_n"].append(list(tail.values()))
                    out["n_bytes"].append(sum(map(len, own)) + max(1, len(own)))
                    out["bits"].append(0.0)
                    for g in grams_of(own, depth):
                        held_grams.append((len(out["bits"]) - 1, g))
                        if sum(len(g) for _, g in held_grams[-256:]) >= _PIECE // 2:
                            settle(memo, held_grams, out["bits"])
                settle(memo, held_grams, out["bits"])
                kinds = dict(n_tokens=pa.int64(), hot=pa.float64(), known=pa.int64(), bits=pa.float64(), n_bytes=pa.int64(), tail=pa.list_(pa.binary()),
                             tail_n=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 256), b.column(1).slice(at, 256), *(pa.array(out[k], kinds[k]) for k in out)], ["id", "held_out", *out]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, hot double, known long, bits double, n_bytes long, tail array<binary>, tail_n array<int>"
    first = materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    tail = first.select("row", F.inline(F.arrays_zip("tail", "tail_n")).alias("word", "k")).join(words, "word", "left")
    part = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(whole)))
    rest = tail.groupBy("row").agg(F.sum(F.col("k") * part).alias("rest"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rest_known"))
    out = first.join(rest, "row", "left")
    bits = F.col("bits")
    discard(nodes)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (bits * _LOG10_2).alias("score"), "n_bytes", (-bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
