"""Exact Hamming-radius search with a distributed forest of vantage-point trees.

A pair of fingerprints within ``distance`` differs by at most
``distance // len(masks)`` bits in one of the disjoint bit blocks, so there is a
tree for each block, over the Hamming distance inside it. The trees are fitted on
a bounded sample of fingerprints (one of ``SHARE``, ``SAMPLE`` at least and ``MAX_SAMPLE``
at most, so leaves hold about as many rows at any size); every fingerprint is then stored in
the one leaf it falls in, and asks every leaf that a ball of the block's radius
around it can reach (the triangle inequality prunes the others). Leaves are the
shards: pairs are compared inside them and only links that connect the groups are
emitted, so a dense group costs rows, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fingerprints that the trees are fitted on; all are indexed.
SAMPLE, SHARE, MAX_SAMPLE = 32_768, 64, 1 << 20
LEAF_ROWS = 1024
#: Rows of one leaf that are compared in one task; a larger leaf is cut in blocks.
BLOCK_ROWS = 4096
MAX_DEPTH = 24


def blocks(words: int, parts: int) -> np.ndarray:
    """Disjoint masks [parts, words] of neighbouring bits that cover all bits."""
    bits = np.arange(words * 64) * parts // (words * 64)
    out = np.zeros((parts, words), np.uint64)
    for at, p in enumerate(bits):
        out[p, at // 64] |= np.uint64(1) << np.uint64(at % 64)
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances along the last axis of uint64 words."""
    x = np.bitwise_count(a ^ b)
    return x[..., 0].astype(np.int16) if x.shape[-1] == 1 else x.sum(-1, dtype=np.int16)


@dataclass
class Tree:
    mask: np.ndarray
    radius: int
    vantage: np.ndarray  # [nodes, words]
    bound: np.ndarray  # rows with distance <= bound go left
    left: np.ndarray  # child node, or ~leaf
    right: np.ndarray
    leaves: int

    @classmethod
    def fit(cls, sample: np.ndarray, mask: np.ndarray, radius: int, rows_each: float, leaf_rows: int) -> Tree:
        """rows_each: fingerprints that one of the sample stands for."""
        x = sample & mask
        nodes: list[list] = []
        leaves = 0

        def grow(own: np.ndarray, depth: int) -> int:
            nonlocal leaves
            best = None
            if len(own) * rows_each > leaf_rows and depth < MAX_DEPTH:
                for at in own[:: max(1, len(own) // 8)][:8]:
                    d = np.bincount(hamming(x[own], x[at]), minlength=65 * x.shape[1])
                    upto = np.cumsum(d) / len(own)
                    pad = np.concatenate([np.zeros(radius), upto, np.ones(radius)])
                    asks_left, asks_right = pad[2 * radius :], 1 - pad[: len(upto)]
                    cost = upto * asks_left + (1 - upto) * asks_right
                    mu = int(cost.argmin())
                    if cost[mu] < 0.85 and (best is None or cost[mu] < best[0]):
                        best = (cost[mu], at, mu)
            if best is None:
                leaves += 1
                return ~(leaves - 1)
            _, at, mu = best
            me = len(nodes)
            nodes.append([x[at], mu, 0, 0])
            near = hamming(x[own], x[at]) <= mu
            nodes[me][2] = grow(own[near], depth + 1)
            nodes[me][3] = grow(own[~near], depth + 1)
            return me

        grow(np.arange(len(x)), 0)
        return cls(
            mask, radius,
            np.array([n[0] for n in nodes], np.uint64).reshape(len(nodes), x.shape[1]),
            *(np.array([n[k] for n in nodes], np.int64) for k in (1, 2, 3)), leaves,
        )

    def route(self, x: np.ndarray, asking: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows, whether each lives there): every row's own leaf and, if asking,
        all leaves that its ball reaches."""
        x = x & self.mask
        todo = [(0 if len(self.vantage) else ~0, np.arange(len(x)), np.ones(len(x), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows, home
                continue
            d = hamming(x[rows], self.vantage[node])
            near, r = d <= self.bound[node], self.radius if asking else 0
            for child, own, reach in (
                (self.left[node], near, d - r <= self.bound[node]),
                (self.right[node], ~near, d + r > self.bound[node]),
            ):
                todo.append((int(child), rows[reach], (home & own)[reach]))


def _array(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names], 1)


def _task(tree: int, leaf: int, asking, living) -> np.ndarray:
    """A number for each pair of a leaf's blocks. Where two pairs share one, more is
    compared than need be."""
    out = np.full(1, tree << 32 | leaf, np.uint64)
    for part in (asking, living):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(part).astype(np.uint64)
    return out.view(np.int64)


def _links(left: np.ndarray, right: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray, distance: int, whole: int):
    """(left id, right id, cut) of pairs within distance, enough of them to connect all
    that are; every pair of a row with at most ``whole`` of them, and the ``whole``
    nearest ones of a row with more (cut)."""
    label = np.arange(len(right))
    out: list[tuple[int, int, int]] = []
    step = max(1, 2_000_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        far = hamming(left[at : at + step, None, :], right[None, :, :])
        close = (far <= distance) & (left_ids[at : at + step, None] != right_ids[None, :])
        for k in np.flatnonzero(close.any(1)):
            near = np.flatnonzero(close[k])
            found, first = np.unique(label[near], return_index=True)
            cut = len(near) > whole
            if cut and whole:
                nearest = near[np.argpartition(far[k, near], whole - 1)[:whole]]
                chosen = np.union1d(nearest, near[first])
            else:
                chosen = near[first] if cut else near
            out.extend((left_ids[at + k], right_ids[r], cut) for r in chosen)
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    return out


def links(points: DataFrame, names: list[str], distance: int, masks: np.ndarray, radius: int | None = None,
          sample=SAMPLE, leaf_rows=LEAF_ROWS, block_rows=BLOCK_ROWS, whole=0) -> DataFrame:
    """Links (a, b, cut) between nodes whose fingerprints lie within ``distance``: enough
    of them to connect each group, all those of a node with at most ``whole`` of them in
    a shard, and the nearest ones of a node with more (cut). ``points``: node long (unique) and the words of
    its fingerprint as longs in ``names``. With the default radius the search is
    exact; a smaller radius or fewer masks trade recall for work."""
    spark = points.sparkSession
    radius = distance // len(masks) if radius is None else radius
    total = points.count()
    sample = max(sample, min(MAX_SAMPLE, total // SHARE))
    fitted = points.select(*names, F.xxhash64(*names).alias("_h")).orderBy("_h", *names).limit(sample).toArrow()
    own = np.stack([fitted.column(n).to_numpy().view(np.uint64) for n in names], 1)
    trees = [Tree.fit(own, m, radius, total / max(1, len(own)), leaf_rows) for m in masks]

    def homes(batches):
        for b in batches:
            x = _array(b, names)
            for t, tree in enumerate(trees):
                for leaf, rows, _ in tree.route(x, asking=False):
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "leaf": pa.array([leaf], pa.int32()), "n": pa.array([len(rows)], pa.int64())})

    counts = points.select("node", *names).mapInArrow(homes, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()
    cut = {(r["tree"], r["leaf"]): -(-r["n"] // block_rows) for r in counts}  # at most one entry a leaf

    def deal(batches):
        for b in batches:
            whole, node = _array(b, names), b.column("node").to_numpy(zero_copy_only=False)
            for start in range(0, len(node), 4096):
                x, ids = whole[start : start + 4096], node[start : start + 4096]
                mix = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                parts = []
                for t, tree in enumerate(trees):
                    for leaf, rows, home in tree.route(x):
                        n = cut.get((t, leaf), 0)
                        if not n:
                            continue  # nothing lives there
                        block = (mix[rows] % np.uint64(n)).astype(np.int64)
                        if n == 1:
                            parts.append((rows, _task(t, leaf, 0 * block, 0), np.ones(len(rows), bool), home))
                            continue
                        for k in range(n):
                            parts.append((rows, _task(t, leaf, block, k), np.ones(len(rows), bool), np.zeros(len(rows), bool)))
                            parts.append((rows[home], _task(t, leaf, k, block[home]), np.zeros(int(home.sum()), bool), np.ones(int(home.sum()), bool)))
                if parts:
                    rows = np.concatenate([p[0] for p in parts])
                    yield pa.RecordBatch.from_pydict(
                        {"task": np.concatenate([p[1] for p in parts]).astype(np.int64), "node": ids[rows]}
                        | {n: x[rows, k].view(np.int64) for k, n in enumerate(names)}
                        | {"asks": np.concatenate([p[2] for p in parts]), "lives": np.concatenate([p[3] for p in parts])}
                    )

    words = ", ".join(f"{n} long" for n in names)

    def match(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        x = np.stack([table.column(n).to_numpy().view(np.uint64) for n in names], 1)
        asks, lives = (table.column(c).to_numpy() for c in ("asks", "lives"))
        got = _links(x[asks], x[lives], ids[asks], ids[lives], distance, whole)
        pairs = np.array(got, np.int64).reshape(-1, 3)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "cut": pairs[:, 2] == 1})

    dealt = points.select("node", *names).mapInArrow(deal, f"task long, node long, {words}, asks boolean, lives boolean")
    return dealt.groupBy("task").applyInArrow(match, "a long, b long, cut boolean")
