"""Shared helpers: materialised tables, memory, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import discard, new_path, scratch, shared_dir
from ..tables import settle as materialize

__all__ = ["ascii_lower", "connected_components", "discard", "fold", "materialize", "lots", "new_path", "scratch", "shared_dir", "trim_memory", "trimmed"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def trim_memory() -> None:
    """Give what a Python worker no longer uses back to the system; workers live on
    between tasks, beside a JVM that needs the room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run):
    """``run``, a function from batches to batches, with trim_memory() once it has given its
    last one and its own variables are gone."""

    def whole(batches):
        yield from run(batches)
        trim_memory()

    return whole


def lots(texts, rows: int, size: int):
    """(first, number) of runs of an Arrow array's texts: up to ``rows`` of them and ``size``
    bytes, or one text that is longer."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        room = (ends[at - 1] if at else 0) + size
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, room, side="right"))))
        yield at, stop - at
        at = stop


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def fold(col: Column, residues: int) -> Column:
    """crc32 of the id as text, modulo ``residues`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % residues


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the smallest node
    reachable. Alternates large-star and small-star steps; each only takes minima
    per node and joins them back, so no neighbour list is ever gathered and a hub
    with a third of all edges is pre-aggregated before its shuffle."""
    cur = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        nxt = materialize(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        state = nxt.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        discard(cur)
        cur = nxt
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not converge")
    stars = cur.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").unionAll(
        stars.select(F.col("root").alias("node"), "root").distinct()
    )
