"""Stage boundaries: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_made: list[tuple[SparkSession, str]] = []
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one
    given to ``setCheckpointDir``. Without either a folder of this machine will do if
    driver and executors are one process; elsewhere it would not be shared, and is refused."""
    global _own_dir
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir")
    if not given:
        set_later = context._jsc.sc().getCheckpointDir()
        given = set_later.get() if set_later.isDefined() else None
    if given:
        return given.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="waymark-tables-")
        atexit.register(lambda d=_own_dir: os.path.isdir(d) and shutil.rmtree(d, ignore_errors=True))
    return _own_dir


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}/{tag}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_path`, through Hadoop's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    """Tables that results may read stay until the application ends."""
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; its folder is the cluster's to clear
            return


def settle(df: DataFrame, tag: str = "t", by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder, in a folder for each value of ``by`` if given, and
    read it back: later plans start from it, and lost executors cost no more."""
    path = new_path(df.sparkSession, tag)
    _made.append((df.sparkSession, path))
    for scope in getattr(_open, "scopes", ()):
        scope.append(path)
    df.write.partitionBy(*by or []).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._waymark_path = path
    return out


def once(rows: DataFrame, by: list[str], number: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what ``build`` makes of each different ``by``, which it gets once, under a
    ``number`` of its own that it keeps. Joined by sorting: what the planner takes for small
    because its file is well packed need not fit into the driver."""
    first = settle(rows.select(*by).distinct().withColumn(number, F.monotonically_increasing_id()), "once")
    keys = first.select(number, *(F.col(c).alias(f"_of_{c}") for c in by))
    made = build(first).join(keys.hint("merge"), number).drop(number)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by))
    return rows.join(made.hint("merge"), same).drop(*(f"_of_{c}" for c in by))


def discard(df: DataFrame) -> None:
    """Delete what :func:`settle` wrote, once nothing reads it any more."""
    path = getattr(df, "_waymark_path", None)
    if path and any(p == path for _, p in _made):
        _made[:] = [(s, p) for s, p in _made if p != path]
        drop_path(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables settled inside are deleted at the end, but for those put into the list."""
    scopes = _open.__dict__.setdefault("scopes", [])
    paths: list[str] = []
    keep: list[DataFrame] = []
    scopes.append(paths)
    try:
        yield keep
    finally:
        scopes.remove(paths)
        gone = set(paths) - {df._waymark_path for df in keep}
        for _, path in [m for m in _made if m[1] in gone]:
            drop_path(spark, path)
        _made[:] = [m for m in _made if m[1] not in gone]
