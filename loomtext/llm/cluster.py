"""Shared tables between stages, and helpers for joins whose sides are of unknown size."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 8-byte ids that are broadcast at most, after they have been counted.
BROADCAST_IDS = 400_000

#: Bytes of one Arrow batch handed to a Python worker while a table is written; a task holds few batches at once.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_ROOTS: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def _root(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, which all executors share.

    Only a session of one machine may leave that setting out; its folder is then a temporary one.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = os.path.join(tempfile.gettempdir(), "loomtext-tables")
        _ROOTS[app] = f"{base.rstrip('/')}/loomtext-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(drop_tables, spark, _ROOTS[app])
    return _ROOTS[app]


def drop_tables(spark: SparkSession, path: str) -> None:
    """Remove written tables; a session that has ended leaves that to the shared folder's own cleaning."""
    if spark.sparkContext._jsc is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_BYTES`` at most for what runs inside; the session's own bound, if smaller, holds, and comes back."""
    conf = spark.conf
    before = conf.get(_BATCH, None)
    own = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) if before else 0
    if 0 < own <= BATCH_BYTES:
        yield
        return
    conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        conf.unset(_BATCH) if before is None else conf.set(_BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a Parquet table in the shared folder and read back: lineage ends here,
    and a lost executor costs a reread and not the work before."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """Where the list of written tables stands now, for ``trimmed``."""
    return len(_TABLES.setdefault(spark.sparkContext.applicationId, []))


def trimmed(result: DataFrame, since: int = 0) -> DataFrame:
    """The result, after removal of the tables written since ``mark`` that its plan doesn't read."""
    spark = result.sparkSession
    tables = _TABLES.setdefault(spark.sparkContext.applicationId, [])
    read = {f.rsplit("/", 1)[0] for f in result.inputFiles()}
    name = lambda path: path.rsplit("/", 1)[1]
    used = {name(folder) for folder in read}
    for path in tables[since:]:
        if name(path) not in used:
            drop_tables(spark, path)
    tables[since:] = [path for path in tables[since:] if name(path) in used]
    return result


def free(df: DataFrame | Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it, upper and lower case alike."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def by_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join on one id column; the ids are broadcast only if their count is within a bound."""
    ids = ids.select(column).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, column, how)
