"""Intermediate tables in the shared folder of the cluster.

A staged table cuts lineage: what is read back stays the same when an executor is
lost, and its file size is known before the next query is planned, so Catalyst
broadcasts it only when it is below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Staged tables up to this many rows are broadcast.
BROADCAST_ROWS = 200_000
SALTS = 16
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where it is unset, a folder set on the context is used; a temporary folder is
    made only for a local master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lumenprep-"))
    return context.getCheckpointDir().rstrip("/")


def staging_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lumenprep/{spark.sparkContext.applicationId}"


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the staging folder of this application."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


_scopes = threading.local()


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end; what is read from them must be written by then."""
    outer = getattr(_scopes, "paths", None)
    _scopes.paths = []
    try:
        yield
    finally:
        for path in _scopes.paths:
            _delete(spark, path)
        _scopes.paths = outer


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def unstage(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        path = table.__dict__.pop("_staged_path", None) if table is not None else None
        if path is not None:
            _delete(table.sparkSession, path)


@contextmanager
def small_batches(spark: SparkSession, limit: int) -> Iterator[None]:
    """Arrow batches of jobs run inside have about ``limit`` bytes; the session's own bound holds again afterwards.

    A task's batch lies in the executor outside of its heap, twice while it grows, and in the Python worker.
    """
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(limit))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def join_staged(
    left: DataFrame,
    staged: DataFrame,
    on: Sequence[str],
    spread: str,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join to a staged table with one row per key, on keys that may be hot in ``left``.

    The staged table is counted (from its file footers) and broadcast when small. A larger
    one is repeated once per salt, and rows of a hot key go to as many tasks as there are
    salts, by the hash of ``spread``. NULL equals NULL.
    """
    right = staged.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in staged.columns])
    keys = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    if staged.count() <= broadcast_rows:
        right = F.broadcast(right)
    else:
        left = left.withColumn("_salt", F.pmod(F.hash(spread), F.lit(SALTS)))
        salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
        # Spark does not see that it is repeated, and would broadcast all copies of a small file.
        right = right.withColumn("_r_salt", salts).hint("merge")
        keys.append(F.col("_salt") == F.col("_r_salt"))
    joined = left.join(right, reduce(lambda a, b: a & b, keys), how)
    return joined.drop("_salt", "_r_salt", *[f"_r_{c}" for c in on])


def clear_staged(spark: SparkSession) -> bool:
    """Delete what this application has staged; results read from it are gone afterwards."""
    return _delete(spark, staging_root(spark))


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
