"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

#: Plans and their tables by the plans' hashes, while a report shares its stages.
_KNOWN: ContextVar[dict[int, list[tuple[DataFrame, DataFrame]]] | None] = ContextVar(
    "known", default=None)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "fareloom", **settings: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submitter decides the
    first, and AQE coalesces or splits whatever the second is.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str | None:
    """What the session names, or what was given to ``SparkContext.setCheckpointDir``.

    The setting can't be changed in a running session; the context's folder can.
    """
    return spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors must all see."""
    root = checkpoint_root(spark)
    if not root:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    return f"{_own_folder(spark, root)}/{purpose}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession, root: str) -> str:
    return f"{root.rstrip('/')}/fareloom/{spark.sparkContext.applicationId}"


def remove_written(spark: SparkSession) -> None:
    """Delete what this application has written with ``written`` and ``shared_folder``.

    For when its reports are finished: DataFrames that read such tables can't be used afterwards.
    """
    root = checkpoint_root(spark)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark, root))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    For an intermediate result that several branches of a plan use: it is computed once, survives
    the loss of executors, and its size on disk tells Spark whether it can be broadcast. A
    ``folder`` of the caller's is written over, so that a stream does not pile up tables.
    """
    known = None if folder else _KNOWN.get()
    if known is not None:
        for plan, table in known.setdefault(df.semanticHash(), []):
            if plan.sameSemantics(df):
                return table
    path = f"{folder}/{purpose}" if folder else shared_folder(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    table = df.sparkSession.read.parquet(path)
    if known is not None:
        known[df.semanticHash()].append((df, table))
    return table


@contextmanager
def shared_stages() -> Iterator[None]:
    """Inside it, ``written`` writes a plan once and gives its table to all that ask for the same.

    For a report that needs a stage in several places, as a decision needs features of the past
    for its model and of what it decides. The tables are those of their first use: what a plan
    reads must not change meanwhile. Other threads, a stream's among them, do not share.
    """
    token = _KNOWN.set({})
    try:
        yield
    finally:
        _KNOWN.reset(token)
