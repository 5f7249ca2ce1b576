"""Helpers shared by the text-corpus operators.

Intermediate results that must not change when an executor is lost are written
as tables below the folder named by ``spark.checkpoint.dir``; nothing is kept
only in executor memory or on one machine's disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this part of all rows is hot: fewer than HOT_KEYS keys can be.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder of the session.

    Only where the session names no such folder (tests, a notebook in local
    mode) a temporary folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not set_dir.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that all its machines share")
        base = set_dir.get() if set_dir.isDefined() else tempfile.mkdtemp(prefix="spark-")
        if not set_dir.isDefined():
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def surrogate_key(spark: SparkSession) -> str:
    """The secret of the surrogates, from the session's setting ``spark.shelflight.surrogate.secret``.

    Where it is unset (tests, trials) a key that is no secret is used: whoever
    knows it can test guesses against surrogates.
    """
    return spark.conf.get("spark.shelflight.surrogate.secret", "not secret")


#: Spark's setting that removes a query's shuffle files when the query ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def materialise(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage and its shuffle files end here.

    The path is added to ``used``, for ``discard`` when nothing reads it any more.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with _releasing_shuffles(spark):
        df.write.parquet(path)
    if used is not None:
        used.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more, and empty the list."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, count: str = "n", hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row for each key, without gathering a hot key in one task.

    ``count`` is a column of ``per_key``: how many ``rows`` have the key. Keys
    with more than one in ``hot_keys`` of all rows, fewer than ``hot_keys`` by that
    bound, are sent to all tasks; the rows of the other keys are shuffled. Rows
    without a partner are left out. Both should be written tables: they are read
    more than once.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > F.lit(total / hot_keys)
    few, many = per_key.where(hot), per_key.where(~hot)
    spread = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(many.hint("merge"), key)
    return spread.unionByName(rest)
