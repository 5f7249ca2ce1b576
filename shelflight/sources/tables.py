"""Reading and writing tables: upserts, keyed updates, appends, exports.

Parquet has no MERGE, so every change is a rewrite by joins into a new table; the
caller swaps it in, or uses ``overwrite`` where the target is a path of its own.
Nulls in key columns never conflict, as in a relational unique index.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Folders of runs that are under way, the latest last.
_RUNS: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder of the run (``run_folder``), else in the session's checkpoint folder.

    That is ``spark.checkpoint.dir``, or what ``setCheckpointDir`` has set; only in
    local mode, where neither names one, a temporary folder is used.
    """
    base = _RUNS[-1] if _RUNS else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir: a folder that all its machines share")
    base = base or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """Tables that the work inside writes on its way go to a folder of their own, which is deleted at the end.

    Write the result elsewhere, or collect it, before the end: it reads those tables.
    """
    path = shared_dir(spark, name)
    _RUNS.append(path)
    try:
        yield path
    finally:
        _RUNS.remove(path)
        remove_folder(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A table of the catalog, or no rows of its schema where it does not exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def table_at(spark: SparkSession, path: str, schema: T.StructType, **options: object) -> DataFrame:
    """A Parquet table at a path, or no rows of its schema where nothing is there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of a folder of HTML files, one row each."""
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "html")
    return files.withColumn("url", F.input_file_name()).select("url", "html")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, columns: list[str], path: str) -> None:
    """CSV with a header in a fixed order of columns."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Truncate and reload: the same call twice leaves the same table."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder where there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def no_nulls(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def first_rows(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``, with partial aggregation: a key with many rows stays spread."""
    pick = F.max_by if last else F.min_by
    best = pick(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select("__row.*")


def insert_or_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``batch`` that an insert would add: unknown keys, the first of each by ``order``.

    Rows with a null in a key column are all added.
    """
    fresh = first_rows(batch.where(no_nulls(keys)), keys, order)
    fresh = fresh.join(target.select(*keys).distinct(), keys, "left_anti").select(*batch.columns)
    return fresh.unionByName(batch.where(~no_nulls(keys)))


def append_new(path: str, batch: DataFrame, keys: list[str], order: list[str]) -> int:
    """Append the rows that ``insert_or_ignore`` gives to a Parquet table; their number."""
    spark = batch.sparkSession
    added = materialise(insert_or_ignore(spark.read.parquet(path), batch, keys, order), "insert")
    append(added, path)
    return added.count()


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], replaced: list[str], order: list[str]) -> DataFrame:
    """``target`` after the batch: new keys are added, known keys get the batch's ``replaced`` columns, nulls too.

    Of several batch rows with one key the last by ``order`` counts. Batch rows
    with a null in a key column are all added. A column that the batch lacks is
    left as it is, and null in new rows.
    """
    keyless = batch.where(~no_nulls(keys))
    new = first_rows(batch.where(no_nulls(keys)), keys, order, last=True)
    new = new.select(*[F.col(c).alias(f"__new_{c}") for c in new.columns], F.lit(True).alias("__new"))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__new_{k}") for k in keys])
    joined = target.withColumn("__old", F.lit(True)).join(new, on, "full_outer")
    columns = []
    for c in target.columns:
        fresh = F.col(f"__new_{c}") if f"__new_{c}" in new.columns else F.lit(None)
        given = c in replaced and f"__new_{c}" in new.columns
        use_new = F.col("__new").isNotNull() if given else F.col("__old").isNull()
        columns.append(F.when(use_new, fresh).otherwise(F.col(c)).alias(c))
    added = [F.col(c) if c in batch.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    return joined.select(*columns).unionByName(keyless.select(*added))


def update_columns(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with non-null values of ``updates`` in ``columns``; other rows stay. Of several values of a key the greatest counts."""
    new = updates.groupBy(*keys).agg(*[F.max(c).alias(f"__new_{c}") for c in columns])
    joined = target.join(new, keys, "left")
    return joined.select(
        *[F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns]
    )


def latest_per_key(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; rows with a null in a key column all stay."""
    return first_rows(updates.where(no_nulls(keys)), keys, order, last=True).unionByName(updates.where(~no_nulls(keys)))


def flags_by_list(checks: DataFrame, flags: dict[str, str]) -> DataFrame:
    """(node_id, flag columns) from checks (node_id, list_type, valid): one column for each list."""
    return checks.groupBy("node_id").agg(
        *[F.max(F.when(F.col("list_type") == name, F.col("valid"))).alias(flag) for name, flag in flags.items()]
    )


def mark(target: DataFrame, ids: DataFrame, key: str, column: str, value: object = 1) -> DataFrame:
    """``target`` with ``column`` set where the key is listed."""
    listed = ids.select(F.col(key).alias("__id")).distinct()
    joined = target.join(listed, F.col(key) == F.col("__id"), "left")
    return joined.withColumn(column, F.when(F.col("__id").isNotNull(), F.lit(value)).otherwise(F.col(column))).drop("__id")


def delete_keys(target: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` without the rows of the listed keys."""
    return target.join(ids.select(*keys).distinct(), keys, "left_anti")


def delete_failing(target: DataFrame, key: str, passes: Column) -> DataFrame:
    """``target`` without any row of a key that has a failing row."""
    failing = target.where(~F.coalesce(passes, F.lit(False))).select(key).distinct()
    return target.join(failing, key, "left_anti")


def reset_column(target: DataFrame, column: str, where: Column) -> DataFrame:
    kind = target.schema[column].dataType
    return target.withColumn(column, F.when(where, F.lit(None).cast(kind)).otherwise(F.col(column)))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows by the order of the MD5 of key and seed: the same rows on every run and in every engine."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), key).limit(n)


def nested_as_json(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.to_json(F.col(c)) for c in columns})
