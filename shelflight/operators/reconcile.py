"""Two copies of a table compared by content: digests of key buckets first, then only the buckets that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflight.sources.tables import materialise

#: Halves of a hash are added up apart, so that a sum fits a long for 2^31 rows of a bucket.
_LOW = (1 << 32) - 1


def _row_hash(columns: list[str], seed: int) -> Column:
    """A hash that tells null from every value in each column."""
    own = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *own, *[c.isNull() for c in own])


def store_bucketed(df: DataFrame, keys: list[str], buckets: int, path: str) -> DataFrame:
    """Write a table in a folder for each bucket of its keys' hash; the stored table with column bucket.

    A key with very many rows keeps its rows in several files of its folder.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(4))).write.partitionBy("bucket").parquet(path)
    return stored(df.sparkSession, path, df.schema)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)


def bucket_digests(table: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket, n, a, b, c, d): rows and sums of two hashes of them; the order of rows does not matter, their number does."""
    first, second = _row_hash(columns, 1), _row_hash(columns, 2)
    sums = [
        F.sum(h.bitwiseAND(F.lit(_LOW)) if low else F.shiftrightunsigned(h, 32)).alias(name)
        for name, h, low in (("a", first, True), ("b", first, False), ("c", second, True), ("d", second, False))
    ]
    return table.groupBy("bucket").agg(F.count("*").alias("n"), *sums)


def differing_buckets(left: DataFrame, right: DataFrame, columns: list[str]) -> list[int]:
    """Buckets whose digests differ or that only one side has: no more numbers than buckets."""
    ours, theirs = bucket_digests(left, columns), bucket_digests(right, columns)
    parts = ["n", "a", "b", "c", "d"]
    both = ours.select("bucket", F.struct(*parts).alias("x")).join(theirs.select("bucket", F.struct(*parts).alias("y")), "bucket", "full_outer")
    return sorted(r.bucket for r in both.where(~F.col("x").eqNullSafe(F.col("y"))).select("bucket").collect())


def reconcile_content(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, in_left, in_right): rows that the two stored tables hold a different number of times.

    Nulls equal each other. Both sides are tables of ``store_bucketed`` with the same
    keys and number of buckets; folders whose digests agree are read for them only.
    """
    buckets = differing_buckets(left, right, columns)
    wanted = F.col("bucket").isin(buckets) if buckets else F.lit(False)
    sides = [
        side.where(wanted).select(*columns, F.lit(a).alias("l"), F.lit(1 - a).alias("r")) for side, a in ((left, 1), (right, 0))
    ]
    counted = sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("l").alias("in_left"), F.sum("r").alias("in_right"))
    return counted.where("in_left <> in_right")


def differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], buckets: int, path: str) -> DataFrame:
    """``reconcile_content`` of two tables that are not stored yet, by way of ``path``."""
    sides = [store_bucketed(df.select(*columns), keys, buckets, f"{path}/{name}") for name, df in (("left", left), ("right", right))]
    return materialise(reconcile_content(*sides, columns), "differences")
