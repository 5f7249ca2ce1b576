"""A table of unique keys that grows by batches without being read whole.

Rows lie in folders by batch and by a bucket of their key's hash. Beside them lies
an index: each key sets four bits of one 64-bit word of its bucket (a Bloom filter
in blocks of a word), a row for each word in use. A batch meets the index first;
only keys whose bits are all set may be known, and only the folders in which
they may lie are read. Each batch writes folders of its own, so one that comes
again replaces what it wrote and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflight.sources.tables import first_rows, materialise, no_nulls, remove_folder, table_at

_INDEX = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("word", "bits")] + [T.StructField(c, T.IntegerType()) for c in ("batch", "bucket")]
)
#: Keys that share a word of the index on average, once the table has the keys that it was made for.
_KEYS_A_WORD = 4
#: The bits of no more keys than this, 20 bytes each, are sent to the tasks, which read the index as it lies; more are shuffled with it.
FEW = 100_000


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` with unique ``keys``; rows with a null in a key column never conflict.

    ``buckets`` and ``expected_keys`` are fixed for the life of a table: the index
    stays right beyond ``expected_keys``, but lets more folders be read.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = 64
    expected_keys: int = 1 << 26

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with __bucket, __word and __mask from one hash of the key; null keys all lie in bucket -1."""
        whole = F.xxhash64(*[F.col(f"`{k}`") for k in self.keys])
        words = max(1, self.expected_keys // (self.buckets * _KEYS_A_WORD))
        hashed = rows.withColumn("__hash", whole)
        bucket = F.when(no_nulls(list(self.keys)), F.pmod("__hash", F.lit(self.buckets))).otherwise(F.lit(-1)).cast("int")
        # a second hash, so that the word and the bits do not follow the bucket
        second = F.xxhash64(F.col("__hash"), F.lit(1))
        bit = lambda shift: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__second, {shift}) & 63 as int))")
        mask = reduce(lambda a, b: a.bitwiseOR(b), [bit(s) for s in (0, 6, 12, 18)])
        hashed = hashed.withColumn("__bucket", bucket).withColumn("__second", second)
        word = F.pmod(F.shiftrightunsigned("__second", 24), F.lit(words)).cast("long")
        return hashed.withColumn("__word", word).withColumn("__mask", mask).drop("__hash", "__second")

    def _rows_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, *[T.StructField(c, T.IntegerType()) for c in ("batch", "bucket")]])

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows."""
        return table_at(spark, f"{self.path}/rows", self._rows_schema()).select(*self.schema.names)

    def holding(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """The keys of ``batch`` that may be known before it, and the part of the table in which they may lie.

        The part is chosen by folders: by the batches and buckets whose index has the keys' bits.
        """
        index = table_at(spark, f"{self.path}/index", _INDEX).where(F.col("batch") != batch_id)
        placed = materialise(self._placed(batch.select(*self.keys).where(no_nulls(list(self.keys))).distinct()), "placed")
        near = [r.bucket for r in placed.select(F.col("__bucket").alias("bucket")).distinct().collect()]  # ``buckets`` at most
        index = index.where(F.col("bucket").isin(near) if near else F.lit(False))
        own = placed.select("__bucket", "__word", "__mask").distinct()
        own = F.broadcast(own) if placed.count() <= FEW else own.hint("merge")
        has = F.col("bits").bitwiseAND(F.col("__mask")) == F.col("__mask")
        met = index.join(own, (F.col("__bucket") == F.col("bucket")) & (F.col("__word") == F.col("word")), "inner").where(has)
        met = materialise(met.select("__bucket", "__word", "__mask", "batch").distinct(), "met")
        maybe = placed.join(met.hint("merge"), ["__bucket", "__word", "__mask"], "left_semi").select(*self.keys)
        # at most one row for each folder of the table
        folders = met.select("batch", F.col("__bucket").alias("bucket")).distinct().collect()
        rows = table_at(spark, f"{self.path}/rows", self._rows_schema())
        own = F.col("batch").isin({f.batch for f in folders}) & F.col("bucket").isin({f.bucket for f in folders})
        return maybe, rows.where(own if folders else F.lit(False)).select(*self.schema.names)

    def insert(self, batch: DataFrame, batch_id: int, order: list[str]) -> DataFrame:
        """Add the rows of ``batch`` whose keys are unknown, the first of each by ``order``; the rows added.

        Batches before and after may come in any order; one that comes again sees
        the table without what it added before. Rows with a null in a key column are all added.
        """
        spark = batch.sparkSession
        keys = list(self.keys)
        batch = materialise(batch.select(*self.schema.names), "batch")
        maybe, part = self.holding(spark, batch, batch_id)
        known = maybe.join(part.select(*keys).distinct().hint("merge"), keys, "left_semi")
        fresh = first_rows(batch.where(no_nulls(keys)), keys, order).join(known.hint("merge"), keys, "left_anti")
        fresh = fresh.select(*self.schema.names).unionByName(batch.where(~no_nulls(keys)))
        added = materialise(fresh, "added")
        placed = self._placed(added)
        at = F.lit(batch_id).cast("int")
        bits = placed.where(no_nulls(keys)).groupBy("__bucket", "__word").agg(F.bit_or("__mask").alias("bits"))
        # the index first: bits without rows only cost a look, rows without bits would be added again
        _replace(
            bits.select(F.col("__word").alias("word"), "bits", at.alias("batch"), F.col("__bucket").alias("bucket")),
            f"{self.path}/index", batch_id,
        )
        _replace(placed.select(*self.schema.names, at.alias("batch"), F.col("__bucket").alias("bucket")), f"{self.path}/rows", batch_id)
        return added

    def writer(self, order: list[str]) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` writer."""
        return lambda batch, batch_id: self.insert(batch, batch_id, order) and None

    def compacted(self, spark: SparkSession, path: str) -> KeyedTable:
        """A copy at a new path with one folder for each bucket and one index row for each word."""
        copy = KeyedTable(path, self.schema, self.keys, self.buckets, self.expected_keys)
        rows = table_at(spark, f"{self.path}/rows", self._rows_schema()).withColumn("batch", F.lit(-1))
        index = table_at(spark, f"{self.path}/index", _INDEX).groupBy("word", "bucket").agg(F.bit_or("bits").alias("bits"))
        _replace(rows, f"{path}/rows", -1)
        _replace(index.withColumn("batch", F.lit(-1)), f"{path}/index", -1)
        return copy


def _replace(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the folders of a batch anew; those of others stay."""
    remove_folder(rows.sparkSession, f"{path}/batch={batch_id}")
    # keys are unique, so buckets are even; rows without a key may be many, and lie in one folder as several files
    part: Column = F.when(F.col("bucket") < 0, F.pmod(F.monotonically_increasing_id(), F.lit(64))).otherwise(0)
    rows.repartition("bucket", part).write.mode("append").partitionBy("batch", "bucket").parquet(path)
