"""Watchlist: additions, removals, daily snapshots and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.operators.sightings import latest
from shelflight.sources.tables import delete_keys, materialise, table_at, upsert

MEASURES = ["price", "rank", "rating", "review_count"]


def watched(watchlist: DataFrame) -> DataFrame:
    """The watchlist, the latest additions first."""
    return watchlist.orderBy(F.desc_nulls_last("added_at"), "asin")


def watch(watchlist: DataFrame, additions: DataFrame, order: list[str]) -> DataFrame:
    """The watchlist after additions: name and notes are replaced, the first added_at stays."""
    return upsert(watchlist, additions, ["asin"], ["name", "notes"], order)


def unwatch(watchlist: DataFrame, ids: DataFrame) -> DataFrame:
    return delete_keys(watchlist, ids, ["asin"])


def snapshot(watchlist: DataFrame, sightings: DataFrame, day: Column, order: list[str]) -> DataFrame:
    """The latest sighting of each watched item under a date; items without one are left out."""
    watched = sightings.join(watchlist.select("asin").distinct(), "asin", "left_semi")
    return latest(watched, "asin", order).select("asin", *MEASURES, day.alias("snapshot_date"))


def track(tracking: DataFrame, today: DataFrame) -> DataFrame:
    """The series after a day's snapshot: a rerun of the day replaces its rows."""
    return upsert(tracking, today, ["asin", "snapshot_date"], MEASURES, ["asin"])


def track_into(path: str, today: DataFrame) -> None:
    """``track`` into a table partitioned by snapshot_date: only the partitions of the days given are read and written."""
    spark = today.sparkSession
    today = materialise(today, "snapshot")
    days = [r.snapshot_date for r in today.select("snapshot_date").distinct().collect()]  # a day or a few
    old = table_at(spark, path, today.schema).where(F.col("snapshot_date").isin(days) if days else F.lit(False))
    new = materialise(track(old, today), "series")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def history(tracking: DataFrame, asin: str | None = None) -> DataFrame:
    """Snapshots with the change of price since the one before."""
    rows = tracking if asin is None else tracking.where(F.col("asin") == asin)
    change = F.expr("price - lag(price) over (partition by asin order by snapshot_date)")
    return rows.withColumn("price_change", change)
