"""Sightings of items on ranked lists: positions, first-seen rows, roll-ups, pages and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.operators.filters import ListGate, PageFilter, clamp
from shelflight.sources.tables import first_rows


def list_positions(items: DataFrame) -> DataFrame:
    """``items`` (node_id, list_type, page_no, idx, rank) with list_position.

    The badge's rank where there is one, else the place: items of earlier pages
    of the list, plus the index on the page (from 0), plus 1.
    """
    sizes = items.groupBy("node_id", "list_type", "page_no").agg(F.count("*").alias("__n"))
    starts = sizes.selectExpr(
        "node_id",
        "list_type",
        "page_no",
        """coalesce(sum(__n) over (partition by node_id, list_type order by page_no
           rows between unbounded preceding and 1 preceding), 0) as __start""",
    )
    joined = items.join(starts, ["node_id", "list_type", "page_no"])
    return joined.withColumn(
        "list_position", F.coalesce(F.col("rank").cast("long"), F.col("__start") + F.col("idx") + 1)
    ).drop("__start")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order of processing; nulls are one key."""
    return first_rows(rows, keys, order)


def gated(rows: DataFrame, gate: ListGate, order: list[str], dedupe: tuple[str, ...] = ("asin",)) -> DataFrame:
    """Rows that pass the gates of their list, then the first row of each key.

    The gate comes first, so an item that fails on one list may stay from another.
    """
    return first_seen(rows.where(gate.column()), list(dedupe), order)


def rollup(sightings: DataFrame, tie_break: list[str]) -> DataFrame:
    """One row per item over all its lists, those on most lists first, then those with fewest reviews.

    The describing columns are those of the row with the best rank; ties go to
    the earliest sighting, then by ``tie_break``.
    """
    joined = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit(""))
    order = F.struct(
        F.coalesce(F.col("rank"), F.lit(2147483647)).alias("rank"),
        F.col("scraped_at"),
        *[F.col(c) for c in tie_break],
    )
    shown = ["name", "price", "rating", "review_count"]
    best = F.min_by(F.struct(*shown), order)
    grouped = sightings.groupBy("asin").agg(
        best.alias("best"),
        joined("list_type").alias("lists"),
        F.size(F.collect_set("list_type")).cast("long").alias("list_count"),
        joined("node_id").alias("categories"),
        F.min("rank").alias("best_rank"),
        F.min("scraped_at").alias("first_seen"),
    )
    return grouped.select(
        "asin", *[F.col(f"best.{c}").alias(c) for c in shown], "lists", "list_count", "categories", "best_rank", "first_seen"
    ).orderBy(F.desc("list_count"), F.asc_nulls_first("review_count"), "asin")


def page(
    sightings: DataFrame, bounds: PageFilter, columns: list[str], tie_break: list[str], limit: int | None = 50, offset: int = 0
) -> DataFrame:
    """A page of sightings, the latest first; at most 200 rows."""
    rows = sightings.where(bounds.column()).select(*columns)
    order = [F.desc_nulls_last("scraped_at"), *[F.asc_nulls_first(c) for c in tie_break]]
    return rows.orderBy(*order).offset(max(offset, 0)).limit(clamp(limit, 50, 200))


def item_stats(sightings: DataFrame) -> DataFrame:
    """One row: distinct items, items on more than one list, sightings."""
    per_item = sightings.groupBy("asin").agg(F.countDistinct("list_type").alias("lists"), F.count("*").alias("n"))
    return per_item.agg(
        F.count("asin").alias("items"),
        F.count_if(F.col("lists") > 1).alias("multi_list"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("sightings"),
    )


def items_by_list(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("list_type").agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key; nulls are one key."""
    return first_rows(rows, [key], order, last=True)


def best_per_key(rows: DataFrame, key: str, metric: str, columns: list[str]) -> DataFrame:
    """The row with the least metric of each key, ties by the columns in order."""
    order = F.struct(F.col(metric), *[F.col(c) for c in columns])
    return rows.where(F.col(metric).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*columns), order).alias("best"), F.min(metric).alias(metric)
    ).select(key, metric, *[F.col(f"best.{c}").alias(c) for c in columns if c != metric])


def enriched(sightings: DataFrame, details: DataFrame, passes: Column | None, fields: list[str]) -> DataFrame:
    """Sightings with detail fields, without any row of an item whose details fail.

    Of several details of an item each field has its least value, and all must
    pass. Items without details stay as they are; ``passes`` None filters nothing.
    """
    test = F.lit(True) if passes is None else F.coalesce(passes, F.lit(False))
    new = details.withColumn("__passes", test).groupBy("asin").agg(
        F.bool_and("__passes").alias("__passes"), *[F.min(f).alias(f"__{f}") for f in fields]
    )
    joined = sightings.join(new.hint("merge"), "asin", "left")
    if passes is not None:
        joined = joined.where(F.coalesce("__passes", F.lit(True)))
    have = set(sightings.columns)
    merged = [F.coalesce(f"__{f}", f).alias(f) if f in have else F.col(f"__{f}").alias(f) for f in fields]
    return joined.select(*[F.col(c) for c in sightings.columns if c not in fields], *merged)
