"""New arrivals: candidates from search pages, details, the accept and signal rules, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.operators.sightings import first_seen


@dataclass(frozen=True)
class ArrivalRules:
    """Bounds of an accepted arrival and of a signal (inclusive, but for the signal's reviews)."""

    max_age_days: int = 30
    max_main_rank: int = 200_000
    signal_age_days: int = 7
    signal_reviews: int = 10
    signal_rank: int = 50_000


RULES = ArrivalRules()


def accepted(main_rank: Column, age_days: Column, rules: ArrivalRules = RULES) -> Column:
    """Has a sales rank, is not known to be too old, and does not rank too low."""
    young = F.coalesce(age_days <= rules.max_age_days, F.lit(True))
    return main_rank.isNotNull() & young & (main_rank <= rules.max_main_rank)


def is_signal(main_rank: Column, age_days: Column, reviews: Column, rules: ArrivalRules = RULES) -> Column:
    """Young by date, hardly reviewed, and ranked well or not at all."""
    return (
        F.coalesce(age_days <= rules.signal_age_days, F.lit(False))
        & (F.coalesce(reviews, F.lit(0)) < rules.signal_reviews)
        & F.coalesce(main_rank <= rules.signal_rank, F.lit(True))
    )


def candidates(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct items of search pages with the node that showed them first.

    ``found`` has asin, node_id, page_no, idx; ``nodes`` node_id, name, depth.
    """
    first = first_seen(found, ["asin"], ["node_id", "page_no", "idx"])
    named = nodes.select("node_id", F.col("name").alias("category_name"), F.col("depth").alias("category_depth"))
    return first.join(named.dropDuplicates(["node_id"]).hint("merge"), "node_id")


def arrivals(candidates: DataFrame, details: DataFrame, as_of: Column, rules: ArrivalRules = RULES) -> DataFrame:
    """Accepted arrivals with age and signal flag.

    ``details`` has asin, listing_date, bsr_main_rank, review_count and whatever else is to be kept.
    """
    aged = candidates.join(details.hint("merge"), "asin").withColumn("listing_age_days", F.datediff(as_of, F.col("listing_date")))
    kept = aged.where(accepted(F.col("bsr_main_rank"), F.col("listing_age_days"), rules))
    signal = is_signal(F.col("bsr_main_rank"), F.col("listing_age_days"), F.col("review_count"), rules)
    return kept.withColumn("is_signal", signal.cast("int"))


def signal_summary(rows: DataFrame) -> DataFrame:
    """Arrivals and signals of each site."""
    return rows.groupBy("site").agg(F.count("*").alias("total"), F.count_if(F.col("is_signal") == 1).alias("signals"))


def top_signals(rows: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` signals with the best main rank, unranked ones first."""
    return rows.where("is_signal = 1").orderBy(F.asc_nulls_first("bsr_main_rank"), "asin").limit(n)


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, place, n) with the number of rows of each stage, in order."""
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), F.lit(i).alias("place"), "n")
        for i, (name, df) in enumerate(stages.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_funnel(
    found: DataFrame, nodes: DataFrame, details: DataFrame, as_of: Column, rules: ArrivalRules = RULES, known: DataFrame | None = None
) -> DataFrame:
    """(stage, place, n) of a whole run: nodes, found, unique, ok, filtered, error, signals, saved.

    ``found`` and ``nodes`` are those of ``candidates``, ``details`` those of
    ``arrivals``, once for an item; an item without details is an error. saved
    counts the accepted items that ``known`` (asin) does not hold.
    """
    rows = candidates(found, nodes).join(details.withColumn("__has", F.lit(True)).hint("merge"), "asin", "left")
    if known is not None:
        rows = rows.join(known.select("asin", F.lit(True).alias("__known")).distinct().hint("merge"), "asin", "left")
    else:
        rows = rows.withColumn("__known", F.lit(None).cast("boolean"))
    age = F.datediff(as_of, F.col("listing_date"))
    has = F.col("__has").isNotNull()
    ok = has & accepted(F.col("bsr_main_rank"), age, rules)
    counted = rows.agg(
        F.count("*").alias("unique"),
        F.count_if(ok).alias("ok"),
        F.count_if(has & ~ok).alias("filtered"),
        F.count_if(~has).alias("error"),
        F.count_if(ok & is_signal(F.col("bsr_main_rank"), age, F.col("review_count"), rules)).alias("signals"),
        F.count_if(ok & F.col("__known").isNull()).alias("saved"),
    )
    # one row each
    whole = counted.crossJoin(nodes.agg(F.count_distinct("node_id").alias("nodes"))).crossJoin(found.agg(F.count("*").alias("found")))
    stages = ["nodes", "found", "unique", "ok", "filtered", "error", "signals", "saved"]
    entries = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(i).alias("place"), F.col(n).alias("n")) for i, n in enumerate(stages)])
    return whole.select(F.inline(entries))
