"""Table schemas, list types and the per-site locale table.

All tables are DataFrames with an explicit StructType; ``conform`` brings a
frame of an older or narrower schema to the present one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
    "ranks": T.ArrayType(T.StructType().add("category", T.StringType()).add("rank", T.IntegerType())),
}


def _schema(columns: str) -> T.StructType:
    """A schema from 'name type, ...': unlike a parsed DDL text it needs no session, so workers can import it."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(", "))])


NODES = _schema(
    "node_id string, name string, url string, depth int, source string, explored int, created_at timestamp, "
    "parent_node_id string, true_depth int, nr_valid int, bs_valid int, ms_valid int, mw_valid int, na_valid int, "
    "breadcrumb_checked int, slug string, child_count long, site string, path strings"
)
SIGHTINGS = _schema(
    "asin string, name string, price double, price_raw string, original_price string, discount_pct string, "
    "rating double, review_count int, rank int, image_url string, product_url string, has_video int, "
    "is_amazon_choice int, node_id string, category_name string, category_slug string, category_depth int, "
    "list_type string, list_total int, site string, scraped_at timestamp, bsr_main_rank int, "
    "bsr_main_category string, bsr_sub_rank int, bsr_sub_category string, variant_option_count int, "
    "other_sellers_count int, item_weight string, item_dimensions string, date_first_available date, "
    "shipping_fee string, shipping_fee_value double, fulfillment_type string, country_of_origin string, "
    "is_bestseller int, detail_scraped int"
)
ARRIVALS = _schema(
    "asin string, title string, price string, price_value double, rating double, review_count int, "
    "listing_date date, listing_age_days int, bsr_main_category string, bsr_main_rank int, "
    "bsr_sub ranks, image_url string, product_url string, shipping_fee string, "
    "shipping_fee_value double, fulfillment_type string, node_id string, category_name string, category_depth int, "
    "site string, is_signal int, scraped_at timestamp"
)
WATCHLIST = _schema("asin string, name string, added_at timestamp, notes string")
TRACKING = _schema(
    "asin string, price double, rank int, rating double, review_count int, snapshot_date date"
)
LINK_CACHE = _schema(
    "node_id string, nr_valid int, bs_valid int, ms_valid int, mw_valid int, checked_at timestamp"
)
RUN_STATUS = _schema("id int, phase string, paused int, total int, queue int, updated_at timestamp")

#: Ranked lists: segment of the URL, flag column of the node, label (fixed values).
LIST_TYPES = (
    ("new-releases", "nr_valid", "New releases"),
    ("bestsellers", "bs_valid", "Bestsellers"),
    ("movers-and-shakers", "ms_valid", "Movers and shakers"),
    ("most-wished-for", "mw_valid", "Most wished for"),
    ("most-gifted", None, "Most gifted"),
)

#: Sites: currency, decimal separator, patterns of ratings and result counts (fixed values).
SITES = (
    ("US", "$", ".", r"([\d.]+)\s+out", r"of\s+([\d,]+)\s+results?"),
    ("DE", "€", ",", r"([\d,]+)\s+von", r"([\d.]+)\s+Ergebnisse"),
    ("JP", "¥", ".", r"5つ星のうち([\d.]+)", r"([\d,]+)\s*件中"),
    ("UK", "£", ".", r"([\d.]+)\s+out", r"of\s+([\d,]+)\s+results?"),
    ("FR", "€", ",", r"([\d,]+)\s+sur", r"([\d\s]+)\s+résultats?"),
)
SITE_COLUMNS = "site string, currency string, decimal_sep string, rating_pattern string, results_pattern string"


def sites(spark: SparkSession) -> DataFrame:
    """The locale table: a row for each site."""
    return spark.createDataFrame(list(SITES), SITE_COLUMNS)


def list_types(spark: SparkSession) -> DataFrame:
    """The ranked lists with flag column and label."""
    return spark.createDataFrame(list(LIST_TYPES), "list_type string, flag string, label string")


def with_locale(df: DataFrame) -> DataFrame:
    """``df`` with the locale of its site (letter case ignored); an unknown site has nulls and ``site_known`` false."""
    table = sites(df.sparkSession).withColumnRenamed("site", "__site")
    joined = df.join(F.broadcast(table), F.upper("site") == F.col("__site"), "left")  # five rows
    return joined.withColumn("site_known", F.col("__site").isNotNull()).drop("__site")


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` with the columns of ``schema`` in its order and types.

    Missing columns are added as null, nulls of the columns in ``defaults`` are
    filled, further columns are dropped.
    """
    have = {c.lower(): c for c in df.columns}
    columns = []
    for f in schema.fields:
        value = F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)
        value = value.try_cast(f.dataType) if isinstance(f.dataType, T.AtomicType) else value.cast(f.dataType)
        if defaults and f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*columns)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both frames under the union of their columns; what a frame lacks is null."""
    return old.unionByName(new, allowMissingColumns=True)
