"""Registered queries over captured pages and streams, and the browser's listings, with their DuckDB counterparts.

Pages are built in SQL from the driver's tables (``views``), so an oracle knows
the values that a page was made from and never reads HTML itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.functions import fields, urls
from shelflight.operators import arrivals, browse, extract, filters, quality, tracking, tree
from shelflight.plans import views
from shelflight.plans.catalogue import AS_OF, FLAGS, query
from shelflight.plans.views import WITH_DETAILS, WITH_NODES, WITH_SIGHTINGS
from shelflight.schema import with_locale
from shelflight.sources import tables
from shelflight.sources.keyed import KeyedTable
from shelflight.streaming import flow, health, jobs

DOMAIN = "https://shop.example"


def _pages(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Built pages; the small tables that they are made from lie in one partition and are dealt out to all cores before."""
    return views.view(spark, sf_dir, sql, 2 * spark.sparkContext.defaultParallelism)


# --- ranked lists ---------------------------------------------------------------

_D = f"{WITH_DETAILS}, d AS (SELECT *, CAST(asin AS BIGINT) AS k, regexp_extract(price_text, '[0-9,.]+') AS p FROM details)"
_PRICE = "CAST(CASE WHEN site IN ('DE', 'FR') THEN replace(replace(p, '.', ''), ',', '.') ELSE replace(p, ',', '') END AS DOUBLE)"
_RATING = """CAST(CASE site WHEN 'DE' THEN '4.2' WHEN 'US' THEN '4.2' WHEN 'JP' THEN '4.1' WHEN 'FR' THEN '3.9' ELSE concat(size % 5, '.5') END AS DOUBLE)"""
_BEST = "CAST(k % 4 = 0 AS INT)"
_CHOICE = "CAST(k % 4 = 1 AS INT)"


@query(f"""WITH {_D} SELECT k AS page_id, 0 AS idx, concat('B', lpad(asin, 9, '0')) AS asin, name,
 concat('{DOMAIN}/Thing/dp/B', lpad(asin, 9, '0'), '/ref=z') AS product_url, {_PRICE} AS price, {_RATING} AS rating,
 CAST(1100 + size AS INT) AS review_count, CAST(size AS INT) AS rank, {_BEST} AS is_bestseller, {_CHOICE} AS is_amazon_choice, concat('i', asin, '.png') AS image_url FROM d
UNION ALL SELECT k, 1, concat('C', lpad(asin, 9, '0')), brand, concat('{DOMAIN}/dp/C', lpad(asin, 9, '0')), NULL, NULL, NULL, NULL, 0, 0, NULL FROM d""")
def chart_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed sightings from ranked-list pages of two layouts in five locales."""
    cards = extract.chart_cards(_pages(spark, sf_dir, views.CHART_PAGES), ("page_id", "site"))
    rows = extract.chart_rows(with_locale(cards), F.lit(DOMAIN))
    return rows.select(
        "page_id", "idx", "asin", "name", "product_url", "price", "rating", "review_count", "rank",
        "is_bestseller", "is_amazon_choice", "image_url",
    )


@query(f"""WITH {_D} SELECT k AS page_id, CASE WHEN k % 2 = 0 THEN 1234 ELSE 3 END::INT AS list_total FROM d""")
def chart_page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a list by the site's result count, else by its cards."""
    pages = with_locale(_pages(spark, sf_dir, views.CHART_PAGES))
    return pages.select("page_id", fields.list_total(F.col("html"), F.col("results_pattern"), F.lit(3)).alias("list_total"))


@query(f"""WITH {_D} SELECT k AS page_id, name, {_RATING} AS rating, CASE k % 3 WHEN 0 THEN concat('+', size, '%') WHEN 1 THEN concat('+', size * 2, '%') END AS percent_change FROM d
UNION ALL SELECT k, brand, NULL, NULL FROM d UNION ALL SELECT k, NULL, NULL, NULL FROM d""")
def mover_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of mover pages with their percent change: by its class, else by its text."""
    cards = with_locale(extract.mover_cards(_pages(spark, sf_dir, views.CHART_PAGES), ("page_id", "site")))
    rating = fields.locale_rating(F.col("rating_text"), F.col("rating_pattern"))
    return cards.select("page_id", "name", rating.alias("rating"), "percent_change")


# --- search pages ---------------------------------------------------------------

_SEARCHED = "s AS (SELECT p_partkey AS k, p_size AS size, p_partkey % 11 NOT IN (1, 2, 3, 4) AS whole FROM part)"


@query(f"""WITH {_SEARCHED} SELECT k AS page_id, i AS idx, CASE i WHEN 0 THEN concat('B', lpad(CAST(k AS VARCHAR), 9, '0')) WHEN 1 THEN 'B999999999' ELSE 'B888888888' END AS asin,
 CASE i WHEN 0 THEN size WHEN 2 THEN 7 END::INT AS reviews, k % 3 = 0 AS has_next, concat(size, ' results') AS total_text
FROM s, (SELECT unnest([0, 1, 2])::INT AS i) WHERE whole AND i < size % 4 AND (i <> 0 OR size <= 40)""")
def search_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of search pages behind the coarse review gate."""
    rows = extract.search_cards(_pages(spark, sf_dir, views.SEARCH_PAGES), ("page_id",))
    rows = rows.withColumn("reviews", fields.count_number(F.col("review_text")))
    kept = rows.where(filters.search_card_gate(F.col("reviews"), 40))
    return kept.select("page_id", "idx", "asin", "reviews", "has_next", "total_text")


_STATUS = """CASE k % 11 WHEN 1 THEN 'error' WHEN 2 THEN 'captcha' WHEN 3 THEN 'no_results' WHEN 4 THEN 'empty'
  ELSE CASE WHEN size % 4 = 0 THEN 'empty' ELSE 'ok' END END"""


@query(f"""WITH {_SEARCHED} SELECT k AS page_id, {_STATUS} AS status, CASE WHEN whole THEN size % 4 ELSE 0 END::BIGINT AS count,
 whole AND size % 4 > 0 AND k % 3 = 0 AS has_next FROM s""")
def search_page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every captured search page, all five of them."""
    pages = _pages(spark, sf_dir, views.SEARCH_PAGES)
    return extract.search_status(pages, extract.search_cards(pages, ("page_id",)))


@query(f"""WITH {_SEARCHED}, c AS (SELECT {_STATUS} AS status, k % 7 + 1 AS depth FROM s)
SELECT depth, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status IN ('empty', 'no_results')) AS empty,
 count(*) FILTER (status = 'captcha') AS captcha, count(*) FILTER (status = 'error') AS error FROM c GROUP BY depth""")
def search_status_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.status_by_depth(search_page_status(spark, sf_dir).withColumn("depth", F.col("page_id") % 7 + 1))


@query(f"""WITH {_SEARCHED}, c AS (SELECT {_STATUS} AS status, size % 4 AS n, k % 3 = 0 AS has_next FROM s)
SELECT min(n)::BIGINT AS least, max(n)::BIGINT AS most, round(avg(n), 6) AS mean, round(count(*) FILTER (has_next) / count(*), 6) AS next_share FROM c WHERE status = 'ok'""")
def search_result_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.result_sizes(search_page_status(spark, sf_dir))
    return rows.withColumns({"mean": F.round("mean", 6), "next_share": F.round("next_share", 6)})


@query(f"""WITH {_SEARCHED}, c AS (SELECT k AS page_id, CASE WHEN k % 11 = 1 THEN NULL WHEN k % 11 = 4 THEN 'robot' WHEN NOT whole OR k % 5 = 0 THEN 'no_select'
 WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END AS capability FROM s)
SELECT page_id, capability, CASE capability WHEN 'yes' THEN 1 WHEN 'no' THEN 0 WHEN 'no_select' THEN 0 END AS flag FROM c""")
def sort_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search page offers the newest-first order, by its sort control."""
    pages = _pages(spark, sf_dir, views.SEARCH_PAGES)
    kind = F.when(F.col("html").isNotNull(), filters.sort_capability(F.col("html")))
    return pages.select("page_id", kind.alias("capability")).withColumn("flag", filters.capability_flag(F.col("capability")))


# --- detail pages ---------------------------------------------------------------

_MAIN = "CAST(CASE WHEN k % 2 = 0 THEN size * 37 ELSE CAST(concat(size % 9 + 1, size * 7 + 100) AS INT) END AS INT)"
_DAY = """CASE k % 4 WHEN 0 THEN try_cast(concat('2024-06-', lpad(CAST(size % 31 + 1 AS VARCHAR), 2, '0')) AS DATE)
 WHEN 1 THEN try_cast(concat('2024-03-', lpad(CAST(size % 31 + 1 AS VARCHAR), 2, '0')) AS DATE)
 WHEN 2 THEN try_cast(concat('2024-02-', lpad(CAST(size % 31 + 1 AS VARCHAR), 2, '0')) AS DATE) END"""
_FEE = "CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN size + 0.99 WHEN 2 THEN size + 0.49 END::DOUBLE"
_FEE_TEXT = "CASE k % 4 WHEN 0 THEN 'FREE' WHEN 1 THEN concat('für ', size, ',99 €') WHEN 2 THEN concat('$', size, '.49') END"


@query(f"""WITH {_D}, t AS (SELECT d.*, p_type AS type FROM d JOIN part ON k = p_partkey)
SELECT k AS page_id, name AS title, item_weight, item_dimensions, {_MAIN} AS bsr_main_rank, type AS bsr_main_category,
 CASE WHEN k % 2 = 0 THEN size END::INT AS bsr_sub_rank, CASE WHEN k % 2 = 0 THEN 'China' ELSE 'Germany' END AS country_of_origin, {_DAY} AS date_first_available,
 {_FEE} AS shipping_fee_value, {_FEE_TEXT} AS shipping_fee, CASE k % 3 WHEN 0 THEN 'FBA' WHEN 1 THEN 'FBM' END AS fulfillment_type,
 CASE WHEN size % 3 > 0 THEN size % 3 END::INT AS variant_option_count, CASE WHEN k % 3 < 2 THEN size % 5 + 1 END::INT AS other_sellers_count,
 {_BEST} AS is_bestseller, {_CHOICE} AS is_amazon_choice FROM t""")
def detail_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed enrichment fields from detail pages."""
    rows = extract.detail_fields(extract.detail_blocks(_pages(spark, sf_dir, views.DETAIL_PAGES), ("page_id",), extract.FIELD_BLOCKS))
    return rows.select(
        "page_id", "title", "item_weight", "item_dimensions", "bsr_main_rank", "bsr_main_category", "bsr_sub_rank",
        "country_of_origin", "date_first_available", "shipping_fee_value", "shipping_fee", "fulfillment_type",
        "variant_option_count", "other_sellers_count", "is_bestseller", "is_amazon_choice",
    )


@query(f"""WITH {_D} SELECT k AS page_id FROM d WHERE {_MAIN} BETWEEN 50 AND 90000 AND size BETWEEN 2 AND 30 AND k % 2 = 0
 AND size % 3 >= 1 AND k % 3 < 2 AND size % 5 + 1 <= 4 AND {_BEST} = 1""")
def detail_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on ranks, variants, sellers and badges as read from detail pages."""
    rows = extract.detail_fields(extract.detail_blocks(_pages(spark, sf_dir, views.DETAIL_PAGES), ("page_id",), extract.FIELD_BLOCKS))
    bounds = filters.DetailFilter(
        bsr_main_min=50, bsr_main_max=90000, bsr_sub_min=2, bsr_sub_max=30, variant_min=1, sellers_max=4, bestseller=True
    )
    return rows.where(bounds.column()).select("page_id")


@query(f"""WITH {_D}, t AS (SELECT d.*, p_type AS type FROM d JOIN part ON k = p_partkey)
SELECT k AS page_id, price_text AS price, {_PRICE} AS price_value, CAST(replace(regexp_extract(review_text, '[0-9,]+'), ',', '') AS INT) AS review_count,
 CASE site WHEN 'JP' THEN 5 ELSE {_RATING} END::DOUBLE AS rating, {_DAY} AS listing_date, {_MAIN} AS bsr_main_rank, type AS bsr_main_category,
 CASE WHEN k % 2 = 0 THEN size END::INT AS second_rank FROM t""")
def arrival_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of an arrival from detail pages."""
    blocks = with_locale(extract.detail_blocks(_pages(spark, sf_dir, views.DETAIL_PAGES), ("page_id", "site"), extract.ARRIVAL_BLOCKS))
    rows = extract.arrival_fields(blocks, F.col("decimal_sep"))
    return rows.select(
        "page_id", "price", "price_value", "review_count", "rating", "listing_date", "bsr_main_rank", "bsr_main_category",
        F.get("bsr_sub", F.lit(0))["rank"].alias("second_rank"),
    )


_FOUND = """[('has_fbt', k % 5 = 0), ('has_comparison_table', k % 7 = 0), ('return_policy', k % 3 = 0), ('variant_option_count', size % 3 > 0),
 ('json_ld_count', k % 2 = 0), ('energy_efficiency', false), ('bullet_count', size % 4 > 0), ('has_description', size % 6 >= 5),
 ('merchant_info', merchant_text IS NOT NULL), ('delivery_message', delivery_text IS NOT NULL), ('bestseller_badge', k % 4 = 0), ('asin', true)]"""


def _found_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        "marketing.has_fbt", "marketing.has_comparison_table", "returns.return_policy", "variants.variant_option_count",
        "hidden.json_ld_count", "safety.energy_efficiency", "description.bullet_count", "description.has_description",
        "delivery.merchant_info", "delivery.delivery_message", "ratings.bestseller_badge", "core.asin",
    )
    return extract.inventory_part(_pages(spark, sf_dir, views.DETAIL_PAGES), names)


@query(f"""WITH {_D}, u AS (SELECT k, unnest({_FOUND}) AS e FROM d)
SELECT e[1] AS field, count(*) FILTER (e[2]) AS n_docs, count(*) AS of_docs, count(*) FILTER (e[2]) >= 2 AS promoted FROM u GROUP BY 1""")
def inventory_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many detail pages fields of the inventory have a value."""
    found = quality.coverage(quality.field_presence(_found_fields(spark, sf_dir), "page_id"))
    return found.select("field", "n_docs", "of_docs", "promoted")


#: All fields of the inventory that detail pages of ``views`` can have, and on which they have a value; the others are on none.
_HELD = f"""[('brand_url', true), ('has_brand_store', k % 2 = 0), ('asin', true), ('price', true), ('rating', true), ('bsr_raw', true),
 ('is_amazons_choice', k % 4 = 1), ('breadcrumbs', true), ('bullet_count', size % 4 > 0), ('bullets_sample', size % 4 > 0), ('has_description', size % 6 >= 5),
 ('attributes', true), ('variant_dimensions', true), ('variant_option_count', size % 3 > 0), ('shipping_fee', k % 4 < 3), ('fulfillment_type', k % 3 < 2),
 ('date_first_available', {_DAY} IS NOT NULL), ('json_ld_count', k % 2 = 0), ('bsr_main_rank', true), ('bsr_main_category', true),
 ('bsr_sub_rank', k % 2 = 0), ('bsr_sub_category', k % 2 = 0), ('item_weight', true), ('item_dimensions', item_dimensions IS NOT NULL),
 ('country_of_origin', true), ('json_ld_type', k % 2 = 0), ('title', true), ('brand_text', true), ('review_count', true), ('bestseller_badge', k % 4 = 0),
 ('delivery_message', delivery_text IS NOT NULL), ('merchant_info', merchant_text IS NOT NULL), ('return_policy', k % 3 = 0), ('has_fbt', k % 5 = 0),
 ('has_comparison_table', k % 7 = 0), ('other_sellers_text', k % 3 < 2)]"""


@query(f"""WITH {_D}, u AS (SELECT k, unnest({_HELD}) AS e FROM d)
SELECT e[1] AS field, k AS page_id FROM u WHERE e[2]""")
def inventory_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page that has a field, for all fields of the inventory."""
    names = (*extract.READ_FROM, *[f"{g}.{f}" for g, own in extract.GROUPS.items() for f in own])
    return quality.field_samples(extract.inventory_part(_pages(spark, sf_dir, views.DETAIL_PAGES), names), "page_id")


@query(f"""WITH {_D}, u AS (SELECT CASE WHEN k % 2 = 0 THEN 'marketing' ELSE 'core' END AS field_group, unnest({_FOUND}) AS e FROM d)
SELECT CASE WHEN e[1] IN ('has_fbt', 'has_comparison_table') THEN 'marketing' ELSE 'other' END AS field_group, count(DISTINCT e[1]) FILTER (e[2]) AS fields FROM u GROUP BY 1""")
def inventory_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with a value in each group."""
    rows = _found_fields(spark, sf_dir)
    groups = {c: "marketing" if c in ("has_fbt", "has_comparison_table") else "other" for c in rows.columns}
    return quality.fields_per_group(quality.field_presence(rows, "page_id", groups))


@query(f"""WITH {_D}, t AS (SELECT d.*, p_type AS type FROM d JOIN part ON k = p_partkey)
SELECT k AS page_id, name AS title, concat('Visit ', brand) AS brand_raw, k % 2 = 0 AS has_brand_store, price_text AS price, concat('B', lpad(asin, 9, '0')) AS asin,
 3 AS n_breadcrumbs, (size % 4)::INT AS bullet_point_count, {_MAIN} AS first_rank, CASE WHEN k % 2 = 0 THEN item_weight END AS weight,
 item_dimensions AS dimensions, brand AS manufacturer, 'Size' AS variant_types, (size % 3)::INT AS variant_option_count,
 CASE WHEN size % 6 > 0 THEN (size % 6) * 5 - 1 END::INT AS description_len, k % 5 = 0 AS has_fbt, k % 3 = 0 AS has_return_policy, k % 7 = 0 AS has_comparison_table,
 CASE WHEN k % 3 < 2 THEN concat(size % 5 + 1, ' new from here') END AS new_used_offers FROM t""")
def flat_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat first look at detail pages."""
    rows = extract.flat_probe(extract.detail_blocks(_pages(spark, sf_dir, views.DETAIL_PAGES), ("page_id",), extract.PROBE_BLOCKS))
    return rows.select(
        "page_id", "title", "brand_raw", "has_brand_store", "price", "asin", F.size("breadcrumbs").alias("n_breadcrumbs"),
        "bullet_point_count", F.get("bsr", F.lit(0))["rank"].alias("first_rank"), "weight", "dimensions", "manufacturer",
        F.array_join("variant_types", ",").alias("variant_types"), "variant_option_count", "description_len", "has_fbt",
        "has_return_policy", "has_comparison_table", "new_used_offers",
    )


@query(f"""WITH {_D} SELECT k AS page_id, 0 AS pos, name, CAST(k + 100 AS VARCHAR) AS node_id FROM d
UNION ALL SELECT k, 1, brand, CAST(size + 7 AS VARCHAR) FROM d""")
def breadcrumb_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadcrumbs of detail pages in order."""
    return extract.breadcrumb_rows(_pages(spark, sf_dir, views.DETAIL_PAGES))


# --- tree pages -----------------------------------------------------------------

_P = "(SELECT unnest([0, 1, 2, 3, 4]) AS p)"


@query(f"""SELECT c_custkey * 5 + p AS page_id, 0 AS pos, 'First' AS name, concat('{DOMAIN}/gp/bestsellers/s-1/', c_custkey + 2000, '/') AS child_url,
 CAST(c_custkey + 2000 AS VARCHAR) AS node_id, 's-1' AS slug FROM customer, {_P}
UNION ALL SELECT c_custkey * 5 + p, 3, 'Books', concat('{DOMAIN}/zgbs/books/', (c_custkey * 3 + p) % 700 + 5000, '/'), CAST((c_custkey * 3 + p) % 700 + 5000 AS VARCHAR), 'books' FROM customer, {_P}
UNION ALL SELECT c_custkey * 5 + p, 4, 'Elsewhere', 'https://other.example/page/', NULL, '' FROM customer, {_P}""")
def sidebar_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child categories in the side bars of ranked-list pages."""
    rows = extract.sidebar_children(_pages(spark, sf_dir, views.TREE_PAGES), F.lit(DOMAIN), ("page_id",))
    return rows.select("page_id", "pos", "name", "child_url", "node_id", "slug")


@query(f"""WITH c AS (SELECT c_custkey AS node, CAST(c_custkey + 2000 AS VARCHAR) AS node_id, 0 AS page_no, 0 AS pos, 'First' AS name FROM customer
 UNION ALL SELECT c_custkey, CAST((c_custkey * 3 + p) % 700 + 5000 AS VARCHAR), p::INT, 3, 'Books' FROM customer, {_P})
SELECT node, node_id, page_no, name FROM (SELECT *, row_number() OVER (PARTITION BY node, node_id ORDER BY page_no, pos) AS n FROM c) WHERE n = 1""")
def chart_page_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of a node over its five chart pages, each id once."""
    rows = extract.chart_children(_pages(spark, sf_dir, views.TREE_PAGES), F.lit(DOMAIN))
    return rows.select("node", "node_id", "page_no", "name")


@query("""SELECT 's-1' AS slug, false AS skipped UNION ALL SELECT 'books', true""")
def root_page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of the category links of root pages, with those to skip."""
    return extract.root_slugs(_pages(spark, sf_dir, views.TREE_PAGES))


@query(f"""SELECT c_custkey * 5 + p AS page_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name FROM customer, {_P}""")
def root_page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of root pages: the selected entry, else what the heading says."""
    return extract.root_name(_pages(spark, sf_dir, views.TREE_PAGES))


@query(f"""WITH {_D}, c AS (SELECT asin, k, size, concat(' a  b ', asin) AS t FROM d)
SELECT asin, concat('a b ', asin) AS clean, concat('{DOMAIN}/s?rh=n%3A', asin, '&s=date-desc-rank', CASE WHEN size % 3 > 1 THEN concat('&page=', size % 3) ELSE '' END) AS search,
 concat('{DOMAIN}/gp/new-releases/s-', size, '/', asin, '/?pg=', size % 3) AS chart, CAST(size AS VARCHAR) AS query_id, concat('B', lpad(asin, 9, '0')) AS item,
 CAST(size AS VARCHAR) AS residual_size, CASE WHEN size % 2 = 0 THEN 'US shop' END AS label, CASE WHEN k % 2 = 0 THEN asin END AS key FROM c""")
def scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts, URLs made and read, attributes left over, labels and keys."""
    rows = views.details(spark, sf_dir)
    size, asin = F.col("size").cast("string"), F.col("asin")
    left = fields.residual(F.create_map(F.lit("Size"), size, F.lit("Brand"), F.lit("x")), ["Brand"])
    return rows.select(
        "asin",
        fields.clean_text(F.concat(F.lit(" a  b "), asin)).alias("clean"),
        urls.search_url(F.lit(DOMAIN), asin, F.col("size") % 3).alias("search"),
        urls.chart_url(F.lit(DOMAIN), F.lit("new-releases"), F.concat(F.lit("s-"), size), asin, F.col("size") % 3).alias("chart"),
        urls.query_node_id(F.concat(F.lit("/b?x=1&node="), size)).alias("query_id"),
        urls.item_id(F.concat(F.lit("/x/dp/B"), F.lpad(asin, 9, "0"), F.lit("/ref"))).alias("item"),
        F.get_json_object(left, "$.Size").alias("residual_size"),
        fields.label_of((F.col("size") % 2).cast("string"), {"0": "US shop"}).alias("label"),
        fields.item_key(F.when(asin.cast("long") % 2 == 0, F.concat(F.lit(" "), asin)).otherwise(F.lit("  "))).alias("key"),
    )


@query(f"""WITH {_D} SELECT asin, CASE WHEN k % 3 = 0 OR size % 4 = 0 THEN 'FBA' WHEN k % 3 = 1 OR size % 4 = 1 THEN 'FBM' END AS fulfilment,
 k % 2 = 0 AS long_text FROM d""")
def extended_fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fulfilment by either of two blocks, and whether a block has more than a few characters."""
    kind = F.col("size") % 4
    offer = F.when(kind == 0, "Ships from Amazon, Fulfilled by Amazon").when(kind == 1, "Ships from a shop")
    return views.details(spark, sf_dir).select(
        "asin",
        fields.fulfilment_extended(F.col("merchant_text"), offer).alias("fulfilment"),
        fields.present(F.when(F.col("asin").cast("long") % 2 == 0, F.lit("x" * 21)).otherwise(F.lit("x" * 20)), 20).alias("long_text"),
    )


@query(f"""WITH {WITH_SIGHTINGS} SELECT asin, list_type, l_orderkey, l_linenumber, review_count <= 50 AND l_suppkey * 97 <= 5000 AS final FROM (
 SELECT * REPLACE (price / 1000 AS price) FROM sightings) WHERE price BETWEEN 15 AND 60 AND review_count <= 100""")
def screened_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings behind the coarse screening, and which of them the final one keeps."""
    rows = views.sightings(spark, sf_dir).withColumn("price", F.col("price") / 1000).withColumn("competition", F.col("l_suppkey") * 97)
    kept = rows.where(filters.screened(F.col("competition"), final=False))
    final = filters.screened(F.col("competition"))
    return kept.select("asin", "list_type", "l_orderkey", "l_linenumber", final.alias("final"))


@query(f"""WITH {WITH_SIGHTINGS}, {_D}, y AS (SELECT k, size % 20 AS reviews, {_MAIN} AS main_rank, date_diff('day', {_DAY}, DATE '2024-07-01') AS age, k % 7 <> 0 AS has
 FROM d WHERE asin IN (SELECT asin FROM sightings)), z AS (SELECT *, has AND coalesce(age <= 30, true) AND main_rank <= 200000 AS ok FROM y),
 n AS (SELECT count(*) AS "unique", count(*) FILTER (ok) AS ok, count(*) FILTER (has AND NOT ok) AS filtered, count(*) FILTER (NOT has) AS error,
 count(*) FILTER (ok AND coalesce(age <= 25, false) AND reviews < 10 AND main_rank <= 50000) AS signals, count(*) FILTER (ok AND k % 2 = 1) AS saved FROM z)
SELECT 'nodes' AS stage, 0 AS place, (SELECT count(DISTINCT p_brand) FROM part) AS n UNION ALL SELECT 'found', 1, (SELECT count(*) FROM sightings)
UNION ALL SELECT 'unique', 2, "unique" FROM n UNION ALL SELECT 'ok', 3, ok FROM n UNION ALL SELECT 'filtered', 4, filtered FROM n
UNION ALL SELECT 'error', 5, error FROM n UNION ALL SELECT 'signals', 6, signals FROM n UNION ALL SELECT 'saved', 7, saved FROM n""")
def run_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of a run over new arrivals, from nodes to saved rows."""
    found = views.sightings(spark, sf_dir).select("asin", "node_id", F.col("l_linenumber").alias("page_no"), F.col("l_orderkey").alias("idx"))
    nodes = views.view(spark, sf_dir, "SELECT DISTINCT p_brand AS node_id, p_brand AS name, 1 AS depth FROM {part}")
    main, _, _ = fields.split_ranks(fields.sales_ranks(F.col("ranks_text")))
    details = views.details(spark, sf_dir).select(
        "asin", fields.month_date(F.col("date_text")).alias("listing_date"), main["rank"].alias("bsr_main_rank"),
        (F.col("size") % 20).alias("review_count"),
    )
    number = F.col("asin").cast("long")
    known = details.where(number % 2 == 0).select("asin")
    return arrivals.run_funnel(found, nodes, details.where(number % 7 != 0), F.lit(AS_OF), arrivals.ArrivalRules(signal_age_days=25), known)


# --- the browser's listings -----------------------------------------------------

_UP = """up AS (
  SELECT node_id AS start, node_id, nullif(parent_node_id, '') AS parent FROM nodes
  UNION ALL SELECT up.start, n.node_id, nullif(n.parent_node_id, '') FROM up JOIN nodes n ON n.node_id = up.parent),
b AS (SELECT node_id, count(*) - 1 AS below FROM up GROUP BY node_id)"""


@query(f"""WITH {WITH_NODES} SELECT name, node_id, 0 AS depth, CAST(NULL AS VARCHAR) AS slug, CAST(NULL AS INT) AS na_valid,
 (SELECT count(*) FROM nodes WHERE site = 'ASIA') AS child_count FROM nodes WHERE depth = 0 AND site = 'ASIA'
UNION ALL SELECT 'All Categories', '_root_', 0, NULL, NULL, count(*) FROM nodes WHERE site = 'EUROPE' AND depth > 0""")
def browse_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of a site, and of one that has none, with the site's nodes as their children."""
    nodes = views.nodes(spark, sf_dir)
    rootless = nodes.where("depth > 0 or site <> 'EUROPE'")
    return browse.tree_children(nodes, "root", "ASIA").unionByName(browse.tree_children(rootless, "root", "EUROPE"))


@query(f"""WITH RECURSIVE {WITH_NODES}, {_UP} SELECT name, node_id, depth, slug, na_valid, below AS child_count FROM nodes JOIN b USING (node_id)
WHERE parent_node_id = 'R2' AND site = (SELECT site FROM nodes WHERE node_id = 'R2') AND contains(name, '2')""")
def browse_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of a node whose names hold a text, with the number of their descendants."""
    nodes = views.nodes(spark, sf_dir)
    site = nodes.where("node_id = 'R2'").first().site
    found = browse.tree_children(nodes, "R2", site, text="2", limit=200)
    return found.where(F.col("name").contains("2"))


@query(f"""WITH {WITH_NODES} SELECT name, node_id, depth, slug, na_valid, 0::BIGINT AS child_count FROM nodes WHERE site = 'ASIA' AND na_valid = 1 AND contains(name, '1')
ORDER BY depth, name, node_id LIMIT 100 OFFSET 5""")
def browse_capable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat list of capable nodes of a site whose names hold a text."""
    return browse.capable(views.nodes(spark, sf_dir), "ASIA", "1", limit=100, offset=5)


_COUNTED = """c AS (SELECT parent_node_id AS p, count(*) AS n FROM nodes WHERE coalesce(trim(parent_node_id), '') <> '' GROUP BY 1),
stored AS (SELECT nodes.*, coalesce(n, 0) AS child_count FROM nodes LEFT JOIN c ON node_id = p)"""


@query(f"""WITH {WITH_NODES}, {_COUNTED} SELECT name, node_id, depth, slug, child_count FROM stored WHERE depth = 0
UNION ALL SELECT name, node_id, depth, slug, child_count FROM stored WHERE parent_node_id = 'N3' AND contains(lower(name), 'customer')""")
def browse_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of all sites, and children of a node by name, with stored child counts."""
    nodes = tree.child_counts(views.nodes(spark, sf_dir))
    return browse.stored_children(nodes, "root").unionByName(browse.stored_children(nodes, "N3", text="customer"))


_TOPS = "CASE WHEN depth = 1 AND CAST(substr(node_id, 2) AS BIGINT) % 2 = 1 THEN NULL ELSE node_id END AS node_id"


@query(f"""WITH {WITH_NODES}, {_COUNTED}, t AS (SELECT * REPLACE ({_TOPS}) FROM stored)
SELECT name, url, node_id, depth, source, explored, regexp_extract(url, '/gp/new-releases/([a-z][a-z0-9-]+)', 1) AS slug,
 coalesce((SELECT sum(child_count) + count(*) FROM t s WHERE s.node_id IS NOT NULL AND s.slug = regexp_extract(t.url, '/gp/new-releases/([a-z][a-z0-9-]+)', 1)), 0)::BIGINT AS child_count
FROM t WHERE depth = 1 AND node_id IS NULL AND contains(lower(name), 'nation')""")
def browse_listed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top entries without an id with all that lies below their slug."""
    nodes = tree.child_counts(views.nodes(spark, sf_dir))
    odd = (F.col("depth") == 1) & (F.substring("node_id", 2, 20).cast("long") % 2 == 1)
    return browse.listed_roots(nodes.withColumn("node_id", F.when(~odd, F.col("node_id"))), "nation")


_CACHE = "SELECT node_id, 1 AS nr_valid, 0 AS bs_valid, CAST(NULL AS INT) AS ms_valid, 1 AS mw_valid FROM {nodes} WHERE explored = 0"
_FLAGGED = ", ".join(f"coalesce(s.{f}, k.{f}) AS {f}" for f in FLAGS)


@query(f"""WITH {WITH_NODES}, {_COUNTED}, k AS ({_CACHE.replace('{nodes}', 'nodes')}), r AS (
SELECT s.name, s.url, s.node_id, s.depth, s.source, s.explored, {_FLAGGED}, s.child_count, s.parent_node_id, s.slug FROM stored s LEFT JOIN k USING (node_id))
SELECT name, url, node_id, depth, source, explored, nr_valid, bs_valid, ms_valid, mw_valid, child_count FROM r WHERE depth <= 1
UNION ALL SELECT name, url, node_id, depth, source, explored, nr_valid, bs_valid, ms_valid, mw_valid, child_count FROM r
 WHERE parent_node_id = 's-2' OR (coalesce(parent_node_id, '') = '' AND contains(url, '/gp/new-releases/s-2/'))""")
def browse_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed nodes with flags from the cache: two depths, and those that a slug finds by URL."""
    nodes = tree.child_counts(views.nodes(spark, sf_dir))
    cache = spark.sql(_CACHE, nodes=nodes)
    parts = [browse.listed(nodes, cache, FLAGS, depth=d) for d in (0, 1)] + [browse.listed(nodes, cache, FLAGS, parent="s-2")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {WITH_NODES} SELECT n.site, r.node_id, count(*) AS child_count FROM nodes n JOIN nodes r ON r.site = n.site AND r.depth = 0 GROUP BY 1, 2""")
def site_root_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of all sites with the number of their site's nodes."""
    return tree.site_totals(views.nodes(spark, sf_dir)).select("site", "node_id", "child_count")


@query(f"""WITH RECURSIVE {WITH_NODES}, down AS (
  SELECT node_id, depth FROM nodes WHERE node_id IN ('R1', 'N3') UNION ALL SELECT n.node_id, n.depth FROM nodes n JOIN down ON n.parent_node_id = down.node_id)
SELECT DISTINCT node_id, depth FROM down WHERE depth IN (1, 3)""")
def expanded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtrees of two roots, then the wanted depths."""
    nodes = views.nodes(spark, sf_dir)
    return tree.expanded(nodes, nodes.where(F.col("node_id").isin("R1", "N3")), [1, 3]).select("node_id", "depth")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS asin, c_name AS name FROM customer ORDER BY c_acctbal DESC, asin LIMIT 50""")
def watchlist_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watchlist in order of addition, the latest first: its first rows."""
    rows = views.view(spark, sf_dir, "SELECT CAST(c_custkey AS STRING) AS asin, c_name AS name, c_acctbal AS added_at FROM {customer}")
    return tracking.watched(rows).select("asin", "name").limit(50)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS asin, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS notes FROM customer""")
def partial_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert of one column; the others stay."""
    old = views.view(spark, sf_dir, "SELECT CAST(c_custkey AS STRING) AS asin, c_name AS name, c_mktsegment AS notes FROM {customer}")
    new = views.view(spark, sf_dir, "SELECT CAST(c_custkey AS STRING) AS asin, 'new' AS notes FROM {customer} WHERE c_custkey % 2 = 0")
    return tables.upsert(old, new, ["asin"], ["notes"], ["notes"])


@query("""SELECT CAST(o_custkey AS VARCHAR) AS asin, o_orderpriority AS node_id, '[{"category":"c","rank":1}]' AS bsr_sub FROM (
 SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 3 > 0) o
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderkey % 3 = 0 AND t.o_custkey = o.o_custkey AND t.o_orderpriority = o.o_orderpriority)""")
def nested_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals inserted where their key is new, nested columns as JSON."""
    sql = """SELECT CAST(o_custkey AS STRING) AS asin, o_orderpriority AS node_id, o_orderkey,
             array(named_struct('category', 'c', 'rank', 1)) AS bsr_sub FROM {orders}"""
    rows = tables.nested_as_json(views.view(spark, sf_dir, sql), ["bsr_sub"])
    target, batch = rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 3 > 0")
    return tables.insert_or_ignore(target, batch, ["asin", "node_id"], ["o_orderkey"]).drop("o_orderkey")


# --- streaming ------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark: SparkSession, sf_dir: str, parts: int = 6) -> DataFrame:
    """The events as files in order of time, a file each batch."""
    events, where = _events(spark, sf_dir), tables.shared_dir(spark, "events")
    jobs.replay(jobs.by_time(events, "ts", parts), where)
    return jobs.stream_of(spark, where, events.schema, files_per_batch=1)


def _drained(df: DataFrame, mode: str = "append") -> DataFrame:
    where = tables.shared_dir(df.sparkSession, "stream")
    return jobs.drain(df, where, f"{where}-checkpoint", mode)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user and kind of event once over the whole run, from a stream that comes twice."""
    events = _stream(spark, sf_dir)
    twice = events.unionByName(_stream(spark, sf_dir, parts=4))
    return _drained(jobs.first_of_run(twice, ["user_id", "event_type"]).select("user_id", "event_type"))


@query(f"""WITH {_D} SELECT k AS page_id, 0 AS pos, concat('B', lpad(asin, 9, '0')) AS asin FROM d
UNION ALL SELECT k, 1, concat('C', lpad(asin, 9, '0')) FROM d""")
def stream_page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ranked-list pages as they arrive."""
    where = tables.shared_dir(spark, "pages")
    _pages(spark, sf_dir, views.CHART_PAGES).select("page_id", "html").write.parquet(where)
    arriving = jobs.stream_of(spark, where, spark.read.parquet(where).schema)
    return _drained(jobs.item_stream(arriving))


_MARK = "(SELECT date_trunc('milliseconds', max(ts)) FROM events)"


@query(f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1
HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= {_MARK} - INTERVAL 10 MINUTE""")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and failures of each hour that the watermark has passed."""
    return _drained(jobs.counters(_stream(spark, sf_dir), "ts", "1 hour", "10 minutes", F.col("event_type") != "error"))


@query(f"""SELECT CAST(ts AS DATE) AS snapshot_date, user_id, max_by(event_id, ts) AS event_id, max(ts) AS seen_at FROM events GROUP BY 1, 2
HAVING CAST(min(ts) AS DATE) + INTERVAL 1 DAY <= {_MARK} - INTERVAL 1 HOUR""")
def stream_daily_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and day that the watermark has passed."""
    return _drained(jobs.daily_latest(_stream(spark, sf_dir), "user_id", "ts", "event_id", "1 hour"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok FROM events),
r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
s AS (SELECT user_id, event_id, sum(1 - CAST(ok AS INT)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM r)
SELECT CAST(user_id AS VARCHAR) AS key, event_id, CAST(streak AS INT) AS streak, streak >= 2 AS tripped FROM s""")
def stream_failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each source since its last success, kept as state over batches."""
    events = _stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("key"), "event_id", "ts", (F.col("event_type") != "error").alias("ok")
    )
    return _drained(jobs.failure_streaks(events, threshold=2, idle="3650 days")).select("key", "event_id", "streak", "tripped")


@query("""SELECT CAST(user_id AS VARCHAR) AS node_id, sum(CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 ELSE 1 END)::BIGINT AS child_count
FROM events GROUP BY 1""")
def stream_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child counts kept up to date by insertions and deletions, over two runs of three batches each."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") != "view", "insert")
    parts, where = jobs.by_time(_events(spark, sf_dir), "ts", 6), tables.shared_dir(spark, "counts")
    for run in (parts[:3], parts[3:]):  # the second run goes on where the first one stopped
        jobs.replay(run, f"{where}-events")
        events = jobs.stream_of(spark, f"{where}-events", parts[0].schema, files_per_batch=1)
        changes = events.select(F.col("user_id").cast("string").alias("parent_node_id"), op.alias("op"))
        jobs.flush(changes, jobs.keep_counts(where), f"{where}-checkpoint").awaitTermination()
    return jobs.kept_counts(spark, where)


@query(f"""WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events)
SELECT user_id, ts AS last_at FROM e WHERE (following IS NULL OR following > ts + INTERVAL 1 HOUR) AND ts + INTERVAL 1 HOUR <= {_MARK} - INTERVAL 10 SECOND""")
def stream_quiet_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each time that a user had no event for an hour, once the watermark shows it."""
    return _drained(jobs.went_quiet(_stream(spark, sf_dir), "user_id", "ts", "1 hour")).select("user_id", "last_at")


@query("""SELECT user_id AS key, max(ts) AS last_at, (SELECT max(ts) FROM events) - max(ts) >= INTERVAL 6 HOUR AS stale FROM events GROUP BY user_id""")
def stale_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by whether their last event is over six hours older than the last of all."""
    log = views.fetch_log(spark, sf_dir)
    last = log.agg(F.max("ts").alias("as_of"))  # one row
    stale = jobs.stale_keys(log.crossJoin(F.broadcast(last)), "user_id", "ts", F.lit(last.first().as_of), 6 * 3600)
    return stale.withColumnRenamed("user_id", "key").select("key", "last_at", "stale")


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0""")
def stream_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after a stream of inserts whose known keys are ignored; each batch reads only the folders that may hold its keys."""
    columns = ["event_id", "user_id", "event_type"]
    log = _events(spark, sf_dir).select(*columns)
    target = KeyedTable(tables.shared_dir(spark, "target"), log.schema, ("event_id",), buckets=8, expected_keys=1 << 20)
    target.insert(log.where("event_id % 2 = 0"), -1, ["event_type"])
    arriving = _stream(spark, sf_dir).where("event_id % 3 = 0").select(*columns)
    jobs.flush(arriving, target.writer(["event_type"]), f"{target.path}-checkpoint").awaitTermination()
    return target.read(spark)


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, date_trunc('milliseconds', ts) AS ts, event_type <> 'error' AS ok FROM events),
g AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, FALSE) AS broke, lead(ts) OVER w AS following FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
r AS (SELECT *, sum(CAST(ok OR broke AS INT)) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT *, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY key, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS streak FROM r)
SELECT key, 'event' AS kind, event_id, ts, streak, streak >= 2 AS tripped FROM s WHERE ts <= {_MARK} - INTERVAL 10 MINUTE
UNION ALL SELECT key, 'quiet', NULL, ts, streak, FALSE FROM s WHERE (following IS NULL OR following > ts + INTERVAL 6 HOUR) AND ts + INTERVAL 6 HOUR <= {_MARK} - INTERVAL 10 MINUTE""")
def stream_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks of failures and quiet times of each source from one stateful processor, over two runs of three batches each."""
    parts, where = jobs.by_time(_events(spark, sf_dir), "ts", 6), tables.shared_dir(spark, "health")
    out = None
    with health.rocks_state(spark):
        for run in (parts[:3], parts[3:]):
            jobs.replay(run, f"{where}-events")
            events = jobs.stream_of(spark, f"{where}-events", parts[0].schema, files_per_batch=1)
            ok = (F.col("event_type") != "error").alias("ok")
            keyed = events.select(F.col("user_id").cast("string").alias("key"), "event_id", "ts", ok)
            out = jobs.drain(health.source_health(keyed, 2, "6 hours", "10 minutes"), where, f"{where}-checkpoint")
    return out


_FLOW_START = "TIMESTAMP '2024-01-01 00:00:00'"
_FLOW = f"""SELECT p_partkey AS k, p_size, CAST({_FLOW_START} AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, CAST(p_partkey AS INT)) AS found_at FROM {{part}}"""


@query(f"""WITH {_D}, i AS (SELECT k, size, asin, {_FLOW_START} + to_minutes(k) AS found_at FROM d),
items AS (SELECT k AS page_id, 0 AS pos, concat('B', lpad(asin, 9, '0')) AS asin, found_at FROM i UNION ALL SELECT k, 1, concat('C', lpad(asin, 9, '0')), found_at FROM i),
arriving AS (SELECT concat('B', lpad(asin, 9, '0')) AS asin, k AS detail_id, found_at + to_minutes(CAST(size * 2 - 5 AS INT)) + INTERVAL 30 SECOND AS arrived_at FROM i WHERE size % 4 > 0),
mark AS (SELECT least((SELECT max(found_at) FROM items), (SELECT max(arrived_at) FROM arriving)) - INTERVAL 10 MINUTE AS at)
SELECT page_id, pos, i.asin, found_at, detail_id, arrived_at FROM items i LEFT JOIN arriving t ON t.asin = i.asin AND arrived_at BETWEEN found_at AND found_at + INTERVAL 1 HOUR, mark
WHERE detail_id IS NOT NULL OR found_at + INTERVAL 1 HOUR < mark.at""")
def stream_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of list pages with their detail pages, while both arrive in five files; some details come too late or never."""
    times = views.view(spark, sf_dir, _FLOW)
    lists = _pages(spark, sf_dir, views.CHART_PAGES).join(times, F.col("page_id") == F.col("k")).select("page_id", "html", "found_at")
    late = F.expr("make_interval(0, 0, 0, 0, 0, cast(p_size * 2 - 5 as int), 30)")
    details = _pages(spark, sf_dir, views.DETAIL_PAGES).join(times.where("p_size % 4 > 0"), F.col("page_id") == F.col("k"))
    details = details.select("page_id", "url", (F.col("found_at") + late).alias("arrived_at"))
    streams = []
    for name, frame, ts in (("lists", lists, "found_at"), ("details", details, "arrived_at")):
        where = tables.shared_dir(spark, name)
        jobs.replay(jobs.by_time(tables.materialise(frame, name), ts, 5), where)
        streams.append(jobs.stream_of(spark, where, frame.schema, files_per_batch=1))
    items, arrived = flow.found_items(streams[0], "found_at"), flow.arrived_details(streams[1], "arrived_at")
    found = _drained(flow.items_with_details(items, arrived, "1 hour"))
    return found.select("page_id", "pos", "asin", "found_at", "detail_id", "arrived_at")


@query("""SELECT user_id, CAST(ts AS DATE) AS snapshot_date, max_by(event_id, struct_pack(ts, event_id)) AS event_id, max_by(value, struct_pack(ts, event_id)) AS value
FROM events GROUP BY 1, 2""")
def stream_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily series of each user's last event, kept by batches that rewrite their own days only."""
    path = tables.shared_dir(spark, "series")
    write = jobs.track_batches(path, "user_id", "ts", ["value"], "event_id")
    jobs.flush(_stream(spark, sf_dir), write, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(path).select("user_id", "snapshot_date", "event_id", "value")


@query("""SELECT 'events' AS name, count(*)::DOUBLE AS total FROM events UNION ALL SELECT 'failed', count(*) FILTER (event_type = 'error') FROM events
UNION ALL SELECT 'input_rows', count(*) FROM events""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that a running stream reports batch by batch, written as rows and added up."""
    path = tables.shared_dir(spark, "progress")
    events = _stream(spark, sf_dir)
    watched = flow.counted(events, "events", {"events": F.count("*"), "failed": F.count_if(F.col("event_type") == "error")})
    listener = flow.ProgressRows(spark, path, "events")
    spark.streams.addListener(listener)
    try:
        query = jobs.flush(watched, lambda batch, _: batch.write.format("noop").mode("append").save(), f"{path}-checkpoint")
        query.awaitTermination()
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    return flow.progress_rows(spark, path).groupBy("name").agg(F.sum("value").alias("total"))
