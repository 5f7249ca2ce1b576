"""Registered queries over stored structures, table functions, and round trips of readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.functions import fields
from shelflight.operators import extract, filters, intervals, quality, reconcile, similar, sketches, tree
from shelflight.plans import views
from shelflight.plans.captures import _D, _pages
from shelflight.plans.catalogue import _AFTER, _BEFORE, _CRUMBS, _TRIGRAMS, _UP, query
from shelflight.plans.views import WITH_NODES, WITH_SIGHTINGS
from shelflight.sources import relational, tables


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = intervals.interval_labels(views.nodes(spark, sf_dir))
    return intervals.store_labels(labels, tables.shared_dir(spark, "labels"))


@query(f"""WITH RECURSIVE {WITH_NODES}, down AS (
  SELECT node_id, 0 AS level FROM nodes WHERE node_id IN ('R1', 'N3')
  UNION ALL SELECT n.node_id, level + 1 FROM nodes n JOIN down ON n.parent_node_id = down.node_id)
SELECT node_id, min(level) AS level FROM down GROUP BY node_id""")
def interval_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes below two roots, as ranges of stored numbers."""
    return intervals.subtree_in_range(_labels(spark, sf_dir), ["R1", "N3"])


@query(f"WITH RECURSIVE {WITH_NODES}, {_UP} SELECT node_id, count(*) FILTER (start <> node_id) AS descendants FROM up GROUP BY node_id")
def interval_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of every node from the ends of its range."""
    return intervals.descendants(_labels(spark, sf_dir))


_NAMES = "SELECT DISTINCT concat(p_name, ' ', p_brand, ' ', p_type) AS name FROM {part}"
_TEXTS = "SELECT DISTINCT concat(replace(p_name, 'i', ''), ' ', lower(p_type)) AS q FROM {part} UNION SELECT DISTINCT concat(substr(p_name, 3), ' brand#1') FROM {part}"


@query(f"""WITH n AS MATERIALIZED (SELECT name, {_TRIGRAMS.format('name')} AS a FROM ({views.duckdb_sql(_NAMES)})), t AS MATERIALIZED (SELECT q, {_TRIGRAMS.format('q')} AS b FROM ({views.duckdb_sql(_TEXTS)})),
s AS (SELECT q, name, len(list_intersect(a, b)) AS i, len(a) + len(b) AS u FROM n, t)
SELECT q, name, round(i / (u - i), 6) AS similarity FROM s WHERE contains(lower(name), lower(q)) OR i / (u - i) >= 0.6""")
def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few hundred misspelt texts searched for among all names at once."""
    names, texts = (views.view(spark, sf_dir, sql) for sql in (_NAMES, _TEXTS))
    found = similar.search_many(names, texts, "name", "name", "q", "q", 0.6)
    return found.select(F.col("text_key").alias("q"), F.col("key").alias("name"), F.round("similarity", 6).alias("similarity"))


_TWICE = " UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM {orders} WHERE o_orderkey % 1000 = 3"


@query(f"""WITH a AS ({views.duckdb_sql(_BEFORE)}), b AS ({views.duckdb_sql(_AFTER + _TWICE)}),
u AS (SELECT id, price, status, 1 AS l, 0 AS r FROM a UNION ALL SELECT id, price, status, 0, 1 FROM b)
SELECT id, price, status, sum(l)::BIGINT AS in_left, sum(r)::BIGINT AS in_right FROM u GROUP BY ALL HAVING sum(l) <> sum(r)""")
def content_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, values and numbers of repetitions in which two copies of a table differ."""
    before, after = (views.view(spark, sf_dir, s) for s in (_BEFORE, _AFTER + _TWICE))
    return reconcile.differences(before, after, ["id"], ["id", "price", "status"], 64, tables.shared_dir(spark, "copies"))


@query(f"""WITH {WITH_SIGHTINGS} SELECT list_type, count(DISTINCT asin) AS items, count(*) AS sightings, TRUE AS close FROM sightings GROUP BY list_type""")
def sketched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items of each list beside their estimate from daily sketches, which may be 4 % off."""
    rows = views.sightings(spark, sf_dir)
    kept = tables.materialise(sketches.item_sketches(rows, F.to_date("scraped_at")), "sketches")
    guess = sketches.distinct_items(kept, "list_type").withColumnRenamed("items", "guess")
    exact = rows.groupBy("list_type").agg(F.countDistinct("asin").alias("items"))
    close = F.abs(F.col("guess") - F.col("items")) <= F.lit(0.04) * F.col("items")
    return exact.join(guess.hint("merge"), "list_type").select("list_type", "items", "sightings", close.alias("close"))


@query(f"""WITH {WITH_SIGHTINGS}, per AS (SELECT asin, count(DISTINCT list_type) AS lists FROM sightings GROUP BY asin)
SELECT count(asin) AS items, count(*) FILTER (lists > 1) AS multi_list, TRUE AS close FROM per""")
def sketched_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on several lists beside their estimate from daily sketches, which may be 6 % off."""
    rows = views.sightings(spark, sf_dir)
    kept = tables.materialise(sketches.item_sketches(rows, F.to_date("scraped_at")), "sketches")
    guess = sketches.items_on_several_lists(kept, ["A", "N", "R"]).select(F.col("items").alias("g_items"), F.col("multi_list").alias("g_multi"))
    per = rows.groupBy("asin").agg(F.countDistinct("list_type").alias("lists"))
    exact = per.agg(F.count("asin").alias("items"), F.count_if(F.col("lists") > 1).alias("multi_list"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(0.06) * F.col(b)
    both = exact.crossJoin(F.broadcast(guess))  # a row each
    return both.select("items", "multi_list", (near("g_items", "items") & near("g_multi", "multi_list")).alias("close"))


_KEYED = "SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS id, c_name AS name, c_acctbal AS balance FROM {customer}"


@query(f"SELECT id, name, balance FROM ({views.duckdb_sql(_KEYED)}) WHERE balance > 0")
def relational_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to a relational database and read in four ranges of its key, rows without a key included.

    Derby stands in for the database; it runs in the driver's process, so this query is for local mode.
    """
    url = f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    relational.write_table(views.view(spark, sf_dir, _KEYED), url, "customers", 2, **options)
    rows = relational.read_table(spark, url, "customers", "id", 4, **options)
    return rows.where("balance > 0").select("id", "name", "balance")


@query("""SELECT o_orderkey AS asin, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS list_type, CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice ELSE 0 END AS price
FROM orders""")
def file_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations of files, each with a column more, in one read."""
    orders = views.view(spark, sf_dir, "SELECT o_orderkey AS asin, o_orderstatus AS list_type, o_totalprice AS price FROM {orders}")
    path = tables.shared_dir(spark, "generations")
    for k, columns in enumerate((["asin"], ["asin", "list_type"], ["asin", "list_type", "price"])):
        orders.where(F.col("asin") % 3 == k).select(*columns).write.mode("append").parquet(path)
    return relational.read_generations(spark, path, orders.schema, {"price": 0.0})


# --- table functions ------------------------------------------------------------


@query(f"""WITH {_D} SELECT k AS page_id, 0 AS idx, concat('B', lpad(asin, 9, '0')) AS asin, name FROM d
UNION ALL SELECT k, 1, concat('C', lpad(asin, 9, '0')), brand FROM d""")
def sql_page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item cards of ranked-list pages by a table function over the table of pages."""
    extract.register_table_functions(spark)
    pages = _pages(spark, sf_dir, views.CHART_PAGES).select("page_id", "url", "html")
    sql = "SELECT page_id, idx, regexp_extract(href, '/dp/([A-Z0-9]{{10}})', 1) AS asin, name FROM cards_of(TABLE({pages}))"
    return spark.sql(sql, pages=pages)


@query(f"""WITH {_D} SELECT k AS page_id, 0 AS pos, name, CAST(k + 100 AS VARCHAR) AS node_id FROM d
UNION ALL SELECT k, 1, brand, CAST(size + 7 AS VARCHAR) FROM d""")
def sql_page_crumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadcrumbs of detail pages by a table function over pages dealt out by their id."""
    extract.register_table_functions(spark)
    pages = _pages(spark, sf_dir, views.DETAIL_PAGES).select("page_id", "url", "html")
    sql = """SELECT page_id, pos, name, regexp_extract(href, 'node=([0-9]+)', 1) AS node_id
             FROM crumbs_of(TABLE({pages}) PARTITION BY page_id) WHERE href LIKE '%node=%'"""
    return spark.sql(sql, pages=pages)


@query(f"""WITH {_D} SELECT k AS page_id, pos, CASE pos WHEN 0 THEN concat('B', lpad(asin, 9, '0')) ELSE concat('C', lpad(asin, 9, '0')) END AS asin FROM d, (SELECT unnest([0, 1]) AS pos)""")
def sql_lateral_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item cards by a LATERAL join with a table function of each page's HTML."""
    extract.register_table_functions(spark)
    sql = """SELECT p.page_id, c.idx AS pos, regexp_extract(c.href, '/dp/([A-Z0-9]{{10}})', 1) AS asin
             FROM {pages} p, LATERAL page_cards(p.html) c"""
    return spark.sql(sql, pages=_pages(spark, sf_dir, views.CHART_PAGES).select("page_id", "html"))


# --- round trips ----------------------------------------------------------------


@query("""SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 = 0""")
def reloaded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table truncated and loaded twice, appended to without keys, written as nested JSON and as a report, and read back."""
    parts = views.view(spark, sf_dir, "SELECT p_partkey AS id, p_name AS name, p_size AS size FROM {part}")
    path = tables.shared_dir(spark, "reloaded")
    for _ in range(2):
        tables.overwrite(parts.where("id % 2 = 0"), f"{path}/table")
    tables.append(parts.where("id % 3 = 0"), f"{path}/table")
    whole = tables.table_at(spark, f"{path}/table", parts.schema)
    tables.write_json(whole.select(F.struct(*parts.columns).alias("row")), f"{path}/json")
    nested = spark.read.schema(f"row {parts.schema.simpleString()}").json(f"{path}/json").select("row.*")
    tables.write_report(nested, ["size", "id", "name"], f"{path}/report")
    return spark.read.option("header", True).schema("size long, id long, name string").csv(f"{path}/report").select(*parts.columns)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS name FROM part""")
def table_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the catalog beside one that is not there."""
    parts = views.view(spark, sf_dir, "SELECT CAST(p_partkey AS STRING) AS id, p_brand AS name FROM {part}")
    named = f"brands_{uuid.uuid4().hex}"
    parts.where("CAST(id AS LONG) % 5 > 0").createOrReplaceTempView(named)
    there, missing = (tables.table_or_empty(spark, n, parts.schema) for n in (named, f"{named}_missing"))
    return parts.select("id").join(there.unionByName(missing).hint("merge"), "id", "left")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS asin, max_by(o_orderstatus, struct_pack(o_orderdate, o_orderkey)) AS valid FROM orders WHERE o_orderkey % 11 > 0 GROUP BY 1
UNION ALL SELECT NULL, o_orderstatus FROM orders WHERE o_orderkey % 11 = 0""")
def latest_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the updates of each key the last; updates without a key all stay."""
    sql = "SELECT CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_custkey AS STRING) END AS asin, o_orderstatus AS valid, o_orderdate, o_orderkey FROM {orders}"
    return tables.latest_per_key(views.view(spark, sf_dir, sql), ["asin"], ["o_orderdate", "o_orderkey"]).select("asin", "valid")


@query(f"""WITH {WITH_SIGHTINGS}, sized AS (SELECT *, count(*) OVER (PARTITION BY node_id, list_type) AS list_total FROM sightings)
SELECT node_id, list_type, count(*) AS n FROM sized WHERE list_total >= 30 GROUP BY 1, 2""")
def sized_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that are long enough to be read at all."""
    rows = views.sightings(spark, sf_dir)
    totals = rows.groupBy("node_id", "list_type").agg(F.count("*").alias("list_total"))
    sized = rows.join(totals.hint("merge"), ["node_id", "list_type"])
    return sized.where(filters.ListGate(min_list_size=30).column()).groupBy("node_id", "list_type").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), 'hot') AS skipped FROM part""")
def kept_and_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt into kept and skipped ones by words, of which some win."""
    parts = views.view(spark, sf_dir, "SELECT p_partkey AS id, p_name AS slug FROM {part}")
    flag = filters.is_skipped(F.col("slug"), ("ring",), ("hot",))
    sides = [parts.where(flag == side).select("id", F.lit(side).alias("skipped")) for side in (False, True)]
    return sides[0].unionByName(sides[1])


@query("""SELECT p_partkey AS id, p_brand AS brand, CASE WHEN p_size > 9 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_size > 9 THEN 2 ELSE 1 END::INT AS n FROM part""")
def attribute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a key and a value as a map: the first colon parts them, the last of equal keys stays, some keys are left out."""
    sql = """SELECT p_partkey AS id, array('Brand: none', 'Rank: 1', 'no colon', concat('Brand: ', p_brand), ': empty',
             concat('Size: ', CASE WHEN p_size > 9 THEN CAST(p_size AS STRING) ELSE '' END)) AS lines FROM {part}"""
    found = views.view(spark, sf_dir, sql).withColumn("m", fields.key_values(F.col("lines"), ("Rank",)))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return found.select("id", get("Brand").alias("brand"), get("Size").alias("size"), F.size("m").alias("n"))


_OVERVIEW = """SELECT p_partkey AS page_id, 'https://shop.example/dp/B000000000' AS url,
 concat('<div id="productOverview_feature_div"><table><tr><td>Brand</td><td>', p_brand, '</td></tr><tr><td>Material :</td><td>', p_type,
        '</td></tr><tr><td>only one</td></tr></table></div>', CASE WHEN p_size % 2 = 0 THEN '/dp/B0ABCDEFGH /dp/B0ABCDEFGH /dp/B0ABCDEFGI' ELSE '' END) AS html FROM {part}"""


@query("""SELECT p_partkey AS page_id, p_brand AS brand, p_type AS material, 2::INT AS n, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END::INT AS list_total FROM part""")
def overview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overview tables of detail pages, and the number of items that a page without any count names."""
    pages = _pages(spark, sf_dir, _OVERVIEW)
    blocks = extract.detail_blocks(pages, ("page_id",)).select("page_id", "overview")
    totals = pages.select("page_id", fields.list_total(F.col("html"), F.lit(r"of (\d+) results"), F.lit(0)).alias("list_total"))
    get = lambda k: F.try_element_at("overview", F.lit(k))
    rows = blocks.join(totals.hint("merge"), "page_id")
    return rows.select("page_id", get("Brand").alias("brand"), get("Material").alias("material"), F.size("overview").alias("n"), "list_total")


@query(f"""WITH {WITH_NODES}, w AS (SELECT count(*) FILTER (coalesce(trim(node_id), '') <> '') AS total, count(*) FILTER (na_valid IS NULL AND coalesce(trim(node_id), '') <> '') AS queue FROM nodes),
s AS (SELECT user_id AS id, arg_max(event_type, ts) AS phase, max(ts) AS updated_at, (SELECT max(ts) FROM events) AS as_of FROM events GROUP BY 1)
SELECT id, phase, epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', updated_at)) < 60 AND phase <> 'error' AND id % 3 > 0 AS running, total, queue FROM s, w""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their phase, whether they are alive, and the work that waits."""
    events = views.fetch_log(spark, sf_dir)
    log = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    status = log.groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "ts").alias("phase"), F.max("ts").alias("updated_at"))
    paused = F.when(F.col("id") % 3 == 0, 1)
    as_of = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return quality.run_state(status.withColumn("paused", paused), views.nodes(spark, sf_dir), F.lit(as_of))


# --- all fields of the inventory ------------------------------------------------

#: Element ids that fields are read from, each with a place of its own.
_IDS = {i: n for n, i in enumerate(dict.fromkeys(i for g in extract.GROUPS.values() for spec in g.values() for i in spec.lstrip("?").split()))}
_FULL_PAGES = "SELECT p_partkey AS page_id, 'https://shop.example/dp/B000000000' AS url, concat({}) AS html FROM {{part}}".format(
    ", ".join(
        f"""CASE WHEN (p_partkey + {n}) % 3 = 0 THEN concat('<div id="{i.replace('*', 'any-')}">v{n} of ', CAST(p_partkey AS STRING), '</div>') ELSE '' END"""
        for i, n in _IDS.items()
    )
)


def _field_sql(group: str, field: str, spec: str) -> str:
    there = [f"(k + {_IDS[i]}) % 3 = 0" for i in spec.lstrip("?").split()]
    if spec.startswith("?"):
        value = f"CASE WHEN {' OR '.join(there)} THEN 'true' ELSE 'false' END"
    else:
        value = "CASE {} END".format(" ".join(f"WHEN {t} THEN concat('v{_IDS[i]} of ', k)" for t, i in zip(there, spec.split())))
    return f"('{group}.{field}', {value})"


_FIELDS = [(g, f, spec) for g, own in extract.GROUPS.items() for f, spec in own.items()]


@query("""WITH d AS (SELECT p_partkey AS k FROM part), u AS (SELECT k, unnest([{}]) AS e FROM d) SELECT k AS page_id, e[1] AS field, e[2] AS value FROM u""".format(
    ", ".join(_field_sql(*f) for f in _FIELDS)))
def inventory_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field that the inventory reads from a block, on pages that have a third of the blocks each."""
    record = extract.inventory_part(_pages(spark, sf_dir, _FULL_PAGES), tuple(f"{g}.{f}" for g, f, _ in _FIELDS))
    entries = [F.struct(F.lit(f"{g}.{f}").alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for g, f, _ in _FIELDS]
    return record.select("page_id", F.inline(F.array(*entries)))


@query(f"""WITH {WITH_NODES}, known AS (SELECT node_id FROM nodes WHERE depth <= 1), c AS ({views.duckdb_sql(_CRUMBS)}),
w AS (SELECT *, lag(node_id) OVER (PARTITION BY page_id ORDER BY pos) AS parent FROM c),
one AS (SELECT w.node_id, arg_min(parent, page_id) AS parent FROM w JOIN known ON known.node_id = w.parent WHERE pos = 1 GROUP BY 1)
SELECT node_id, parent AS parent_node_id, 2 AS depth FROM one UNION ALL SELECT DISTINCT w.node_id, w.parent, 3 FROM w JOIN one ON one.node_id = w.parent WHERE pos = 2""")
def filled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that breadcrumbs add to a tree of two levels, also below what other pages added."""
    known = views.nodes(spark, sf_dir).where("depth <= 1")
    return tree.fill_from_crumbs(views.view(spark, sf_dir, _CRUMBS), known).select("node_id", "parent_node_id", "depth")
