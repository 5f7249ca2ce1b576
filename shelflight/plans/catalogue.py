"""Registered queries over the catalogue views and their DuckDB counterparts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.functions import fields, urls
from shelflight.operators import arrivals, extract, filters, quality, sightings, tracking, tree
from shelflight.plans import views
from shelflight.plans.views import WITH_DETAILS, WITH_NODES, WITH_SIGHTINGS
from shelflight.schema import LIST_TYPES, WATCHLIST, conform, evolve, with_locale
from shelflight.sources import tables
from shelflight.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGS = ["nr_valid", "bs_valid", "ms_valid", "mw_valid"]
TIES = ["l_orderkey", "l_linenumber", "l_suppkey", "price"]
AS_OF = dt.date(2024, 7, 1)


def query(oracle: str | None = None):
    """Register a query, and its oracle."""

    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLE_SQL[function.__name__] = oracle
        return function

    return register


# --- roll-ups, pages and statistics of sightings --------------------------------

_ORDER = "coalesce(rank, 2147483647), scraped_at, l_orderkey, l_linenumber, l_suppkey, price"


@query(f"""
WITH {WITH_SIGHTINGS}, best AS (
  SELECT asin, name, price, rating, review_count,
         row_number() OVER (PARTITION BY asin ORDER BY {_ORDER}) AS n FROM sightings)
SELECT asin, b.name, b.price, round(b.rating, 6) AS rating, b.review_count,
       string_agg(DISTINCT list_type, ',' ORDER BY list_type) AS lists, count(DISTINCT list_type) AS list_count,
       string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS categories, min(rank) AS best_rank, min(scraped_at) AS first_seen
FROM sightings JOIN (SELECT * FROM best WHERE n = 1) b USING (asin)
GROUP BY asin, b.name, b.price, b.rating, b.review_count""")
def rollup_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item over all its ranked lists."""
    rows = sightings.rollup(views.sightings(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_suppkey", "price"])
    return rows.withColumn("rating", F.round("rating", 6))


@query(f"""WITH {WITH_SIGHTINGS}, per AS (SELECT asin, count(DISTINCT list_type) AS lists, count(*) AS n FROM sightings GROUP BY asin)
SELECT count(asin) AS items, count(*) FILTER (lists > 1) AS multi_list, CAST(sum(n) AS BIGINT) AS sightings FROM per""")
def item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings.item_stats(views.sightings(spark, sf_dir))


@query(f"WITH {WITH_SIGHTINGS} SELECT list_type, count(*) AS n FROM sightings GROUP BY list_type")
def items_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings.items_by_list(views.sightings(spark, sf_dir))


_PAGE = ["asin", "name", "price", "review_count", "list_type", "scraped_at", "l_orderkey", "l_linenumber", "l_suppkey"]


@query(f"""WITH {WITH_SIGHTINGS} SELECT {', '.join(_PAGE)} FROM sightings
WHERE list_type = 'A' AND price >= 20000 AND price <= 60000 AND rating >= 1 AND review_count <= 40
ORDER BY scraped_at DESC, l_orderkey, l_linenumber, l_suppkey, price LIMIT 200 OFFSET 20""")
def sightings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of sightings in bounds, the latest first."""
    bounds = filters.PageFilter(list_type="A", price_min=20000, price_max=60000, rating_min=1, review_max=40)
    return sightings.page(views.sightings(spark, sf_dir), bounds, _PAGE, TIES, limit=200, offset=20)


@query(f"""WITH {WITH_SIGHTINGS}, ok AS (
  SELECT * FROM sightings WHERE coalesce(review_count, 0) < 40 AND coalesce(review_count, 0) >= 5
  AND rating >= 1 AND rating <= 4 AND price >= 10000)
SELECT asin, list_type, price, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY asin ORDER BY scraped_at, l_orderkey, l_linenumber, l_suppkey, price) AS n FROM ok)
WHERE n = 1""")
def gated_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of a ranked list, then the first sighting of each item."""
    gate = filters.ListGate(review_max=40, review_min=5, rating_min=1, rating_max=4, price_min=10000)
    kept = sightings.gated(views.sightings(spark, sf_dir), gate, ["scraped_at", *TIES])
    return kept.select("asin", "list_type", "price", "l_orderkey", "l_linenumber")


_ITEMS = """SELECT l_suppkey AS node_id, l_returnflag AS list_type, l_linenumber AS page_no,
  row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linenumber
                     ORDER BY l_orderkey, l_partkey, l_extendedprice, l_shipdate) - 1 AS idx,
  CASE WHEN l_partkey % 3 = 0 THEN l_linenumber END AS rank, l_orderkey, l_partkey FROM {lineitem}"""


@query(f"""WITH items AS ({views.duckdb_sql(_ITEMS)}), placed AS (
  SELECT *, row_number() OVER (PARTITION BY node_id, list_type ORDER BY page_no, idx) AS place FROM items)
SELECT node_id, list_type, page_no, idx, l_orderkey, coalesce(rank, place) AS list_position FROM placed
WHERE coalesce(rank, place) <= 100""")
def list_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on ranked lists over all pages of a list, capped."""
    placed = sightings.list_positions(views.view(spark, sf_dir, _ITEMS))
    capped = placed.where(F.col("list_position") <= 100)
    return capped.select("node_id", "list_type", "page_no", "idx", "l_orderkey", "list_position")


@query(f"""WITH {WITH_SIGHTINGS} SELECT node_id, min(price) AS price, min_by(asin, (price, CAST(asin AS BIGINT), list_type)) AS asin FROM sightings GROUP BY node_id""")
def cheapest_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sightings(spark, sf_dir).withColumn("n", F.col("asin").cast("long"))
    return sightings.best_per_key(rows, "node_id", "price", ["n", "list_type", "asin"]).select("node_id", "price", "asin")


# --- trees ----------------------------------------------------------------------


@query(f"""WITH {WITH_NODES} SELECT count(*) AS total, count(*) FILTER (explored = 0) AS unexplored, count(node_id) AS with_id,
count(*) FILTER (source = 'breadcrumb') AS from_breadcrumbs, count(nr_valid) AS validated FROM nodes""")
def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.node_stats(views.nodes(spark, sf_dir))


@query(f"WITH {WITH_NODES} SELECT concat('L', depth) AS level, count(*) AS n FROM nodes GROUP BY depth")
def depth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.depth_counts(views.nodes(spark, sf_dir))


@query(f"""WITH {WITH_NODES}, c AS (SELECT parent_node_id AS p, count(*) AS n FROM nodes WHERE coalesce(trim(parent_node_id), '') <> '' GROUP BY 1)
SELECT node_id, coalesce(n, 0) AS child_count FROM nodes LEFT JOIN c ON node_id = p""")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.child_counts(views.nodes(spark, sf_dir)).select("node_id", "child_count")


_UP = """up AS (
  SELECT node_id AS start, node_id, nullif(parent_node_id, '') AS parent, node_id AS path FROM nodes
  UNION ALL
  SELECT up.start, n.node_id, nullif(n.parent_node_id, ''), concat(n.node_id, '.', up.path) FROM up JOIN nodes n ON n.node_id = up.parent)"""


@query(f"WITH RECURSIVE {WITH_NODES}, {_UP} SELECT start AS node_id, path AS labels FROM up WHERE parent IS NULL")
def node_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root-to-node path of every node."""
    return tree.paths(views.nodes(spark, sf_dir)).select("node_id", "labels")


@query(f"""WITH RECURSIVE {WITH_NODES}, {_UP} SELECT node_id, count(*) - 1 AS descendants FROM up GROUP BY node_id""")
def descendant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.descendant_counts(tree.paths(views.nodes(spark, sf_dir)))


@query(f"""WITH RECURSIVE {WITH_NODES}, down AS (
  SELECT node_id, 0 AS level FROM nodes WHERE node_id IN ('R1', 'N3')
  UNION ALL SELECT n.node_id, level + 1 FROM nodes n JOIN down ON n.parent_node_id = down.node_id)
SELECT node_id, min(level) AS level FROM down GROUP BY node_id""")
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes below two roots."""
    nodes = views.nodes(spark, sf_dir)
    return tree.subtree(nodes, nodes.where(F.col("node_id").isin("R1", "N3")))


@query(f"""WITH RECURSIVE {WITH_NODES}, {_UP} SELECT DISTINCT start AS node_id FROM up WHERE node_id IN ('R2', 'N4')""")
def subtree_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtree_by_path(tree.paths(views.nodes(spark, sf_dir)), ["R2", "N4"]).select("node_id")


@query(f"""WITH {WITH_NODES} SELECT node_id FROM nodes
WHERE starts_with(url, 'https://shop.example/gp/bestsellers/s-3/') OR node_id = 'R1'""")
def subtree_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("R1", "https://shop.example/gp/bestsellers/s-3/")], "node_id string, url string")
    return tree.subtree_by_url(views.nodes(spark, sf_dir), roots).select("node_id")


@query(f"""WITH {WITH_NODES} SELECT node_id, name, depth, 0 AS child_count FROM nodes WHERE na_valid = 1 AND site = 'ASIA'
ORDER BY depth, name, node_id LIMIT 200""")
def capable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat list of nodes with a capability, by depth and name."""
    rows = views.nodes(spark, sf_dir).where((F.col("na_valid") == 1) & (F.col("site") == "ASIA"))
    return rows.select("node_id", "name", "depth", F.lit(0).alias("child_count")).orderBy("depth", "name", "node_id").limit(200)


@query(f"""WITH RECURSIVE {WITH_NODES}, {_UP}, d AS (SELECT node_id, count(*) - 1 AS descendants FROM up GROUP BY node_id)
SELECT n.node_id, n.name, n.depth, d.descendants FROM nodes n JOIN d USING (node_id) WHERE n.parent_node_id = 'R2'""")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of a node with the number of their descendants."""
    nodes = views.nodes(spark, sf_dir)
    counts = tree.descendant_counts(tree.paths(nodes))
    rows = tree.children(nodes, "R2").join(counts, "node_id")
    return rows.select("node_id", "name", "depth", "descendants").orderBy("depth", "name")


@query(f"""WITH {WITH_NODES} SELECT site, count(*) AS child_count FROM nodes GROUP BY site""")
def site_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.nodes(spark, sf_dir).groupBy("site").agg(F.count("*").alias("child_count"))


@query(f"""WITH {WITH_NODES} SELECT node_id FROM nodes
WHERE node_id NOT IN (SELECT parent_node_id FROM nodes WHERE parent_node_id IS NOT NULL)""")
def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.leaves(views.nodes(spark, sf_dir)).select("node_id")


@query(f"""WITH {WITH_NODES}, known AS (SELECT * FROM nodes WHERE depth < 3), f AS (
  SELECT n.* FROM nodes n WHERE depth = 3 AND url NOT IN (SELECT url FROM known) AND node_id NOT IN (SELECT node_id FROM known))
SELECT node_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY node_id) AS n FROM f) WHERE n = 1""")
def unseen_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New nodes whose url and id are both unknown, each once."""
    nodes = views.nodes(spark, sf_dir)
    fresh = tree.unseen(nodes.where("depth = 3"), nodes.where("depth < 3"), ["node_id"])
    return fresh.select("node_id", "url")


@query(f"""WITH {WITH_NODES}, known AS (SELECT * FROM nodes WHERE depth < 2)
SELECT n.node_id, coalesce(p.depth + 1, 1) AS depth, coalesce(p.slug, '') AS slug
FROM nodes n LEFT JOIN known p ON n.parent_node_id = p.node_id WHERE n.depth >= 2""")
def placed_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.nodes(spark, sf_dir)
    return tree.placed_below(nodes.where("depth >= 2"), nodes.where("depth < 2")).select("node_id", "depth", "slug")


@query(f"""WITH {WITH_NODES}, part AS (SELECT * FROM nodes WHERE NOT (depth = 0 AND site IN ('ASIA', 'EUROPE')) AND NOT (depth = 1 AND site = 'EUROPE')),
every AS (
  SELECT site, node_id, name, 1 AS choice FROM part WHERE depth = 0
  UNION ALL SELECT DISTINCT site, parent_node_id, parent_node_id, 2 FROM part WHERE depth = 1 AND coalesce(parent_node_id, '') <> ''
  UNION ALL SELECT DISTINCT site, '', site, 3 FROM part)
SELECT * FROM every QUALIFY choice = min(choice) OVER (PARTITION BY site)""")
def root_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry rows of each site, with two sites that lack roots."""
    lacking = "not (depth = 0 and site in ('ASIA', 'EUROPE')) and not (depth = 1 and site = 'EUROPE')"
    return tree.root_rows(views.nodes(spark, sf_dir).where(lacking)).select("site", "node_id", "name", "choice")


@query(f"""WITH {WITH_NODES}, own AS (SELECT slug, min(name) AS name FROM nodes WHERE depth = 1 AND slug <> '' GROUP BY slug),
c AS (SELECT regexp_extract(url, '/gp/(?:bestsellers|new-releases)/([a-z][a-z0-9-]+)', 1) AS slug, count(*) AS n FROM nodes WHERE depth > 1 GROUP BY 1)
SELECT slug, name, coalesce(n, 0) AS child_count, 0 AS discovered FROM own LEFT JOIN c USING (slug)
UNION ALL SELECT slug, concat('S ', replace(slug, 's-', '')), n, 1 FROM c WHERE slug NOT IN (SELECT slug FROM own)""")
def top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-level categories with child counts, and slugs found in child URLs only."""
    return tree.top_level(views.nodes(spark, sf_dir))


@query(f"""WITH {WITH_NODES} SELECT node_id, name, depth, url FROM nodes WHERE contains(url, '/s-4/') ORDER BY depth, name, node_id""")
def slug_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.nodes(spark, sf_dir).where(urls.chart_slug(F.col("url")) == "s-4")
    return rows.select("node_id", "name", "depth", "url").orderBy("depth", "name", "node_id")


@query(f"""WITH {WITH_NODES} SELECT DISTINCT node_id, depth FROM nodes
WHERE regexp_matches(url, '/gp/(bestsellers|new-releases)/(s-1|s-2)/') ORDER BY depth DESC""")
def nodes_by_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of some slugs on some lists, the deepest first."""
    url = F.col("url")
    rows = views.nodes(spark, sf_dir).where(
        urls.list_of(url).isin("bestsellers", "new-releases") & urls.chart_slug(url).isin("s-1", "s-2")
    )
    return rows.select("node_id", "depth").distinct().orderBy(F.desc("depth"), "node_id")


@query(f"""WITH {WITH_NODES}, l(list_type) AS (VALUES ('new-releases'), ('bestsellers'), ('movers-and-shakers'), ('most-wished-for'), ('most-gifted'))
SELECT node_id, list_type, concat('https://shop.example/gp/', list_type, '/', slug, '/', node_id, '/') AS url FROM nodes, l""")
def chart_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node on every ranked list."""
    from shelflight.schema import list_types

    return tree.chart_targets(views.nodes(spark, sf_dir), list_types(spark), F.lit("https://shop.example"))


@query(f"""WITH {WITH_NODES}, named AS (SELECT node_id, CASE WHEN depth = 2 THEN replace(name, '#00', '_0%') ELSE name END AS name FROM nodes)
SELECT node_id FROM named WHERE contains(lower(name), '_0%') AND contains(lower(name), 'mer_0%') OR contains(lower(name), 'er 3-')""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search; % and _ are plain characters, which some names hold."""
    nodes = views.nodes(spark, sf_dir)
    named = nodes.withColumn("name", F.when(F.col("depth") == 2, F.replace("name", F.lit("#00"), F.lit("_0%"))).otherwise(F.col("name")))
    name = F.col("name")
    wanted = (filters.name_contains(name, "_0%") & filters.name_contains(name, "MER_0%")) | filters.name_contains(name, "er 3-")
    return named.where(wanted).select("node_id")


@query(f"""WITH {WITH_NODES} SELECT node_id, least(depth, 2) AS bucket FROM nodes
WHERE (contains(lower(name), '12') OR contains(lower(node_id), '12')) AND least(depth, 2) = 2""")
def name_or_id_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by name or id in the folded bucket of deep nodes."""
    nodes = views.nodes(spark, sf_dir)
    wanted = filters.name_or_id(F.col("name"), F.col("node_id"), "12") & filters.depth_is(F.col("depth"), 4, folded_from=2)
    return nodes.where(wanted).select("node_id", F.least("depth", F.lit(2)).alias("bucket"))


_TRIGRAMS = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))"""


@query(f"""WITH t AS (SELECT DISTINCT p_name AS name FROM part), s AS (
  SELECT name, len(list_intersect({_TRIGRAMS.format('name')}, {_TRIGRAMS.format("'smal widgt'")})) AS i,
         len(list_distinct(list_concat({_TRIGRAMS.format('name')}, {_TRIGRAMS.format("'smal widgt'")}))) AS u FROM t)
SELECT name, round(i / u, 6) AS similarity FROM s WHERE i / u >= 0.3""")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names similar to a misspelt text, the most similar first."""
    names = views.view(spark, sf_dir, "SELECT DISTINCT p_name AS name, p_name AS node_id FROM {part}")
    found = tree.search_fuzzy(names, "smal widgt")
    return found.select("name", F.round("similarity", 6).alias("similarity"))


_CRUMBS = """SELECT o_orderkey AS page_id, p AS pos, CASE WHEN p = 0 THEN concat('N', CAST(o_custkey % 40 AS STRING))
  ELSE concat('X', CAST((o_custkey * 7 + p) % 500 AS STRING), '-', CAST(p AS STRING)) END AS node_id,
  concat('crumb ', CAST(p AS STRING)) AS name FROM {orders} CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2) ps"""


@query(f"""WITH {WITH_NODES}, known AS (SELECT node_id FROM nodes WHERE depth <= 1), crumbs AS ({views.duckdb_sql(_CRUMBS)}),
m AS (SELECT c.*, k.node_id IS NOT NULL AS known FROM crumbs c LEFT JOIN known k USING (node_id)),
w AS (SELECT *, lag(node_id) OVER (PARTITION BY page_id ORDER BY pos) AS parent_node_id,
  max(CAST(known AS INT)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rooted FROM m)
SELECT page_id, pos, node_id, name, parent_node_id FROM w WHERE NOT known AND rooted = 1
QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY page_id, pos) = 1""")
def crumb_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown breadcrumbs attached below their nearest known ancestor."""
    known = views.nodes(spark, sf_dir).where("depth <= 1").select("node_id")
    return tree.edges_of_crumbs(views.view(spark, sf_dir, _CRUMBS), known)


def _grown_oracle() -> str:
    """Four levels written out: at each, children of the last level whose url and id are unknown, one to a url, then one to an id."""
    first = "row_number() OVER (PARTITION BY {} ORDER BY parent_url, url, name, node_id) = 1"
    sql = f"""WITH {WITH_NODES}, e AS (SELECT p.url AS parent_url, n.name, n.url, n.node_id FROM nodes n JOIN nodes p ON n.parent_node_id = p.node_id),
    known0 AS (SELECT url, node_id, 0 AS depth FROM nodes WHERE depth = 0)"""
    for n in range(1, 5):
        sql += f""", found{n} AS (SELECT DISTINCT e.* FROM e JOIN known{n - 1} k ON e.parent_url = k.url AND k.depth = {n - 1}
          WHERE e.url NOT IN (SELECT url FROM known{n - 1}) AND e.node_id NOT IN (SELECT node_id FROM known{n - 1})),
        once{n} AS (SELECT * FROM found{n} QUALIFY {first.format('url')}), level{n} AS (SELECT * FROM once{n} QUALIFY {first.format('node_id')}),
        known{n} AS (SELECT * FROM known{n - 1} UNION ALL SELECT url, node_id, {n} FROM level{n})"""
    return sql + " SELECT node_id, depth FROM known4"


@query(_grown_oracle())
def grown_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first growth from the roots over all captured edges; many pages share a URL."""
    nodes = views.nodes(spark, sf_dir)
    parents = nodes.select(F.col("url").alias("parent_url"), F.col("node_id").alias("parent"))
    edges = nodes.join(parents, F.col("parent_node_id") == F.col("parent")).select("parent_url", "name", "url", "node_id", "slug")
    return tree.grow(edges, nodes.where("depth = 0")).select("node_id", "depth")


# --- flags, caches, progress -----------------------------------------------------

_CACHE = """SELECT node_id, CAST(1 AS INT) AS nr_valid, CAST(0 AS INT) AS bs_valid, CAST(NULL AS INT) AS ms_valid, CAST(1 AS INT) AS mw_valid
FROM {nodes} WHERE depth < 3 AND explored = 0"""


@query(f"""WITH {WITH_NODES}, cache AS ({_CACHE.replace('{nodes}', 'nodes')})
SELECT n.node_id, coalesce(n.nr_valid, c.nr_valid) AS nr_valid, coalesce(n.bs_valid, c.bs_valid) AS bs_valid,
coalesce(n.ms_valid, c.ms_valid) AS ms_valid, coalesce(n.mw_valid, c.mw_valid) AS mw_valid FROM nodes n LEFT JOIN cache c USING (node_id)""")
def cached_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null flags filled from the link cache."""
    nodes = views.nodes(spark, sf_dir)
    return quality.with_cache(nodes, spark.sql(_CACHE, nodes=nodes), FLAGS).select("node_id", *FLAGS)


@query(f"""WITH {WITH_NODES} SELECT count(*) AS total, {', '.join(f"count({f}) AS {f}_checked, count(*) FILTER ({f} = 1) AS {f}_ok" for f in FLAGS)} FROM nodes""")
def check_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_progress(views.nodes(spark, sf_dir), FLAGS)


@query(f"""WITH {WITH_NODES} SELECT site, count(*) FILTER (na_valid = 1) AS yes, count(*) FILTER (na_valid = 0) AS no,
count(*) FILTER (na_valid IS NULL) AS unknown FROM nodes GROUP BY site""")
def tristate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tristate(views.nodes(spark, sf_dir))


@query(f"""WITH {WITH_NODES} SELECT node_id FROM nodes WHERE na_valid IS NULL AND node_id IS NOT NULL AND explored = 0""")
def pending_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.pending(views.nodes(spark, sf_dir)).where("explored = 0").select("node_id")


_CHECKS = """SELECT c.node_id, c.list_type, c.valid FROM (
  SELECT concat('C', CAST(o_custkey AS STRING)) AS node_id, CASE WHEN o_orderkey % 2 = 0 THEN 'bestsellers' ELSE 'new-releases' END AS list_type,
         CAST(o_orderkey % 2 AS INT) AS valid FROM {orders}) c"""


@query(f"""WITH {WITH_NODES}, c AS ({views.duckdb_sql(_CHECKS)}), u AS (SELECT node_id, max(valid) FILTER (list_type = 'new-releases') AS nr,
 max(valid) FILTER (list_type = 'bestsellers') AS bs FROM c GROUP BY node_id)
SELECT n.node_id, coalesce(nr, nr_valid) AS nr_valid, coalesce(bs, bs_valid) AS bs_valid FROM nodes n LEFT JOIN u USING (node_id)""")
def flag_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed updates of flag columns from a table of checks."""
    flags = {name: flag for name, flag, _ in LIST_TYPES if flag in ("nr_valid", "bs_valid")}
    updates = tables.flags_by_list(views.view(spark, sf_dir, _CHECKS), flags)
    updated = tables.update_columns(views.nodes(spark, sf_dir), updates, ["node_id"], ["nr_valid", "bs_valid"])
    return updated.select("node_id", "nr_valid", "bs_valid")


@query(f"""WITH {WITH_NODES} SELECT node_id, CASE WHEN site <> 'ASIA' THEN na_valid END AS na_valid,
CASE WHEN depth = 2 THEN 1 ELSE explored END AS explored FROM nodes""")
def marked_and_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag set by key, and another reset for one site."""
    nodes = views.nodes(spark, sf_dir)
    marked = tables.mark(nodes, nodes.where("depth = 2"), "node_id", "explored")
    return tables.reset_column(marked, "na_valid", F.col("site") == "ASIA").select("node_id", "na_valid", "explored")


# --- writes ---------------------------------------------------------------------


@query(f"""WITH {WITH_SIGHTINGS} SELECT asin, node_id, list_type, l_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY asin, node_id, list_type ORDER BY l_orderkey, l_linenumber, l_suppkey, price) AS n
  FROM sightings WHERE l_linestatus = 'O') s
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM sightings t WHERE t.l_linestatus = 'F' AND t.asin = s.asin AND t.list_type = s.list_type AND t.node_id = s.node_id)""")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an insert with ignored conflicts would add."""
    rows = views.sightings(spark, sf_dir)
    target, batch = rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'")
    added = tables.insert_or_ignore(target, batch, ["asin", "node_id", "list_type"], TIES)
    return added.select("asin", "node_id", "list_type", "l_orderkey")


_OLD = "SELECT CAST(c_custkey AS STRING) AS asin, c_name AS name, TIMESTAMP '2024-01-01 00:00:00' AS added_at, c_mktsegment AS notes FROM {customer} WHERE c_custkey % 3 = 0"
_NEW = "SELECT CAST(c_custkey AS STRING) AS asin, concat(c_name, '!') AS name, TIMESTAMP '2024-02-01 00:00:00' AS added_at, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS notes FROM {customer} WHERE c_custkey % 2 = 0"


@query(f"""WITH o AS ({views.duckdb_sql(_OLD)}), n AS ({views.duckdb_sql(_NEW)})
SELECT coalesce(o.asin, n.asin) AS asin, CASE WHEN n.asin IS NOT NULL THEN n.name ELSE o.name END AS name,
coalesce(o.added_at, n.added_at) AS added_at, CASE WHEN n.asin IS NOT NULL THEN n.notes ELSE o.notes END AS notes
FROM o FULL JOIN n ON o.asin = n.asin WHERE coalesce(o.asin, n.asin) NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 0)""")
def watchlist_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watchlist after additions and removals."""
    old, new = (conform(views.view(spark, sf_dir, s), WATCHLIST) for s in (_OLD, _NEW))
    gone = views.view(spark, sf_dir, "SELECT CAST(c_custkey AS STRING) AS asin FROM {customer} WHERE c_custkey % 10 = 0")
    return tracking.unwatch(tracking.watch(old, new, ["added_at"]), gone)


@query(f"""WITH {WITH_SIGHTINGS} SELECT asin, count(*) AS n FROM sightings
WHERE asin NOT IN (SELECT asin FROM sightings WHERE price > 85000) GROUP BY asin""")
def items_without_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of items none of whose rows fails a predicate."""
    kept = tables.delete_failing(views.sightings(spark, sf_dir), "asin", F.col("price") <= 85000)
    return kept.groupBy("asin").agg(F.count("*").alias("n"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus AS status, CAST(NULL AS DOUBLE) AS value FROM orders
UNION ALL SELECT event_id, NULL, value FROM events""")
def evolved_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two schema versions under the union of their columns."""
    old = views.view(spark, sf_dir, "SELECT o_orderkey AS id, o_orderstatus AS status FROM {orders}")
    return evolve(old, views.view(spark, sf_dir, "SELECT event_id AS id, value FROM {events}"))


@query(f"""WITH {WITH_NODES} SELECT node_id, name FROM nodes ORDER BY md5(concat(node_id, '#7')), node_id LIMIT 100""")
def sampled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sample of nodes by hash (a sampling operator)."""
    return tables.sample_rows(views.nodes(spark, sf_dir), 100, "node_id", seed=7).select("node_id", "name")


# --- tracking -------------------------------------------------------------------


@query(f"""WITH {WITH_SIGHTINGS} SELECT asin, price, rank, round(rating, 6) AS rating, review_count, DATE '2024-07-01' AS snapshot_date FROM (
  SELECT *, row_number() OVER (PARTITION BY asin ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, price DESC) AS n FROM sightings)
WHERE n = 1 AND CAST(asin AS BIGINT) % 3 = 0""")
def watch_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest sighting of each watched item."""
    watched = views.view(spark, sf_dir, "SELECT CAST(p_partkey AS STRING) AS asin FROM {part} WHERE p_partkey % 3 = 0")
    rows = tracking.snapshot(watched, views.sightings(spark, sf_dir), F.lit(AS_OF), ["scraped_at", *TIES])
    return rows.withColumn("rating", F.round("rating", 6))


_DAYS = """SELECT asin, CAST(scraped_at AS DATE) AS snapshot_date, min(price) AS price, min(rank) AS rank,
  min(rating) AS rating, min(review_count) AS review_count FROM {sightings} GROUP BY asin, CAST(scraped_at AS DATE)"""


@query(f"""WITH {WITH_SIGHTINGS}, d AS ({_DAYS.replace('{sightings}', 'sightings')})
SELECT asin, snapshot_date, price, round(price - lag(price) OVER (PARTITION BY asin ORDER BY snapshot_date), 4) AS price_change FROM d""")
def item_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series of every item with its change of price."""
    days = spark.sql(_DAYS, sightings=views.sightings(spark, sf_dir))
    rows = tracking.history(days).withColumn("price_change", F.round("price_change", 4))
    return rows.select("asin", "snapshot_date", "price", "price_change")


@query(f"""WITH {WITH_SIGHTINGS}, d AS ({_DAYS.replace('{sightings}', 'sightings')})
SELECT asin, snapshot_date, CASE WHEN snapshot_date >= DATE '2000-01-01' THEN price * 2 ELSE price END AS price FROM d""")
def tracked_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series after a rerun of some days replaced their rows."""
    days = spark.sql(_DAYS, sightings=views.sightings(spark, sf_dir))
    again = days.where(F.col("snapshot_date") >= dt.date(2000, 1, 1)).withColumn("price", F.col("price") * 2)
    return tracking.track(days, again).select("asin", "snapshot_date", "price")


# --- fetch log ------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok FROM events),
r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, event_id, CAST(sum(1 - CAST(ok AS INT)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM r""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each source since its last success."""
    rows = quality.failure_streaks(views.fetch_log(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("ok"))
    return rows.select("user_id", "event_id", "streak")


@query("""SELECT user_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS fail,
round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 6) AS fail_pct FROM events GROUP BY user_id""")
def fail_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.fail_rates(views.fetch_log(spark, sf_dir), "user_id", F.col("ok"))
    return rows.withColumn("fail_pct", F.round("fail_pct", 6))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.throughput(views.fetch_log(spark, sf_dir), "ts", "1 hour")


_BEFORE = "SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status FROM {orders} WHERE o_orderkey % 10 <> 1"
_AFTER = "SELECT o_orderkey AS id, o_totalprice AS price, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM {orders} WHERE o_orderkey % 10 <> 2"


@query(f"""WITH a AS ({views.duckdb_sql(_BEFORE)}), b AS ({views.duckdb_sql(_AFTER)})
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.price <> b.price OR a.status <> b.status""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added, removed and changed between two snapshots."""
    before, after = (views.view(spark, sf_dir, s) for s in (_BEFORE, _AFTER))
    return quality.snapshot_diff(before, after, ["id"], ["price", "status"])


@query(f"""WITH a AS ({views.duckdb_sql(_BEFORE)}), b AS ({views.duckdb_sql(_AFTER)})
SELECT 'before' AS source, count(*) AS n_rows, count(*) - count(status) AS status_nulls FROM a
UNION ALL SELECT 'after', count(*), count(*) - count(status) FROM b""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (views.view(spark, sf_dir, s) for s in (_BEFORE, _AFTER))
    return quality.reconcile({"before": before, "after": after}, ["status"])


# --- field texts ----------------------------------------------------------------


@query(f"""WITH {WITH_DETAILS}, p AS (SELECT asin, site, regexp_extract(price_text, '[0-9,.]+') AS p, rating_text, review_text FROM details)
SELECT asin, CAST(CASE WHEN site IN ('DE', 'FR') THEN replace(replace(p, '.', ''), ',', '.') ELSE replace(p, ',', '') END AS DOUBLE) AS price,
CAST(replace(CASE site WHEN 'DE' THEN regexp_extract(rating_text, '([0-9,]+)\\s+von', 1) WHEN 'JP' THEN regexp_extract(rating_text, '5つ星のうち([0-9.]+)', 1)
  WHEN 'FR' THEN regexp_extract(rating_text, '([0-9,]+)\\s+sur', 1) ELSE regexp_extract(rating_text, '([0-9.]+)\\s+out', 1) END, ',', '.') AS DOUBLE) AS rating,
CAST(replace(regexp_extract(review_text, '[0-9,.]+'), ',', '') AS INT) AS reviews FROM p""")
def locale_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, ratings and counts under each site's locale."""
    rows = with_locale(views.details(spark, sf_dir))
    return rows.select(
        "asin",
        fields.locale_number(F.col("price_text"), F.col("decimal_sep")).alias("price"),
        fields.locale_rating(F.col("rating_text"), F.col("rating_pattern")).alias("rating"),
        fields.count_number(F.col("review_text")).alias("reviews"),
    )


@query(f"""WITH {WITH_DETAILS}, w AS (SELECT asin, size, CAST(asin AS BIGINT) % 4 AS k, CAST(asin AS BIGINT) % 3 AS d FROM details)
SELECT asin, round(CASE k WHEN 0 THEN size / 16 WHEN 1 THEN (size + 0.5) * 2.205 WHEN 2 THEN size * 10 * 0.0022 ELSE size + 0.25 END, 6) AS pounds,
round(CASE d WHEN 0 THEN greatest(size + 3, 2.5) / 2.54 WHEN 1 THEN greatest(size, 4) END, 6) AS longest FROM w""")
def weights_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.details(spark, sf_dir)
    return rows.select(
        "asin",
        F.round(fields.pounds(F.col("item_weight")), 6).alias("pounds"),
        F.round(F.get(fields.inches(F.col("item_dimensions")), F.lit(0)), 6).alias("longest"),
    )


@query(f"""WITH {WITH_DETAILS}, x AS (SELECT asin, size % 31 + 1 AS day, CAST(asin AS BIGINT) % 4 AS k FROM details)
SELECT asin, CASE k WHEN 0 THEN try_cast(concat('2024-06-', lpad(CAST(day AS VARCHAR), 2, '0')) AS DATE)
 WHEN 1 THEN try_cast(concat('2024-03-', lpad(CAST(day AS VARCHAR), 2, '0')) AS DATE)
 WHEN 2 THEN try_cast(concat('2024-02-', lpad(CAST(day AS VARCHAR), 2, '0')) AS DATE) END AS listed,
 date_diff('day', CASE k WHEN 0 THEN try_cast(concat('2024-06-', lpad(CAST(day AS VARCHAR), 2, '0')) AS DATE)
 WHEN 1 THEN try_cast(concat('2024-03-', lpad(CAST(day AS VARCHAR), 2, '0')) AS DATE)
 WHEN 2 THEN try_cast(concat('2024-02-', lpad(CAST(day AS VARCHAR), 2, '0')) AS DATE) END, DATE '2024-07-01') AS age FROM x""")
def listing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in three languages, impossible ones null, and their age."""
    rows = views.details(spark, sf_dir).select("asin", fields.month_date(F.col("date_text")).alias("listed"))
    return rows.withColumn("age", fields.age_days(F.col("listed"), F.lit(AS_OF)).cast("long"))


@query(f"""WITH {WITH_DETAILS}, x AS (SELECT d.asin, p_type, p_brand, size, CAST(d.asin AS BIGINT) % 2 AS odd FROM details d JOIN part ON CAST(d.asin AS BIGINT) = p_partkey)
SELECT asin, CAST(CASE WHEN odd = 0 THEN size * 37 ELSE CAST(concat(size % 9 + 1, size * 7 + 100) AS INT) END AS INT) AS main_rank, p_type AS main_category,
CASE WHEN odd = 0 THEN size END AS sub_rank, CASE WHEN odd = 0 THEN 'Brand' END AS sub_category FROM x""")
def sales_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main and second sales rank from German and English texts."""
    ranks = views.details(spark, sf_dir).select("asin", fields.sales_ranks(F.col("ranks_text")).alias("ranks"))
    main, sub, _ = fields.split_ranks(F.col("ranks"))
    return ranks.select(
        "asin", main["rank"].alias("main_rank"), main["category"].alias("main_category"),
        sub["rank"].alias("sub_rank"), sub["category"].alias("sub_category"),
    )


@query(f"""WITH {WITH_DETAILS}, x AS (SELECT asin, size, CAST(asin AS BIGINT) % 4 AS k, CAST(asin AS BIGINT) % 3 AS m, CAST(asin AS BIGINT) % 2 AS o FROM details)
SELECT asin, CASE k WHEN 0 THEN 0 WHEN 1 THEN size + 0.99 WHEN 2 THEN size + 0.49 END::DOUBLE AS fee,
CASE m WHEN 0 THEN 'FBA' WHEN 1 THEN 'FBM' END AS fulfilment, CASE o WHEN 0 THEN 'China' ELSE 'Germany' END AS country FROM x""")
def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping fee, fulfilment and country of origin from texts."""
    rows = views.details(spark, sf_dir)
    return rows.select(
        "asin",
        fields.shipping_value(F.col("delivery_text")).alias("fee"),
        fields.fulfilment(F.col("merchant_text")).alias("fulfilment"),
        fields.country(F.col("origin_text")).alias("country"),
    )


def _typed_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.details(spark, sf_dir)
    main, sub, _ = fields.split_ranks(fields.sales_ranks(F.col("ranks_text")))
    choice, best = fields.badge_flags(F.concat(F.lit("Amazon's "), F.when(F.col("size") % 3 > 0, F.lit("Choice")).otherwise(F.lit("pick"))))
    return rows.select(
        "asin", "site", "item_weight", "item_dimensions", "size", "name",
        main["rank"].alias("bsr_main_rank"), main["category"].alias("bsr_main_category"), sub["rank"].alias("bsr_sub_rank"),
        F.lit(None).cast("int").alias("variant_option_count"), F.lit(None).cast("int").alias("other_sellers_count"),
        fields.shipping_value(F.col("delivery_text")).alias("shipping_fee_value"),
        fields.fulfilment(F.col("merchant_text")).alias("fulfillment_type"),
        fields.country(F.col("origin_text")).alias("country_of_origin"),
        fields.month_date(F.col("date_text")).alias("date_first_available"),
        choice.alias("is_amazon_choice"), best.alias("is_bestseller"),
    )


@query(f"""WITH {WITH_DETAILS}, x AS (SELECT asin, size, CAST(asin AS BIGINT) AS a FROM details)
SELECT asin FROM x WHERE CASE WHEN a % 2 = 0 THEN size * 37 ELSE CAST(concat(size % 9 + 1, size * 7 + 100) AS INT) END BETWEEN 100 AND 9000
AND CASE a % 4 WHEN 0 THEN size / 16 WHEN 1 THEN (size + 0.5) * 2.205 WHEN 2 THEN size * 10 * 0.0022 ELSE size + 0.25 END <= 60
AND CASE a % 3 WHEN 0 THEN greatest(size + 3, 2.5) / 2.54 WHEN 1 THEN greatest(size, 4) END <= 30
AND CASE a % 4 WHEN 0 THEN 0 WHEN 1 THEN size + 0.99 WHEN 2 THEN size + 0.49 END <= 40""")
def detail_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range, weight, size and shipping filters over detail fields."""
    bounds = filters.DetailFilter(
        bsr_main_min=100, bsr_main_max=9000, weight_max=60, dim_l=30, shipping_fee="custom", shipping_val=40
    )
    return _typed_details(spark, sf_dir).where(bounds.column()).select("asin")


@query(f"""WITH {WITH_DETAILS}, x AS (SELECT asin, size, size % 31 + 1 AS day, CAST(asin AS BIGINT) AS a FROM details)
SELECT asin FROM x WHERE a % 3 = 0 AND a % 2 = 0 AND size % 3 > 0 AND CASE a % 4 WHEN 0 THEN day <= 30 WHEN 2 THEN day <= 29 ELSE false END
AND CASE a % 4 WHEN 0 THEN make_date(2024, 6, least(day, 30)::INT) ELSE make_date(2024, 2, least(day, 29)::INT) END >= DATE '2024-02-10'""")
def detail_filter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fulfilment, country, badge and date filters over detail fields."""
    bounds = filters.DetailFilter(
        fulfillment_type="FBA", country="china", choice=True, date_from=dt.date(2024, 2, 10), date_to=dt.date(2024, 12, 31)
    )
    return _typed_details(spark, sf_dir).where(bounds.column()).select("asin")


@query(f"""WITH {WITH_SIGHTINGS}, f AS (SELECT CAST(p_partkey AS VARCHAR) AS asin, p_size FROM part)
SELECT list_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM sightings JOIN f USING (asin) WHERE p_size <= 30 GROUP BY list_type""")
def enriched_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings with detail fields, without items whose details fail."""
    details = _typed_details(spark, sf_dir).select("asin", "size")
    rows = sightings.enriched(views.sightings(spark, sf_dir), details, F.col("size") <= 30, ["size"])
    return rows.groupBy("list_type").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"))


# --- new arrivals ---------------------------------------------------------------


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = views.sightings(spark, sf_dir).select(
        "asin", "node_id", F.col("l_linenumber").alias("page_no"), F.col("l_orderkey").alias("idx")
    )
    nodes = views.view(spark, sf_dir, "SELECT DISTINCT p_brand AS node_id, p_brand AS name, 1 AS depth FROM {part}")
    details = _typed_details(spark, sf_dir).select(
        "asin", "site", F.col("date_first_available").alias("listing_date"), "bsr_main_rank",
        (F.col("size") % 20).alias("review_count"),
    )
    return arrivals.arrivals(arrivals.candidates(shown, nodes), details, F.lit(AS_OF), arrivals.ArrivalRules(signal_age_days=25))


_ARRIVALS = f"""{WITH_DETAILS}, x AS (SELECT asin, site, size, size % 31 + 1 AS day, CAST(asin AS BIGINT) AS a FROM details
  WHERE asin IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem)),
y AS (SELECT asin, site, size % 20 AS reviews, CASE WHEN a % 2 = 0 THEN size * 37 ELSE CAST(concat(size % 9 + 1, size * 7 + 100) AS INT) END AS main_rank,
  date_diff('day', CASE a % 4 WHEN 0 THEN try_cast(concat('2024-06-', lpad(CAST(day AS VARCHAR), 2, '0')) AS DATE)
   WHEN 1 THEN try_cast(concat('2024-03-', lpad(CAST(day AS VARCHAR), 2, '0')) AS DATE)
   WHEN 2 THEN try_cast(concat('2024-02-', lpad(CAST(day AS VARCHAR), 2, '0')) AS DATE) END, DATE '2024-07-01') AS age FROM x),
arr AS (SELECT *, coalesce(age <= 25, false) AND reviews < 10 AND main_rank <= 50000 AS signal FROM y WHERE coalesce(age <= 30, true) AND main_rank <= 200000)"""


@query(f"WITH {_ARRIVALS} SELECT site, count(*) AS total, count(*) FILTER (signal) AS signals FROM arr GROUP BY site")
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals and signals of each site."""
    return arrivals.signal_summary(_arrivals(spark, sf_dir))


@query(f"WITH {_ARRIVALS} SELECT asin, main_rank AS bsr_main_rank FROM arr WHERE signal ORDER BY main_rank, asin LIMIT 20")
def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.top_signals(_arrivals(spark, sf_dir)).select("asin", "bsr_main_rank")


@query(f"""WITH {WITH_SIGHTINGS}, {_ARRIVALS} SELECT 'sightings' AS stage, 0 AS place, count(*) AS n FROM sightings
UNION ALL SELECT 'accepted', 1, count(*) FROM arr UNION ALL SELECT 'signals', 2, count(*) FROM arr WHERE signal""")
def arrival_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir)
    stages = {"sightings": views.sightings(spark, sf_dir), "accepted": rows, "signals": rows.where("is_signal = 1")}
    return arrivals.funnel(stages)


# --- URLs and pages -------------------------------------------------------------


@query("""WITH u AS (SELECT page_id, url, regexp_replace(split_part(url, '?', 1), '/ref=.*$', '/') AS b FROM pages)
SELECT page_id, CASE WHEN b LIKE '%/' THEN b ELSE concat(b, '/') END AS normal, nullif(regexp_extract(url, '/([0-9]{3,})', 1), '') AS node_id,
 concat('https://shop.example/dp/', lpad(CAST(page_id AS VARCHAR), 10, '0')) AS item FROM u""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised URL, node id and item URL of every page."""
    pages = views.tables(spark, sf_dir)["pages"].select("page_id", "url")
    item = urls.item_url(F.lit("https://shop.example"), F.lpad(F.col("page_id").cast("string"), 10, "0"))
    return pages.select(
        "page_id", urls.normalize_url(F.col("url")).alias("normal"), urls.path_node_id(F.col("url")).alias("node_id"), item.alias("item")
    )


@query(f"""WITH {WITH_NODES} SELECT node_id, regexp_extract(url, '/gp/([a-z-]+)/', 1) AS list_type, regexp_extract(url, '/gp/[a-z-]+/([^/]+)/', 1) AS slug,
regexp_extract(url, '/([0-9]{{3,}})', 1) AS number FROM nodes""")
def node_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List, slug and number taken from node URLs."""
    url = F.col("url")
    return views.nodes(spark, sf_dir).select(
        "node_id", urls.list_of(url).alias("list_type"), urls.path_slug(url).alias("slug"), urls.path_node_id(url).alias("number")
    )


@query(r"""SELECT page_id, i - 1 AS pos, a[i] AS href FROM (
 SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages))""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every captured page, by the page reader."""
    return extract.page_links(views.tables(spark, sf_dir)["pages"]).select("page_id", "pos", "href")


@query(r"""SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM (
 SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.page_links(views.tables(spark, sf_dir)["pages"])
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


@query("""SELECT CASE WHEN page_id % 5 = 0 THEN 'error' WHEN page_id % 5 = 1 OR contains(lower(html), 'captcha') THEN 'captcha'
 WHEN NOT contains(html, '<article>') OR page_id % 5 = 2 THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM pages GROUP BY 1""")
def capture_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of captured pages, some of which were not captured, blocked or empty."""
    page, k = F.col("html"), F.col("page_id") % 5
    html = F.when(k == 0, None).when(k == 1, F.concat(page, F.lit(" Type the Characters"))).when(k == 2, F.replace(page, F.lit("<article>")))
    pages = views.tables(spark, sf_dir)["pages"].select(html.otherwise(page).alias("html"))
    items = F.regexp_count(F.col("html"), F.lit("<article>"))
    return pages.groupBy(filters.capture_status(F.col("html"), items).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) <> 0 THEN 1 ELSE 0 END AS truthy FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of a JSON text column, and its truthiness."""
    k = F.try_variant_get(F.try_parse_json(F.col("props")), "$.k", "int")
    rows = views.fetch_log(spark, sf_dir).select("event_id", k.alias("k"))
    return rows.withColumn("truthy", fields.truthy(F.col("k"), "int").cast("int"))


@query(f"""WITH {WITH_DETAILS}, u AS (SELECT asin, unnest([('item_weight', item_weight IS NOT NULL), ('item_dimensions', item_dimensions IS NOT NULL),
 ('delivery_text', delivery_text IS NOT NULL), ('merchant_text', merchant_text IS NOT NULL)]) AS e FROM details)
SELECT e[1] AS field, count(DISTINCT asin) FILTER (e[2]) AS n_docs, count(DISTINCT asin) AS of_docs,
concat(count(DISTINCT asin) FILTER (e[2]), '/', count(DISTINCT asin)) AS frequency FROM u GROUP BY e[1]""")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each field has a value."""
    rows = views.details(spark, sf_dir).select("asin", "item_weight", "item_dimensions", "delivery_text", "merchant_text")
    found = quality.coverage(quality.field_presence(rows, "asin"))
    return found.select("field", "n_docs", "of_docs", "frequency")


# --- streaming ------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as five files in order of time, a file each batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    where = tables.shared_dir(spark, "events")
    jobs.replay(jobs.by_time(events, "ts", 5), where)
    return jobs.stream_of(spark, where, events.schema, files_per_batch=1)


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS n FROM events) WHERE n = 1""")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream that comes twice, each once, with state inside the watermark only."""
    twice = _event_stream(spark, sf_dir).unionByName(_event_stream(spark, sf_dir))
    first = jobs.first_in_window(twice, "event_id", "ts", "1 day")
    where = tables.shared_dir(spark, "stream")
    return jobs.drain(first.select("user_id", "event_id", "event_type"), where, f"{where}-checkpoint")


@query("""SELECT page_id, pos - 1 AS pos, asin FROM (SELECT page_id, unnest(a) AS asin, generate_subscripts(a, 1) AS pos FROM (
 SELECT page_id, list_distinct(regexp_extract_all(html, '/dp/([A-Z0-9]{10})', 1)) AS a FROM pages))""")
def stream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of arriving pages, as a stream."""
    path = f"{sf_dir}/pages.parquet"
    pages = jobs.stream_of(spark, path, spark.read.parquet(path).schema)
    where = tables.shared_dir(spark, "stream")
    return jobs.drain(jobs.item_stream(pages), where, f"{where}-checkpoint")
