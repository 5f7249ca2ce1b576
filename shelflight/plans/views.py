"""Views that bind the driver's tables to the catalogue model.

Each view is one SQL text that Spark and DuckDB both run: Spark with its input
frames in the braces, DuckDB with the tables' names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

#: Category tree: regions, nations, customers and suppliers, orders. Some parents are blank, some flags null.
NODES = """
SELECT node_id, name, depth,
       CASE WHEN depth = 1 AND k % 11 = 10 THEN '' ELSE parent END AS parent_node_id, site,
       concat('s-', CAST(k % 7 AS STRING)) AS slug,
       concat('https://shop.example/gp/', CASE WHEN k % 2 = 0 THEN 'bestsellers' ELSE 'new-releases' END,
              '/s-', CAST((k + depth) % 9 AS STRING), '/', CAST(k + 1000 AS STRING), '/') AS url,
       CASE WHEN k % 4 = 0 THEN 'breadcrumb' ELSE 'sidebar' END AS source,
       CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS explored,
       CASE WHEN k % 3 < 2 THEN CAST(k % 3 AS INT) END AS nr_valid,
       CASE WHEN k % 4 < 2 THEN CAST(k % 4 AS INT) END AS bs_valid,
       CASE WHEN k % 5 < 2 THEN CAST(k % 5 AS INT) END AS ms_valid,
       CASE WHEN k % 6 < 2 THEN CAST(k % 6 AS INT) END AS mw_valid,
       CASE WHEN k % 7 < 2 THEN CAST(k % 7 AS INT) END AS na_valid
FROM (
  SELECT concat('R', CAST(r_regionkey AS STRING)) AS node_id, r_name AS name, 0 AS depth,
         CAST(NULL AS STRING) AS parent, r_name AS site, CAST(r_regionkey AS BIGINT) AS k
  FROM {region}
  UNION ALL
  SELECT concat('N', CAST(n_nationkey AS STRING)), n_name, 1, concat('R', CAST(n_regionkey AS STRING)), r_name,
         CAST(n_nationkey AS BIGINT)
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
  UNION ALL
  SELECT concat('C', CAST(c_custkey AS STRING)), c_name, 2, concat('N', CAST(c_nationkey AS STRING)), r_name, c_custkey
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  UNION ALL
  SELECT concat('S', CAST(s_suppkey AS STRING)), s_name, 2, concat('N', CAST(s_nationkey AS STRING)), r_name, s_suppkey
  FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  UNION ALL
  SELECT concat('O', CAST(o_orderkey AS STRING)), concat('Order ', o_orderpriority), 3,
         concat('C', CAST(o_custkey AS STRING)), r_name, o_orderkey
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  JOIN {region} ON n_regionkey = r_regionkey
) base
"""

#: Sightings of parts on three lists.
SIGHTINGS = """
SELECT CAST(l_partkey AS STRING) AS asin, p_name AS name, l_extendedprice AS price, l_discount * 50 AS rating,
       CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS review_count,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS rank, p_brand AS node_id, p_type AS category_name,
       l_returnflag AS list_type, l_shipdate AS scraped_at, l_orderkey, l_linenumber, l_suppkey, l_linestatus
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

#: Texts of detail pages, made from the parts and line items in the sites' languages and units.
DETAILS = """
SELECT CAST(p_partkey AS STRING) AS asin,
       CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'JP' WHEN 3 THEN 'UK' ELSE 'FR' END AS site,
       CASE WHEN p_partkey % 2 = 0
            THEN concat('#', CAST(p_size * 37 AS STRING), ' in ', p_type, ' (See Top 100) #', CAST(p_size AS STRING), ' in ', p_brand)
            ELSE concat('Nr. ', CAST(p_size % 9 + 1 AS STRING), '.', CAST(p_size * 7 + 100 AS STRING), ' in ', p_type, ' (Top 100)')
       END AS ranks_text,
       CASE CAST(p_partkey % 4 AS INT)
            WHEN 0 THEN concat(CAST(p_size AS STRING), ' ounces') WHEN 1 THEN concat(CAST(p_size AS STRING), ',5 kg')
            WHEN 2 THEN concat(CAST(p_size * 10 AS STRING), 'g') ELSE concat(CAST(p_size AS STRING), '.25 Pounds') END AS item_weight,
       CASE CAST(p_partkey % 3 AS INT)
            WHEN 0 THEN concat(CAST(p_size AS STRING), ' x ', CAST(p_size + 3 AS STRING), ' x 2,5 cm')
            WHEN 1 THEN concat('4 x ', CAST(p_size AS STRING), ' inches') END AS item_dimensions,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'FREE delivery Friday'
            WHEN 1 THEN concat('Lieferung für ', CAST(p_size AS STRING), ',99 €')
            WHEN 2 THEN concat('$', CAST(p_size AS STRING), '.49 delivery') END AS delivery_text,
       CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'Versand durch Amazon' WHEN 1 THEN concat('Sold by ', p_brand) END AS merchant_text,
       concat('Country of Origin: ', CASE WHEN p_partkey % 2 = 0 THEN 'China' ELSE 'Germany' END) AS origin_text,
       CASE CAST(p_partkey % 4 AS INT)
            WHEN 0 THEN concat('Date First Available ‏ : ‎ June ', CAST(p_size % 31 + 1 AS STRING), ', 2024')
            WHEN 1 THEN concat('Datum der Ersten ', CAST(p_size % 31 + 1 AS STRING), '. März 2024')
            WHEN 2 THEN concat('発売日 2024/2/', CAST(p_size % 31 + 1 AS STRING)) ELSE 'Date unknown' END AS date_text,
       CASE WHEN p_partkey % 5 IN (1, 4) THEN concat(CAST(p_size AS STRING), '.', CAST(100 + p_partkey % 900 AS STRING), ',50 EUR')
            ELSE concat('$', CAST(p_size AS STRING), ',', CAST(100 + p_partkey % 900 AS STRING), '.50') END AS price_text,
       CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '4.2 out of 5 stars' WHEN 1 THEN '4,2 von 5 Sternen' WHEN 2 THEN '5つ星のうち4.1'
            WHEN 3 THEN concat(CAST(p_size % 5 AS STRING), '.5 out of 5') ELSE '3,9 sur 5' END AS rating_text,
       CASE WHEN p_partkey % 3 = 0 THEN concat('(', CAST(p_size AS STRING), ',', CAST(100 + p_partkey % 900 AS STRING), ')')
            ELSE CAST(p_size AS STRING) END AS review_text,
       p_name AS name, p_brand AS brand, p_size AS size
FROM {part}
"""


#: Ranked-list pages in two layouts: two cards of items and one without a link.
CHART_PAGES = f"""
SELECT CAST(asin AS BIGINT) AS page_id, 'https://shop.example/gp/bestsellers/' AS url, site,
       concat(open1, '<a href="/Thing/dp/B', lpad(asin, 9, '0'), '/ref=z"><span><div>', name, '</div></span></a><img src="i', asin, '.png">',
              '<span class="zg-badge-text">#', CAST(size AS STRING), '</span><span class="a-price"><span class="a-offscreen">', price_text,
              '</span></span><i class="a-icon-alt">', rating_text, '</i><a class="a-size-small" href="#r"><span>1,',
              CAST(size + 100 AS STRING), '</span></a>',
              CASE CAST(k % 4 AS INT) WHEN 0 THEN '<span class="a-badge" data-a-badge-type="best-seller">Best Seller</span>'
                   WHEN 1 THEN '<span class="a-badge" data-a-badge-type="amazons-choice">x</span>' ELSE '' END,
              CASE CAST(k % 3 AS INT) WHEN 0 THEN concat('<b class="x zg-percent-change">+', CAST(size AS STRING), '%</b><i>9%</i>')
                   WHEN 1 THEN concat('<span>up</span><span>+', CAST(size * 2 AS STRING), '%</span>') ELSE '' END, '</div>',
              open2, '<a href="https://shop.example/dp/C', lpad(asin, 9, '0'), '"><div class="p13n-sc-truncate">', brand,
              '</div></a><span class="x-sc-price">none</span></div>', open3, '<a href="/nothing">x</a></div>',
              CASE CAST(k % 2 AS INT) WHEN 0 THEN CASE site WHEN 'DE' THEN '1.234 Ergebnisse' WHEN 'JP' THEN '1,234 件中'
                   WHEN 'FR' THEN '1 234 résultats' ELSE '1-48 of 1,234 results' END ELSE '' END) AS html
FROM (SELECT asin, site, name, brand, size, price_text, rating_text, CAST(asin AS BIGINT) AS k,
             CASE WHEN CAST(asin AS BIGINT) % 3 = 0 THEN '<div class="zg-grid-general-faceout">' ELSE '<div id="gridItemRoot1">' END AS open1,
             CASE WHEN CAST(asin AS BIGINT) % 3 = 0 THEN '<div class="zg-grid-general-faceout">' ELSE '<div id="gridItemRoot2">' END AS open2,
             CASE WHEN CAST(asin AS BIGINT) % 3 = 0 THEN '<div class="zg-grid-general-faceout">' ELSE '<div id="gridItemRoot3">' END AS open3
      FROM ({DETAILS}) d) cards
"""

#: Search pages: none to three results, a next control, a sort control, and pages that are no results.
SEARCH_PAGES = """
SELECT p_partkey AS page_id, concat('https://shop.example/s?page=', CAST(p_partkey AS STRING)) AS url,
       CASE CAST(p_partkey % 11 AS INT) WHEN 1 THEN NULL WHEN 2 THEN 'Type the characters you see' WHEN 3 THEN '<p>Leider keine Ergebnisse</p>'
            WHEN 4 THEN 'try api-services'
            ELSE concat('<div class="a-spacing-small"><span>', CAST(p_size AS STRING), ' results</span></div>',
              CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('<select id="s-result-sort-select"><option value="relevance">r</option>',
                   CASE WHEN p_partkey % 2 = 0 THEN '<option value="date-desc-rank">n</option>' ELSE '' END, '</select>') END,
              CASE WHEN p_size % 4 >= 1 THEN concat('<div data-component-type="s-search-result" data-asin="B', lpad(CAST(p_partkey AS STRING), 9, '0'),
                   '"><a href="/x#customerReviews">(', CAST(p_size AS STRING), ')</a></div>') ELSE '' END,
              '<div data-component-type="s-search-result" data-asin=" "></div>',
              CASE WHEN p_size % 4 >= 2 THEN '<div data-component-type="s-search-result" data-asin="B999999999"></div>' ELSE '' END,
              CASE WHEN p_size % 4 >= 3 THEN '<div data-component-type="s-search-result" data-asin="B888888888"><span class="a-size-base s-underline-text">7</span></div>' ELSE '' END,
              CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '<a class="s-pagination-next">Next</a>'
                   WHEN 1 THEN '<a class="s-pagination-next s-pagination-disabled">Next</a>' ELSE '' END) END AS html
FROM {part}
"""

#: Detail pages that hold the texts of DETAILS in their blocks.
DETAIL_PAGES = f"""
SELECT k AS page_id, concat('https://shop.example/dp/B', lpad(asin, 9, '0')) AS url, site,
       concat('<span id="productTitle"> ', name, ' </span><a id="bylineInfo" href="', CASE WHEN k % 2 = 0 THEN '/stores/x' ELSE '/b' END, '">Visit ', brand, '</a>',
              '<div id="corePrice_feature_div"><span class="a-price"><span class="a-offscreen">', price_text, '</span></span></div>',
              '<div id="acrPopover"><i class="a-icon-alt">', rating_text, '</i></div><span id="acrCustomerReviewText">', review_text, '</span>',
              '<div id="prodDetails"><table>',
              CASE WHEN k % 2 = 0 THEN '<tr><th>Item Weight</th><td>' ELSE '<tr><th>Artikelgewicht</th><td>' END, item_weight, '</td></tr>',
              CASE WHEN item_dimensions IS NULL THEN '' ELSE concat('<tr><th>Item Dimensions</th><td>', item_dimensions, '</td></tr>') END,
              '<tr><td>', origin_text, '</td></tr><tr><td>Date First Available ', date_text, '</td></tr><tr><th>Manufacturer :</th><td>', brand,
              '</td></tr><tr><th>Best Sellers Rank</th><td>', ranks_text, '</td></tr></table></div>',
              CASE WHEN merchant_text IS NULL THEN '' ELSE concat('<div id="merchant-info">', merchant_text, '</div>') END,
              CASE WHEN delivery_text IS NULL THEN '' ELSE concat('<div id="deliveryBlockMessage">', delivery_text, '</div>') END,
              CASE CAST(k % 4 AS INT) WHEN 0 THEN '<div id="zeitgeistBadge_feature_div">#1 Best Seller in Rings</div>'
                   WHEN 1 THEN '<span class="a-badge" data-a-badge-type="amazons-choice">x</span>' ELSE '' END,
              '<div id="twister_feature_div"><span class="a-form-label">Size:</span><ul>', repeat('<li data-defaultasin="x">', CAST(size % 3 AS INT)), '</ul></div>',
              CASE WHEN k % 3 < 2 THEN concat('<div id="olp_feature_div">', CAST(size % 5 + 1 AS STRING), ' new from here</div>') ELSE '' END,
              '<ul id="wayfinding-breadcrumbs_feature_div"><li><a href="/b?node=', CAST(k + 100 AS STRING), '">', name, '</a><li><a href="/b?node=',
              CAST(size + 7 AS STRING), '">', brand, '</a><li><a>none</a></ul>',
              '<div id="feature-bullets"><ul>', repeat('<li><span class="a-list-item">A point</span></li>', CAST(size % 4 AS INT)), '</ul></div>',
              CASE WHEN k % 5 = 0 THEN '<div id="sims-fbt"></div>' ELSE '' END, CASE WHEN k % 7 = 0 THEN '<div id="x-ComparisonTable-1">t</div>' ELSE '' END,
              CASE WHEN k % 3 = 0 THEN '<div id="returnsInfoFeature_feature_div">30 days</div>' ELSE '' END,
              CASE WHEN k % 2 = 0 THEN concat('<script type="application/ld+json">', chr(123), '"@type": "Product"', chr(125), '</script>') ELSE '' END,
              '<input id="ASIN" value="B', lpad(asin, 9, '0'), '"><div id="productDescription">', repeat('text ', CAST(size % 6 AS INT)), '</div>') AS html
FROM (SELECT *, CAST(asin AS BIGINT) AS k FROM ({DETAILS}) d) e
"""

#: Ranked-list pages of customers: side bar with an up link, repeated, numeric and foreign children; a root list; five pages each.
TREE_PAGES = """
SELECT c_custkey * 5 + p AS page_id, c_custkey AS node, CAST(p AS INT) AS page_no, concat('https://shop.example/gp/bestsellers/s-1/', CAST(c_custkey + 1000 AS STRING), '/') AS url,
       concat('<h1>Best Sellers in ', c_mktsegment, '</h1><ul class="x-zg-browse-root"><li class="browse-up"><a href="/gp/bestsellers/">Any</a></li><li>',
              CASE WHEN c_custkey % 3 = 0 THEN '<i></i>' ELSE concat('<span class="zg-selected">', c_name, '</span>') END,
              '</li><li><ul class="zg-browse-group"><li><a href="/gp/bestsellers/s-1/', CAST(c_custkey + 2000 AS STRING), '/ref=zz?x=1">First</a></li>',
              '<li><a href="/gp/bestsellers/s-1/', CAST(c_custkey + 2000 AS STRING), '/">Again</a></li><li><a href="/gp/bestsellers/s-1/99999">12345</a></li>',
              '<li><a href="/zgbs/books/', CAST((c_custkey * 3 + p) % 700 + 5000 AS STRING), '">Books</a></li>',
              '<li><a href="https://other.example/page/">Elsewhere</a></li></ul></li></ul>') AS html
FROM {customer} CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ps
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def view(spark: SparkSession, sf_dir: str, sql: str, parts: int | None = None) -> DataFrame:
    """The view over the tables it names, these dealt out to ``parts`` tasks first if given."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **{t: df.repartition(parts) if parts else df for t, df in used.items()})


def duckdb_sql(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, NODES)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SIGHTINGS)


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DETAILS)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, ok): fetches that succeeded or failed."""
    return view(
        spark, sf_dir, "SELECT event_id, ts, user_id, event_type <> 'error' AS ok, value, props FROM {events}"
    )


#: The same views as WITH clauses for DuckDB.
WITH_NODES = "nodes AS (" + duckdb_sql(NODES) + ")"
WITH_SIGHTINGS = "sightings AS (" + duckdb_sql(SIGHTINGS) + ")"
WITH_DETAILS = "details AS (" + duckdb_sql(DETAILS) + ")"
