import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelflight.functions import fields
from shelflight.operators import extract, filters, quality
from shelflight.plans import captures, catalogue, views
from shelflight.schema import with_locale
from shelflight.streaming import jobs

CHART = """<div id="gridItemRoot1"><a href="/Thing/dp/B000000001/ref=x"><span><div>Thing one</div></span></a><img src="i.png">
<span class="zg-badge-text">#7</span><span class="a-price"><span class="a-offscreen">$1,019.50</span></span>
<i class="a-icon-alt">4.5 out of 5 stars</i><a class="a-size-small" href="#"><span>1,234</span></a>
<span class="a-badge" data-a-badge-type="best-seller">Best Seller</span></div>
<div id="gridItemRoot2"><a href="https://shop.example/dp/B000000002"><div class="p13n-sc-truncate">Thing two</div></a>
<span class="a-price"><span class="a-offscreen">none</span></span></div><div id="gridItemRoot3"><a href="/nothing">x</a></div>"""
SEARCH = """<div data-component-type="s-search-result" data-asin="B000000001"><a href="/x#customerReviews">(1.234)</a></div>
<div data-component-type="s-search-result" data-asin=" "></div><div data-component-type="s-search-result" data-asin="B000000002">
<span class="a-size-base s-underline-text">7</span></div><a class="s-pagination-next">Next</a>"""
DETAIL = """<span id="productTitle"> A thing </span><div id="corePrice_feature_div"><span class="a-offscreen">12,50 €</span></div>
<span id="acrCustomerReviewText">2.121 Bewertungen</span><div id="acrPopover"><i class="a-icon-alt">4,2 von 5</i></div>
<div id="prodDetails"><table><tr><th>Item Weight</th><td>0.81 Pounds</td></tr><tr><th>Date First Available</th><td>June 13, 2026</td></tr>
<tr><th>Item Dimensions</th><td>4 x 5 x 6 inches</td></tr><tr><th>Country of Origin</th><td>: China</td></tr>
<tr><th>Best Sellers Rank</th><td>#19 in Patio, Lawn &amp; Garden (See Top 100)<br> #2 in Garden Hoses</td></tr></table></div>
<div id="merchant-info">Fulfilled by Amazon</div><div id="deliveryBlockMessage">FREE delivery</div>
<ul id="wayfinding-breadcrumbs_feature_div"><li><a href="/b?node=11">Garden</a><li><a href="/b?node=22">Hoses</a><li><a>none</a></ul>
<script type="application/ld+json">{"@type": "Product"}</script><div id="twister_feature_div"><ul><li data-defaultasin="x"><li data-defaultasin="y"></ul></div>"""
SIDEBAR = """<h1>Best Sellers in Garden</h1><ul class="x-zg-browse-root"><li class="browse-up"><a href="/gp/bestsellers/">Any</a></li>
<li><span class="zg-selected">Garden</span></li><li><ul class="zg-browse-group"><li><a href="/gp/bestsellers/garden/1234/ref=zz?x=1">Hoses</a></li>
<li><a href="/gp/bestsellers/garden/1234/">Hoses again</a></li><li><a href="/gp/bestsellers/garden/99999">12345</a></li>
<li><a href="/gp/bestsellers/books/5678/">Books</a></li></ul></li></ul>"""


def _pages(spark, *htmls):
    return spark.createDataFrame([(i, f"http://p/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_chart_rows(spark):
    cards = extract.chart_cards(_pages(spark, CHART, None, "")).withColumn("site", F.lit("US"))
    one, two = extract.chart_rows(with_locale(cards), F.lit("https://shop.example")).orderBy("idx").collect()
    assert (one.asin, one["rank"], one.price, one.rating, one.review_count, one.is_bestseller, one.name) == ("B000000001", 7, 1019.5, 4.5, 1234, 1, "Thing one")
    assert one.product_url == "https://shop.example/Thing/dp/B000000001/ref=x" and one.n_cards == 3
    assert (two.asin, two["rank"], two.price, two.review_count, two.name) == ("B000000002", None, None, None, "Thing two")
    movers = extract.mover_cards(_pages(spark, CHART.replace("Best Seller", "+55%"))).collect()
    assert movers[0].percent_change == "+55%" and movers[1].percent_change is None


def test_search_rows(spark):
    pages = _pages(spark, SEARCH, "captcha", "<p>")
    cards = extract.search_cards(pages)
    rows = cards.orderBy("idx").collect()
    assert [(r.asin, r.review_text, r.has_next) for r in rows] == [("B000000001", "(1.234)", True), ("B000000002", "7", True)]
    got = {r.page_id: (r.status, r["count"], r.has_next) for r in extract.search_status(pages, cards).collect()}
    assert got == {0: ("ok", 2, True), 1: ("captcha", 0, False), 2: ("empty", 0, False)}


def test_detail_rows(spark):
    blocks = extract.detail_blocks(_pages(spark, DETAIL, "<p>nothing"))
    one, two = extract.detail_fields(blocks).orderBy("page_id").collect()
    assert (one.bsr_main_rank, one.bsr_main_category, one.bsr_sub_rank, one.bsr_sub_category) == (19, "Patio, Lawn & Garden", 2, "Garden Hoses")
    assert (one.item_weight, one.date_first_available, one.country_of_origin) == ("0.81 Pounds", dt.date(2026, 6, 13), "China")
    assert (one.item_dimensions, one.variant_option_count, one.fulfillment_type, one.shipping_fee_value) == ("4 x 5 x 6 inches", 2, "FBA", 0.0)
    assert two.bsr_main_rank is None and two.fulfillment_type is None and two.shipping_fee is None
    arrival = extract.arrival_fields(blocks, F.lit(",")).orderBy("page_id").first()
    assert (arrival.price_value, arrival.review_count, arrival.rating, arrival.listing_date) == (12.5, 2121, 4.2, dt.date(2026, 6, 13))
    assert [(r["rank"], r.category) for r in arrival.bsr_sub] == [(2, "Garden Hoses")]
    record = extract.inventory(blocks).orderBy("page_id").first()
    assert record.ranks.bsr_main_rank == 19 and record.json_ld_type == "Product" and record.attributes["Item Weight"] == "0.81 Pounds"
    assert [r.field for r in quality.field_presence(extract.inventory(blocks), "page_id").where("n_docs > 0").orderBy("field").collect()][:1] == ["attributes"]


def test_tree_pages(spark):
    pages = _pages(spark, SIDEBAR, "<p>")
    rows = extract.sidebar_children(pages, F.lit("https://shop.example")).orderBy("pos").collect()
    assert [(r.name, r.child_url, r.node_id, r.slug) for r in rows] == [
        ("Hoses", "https://shop.example/gp/bestsellers/garden/1234/", "1234", "garden"),
        ("Books", "https://shop.example/gp/bestsellers/books/5678/", "5678", "books"),
    ]
    crumbs = extract.breadcrumb_rows(_pages(spark, DETAIL)).orderBy("pos").collect()
    assert [(r.pos, r.name, r.node_id) for r in crumbs] == [(0, "Garden", "11"), (1, "Hoses", "22")]
    assert {(r.slug, r.skipped) for r in extract.root_slugs(pages).collect()} == {("garden", False), ("books", True)}
    assert {r.page_id: r.name for r in extract.root_name(pages).collect()}[0] == "Garden"
    assert [r.asin for r in extract.page_items(_pages(spark, CHART), 1).collect()] == ["B000000001"]
    assert filters.search_card_gate(F.lit(5), 0) is not None


def test_sql_table_functions(spark):
    extract.register_table_functions(spark)
    _pages(spark, DETAIL, None).createOrReplaceTempView("captured")
    rows = spark.sql("SELECT page_id, pos, name FROM captured, LATERAL page_crumbs(html) ORDER BY pos").collect()
    assert [(r.page_id, r.pos, r.name) for r in rows] == [(0, 0, "Garden"), (0, 1, "Hoses"), (0, 2, "none")]
    assert spark.sql("SELECT * FROM captured, LATERAL page_links(html)").count() == 2


def test_streams(spark, tmp_path):
    schema = "key string, event_id long, ts timestamp, ok boolean"
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    batches = [[("a", 1, at(1), False), ("a", 2, at(2), False), ("b", 3, at(3), True)], [("a", 4, at(4), False), ("a", 5, at(5), True), ("a", 6, at(6), False), ("b", 7, at(7), False)]]
    source = str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    events = jobs.stream_of(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    got = jobs.drain(jobs.failure_streaks(events, threshold=3), str(tmp_path / "out"), str(tmp_path / "cp"))
    streaks = {r.event_id: (r.streak, r.tripped) for r in got.collect()}
    assert streaks == {1: (1, False), 2: (2, False), 3: (0, False), 4: (3, True), 5: (0, False), 6: (1, False), 7: (1, False)}
    again = jobs.drain(jobs.failure_streaks(events, threshold=3), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert again.count() == 7  # the checkpoint resumes: nothing is read twice
    windows = jobs.counters(events, "ts", "5 seconds", "0 seconds", F.col("ok"))
    first = jobs.drain(windows, str(tmp_path / "w"), str(tmp_path / "wcp")).orderBy("start").first()
    assert (first.start, first.n, first.failed) == (at(0), 4, 3)
    days = jobs.daily_latest(events, "key", "ts", "event_id", "1 hour")
    assert days.schema.names == ["snapshot_date", "key", "event_id", "seen_at"]
    target = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, at(1), False)], schema).write.parquet(f"{target}/batch-base")
    write = jobs.insert_batches(target, ["event_id"], ["ts"])
    jobs.flush(events, write, str(tmp_path / "fcp")).awaitTermination()
    read = lambda: spark.read.option("recursiveFileLookup", True).parquet(target)
    assert read().count() == 7
    write(spark.createDataFrame(batches[1], schema), 1)  # a batch that comes twice
    assert read().count() == 7
    counts = spark.createDataFrame([("p", 2)], "node_id string, child_count long")
    changes = spark.createDataFrame([("p", "insert"), ("p", "delete"), ("p", "delete"), ("q", "insert"), (None, "insert")], "parent_node_id string, op string")
    assert {r.node_id: r.child_count for r in jobs.count_deltas(changes, counts).collect()} == {"p": 1, "q": 1}
    stale = jobs.stale_keys(spark.createDataFrame(batches[0], schema), "key", "ts", F.lit(at(59)) + F.expr("interval 5 seconds"))
    assert {r.key: r.stale for r in stale.collect()} == {"a": True, "b": True}


def test_item_query_lists_all_items_of_a_page(spark, tmp_path):
    items = [f"B{i:09d}" for i in range(12)]
    html = " ".join(f'<a href="/dp/{i}">x</a>' for i in [*items, items[0]])
    spark.createDataFrame([(1, html), (2, "none")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.stream_items(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.pos, r.asin) for r in got) == [(1, n, i) for n, i in enumerate(items)]


def test_deeply_nested_pages_do_not_end_a_job(spark):
    deep = "<span>" * 5000 + '<a href="/dp/B000000001">x</a>'
    rows = extract.page_links(_pages(spark, deep, None, "<p>" * 3000)).collect()
    assert [(r.page_id, r.href) for r in rows] == [(0, "/dp/B000000001")]
    assert extract.detail_blocks(_pages(spark, deep)).first().title is None


def test_first_of_several_tests_wins():
    page = extract.read_page('<b id="one">1</b><i id="two">2</i>')
    is_tag = lambda t: lambda e: e.tag == t
    assert page.find(is_tag("i"), is_tag("b")).get("id") == "two"
    assert page.find(is_tag("u"), is_tag("b"), is_tag("i")).get("id") == "one" and page.find(is_tag("u")) is None


def test_all_extractors_are_table_functions(spark):
    extract.register_table_functions(spark)
    _pages(spark, CHART, SEARCH, DETAIL, SIDEBAR).createOrReplaceTempView("all_pages")
    count = lambda f: spark.sql(f"SELECT page_id FROM all_pages, LATERAL {f}(html)").count()
    assert {f: count(f) for f in extract.EXTRACTORS} == {
        "page_links": 12, "page_crumbs": 3, "page_cards": 2, "page_movers": 3, "page_results": 2, "page_blocks": 4,
        "page_children": 4, "page_root_links": 5, "page_headings": 4,
    }
    row = spark.sql("SELECT title, blocks['merchant-info'] AS m FROM all_pages, LATERAL page_blocks(html) WHERE page_id = 2").first()
    assert (row.title, row.m) == ("A thing", "Fulfilled by Amazon")


def test_insert_into_a_table_that_is_not_there_yet(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, n int")
    write = jobs.insert_batches(f"file://{tmp_path}/none", ["k"], ["n"])
    write(batch, 0)
    write(batch, 0)
    write(batch.where("k = 'a'"), 1)
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/none").collect()
    assert sorted((r.k or "", r.n) for r in got) == [("", 3), ("a", 1)]


def test_counts_over_batches(spark, tmp_path):
    path = f"file://{tmp_path}/counts"
    write = jobs.keep_counts(path)
    batch = lambda *rows: spark.createDataFrame(rows, "parent_node_id string, op string")
    write(batch(("a", "insert"), ("a", "insert"), ("b", "delete")), 0)
    write(batch(("a", "delete"), ("b", "insert")), 1)
    write(batch(("a", "delete"), ("b", "insert")), 1)  # comes twice
    assert {r.node_id: r.child_count for r in jobs.kept_counts(spark, path).collect()} == {"a": 1, "b": 0}
    assert jobs.kept_counts(spark, f"file://{tmp_path}/none").count() == 0


def test_pages_made_to_be_slow():
    """End tags without a start, open elements of great depth, and many blocks inside each other."""
    import time

    for html in ("</b>" * 100_000, "<ul><li>" + "<span>" * 100_000 + "</p>" * 10_000 + "<li>" * 1000, "<div class='a-price'>" * 20_000 + "<i class='a-offscreen'>" * 20_000):
        began = time.process_time()
        for name in ("page_blocks", "page_cards", "page_children"):
            list(extract.EXTRACTORS[name][0](extract.read_page(html), html))
        assert time.process_time() - began < 20


def test_elements_by_key():
    """Found by id, class and tag as by a walk; inside only what an element holds."""
    page = extract.read_page("<div id=a class='x y'><p class=y>1<p id=a>2</div><p class='x'>3<img class=y></p></div>")
    own = lambda test: [(e.tag, e.order) for e in page.all(test)]
    for keyed, plain in (
        (extract.has_id("a"), lambda e: e.get("id") == "a"),
        (extract.has_class("x", "y"), lambda e: {"x", "y"} & set(e.classes())),
        (extract.is_tag("p", "img"), lambda e: e.tag in ("p", "img")),
    ):
        assert own(keyed) == own(lambda e, t=plain: bool(t(e)))
    within = extract.inside(extract.has_id("a"), extract.is_tag("p"))
    assert own(within) == [("p", 2), ("p", 3)]
    assert page.all(extract.has_class("x"))[1].find(extract.has_class("y")).tag == "img"
    assert page.find(extract.has_id("none"), extract.is_tag("img")).tag == "img" and page.find(extract.has_id("none")) is None


def test_table_functions_over_pages(spark):
    extract.register_table_functions(spark)
    _pages(spark, CHART, SEARCH, DETAIL, SIDEBAR).createOrReplaceTempView("all_pages")
    for name, own in extract.PAGE_FUNCTIONS.items():
        by_table = spark.sql(f"SELECT * FROM {name}(TABLE(all_pages) PARTITION BY page_id)").drop("url")
        by_page = spark.sql(f"SELECT page_id, f.* FROM all_pages, LATERAL {own}(html) f")
        assert sorted(map(tuple, by_table.collect()), key=repr) == sorted(map(tuple, by_page.collect()), key=repr)


def _dump(root):
    return [
        (e.tag, e.attrs, e.last, e.parent.order if e.parent else None, [c if isinstance(c, str) else c.order for c in e.content])
        for e in root.page.elements
    ]


PLAIN = [
    "<!DOCTYPE html><div id='a' CLASS=\"b  c\">x &amp; y<br/><img src=\"i?a=1&amp;b=2\" />z<!-- - c --></div>",
    "<ul><li>a<li>b<ul><li>c</ul><li disabled>d</ul></b><p>e<p>f<script type='t'>{'k': 1 && 2}</script><option>g<option>h &lt",
    "<table><tr><th>a<td>b<tr><td>c</table>&#65;<h1\n class='k'>t</h1 ><style>p > q</STYLE>",
]
ODD = ["<a href=x>y</a>", "<b a = 'c'>", "<div id='a'id='b'>", "<!x>y", "<?p>y", "a < b", "<script>if (a < b) {}</script>c", "<a", "</ div>", "<script>x", "<!-->y-->"]


@pytest.mark.parametrize("html", PLAIN + ODD)
def test_plain_markup_is_read_as_by_the_parser(html):
    """One pattern reads plain markup; both readers build the same elements, and what is not plain goes to the parser."""
    one, two = extract._Reader(), extract._Reader()
    assert extract._read_plain(html, one) == (html in PLAIN)
    two.feed(html)
    two.close()
    assert _dump(extract.read_page(html)) == _dump(two.whole())
    if html in PLAIN:
        assert _dump(one.whole()) == _dump(two.whole())


def test_a_page_leaves_nothing_to_the_collector():
    """Elements hold each other; when a page is done they are freed at once."""
    import gc

    gc.collect()
    gc.disable()
    try:
        assert [list(extract._found(extract._links, "<ul><li><a href='/x'>y</a></ul>")) for _ in range(2)]
        assert not [o for o in gc.get_objects() if isinstance(o, extract.Element)]
    finally:
        gc.enable()


def test_detail_fields_from_the_blocks_they_read(spark):
    """The same fields from those blocks as from all."""
    pages = _pages(spark, DETAIL, "<p>nothing</p>", None)
    few, every = extract.detail_blocks(pages, ("page_id",), extract.FIELD_BLOCKS), extract.detail_blocks(pages, ("page_id",))
    assert set(few.columns) == {"page_id", *extract.FIELD_BLOCKS}
    shown = [c for c in extract.detail_fields(few).columns]
    assert extract.detail_fields(few).collect() == extract.detail_fields(every).select(*shown).collect()
    few = extract.detail_blocks(pages, ("page_id",), extract.ARRIVAL_BLOCKS)
    shown = [c for c in extract.arrival_fields(few, F.lit(".")).columns]
    assert extract.arrival_fields(few, F.lit(".")).collect() == extract.arrival_fields(every, F.lit(".")).select(*shown).collect()


def test_amounts_are_computed_once(spark):
    """A text is searched once for its amount and once for its size, however often these are named."""
    rows = spark.range(1).select(F.col("id").cast("string").alias("t"))
    for column, most in ((fields.shipping_text(F.col("t")), 5), (fields.dimensions_text(F.col("t")), 4)):
        plan = rows.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("regexp_extract_all") <= most


@pytest.mark.parametrize("sql", [views.DETAIL_PAGES, views.TREE_PAGES, views.CHART_PAGES, views.SEARCH_PAGES])
def test_pages_are_built_on_all_cores(spark, sf_dir, sql):
    """The rows that pages are made from are dealt out, not the pages."""
    pages = captures._pages(spark, sf_dir, sql)
    assert pages.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS html") < plan.index("Repartition")


def test_parts_of_the_inventory_make_only_their_blocks(spark):
    """Some fields as in the whole record; of a page only what they are read from is taken."""
    full = DETAIL + "".join(f'<div id="{i.lstrip("*")}" value="v">{i} (12) 34%</div>' for i in sorted(extract._BLOCK_IDS)) + (
        '<input id="ASIN" value="B1"><input id="parentAsin" value="P1"><div id="histogramTable">5 stars 60% 4 stars 40%</div><div id="altImages"><img></div>'
        '<div id="productOverview_feature_div"><tr><td>Brand</td><td>x</td></tr></div><img id="landingImage" src="i.png"><i class="a-icon-vse"></i>'
        '<span class="savingsPercentage">-5%</span><div id="feature-bullets"><ul><li><span class="a-list-item">Point</span></ul></div>'
    )
    pages = _pages(spark, full, "<p>nothing</p>", None)
    names = (*extract.READ_FROM, *[f"{g}.{f}" for g, own in extract.GROUPS.items() for f in own])
    whole = extract.inventory(extract.detail_blocks(pages, ("page_id",))).orderBy("page_id").cache()
    every = {f"{c.name}.{f}" for c in whole.schema if hasattr(c.dataType, "names") for f in c.dataType.names} | {
        c.name for c in whole.schema if not hasattr(c.dataType, "names") and c.name != "page_id"
    }
    assert every == set(names)
    for part in (names[::9], names[4::9]):
        assert extract.inventory_part(pages, part).orderBy("page_id").collect() == whole.select("page_id", *part).collect(), part
    one = next(extract._details(extract.read_page(full), only=frozenset(["blocks"]), ids=frozenset(["sims-fbt"])))
    assert one == {"blocks": {"sims-fbt": "sims-fbt (12) 34%"}}
    probed = extract.flat_probe(extract.detail_blocks(pages, ("page_id",), extract.PROBE_BLOCKS))
    assert probed.collect() == extract.flat_probe(extract.detail_blocks(pages, ("page_id",))).collect()


def test_tags_are_remembered_up_to_a_length(spark):
    extract._known_tag.cache_clear()
    html = "<ul><li class='x' title='a > b'>1</li><li class='y'>2</li></ul>" + f'<img src="{"i" * 1000}">'
    one, two = extract.read_page(html * 3), extract._Reader()
    two.feed(html * 3)
    two.close()
    assert _dump(one) == _dump(two.whole())
    info = extract._known_tag.cache_info()
    assert info.hits >= 2 * 5 and info.currsize <= 6


def test_headings_are_read_no_further_than_they_lie():
    """The same headings from the beginning of a page as from all of it."""
    seen = lambda html: len(extract.read_page(html, extract._headings.first_of).page.elements)
    rest = "<ul>" + "<li><a href='/x'>y</a>" * 50 + "</ul>"
    for page, most in [
        (SIDEBAR, 10), ("<h1>In a <b>b</b></h1>" + rest, 4), ("<h1>a</h1><span class='zg-selected'>b<i>c</i></span>" + rest, 5),
        ("<i class='x-zg-selected'>b</i><h1>In <b>c</b></h1>" + rest, 5), ("<h1>a<span class='zg-selected'>b" + rest, 200),
        ("<li><h1>a<li class='zg&#45;selected'>b<li>c" + rest, 200), (rest, 200), ("<h1>a</h1><p title='zg-selected'>" + rest, 200),
        ("<h1>a</h1 ><b class=zg-selected>odd</b>", 200), ("<img class='zg-selected'><h1>b</h1><script>x", 5), ("", 1),
    ]:
        whole = list(extract._headings(extract.read_page(page)))
        assert list(extract._found(extract._headings, page)) == whole
        assert seen(page) <= most, page
