import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelflight.operators import arrivals, browse, filters, quality, sightings, tracking, tree
from shelflight.plans import captures, views
from shelflight.sources import tables


def _ids(df, column="asin"):
    return sorted(r[0] for r in df.select(column).collect())


def test_list_gate_rules(spark):
    rows = spark.createDataFrame(
        [("a", 10.0, 4.0, 5), ("b", None, 4.0, 5), ("c", 20.0, None, 5), ("d", 15.0, 3.0, None), ("e", 15.0, 3.0, 10)],
        "asin string, price double, rating double, review_count int",
    )
    keep = lambda **k: _ids(rows.where(filters.ListGate(**k).column()))
    assert keep() == list("abcde")
    assert keep(review_max=10) == list("abcd")  # the bound itself is rejected, missing counts as 0
    assert keep(review_min=5) == list("abce")
    assert keep(price_min=10, price_max=15) == list("ade")
    assert keep(rating_min=4) == list("ab")


def test_page_filter_and_presets(spark):
    rows = spark.createDataFrame([("a", 15.0, 1), ("b", 60.0, 100), ("c", 61.0, 1), ("d", None, 1)], "asin string, price double, review_count int")
    assert _ids(rows.where(filters.COARSE.column())) == ["a", "b"]
    assert _ids(rows.where(filters.PageFilter().column())) == list("abcd")


DETAIL = (
    "asin string, bsr_main_rank int, bsr_sub_rank int, variant_option_count int, other_sellers_count int, item_weight string, "
    "item_dimensions string, shipping_fee_value double, fulfillment_type string, country_of_origin string, is_amazon_choice int, "
    "is_bestseller int, date_first_available date"
)


def test_detail_filter_rules(spark):
    day = dt.date(2024, 6, 1)
    rows = spark.createDataFrame(
        [
            ("a", 100, 5, 3, 2, "1 kg", "10 x 5 x 2 cm", 0.0, "FBA", "China", 1, 0, day),
            ("b", 500, None, None, None, None, None, None, None, None, None, None, None),
            ("c", 101, 9, 9, 9, "40 Pounds", "40 x 5 inches", 4.99, "FBM", "Made in CHINA", 0, 1, dt.date(2024, 1, 1)),
        ],
        DETAIL,
    )
    as_of = F.lit(dt.date(2024, 6, 8))
    keep = lambda **k: _ids(rows.where(filters.DetailFilter(**k).column(as_of)))
    assert keep() == list("abc")
    assert keep(bsr_main_min=100, bsr_main_max=101) == ["a", "c"]
    assert keep(bsr_sub_max=5) == ["a"] and keep(variant_min=4) == ["c"] and keep(sellers_max=2) == ["a"]
    assert keep(weight_max=3) == ["a"] and keep(dim_l=20) == ["a"] and keep(dim_h=1) == ["a", "c"]
    assert keep(shipping_fee="free") == ["a"] and keep(shipping_fee="paid") == ["c"]
    assert keep(shipping_fee="custom") == ["a", "c"] and keep(shipping_fee="custom", shipping_val=4, shipping_op="gte") == ["c"]
    assert keep(fulfillment_type="FBA") == ["a"] and keep(country="china") == ["a", "c"]
    assert keep(choice=True) == ["a"] and keep(bestseller=True) == ["c"]
    assert keep(listed_within_days=7) == ["a"] and keep(date_to=dt.date(2024, 2, 1)) == ["c"]
    with pytest.raises(ValueError):
        filters.DetailFilter(listed_within_days=1).column()


def test_classes(spark):
    html = [None, "Please solve the CAPTCHA", "keine Ergebnisse", "x", "x"]
    rows = spark.createDataFrame([(h, n) for h, n in zip(html, [1, 1, 1, 0, 3])], "html string, n int")
    assert [r[0] for r in rows.select(filters.capture_status(F.col("html"), F.col("n"))).collect()] == ["error", "captcha", "no_results", "empty", "ok"]
    select = '<select id="s-result-sort-select"><option value="{}">x</option></select>'
    pages = ["api-services", "plain", select.format("date-desc-rank"), select.format("price")]
    got = spark.createDataFrame([(p,) for p in pages], "h string").select(filters.sort_capability(F.col("h")).alias("c"))
    assert [(r.c, r.f) for r in got.select("c", filters.capability_flag(F.col("c")).alias("f")).collect()] == [("robot", None), ("no_select", 0), ("yes", 1), ("no", 0)]
    slugs = spark.createDataFrame([("kitchen",), ("Books-x",), ("musical-instruments",), (None,)], "slug string")
    kept, skipped = filters.keep_and_skip(slugs)
    assert [r.slug for r in kept.collect()] == ["kitchen", "musical-instruments", None] and [r.slug for r in skipped.collect()] == ["Books-x"]
    assert (filters.clamp(None, 50, 200), filters.clamp(500, 50, 200), filters.clamp(-1, 50, 200)) == (50, 200, 50)


def test_paths_stop_at_cycles_and_missing_parents(spark):
    nodes = spark.createDataFrame(
        [("r", None), ("a", "r"), ("b", "a"), ("x", "gone"), ("p", "q"), ("q", "p"), ("e", ""), ("b", "a")],
        "node_id string, parent_node_id string",
    )
    got = {r.node_id: r for r in tree.paths(nodes).collect()}
    assert got["b"].labels == "r.a.b" and got["x"].labels == "x" and got["e"].path == ["e"]
    assert got["p"].cyclic and got["q"].cyclic and not got["b"].cyclic
    counts = {r.node_id: r.descendants for r in tree.descendant_counts(tree.paths(nodes)).collect()}
    assert counts["r"] == 2 and counts["b"] == 0
    assert {(r.node_id, r.level) for r in tree.subtree(nodes, spark.createDataFrame([("r",), ("p",)], "node_id string")).collect()} == {("r", 0), ("a", 1), ("b", 2), ("p", 0), ("q", 1)}


def test_growth_and_crumbs(spark):
    edges = spark.createDataFrame(
        [("u0", "A", "u1", "1", "s"), ("u0", "B", "u2", "2", "s"), ("u1", "C", "u3", "3", "s"), ("u3", "back", "u0", "0", "s"), ("u2", "C2", "u3", "3", "s")],
        "parent_url string, name string, url string, node_id string, slug string",
    )
    roots = spark.createDataFrame([("u0", "0", "root", "s")], "url string, node_id string, name string, slug string")
    got = {r.node_id: (r.depth, r.parent_node_id) for r in tree.grow(edges, roots).collect()}
    assert got == {"0": (0, None), "1": (1, "0"), "2": (1, "0"), "3": (2, "1")}
    crumbs = spark.createDataFrame(
        [(1, 0, "k", "K"), (1, 1, "x", "X"), (1, 2, "y", "Y"), (2, 0, "z", "Z"), (2, 1, "k", "K"), (3, 0, "y", "Y"), (3, 1, "w", "W")],
        "page_id int, pos int, node_id string, name string",
    )
    known = spark.createDataFrame([("k", 2, "slug")], "node_id string, depth int, slug string")
    got = {r.node_id: (r.parent_node_id, r.depth, r.slug) for r in tree.fill_from_crumbs(crumbs, known).collect()}
    assert got == {"x": ("k", 3, "slug"), "y": ("x", 4, "slug"), "w": ("y", 5, "slug")}


def test_writes(spark, tmp_path):
    target = spark.createDataFrame([("a", "old", "n"), ("b", "old", "n")], "asin string, name string, notes string")
    batch = spark.createDataFrame([("b", "new", None), ("c", "new", "m"), ("c", "newer", "m"), (None, "x", "y"), (None, "x", "y")], "asin string, name string, notes string")
    added = tables.insert_or_ignore(target, batch, ["asin"], ["name"])
    assert sorted((r.asin or "", r.name) for r in added.collect()) == [("", "x"), ("", "x"), ("c", "new")]
    new = batch.where("asin is not null")
    got = {r.asin: (r.name, r.notes) for r in tables.upsert(target, new, ["asin"], ["name", "notes"], ["name"]).collect()}
    assert got == {"a": ("old", "n"), "b": ("new", None), "c": ("newer", "m")}
    path = str(tmp_path / "t")
    tables.overwrite(target, path)
    assert tables.append_new(path, new, ["asin"], ["name"]) == 1 and tables.append_new(path, new, ["asin"], ["name"]) == 0
    assert spark.read.parquet(path).count() == 3
    updates = spark.createDataFrame([("a", "set"), ("b", None)], "asin string, notes string")
    assert {r.asin: r.notes for r in tables.update_columns(target, updates, ["asin"], ["notes"]).collect()} == {"a": "set", "b": "n"}
    assert _ids(tables.delete_keys(target, updates.where("asin = 'a'"), ["asin"])) == ["b"]
    assert tables.table_or_empty(spark, "no_such_table", target.schema).count() == 0
    tables.write_report(target, ["notes", "asin"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["notes", "asin"]
    tables.write_json(tables.nested_as_json(target.withColumn("s", F.struct("asin")), ["s"]), str(tmp_path / "json"))
    assert tables.read_json_array(spark, str(tmp_path / "json")).count() in (1, 2)


def test_positions_and_rollup(spark):
    items = spark.createDataFrame(
        [("n", "l", 1, 0, None), ("n", "l", 1, 1, 50), ("n", "l", 2, 0, None), ("n", "m", 3, 0, None)],
        "node_id string, list_type string, page_no int, idx int, rank int",
    )
    got = sorted((r.list_type, r.page_no, r.idx, r.list_position) for r in sightings.list_positions(items).collect())
    assert got == [("l", 1, 0, 1), ("l", 1, 1, 50), ("l", 2, 0, 3), ("m", 3, 0, 1)]
    at = lambda d: dt.datetime(2024, 1, d)
    rows = spark.createDataFrame(
        [("a", "late", 1.0, None, 3, "x", "n1", 2, at(2)), ("a", "best", 2.0, None, 4, "y", None, 1, at(3)), ("b", "one", 3.0, 4.0, None, "x", None, None, at(1))],
        "asin string, name string, price double, rating double, review_count int, list_type string, node_id string, rank int, scraped_at timestamp",
    )
    a, b = sightings.rollup(rows, []).collect()
    assert (a.asin, a.name, a.lists, a.list_count, a.categories, a.best_rank, a.first_seen) == ("a", "best", "x,y", 2, "n1", 1, at(2))
    assert b.categories is None and b.best_rank is None
    stats = sightings.item_stats(rows).first()
    assert (stats["items"], stats.multi_list, stats.sightings) == (2, 1, 3)
    assert sightings.item_stats(rows.limit(0)).first().sightings == 0


@pytest.mark.parametrize(
    ("rank", "age", "reviews", "kept", "signal"),
    [(50000, 7, 9, True, True), (50001, 7, 9, True, False), (200000, 30, 0, True, False), (200001, 1, 0, False, False), (1, 31, 0, False, False), (1, 8, 0, True, False), (1, 7, 10, True, False), (None, 1, 0, False, True), (1, None, 0, True, False)],
)
def test_arrival_rules(spark, rank, age, reviews, kept, signal):
    row = spark.createDataFrame([(rank, age, reviews)], "r int, a int, n int").select(
        arrivals.accepted(F.col("r"), F.col("a")), arrivals.is_signal(F.col("r"), F.col("a"), F.col("n"))
    )
    assert tuple(bool(x) for x in row.first()) == (kept, signal)


def test_tracking_rerun(spark):
    day = dt.date(2024, 1, 1)
    schema = "asin string, price double, rank int, rating double, review_count int, snapshot_date date"
    series = spark.createDataFrame([("a", 1.0, 1, 1.0, 1, day), ("b", 1.0, 1, 1.0, 1, day)], schema)
    again = spark.createDataFrame([("a", 2.0, None, 1.0, 1, day)], schema)
    got = {r.asin: (r.price, r.rank) for r in tracking.track(series, again).collect()}
    assert got == {"a": (2.0, None), "b": (1.0, 1)}
    assert [r.price_change for r in tracking.history(series.unionByName(again.withColumn("snapshot_date", F.lit(dt.date(2024, 1, 2)))), "a").collect()] == [None, 1.0]


def test_reports(spark):
    log = spark.createDataFrame([("k", i, i not in (1, 2, 3, 5)) for i in range(7)], "key string, at int, ok boolean")
    streaks = [r.streak for r in quality.failure_streaks(log, "key", ["at"], F.col("ok"), 3).orderBy("at").collect()]
    assert streaks == [0, 1, 2, 3, 0, 1, 0]
    docs = spark.createDataFrame([(1, "x", 0, [1]), (2, "", 5, []), (3, None, None, None)], "doc int, a string, b int, c array<int>")
    found = {r.field: (r.frequency, r.promoted) for r in quality.coverage(quality.field_presence(docs, "doc")).collect()}
    assert found == {"a": ("1/3", False), "b": ("1/3", False), "c": ("1/3", False)}
    counted, seen = quality.observed(docs, "counters", rows=F.count("*"), with_b=F.count("b"))
    counted.collect()
    assert seen.get == {"rows": 3, "with_b": 2}
    checks = spark.createDataFrame([(1, "ok", 5, True), (1, "empty", 0, False), (2, "captcha", 0, False), (9, "ok", 1, False)], "depth int, status string, count int, has_next boolean")
    assert {r.depth: (r.ok, r.empty, r.captcha) for r in quality.status_by_depth(checks).collect()} == {1: (1, 1, 0), 2: (0, 0, 1)}
    sizes = quality.result_sizes(checks).first()
    assert (sizes.least, sizes.most, sizes.mean, sizes.next_share) == (1, 5, 3.0, 0.5)
    assert quality.depth_map(checks).first().depths == {"L1": 2, "L2": 1, "L9": 1}
    assert quality.nested_child_sum(spark.createDataFrame([(None,), (None,)], "child_count long")).first().n == 0


def _chain(spark, n):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, f"u{i}/", f"name {i}", 0, "s") for i in range(n)]
    return spark.createDataFrame(rows, "node_id string, parent_node_id string, url string, name string, depth int, slug string")


def test_long_chains_are_whole(spark):
    nodes = _chain(spark, 300)
    found = {r.node_id: r for r in tree.paths(nodes).collect()}
    assert len(found) == 300 and not any(r.cyclic for r in found.values())
    assert found["n299"].path == [f"n{i}" for i in range(300)] and found["n299"].labels.startswith("n0.n1.")
    counts = {r.node_id: r.descendants for r in tree.descendant_counts(tree.paths(nodes)).collect()}
    assert counts == {f"n{i}": 299 - i for i in range(300)}


def test_walks_have_no_last_level(spark):
    nodes = _chain(spark, 20)
    levels = {r.node_id: r.level for r in tree.subtree(nodes, nodes.where("node_id = 'n0'")).collect()}
    assert levels == {f"n{i}": i for i in range(20)}
    assert tree.subtree(nodes, nodes.where("node_id = 'n0'"), most_levels=3).count() == 4
    edges = [(f"u{i - 1}/", f"name {i}", f"u{i}/", f"n{i}", "s") for i in range(1, 20)] + [("u19/", "back", "u0/", "n0", "s")]
    edges = spark.createDataFrame(edges, "parent_url string, name string, url string, node_id string, slug string")
    grown = {r.node_id: r.depth for r in tree.grow(edges, nodes.where("node_id = 'n0'")).collect()}
    assert grown == {f"n{i}": i for i in range(20)}
    crumbs = spark.createDataFrame([(1, i, f"n{i}", f"name {i}") for i in range(20)], "page_id long, pos int, node_id string, name string")
    added = tree.fill_from_crumbs(crumbs, nodes.where("node_id = 'n0'")).collect()
    assert {r.node_id: r.depth for r in added} == {f"n{i}": i for i in range(1, 20)}


def test_paths_of_cycles_and_of_what_hangs_on_them(spark):
    rows = [("a", "b"), ("b", "a"), ("x", "a"), ("y", "x"), ("self", "self"), ("lost", "nowhere"), ("r", ""), ("c", "r"), (None, "r")]
    found = {r.node_id: r for r in tree.paths(spark.createDataFrame(rows, "node_id string, parent_node_id string")).collect()}
    assert {k for k, r in found.items() if r.cyclic} == {"a", "b", "x", "y", "self"}
    assert found["y"].path == ["b", "a", "x", "y"] and found["self"].path == ["self"] and found["lost"].path == ["lost"]
    assert found["c"].path == ["r", "c"] and len(found) == 8


def test_rows_without_a_key_never_conflict(spark):
    schema = "k string, a int, b int"
    target = spark.createDataFrame([("x", 1, 1), (None, 9, 9)], schema)
    batch = spark.createDataFrame([(None, 2, 2), (None, 3, 3), ("x", 5, 5), ("x", 4, 4), ("y", 6, 6)], schema)
    got = sorted(map(tuple, tables.upsert(target, batch, ["k"], ["a"], ["a"]).collect()), key=repr)
    assert got == sorted([("x", 5, 1), ("y", 6, 6), (None, 9, 9), (None, 2, 2), (None, 3, 3)], key=repr)
    last = sorted(map(tuple, tables.latest_per_key(batch, ["k"], ["a"]).collect()), key=repr)
    assert last == sorted([(None, 2, 2), (None, 3, 3), ("x", 5, 5), ("y", 6, 6)], key=repr)
    part = tables.upsert(target, batch.select("k", "b"), ["k"], ["b"], ["b"])  # a column the batch lacks
    assert ("x", 1, 5) in set(map(tuple, part.collect())) and ("y", None, 6) in set(map(tuple, part.collect()))
    found = spark.createDataFrame([(None, "1"), (None, "2"), ("u", None), ("v", None), ("u", "3"), ("w", "1")], "url string, node_id string")
    known = spark.createDataFrame([("w", "7")], "url string, node_id string")
    fresh = sorted(map(tuple, tree.unseen(found, known, ["url", "node_id"]).collect()), key=repr)
    assert fresh == sorted([(None, "1"), (None, "2"), ("u", None), ("v", None)], key=repr)


def test_repeated_keys_do_not_multiply_rows(spark):
    nodes = spark.createDataFrame([("a", None), ("b", 1)], "node_id string, f int")
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("a", None)], "node_id string, f int")
    assert sorted(map(tuple, quality.with_cache(nodes, twice, ["f"]).collect())) == [("a", 2), ("b", 1)]
    assert sorted(map(tuple, tables.update_columns(nodes, twice, ["node_id"], ["f"]).collect())) == [("a", 2), ("b", 1)]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "asin string, price int")
    details = spark.createDataFrame([("a", 5), ("a", 3), ("b", 9)], "asin string, size int")
    assert sorted(map(tuple, sightings.enriched(rows, details, None, ["size"]).collect())) == [("a", 1, 3), ("b", 2, 9)]
    assert sorted(map(tuple, sightings.enriched(rows, details, F.col("size") < 5, ["size"]).collect())) == []


def test_series_is_written_by_day(spark, tmp_path):
    day = lambda d: dt.date(2024, 1, d)
    schema = "asin string, price double, rank int, rating double, review_count int, snapshot_date date"
    path = f"file://{tmp_path}/series"
    write = lambda *rows: tracking.track_into(path, spark.createDataFrame(rows, schema))
    write(("a", 1.0, 1, 1.0, 1, day(1)), ("b", 2.0, 2, 2.0, 2, day(1)))
    write(("a", 3.0, 1, 1.0, 1, day(2)))
    write(("a", 9.0, None, 1.0, 1, day(1)))  # a rerun of a day replaces the rows it has
    got = {(r.asin, r.snapshot_date): (r.price, r["rank"]) for r in spark.read.parquet(path).collect()}
    assert got == {("a", day(1)): (9.0, None), ("b", day(1)): (2.0, 2), ("a", day(2)): (3.0, 1)}


def test_listings_page_and_order(spark):
    rows = [(f"c{i}", f"n{i}", 1, "s", "r", "X", 1, 0) for i in range(5)] + [("top", "r", 0, "s", None, "X", None, 5), ("cc", "m", 2, "s", "n1", "X", 0, 0)]
    nodes = spark.createDataFrame(rows, "name string, node_id string, depth int, slug string, parent_node_id string, site string, na_valid int, child_count long")
    got = browse.tree_children(nodes, "r", "X", limit=2, offset=1).collect()
    assert [(r.name, r.child_count) for r in got] == [("c1", 1), ("c2", 0)]
    assert [r.name for r in browse.tree_children(nodes, "r", "X", text="c3").collect()][0] == "c3"
    assert [(r.node_id, r.child_count) for r in browse.tree_children(nodes, "root", "X").collect()] == [("r", 7)]
    assert [r.node_id for r in browse.capable(nodes, "X", limit=2, offset=3).collect()] == ["n3", "n4"]
    assert browse.tree_children(nodes, "nothing", "X").count() == 0
    assert [r.node_id for r in browse.stored_children(nodes.where("depth > 0"), "root", "X").collect()] == [f"n{i}" for i in range(5)]
    assert [r.node_id for r in tree.expanded(nodes, None, [2]).collect()] == ["m"]


def test_url_roots_that_most_nodes_share(spark, monkeypatch):
    """Few roots are sent to the tasks, many are dealt out in copies: rows that share a prefix do not gather in one task."""
    rows = [(str(i), f"https://x/gp/a/{i}/" if i % 10 else "https://y/z/") for i in range(500)] + [("500", None), (None, "https://x/gp/a/9/")]
    nodes = spark.createDataFrame(rows, "node_id string, url string")
    roots = spark.createDataFrame([("30", "https://x/gp/a/"), ("40", "https://none/")], "node_id string, url string")
    want = sorted({r for r in rows if r[0] in ("30", "40") or (r[1] or "").startswith("https://x/gp/a/")}, key=repr)
    few = tree.subtree_by_url(nodes, roots)
    assert sorted((tuple(r) for r in few.collect()), key=repr) == want
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tree, "ROOTS_SENT", 1)
    many = tree.subtree_by_url(nodes, roots)
    assert sorted((tuple(r) for r in many.collect()), key=repr) == want
    assert "__part" in many._jdf.queryExecution().executedPlan().toString()


def test_presence_holds_one_row_a_document(spark):
    """Documents that repeat count once, those without an id not at all; no row is multiplied by the number of fields."""
    docs = spark.createDataFrame([(1, "x", None), (1, None, "y"), (2, "", None), (None, "z", "z")], "doc long, a string, b string")
    found = quality.field_presence(docs, "doc", {"b": "g"})
    rows = sorted((r.field_group, r.field, r.n_docs, r.of_docs) for r in found.collect())
    assert rows == [("", "a", 1, 2), ("g", "b", 1, 2)]
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert quality.field_presence(docs.limit(0), "doc").count() == 0


def test_samples_of_a_field_are_all_its_documents(spark):
    """More than a few documents, dates, repeated rows, a row without a document, and a field that none has."""
    rows = [(i, i % 2, dt.date(2024, 1, 1) if i < 5 else None, "") for i in range(9)] + [(4, 7, None, ""), (None, 1, None, "x")]
    docs = spark.createDataFrame(rows, "doc long, a int, b date, c string")
    got = sorted((r.field, r.doc) for r in quality.field_samples(docs, "doc").collect())
    assert got == [("a", i) for i in (1, 3, 4, 5, 7)] + [("b", i) for i in range(5)]
    assert quality.field_samples(docs.limit(0), "doc").count() == 0


def test_inventory_samples_reads_every_field_of_every_page(spark, sf_dir):
    """All fields of the inventory are asked for, and a field that all pages have names all of them."""
    rows = captures.inventory_samples(spark, sf_dir)
    pages = {r.page_id for r in captures._pages(spark, sf_dir, views.DETAIL_PAGES).select("page_id").collect()}
    by_field = collections.defaultdict(list)
    for r in rows.collect():
        by_field[r.field].append(r.page_id)
    assert len(by_field) == 36 and len(pages) > 3
    for field in ("title", "price", "attributes", "breadcrumbs"):
        assert len(by_field[field]) == len(pages) and set(by_field[field]) == pages
