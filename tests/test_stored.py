"""Interval labels, trigram joins, digests, sketches, relational tables and merged schemas against brute force, with their plans."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from shelflight.functions import fields
from shelflight.operators import intervals, reconcile, similar, sketches, tree
from shelflight.sources import relational, tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _forest(rng, n, loops):
    """(node_id, parent) of a random forest with some chains, a hot parent, cycles, blank and missing parents."""
    rows = [(f"n{i:03d}", None if i == 0 else rng.choice([f"n{max(0, i - 1):03d}", "n000", f"n{rng.randrange(i):03d}"])) for i in range(n)]
    rows += [("blank", " "), ("lost", "nowhere"), ("below-lost", "lost")]
    if loops:
        rows += [("c1", "c3"), ("c2", "c1"), ("c3", "c2"), ("under", "c1"), ("self", "self")]
    return rows


@pytest.mark.parametrize(("n", "loops", "seed"), [(60, True, 1), (40, False, 2), (1, False, 3)])
def test_interval_labels(spark, tmp_path, n, loops, seed):
    rows = _forest(random.Random(seed), n, loops)
    nodes = spark.createDataFrame([*rows, rows[0], (None, "n000")], "node_id string, parent_node_id string")
    labels = intervals.store_labels(intervals.interval_labels(nodes), f"file://{tmp_path}/labels")
    found = {r.node_id: r for r in labels.collect()}
    assert found.keys() == {i for i, _ in rows} and labels.count() == len(found)
    parent = {i: p for i, p in rows if p in found and p.strip()}
    cyclic = set()
    for i in found:
        seen, at = set(), i
        while at in parent and at not in seen:
            seen.add(at)
            at = parent[at]
        if at in seen:
            cyclic.add(i)
    assert {i for i, r in found.items() if r.cyclic} == cyclic

    children = {}
    for i, p in parent.items():
        children.setdefault(p, []).append(i)
    order, after, want = [], [], {}

    def visit(i, level):
        first = len(order)
        order.append(i)
        for c in sorted(children.get(i, [])):
            visit(c, level + 1)
        want[i] = (level, len(order) - first, first, len(order) - 1, len(after))
        after.append(i)

    for root in sorted(i for i in found if i not in parent and i not in cyclic):
        visit(root, 0)
    assert {i: (r.level, r.size, r.pre, r.last, r.post) for i, r in found.items() if not r.cyclic} == want
    for roots in (["n000"], ["n000", "lost", "n000"], ["blank", "n000", "below-lost"], ["none"], [*list(want)[:4], *cyclic]):
        below = {}
        for root in roots:
            if root in want:
                for i, (level, *_) in want.items():
                    if want[root][2] <= want[i][2] <= want[root][3]:
                        below[i] = min(below.get(i, 999), level - want[root][0])
        got = intervals.subtree_in_range(labels, roots)
        assert {r.node_id: r.level for r in got.collect()} == below
    plan = _plan(intervals.subtree_in_range(labels, ["n000"]))
    assert "Join" not in plan and "GreaterThanOrEqual(pre" in plan and "LessThanOrEqual(pre" in plan
    assert {r.node_id: r.descendants for r in intervals.descendants(labels).collect()} == {i: w[1] - 1 for i, w in want.items()}


def test_no_labels(spark):
    assert intervals.interval_labels(spark.createDataFrame([], "node_id string, parent_node_id string")).count() == 0


@pytest.mark.parametrize(("least", "few"), [(0.3, 100_000), (0.5, 0), (0.9, 100_000)])
def test_search_many(spark, least, few, monkeypatch):
    """Against every pair, with a hot word, short texts, texts without trigrams and the search of one text."""
    monkeypatch.setattr(similar, "FEW", few)
    rng = random.Random(4)
    words = ["kitchen", "kitchn", "dining", "garden", "the", "ab", "café", "x-ray", "50%", "toy"]
    names = [" ".join(["the", *rng.choices(words, k=rng.randrange(0, 4))]) for _ in range(80)] + [None, "", "--", "AB_c"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 3))) for _ in range(25)] + [None, "a", "--", "0%", "The KITCH", "É"]
    left = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    right = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    got = similar.search_many(left, right, "id", "name", "id", "name", least)
    pairs = left.select(F.col("id").alias("key"), F.col("name").alias("n")).crossJoin(right.select(F.col("id").alias("text_key"), F.col("name").alias("t")))
    score = fields.similarity(F.col("n"), F.col("t"))
    want = pairs.where("n is not null and t is not null").where(F.lower("n").contains(F.lower("t")) | (score >= least))
    want = {(r.text_key, r.key): r.s for r in want.select("text_key", "key", score.alias("s")).collect()}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.text_key, r.key): r.similarity for r in rows} == want


def test_search_without_products(spark):
    names = spark.createDataFrame([(1, "kitchen")], "id long, name string")
    plan = _plan(similar.search_many(names, names, "id", "name", "id", "name"))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_content_differences(spark, tmp_path):
    """A row too many, a changed value, a null in place of a value, another number of repetitions; other folders are not read again."""
    rows = [(i, f"v{i}", float(i)) for i in range(400)] + [(1000, None, None)] * 3 + [(None, "n", 0.0)]
    other = [r for r in rows if r[0] != 7] + [(8, "v8", 8.0), (9999, "new", 1.0)]
    other[20] = (other[20][0], "changed", other[20][2])
    other[30] = (other[30][0], None, other[30][2])
    other.remove((1000, None, None))
    schema = "id long, v string, x double"
    sides = [
        reconcile.store_bucketed(spark.createDataFrame(r, schema), ["id"], 256, f"file://{tmp_path}/{k}") for k, r in enumerate((rows, other))
    ]
    columns = ["id", "v", "x"]
    found = reconcile.reconcile_content(*sides, columns)
    got = {(r.id, r.v, r.x): (r.in_left, r.in_right) for r in found.collect()}
    want = {r: (rows.count(r), other.count(r)) for r in {*rows, *other} if rows.count(r) != other.count(r)}
    assert got == want and len(want) == 8
    touched = reconcile.differing_buckets(*sides, columns)
    assert 1 <= len(touched) <= 7
    plan = _plan(found)
    assert plan.count("PartitionFilters: [bucket#") >= 2 and "PartitionFilters: []" not in plan
    assert reconcile.reconcile_content(sides[0], sides[0], columns).count() == 0
    files = sides[0].where(F.col("bucket").isin(touched)).select(F.input_file_name()).distinct().count()
    assert files < sides[0].select(F.input_file_name()).distinct().count() / 10


def test_digests_disregard_order_only(spark, tmp_path):
    rows = [(i % 5, i) for i in range(50)]
    a, b = (reconcile.store_bucketed(spark.createDataFrame(r, "k int, v int"), ["k"], 4, f"file://{tmp_path}/{n}") for n, r in (("a", rows), ("b", rows[::-1])))
    assert reconcile.differing_buckets(a, b, ["k", "v"]) == []
    c = reconcile.store_bucketed(spark.createDataFrame([(k, None if v == 3 else v) for k, v in rows], "k int, v int"), ["k"], 4, f"file://{tmp_path}/c")
    assert len(reconcile.differing_buckets(a, c, ["k", "v"])) == 1


def test_sketches(spark):
    """Days united in any grouping; relative errors within five standard errors, and small counts are exact."""
    n = 60_000
    rows = spark.range(n).select(
        F.concat(F.lit("B"), F.col("id") % 40_000).alias("asin"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("id") % 3 + 1).cast("int")).alias("list_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("day"),
    )
    kept = sketches.item_sketches(rows, F.col("day"))
    assert kept.count() == 21
    close = lambda guess, exact: abs(guess - exact) <= 0.04 * exact
    total = sketches.distinct_items(kept).first()
    assert close(total["items"], 40_000) and total.sightings == n
    for row in sketches.distinct_items(kept, "list_type").collect():
        assert close(row["items"], rows.where(F.col("list_type") == row.list_type).select("asin").distinct().count())
    several = rows.groupBy("asin").agg(F.countDistinct("list_type").alias("n")).where("n > 1").count()
    found = sketches.items_on_several_lists(kept, ["A", "N", "R"]).first()
    assert close(found["items"], 40_000) and close(found.multi_list, several)
    few = sketches.item_sketches(rows.where("id < 30"), F.col("day"))
    assert sketches.distinct_items(few).first()["items"] == 30
    assert sketches.items_on_several_lists(few, ["A", "N", "R"]).first() == (30, 0)
    assert sketches.items_on_several_lists(few, ["A"]).first().multi_list == 0


def test_relational(spark):
    url, driver = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i if i % 9 else None, f"n{i}") for i in range(1, 100)], "id long, name string")
    for _ in range(2):  # written again, it is replaced
        relational.write_table(rows, url, "t", 3, **driver)
    read = relational.read_table(spark, url, "t", "id", 4, **driver)
    assert read.rdd.getNumPartitions() == 4 and sorted(map(tuple, read.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    plan = _plan(read.where("id > 50").select("id"))
    assert "GreaterThan(id,50)" in plan and "name" not in plan.split("ReadSchema")[1]
    relational.write_table(rows.limit(0), url, "t", 1, **driver)
    assert relational.key_bounds(spark, url, "t", "id", **driver) is None
    assert relational.read_table(spark, url, "t", "id", 4, **driver).count() == 0


def test_generations(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    spark.createDataFrame([(1,)], "a int").write.mode("append").parquet(path)
    spark.createDataFrame([(2, "x", 5)], "a int, b string, gone int").write.mode("append").parquet(path)
    spark.createDataFrame([(3, None, None)], "a int, b string, c double").write.mode("append").parquet(path)
    schema = spark.createDataFrame([], "c double, a long, b string, never string, flag int").schema
    found = relational.read_generations(spark, path, schema, {"c": 1.5, "flag": 0})
    assert found.dtypes == [(f.name, f.dataType.simpleString()) for f in schema.fields]
    assert sorted(tuple(r) for r in found.collect()) == [(1.5, 1, None, None, 0), (1.5, 2, "x", None, 0), (1.5, 3, None, None, 0)]


def test_a_run_leaves_no_tables(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "node_id string, parent_node_id string")
    with tables.run_folder(spark) as path:
        assert tables.shared_dir(spark, "x").startswith(path)
        assert tree.paths(nodes).count() == 3
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        assert len(store.listStatus(at)) >= 2
    assert not store.exists(at) and not tables.shared_dir(spark, "x").startswith(path)
