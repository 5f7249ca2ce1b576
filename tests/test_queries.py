"""Every registered catalogue query against its DuckDB counterpart, and the driver's entry."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__
from shelflight.plans import catalogue, views


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in views.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if hasattr(value, "__float__") and not isinstance(value, str):
        return None if math.isnan(float(value)) else round(float(value), 6)
    return value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(_plain(r[names.index(c)]) for c in columns) for r in want.fetchall()]
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["items_by_list"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "l_extendedprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_sample_is_repeatable(spark, sf_dir):
    one, two = (sorted(r.node_id for r in catalogue.QUERIES["sampled_nodes"](spark, sf_dir).collect()) for _ in range(2))
    assert one == two and len(one) == 100


def test_children_whose_ids_meet(spark, tmp_path):
    """Among customers 3000 to 3699 the two kinds of children have an id in common: it comes once, from the first place."""
    keys = spark.range(2990, 3720).selectExpr("id AS c_custkey", "concat('Customer ', id) AS c_name", "'A' AS c_mktsegment")
    keys.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["chart_page_children"]).fetchall()
    rows = catalogue.QUERIES["chart_page_children"](spark, str(tmp_path)).select("node", "node_id", "page_no", "name")
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want)
    assert len(want) < 6 * 730
