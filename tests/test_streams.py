"""Streams over several batches: the same result however the input is cut, replays, restarts and what each batch reads."""

import collections
import datetime as dt
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelflight.sources import keyed
from shelflight.sources.keyed import KeyedTable
from shelflight.streaming import flow, health, jobs, streaks

START = dt.datetime(2024, 1, 1)


def _at(minutes):
    return START + dt.timedelta(minutes=minutes)


CHANGES = [("a", "delete"), ("a", "delete"), ("b", "insert"), ("a", "insert"), ("a", "insert"), ("a", "insert"), (None, "insert"), ("c", "move")]


@pytest.mark.parametrize("cuts", [[], [2], [1, 2, 3, 4, 5, 6, 7], [6]])
def test_counts_do_not_depend_on_the_cuts(spark, tmp_path, cuts):
    path = f"file://{tmp_path}/counts"
    write = jobs.keep_counts(path)
    edges = [0, *cuts, len(CHANGES)]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        batch = spark.createDataFrame(CHANGES[a:b], "parent_node_id string, op string")
        write(batch, i)
        write(batch, i)  # comes twice
    assert {r.node_id: r.child_count for r in jobs.kept_counts(spark, path).collect()} == {"a": 1, "b": 1, "c": 0}


def test_counts_after_a_write_that_broke_off(spark, tmp_path):
    path = f"file://{tmp_path}/counts"
    write = jobs.keep_counts(path)
    rows = lambda *r: spark.createDataFrame(r, "parent_node_id string, op string")
    write(rows(("a", "insert"), ("b", "insert")), 0)
    write(rows(("a", "insert")), 1)
    (tmp_path / "counts/after-00000001/_SUCCESS").unlink()
    (tmp_path / "counts/after-00000001/._SUCCESS.crc").unlink(missing_ok=True)
    counts = lambda: {r.node_id: r.child_count for r in jobs.kept_counts(spark, path).collect()}
    assert counts() == {"a": 1, "b": 1}
    write(rows(("a", "insert")), 1)
    assert counts() == {"a": 2, "b": 1}


def test_counts_touch_only_their_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/counts"
    write = jobs.keep_counts(path)
    write(spark.createDataFrame([(f"n{i}", "insert") for i in range(200)], "parent_node_id string, op string"), 0)
    write(spark.createDataFrame([("n7", "insert")], "parent_node_id string, op string"), 1)
    assert len(list((tmp_path / "counts/after-00000001").glob("bucket=*"))) == 1
    assert jobs.kept_counts(spark, path).agg(F.sum("child_count"), F.count("*")).first() == (201, 200)


def _health_by_hand(events, threshold, idle, mark):
    """Streaks and quiet times of (key, event_id, minute, ok), as far as ``mark`` has passed them."""
    out = []
    for key in {e[0] for e in events}:
        streak, last = 0, None
        for _, event_id, at, ok in sorted((e for e in events if e[0] == key), key=lambda e: (e[2], e[1])):
            if last is not None and at > last + idle:
                if last + idle <= mark:
                    out.append((key, "quiet", None, last, streak, False))
                streak = 0
            streak, last = 0 if ok else streak + 1, at
            if at <= mark:
                out.append((key, "event", event_id, at, streak, streak >= threshold))
        if last + idle <= mark:
            out.append((key, "quiet", None, last, streak, False))
    return sorted(out, key=repr)


@pytest.fixture
def zone(spark, request):
    """The session's time zone for a test."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("seed,zone", [(1, "UTC"), (2, "Asia/Tokyo"), (3, "America/New_York")], indirect=["zone"])
def test_source_health_over_any_batches(spark, tmp_path, seed, zone):
    """Events out of order inside the delay, many batches, a restart in between, and any time zone."""
    rng = random.Random(seed)
    events = [(rng.choice("abc"), i, rng.randrange(0, 400), rng.random() < 0.4) for i in range(120)]
    events += [("d", 900, 5, False), ("d", 901, 5, False), ("e", 902, 600, True)]
    batches = [[] for _ in range(6)]
    for e in sorted(events, key=lambda e: e[2] + rng.randrange(0, 20)):  # up to 20 minutes late
        batches[min(5, e[2] // 70)].append(e)
    schema = "key string, event_id long, ts timestamp, ok boolean"
    with health.rocks_state(spark):
        for run in (batches[:2], batches[2:]):
            jobs.replay([spark.createDataFrame([(k, i, _at(m), ok) for k, i, m, ok in b], schema) for b in run], f"{tmp_path}/in")
            stream = jobs.stream_of(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
            out = jobs.drain(health.source_health(stream, 3, "50 minutes", "90 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted(((r.key, r.kind, r.event_id, int((r.ts - START).total_seconds() // 60), r.streak, r.tripped) for r in out.collect()), key=repr)
    assert got == _health_by_hand(events, 3, 50, 600 - 90)


class _Kept:
    """A state of one kind, and how often it was called."""

    calls = 0

    def __init__(self, *_):
        self.value, self.entries = None, {}

    def __getattr__(self, name):
        _Kept.calls += 1
        return {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "clear": lambda: setattr(self, "value", None),
            "update": lambda v: setattr(self, "value", v), "appendValue": lambda v: setattr(self, "value", [*(self.value or []), v]),
            "containsKey": lambda k: k in self.entries, "getValue": self.entries.get, "updateValue": self.entries.__setitem__,
            "registerTimer": lambda _: None, "listTimers": lambda: [], "getListState": _Kept, "getValueState": _Kept, "getMapState": _Kept,
        }[name]


def test_source_health_of_many_keys_of_a_bucket():
    """The same rows and streak lengths as key by key, with as many state calls for a bucket of 200 keys as for one of few."""
    rng = random.Random(4)
    events = [(f"k{rng.randrange(200)}", i, rng.randrange(0, 400), rng.random() < 0.4) for i in range(4000)] + [("last", 9000, 600, True)]
    step, out, calls = health.SourceHealth(3, 50), [], []
    step.init(_Kept())
    for low, mark in ((0, 0), (100, 80), (200, 190), (300, 290), (400, 400), (None, 510)):
        batch = [e for e in events if low is not None and (low <= e[2] < low + 100 or low == 400 <= e[2])]
        parts = [pd.DataFrame(part, columns=["key", "event_id", "at", "ok"]) for part in (batch[::2], batch[1::2]) if part]
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda _, m=mark: m})()
        _Kept.calls = 0
        for rows in step.handleInputRows((0,), iter(parts), clock) if parts else step.handleExpiredTimer((0,), clock, None):
            out += [tuple(None if v is pd.NA else v for v in r) for r in rows.itertuples(index=False)]
        calls.append(_Kept.calls)
    assert sorted(out, key=repr) == _health_by_hand(events, 3, 50, 510)
    assert max(calls) < 80
    quiet = collections.Counter()
    for key, own in itertools.groupby(sorted((r[0], r[3], r[1] == "quiet", r[2] or 0, r[4]) for r in out), key=lambda r: r[0]):
        streak = 0
        for _, _, is_quiet, _, behind in own:
            if streak and (is_quiet or behind <= streak):
                quiet[key, streak] += 1
            streak = 0 if is_quiet else behind
    kept = {(k, length): n for (length,), (keys, times) in step.lengths.entries.items() for k, n in zip(keys, times)}
    assert kept == quiet


def test_streaks_of_many_keys_lie_in_few_states(spark, tmp_path, monkeypatch):
    """States are as many as buckets, not keys, and keys of a bucket do not touch each other."""
    monkeypatch.setattr(streaks, "BUCKETS", 2)
    schema = "key string, event_id long, ts timestamp, ok boolean"
    rows = [(f"k{i % 50}" if i % 50 else None, i, _at(i), i % 3 == 0) for i in range(400)]
    jobs.replay([spark.createDataFrame(rows[k : k + 200], schema) for k in (0, 200)], f"{tmp_path}/in")
    stream = jobs.stream_of(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    got = jobs.drain(jobs.failure_streaks(stream, threshold=2, idle="9 days"), f"{tmp_path}/out", f"{tmp_path}/check").collect()
    want, streak = {}, collections.Counter()
    for key, i, _, ok in rows:
        streak[key] = 0 if ok else streak[key] + 1
        want[i] = (key, streak[key], streak[key] >= 2)
    assert {r.event_id: (r.key, r.streak, r.tripped) for r in got} == want
    assert spark.read.format("statestore").load(f"{tmp_path}/check").count() <= 2


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"], indirect=True)
def test_streaks_end_with_their_state_in_any_time_zone(spark, tmp_path, zone):
    """State goes once the watermark is an hour past a key's last event, neither before nor long behind it."""
    schema = "key string, event_id long, ts timestamp, ok boolean"
    batches = [[("a", 1, 0, False)], [("b", 2, 50, True)], [("a", 3, 55, False)], [("b", 4, 200, True)], [("b", 5, 210, True)], [("a", 6, 215, False)]]
    jobs.replay([spark.createDataFrame([(k, i, _at(m), ok) for k, i, m, ok in b], schema) for b in batches], f"{tmp_path}/in")
    stream = jobs.stream_of(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    got = jobs.drain(jobs.failure_streaks(stream, threshold=2), f"{tmp_path}/out", f"{tmp_path}/check").collect()
    # a's second failure is within the hour; its third comes when the streak is forgotten
    assert {r.event_id: (r.ts, r.streak, r.tripped) for r in got if r.key == "a"} == {
        1: (_at(0), 1, False), 3: (_at(55), 2, True), 6: (_at(215), 1, False),
    }


@pytest.mark.parametrize("few", [keyed.FEW, 0])
def test_keyed_inserts_read_few_folders(spark, tmp_path, monkeypatch, few):
    """The same whether the batch's bits are sent to the index or shuffled with it."""
    monkeypatch.setattr(keyed, "FEW", few)
    schema = spark.createDataFrame([], "k long, j string, n int").schema
    table = KeyedTable(f"file://{tmp_path}/t", schema, ("k", "j"), buckets=8, expected_keys=1 << 14)
    rows = lambda r: spark.createDataFrame(r, schema)
    table.insert(rows([(i, "x", 0) for i in range(1000)]), 0, ["n"])
    table.insert(rows([(i, "x", 0) for i in range(1000, 2000)]), 1, ["n"])
    # one known key, new ones, a repeated one and keys with nulls
    batch = rows([(5, "x", 9), (-1, "x", 2), (-1, "x", 1), (None, "x", 3), (None, "x", 3), (7, None, 4)])
    _, part = table.holding(spark, batch, 2)
    read = {r[0].split("/rows/")[1].rsplit("/", 1)[0] for r in part.select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(read) <= 3 and all(f.startswith("batch=0/") for f in read)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0]
    for _ in range(2):  # a batch that comes again adds nothing
        added = sorted(((r.k, r.j, r.n) for r in table.insert(batch, 2, ["n"]).collect()), key=repr)
        assert added == sorted([(-1, "x", 1), (None, "x", 3), (None, "x", 3), (7, None, 4)], key=repr)
        assert table.read(spark).count() == 2004
    copy = table.compacted(spark, f"file://{tmp_path}/copy")
    assert copy.read(spark).count() == 2004
    assert copy.insert(rows([(1500, "x", 0), (2500, "x", 0)]), 3, ["n"]).count() == 1
    assert table.read(spark).where("k = 5").first().n == 0


def test_keyed_inserts_of_nothing_and_into_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], "k string").schema
    table = KeyedTable(f"file://{tmp_path}/t", schema, ("k",))
    assert table.read(spark).count() == 0
    assert table.insert(spark.createDataFrame([], schema), 0, ["k"]).count() == 0
    assert table.insert(spark.createDataFrame([("a",), ("a",)], schema), 1, ["k"]).count() == 1
    assert [r.k for r in table.read(spark).collect()] == ["a"]


def test_daily_series(spark, tmp_path):
    path = f"file://{tmp_path}/series"
    write = jobs.track_batches(path, "asin", "at", ["price"], "tie")
    rows = lambda *r: spark.createDataFrame(r, "asin string, at timestamp, price double, tie long")
    day = 24 * 60
    first = rows(("a", _at(10), 1.0, 1), ("a", _at(20), 2.0, 2), ("b", _at(day), 3.0, 3), (None, _at(5), 9.0, 4), ("c", None, 9.0, 5))
    write(first, 0)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "series").rglob("*.parquet")}
    before = files()
    write(rows(("b", _at(day + 5), 4.0, 6), ("c", _at(day + 1), 5.0, 7)), 1)
    kept = {p for p in files() if "snapshot_date=2024-01-01" in str(p)}
    assert kept and kept <= before.keys()  # another day's files are left as they are
    table = lambda: sorted((r.asin, str(r.snapshot_date), r.price) for r in spark.read.parquet(path).collect())
    want = [("a", "2024-01-01", 2.0), ("b", "2024-01-02", 4.0), ("c", "2024-01-02", 5.0)]
    assert table() == want
    write(first, 0)  # an old batch comes again, behind later ones
    assert table() == want


def test_items_wait_for_their_details(spark, tmp_path):
    """Several files a side; one item's page comes late, one too late, one never; the same as the join of tables."""
    items = [(i, _at(i * 10), f"/dp/B{i:09d}") for i in range(12)] + [(99, _at(800), "none")]
    details = [(100 + i, f"https://x/dp/B{i:09d}", _at(i * 10 + wait)) for i, wait in ((0, 0), (1, 5), (2, 59), (3, 61), (5, -1), (6, 30), (6, 40))]
    details += [(200, "https://x/other", _at(20)), (201, "https://x/dp/B999999999", _at(800))]
    pages = spark.createDataFrame(items, "page_id long, found_at timestamp, html string")
    captures = spark.createDataFrame(details, "page_id long, url string, arrived_at timestamp")
    streams = []
    for name, frame, ts in (("a", pages, "found_at"), ("b", captures, "arrived_at")):
        jobs.replay(jobs.by_time(frame, ts, 4), f"{tmp_path}/{name}")
        streams.append(jobs.stream_of(spark, f"{tmp_path}/{name}", frame.schema, files_per_batch=1))
    sides = [(flow.found_items(p, "found_at"), flow.arrived_details(c, "arrived_at")) for p, c in ((pages, captures), streams)]
    tables, arriving = (flow.items_with_details(i, d, "60 minutes") for i, d in sides)
    got = jobs.drain(arriving, f"{tmp_path}/out", f"{tmp_path}/check")
    read = lambda df: sorted(((r.page_id, r.asin, r.detail_id) for r in df.collect()), key=repr)
    want = read(tables)
    assert read(got) == want
    assert {(p, d) for p, _, d in want} >= {(0, 100), (1, 101), (2, 102), (3, None), (4, None), (5, None), (6, 106)} and len(want) == 13


def test_progress_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, _at(i)) for i in range(40)], "n long, ts timestamp")
    jobs.replay(jobs.by_time(rows, "ts", 4), f"{tmp_path}/in")
    stream = jobs.stream_of(spark, f"{tmp_path}/in", rows.schema, files_per_batch=1)
    watched = flow.counted(stream, "own", {"rows": F.count("*"), "even": F.count_if(F.col("n") % 2 == 0)})
    listener = flow.ProgressRows(spark, f"file://{tmp_path}/rows", "own")
    spark.streams.addListener(listener)
    query = jobs.flush(watched, lambda batch, _: batch.write.format("noop").mode("append").save(), f"{tmp_path}/check")
    query.awaitTermination()
    listener.wait(query)
    spark.streams.removeListener(listener)
    found = flow.progress_rows(spark, f"file://{tmp_path}/rows")
    assert found.where("name = 'rows'").agg(F.sum("value"), F.countDistinct("batch_id")).first() == (40.0, 4)
    assert found.where("name = 'even'").agg(F.sum("value")).first()[0] == 20.0
