"""Structured Streaming jobs over arriving captures, fetch logs and sightings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelflight.functions import urls
from shelflight.sources.tables import first_rows, insert_or_ignore, materialise, remove_folder, table_at
from shelflight.streaming.streaks import bucket_of, key_starts, streaks


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder, or one file by name, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getFileStatus(at).isFile():  # a stream's source is a folder
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def by_time(df: DataFrame, ts: str, parts: int) -> list[DataFrame]:
    """``df`` in equal spans of ``ts``, the earliest first; rows without a time in the last."""
    at = F.col(ts).cast("timestamp").cast("double")
    low, high = df.agg(F.min(at), F.max(at)).first()
    width = ((high or 0.0) - (low or 0.0)) / parts or 1.0
    part = F.coalesce(F.least(F.floor((at - F.lit(low or 0.0)) / width), F.lit(parts - 1)), F.lit(parts - 1))
    return [df.where(part == k) for k in range(parts)]


def replay(frames: list[DataFrame], path: str) -> None:
    """Write frames below ``path`` one after another, a file each: a file source takes them in this order.

    All cores read a frame and choose its rows; one task writes the file.
    """
    for frame in frames:
        frame.repartition(1).write.mode("append").parquet(path)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet folder, and read it. The checkpoint resumes a run."""
    query = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def item_stream(pages: DataFrame, n: int | None = None) -> DataFrame:
    """Items of arriving pages, the first ``n`` distinct ones of a page if given, on to the next step while pages still come in."""
    return pages.select("page_id", F.posexplode(urls.first_items(F.col("html"), n)).alias("pos", "asin"))


def first_in_window(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First event of each key inside the watermark's delay; older state is dropped."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def first_of_run(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key over the whole run, however late: the state keeps every key."""
    return events.dropDuplicates(keys)


def counters(events: DataFrame, ts: str, width: str, delay: str, ok: Column) -> DataFrame:
    """Entries and failures of each tumbling window, once the watermark has passed it."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(~ok).alias("failed"))
        .select(F.col("w.start").alias("start"), "n", "failed")
    )


def daily_latest(events: DataFrame, key: str, ts: str, value: str, delay: str) -> DataFrame:
    """The last value of each key and day."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"), key)
        .agg(F.max_by(value, ts).alias(value), F.max(ts).alias("seen_at"))
        .select(F.col("w.start").cast("date").alias("snapshot_date"), key, value, "seen_at")
    )


def flush(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch to ``write`` with its id; the writer must bear a batch that comes twice."""
    return (
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def insert_batches(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``flush`` writer that adds unknown keys to a Parquet table, in a folder for each batch.

    A batch that runs again overwrites its own folder, so nothing is added twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        target = table_at(batch.sparkSession, path, batch.schema, recursiveFileLookup=True)
        own = f"{path}/batch-{batch_id:08d}"
        target = target.where(~F.input_file_name().contains(f"batch-{batch_id:08d}"))
        insert_or_ignore(target, batch, keys, order).write.mode("overwrite").parquet(own)

    return write


BUCKETS = 64


def keep_counts(path: str) -> Callable[[DataFrame, int], None]:
    """A ``flush`` writer that keeps child counts up to date with batches of changes (parent_node_id, op = insert or delete).

    Counts are signed sums, as many as the changes give, so they do not depend on
    how changes are cut into batches; a deletion may come before its insertion.
    Nodes lie in buckets by their hash. A batch reads and writes only the buckets
    that it changes, into a folder of its own number; the version of a bucket
    before it stays until the next batch is done. So a batch that runs again, even
    after one that broke off, begins from what the batches before it left.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("node_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        deltas = materialise(count_deltas(batch, spark.createDataFrame([], COUNTS)).select("*", bucket), "deltas")
        touched = [r.bucket for r in deltas.select("bucket").distinct().collect()]  # BUCKETS at most
        versions = _versions(spark, path, batch_id)
        before = _counts_in(spark, [versions[b][-1] for b in touched if b in versions])
        after = _added(before.unionByName(deltas.select("node_id", "child_count")))
        parted = after.select("*", bucket).repartition("bucket")
        parted.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/after-{batch_id:08d}")
        for own in versions.values():
            for old in own[:-1]:  # replaced before this batch began
                remove_folder(spark, old)

    return write


def count_deltas(changes: DataFrame, counts: DataFrame) -> DataFrame:
    """Child counts after a batch of changes (parent_node_id, op = insert or delete)."""
    signed = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    deltas = changes.where("parent_node_id is not null").select(F.col("parent_node_id").alias("node_id"), signed.cast("long").alias("child_count"))
    return _added(counts.unionByName(deltas))


def _added(counts: DataFrame) -> DataFrame:
    return counts.groupBy("node_id").agg(F.sum("child_count").alias("child_count"))


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[str]]:
    """The folders of each bucket by batch, of the batches that were written whole and come before the given one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in store.listStatus(root)) if store.exists(root) else []
    found: dict[int, list[str]] = {}
    for name in names:
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        late = before is not None and int(name.removeprefix("after-")) >= before
        if late or not store.exists(spark._jvm.org.apache.hadoop.fs.Path(own, "_SUCCESS")):
            continue
        for part in store.listStatus(own):
            if part.isDirectory():
                last = part.getPath().getName()
                found.setdefault(int(last.removeprefix("bucket=")), []).append(f"{path}/{name}/{last}")
    return found


def _counts_in(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(COUNTS).parquet(*folders) if folders else spark.createDataFrame([], COUNTS)


def kept_counts(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, child_count) after the last whole batch of ``keep_counts``; a count is below 0 where more was deleted than inserted."""
    return _counts_in(spark, [own[-1] for own in _versions(spark, path).values()])


COUNTS = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("child_count", T.LongType())])


def track_batches(path: str, key: str, ts: str, measures: list[str], tie: str) -> Callable[[DataFrame, int], None]:
    """A ``flush`` writer that keeps a daily series: the latest row of each key and day, in a table by snapshot_date.

    A batch reads and overwrites only the days of its own rows. The later of two
    rows of a day stays, by ``ts`` and then ``tie``, whichever came first; so a
    batch that comes again, or late, changes nothing that it should not. Rows
    without key or time are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = list(dict.fromkeys([key, *measures, ts, tie]))
        rows = batch.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(*columns, F.to_date(ts).alias("snapshot_date"))
        today = materialise(first_rows(rows, [key, "snapshot_date"], [ts, tie], last=True), "snapshot")
        days = [r.snapshot_date for r in today.select("snapshot_date").distinct().collect()]  # a row for each day of a batch
        if not days:
            return
        old = table_at(spark, path, today.schema).where(F.col("snapshot_date").isin(days)).select(*today.columns)
        new = materialise(first_rows(today.unionByName(old), [key, "snapshot_date"], [ts, tie], last=True), "series")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)

    return write


STREAK = "key string, event_id long, at long, streak int, tripped boolean"


def failure_streaks(events: DataFrame, threshold: int = 8, idle: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Running failures of each key since its last success, over batches.

    ``events`` has key, event_id, ts, ok. State is one number for each key, held
    by bucket of keys, and is dropped once the watermark (``delay`` behind the latest
    event) is ``idle`` past the key's last event. Inside a batch events go by time.
    Times reach the state as microseconds: pandas would show them in the session's
    time zone.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        known, streak, due = state.get if state.exists else ([], [], [])
        rows = None if state.hasTimedOut else pd.concat(list(parts))
        named = np.array(known, dtype=object)
        codes, keys = pd.factorize(named if rows is None else np.concatenate([named, rows["key"].to_numpy(object)]), use_na_sentinel=False)
        streak, due = (np.concatenate([np.array(v, np.int64), np.zeros(len(keys) - len(known), np.int64)]) for v in (streak, due))
        arrived = np.zeros(len(keys), dtype=bool)
        if rows is not None:
            rows = rows.assign(code=codes[len(known) :]).sort_values(["code", "at", "event_id"])
            code = rows["code"].to_numpy()
            found = streaks(code, rows["ok"].to_numpy(bool), streak[code])
            ends = np.append(key_starts(code)[1:], True)
            arrived[code] = True
            streak[code[ends]] = found[ends]
            latest = rows.groupby("code")["at"].max()
            due[latest.index] = np.fmax(latest.to_numpy() // 1000, mark) + idle_ms
            rows = rows.assign(streak=found.astype("int32"), tripped=found >= threshold)
            yield rows[["key", "event_id", "at", "streak", "tripped"]]
        kept = arrived | (due >= mark)  # a key whose events are here goes on, however late
        if kept.any():
            state.update((keys[kept].tolist(), streak[kept].tolist(), due[kept].tolist()))
            state.setTimeoutTimestamp(int(due[kept].min()))
        else:
            state.remove()

    found = (
        events.withColumns({"at": F.unix_micros("ts"), "ok": F.coalesce("ok", F.lit(False)), "bucket": bucket_of("key")})
        .withWatermark("ts", delay)
        .groupBy("bucket")
        .applyInPandasWithState(
            step, STREAK, "keys array<string>, streaks array<int>, due array<long>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
    return found.select("key", "event_id", F.timestamp_micros("at").alias("ts"), "streak", "tripped")


def went_quiet(events: DataFrame, key: str, ts: str, idle: str = "60 seconds", delay: str = "10 seconds") -> DataFrame:
    """(key, last_at): each time that a key had no event for ``idle``, as soon as the watermark shows it."""
    quiet = events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, idle).alias("w")).agg(F.count("*").alias("n"))
    return quiet.select(key, (F.col("w.end") - F.expr(f"interval {idle}")).alias("last_at"), "n")


def stale_keys(events: DataFrame, key: str, ts: str, as_of: Column, seconds: int = 60) -> DataFrame:
    """Keys with their last event, and whether it is older than ``seconds`` at ``as_of``."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_at"))
    return last.withColumn("stale", F.unix_timestamp(as_of) - F.unix_timestamp("last_at") >= seconds)
