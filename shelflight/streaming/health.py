"""Failure streaks and liveness of sources from one stateful processor.

Events of a source may arrive in any order and in any cut into batches: they wait
in a list state until the watermark has passed them, and are then taken by time.
So what comes out depends on the events only, not on how they came.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelflight.streaming.streaks import bucket_of, key_starts, streaks

#: kind is "event", with the streak behind it, or "quiet": no event since ``at`` (milliseconds) for the idle time.
HEALTH = "key string, kind string, event_id long, at long, streak int, tripped boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which stateful processors need; the setting is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class SourceHealth(StatefulProcessor):
    """State of a bucket of keys: events that wait for the watermark, the streak of each key with its last event's time, and how often each length of streak ended.

    A timer stands at the first waiting event, or where the first key will have been
    quiet for ``idle_ms``. A quiet key begins anew: its streak and its state go.
    Each state holds the keys of the bucket in arrays, so that it is read and
    written in a call and not by key or event.
    """

    def __init__(self, threshold: int, idle_ms: int):
        self.threshold, self.idle_ms = threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "keys array<string>, ts array<long>, event_ids array<long>, ok array<boolean>")
        self.present = handle.getValueState("present", "keys array<string>, streaks array<int>, last_at array<long>")
        self.lengths = handle.getMapState("lengths", "streak int", "keys array<string>, times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._advance([tuple(part[c].to_numpy() for c in ("key", "at", "event_id", "ok")) for part in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._advance([], timerValues)

    def close(self) -> None:
        pass

    def _advance(self, new: list[tuple], timer_values) -> pd.DataFrame:
        mark = timer_values.getCurrentWatermarkInMs()
        old = list(self.waiting.get()) if self.waiting.exists() else []
        n_old = sum(len(chunk[0]) for chunk in old)
        known, streak, last = self.present.get() if self.present.exists() else ([], [], [])
        columns = list(zip(*old, *new)) or [()] * 4
        names, at, event_id, ok = (_joined(c, t) for c, t in zip(columns, (object, np.int64, np.int64, bool)))
        codes, keys = pd.factorize(np.concatenate([np.array(known, dtype=object), names]))
        codes = codes[len(known) :]  # the known keys are the first ones
        here = np.arange(len(keys)) < len(known)  # keys with a last event
        streak, last = (np.concatenate([np.array(v, np.int64), np.zeros(len(keys) - len(known), np.int64)]) for v in (streak, last))

        ready = at <= mark
        order = np.lexsort((event_id, at, codes))
        order = order[ready[order]]
        code, when, good = codes[order], at[order], ok[order]
        first = key_starts(code)
        ends = np.append(first[1:], True)[: len(code)]
        before = np.where(first, last[code], np.roll(when, 1))
        broke = (~first | here[code]) & (when > before + self.idle_ms)
        behind = streaks(code, good, streak[code], broke)
        previous = np.where(first, streak[code], np.roll(behind, 1))
        ended = good | broke
        over = [(code[ended], previous[ended])]
        found = [(code, "event", event_id[order], when, behind), (code[broke], "quiet", None, before[broke], previous[broke])]
        streak[code[ends]], last[code[ends]], here[code[ends]] = behind[ends], when[ends], True

        rest = np.flatnonzero(~ready)
        following = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(following, codes[rest], at[rest])
        quiet = np.flatnonzero(here & (last + self.idle_ms <= mark) & (following > last + self.idle_ms))
        found.append((quiet, "quiet", None, last[quiet], streak[quiet]))
        over.append((quiet, streak[quiet]))
        here[quiet] = False

        if ready[:n_old].any():
            self.waiting.clear()
            self._wait(names, at, event_id, ok, rest)
        else:
            self._wait(names, at, event_id, ok, rest[rest >= n_old])
        if here.any():
            self.present.update((keys[here].tolist(), streak[here].tolist(), last[here].tolist()))
        else:
            self.present.clear()
        self._count(keys, *map(np.concatenate, zip(*over)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = min([*at[rest].tolist(), *(last[here] + self.idle_ms).tolist()], default=None)
        if due is not None:
            self.handle.registerTimer(max(due, mark + 1))
        return pd.concat([self._rows(keys, *part) for part in found], ignore_index=True)

    def _rows(self, keys, code, kind: str, event_id, at, streak) -> pd.DataFrame:
        """Rows of ``HEALTH``."""
        ids = pd.array(event_id if event_id is not None else [None] * len(code), dtype="Int64")
        tripped = (streak >= self.threshold) if kind == "event" else np.zeros(len(code), dtype=bool)
        columns = {"key": keys[code], "kind": np.full(len(code), kind, dtype=object), "event_id": ids, "at": at, "streak": streak.astype("int32"), "tripped": tripped}
        return pd.DataFrame(columns)

    def _wait(self, names, at, event_id, ok, chosen) -> None:
        """The chosen events wait, in one element of the list."""
        if len(chosen):
            self.waiting.appendValue(tuple(c[chosen].tolist() for c in (names, at, event_id, ok)))

    def _count(self, keys, code, streak) -> None:
        """Ended streaks by length and key, to be read from the state by operators of the stream."""
        for length in np.unique(streak[streak > 0]).tolist():
            counts = Counter(keys[code[streak == length]].tolist())
            if self.lengths.containsKey((length,)):
                for key, n in zip(*self.lengths.getValue((length,))):
                    counts[key] += n
            self.lengths.updateValue((length,), (list(counts), list(counts.values())))


def _joined(parts: tuple, dtype: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *[np.asarray(p, dtype=dtype) for p in parts]])


def source_health(events: DataFrame, threshold: int = 8, idle: str = "1 minute", delay: str = "10 seconds") -> DataFrame:
    """Streaks behind each event and quiet times of each key, each once, when the watermark has passed it.

    ``events`` has key, event_id, ts, ok; the rows are those of ``HEALTH`` with ts in
    place of at. Times count in milliseconds, as watermarks do, and reach the
    processor as numbers: pandas would show them in the session's time zone. Events
    of one time go by event_id. A key without an event for longer than ``idle`` is quiet
    and its streak ends. Rows without a key or time are left out; events later than
    ``delay`` behind the latest one are dropped by the watermark. State and timers lie
    by bucket of keys. Start the stream inside ``rocks_state``.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    whole = events.where("key is not null and ts is not null")
    millis = F.unix_millis("ts")
    found = (
        whole.select("key", "event_id", F.timestamp_millis(millis).alias("ts"), millis.alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"))
        .withColumn("bucket", bucket_of("key"))
        .withWatermark("ts", delay)
        .groupBy("bucket")
        .transformWithStateInPandas(SourceHealth(threshold, idle_ms), HEALTH, "Append", "EventTime")
    )
    return found.select("key", "kind", "event_id", F.timestamp_millis("at").alias("ts"), "streak", "tripped")
