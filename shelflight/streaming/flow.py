"""Found items on to their details while both still arrive, and a running job's own figures."""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from shelflight.functions import urls

#: Rows of ``ProgressRows``: a figure of a batch of a stream.
PROGRESS = "query string, batch_id long, name string, value double"


def _watched(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """The watermark stands on all rows that arrive, so that those without a find move it too."""
    return rows.withWatermark(ts, delay) if rows.isStreaming else rows


def found_items(pages: DataFrame, found_at: str, delay: str = "10 minutes") -> DataFrame:
    """(page_id, found_at, pos, asin) of every distinct item of arriving pages."""
    return _watched(pages, found_at, delay).select("page_id", F.col(found_at).alias("found_at"), F.posexplode(urls.first_items(F.col("html"), None)).alias("pos", "asin"))


def arrived_details(captures: DataFrame, arrived_at: str, delay: str = "10 minutes") -> DataFrame:
    """(asin, detail_id, arrived_at) of arriving detail pages, by the item in their URL; other pages are left out."""
    asin = urls.item_id(F.col("url"))
    rows = _watched(captures, arrived_at, delay).select(asin.alias("asin"), F.col("page_id").alias("detail_id"), F.col(arrived_at).alias("arrived_at"))
    return rows.where("asin is not null")


def items_with_details(items: DataFrame, details: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Each found item with each detail page of it that arrives up to ``wait`` behind it; works on streams and on tables.

    As streams, an item that gets a detail page is given out when the later of the
    two is there. An item without one is given out once, with nulls, when the
    watermarks of both sides have passed the time it could wait; its state is
    dropped then. Rows later than the watermark are dropped.
    """
    right = details.withColumnRenamed("asin", "detail_asin")
    right = right if right.isStreaming else right.hint("merge")
    on = (
        (F.col("asin") == F.col("detail_asin"))
        & (F.col("arrived_at") >= F.col("found_at"))
        & (F.col("arrived_at") <= F.col("found_at") + F.expr(f"interval {wait}"))
    )
    return items.join(right, on, "left_outer").drop("detail_asin")


def counted(events: DataFrame, name: str, counters: dict[str, Column]) -> DataFrame:
    """``events`` with counters that each batch reports under ``name``."""
    return events.observe(name, *[c.cast("double").alias(k) for k, c in counters.items()])


class ProgressRows(StreamingQueryListener):
    """Writes the figures of each batch of the streams that report ``name``: a row for each counter, as they end, below ``path``.

    Add it by ``spark.streams.addListener`` before the stream starts. A batch whose
    report comes again writes the same file again. ``wait`` returns when the report
    of the stream's end is in.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: object) -> threading.Event:
        return self.ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._end(event.runId)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        seen = progress.observedMetrics.get(self.name)
        if seen is None:
            return
        values = {k: v for k, v in seen.asDict().items() if v is not None} | {"input_rows": float(progress.numInputRows)}
        lines = [
            json.dumps({"query": str(progress.id), "batch_id": progress.batchId, "name": k, "value": v}) for k, v in values.items()
        ]
        self._put(f"{progress.id}-{progress.batchId:08d}.json", "\n".join(lines) + "\n")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._end(event.runId).set()

    def wait(self, query, seconds: float = 60.0) -> None:
        if not self._end(query.runId).wait(seconds):
            raise TimeoutError("the stream's last report did not come")

    def _put(self, name: str, text: str) -> None:
        """A small file through Hadoop, so that any store will do."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``ProgressRows`` wrote."""
    return spark.read.schema(PROGRESS).json(path)
