"""Streaming forms of batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import manifest


def failure_windows(events: DataFrame, key: str, ts: str, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", limit: int = 5) -> DataFrame:
    """Failures of each key in sliding windows, and whether they reach the limit; state is bounded by the watermark."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, window, slide), key).agg(F.count("*").alias("failures"))
    return counts.select(key, F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), "failures", (F.col("failures") >= limit).alias("blocked"))


def match_stream(tracker: DataFrame, export: DataFrame) -> DataFrame:
    """Exact post matches of newly arriving tracker rows (note_id) against the export table: a stream-static join without state."""
    posts = export.dropDuplicates(["post_id"]).select("post_id", "blogger", "username")
    return tracker.join(posts, F.col("note_id") == F.col("post_id"), "left").withColumn("matched", F.col("post_id").isNotNull())


def ingest_stream(files: DataFrame, table: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], version: str, kind: str = "", shape: int = 1) -> StreamingQuery:
    """Ingest arriving files (path, content) into a manifest table, all that have arrived by now.

    A batch that is run again after a restart finds its contents recorded, so each content is parsed and stored once.
    """
    step = lambda batch, _: manifest.ingest(batch, table, parse, version, kind, shape)
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
