"""Session windows, as a batch and as a stream, and continuous maintenance of a derived table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """key, started, n: runs of events no further apart than the gap."""
    w = events.select(key, F.col(ts).cast("timestamp").alias("t")).groupBy(key, F.session_window("t", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def stream_sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The same over a stream: a session is given out once the watermark has passed its end."""
    w = stream.withColumn("t", F.col(ts).cast("timestamp")).withWatermark("t", late).groupBy(key, F.session_window("t", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("started"), "n")


def maintain(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]):
    """Runs `merge` on each batch of new rows until all that is there has been taken."""
    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
