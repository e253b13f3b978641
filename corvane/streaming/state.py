"""Sessions kept in state per key, and results merged into versioned tables once per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.snapshots import Bundle
from ..operators.tables import upsert

_STATE = "starts array<bigint>, ends array<bigint>, counts array<bigint>"


def merged(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, count) of sessions, from such spans in any order: spans at most a gap apart are one, as in Spark's session windows."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def _keeper(key: str, gap: int):
    """Adds a key's new events to its open sessions, and gives out those that the watermark has passed by a gap."""

    def keep(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            # events of one moment count together
            spans += [(int(t), int(t), int(n)) for t, n in frame.groupby("micros").size().items()]
            spans = merged(spans, gap)
        mark = state.getCurrentWatermarkMs() * 1000
        done = [s for s in spans if s[1] + gap < mark]
        left = spans[len(done) :]  # they're sorted, and the first to end is the first
        if left:
            state.update(tuple([int(x) for x in c] for c in zip(*left, strict=True)))
            # (a timer may not lie before the watermark)
            state.setTimeoutTimestamp(max((left[0][1] + gap) // 1000 + 1, mark // 1000 + 1))
        else:
            state.remove()
        if done:
            yield pd.DataFrame({key: [keys[0]] * len(done), "started": pd.to_datetime([s[0] for s in done], unit="us"), "n": [s[2] for s in done]})

    return keep


def stateful_sessions(stream: DataFrame, key: str, ts: str, gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """key, started, n of each session, given out once: when the watermark has passed its end. Events may come in any order within `late`."""
    marked = stream.select(key, F.col(ts).cast("timestamp").alias("t")).withColumn("micros", F.unix_micros("t")).withWatermark("t", late)
    kind = dict(stream.dtypes)[key]
    return marked.groupBy(key).applyInPandasWithState(_keeper(key, gap_seconds * 1_000_000), f"{key} {kind}, started timestamp_ntz, n bigint", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def merging(bundle: Bundle, name: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: merges each batch's rows by key into a table of the bundle, together with the number of the batch.

    Table and number appear in one version, so a batch that is delivered again after a restart changes nothing.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        tables = bundle.pinned()
        done = f"{name} batches"
        if done in tables and not tables[done].where(F.col("batch") >= batch).isEmpty():
            # the state of the batch has to be made all the same
            rows.write.format("noop").mode("overwrite").save()
            return
        new = rows if name not in tables else upsert(tables[name], rows, keys)
        bundle.commit({name: new, done: rows.sparkSession.createDataFrame([(batch,)], "batch bigint")})

    return merge
