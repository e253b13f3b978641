"""What the operators of this folder share: table access, checkpoints, partition counts."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Most bytes of one Arrow batch between a JVM and its Python workers.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Arrow batches of the session are bounded in bytes from here on: both sides hold several copies of one, and texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session within one process (tests) may leave it unset; it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="corvane-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, eagerly, and its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts_for(rows_or_bytes: int, each: int, least: int = 1) -> int:
    """So many partitions that each holds about `each`; grows in proportion, without a cap."""
    return max(least, -(-int(rows_or_bytes) // each))


def release() -> None:
    """Gives freed memory of this process back to the system; a worker lives on, idle, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(f: Callable) -> Callable:
    """`f` of one or two tables, after which what it has freed is given back. (Spark counts the arguments.)"""

    def after(out):
        release()
        return out

    return (lambda t: after(f(t))) if f.__code__.co_argcount == 1 else lambda left, right: after(f(left, right))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches (views, not copies), so that a worker holds Python objects of few rows at once."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)
        release()
