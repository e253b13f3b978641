"""Indexes of the driver's tables that are kept in the shared folder, one for each state of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.segments import SegmentedIndex
from ..operators.snapshots import Bundle
from ..session import shared_dir, table


def revised(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with a revision that changes with their columns."""
    return rows.withColumn("revision", F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def stored_index(spark, sf_dir: str, columns: tuple[str, ...] = ("text",), kind: str = "documents") -> SegmentedIndex:
    """The index of `documents`; it is built once for each content of the table, and found by the digest of all rows."""
    rows = revised(table(spark, sf_dir, "documents").select("doc_id", *columns), *columns)
    state = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id", "revision")).alias("x")).first()
    index = SegmentedIndex(Bundle(spark, f"{shared_dir(spark)}/index-{kind}-{'-'.join(columns)}-{state.n}-{state.x or 0:x}"), "doc_id", columns)
    if not index.bundle.current():
        index.apply(rows)
    return index.at(index.bundle.current())
