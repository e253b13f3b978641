"""Interval coverage by a sweep over end points: what is covered, what isn't, and what a run adds.

Intervals are closed, over whole numbers or days. End points are added up by place first, so an interval that many rows
repeat counts once. Running sums go in two steps: each sorted part is added up, the parts' totals are carried
forward, and each part starts from what came before it. A key with most of the rows is spread over many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running_sums(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """rows, with each of `values` as its sum up to that row within the keys. (keys, order) has to be unique."""
    dealt = cut(rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("part_", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "part_").agg(*[F.sum(v).alias(f"{v}_all") for v in values])
    # a row for each part of a key
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, "part_", *[F.coalesce(F.sum(f"{v}_all").over(before), F.lit(0)).alias(f"{v}_before") for v in values])
    inside = Window.partitionBy(*keys, "part_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select(*[c for c in dealt.columns if c not in values], *[F.sum(v).over(inside).alias(v) for v in values])
    joined = summed.join(carried, [*keys, "part_"])
    return joined.select(*[c for c in rows.columns if c not in values], *[(F.col(v) + F.col(f"{v}_before")).alias(v) for v in values])


def _following(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """rows, with the next row's `order` within the keys, in the same two steps."""
    dealt = cut(rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("part_", F.spark_partition_id()))
    first = dealt.groupBy(*keys, "part_").agg(F.min(order).alias("first_"))
    after = first.select(*keys, "part_", F.lead("first_").over(Window.partitionBy(*keys).orderBy("part_")).alias("after_"))
    inside = Window.partitionBy(*keys, "part_").orderBy(order)
    joined = dealt.withColumn(name, F.lead(order).over(inside)).join(after, [*keys, "part_"])
    return joined.withColumn(name, F.coalesce(name, "after_")).drop("part_", "after_")


def _one_more(c: Column, days: bool) -> Column:
    return F.date_add(c, 1) if days else c + 1


def segments(sides: dict[str, DataFrame], keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end and for each side how many of its intervals cover all of that stretch, for every stretch between end points.

    Intervals with a null bound, or that end before they start, cover nothing.
    """
    events = None
    for name, rows in sides.items():
        days = dict(rows.dtypes)[start] == "date"
        whole = rows.where(F.col(start) <= F.col(end))
        at = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("n")), F.struct(_one_more(F.col(end), days).alias("at"), F.lit(-1).alias("n"))))
        e = whole.select(*keys, at.alias("e")).select(*keys, "e.at", *[(F.col("e.n") if s == name else F.lit(0)).alias(f"n_{s}") for s in sides])
        events = e if events is None else events.unionByName(e)
    counts = [f"n_{s}" for s in sides]
    points = events.groupBy(*keys, "at").agg(*[F.sum(c).alias(c) for c in counts])
    swept = _following(running_sums(points, keys, "at", counts), keys, "at", "next_").where("next_ IS NOT NULL")
    last = F.date_sub("next_", 1) if days else F.col("next_") - 1
    return swept.select(*keys, F.col("at").alias(start), last.alias(end), *counts)


def _joined(stretches: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Stretches that touch, as one."""
    days = dict(stretches.dtypes)[start] == "date"
    events = stretches.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("n")), F.struct(_one_more(F.col(end), days).alias("at"), F.lit(-1).alias("n")))).alias("e"))
    edges = events.select(*keys, "e.at", "e.n").groupBy(*keys, "at").agg(F.sum("n").alias("n")).where("n <> 0")
    pairs = _following(edges, keys, "at", "next_").where("n > 0")
    return pairs.select(*keys, F.col("at").alias(start), (F.date_sub("next_", 1) if days else F.col("next_") - 1).alias(end))


def missing(wanted: DataFrame, covered: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """What of the wanted intervals isn't covered: keys, start, end, as few and as long as can be."""
    s = segments({"wanted": wanted, "covered": covered}, keys, start, end)
    return _joined(s.where("n_wanted > 0 AND n_covered = 0"), keys, start, end)


def committed(covered: DataFrame, done: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The coverage after a run: intervals that overlap or touch are one."""
    s = segments({"old": covered, "new": done}, keys, start, end)
    return _joined(s.where("n_old > 0 OR n_new > 0"), keys, start, end)


def gaps(covered: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """What lies between the first and the last covered place of each key and isn't covered."""
    return _joined(segments({"covered": covered}, keys, start, end).where("n_covered = 0"), keys, start, end)
