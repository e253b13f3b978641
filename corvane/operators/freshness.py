"""What of an index is out of date, and the control rows of incremental runs: plain tables, compared by joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stale


def planned_chunks(rows: DataFrame, key: str, n_chunks: str) -> DataFrame:
    """key, chunk_id: the ids `key#0` .. `key#n-1` that an index of the rows has to hold."""
    each = rows.where(F.col(n_chunks) > 0).select(key, F.explode(F.sequence(F.lit(0), F.col(n_chunks).cast("int") - 1)).alias("i"))
    return each.select(key, F.concat_ws("#", F.col(key).cast("string"), F.col("i").cast("string")).alias("chunk_id"))


def stale_parents(planned: DataFrame, indexed: DataFrame, parent: str, child: str, fingerprint: list[str] = ()) -> DataFrame:
    """parent, reason of those with a child that is missing from the index, differs there in `fingerprint`, or is there without being planned."""
    keys = [parent, child]
    return stale(planned.select(*keys, *fingerprint), indexed.select(*keys, *fingerprint), keys, list(fingerprint)).select(parent, "reason").distinct()


def closed(control: DataFrame, end: str, last: str, today: Column, days: int) -> Column:
    """Whether an entity needs no more runs: it ended more than `days` ago and has been run before."""
    return F.col(last).isNotNull() & (F.datediff(today, F.col(end)) > days)


def unseen(files: DataFrame, ledger: DataFrame, identity: list[str]) -> DataFrame:
    """Files that no row of the ledger names by all of `identity`."""
    return files.join(ledger.select(*identity), identity, "left_anti")


def advanced(control: DataFrame, seen: DataFrame, key: str, mark: str, monotonic: bool = True) -> DataFrame:
    """The control table with each key's mark moved to the greatest seen; `monotonic` marks never move back."""
    new = seen.groupBy(key).agg(F.max(mark).alias("new__"))
    moved = F.greatest(mark, "new__") if monotonic else F.coalesce("new__", mark)
    return control.join(new, key, "full_outer").select(key, moved.alias(mark))


def retry_first(todo: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """What is to be done, and what has failed before, with `attempt`: 0 for the latter, which come first."""
    again = failed.select(*keys).distinct()
    return again.withColumn("attempt", F.lit(0)).unionByName(todo.select(*keys).join(again, keys, "left_anti").withColumn("attempt", F.lit(1)))


def resumed(rows: DataFrame, key: str, cursor: DataFrame, snapshot: Column) -> DataFrame:
    """Rows beyond the cursor of an interrupted run, if its snapshot is still this one; else all. `cursor` (last_key, snapshot) has at most one row."""
    last = cursor.agg(F.max(F.when(F.col("snapshot") == snapshot, F.col("last_key"))).alias("last__"))  # one row
    return rows.crossJoin(F.broadcast(last)).where(F.col("last__").isNull() | (F.col(key) > F.col("last__"))).drop("last__")


def changed_revisions(rows: DataFrame, indexed: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Rows whose (key, identity) the index doesn't hold."""
    return rows.join(indexed.select(key, *identity), [key, *identity], "left_anti")


MAINTENANCE = ("status", "text", "embeddings", "both")


def maintenance(text: bool = False, embeddings: bool = False, both: bool = False, resume: bool = False, stale_only: bool = False, batch: int = 100) -> dict:
    """A maintenance request, checked: at most one of the three rebuilds; resume and stale-only exclude each other and need one."""
    asked = [n for n, on in zip(MAINTENANCE[1:], (text, embeddings, both), strict=True) if on]
    if len(asked) > 1 or resume and stale_only or (resume or stale_only) and not asked or batch < 1:
        raise ValueError("the flags of a maintenance request exclude each other")
    return {"what": asked[0] if asked else "status", "resume": resume, "stale_only": stale_only, "batch": batch}


def each_or_error(rows: DataFrame, value: Column, valid: Column) -> DataFrame:
    """rows, `value` and `error`: a row that isn't valid keeps a null value and says so, and fails nothing else."""
    return rows.withColumn("error", F.when(F.coalesce(valid, F.lit(False)), F.lit(None).cast("string")).otherwise("invalid")).withColumn("value", F.when(F.col("error").isNull(), value))


@dataclass(frozen=True)
class Derived:
    """A table that is made from others, with what it should hold and what it holds.

    `planned` and `held` have key and fingerprint, and may have metadata (what was copied beside the content); `planned` may have
    day. `parents` names tables of the graph with the rows (parent_key, key) that tell what a row is made from. Rows of the
    snapshot's day and later are made anew, as a day may have gone on after the snapshot.
    """

    name: str
    planned: DataFrame
    held: DataFrame
    parents: tuple[tuple[str, DataFrame], ...] = ()
    snapshot: str | None = None


#: Why a row is stale, the weightiest first.
REASONS = ("missing", "orphan", "changed", "metadata", "same day", "upstream")


def _full(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names])


def freshness_graph(tables: list[Derived]) -> DataFrame:
    """table, key, reason, level of every stale row. A row made from a stale one is stale itself, level by level; parents come before their children in the list."""
    found: dict[str, tuple[int, DataFrame]] = {}
    for t in tables:
        unknown = [p for p, _ in t.parents if p not in found]
        if unknown:
            raise ValueError(f"{t.name} comes before {', '.join(unknown)}")
        names = ["key", "fingerprint", "metadata"]
        planned = _full(t.planned, [*names, "day"]).select(F.col("key"), *[F.col(c).alias(f"p_{c}") for c in (*names[1:], "day")], F.lit(True).alias("p_"))
        held = _full(t.held, names).select(F.col("key"), *[F.col(c).alias(f"h_{c}") for c in names[1:]], F.lit(True).alias("h_"))
        both = planned.join(held, "key", "full_outer")
        said = [F.when(F.col("h_").isNull(), "missing"), F.when(F.col("p_").isNull(), "orphan"), F.when(~F.col("p_fingerprint").eqNullSafe(F.col("h_fingerprint")), "changed")]
        said += [F.when(~F.col("p_metadata").eqNullSafe(F.col("h_metadata")), "metadata")]
        if t.snapshot is not None:
            said += [F.when(F.col("p_day") >= F.lit(t.snapshot), "same day")]
        own = both.select("key", F.coalesce(*said).alias("reason"))
        level = 0
        if t.parents:
            level = 1 + max(found[p][0] for p, _ in t.parents)
            above = reduce(DataFrame.unionByName, [made.join(found[p][1].select(F.col("key").alias("parent_key")), "parent_key", "left_semi").select("key") for p, made in t.parents])
            own = own.join(above.distinct().withColumn("up_", F.lit(True)), "key", "left")
            own = own.select("key", F.coalesce("reason", F.when(F.col("up_"), "upstream")).alias("reason"))
        found[t.name] = (level, own.where("reason IS NOT NULL"))
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("table"), F.col("key").cast("string").alias("key"), "reason", F.lit(level).alias("level")) for name, (level, rows) in found.items()])


def stale_hint(stale_rows: DataFrame, tables: list[str]) -> DataFrame:
    """table, n_stale, hint: whether a search of each table should say that it may miss something."""
    n = stale_rows.groupBy("table").agg(F.count("*").alias("n"))
    every = reduce(DataFrame.unionByName, [stale_rows.sparkSession.range(1).select(F.lit(t).alias("table")) for t in tables])
    counted = every.join(n, "table", "left").select("table", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_stale"))
    return counted.withColumn("hint", F.when(F.col("n_stale") > 0, F.concat(F.col("table"), F.lit(": "), F.col("n_stale").cast("string"), F.lit(" stale rows"))))
