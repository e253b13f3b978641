"""Relational building blocks: upserts on snapshots, newest-row dedup, freshness of derived tables, coverage intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import in_bracket, label_number


def by_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(ids.select(key), key, "left_semi")


def keyed(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def after(rows: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """The next page of n rows beyond a cursor."""
    return rows.where(F.col(key) > F.lit(cursor)).orderBy(key).limit(n)


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    if limit < 0 or offset < 0:
        raise ValueError("offset and limit can't be negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """The next snapshot: new rows replace old ones by key; columns in `keep` stay where the new value is null."""
    n = new.select(*keys, *[F.col(c).alias(f"{c}__new") for c in new.columns if c not in keys], F.lit(True).alias("is__new"))
    o = old.select("*", F.lit(True).alias("is__old"))
    joined = o.join(n, keys, "full_outer")
    rest = [c for c in old.columns if c not in keys]
    return joined.select(*keys, *[(F.coalesce(F.col(f"{c}__new"), F.col(c)) if c in keep else F.when(F.col("is__new"), F.col(f"{c}__new")).otherwise(F.col(c))).alias(c) for c in rest]).select(*old.columns)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_parents(old: DataFrame, bundle: DataFrame, parent: str) -> DataFrame:
    """All rows of the bundle's parents are replaced by the bundle."""
    return old.join(bundle.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(bundle.select(*old.columns))


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def bump_revisions(old: DataFrame, new: DataFrame, key: str, columns: list[str], revision: str = "revision") -> DataFrame:
    """key, revision, changed: one more where the contents differ, 1 for new keys."""
    o = old.select(key, F.col(revision), row_hash(columns).alias("was"))
    n = new.select(key, row_hash(columns).alias("now"))
    changed = F.col("was").isNull() | (F.col("was") != F.col("now"))
    return n.join(o, key, "left").select(key, (F.coalesce(F.col(revision), F.lit(0)) + changed.cast("int")).cast("int").alias("revision"), changed.alias("changed"))


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by `order`; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def oldest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def stale(source: DataFrame, index: DataFrame, keys: list[str], fingerprint: list[str]) -> DataFrame:
    """keys, reason: missing from the index, changed since, or orphaned in it."""
    missing = source.join(index, keys, "left_anti").select(*keys, F.lit("missing").alias("reason"))
    changed = source.join(index, [*keys, *fingerprint], "left_anti").join(index, keys, "left_semi").select(*keys, F.lit("changed").alias("reason"))
    orphans = index.join(source, keys, "left_anti").select(*keys, F.lit("orphan").alias("reason"))
    return reduce(DataFrame.union, [missing, changed, orphans]).distinct()


def contiguous(rows: DataFrame, parent: str, index: str) -> DataFrame:
    """parent, n, complete: whether its indexes are 0..n-1, each once."""
    a = rows.groupBy(parent).agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high"))
    return a.select(parent, "n", ((F.col("d") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("complete"))


def islands(rows: DataFrame, key: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Unions of intervals that overlap, touch or leave at most `gap` between them (integers or dates): key, start, end.

    A row without a start counts to its key's last union. Nothing opens a union before the first end of its key.
    """
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*key, start, end, F.coalesce((F.col(start) > F.try_add(before, F.lit(1 + gap))).cast("int"), F.lit(0)).alias("new"))  # nothing starts beyond the type's end
    return marked.select("*", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run")).groupBy(*key, "run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("run")


def due(control: DataFrame, last: str, now: Column, seconds: int, force: bool = False) -> DataFrame:
    """Entities whose last run is missing or at least `seconds` ago."""
    return control if force else control.where(F.col(last).isNull() | (F.unix_timestamp(now) - F.unix_timestamp(F.col(last)) >= seconds))


def list_members(rows: DataFrame, key: str, column: str, separator: str = ",") -> DataFrame:
    """key, member: a delimited list as rows, trimmed and in lower case, to be joined by equality."""
    return rows.select(key, F.explode(F.array_distinct(F.transform(F.split(column, separator), lambda x: F.lower(F.trim(x))))).alias("member")).where("member <> ''")


def bracket_join(rows: DataFrame, brackets: DataFrame, prefix: str, number: str, start: str, end: str, digits: int, width: int = 600) -> DataFrame:
    """Each row with every bracket of labels that its (prefix, number) lies in; an absent end is open.

    Closed brackets meet the rows by equality on (prefix, bucket), once in each bucket of `width` numbers they
    reach into. Open ones have no last bucket: they meet the rows of their prefix.
    """
    low, high = label_number(F.col(start), digits), label_number(F.col(end), digits)
    same = F.col(prefix) == F.substring(start, 1, digits)
    inside = in_bracket(F.col(prefix), F.col(number), F.col(start), F.col(end), digits)
    buckets = F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    closed = brackets.where(low <= high).withColumn("_reach", buckets)
    met = rows.withColumn("_bucket", F.floor(F.col(number) / width)).join(closed, same & (F.col("_bucket") == F.col("_reach")))
    onward = rows.join(brackets.where(F.col(end).isNull()), same & (F.col(number) >= low))
    return met.where(inside).drop("_bucket", "_reach").unionByName(onward.where(inside))


def like_members(rows: DataFrame, key: str, column: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """key, pattern where the comma-wrapped list is LIKE `%,pattern,%`, any case: wildcards in a pattern count, members aren't trimmed.

    A pattern and a list meet by equality on three letters that the pattern must have, and are then compared. Patterns without
    three letters between wildcards meet every list. `key` is unique.
    """
    wrapped = F.lower(F.concat(F.lit(","), F.col(column), F.lit(",")))
    asked = patterns.select(F.col(pattern)).where(F.col(pattern).isNotNull()).distinct()
    runs = F.split(F.lower(F.concat(F.lit(","), F.col(pattern), F.lit(","))), "[%_]+")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))
    # of the longest run the last letters, which tell more than the comma before it
    gram = F.when(longest["n"] >= 3, F.right(longest["r"], F.lit(3))).otherwise("")
    text = rows.select(key, wrapped.alias("text_")).where("text_ IS NOT NULL")
    grams = F.transform(F.sequence(F.lit(1), F.length("text_") - 2), lambda i: F.substring(F.col("text_"), i, 3))
    grams = F.when(F.length("text_") >= 3, grams).otherwise(F.array().cast("array<string>"))
    parts = text.select(key, F.explode(F.array_distinct(F.concat(grams, F.array(F.lit(""))))).alias("gram_"))
    met = parts.join(asked.withColumn("gram_", gram), "gram_").select(key, pattern)
    held = F.expr(f"text_ LIKE lower(concat('%,', replace({pattern}, '\\\\', '\\\\\\\\'), ',%'))")
    return met.join(text, key).where(held).select(key, pattern)
