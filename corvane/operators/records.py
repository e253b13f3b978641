"""Records: composition with their children, orders that are given by a list, checks of bundles, schema listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_children(parents: DataFrame, key: str, **children: tuple[DataFrame, list[str]]) -> DataFrame:
    """`parents` with an array column for each named child table (a frame with the key, and the columns of an entry, which also order it); empty where there are none."""
    out = parents
    for name, (rows, columns) in children.items():
        each = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(each, key, "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(each.schema[name].dataType)))
    return out


def place_in(value: Column, order: list[str]) -> Column:
    """Where a value stands in a list; what isn't in it comes last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def main_first(name: Column, main: Column) -> list[Column]:
    """Order: the main document, then the others without regard to case."""
    return [F.when(name == main, 0).otherwise(1).asc(), F.lower(name).asc_nulls_last(), name.asc_nulls_last()]


def main_member(members: Column, number: Column) -> Column:
    """The member (of an array of paths) that holds a number's main document: a lone one whose name starts with the number, not followed by a digit; of several the only one with just that name; else null."""
    low, base = F.lower(number), lambda m: F.lower(F.substring_index(m, "/", -1))
    mine = F.filter(members, lambda m: base(m).startswith(low) & ~F.substring(base(m), F.length(low) + 1, F.lit(1)).rlike("^[0-9]"))
    exact = F.filter(mine, lambda m: F.array_contains(F.transform(F.array(*map(F.lit, (".docx", ".doc", ".pptx", ".ppt"))), lambda e: F.concat(low, e)), base(m)))
    return F.when(F.size(mine) == 1, F.get(mine, F.lit(0))).when(F.size(exact) == 1, F.get(exact, F.lit(0)))


def conflicts(old: DataFrame, new: DataFrame, key: str, identity: str) -> DataFrame:
    """key, identity of new rows that give a known key another identity, or a known identity another key."""
    o = old.select(F.col(key).alias("old_key"), F.col(identity).alias("old_identity"))
    n = new.select(key, identity)
    by_key = n.join(o, (F.col(key) == F.col("old_key")) & (F.col(identity) != F.col("old_identity")), "left_semi")
    return by_key.union(n.join(o, (F.col(identity) == F.col("old_identity")) & (F.col(key) != F.col("old_key")), "left_semi")).distinct()


def bundle_faults(bundle: DataFrame, parent: str, source: str, document: str, count: str, main: str) -> DataFrame:
    """parent, fault of bundles whose sources or documents repeat, whose count is wrong, or whose main source is absent."""
    a = bundle.groupBy(parent).agg(
        F.count("*").alias("n"), F.countDistinct(source).alias("sources"), F.countDistinct(document).alias("documents"), F.max(count).alias("said"), F.bool_or(F.col(source) == F.col(main)).alias("has_main")
    )
    fault = F.when(F.col("sources") < F.col("n"), "repeated source").when(F.col("documents") < F.col("n"), "repeated document").when(F.col("said") != F.col("n"), "wrong count").when(~F.coalesce("has_main", F.lit(False)), "no main source")
    return a.select(parent, fault.alias("fault")).where("fault is not null")


def schema_listing(spark: SparkSession, **tables: DataFrame) -> DataFrame:
    """table_name, position, column_name, type of given tables."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def show_fields(rows: DataFrame, fields: str | list[str]) -> DataFrame:
    """The named columns (`all`: every one), in that order; an unknown name is an error."""
    names = rows.columns if fields == "all" else [f.strip() for f in fields.split(",")] if isinstance(fields, str) else list(fields)
    unknown = [n for n in names if n not in rows.columns]
    if unknown or not names:
        raise ValueError(f"unknown fields: {', '.join(unknown) or 'none given'}")
    return rows.select(*names)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one line of compact JSON, absent values as null."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def as_lines(rows: DataFrame, form: str = "table") -> DataFrame:
    """Each row as a line: tab-separated (`table`) or a Markdown table row, without the head; line breaks and separators in values become blanks."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n|]+" if form == "markdown" else r"[\t\r\n]+", " ") for c in rows.columns]
    if form == "table":
        return rows.select(F.concat_ws("\t", *clean).alias("value"))
    if form != "markdown":
        raise ValueError(f"unknown form: {form}")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |")).alias("value"))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A folder of CSV parts with a head each."""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)
