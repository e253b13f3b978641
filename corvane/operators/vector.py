"""Exact vector search: distance as a JVM expression, filters before the limit, best child per parent, ties at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where either vector is zero, null or of another length."""
    def of(ab: Column) -> Column:
        x, y = ab["a"], ab["b"]
        return F.when(F.size(x) == F.size(y), 1 - dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0)))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def knn(rows: DataFrame, query: list[float], key: str, vector: str, k: int = 20, where: Column | None = None, digits: int = 5) -> DataFrame:
    """key, distance: the k nearest of the rows that pass `where`; nulls last, ties to the smaller key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = (rows.where(where) if where is not None else rows).select("*", F.round(cosine_distance(F.col(vector), q), digits).alias("distance"))
    return scored.orderBy(F.asc_nulls_last("distance"), key).limit(k)


def best_per_parent(scored: DataFrame, parent: str, key: str, k: int | None = None, ties: bool = False) -> DataFrame:
    """parent, key, distance: each parent's nearest child; then the k nearest parents, with all that tie at the edge if asked for."""
    best = scored.groupBy(parent).agg(F.min(F.struct("distance", key)).alias("b")).select(parent, f"b.{key}", "b.distance")
    if k is None:
        return best
    if not ties:
        return best.orderBy(F.asc_nulls_last("distance"), parent).limit(k)
    # the edge is one number, found by a top-k, and then a filter: no window over all parents
    edge = best.orderBy(F.asc_nulls_last("distance"), parent).limit(k).agg(F.max("distance").alias("edge"))
    return best.join(F.broadcast(edge), F.col("distance") <= F.col("edge")).drop("edge")


def hashed_embedding(toks: Column, dims: int = 64) -> Column:
    """A deterministic offline embedding of tokens: hashed counts, L2-normed, as a full array; `encoding.sparse_vectors` has signed ones for many dimensions."""
    def spread(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(at, lambda a: a == d)).cast("double"))

    def normed(raw: Column) -> Column:
        return let(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n > 0, F.transform(raw, lambda x: x / n)).otherwise(raw))

    return let(let(F.transform(toks, lambda t: F.pmod(F.crc32(t), F.lit(dims)).cast("int")), spread), normed)


def rerank(hits: DataFrame, distances: DataFrame, key: str, order: str) -> DataFrame:
    """Text hits by their least distance; hits without one last, in their own order."""
    least = distances.groupBy(key).agg(F.min("distance").alias("distance"))
    return hits.join(least, key, "left").orderBy(F.asc_nulls_last("distance"), order)


def ranked(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """0-based ranks of a result that a limit has already made small."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(text: DataFrame, semantic: DataFrame, key: str, weight: float = 0.5, k: int = 60, digits: int = 8) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (key, rank from 0): key, score; what is in one list only counts there only."""
    a, b = text.select(key, F.col("rank").alias("ra")), semantic.select(key, F.col("rank").alias("rb"))
    both = a.join(b, key, "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(float(k)) + r), F.lit(0.0))
    return both.select(key, F.round(part(weight, F.col("ra")) + part(1 - weight, F.col("rb")), digits).alias("score")).orderBy(F.desc("score"), key)


#: The most rows that one window asks for.
MOST_ROWS = 4096


def widening(scored: DataFrame, parent: str, key: str, k: int, passes: Column | None = None, fanout: int = 8, most: int = MOST_ROWS) -> tuple[DataFrame, list[int]]:
    """Rows (parent, key, distance, place) of the first window that holds k distinct parents which pass, and how many rows each window had.

    For filters that can't go before the limit: windows of k * fanout nearest rows, doubled up to `most`, until
    enough parents pass or the rows end. Distances are computed once; of each parent only its first place tells
    how far the windows have to reach.
    """
    # at most `most` rows from here on
    window = scored.select(parent, key, "distance", (passes if passes is not None else F.lit(True)).alias("passes")).orderBy(F.asc_nulls_last("distance"), key).limit(most)
    window = cut(window.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("distance"), key))))
    kept = window.where("passes").drop("passes")
    first = kept.groupBy(parent).agg(F.min("place").alias("place")).orderBy("place").limit(k)
    reach = first.agg(F.count("*").alias("n"), F.max("place").alias("place")).first()
    rows, sizes = window.count(), []
    fetch = min(max(k * fanout, k), most)
    while True:
        sizes.append(min(fetch, rows))
        if reach.n >= k and reach.place <= fetch or rows < fetch or fetch >= most:
            return kept.where(F.col("place") <= fetch), sizes
        fetch = min(fetch * 2, most)


def grouped(rows: DataFrame, parent: str, key: str) -> DataFrame:
    """parent, rank (from 0), distance and the nearest child of each parent in a window."""
    best = rows.groupBy(parent).agg(F.min(F.struct("place", "distance", key)).alias("b"))
    return best.select(parent, (F.row_number().over(Window.orderBy("b.place")) - 1).alias("rank"), "b.distance", f"b.{key}")  # a window's rows
