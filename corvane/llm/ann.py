"""Approximate nearest neighbours by collision counting over query-centred windows.

Every block of the base holds, for each of `projections` random directions, its vectors' projections
in sorted order (built once per task, all rows indexed). A query uses the `used` arrays in which its own
projection is farthest from 0: a direction that is nearly perpendicular to the query puts near and far
vectors into its window alike. From each it cuts a window around its projection; a vector met in enough
of them has collided often enough and is verified with its true inner product. "Enough" follows from
the query's projections: what a vector at the distance that the windows stand for is expected to reach,
less `SLACK` standard deviations. If that doesn't end the search, virtual rehashing widens all windows by
`ratio` and counts on: only the newly covered rings are read. A query ends in a block when its k-th best
verified vector is nearer than the radius the windows stand for, or when `budget` of the block plus 10 k
vectors have been verified, or when nothing is left.

The first radius of a block is a little less than the median k-th distance of `STARTS` of its queries; it
decides how many rounds there are, not what a round finds.

Largest inner product is reduced to least distance the usual way: with M the largest norm, base
vectors get one more component sqrt(M^2 - |x|^2) and queries are scaled to norm M with 0 there, which
leaves the order by inner product as the order by distance.

How it scales: base vectors go to blocks of about `block_rows`, queries to blocks of about
`query_rows`, and each pair of blocks is one bounded task (queries are a stated set that is to be held
against all rows; nothing is broadcast and nothing is collected but three numbers). Each pair gives k
rows a query; the best k are taken by a grouped top-k that keeps k rows per task.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, on
either side; nor do those of another length than the most common one; null ids take no part; repeated
ids are separate rows; ties go to the smaller id; fewer than k candidates give fewer rows; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_for

K, PROJECTIONS, USED, RATIO, BUDGET, SEED = 20, 512, 72, 1.03, 0.2, 20_241
BLOCK_ROWS, QUERY_ROWS = 16_384, 2_048
#: Half a window at radius 1, and by how many standard deviations a neighbour at that radius may fall short.
HALF_WIDTH, SLACK = 1.3, 0.9
#: Queries of which a block's first radius is taken, and the least that it can be (of the largest norm).
STARTS, LEAST_RADIUS = 64, 0.3
_GRID = np.linspace(-8, 8, 4001)
_NORMAL = np.array([0.5 * (1 + erf(t / sqrt(2))) for t in _GRID])


def _normal_below(t: np.ndarray) -> np.ndarray:
    return np.interp(t, _GRID, _NORMAL)


def directions(dims: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims + 1, projections))


def _index(base: np.ndarray, a: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each direction the places of the vectors in the order of their projections, and these."""
    order, ranked = np.empty((a.shape[1], len(base)), np.int32), np.empty((a.shape[1], len(base)), np.float32)
    for j in range(a.shape[1]):
        at = (base @ a[:-1, j] + last * a[-1, j]).astype(np.float32)
        order[j] = np.argsort(at)
        ranked[j] = at[order[j]]
    return order, ranked


def _first_radius(base: np.ndarray, queries: np.ndarray, scale: np.ndarray, top_norm: float, k: int) -> float:
    """0.9 of the median k-th distance of some queries, of the largest norm."""
    some = np.unique(np.linspace(0, len(queries) - 1, min(STARTS, len(queries))).astype(int))
    s = (queries[some] * scale[some, None]) @ base.T
    kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)] / top_norm**2
    return min(1.9, max(LEAST_RADIUS, 0.9 * float(np.median(np.sqrt(np.maximum(0, 2 - 2 * kth))))))


def _thresholds(t: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query, whose chosen projections are `t` (of a vector of norm 1), and each radius: the collisions that make a candidate.

    A vector at distance R of the query has the cosine c = 1 - R^2 / 2; in a direction where the query's
    projection is t its own lies normally about c t with variance 1 - c^2.
    """
    out = np.empty((len(t), len(radii)))
    for r, radius in enumerate(radii):
        c = 1 - radius**2 / 2
        deviation, shift = np.sqrt(max(1e-12, 1 - c * c)), (1 - c) * t
        p = _normal_below((HALF_WIDTH * radius + shift) / deviation) - _normal_below((shift - HALF_WIDTH * radius) / deviation)
        out[:, r] = np.maximum(1, p.sum(1) - SLACK * np.sqrt((p * (1 - p)).sum(1)))
    return out


def search_block(
    base: np.ndarray, base_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, top_norm: float,
    k: int = K, projections: int = PROJECTIONS, used: int = USED, ratio: float = RATIO, budget: float = BUDGET, seed: int = SEED,
    base_rows: np.ndarray | None = None, query_rows: np.ndarray | None = None, shares: list[float] | None = None,
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: places and inner products of the best k of this block that were found, its own row left out (told by row numbers; by ids where none are given).

    To `shares` goes, for each query, the share of the block that was verified.
    """
    n, dims = base.shape
    base_rows, query_rows = (base_ids, query_ids) if base_rows is None or query_rows is None else (base_rows, query_rows)
    a, used = directions(dims, projections, seed), min(used, projections)
    last = np.sqrt(np.maximum(top_norm**2 - (base * base).sum(1), 0))
    order, ranked = _index(base, a, last)
    scale = top_norm / np.sqrt((queries * queries).sum(1))
    at_query = (queries * scale[:, None]) @ a[:-1]
    chosen = np.argpartition(-np.abs(at_query), used - 1, axis=1)[:, :used]
    # radii on the sphere of that norm; after them a last round covers everything
    radii = _first_radius(base, queries, scale, top_norm, k) * ratio ** np.arange(200)
    radii = radii[radii < 2]
    threshold = _thresholds(np.abs(np.take_along_axis(at_query, chosen, 1)) / top_norm, radii)
    edges = np.empty((2, len(queries), used, len(radii)), np.int32)
    for j in range(projections):
        asks, slot = np.nonzero(chosen == j)
        for side, (sign, kind) in enumerate(((-1, "left"), (1, "right"))):
            at = at_query[asks, j][:, None] + sign * HALF_WIDTH * top_norm * radii
            edges[side, asks, slot] = np.searchsorted(ranked[j], at.astype(np.float32), side=kind)
    out, most = [], 10 * k + int(np.ceil(budget * n))
    for q in range(len(queries)):
        hits = np.zeros(n, np.int64)
        verified = np.asarray(base_rows == query_rows[q])
        own = int(verified.sum())
        arrays = order[chosen[q]]
        ids, scores, lo, hi, total = [], [], None, None, 0
        for r in range(len(radii) + 1):
            if total + own >= n:
                break
            if r == len(radii):
                found = np.flatnonzero(~verified)
            else:
                new_lo, new_hi = edges[0, q, :, r].tolist(), edges[1, q, :, r].tolist()
                if lo is None:
                    ring = [x[i:j] for x, i, j in zip(arrays, new_lo, new_hi, strict=True)]
                else:  # the windows grow: only the rings are counted
                    ring = [x[i:j] for x, i, j in zip(arrays, new_lo, lo, strict=True)] + [x[i:j] for x, i, j in zip(arrays, hi, new_hi, strict=True)]
                hits += np.bincount(np.concatenate(ring), minlength=n)
                lo, hi = new_lo, new_hi
                found = np.flatnonzero((hits >= threshold[q, r]) & ~verified)
            if len(found):
                verified[found] = True
                ids.append(found)
                scores.append(base[found] @ queries[q])
                total += len(found)
            if total >= most:
                break
            if total >= k and r < len(radii):
                kth = np.partition(np.concatenate(scores), total - k)[total - k]
                if np.sqrt(max(0.0, 2 * top_norm**2 - 2 * kth * scale[q])) <= radii[r] * top_norm:
                    break
        if shares is not None:
            shares.append(total / n)
        if ids:
            found, s = np.concatenate(ids), np.concatenate(scores)
            if len(found) > k:
                # products of equal vectors can differ in their last bits: who is that near to the k-th is told apart by exact scores
                slack = 4 * base.shape[1] * np.finfo(float).eps * top_norm * np.sqrt(queries[q] @ queries[q])
                found = found[s >= np.partition(s, len(s) - k)[len(s) - k] - slack]
            s = exact_scores(base[found], queries[q])
            first = np.lexsort((base_ids[found], -s))[:k]
            out.append((q, found[first], s[first]))
    return out


def exact_block(base: np.ndarray, base_ids: np.ndarray, queries: np.ndarray, k: int, base_rows: np.ndarray, query_rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """As `search_block`, with all of `base` verified, one query at a time."""
    out = []
    for q, query in enumerate(queries):
        others = np.flatnonzero(base_rows != query_rows[q])
        if len(others):
            s = exact_scores(base[others], query)
            first = np.lexsort((base_ids[others], -s))[:k]
            out.append((q, others[first], s[first]))
    return out


def exact_scores(base: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products added up component by component, so that equal vectors score equally wherever they stand."""
    total = np.zeros(len(base))
    for d in range(base.shape[1]):
        total += base[:, d] * query[d]
    return total


def _every(n: int):
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def search(
    vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
    projections: int = PROJECTIONS, used: int = USED, ratio: float = RATIO, budget: float = BUDGET, seed: int = SEED, exact: bool = False,
) -> DataFrame:
    """The k nearest found of every row for which `is_query` (a Column on `vec_id`) holds: query_id, rank, vec_id, score.

    With `exact` every vector of a block is verified, so that nothing is missed; it costs what comparing all of them costs.
    """
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = v.groupBy(F.size("v").alias("d")).agg(
        F.count("*").alias("n"), F.max(norm2).alias("m"), F.count_if(is_query).alias("q")
    )
    top = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_row bigint, query_id bigint, vec_id bigint, score double"
    if not top:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, top_norm = top[0]["d"], float(np.sqrt(top[0]["m"]))
    n_base, n_query = parts_for(top[0]["n"], block_rows), parts_for(top[0]["q"], query_rows)
    # ids may repeat: rows are told apart by numbers, which are fixed once
    v = cut(v.where(F.size("v") == dims).withColumn("row", F.monotonically_increasing_id()))
    number = F.xxhash64(F.lit(seed), F.col("vec_id"))
    base = v.select(
        F.pmod(number, F.lit(n_base)).alias("b"), _every(n_query).alias("q"), "vec_id", "row", "v"
    )
    asked = v.where(is_query).select(
        _every(n_base).alias("b"), F.pmod(number, F.lit(n_query)).alias("q"), "vec_id", "row", "v"
    )

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if left.num_rows and right.num_rows:
            x, y = (t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims) for t in (left, right))
            ids, asks, rows, own = (t.column(c).to_numpy() for c, t in (("vec_id", left), ("vec_id", right), ("row", left), ("row", right)))
            near = exact_block(x, ids, y, k, rows, own) if exact else search_block(x, ids, y, asks, top_norm, k, projections, used, ratio, budget, seed, rows, own)
            for q, found, s in near:
                got.append((np.full(len(found), own[q]), np.full(len(found), asks[q]), ids[found], s))
        parts = [np.concatenate(p) for p in zip(*got, strict=True)] if got else [*[np.empty(0, np.int64)] * 3, np.empty(0)]
        return pa.table(parts, ["query_row", "query_id", "vec_id", "score"])

    # (written, as a plan that needs no column of it, such as a count's, would take columns from the cells' inputs)
    near = cut(base.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInArrow(cell, schema))
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, k: int = K) -> dict[int, list[int]]:
    """The true neighbours, for recall tests."""
    at = {int(i): n for n, i in enumerate(ids)}
    out = {}
    for q in query_ids:
        s = exact_scores(vectors, vectors[at[int(q)]])
        best = np.lexsort((ids, -s))
        out[int(q)] = [int(ids[i]) for i in best if ids[i] != q][:k]
    return out
