"""The setting of the vector search that misses nothing."""

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import ann


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(160, 6)), 1)  # with ties
    v[40:60] = v[20]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v) if np.any(r)]
    odd = [(1000, None), (1001, [0.0] * 6), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0, k=7, block_rows=50, query_rows=6, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids = np.array([i for i, _ in rows])
    want = ann.brute_force(ids, v[ids], ids[ids % 10 == 0], 7)
    assert got == want
    few = ann.search(df.where("vec_id < 3"), F.col("vec_id") == 0, k=7, exact=True)
    assert few.count() == 2 and ann.search(df.where("false"), F.col("vec_id") == 0, exact=True).count() == 0
