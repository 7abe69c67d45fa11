"""Nearest vectors against brute force, and the bounds that choose what is reranked."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from joinery.llm import ann, queries


def brute(rows, asks, k=10):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in good:
        if asks(q):
            near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x, y)))), i) for i, y in good if i != q)[:k]
            out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect())


def test_query_equals_sql(same):
    same(queries.op1_nearest_vectors, queries.ORACLE_SQL["op1_nearest_vectors"])


def test_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(20).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, found = brute(rows, lambda q: q % 100 == 0), got(ann.search(df, F.col("vec_id") % 100 == 0))
    assert len(set(want) & set(found)) / len(want) >= 0.99


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [3.0, -1.0]), (None, [1.0, 1.0]), (9, [1e30, 1e-30])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    assert got(ann.search(df, F.lit(True))) == brute(rows, lambda q: True)
    assert ann.search(df.limit(0), F.lit(True)).collect() == []
    assert ann.search(df.filter("vec_id = 0"), F.lit(True)).collect() == []


def test_repeated_vectors_tie_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.5, 0.25] if i % 2 else [float(i), 1.0, 2.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(ann.search(df, F.col("vec_id") < 5)) == brute(rows, lambda q: q < 5)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    index = ann.Index(np.arange(2000), x, ann.centres(x[:500]), ann.rotation(64))
    held = []
    for q in rng.standard_normal((20, 64)):
        low, high = index.bounds(q)
        true = ann.distances(index.vectors, q) ** 2
        held.append((low <= true + 1e-9) & (true <= high + 1e-9))  # a vector at a centre is exact but for rounding
    assert np.mean(held) > 0.98  # two and a half standard deviations leave out 0.012


def test_bounds_fail_with_a_tiny_chance_only():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 64))
    index = ann.Index(np.arange(2000), x, ann.centres(x[:500]), ann.rotation(64))
    held = []
    for q in rng.standard_normal((40, 64)):
        low, high = index.bounds(q)
        true = ann.distances(index.vectors, q) ** 2
        held.append((low <= true + 1e-9) & (true <= high + 1e-9))
    assert np.mean(held) > 0.9997  # four standard deviations leave out 6e-5


def test_rows_of_one_id_are_queries_of_their_own(spark):
    rows = [(0, [0.0, 1.0]), (0, [5.0, 5.0]), (0, [5.0, 5.0]), (1, [1.0, 1.0]), (2, [4.0, 4.0]), (3, [0.0, 2.0]), (3, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") == 0, 3).collect())
    # from (0, 1): 1, 3 at (0, 2), 2; from (5, 5): 2, 1, then 3 at (9, 9) before (0, 2)
    assert found == sorted([(0, 1, 1), (0, 2, 3), (0, 3, 2), (0, 1, 2), (0, 2, 1), (0, 3, 3)])
