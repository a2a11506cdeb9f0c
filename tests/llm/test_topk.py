"""Exact top-k search against brute force."""

import math
import random

import numpy as np
import pytest
from medley.llm import topk
from pyspark.sql import functions as F


def plain(rows, is_query, k):
    vectors = {}
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = [math.floor(64 * x) for x in vector]
        vectors[vec_id] = min(own, vectors.get(vec_id, own))
    out = []
    for q in vectors:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("slice_rows,pilots", [(65_536, 4096), (40, 30), (7, 1)])
def test_the_test_table(spark, slice_rows, pilots):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in rows.collect()], lambda i: i % 20 == 0, 20)
    got = topk.search(topk.integer_vectors(rows), F.col("vec_id") % 20 == 0, 20, slice_rows=slice_rows, pilots=pilots)
    assert found(got) == want


def test_awkward_rows(spark):
    rng = random.Random(2)
    same = [0.25, -0.5, 0.125, 1.0]
    rows = [(i, same) for i in range(0, 300, 2)] + [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(1, 60, 2)]
    rows += [(-20, [0.0] * 4), (1000, None), (1020, [1.0, None, 0.0, 0.0]), (1040, [float("nan")] * 4), (None, same)]
    rows += [(1060, [float("inf"), 0.0, 0.0, 0.0]), (1080, []), (1100, [2.0]), (0, same), (0, [9.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("slice", F.lit(1))
    for slice_rows in (1000, 30):
        got = topk.search(topk.integer_vectors(frame), F.col("vec_id") % 20 == 0, 20, slice_rows=slice_rows, pilots=25)
        assert found(got) == plain(rows, lambda i: i % 20 == 0, 20)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(20, [1.0])], [(20, [1.0]), (40, [-1.0])]):
        got = topk.search(topk.integer_vectors(spark.createDataFrame(rows, schema)), F.col("vec_id") % 20 == 0, 20)
        assert found(got) == plain(rows, lambda i: i % 20 == 0, 20)


def test_bounds_hold_at_every_level_and_get_tighter():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-90, 90, (50, 64)), rng.integers(-90, 90, (70, 64))
    exact = a @ b.T
    before = np.full(exact.shape, np.inf)
    for segments in (1, 4, 16, 64):
        bound = topk.statistics(a, segments) @ topk.statistics(b, segments).T
        assert (bound >= exact - 1e-6).all() and (bound <= before + 1e-6).all()
        before = bound
