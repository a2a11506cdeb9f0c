"""Whitening against numpy over the plain list of distinct vectors."""

import math
from collections import Counter

import numpy as np
import pytest

from medley.llm import queries, whitening


def fair(vector):
    return vector is not None and len(vector) > 0 and all(c is not None and math.isfinite(c) for c in vector)


def plain(rows, scale=256, by_copies=False):
    """vec_id -> (n, deviation, projections over the root of the eigenvalue, explained), for one length."""
    kept = [(r.vec_id, tuple(math.floor(scale * float(c)) for c in r.embedding)) for r in rows if fair(r.embedding)]
    copies = Counter(x for _, x in kept)
    fit = [x for x, times in copies.items() for _ in range(times if by_copies else 1)]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:4]
    out = []
    for vec_id, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        along = (np.array(x) - np.array(sums) / n) @ vectors[:, order]
        out.append((vec_id, n, deviation, along / np.sqrt(np.maximum(values[order], 1e-300)), values[order] / values.sum()))
    return out


def check(frame, rows, **how):
    want = plain(rows, **{k: v for k, v in how.items() if k in ("scale", "by_copies")})
    got = {}
    for r in whitening.whiten(frame, **how).collect():
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len({w[0] for w in want}) == len({v for v, _ in got})
    signs = None
    for vec_id, n, deviation, along, explained in want:
        found = sorted(got[(vec_id, deviation)], key=lambda r: r.component)[:: len(got[(vec_id, deviation)]) // len(along)]
        assert [r.component for r in found] == list(range(1, len(along) + 1))
        assert {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-8
        np.testing.assert_allclose([r.explained for r in found], explained, rtol=1e-9)
        values = np.array([r.whitened for r in found])
        if signs is None and (np.abs(along) > 1e-3).all():
            signs = np.sign(values * along)
        np.testing.assert_allclose(np.abs(values), np.abs(along), atol=1e-8)
        if signs is not None:
            np.testing.assert_allclose(values * signs, along, atol=1e-8)
    assert sum(map(len, got.values())) == len(want) * len(want[0][3])


@pytest.fixture(scope="module")
def vectors(spark):
    """Repeated vectors, one of them very often; NULL, NaN, infinite and empty ones; clashing columns."""
    rng = np.random.default_rng(7)
    made = [[float(c) for c in rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.2]] for _ in range(150)]
    rows = [(i, made[i % 150]) for i in range(220)] + [(1000 + i, made[0]) for i in range(300)]
    rows += [(None, made[3]), (5, made[5]), (5, made[5]), (-7, [-0.0] * 6), (-8, [0.001] * 6)]
    rows += [(9001, None), (9002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (9003, [float("nan")] * 6), (9004, [float("inf")] * 6), (9005, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return frame.selectExpr("*", "'a' AS key", "1 AS x", "2 AS copies", "3 AS n", "4 AS length", "5 AS component").repartition(5)


@pytest.mark.parametrize("how", [{}, {"by_copies": True}, {"scale": 16}, {"hot_rows": 20}, {"hot_rows": 0}])
def test_whitening_equals_numpy(vectors, how):
    check(vectors, vectors.collect(), **how)


def test_each_distinct_vector_is_whitened_once(vectors):
    from medley.llm.whitening import integer_rows

    rows = integer_rows(vectors).collect()
    assert len({bytes(r.key) for r in rows}) == len({tuple(r.x) for r in rows}) < len(rows)


def test_lengths_are_fitted_apart(spark, nothing):
    rows = [(i, [float(i % 7), float(i * i % 11), 1.0][: 2 + i % 2]) for i in range(60)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(r.component for r in out) == {1: 60, 2: 60, 3: 30}
    # the third entry never varies: a component without variance
    assert {r.whitened for r in out if r.component == 3} == {None}
    assert {(r.vec_id % 2, r.n) for r in out} == {(0, len({(i % 7, i * i % 11) for i in range(0, 60, 2)})), (1, len({(i % 7, i * i % 11) for i in range(1, 60, 2)}))}
    assert max(r.identity_error for r in out) < 1e-9


def test_nothing_and_nothing_that_varies(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    (only,) = {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])] * 2, schema)).collect()}
    assert only == (1, 0, None, None, None)


def test_large_numbers_stay_exact(spark):
    big = [[1e6 + i, -1e12 * i, 3.5] for i in range(50)]
    x = np.array([[math.floor(256 * c) for c in row] for row in big], np.int64)
    n, sums = 50, tuple(int(s) for s in x.astype(object).sum(axis=0))
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, sums) == [e if e < 2**63 else None for e in exact] and max(exact) >= 2**63
    assert whitening._exact_sums(np.full((3, 1), 2**62), np.array([2, 2, 2])) == [6 * 2**62]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(big)] + [(99, [1e300, 0.0, 0.0])], "vec_id long, embedding array<double>")
    out = whitening.whiten(rows).collect()
    assert {r.n for r in out} == {51} and len(out) == 51 * 3


def test_query_over_the_test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = frame.collect()
    out = queries.QUERIES["op13_multiplicity_whitening"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(out.dtypes)["component"] == "int" and dict(out.dtypes)["deviation"] == "bigint"
    check(frame, rows)
