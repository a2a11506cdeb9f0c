import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from medley.functions import losses as L
from medley.operators import explore as X
from medley.operators import metrics as M
from medley.operators import scores as S


@pytest.fixture(scope="module")
def matrices():
    rng = np.random.default_rng(3)
    y = np.round(np.clip(rng.normal(size=(23, 5)), 0, None), 1)
    p = np.round(rng.normal(size=(23, 5)), 1)
    y[4], p[5], y[:, 3] = 0.0, 0.0, 0.7
    return y, p


@pytest.fixture(scope="module")
def pred(spark, matrices):
    y, p = matrices
    rows = [(i, d, float(y[i, d]), float(p[i, d])) for i in range(y.shape[0]) for d in range(y.shape[1])]
    return spark.createDataFrame(rows, "row_id long, dim int, y double, y_hat double").cache()


def tau_b(a, b):
    pairs = list(itertools.combinations(range(len(a)), 2))
    sa = [np.sign(a[i] - a[j]) for i, j in pairs]
    sb = [np.sign(b[i] - b[j]) for i, j in pairs]
    bottom = np.sqrt(sum(x != 0 for x in sa) * sum(x != 0 for x in sb))
    return sum(x * z for x, z in zip(sa, sb)) / bottom if bottom else None


def test_kendall_against_all_pairs(pred, matrices):
    y, p = matrices
    got = {r["dim"]: r["kendall"] for r in M.kendall(pred, ["dim"]).collect()}
    for d in range(5):
        want = tau_b(y[:, d], p[:, d])
        assert got[d] is None if want is None else got[d] == pytest.approx(want)
    flat = M.kendall(pred, []).collect()[0]["kendall"]
    assert flat == pytest.approx(tau_b(y.ravel(), p.ravel()))


def test_auroc_against_pairs(pred, matrices):
    y, p = matrices
    flagged = pred.withColumn("y", F.when(F.col("y") > 0.3, 1.9).otherwise(0.9))
    got = {r["dim"]: r["auroc"] for r in M.auroc(flagged, ["dim"]).collect()}
    for d in range(5):
        pos, neg = p[y[:, d] > 0.3, d], p[y[:, d] <= 0.3, d]
        if len(pos) == 0 or len(neg) == 0:
            assert got[d] is None
        else:
            wins = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
            assert got[d] == pytest.approx(wins / (len(pos) * len(neg)))


def test_constant_sides_have_no_correlation(pred):
    rows = {r["row_id"]: r["pearson"] for r in M.row_pearson(pred).collect()}
    assert rows[5] is None and rows[0] is not None
    assert {r["dim"]: r["pearson"] for r in M.column_pearson(pred).collect()}[3] is None


def test_all_pairs_rewrite_equals_brute_force(pred, matrices):
    y, p = matrices
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), where=np.linalg.norm(m, axis=1, keepdims=True) > 0, out=np.zeros_like(m))
    got = M.all_pairs_mean_cosine(pred).collect()[0]["cosine"]
    assert got == pytest.approx((unit(y) @ unit(p).T).mean())


def test_reductions(pred):
    scores = M.column_pearson(pred)
    values = [r["pearson"] for r in scores.collect() if r["pearson"] is not None]
    assert M.reduce_scores(scores, "pearson", "max").collect()[0]["pearson"] == pytest.approx(max(values))
    with pytest.raises(ValueError):
        M.reduce_scores(scores, "pearson", "median")


def test_r2_of_constant_truth(pred):
    assert {r["dim"]: r["r2"] for r in M.column_r2(pred).collect()}[3] == 0.0


@pytest.mark.parametrize("method", ["resample", "poisson"])
def test_bootstrap_brackets_the_estimate(pred, method):
    whole = M.errors(pred).collect()[0]["rmse"]
    bounds = M.bootstrap(pred, "rmse", 100, method=method).collect()[0]
    assert bounds["lower"] < whole < bounds["upper"]


@pytest.mark.parametrize("kind", ["cosine", "pearson", "squared"])
def test_distance_to_others(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9, 4))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {r["id"]: r["distance"] for r in X.mean_distance_to_others(rows, "id", "vec", kind).collect()}

    def distance(a, b):
        if kind == "squared":
            return ((a - b) ** 2).sum()
        if kind == "pearson":
            a, b = a - a.mean(), b - b.mean()
        return 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    for i in range(9):
        assert got[i] == pytest.approx(np.mean([distance(x[i], x[j]) for j in range(9) if j != i]))


def test_gram_co_occurrence_and_correlation(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.random((40, 3)), 2)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").repartition(5)
    hit = (x >= np.quantile(x, 0.75, axis=0)).astype(int)
    got = {(r["a"], r["b"]): r["n"] for r in X.co_occurrence(rows, "id", "vec", 3, 0.75).collect()}
    corr = {(r["a"], r["b"]): r["r"] for r in X.correlation_matrix(rows, "vec", 3).collect()}
    for a in range(3):
        for b in range(3):
            assert got[(a, b)] == (hit.T @ hit)[a, b]
            assert corr[(a, b)] == pytest.approx(np.corrcoef(x.T)[a, b])


def test_losses(pred, matrices):
    y, p = (m.ravel() for m in matrices)
    sig = 1 / (1 + np.exp(-p))
    mask = (y > 0).astype(float)
    bce = lambda t: (np.maximum(p, 0) - p * t + np.log1p(np.exp(-abs(p)))).mean()
    e = p - y
    tw = lambda t, m: (np.maximum(t, 1e-6) * np.maximum(m, 1e-6) ** -0.8 / -0.8 - np.maximum(m, 1e-6) ** 0.2 / 0.2)
    hub = np.where(abs(e) < 1, 0.5 * e * e, abs(e) - 0.5)
    want = {
        "mae": abs(e).mean(),
        "mse": (e * e).mean(),
        "bce": bce(y),
        "tweedie": tw(y, p).mean(),
        "huber": hub.mean(),
        "logcosh": np.log(np.cosh(e)).mean(),
        "quantile": np.maximum(0.5 * -e, -0.5 * -e).mean(),
        "mixed": tw(y, p)[y == 0].mean() + hub[y != 0].mean(),
        "focal": ((0.25 * mask + 0.75 * (1 - mask)) * (np.maximum(p, 0) - p * mask + np.log1p(np.exp(-abs(p))))
                  * (1 - (sig * mask + (1 - sig) * (1 - mask))) ** 2).mean(),
    }
    got = pred.agg(*[L.loss(k).alias(k) for k in want]).collect()[0].asDict()
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    with pytest.raises(ValueError):
        L.loss("hinge")
    with pytest.raises(ValueError):
        L.pinball(1.0)


def test_composite(pred, matrices):
    y, p = matrices
    cy, cp = y - y.mean(1, keepdims=True), p - p.mean(1, keepdims=True)
    pearson = (cy * cp).sum(1) / (np.sqrt((cp**2).sum(1) + 1e-6) * np.sqrt((cy**2).sum(1) + 1e-6))
    cos = (y * p).sum(1) / np.maximum(np.linalg.norm(y, axis=1) * np.linalg.norm(p, axis=1), 1e-8)
    mask = (y > 0).astype(float)
    bce = (np.maximum(p, 0) - p * mask + np.log1p(np.exp(-abs(p)))).mean()
    rmse = np.sqrt(((y - p) ** 2).mean() + 1e-6)
    want = bce + 2 * rmse + 3 * (1 - pearson).mean() + 4 * (1 - cos.mean())
    assert S.composite(pred, 1, 2, 3, 4).collect()[0]["score"] == pytest.approx(want)
    dy, dp = y - y.mean(0), p - p.mean(0)
    pooled = 1 - (dy * dp).mean() / (np.sqrt((dy**2).mean() * (dp**2).mean()) + 1e-6)
    got = S.composite_uncertain(pred).collect()[0]["score"]
    assert got == pytest.approx(bce + rmse + pooled + 1 - cos.mean())


@pytest.mark.parametrize("metric", ["rmse", "pearson"])
def test_bootstrap_of_many_rows_sends_draws_without_a_row_per_draw(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    cells = [(None if i == 7 else i % 60, d, float(rng.normal()), float(rng.normal())) for i in range(90) for d in range(3)]
    pred = spark.createDataFrame(cells, "row_id int, dim int, y double, y_hat double")
    few = M.bootstrap(pred, metric, 50, method="resample").collect()[0]
    monkeypatch.setattr(M, "SMALL", 0)
    monkeypatch.setattr(M, "CELLS", 500)  # slices of ten rows
    monkeypatch.setattr(M, "BLOCK", 16)
    many = M.bootstrap(pred, metric, 50, method="resample")
    assert "Generate" not in many._jdf.queryExecution().executedPlan().toString()
    got = many.collect()[0]
    assert (got["lower"], got["upper"]) == pytest.approx((few["lower"], few["upper"]))


def test_infinite_rows_reach_only_the_replicates_that_draw_them(spark, monkeypatch):
    rows = [(i, float("inf") if i == 0 else 1.0, 0.5) for i in range(40)]
    pred = spark.createDataFrame(rows, "row_id int, y double, y_hat double")
    monkeypatch.setattr(M, "SMALL", 0)
    monkeypatch.setattr(M, "CELLS", 300)
    bounds = M.bootstrap(pred, "rmse", 30, alpha=0.2, method="resample").collect()[0]
    assert bounds["lower"] == pytest.approx(0.5)
