"""The nested model with a held part, the grid of scores and the comparison over folds, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from medley.operators import models as ML
from medley.plans import flows as PL
from medley.session import cut


@pytest.fixture(scope="module")
def rows(spark):
    """Targets: a step and slope of feature 3, of feature 0, one that is never above its threshold, one with NULLs."""
    frame = spark.range(240).select(
        F.col("id").alias("row_id"), F.array(*[F.sin(F.col("id") * (d + 1)) for d in range(12)]).alias("x")
    )
    step = lambda d: (F.col("x")[d] > 0.4).cast("double")  # noqa: E731; less than half are above, so medians are below
    frame = frame.select(
        "row_id", "x", (step(3) * (5 + 3 * F.col("x")[3]) + 1).alias("a"), (step(0) * (2 + F.col("x")[0])).alias("b"), F.lit(1.0).alias("c"),
        F.when(F.col("row_id") % 4 > 0, step(3)).alias("d"), (F.col("row_id") % 5 == 1).alias("held"),
    )
    return ML.assemble(frame, "x").drop("x").cache()


@pytest.mark.parametrize("keep", [None, 2])
def test_nested_model_scores_rows_it_has_not_seen(rows, keep):
    found = PL.nested_model(
        rows, "row_id", {0: "a", 1: "b", 2: "c"}, F.col("held"), trees=3, depth=2, share=1.0, keep=keep, step=5, folds=2
    )
    scores = {r.part: r for r in found.collect()}
    assert set(scores) == {"train", "held"} and (scores["train"].n, scores["held"].n) == (192, 48)
    for r in scores.values():
        # target c is always 0 where 1 is right and counts as below its threshold; a and b are gated right
        assert r.mask_accuracy > 0.8 and r.mae < 1.2 and 0 < r.cosine <= 1
    held = scores["held"]
    assert held.pearson > 0.8  # of a and b; c has none


def test_a_target_that_nothing_can_be_fitted_on(rows):
    found = PL.nested_model(rows, "row_id", {0: "c"}, F.col("held"), trees=1, depth=1)
    for r in found.collect():
        assert (r.mask_accuracy, r.mae, r.pearson, r.cosine) == (1.0, 1.0, None, 0.0)


def test_grid_scores(rows):
    found = ML.grid_scores(rows, "row_id", {0: "a", 1: "b"}, F.col("held"), {"depth": [1, 2], "rate": [0.1, 0.5], "share": [1.0]}, trees=2)
    got = found.collect()
    assert found.columns[:4] == ["depth", "rate", "share", "n"] and {(r.depth, r.rate) for r in got} == {(1, 0.1), (1, 0.5), (2, 0.1), (2, 0.5)}
    for r in got:
        model = ML.regressor(2, r.depth, r.rate, 1.0)
        fits = [model.fit(rows.filter("NOT held").select("features", F.col(c).alias("y"))) for c in "ab"]
        held = rows.filter("held").orderBy("row_id")
        y = np.array([[v.a, v.b] for v in held.collect()])
        p = np.array([[v.prediction for v in f.transform(held).orderBy("row_id").collect()] for f in fits]).T
        assert r.n == len(y) and r.mae == pytest.approx(np.abs(y - p).mean()) and r.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
        assert r.r2 == pytest.approx((1 - ((y - p) ** 2).sum(0) / ((y - y.mean(0)) ** 2).sum(0)).mean())
        assert r.column_pearson == pytest.approx(np.mean([np.corrcoef(y[:, i], p[:, i])[0, 1] for i in (0, 1)]))
        assert r.cosine == pytest.approx(((y * p).sum(1) / np.linalg.norm(y, axis=1) / np.linalg.norm(p, axis=1)).mean())
    with pytest.raises(ValueError):
        ML.grid_scores(rows, "row_id", {0: "a"}, F.col("held"), {"gamma": [1]})


def test_comparison_over_folds(spark):
    rng = np.random.default_rng(5)
    cells = [
        (m, f, part, row, d, float(rng.normal()), float(rng.normal()))
        for m in ("one", "two") for f in range(3 if m == "one" else 1) for part in ("train", "held") for row in range(4) for d in range(5)
    ]
    cells += [("one", 0, "held", 99, d, 0.0, 1.0) for d in range(5)]  # no direction: in mae alone
    frame = spark.createDataFrame(cells, "model string, fold int, part string, row_id int, dim int, y double, y_hat double")
    got = {(r.model, r.part): r for r in PL.compare_over_folds(frame).collect()}
    folds = []
    for f in range(3):
        own = [c for c in cells if c[:3] == ("one", f, "held")]
        y, p = (np.array([c[i] for c in own]).reshape(-1, 5) for i in (5, 6))
        live = y.any(axis=1)
        r = np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(y[live], p[live])])
        c = np.mean([a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(y[live], p[live])])
        folds.append((np.abs(y - p).mean(), r, c))
    one = got["one", "held"]
    np.testing.assert_allclose([one.mae_mean, one.pearson_mean, one.cosine_mean], np.mean(folds, axis=0))
    np.testing.assert_allclose([one.mae_std, one.pearson_std, one.cosine_std], np.std(folds, axis=0, ddof=1))
    assert got["two", "train"].folds == 1 and got["two", "train"].mae_std is None


def test_mixture_rows_are_made_in_parts(spark, monkeypatch):
    """Stimuli of one entry, without a known component, unrated and rated twice; NULL keys and links; a vector that comes twice."""
    pairs = [(s, (s * 7 + j) % 23) for s in range(60) for j in range(s % 4)] + [(3, 1), (3, 1), (None, 2), (61, None), (61, 5)]
    entries = spark.createDataFrame([(s, c, None if c is None else c % 11) for s, c in pairs], "stimulus int, cid int, vec_id int")
    features = spark.createDataFrame([(i % 10, [i / 4, None if i == 4 else -i / 8]) for i in range(11)], "vec_id int, vec array<double>")
    rated = [(s, [s / 2, 1.0]) for s in range(70) if s % 3] + [(10, [9.0, 0.0]), (None, [1.0, 1.0])]
    ratings = spark.createDataFrame(rated, "stimulus int, rating array<double>")

    def told():
        found = PL.mixture_rows(entries, features, ratings, 2, [0, 1], F.col("stimulus") % 5 == 0)
        rows = [(r.stimulus, r.y0, r.y1, r._held, [round(float(x), 9) for x in r.features]) for r in found.collect()]
        return found, sorted(rows, key=str)

    monkeypatch.setattr(ML, "assemble", lambda df, vec: df.withColumn("features", F.transform(vec, lambda x: F.coalesce(x, F.lit(-99.0)))))
    whole, rows = told()
    assert len(rows) > 10 and len({r[0] for r in rows}) < len(rows)  # the one that is rated twice
    monkeypatch.setattr(PL, "PART_BYTES", 700)
    parted, again = told()
    assert again == rows and parted.columns == whole.columns
    assert len(parted.inputFiles()) > len(whole.inputFiles())


def test_models_that_keep_many_rows_are_fitted_one_by_one(rows, monkeypatch):
    assert ML.at_a_time(rows) == ML.PARALLEL and ML.at_a_time(rows.limit(0)) == ML.PARALLEL
    monkeypatch.setattr(ML, "BINNED_BYTES", 2 * rows.count() * (4 * 12 + 48))
    assert ML.at_a_time(rows) == 2
    monkeypatch.setattr(ML, "BINNED_BYTES", 1)
    assert ML.at_a_time(rows) == 1


def test_a_cut_leaves_no_shuffle_files(spark, tmp_path):
    counted = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count().join(spark.range(97).withColumnRenamed("id", "k").hint("merge"), "k")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    store = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: {f.getName() for f in _scala(store.getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = shuffled(), spark.conf.get(name, None)
    kept = cut(counted, f"{tmp_path}/kept")
    assert not shuffled() - before and kept.count() == 97 and spark.conf.get(name, None) == setting


def _scala(items):
    return [items.apply(i) for i in range(items.size())]
