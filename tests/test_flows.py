import math

import pytest
from pyspark.sql import functions as F

from medley.functions.featurise import featurise, text_key
from medley.operators import metrics as M
from medley.operators import models as ML
from medley.operators import scoring as SC
from medley.operators import selection as SEL
from medley.operators import splits as SP
from medley.operators.early import early_stop
from medley.schemas import COMPONENT, RATINGS, RAW_COMPOUND
from medley.session import scratch_path
from medley.sources import tables as S
from medley.streaming import accumulate as ST


def test_csv_with_bom_and_quoted_header(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_bytes("﻿molecule,SMILES,is_solvent\n-1,,TRUE (Oil)\n7,CC,FALSE\n".encode())
    assert [tuple(r) for r in S.read_table(spark, str(raw), RAW_COMPOUND).collect()] == [(-1, None, "TRUE (Oil)"), (7, "CC", "FALSE")]
    quoted = tmp_path / "quoted.csv"
    quoted.write_text('"id","molecule","dilution","solvent"\n"1",-1,1,"nt"\n')
    assert tuple(S.read_table(spark, str(quoted), COMPONENT).collect()[0]) == (1, -1, 1.0, "nt")
    assert len(RATINGS) == 51


def test_keys_masks_and_vectors(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        S.keyed_table(df, ["k"])
    assert S.keyed_table(df, ["k", "v"]).count() == 2
    path = scratch_path(spark, "vec")
    S.store_vectors(spark.createDataFrame([(1, [1.0])], "row_id long, vec array<double>"), path)
    with pytest.raises(ValueError):
        S.load_vectors(spark, path, spark.createDataFrame([(2,)], "row_id long"))


def test_kfold_parts(spark):
    ids = spark.range(103).withColumnRenamed("id", "row_id")
    split = SP.kfold(ids, "row_id", 5, 0.1, seed=4).toPandas()
    assert sorted(split[split["part"] == "test"]["row_id"]) == list(range(103))
    for fold, rows in split.groupby("fold"):
        assert sorted(rows["row_id"]) == list(range(103))
        counts = rows["part"].value_counts()
        assert counts["train"] == math.floor(0.875 * (103 - counts["test"]))
    path = scratch_path(spark, "fold")
    S.save_split(SP.kfold(ids, "row_id"), path)
    assert S.count_splits(spark, path) == 5 and S.load_split(spark, path, 9) is None
    assert S.load_split(spark, path, 0).count() == 103
    again = SP.kfold(ids.repartition(7), "row_id", 5, 0.1, seed=4).toPandas()
    key = ["fold", "row_id"]
    assert again.sort_values(key).reset_index(drop=True).equals(split.sort_values(key).reset_index(drop=True))


def test_other_splits(spark):
    ids = spark.range(100).withColumnRenamed("id", "row_id")
    parts = SP.train_val_test(ids, "row_id").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"test": 20, "val": 10, "train": 70}
    with pytest.raises(ValueError):
        SP.train_val_test(ids, "row_id", 0.6, 0.4)
    flagged = ids.select("row_id", (F.col("row_id") % 3 == 0).cast("int").alias("a"), (F.col("row_id") == 50).cast("int").alias("b"))
    folds = SP.balanced_folds(flagged, "row_id", ["a", "b"], 4).join(flagged, "row_id").toPandas()
    assert len(folds) == 100
    per_fold = folds[(folds["a"] == 0) & (folds["b"] == 0)].groupby("fold").size()
    assert per_fold.max() - per_fold.min() <= 1


def _python_stop(values, patience):
    best, last = -math.inf, 0
    for step, v in enumerate(values):
        if v >= best:
            best, last = v, step
        if step - last >= patience:
            return step, last, best, step + 1
    return None, last, best, len(values)


@pytest.fixture(scope="module")
def series(spark):
    rows = [(run, step, float((step * (7 + run)) % 13)) for run in range(4) for step in range(40 if run else 6)]
    return spark.createDataFrame(rows, "run long, step long, value double").cache()


def test_early_stop_batch_and_resumed(series):
    whole = {r["run"]: tuple(r)[1:] for r in early_stop(series, "run", ["step"], "value", 5).collect()}
    data = series.toPandas()
    for run, rows in data.groupby("run"):
        assert whole[run] == _python_stop(list(rows.sort_values("step")["value"]), 5)
    state = None
    for low, high in ((0, 3), (3, 20), (20, 40)):
        part = series.filter((F.col("step") >= low) & (F.col("step") < high))
        state = early_stop(part, "run", ["step"], "value", 5, state=state)
    assert {r["run"]: tuple(r)[1:] for r in state.collect()} == whole
    low = early_stop(series.withColumn("value", -F.col("value")), "run", ["step"], "value", 5, "minimize").collect()
    assert {r["run"]: r["stop_step"] for r in low} == {k: v[0] for k, v in whole.items()}


def test_streams_equal_batch(spark, series):
    source, work = scratch_path(spark, "src"), scratch_path(spark, "work")
    for low, high in ((0, 10), (10, 25), (25, 40)):
        series.filter((F.col("step") >= low) & (F.col("step") < high)).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: ST.file_stream(spark, source, series.schema, files=1)
    means = ST.running_means(stream(), "run", "value", work + "/a").collect()
    want = series.groupBy("run").agg(F.count("value").alias("n"), F.avg("value").alias("mean")).collect()
    assert {r["run"]: (r["n"], pytest.approx(r["mean"])) for r in want} == {r["run"]: (r["n"], r["mean"]) for r in means}
    stops = ST.early_stop_stream(stream(), "run", ["step"], "value", work + "/b", 5).collect()
    batch = early_stop(series, "run", ["step"], "value", 5).collect()
    assert sorted(map(tuple, stops), key=str) == sorted(map(tuple, batch), key=str)


def test_metric_sums_stream(spark):
    source, work = scratch_path(spark, "cells"), scratch_path(spark, "work")
    cells = spark.range(300).select(
        (F.col("id") % 2).alias("epoch"), (F.col("id") % 3).cast("int").alias("dim"),
        F.sin("id").alias("y"), F.cos(F.col("id") * 2).alias("y_hat"),
    )
    cells.repartition(3).write.parquet(source)
    sums = ST.metric_sums(ST.file_stream(spark, source, cells.schema, files=1), ["epoch", "dim"], work)
    got = {(r["epoch"], r["dim"]): r["pearson"] for r in ST.metrics_from_sums(sums, ["epoch", "dim"]).collect()}
    for r in cells.groupBy("epoch", "dim").agg(F.corr("y", "y_hat").alias("r")).collect():
        assert got[(r["epoch"], r["dim"])] == pytest.approx(r["r"])


def test_featurise_quarantines_bad_rows(spark):
    def fn(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("no parse")
        return [[len(t)] for t in texts]

    texts = spark.createDataFrame([("a",), ("bad",), ("ccc",), ("a",), (None,)], "t string")
    good, bad = featurise(texts, "t", fn)
    back = texts.withColumn("text_key", text_key("t")).join(good, "text_key")
    assert sorted((r.t, r.vec) for r in back.collect()) == [("a", [1.0]), ("a", [1.0]), ("ccc", [3.0])]
    assert good.count() == 2 and [(r.text, r.error) for r in bad.collect()] == [("bad", "RuntimeError: no parse")]


def test_linear_film_and_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], [3.0])], "id long, x array<double>, c array<double>")
    model = spark.createDataFrame([(0, [1.0, 1.0], 0.5), (1, [0.0, -1.0], 0.0)], "out int, w array<double>, bias double")
    assert {r["out"]: r["score"] for r in SC.linear(rows, "id", "x", model).collect()} == {0: 3.5, 1: -2.0}
    layer = spark.createDataFrame([(0, [1.0], 0.0), (1, [-1.0], 0.0)], "out int, w array<double>, bias double")
    film = SC.film(rows, "id", "x", "c", layer, layer, "relu").collect()
    assert {r["out"]: r["score"] for r in film} == {0: 6.0, 1: 0.0}
    edges = SC.directed_edges(spark.createDataFrame([("g", 2, 1, "s")], "g string, src int, dst int, kind string"), "g")
    assert sorted((r["src"], r["dst"], r["kind"]) for r in edges.collect()) == [(1, 2, "s"), (2, 1, "s")]


@pytest.fixture(scope="module")
def learning(spark):
    rows = spark.range(160).select(
        F.col("id").alias("row_id"),
        F.array(*[F.sin(F.col("id") * (d + 1)) for d in range(6)]).alias("vec"),
    )
    rows = rows.withColumn("y", F.greatest(F.col("vec")[2] * 2, F.lit(0.0)))
    return ML.assemble(rows, "vec").cache()


def test_models_learn_and_persist(spark, learning):
    models = ML.fit_regressors(learning, {0: "y"}, trees=5, depth=3)
    scored = ML.score(learning, models, "row_id").join(learning.select("row_id", "y"), "row_id")
    base = learning.agg(F.avg(F.abs(F.col("y") - learning.agg(F.avg("y")).first()[0]))).first()[0]
    assert scored.agg(F.avg(F.abs(F.col("y") - F.col("y_hat")))).first()[0] < base / 3
    path = scratch_path(spark, "model")
    ML.save_model(models[0], path)
    again = ML.load_and_score(path, learning, "row_id").orderBy("row_id").collect()
    assert [r["y_hat"] for r in again] == [r["y_hat"] for r in scored.orderBy("row_id").collect()]
    gates = ML.fit_gates(learning, {0: "y", 1: "y"}, {0: 0.1, 1: 99.0}, trees=2, depth=2)
    assert set(gates) == {0}
    both = ML.hybrid(ML.score(learning, gates, "row_id", "gate"), scored.select("row_id", "dim", "y_hat"), "row_id")
    assert both.filter("y_hat = 0").count() > 20


def test_elimination_keeps_the_informative_dim(learning):
    kept, history = SEL.eliminate(learning.select("row_id", "features", "y"), 6, folds=2, step=2, keep=2, trees=2, depth=2)
    assert 2 in kept and [n for n, _ in history] == [6, 4, 2]
    flagged = learning.withColumn("on", (F.col("y") > 0).cast("int"))
    ranked = SEL.mutual_information(flagged, "vec", "on").orderBy(F.desc("mi")).first()
    assert ranked["dim"] == 2


def test_selection_over_targets_and_settings(learning):
    rows = learning.select(
        "row_id",
        "features",
        (F.col("vec")[2] > 0).cast("double").alias("a"),
        ((F.col("vec")[1] > 0).cast("double") * 3 + (F.col("vec")[4] > 0).cast("double")).alias("b"),
        F.when(F.col("row_id") % 3 > 0, (F.col("vec")[2] > 0.5).cast("double")).alias("c"),
        F.lit(1.0).alias("d"),
    )
    targets = {0: "a", 1: "b", 2: "c", 3: "d"}
    found = SEL.select_features(rows, targets, 6, cvs=(2, 4), step=2, keep=2, trees=2, depth=2)
    masks = {(r.target, r.dim) for r in found.masks.collect()}
    assert {(0, 2), (1, 1), (1, 4), (2, 2)} <= masks and {t for t, _ in masks} == set(targets)
    history = found.history.collect()
    assert sorted((r.target, r.cv, r.dims_left) for r in history) == [(t, cv, n) for t in targets for cv in (2, 4) for n in (2, 4, 6)]
    choices = found.choices.collect()
    for t in targets:
        own = [c for c in choices if c.target == t]
        chosen = [c for c in own if c.chosen]
        assert [c.cv for c in own] == [2, 4] and len(chosen) == 1
        # the chosen setting correlates best on the held rows, the first of equal ones; none without a correlation beats it
        assert chosen[0] is max(own, key=lambda c: -2.0 if c.pearson is None else c.pearson)
        assert sum((t, d) in masks for d in range(6)) == chosen[0].dims
        for c in own:
            at = {r.dims_left: r.mae for r in history if (r.target, r.cv) == (t, c.cv)}
            assert c.mae == min(at.values()) and c.dims == min(n for n, mae in at.items() if mae == c.mae)
    assert {c.pearson for c in choices if c.target == 3} == {None}
    union = {r.dim: r.targets for r in found.union().collect()}
    assert union == {d: sum((t, d) in masks for t in targets) for d in {d for _, d in masks}}
    with pytest.raises(ValueError):
        SEL.select_features(rows, targets, 6, cvs=(1,))


def test_a_fit_is_kept_until_a_dim_of_its_trees_goes(learning, monkeypatch):
    """Fits of every level, and only those that change: the same tables come out."""
    fits = []
    plain = SEL.GBTRegressor._fit
    monkeypatch.setattr(SEL.GBTRegressor, "_fit", lambda self, rows: fits.append(1) or plain(self, rows))
    flag = (F.col("vec")[2] > 0).cast("double")
    noisy = (F.col("vec")[1] > 0).cast("double") * 3 + F.col("vec")[3] * F.col("vec")[5]
    rows = learning.select("row_id", "features", flag.alias("a"), noisy.alias("b"))

    def run(names, **settings):
        fits.clear()
        found = SEL.select_features(rows, dict(enumerate(names)), 6, cvs=(2,), step=2, keep=2, trees=2, depth=2, **settings)
        return len(fits), [sorted(map(tuple, t.collect())) for t in (found.history, found.choices, found.masks)]

    one, both = run("a"), run("ab", share=0.7)
    kept, history = SEL.eliminate(rows.select("row_id", "features", F.col("b").alias("y")), 6, folds=2, step=2, keep=2, trees=2, depth=2)
    monkeypatch.setattr(SEL, "_used", lambda importances: {-1})  # so that every level fits
    assert one[0] < 9 and run("a") == (9, one[1])  # two folds and all rows, three levels
    again = run("ab", share=0.7)
    assert both[0] < again[0] == 18 and both[1] == again[1]
    assert (kept, history) == SEL.eliminate(rows.select("row_id", "features", F.col("b").alias("y")), 6, folds=2, step=2, keep=2, trees=2, depth=2)


def test_state_does_not_grow_with_batches(spark):
    """What is kept for a stream is a row per key after any number of batches, across restarts."""
    source, work = scratch_path(spark, "grow"), scratch_path(spark, "work")
    rows = spark.range(1200).select((F.col("id") % 4).alias("run"), F.col("id").alias("step"), F.sin("id").alias("value"))
    for part in range(6):
        rows.filter(f"step div 200 = {part}").repartition(3).write.mode("append").parquet(source)
        stream = lambda: ST.file_stream(spark, source, rows.schema, files=3)  # noqa: B023, E731
        means = ST.running_means(stream(), "run", "value", f"{work}/a")
        stops = ST.early_stop_stream(stream(), "run", ["step"], "value", f"{work}/b", 90, min_delta=0.001)
        for place in "ab":
            assert spark.read.format("statestore").load(f"{work}/{place}/checkpoint").count() == 4
    want = {r.run: (r.n, r.m) for r in rows.groupBy("run").agg(F.count("value").alias("n"), F.avg("value").alias("m")).collect()}
    assert {r.run: (r.n, pytest.approx(r["mean"])) for r in means.collect()} == want
    batch = early_stop(rows, "run", ["step"], "value", 90, min_delta=0.001).collect()
    assert sorted(map(tuple, stops.collect())) == sorted(map(tuple, batch))


@pytest.mark.parametrize("min_delta", [None, 2.0])
@pytest.mark.parametrize("mode", ["maximize", "minimize"])
def test_early_stop_stream_with_gaps(spark, mode, min_delta):
    """NULL and NaN steps, a run that never improves, one that stops, one that starts late."""
    nan = math.nan
    runs = {1: [None, nan, 3.0, 2.0, 4.0, 4.5, nan, 9.0, 1.0, 1.0, 1.0, 1.0, 99.0], 2: [nan] * 9, 3: [5.0, 5.0, 6.0, 7.5, None, 3.0], 4: [1.0]}
    schema = "run string, step int, value double"
    rows = spark.createDataFrame([(f"r{k}", i, v) for k, vs in runs.items() for i, v in enumerate(vs)], schema)
    source, work = scratch_path(spark, "gaps"), scratch_path(spark, "work")
    for low, high in ((0, 2), (2, 5), (5, 6), (6, 20)):
        rows.filter((F.col("step") >= low) & (F.col("step") < high)).repartition(2).write.mode("append").parquet(source)
        stream = ST.file_stream(spark, source, rows.schema, files=100)
        found = ST.early_stop_stream(stream, "run", ["step"], "value", work, 4, mode, min_delta)
    batch = early_stop(rows, "run", ["step"], "value", 4, mode, min_delta)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_a_new_epoch_drops_the_old_state(spark):
    source, work = scratch_path(spark, "epochs"), scratch_path(spark, "work")
    cells = spark.range(400).select(
        (F.col("id") / 100).cast("long").alias("epoch"), (F.col("id") % 3).cast("int").alias("dim"), F.sin("id").alias("y"), F.cos("id").alias("y_hat")
    )
    last = None
    for epoch in range(4):
        cells.filter(F.col("epoch") == epoch).repartition(2).write.mode("append").parquet(source)
        stream = ST.file_stream(spark, source, cells.schema, files=2)
        last = ST.metric_sums(stream, ["epoch", "dim"], work, epoch="epoch")
        assert {(r.epoch, r.dim) for r in last.collect()} == {(epoch, d) for d in range(3)}
    late = cells.filter("epoch = 1")
    late.write.mode("append").parquet(source)
    last = ST.metric_sums(ST.file_stream(spark, source, cells.schema, files=2), ["epoch", "dim"], work, epoch="epoch")
    scores = {(r.epoch, r.dim): (r.n, r.pearson) for r in ST.metrics_from_sums(last, ["epoch", "dim"]).collect()}
    want = cells.filter("epoch = 3").groupBy("epoch", "dim").agg(F.count("y").alias("n"), F.corr("y", "y_hat").alias("r")).collect()
    assert scores == {(r.epoch, r.dim): (r.n, pytest.approx(r.r)) for r in want}
    with pytest.raises(ValueError):
        ST.metric_sums(ST.file_stream(spark, source, cells.schema), ["dim"], work, epoch="epoch")


def test_a_split_is_written_by_as_many_tasks_as_its_rows_need(spark, tmp_path, monkeypatch):
    from medley.sources import tables

    monkeypatch.setattr(tables, "SPLIT_ROWS", 100)
    split = spark.range(300).select((F.col("id") % 2).alias("fold"), F.col("id").alias("row_id"), F.lit("train").alias("part"))
    tables.save_split(split, str(tmp_path / "split"))
    assert len(list((tmp_path / "split").glob("fold=1/*.parquet"))) == 3
    assert {r.row_id for r in tables.load_split(spark, str(tmp_path / "split"), 1).collect()} == set(range(1, 300, 2))
    tables.save_split(split.limit(0), str(tmp_path / "none"))
    assert tables.load_split(spark, str(tmp_path / "none"), 1) is None


def test_edges_are_grouped_in_as_many_tasks_as_their_number_needs(spark, tmp_path, monkeypatch):
    from medley.operators import hot
    from medley.plans import array_queries

    monkeypatch.setattr(hot, "TASK_BYTES", 100 * array_queries._EDGE_BYTES)
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 100 * (floor + 3)
    rows = spark.range(2 * n).selectExpr(
        "id % 7 AS l_orderkey", "id % 50 AS l_partkey", "id % 50 + id % 2 AS l_suppkey", "0D AS l_discount", "'A' AS l_returnflag"
    )
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = array_queries.directed_edges(spark, str(tmp_path))
    assert edges.rdd.getNumPartitions() == 2 * (floor + 3)
    found = {(r.graph_id, r.src, r.dst): r.n for r in edges.collect()}
    expected = {}
    for i in range(1, 2 * n, 2):
        a, b = i % 50, i % 50 + 1
        for s, d in ((a, b), (b, a)):
            expected[i % 7, s, d] = expected.get((i % 7, s, d), 0) + 1
    assert found == expected
