"""NULL, NaN, zero, width and restart cases that the test tables do not reach."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from medley.functions import lists as A
from medley.functions.mixing import mix
from medley.operators import explore as X
from medley.operators import joins as J
from medley.operators import metrics as M
from medley.operators import pooling as P
from medley.operators import scores as SCORES
from medley.operators import splits as SP
from medley.operators import tidy as T
from medley.operators.early import early_stop
from medley.operators.hot import profile
from medley.session import scratch_path
from medley.sources import tables as S
from medley.streaming import accumulate as ST


@pytest.fixture(scope="module")
def wide_sets(spark):
    """One set of 70 entries, one of 5,000 and a small one."""
    rows = [(1, i * 7 % 71) for i in range(70)] + [(2, i) for i in range(5000)] + [(3, 9), (3, 9), (3, None)]
    return spark.createDataFrame(rows, "stimulus long, cid long").repartition(5)


def test_lists_hold_whole_sets(wide_sets):
    lists = {r.stimulus: r.cid for r in T.regroup(wide_sets, "stimulus", ["cid"], ["cid"]).collect()}
    assert lists[1] == sorted(i * 7 % 71 for i in range(70)) and lists[2] == list(range(5000)) and lists[3] == [None, 9, 9]


@pytest.mark.parametrize("chunk", [2, 3, 64, 4096])
def test_chunks_give_the_same_positions(wide_sets, chunk):
    whole = T.regroup(wide_sets, "stimulus", ["cid"], ["cid"]).select("stimulus", F.posexplode("cid").alias("pos", "cid"))
    parts = T.regroup(wide_sets, "stimulus", ["cid"], ["cid"], chunk=chunk)
    placed = parts.select("stimulus", "base", F.posexplode("cid").alias("pos", "cid"))
    placed = placed.select("stimulus", (F.col("base") + F.col("pos")).alias("pos"), "cid")
    assert sorted(map(tuple, placed.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert max(r[0] for r in parts.select(F.size("cid")).collect()) <= chunk


def test_wide_lists_are_split_padded_and_fitted(wide_sets):
    text = T.regroup(wide_sets.filter("cid is not null"), "stimulus", ["cid"], ["cid"]).select("stimulus", A.join_list("cid").alias("t"))
    ids = A.split_list("t", "bigint")
    got = {r.stimulus: r for r in text.select("stimulus", ids.alias("ids"), A.fit(ids, 3, F.lit(0).cast("long")).alias("fit"), A.pad(ids, 80, F.lit(-1).cast("long")).alias("pad")).collect()}
    assert got[2].ids == list(range(5000)) and got[2].fit == [0, 1, 2] and got[2].pad == got[2].ids
    assert got[3].fit == [9, 9, 0] and len(got[1].pad) == 80 and got[1].pad[70:] == [-1] * 10


def test_unknown_components_are_an_error(spark):
    definitions = spark.createDataFrame([(7, "1;99;2")], "stimulus long, text string")
    components = spark.createDataFrame([(1, 0.5), (2, 0.25)], "component long, dilution double")
    args = definitions, "stimulus", "text", components
    with pytest.raises(Exception, match="no component 99"):
        J.expand_definition(*args, ["dilution"], ["dilution"]).collect()
    assert [tuple(r) for r in J.undefined_components(*args).collect()] == [(7, 1, 99)]
    fixed = definitions.withColumn("text", F.lit("1;2"))
    rows = J.expand_definition(fixed, "stimulus", "text", components, ["dilution"], ["dilution"]).collect()
    assert sorted(map(tuple, rows)) == [(7, 0, 1, 0.5), (7, 1, 2, 0.25)]


def test_pivot_skips_null_and_null_sorts_last(spark):
    rows = spark.createDataFrame([(1, "a", 1, None), (1, "a", 2, 5.0), (1, "b", 1, None)], "k long, c string, o long, v double")
    assert [tuple(r) for r in T.pivot_first(rows, ["k"], "c", ["a", "b"], "v", ["o"]).collect()] == [(1, 5.0, None)]
    marked = T.mark_first(spark.createDataFrame([(1, None), (1, 0.5)], "k long, d double"), "k", ["d"]).collect()
    assert sorted((r.k, r.d) for r in marked) == [("A1", 0.5), ("B1", None)]
    first = T.keep_first(spark.createDataFrame([(1, None, 1), (1, 3, 2)], "k long, o long, v long"), ["k"], ["o"])
    assert [tuple(r) for r in first.collect()] == [(1, 3, 2)]


def test_pad_nested_null_is_all_padding(spark):
    rows = spark.createDataFrame([(None,)], "x array<array<double>>")
    assert rows.select(A.pad_nested("x", 2, 2, -1.0)).first()[0] == [[-1.0, -1.0]] * 2


def plain_early_stop(values, patience, mode, min_delta):
    best, best_step, wait = None, None, 0
    for step, value in enumerate(values):
        sign = 1 if mode == "maximize" else -1
        usable = value is not None and not math.isnan(value)
        if usable and (best is None or sign * value - min_delta >= sign * best):
            best, best_step, wait = value, step, 0
        else:
            wait += 1
        if wait >= patience:
            return step, best_step, best, step + 1
    return None, best_step, best, len(values)


@pytest.mark.parametrize("mode", ["maximize", "minimize"])
@pytest.mark.parametrize("min_delta", [0, 0.5])
def test_early_stop_equals_a_loop(spark, mode, min_delta):
    rng = random.Random(8)
    series = {k: [rng.choice([None, math.nan, *[i / 4 for i in range(9)]]) for _ in range(rng.randint(1, 25))] for k in range(30)}
    series[30] = [math.nan] * 6
    series[31] = [1.0, math.nan, 2.0, 1.5, 1.0]
    rows = [(k, i, v) for k, values in series.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "run long, step long, value double")
    want = {k: plain_early_stop(v, 4, mode, min_delta) for k, v in series.items()}
    found = early_stop(frame, "run", ["step"], "value", 4, mode, min_delta).collect()
    assert {r.run: (r.stop_step, r.best_step, r.best, r.steps) for r in found} == want
    head = early_stop(frame.filter("step < 7"), "run", ["step"], "value", 4, mode, min_delta)
    both = early_stop(frame.filter("step >= 7"), "run", ["step"], "value", 4, mode, min_delta, state=head).collect()
    assert {r.run: (r.stop_step, r.best_step, r.best, r.steps) for r in both} == want


def test_csv_columns_are_found_by_name(spark, tmp_path):
    schema = T_.StructType([T_.StructField("a", T_.IntegerType()), T_.StructField("b", T_.DoubleType())])
    (tmp_path / "x.csv").write_text('b,extra,"a"\n2.5,z,1\n')
    assert [tuple(r) for r in S.read_table(spark, str(tmp_path / "x.csv"), schema).collect()] == [(1, 2.5)]
    (tmp_path / "y.csv").write_text("a,b\nnot a number,1\n")
    with pytest.raises(Exception, match="(?i)malformed|not a number"):
        S.read_table(spark, str(tmp_path / "y.csv"), schema).collect()
    (tmp_path / "z.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="no column"):
        S.read_table(spark, str(tmp_path / "z.csv"), schema)


def test_half_written_tables_are_built_again(spark):
    path = scratch_path(spark, "half")
    build = lambda: spark.range(100)
    assert S.materialise(spark, path, build).count() == 100
    os.remove(f"{path}/_SUCCESS")
    spark.range(25).write.mode("append").parquet(f"{path}/part")
    assert S.materialise(spark, path, build).count() == 100


def test_distance_to_others_without_a_direction(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [3.0, 3.0])], "k long, v array<double>")
    got = {r.k: r.distance for r in X.mean_distance_to_others(rows, "k", "v", "cosine").collect()}
    half = 1 - math.sqrt(0.5)
    assert got[1] is None and got[2] == pytest.approx((1 + half) / 2) and got[4] == pytest.approx(half)
    flat = {r.k: r.distance for r in X.mean_distance_to_others(rows, "k", "v", "pearson").collect()}
    assert flat[1] is None and flat[4] is None and flat[2] == pytest.approx(2.0)
    for kind in ("cosine", "pearson", "squared"):
        assert X.mean_distance_to_others(rows.filter("k = 2"), "k", "v", kind).first().distance is None


def test_constant_truth_scores_the_same_in_both_reports(spark):
    rows = [(i, d, 1.0 if d == 3 else float(i), float(i)) for i in range(4) for d in range(4)]
    pred = spark.createDataFrame(rows, "row_id long, dim int, y double, y_hat double")
    by_dim = {r.dim: r.r2 for r in M.column_r2(pred).collect()}
    parts = {r.part: r.r2 for r in M.by_part(pred).collect()}
    assert parts["rest"] == pytest.approx((by_dim[2] + by_dim[3]) / 2) == pytest.approx(0.5)


def test_draws_of_replicates_are_unrelated(spark):
    n = 300_000
    rows = spark.range(n).select(*[(mix(b, "id") % n).alias(f"d{b}") for b in (0, 1)])
    shared = rows.select("d0").join(rows.select(F.col("d1").alias("d0")), "d0", "left_semi").distinct().count()
    assert abs(shared / n - (1 - math.exp(-1)) ** 2) < 0.01  # as for independent draws
    total = 2**40
    wide = spark.range(1000).agg(F.max(mix(3, "id") % total)).first()[0]
    assert wide > 2**39


@pytest.mark.parametrize("method", ["poisson", "resample"])
def test_bootstrap_spread_is_right_for_many_rows(spark, method):
    n = 200_000 if method == "poisson" else 30_000
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.lit(0).alias("dim"), F.lit(0.0).alias("y"), F.randn(3).alias("y_hat"))
    bounds = M.bootstrap(rows, "rmse", resamples=200, method=method).first()
    want = 2 * 1.96 / math.sqrt(2 * n)  # of the root mean square of standard normals
    assert (bounds.upper - bounds.lower) == pytest.approx(want, rel=0.25)


def test_seeds_give_unrelated_orders(spark):
    ids = spark.range(4000).withColumnRenamed("id", "row_id")
    both = SP.shuffled(ids, "row_id", 1).alias("a").join(SP.shuffled(ids, "row_id", 2).alias("b"), "row_id")
    assert abs(both.agg(F.corr("a.i", "b.i")).first()[0]) < 0.06


def test_folds_stay_balanced_with_many_labels(spark):
    rng = random.Random(4)
    labels = [f"l{i}" for i in range(51)]
    rows = [(i, *[int(rng.random() < 0.02 + 0.3 * (j < 2)) for j in range(51)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} int" for c in labels))
    folds = {r.row_id: r.fold for r in SP.balanced_folds(frame, "row_id", labels).collect()}
    for j in (1, 2):
        per_fold = Counter(folds[r[0]] for r in rows if r[j])
        assert max(per_fold.values()) - min(per_fold.values()) <= 12
    assert max(Counter(folds.values()).values()) - min(Counter(folds.values()).values()) <= 12


def test_every_outsized_key_is_found(spark):
    small = spark.range(200_000).select((F.col("id") + 10_000).alias("k"))
    large = spark.range(2000).select(F.explode(F.array_repeat(F.col("id"), 300)).alias("k"))
    one = spark.range(800_000).select(F.lit(-1).cast("long").alias("k"))
    tasks, hot = profile(small.union(large).union(one), "k", 512, threshold=250)
    assert set(hot) >= {-1, *range(2000)} and tasks >= 4
    assert profile(one, "k", 64 * 2**20)[0] == 800_000  # tasks follow the bytes, without a cap
    entries = one.limit(3000).withColumn("c", F.monotonically_increasing_id() % 7).select("k", "c")
    features = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "c long, vec array<double>")
    sums = [sorted(map(tuple, P.pool_members(entries, features, "k", "c", ["sum", "max"], threshold=t).collect())) for t in (None, 10)]
    assert sums[0] == sums[1]


def test_scores_by_name(spark):
    rows = [(i, d, float((i + d) % 3), 0.5 * i - d / 4) for i in range(6) for d in range(5)]
    pred = spark.createDataFrame(rows, "row_id long, dim int, y double, y_hat double")
    rest = pred.filter("dim >= 2").withColumn("dim", F.col("dim") - 2)
    first = pred.filter("dim < 2").agg(F.avg((F.col("y") - F.col("y_hat")) ** 2)).first()[0]
    for name in ("mixed", "hurdle", "combined", "combined_uncertain", "focal", "huber"):
        alone = SCORES.score(rest, name).first().score
        assert SCORES.two_part(pred, name, 0.5, 2.0).first().score == pytest.approx(0.5 * first + 2 * alone), name
        assert SCORES.two_part(pred, name, uncertain=True).first().score == pytest.approx(first + alone)
    with pytest.raises(ValueError):
        SCORES.score(pred, "nothing")


def test_streams_take_folders_and_start_again(spark, tmp_path):
    schema = T_.StructType([T_.StructField("run", T_.LongType()), T_.StructField("step", T_.LongType()), T_.StructField("value", T_.DoubleType())])
    values = [1.0, math.nan, 2.0, 1.5, 1.0, 0.5, 0.25, 3.0]
    source, work = f"{tmp_path}/metrics.parquet", f"{tmp_path}/work"

    def add(start, stop):
        rows = [(1, i, values[i]) for i in range(start, stop)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def detect():
        stream = ST.file_stream(spark, source, schema, files=1)
        return [tuple(r) for r in ST.early_stop_stream(stream, "run", ["step"], "value", work, patience=4).collect()]

    spark.createDataFrame([], schema).write.parquet(source)
    assert detect() == []
    add(0, 3)
    add(3, 5)
    assert detect() == [(1, None, 2, 2.0, 5)]
    assert detect() == [(1, None, 2, 2.0, 5)]  # a restart without new rows
    add(5, 8)
    assert detect() == [(1, 6, 2, 2.0, 7)]
    means = ST.running_means(ST.file_stream(spark, source, schema, files=1).filter("not isnan(value)"), "run", "value", f"{tmp_path}/means")
    assert means.first()["n"] == 7
    one = next(f"{source}/{f}" for f in sorted(os.listdir(source)) if f.endswith(".parquet") and os.path.getsize(f"{source}/{f}") > 800)
    assert ST.running_means(ST.file_stream(spark, one, schema), "run", "value", f"{tmp_path}/single").count() <= 1


def test_every_csv_variant_opens(spark, tmp_path):
    from medley.sources import catalog as C
    from medley.sources import variants

    (tmp_path / "compounds.csv").write_bytes("﻿SMILES,extra,CID\nCC,x,7\n,y,-1\n".encode())
    (tmp_path / "inputs.csv").write_text('stimulus,cmp_ids,dilution_info\nS1,"[7, -1]","[[0.1, nan], [0, 1], [1.0, 0.5]]"\n')
    (tmp_path / "bare.csv").write_text('cmp_ids,stimulus\n"[7, -1]",S1\n')
    names = sorted({output for output, _ in variants.VARIANTS.values()})
    (tmp_path / "labels.csv").write_text('"stimulus",' + ",".join(names) + "\nS1" + ',"[0.5, 0, 1]"' * len(names) + "\nS2" + "," * len(names) + "\n")
    for name, (_, fractions) in variants.VARIANTS.items():
        if fractions:
            ds = C.open_dataset(name, spark, str(tmp_path))
        else:
            ds = variants.load_variant(spark, str(tmp_path), name, inputs="bare")
        rows = {r.pos: r for r in ds.inputs.collect()}
        assert [rows[i].cid for i in (0, 1)] == [7, -1]
        if fractions:
            assert (rows[0].dilution, rows[1].solvent_id, rows[1].weakness) == (0.1, 1.0, 0.5) and math.isnan(rows[1].dilution)
        else:
            assert rows[0].dilution is None
        assert {r.stimulus: r[1] for r in ds.labels.collect()} == {"S1": [0.5, 0.0, 1.0], "S2": None}
        assert C.describe_dataset(ds).first().n_entries == 2
        assert {r.cid: r.smiles for r in ds.compounds.collect()} == {7: "CC", -1: None}


@pytest.mark.parametrize("run_type", ["long", "string"])
def test_rising_runs_are_walked_in_bounded_memory(spark, run_type):
    """Every step is a record; Arrow batches end inside runs; one run comes with an earlier state."""
    rng = random.Random(31)
    runs = {}
    for run in range(5):
        value, values = 0.0, []
        for _ in range(4000 if run else 12_000):
            value += rng.choice([0.001, 0.01, 0.3])
            values.append(value)
        runs[run] = values
    rows = spark.createDataFrame([(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs)], "run long, step long, value double")
    rows = rows.withColumn("run", F.col("run").cast(run_type)).repartition(5)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        whole = {int(r.run): tuple(r)[1:] for r in early_stop(rows, "run", ["step"], "value", 90, "maximize", 1.0).collect()}
        head = early_stop(rows.filter("step < 1500"), "run", ["step"], "value", 90, "maximize", 1.0)
        tail = early_stop(rows.filter("step >= 1500"), "run", ["step"], "value", 90, "maximize", 1.0, head)
        assert {int(r.run): tuple(r)[1:] for r in tail.collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    for run, values in runs.items():
        assert whole[run] == plain_early_stop(values, 90, "maximize", 1.0)
