import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from medley.operators import explore, ordered
from medley.operators.ordered import Ordered, Running, exact_quantiles, row_ids, row_numbers, value_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; values repeat."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        "id",
        ((F.col("id") * 37) % 101).cast("double").alias("v"),
    ).cache()


def test_running_equals_window(skewed):
    got = Ordered(skewed, ["k"], ["v", "id"], slices=7).with_running(
        Running("n", "sum", F.lit(1)),
        Running("before", "max", F.col("id"), inclusive=False),
        Running("low", "min", F.col("id")),
    ).rows()
    w = Window.partitionBy("k").orderBy("v", "id")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "*",
        F.row_number().over(w).cast("long").alias("n"),
        F.max("id").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min("id").over(up_to).alias("low"),
    )
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_running_sum_without_keys(spark):
    rows = row_numbers(spark.range(100), [], [F.desc("id")]).collect()
    assert {r["id"]: r["rn"] for r in rows} == {i: 100 - i for i in range(100)}


def test_row_numbers_spread_equal_rows(spark):
    same = spark.range(50).select(F.lit(1).alias("k"), F.lit(2).alias("v"))
    assert sorted(r["rn"] for r in row_numbers(same, ["k"], ["v"]).collect()) == list(range(1, 51))


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    got = {(r["k"], r["v"]): r["rn"] for r in row_numbers(df, ["k"], ["v"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}


def test_value_ranks_count_smaller_rows(skewed):
    for r in value_ranks(skewed, ["k"], "v").filter("k = 'hot'").collect():
        smaller = skewed.filter((F.col("k") == "hot") & (F.col("v") < r["v"])).count() if r["v"] in (0.0, 50.0, 100.0) else None
        assert smaller is None or smaller == r["n_before"]


def test_quantiles_match_numpy(skewed):
    data = skewed.toPandas()
    got = {(r["k"], r["q"]): r["v"] for r in exact_quantiles(skewed, ["k"], "v", [0.0, 0.3, 0.75, 1.0]).collect()}
    for k, group in data.groupby("k"):
        for q in (0.0, 0.3, 0.75, 1.0):
            assert got[(k, q)] == pytest.approx(np.percentile(group["v"], q * 100))
    whole = exact_quantiles(skewed, [], "v", [0.5]).collect()[0]["v"]
    assert whole == pytest.approx(np.median(data["v"]))


def test_slices_follow_the_written_bytes(spark, monkeypatch):
    """More bytes than the usual slices should take give more slices, and the same numbers."""
    rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), "id", F.rand(5).alias("v")).cache()
    want = {r.id: r.rn for r in row_numbers(rows, ["k"], ["v"]).collect()}
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(ordered, "SLICE_BYTES", 10_000)
    sliced = Ordered(rows, ["k"], ["v"])
    assert sliced.df.select("_slice").distinct().count() > 2 * usual
    assert {r.id: r.rn for r in sliced.with_row_number("rn").rows().collect()} == want
    assert Ordered(rows, ["k"], ["v"], slices=3).df.select("_slice").distinct().count() == 3


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_ids_without_an_order(spark, parts):
    rows = spark.range(123).repartition(parts).filter("id % 5 > 0")
    ids = row_ids(rows, "n")
    assert sorted(r.n for r in ids.collect()) == list(range(rows.count())) and ids.columns == ["id", "n"]
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    assert row_ids(rows.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [1, 5, 16, 64])
def test_tiles_add_up_to_the_square(spark, tile):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 20))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>").repartition(4)
    square = np.zeros((20, 20))
    cells = explore.gram(rows, "vec", 20, tile).collect()
    assert len(cells) == 400
    for r in cells:
        square[r.a, r.b] = r.s
    np.testing.assert_allclose(square, x.T @ x, atol=1e-9)
    plain = {(r.a, r.b): r.n for r in explore.co_occurrence(rows, "row_id", "vec", 20, 0.75).collect()}
    assert {(r.a, r.b): r.n for r in explore.co_occurrence(rows, "row_id", "vec", 20, 0.75, tile).collect()} == plain
    assert explore.gram(rows.limit(0), "vec", 20, tile).count() == 0


def test_slices_are_sorted_in_as_many_tasks_as_their_bytes_need(spark, monkeypatch):
    rows = spark.range(2_000).select((F.col("id") * 7919 % 2_000).alias("v"))
    monkeypatch.setattr(ordered, "TASK_BYTES", 1_000)
    walked = ordered.Ordered(rows, [], ["v"], slices=7).with_row_number("rn")
    assert walked.tasks == 7
    again = walked.with_running(ordered.Running("s", "sum", F.col("v")))
    assert walked.rows().rdd.getNumPartitions() == again.rows().rdd.getNumPartitions() == 7
    assert again.rows().filter("rn <> v + 1 OR s <> v * (v + 1) / 2").count() == 0
