import pytest
from pyspark.sql import functions as F

from medley.functions import lists as A
from medley.functions import numeric as N
from medley.operators import joins as J
from medley.operators import tidy as T


def one(df):
    return df.collect()[0][0]


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame(
        [("1;2;;3", "[1, nan, 2.5]", "[ 1 , 2 ]", "['{1, 2}', '{3}']", None)],
        "semi string, lst string, br string, braces string, nothing string",
    )


def test_decoding(row):
    assert one(row.select(A.split_list("semi", "int"))) == [1, 2, 3]
    assert one(row.select(A.split_list("nothing", "int"))) is None
    got = one(row.select(A.decode_list("lst")))
    assert got[0] == 1.0 and got[1] != got[1] and got[2] == 2.5
    assert one(row.select(A.decode_list(F.lit("['a', 'b']"), "string"))) == ["a", "b"]
    assert one(row.select(A.decode_brackets("br"))) == [1.0, 2.0]
    assert one(row.select(A.decode_braces("braces"))) == [[1.0, 2.0], [3.0]]
    assert one(row.select(A.join_list(A.split_list("semi")))) == "1;2;3"


def test_padding_and_fitting(spark):
    df = spark.createDataFrame([([1, 2],), (None,)], "a array<int>")
    assert [r[0] for r in df.select(A.pad("a", 3)).collect()] == [[1, 2, -999], [-999] * 3]
    assert df.select(A.pad("a", 1)).first()[0] == [1, 2]
    assert df.select(A.fit("a", 1, 0)).first()[0] == [1]
    nested = spark.createDataFrame([([[1], [2, 3]],)], "a array<array<int>>")
    assert one(nested.select(A.pad_nested("a", 3, 2))) == [[1, -999], [2, 3], [-999, -999]]


def test_small_list_rules(spark):
    df = spark.createDataFrame([([None], "a", None), ([1], "z", 5)], "l array<int>, c string, s int")
    assert [r[0] for r in df.select(A.null_if_all_null_single("l")).collect()] == [None, [1]]
    assert [r[0] for r in df.select(A.wrap("s")).collect()] == [[], [5]]
    assert [r[0] for r in df.select(A.one_hot("c", ["a", "b"])).collect()] == [[1, 0, 0], [0, 0, 1]]


def test_null_list_keeps_rows(spark):
    df = spark.createDataFrame([(1, [7, 8], None), (2, [9], ["x"])], "k int, a array<int>, b array<string>")
    got = A.explode_parallel(df, ["a", "b"]).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 7, None), (1, 1, 8, None), (2, 0, 9, "x")]


def test_merge_duplicates_within_tolerance(spark):
    df = spark.createDataFrame([("s", 1.0, 1, 0), ("s", 1.0000001, 0, 1), ("s", 1.1, 0, 1)], "k string, v double, a int, b int")
    got = sorted(map(tuple, T.merge_duplicates(df, "k", ["v"], ["a", "b"]).collect()))
    assert got == [("s", 1, 1, 1.0), ("s", 0, 1, 1.1)][::-1] or got == sorted([("s", 1, 1, 1.0), ("s", 0, 1, 1.1)])


def test_mark_first_counts_copies(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.1), (1, 0.5), (2, 0.3)], "s int, d double")
    got = {(r["s"], r["d"]): r["copies"] for r in T.mark_first(df, "s", ["d"]).collect()}
    assert got == {("A1", 0.1): 1, ("B1", 0.1): 1, ("B1", 0.5): 1, ("A2", 0.3): 1}


def test_drop_shadowed(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 5), (2, None), (2, None)], "k int, d int")
    assert sorted(map(tuple, T.drop_shadowed(df, ["k"], "d").collect()), key=str) == [(1, 5), (2, None)]


def test_min_max_position_of_constant_key_is_one(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4), (1, 0.3), (2, 0.9)], "c int, v double")
    got = {(r["c"], r["v"]): r["w"] for r in T.min_max_position(df, "c", "v", "w").collect()}
    assert got[(1, 0.2)] == 0 and got[(1, 0.4)] == 1 and got[(1, 0.3)] == pytest.approx(0.5) and got[(2, 0.9)] == 1.0


def test_ids(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5)], "k string, pos int")
    seen = {r["k"]: r["id"] for r in T.ids_by_first_seen(df, "k", ["pos"]).collect()}
    often = {r["k"]: r["id"] for r in T.ids_by_frequency(df, "k").collect()}
    assert seen == {"b": 0, "a": 1, "c": 2} and often == {"b": 0, "c": 1, "a": 2}


def test_lower_names_merges_collisions(spark):
    df = spark.createDataFrame([(1, 0, 1, 2), (2, 0, 0, 3)], "id int, Rose int, rose int, Mint int")
    got = T.lower_names(df, ["Rose", "rose", "Mint"])
    assert got.columns == ["id", "rose", "mint"] and sorted(map(tuple, got.collect())) == [(1, 1, 2), (2, 0, 3)]


def test_regroup_continues_in_chunks(spark):
    df = spark.range(10).select(F.lit("s").alias("k"), "id")
    got = {r["base"]: r["id"] for r in T.regroup(df, "k", ["id"], ["id"], chunk=4).collect()}
    assert got == {0: [0, 1, 2, 3], 4: [4, 5, 6, 7], 8: [8, 9]}


def test_stage_report(spark):
    df = spark.createDataFrame([(None, 5), ("a", 5), ("a", 50), ("b", 50)], "t string, w int")
    rules = [("text", F.col("t").isNotNull()), ("range", F.col("w").between(20, 600)), ("letter", F.col("t").contains("a"))]
    got = [tuple(r) for r in T.stage_report(df, rules).orderBy("step").collect()]
    assert got == [(1, "text", 4, 1, 3), (2, "range", 3, 1, 2), (3, "letter", 2, 1, 1)]


def test_column_drops_and_filters(spark):
    df = spark.createDataFrame([(1, 1.0, None), (0, float("nan"), 2)], "a int, b double, c int")
    assert T.drop_null_columns(df, ["a", "b", "c"]).columns == ["a"]
    assert T.drop_rare_columns(df, ["a"], 2).columns == ["b", "c"]
    with pytest.raises(ValueError):
        T.with_any_task(df, ["missing"])
    words = spark.createDataFrame([("Na Cl",), ("NaCl",), ("C",)], "t string")
    assert sorted(r[0] for r in T.without_tokens(words, "t", ["Na", "K"]).collect()) == ["C", "NaCl"]


def test_lookup_and_expand(spark):
    comps = spark.createDataFrame([(1, 10, "pg"), (1, 11, "pg"), (2, 20, "nt")], "component long, cid long, solvent string")
    defs = spark.createDataFrame([("m", "2;1")], "stimulus string, text string")
    got = J.expand_definition(defs, "stimulus", "text", comps, ["cid", "solvent"], ["cid"]).orderBy("pos").collect()
    assert [(r["pos"], r["cid"]) for r in got] == [(0, 20), (1, 10)]
    table = spark.createDataFrame([(20, 5)], "cid long, id long")
    base = spark.createDataFrame([(20,), (30,)], "cid long")
    assert sorted(r["v"] for r in J.lookup(base, "cid", table, "id", "v", True).collect()) == [5, 30]
    assert {r["v"] for r in J.lookup(base, "cid", table, "id", "v", False).collect()} == {5, None}


def test_laws_and_activations(spark):
    df = spark.createDataFrame([(1.0, 0.5, 100.0, 300.0)], "a double, e double, t0 double, t double")
    cols = [F.col("a"), F.col("e"), F.col("t0")]
    assert one(df.select(N.temperature_law("vft_cmu", cols, F.col("t")))) == pytest.approx(2.718281828 ** -0.0025, rel=1e-6)
    assert one(df.select(N.activation("hardtanh", F.lit(3.0)))) == 1.0
    with pytest.raises(ValueError):
        N.activation("gelu", F.lit(1.0))
