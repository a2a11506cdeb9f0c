"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUICK = [
    "G9_set_statistics", "G14_weighted_pooling", "G1_merge_duplicates", "G8_regroup_lists", "G18_expected_mixture_rating",
    "G20_column_quantiles", "G24_membership_regions", "G25_histogram", "J5_lookup_pass_through", "J6_expand_definition",
    "W1_first_later_prefix", "W2_drop_shadowed_duplicates", "W5_ids_by_frequency", "W7_running_mean", "W8_early_stop",
    "V2_all_pairs_cosine", "V8_auroc", "V11_by_part", "L8_tweedie_huber", "A9_pad_list", "A16_linear_scoring",
    "S10_split_store", "M3_balanced_folds", "E1_tidy_inputs", "T3_early_stop_stream",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    from check_oracle import digest

    df = entry_module.queries()[name](spark, SF)
    cursor = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    mine, theirs = digest(df.columns, [tuple(r) for r in df.collect()]), digest(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert mine[:2] == theirs[:2], (sorted(set(mine[2]) ^ set(theirs[2]))[:4])


def test_registry_is_consistent():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
