"""Published versions and owned scratch tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from medley.session import cut, scratch, scratch_path, shared_dir
from medley.sources import tables as S


def local(spark):
    return shared_dir(spark).removeprefix("file:").replace("///", "/")


def test_readers_see_whole_versions(spark):
    path = scratch_path(spark, "published")
    assert S.open_published(spark, path) is None
    first = S.publish(spark.range(10), path)
    old = S.open_published(spark, path)
    second = S.publish(spark.range(100, 105), path)
    assert first < second
    assert sorted(r.id for r in S.open_published(spark, path).collect()) == list(range(100, 105))
    assert old.count() == 10  # still there for those who read it
    S.publish(spark.range(3), path)
    place = path.removeprefix("file:").replace("///", "/")
    assert first not in os.listdir(place) and second in os.listdir(place)


def test_a_failed_write_changes_nothing(spark):
    path = scratch_path(spark, "published")
    S.publish(spark.range(4), path)
    with pytest.raises(Exception):
        S.publish(spark.range(4).selectExpr("raise_error('no') AS id"), path)
    assert S.open_published(spark, path).count() == 4


def test_two_writers_do_not_mix(spark):
    path = scratch_path(spark, "published")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: S.publish(spark.range(k * 100, k * 100 + 50).repartition(3), path, keep=10), range(4)))
    ids = sorted(r.id for r in S.open_published(spark, path).collect())
    assert ids == list(range(ids[0], ids[0] + 50)) and ids[0] % 100 == 0


def test_scratch_tables_go_with_their_owner(spark):
    before = set(os.listdir(local(spark)))
    with scratch(spark):
        kept = cut(spark.range(7))
        with scratch(spark):
            assert cut(kept).count() == 7
        assert kept.count() == 7 and len(set(os.listdir(local(spark))) - before) == 1
    assert set(os.listdir(local(spark))) == before
    with pytest.raises(RuntimeError), scratch(spark):
        cut(spark.range(2))
        raise RuntimeError("stop")
    assert set(os.listdir(local(spark))) == before
