from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from medley.operators import blocks as B
from medley.operators import explore as X
from medley.operators import pooling as P


@pytest.fixture(scope="module")
def small(spark):
    entries = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 13)], "s long, c long")
    features = spark.createDataFrame(
        [(10, [1.0]), (11, [2.0]), (12, [4.0]), (13, [4.0]), (14, [9.0])], "c long, vec array<double>"
    )
    return entries, features


def as_dict(df, *cols):
    return {r["s"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_masked_statistics_golden(small):
    got = as_dict(P.pool_members(*small, "s", "c", ["mean", "var", "min", "max"]), "mean", "var", "min", "max")
    assert got == {1: (1.5, 0.25, 1.0, 2.0), 2: (4.0, 0.0, 4.0, 4.0)}


@pytest.fixture(scope="module")
def random_sets(spark):
    entries = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("s"), (F.col("id") % 17).alias("c"),
        (F.col("id") % 5 / 4).alias("w"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("solvent"),
    ).cache()
    features = spark.range(17).select(
        F.col("id").alias("c"),
        F.array(*[F.sin(F.col("id") * (d + 1)) for d in range(6)]).alias("vec"),
    ).cache()
    return entries, features


def numpy_sets(random_sets):
    entries, features = (df.toPandas() for df in random_sets)
    vecs = {r.c: np.array(r.vec) for r in features.itertuples()}
    return {s: (np.array([vecs[c] for c in g["c"]]), g) for s, g in entries.groupby("s")}


@pytest.mark.parametrize("mode", ["plain", "hot", "joined"])
def test_all_plans_agree(random_sets, monkeypatch, mode):
    if mode == "joined":
        monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    threshold = 100 if mode == "hot" else 10**6
    cells = P.pool_members(*random_sets, "s", "c", ["sum", "var", "max"], threshold=threshold).toPandas()
    for s, (x, _) in numpy_sets(random_sets).items():
        part = cells[cells["s"] == s].sort_values("dim")
        np.testing.assert_allclose(part["sum"], x.sum(0), atol=1e-12)
        np.testing.assert_allclose(part["var"], x.var(0), atol=1e-12)
        np.testing.assert_allclose(part["max"], x.max(0))


def test_array_and_long_plans_agree(random_sets):
    entries, features = random_sets
    joined = entries.join(features, "c")
    wide = P.unpack(P.pool_vectors(joined, ["s"], "vec", 6, ["mean", "min"]), ["s"], ["mean", "min"])
    long = P.pool_long(joined.select("s", F.posexplode("vec").alias("dim", "v")), ["s"], "v", ["mean", "min"])
    a = wide.select("s", "dim", F.round("mean", 9), "min").collect()
    b = long.select("s", "dim", F.round("mean", 9), "min").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_neighbourhood_layout(random_sets):
    base = as_dict(P.neighbourhood(*random_sets, "s", "c"), "pooled", "n")
    summed = as_dict(P.neighbourhood(*random_sets, "s", "c", "sum"), "pooled")
    scaled = as_dict(P.neighbourhood_size_scaled(*random_sets, "s", "c"), "pooled")
    for s, (x, _) in numpy_sets(random_sets).items():
        want = np.concatenate([x.mean(0), x.var(0), x.min(0), x.max(0)])
        np.testing.assert_allclose(base[s][0], want, atol=1e-12)
        np.testing.assert_allclose(summed[s][0][:6], x.sum(0), atol=1e-12)
        np.testing.assert_allclose(scaled[s][0], np.concatenate([want, want / len(x)]), atol=1e-12)
        assert base[s][1] == len(x)


def test_weighted_and_softmax(random_sets):
    entries, features = random_sets
    pooled = as_dict(P.weighted_pool(entries, features, "s", "c", "w", "solvent", ["a", "b"]), "dominant", "pooled")
    scored = features.withColumn("score", P.dot("vec", "vec"))
    soft = P.softmax_pool(entries, scored, "s", "c", "score").toPandas()
    for s, (x, g) in numpy_sets(random_sets).items():
        w = g["w"].to_numpy()
        counts = [(g["solvent"] == c).sum() for c in "ab"]
        assert pooled[s][0] == "ab"[int(np.argmax(counts))]
        np.testing.assert_allclose(pooled[s][1][:7], [*(x * w[:, None]).sum(0), w.mean()], atol=1e-12)
        e = np.exp((x * x).sum(1))
        got = soft[soft["s"] == s].sort_values("dim")["pooled"]
        np.testing.assert_allclose(got, (x * (e / e.sum())[:, None]).sum(0), atol=1e-12)


def test_clamped_mean_of_absent_members_is_zero(small):
    cells = P.mean_pool_clamped(*small, "s", "c", F.col("c") < 11)
    got = as_dict(cells, "n", "mean")
    assert got == {1: (1, 1.0), 2: (0, 0.0)}


def test_singleton_pool_is_itself(spark, small):
    one = spark.createDataFrame([(7, 14)], "s long, c long")
    assert as_dict(P.pool_members(one, small[1], "s", "c", ["mean", "var"]), "mean", "var") == {7: (9.0, 0.0)}


@pytest.fixture(scope="module")
def ragged(spark):
    """Sets with empty, short and NULL-holding vectors, NaN and infinite entries, NULL weights and a NULL key."""
    rows = [(1, 0), (1, 1), (1, 2), (2, 1), (2, 3), (None, 0), (None, 2), (3, 4), (4, 5), (4, 0), (5, 6), (5, 6), (6, 7), (6, 0)]
    entries = spark.createDataFrame([(*r, float(i % 4) if i % 5 else None) for i, r in enumerate(rows)], "s long, c long, w double")
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, 4.0], [0.5], [None, 3.0, None], [-2.0, None], [], [nan, 1.0, inf], [nan], [None, None]]
    return entries, spark.createDataFrame(list(enumerate(vectors)), "c long, vec array<double>")


@pytest.mark.parametrize("threshold", [None, 1])
def test_ragged_members_follow_sql(ragged, threshold):
    """One row per cell, as the blocks must not make it, is the plain version."""
    entries, features = ragged
    stats = ["sum", "mean", "var", "std", "min", "max"]
    cells = entries.join(features, "c").select("s", F.posexplode("vec").alias("dim", "v"))
    want = cells.groupBy("s", "dim").agg(F.count(F.lit(1)).alias("n"), *[P.STATS[x]("v").alias(x) for x in stats])
    got = P.pool_members(entries, features, "s", "c", stats, threshold=threshold)
    told = lambda df: sorted(
        repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select("s", "dim", "n", *stats).collect()
    )
    assert told(got) == told(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("threshold", [None, 1])
def test_weights_that_are_null(ragged, threshold):
    entries, features = ragged
    cells = entries.join(features, "c").select("s", "w", F.posexplode("vec").alias("dim", "v"))
    want = cells.groupBy("s", "dim").agg(F.sum(F.col("v") * F.col("w")).alias("sum")).collect()
    pooled = P.pool_blocks(entries, features, "s", "c", ["sum"], weight="w", sums=["w"], threshold=threshold)
    got = {r.s: r for r in pooled.collect()}
    assert sorted(repr((r.s, r.dim, r.sum)) for r in want) == sorted(
        repr((s, d, x)) for s, r in got.items() for d, x in enumerate(r.sum)
    )
    sums = entries.groupBy("s").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.s: (r.w, r.n) for r in sums} == {s: (r.sum_w, r.n) for s, r in got.items()}


def test_blocks_merge_without_loss():
    """Any cut of the members into blocks, merged in any order, gives the same statistics."""
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1.0, (40, 5))
    x[rng.random(x.shape) < 0.3] = np.nan
    seen = ~np.isnan(x)

    def block(part, known):
        held = np.where(known, part, 0.0)
        count = known.sum(0)
        m2 = np.where(known, part - held.sum(0) / np.maximum(count, 1), 0.0) ** 2
        one = lambda a: np.asarray(a)[None]
        return B.Blocks(
            np.array([len(part)]), np.zeros((1, 0)), one(count), one(count), one(held.sum(0)), one(m2.sum(0)),
            one(np.fmin.reduce(part)), one(np.maximum.reduce(np.where(known, part, -np.inf))),
        )

    whole = block(x, seen)
    for cuts in ([20], [1, 2, 39], [5, 10, 15, 20, 30]):
        parts = [block(a, k) for a, k in zip(np.split(x, cuts), np.split(seen, cuts))]
        rng.shuffle(parts)
        total = parts[0]
        for p in parts[1:]:
            total = total.merged(p)
        for name in ("n", "seen", "sum", "m2", "low", "high"):
            np.testing.assert_allclose(getattr(total, name), getattr(whole, name), rtol=1e-9)


def test_no_members_and_unknown_statistics(small, spark):
    nobody = small[0].limit(0)
    assert P.neighbourhood(nobody, small[1], "s", "c").count() == 0
    assert P.pool_members(small[0], small[1].limit(0), "s", "c", ["mean"]).count() == 0
    with pytest.raises(ValueError):
        P.pool_members(*small, "s", "c", ["median"])
    with pytest.raises(ValueError):
        P.pool_blocks(small[0].withColumn("w", F.lit(1.0)), small[1], "s", "c", ["var"], weight="w")


def test_entries_are_counted_in_tasks_by_their_number(spark, monkeypatch):
    rows = [(k, c) for k in range(40) for c in range(k % 4)] + [(99, c) for c in range(50)] + [(None, 1), (None, 2), (98, None)]
    entries = spark.createDataFrame(rows, "stimulus int, cid int")
    size = Counter(k for k, _ in rows)
    monkeypatch.setattr(X, "ENTRY_BYTES", 8 * 2**20)  # eight entries a task
    for threshold in (None, 5):  # no outsized stimulus, and one
        found = [tuple(r) for r in X.with_size(entries, threshold).collect()]
        assert sorted(found, key=str) == sorted([(k, c, size[k]) for k, c in rows if k is not None], key=str)
        alone = [tuple(r) for r in X.singles(entries, threshold).collect()]
        assert sorted(alone, key=str) == sorted([(k, c) for k, c in rows if size[k] == 1], key=str)
    assert X.with_size(entries, 100).rdd.getNumPartitions() == 14


@pytest.mark.parametrize("scale", [0.5, 0.1])  # floats, and values that no float has
def test_vectors_that_are_not_broadcast(spark, monkeypatch, scale):
    entries = spark.createDataFrame([(s, c) for s in range(30) for c in (0, s % 6, 9)], "s int, c int")
    features = spark.createDataFrame([(c, [c * scale, -c * scale, None if c == 3 else scale]) for c in range(6)], "c int, vec array<double>")
    assert P.vector_bytes(features, "vec")[::2] == ((72, True) if scale == 0.5 else (144, False))

    def pooled():
        rows = P.pool_blocks(entries, features, "s", "c", ["mean", "min", "max"]).collect()
        return {r.s: (r.n, r.size, r["min"], r["max"], [round(x, 9) for x in r["mean"]]) for r in rows}

    plain = pooled()
    monkeypatch.setattr(P, "BROADCAST_BYTES", -1)
    assert pooled() == plain
    monkeypatch.setattr(P, "LINK_BYTES", 2**24)  # four entries a task: link 0 is shared by more
    assert pooled() == plain and plain[4][2:4] == ([0.0, -4 * scale, scale], [4 * scale, 0.0, scale])


@pytest.mark.parametrize("threshold", [None, 8])  # no outsized set, and one
@pytest.mark.parametrize("weighted", [False, True])
def test_many_entries_move_without_their_vectors(spark, monkeypatch, ragged, threshold, weighted):
    """Entries of vectors too many to broadcast: the vectors are copied to each task, no entry is shuffled with its vector."""
    entries = ragged[0].unionByName(spark.createDataFrame([(s, c, 0.5) for s in range(7, 90) for c in (0, s % 9, 9, None)], ragged[0].schema))
    entries = entries.unionByName(spark.createDataFrame([(7, s % 3, 1.0) for s in range(9)], entries.schema))
    features = ragged[1].unionByName(ragged[1].filter("c IN (1, 3)").withColumn("vec", F.transform("vec", lambda x: x + 1)))  # links that come twice
    features = features.unionByName(spark.createDataFrame([(None, [1.0])], features.schema))
    stats = ["sum", "min", "max"] if weighted else ["sum", "mean", "var", "std", "min", "max"]

    def pooled():
        kept = P.pool_blocks(entries, features, "s", "c", stats, weight="w" if weighted else None, sums=["w"], threshold=threshold)
        told = lambda x: [told(y) for y in x] if isinstance(x, list) else round(x, 9) if isinstance(x, float) else x
        return kept, sorted(repr([told(x) for x in r]) for r in kept.collect())

    _, plain = pooled()
    monkeypatch.setattr(P, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(P, "copies_worth", lambda *_: 0)
    for link_bytes in (P.LINK_BYTES, 2**24):  # no shared link, and some
        monkeypatch.setattr(P, "LINK_BYTES", link_bytes)
        joined, rows = pooled()
        assert rows == plain and "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(P, "copies_worth", lambda *_: 3)
    monkeypatch.setattr(B, "MEMBERS", 5)
    copied, rows = pooled()
    assert rows == plain and len(rows) > 80
    assert threshold or "Join" not in copied._jdf.queryExecution().optimizedPlan().toString()


def test_copies_pay_for_many_entries_alone(spark):
    entries, vectors = spark.createDataFrame([(1, 2)], "s long, c long"), spark.createDataFrame([(2, [1.0])], "c long, vec array<double>")
    cores = spark.sparkContext.defaultParallelism
    total = 200 * 2**20
    assert P.copies_worth(entries, vectors, "c", total, 10**6, 256) == 0  # a copy for each core is more than all members
    assert P.copies_worth(entries, vectors, "c", total, 4 * 10**7, 256) == max(cores, -(-4 * 10**7 * P.HELD_BYTES // P.COPY_BYTES))
    assert P.copies_worth(entries, vectors, "c", P.COPY_BYTES + 1, 10**9, 256) == 0  # more than a task may hold
    assert P.copies_worth(entries, vectors.withColumn("c", F.col("c").cast("int")), "c", total, 4 * 10**7, 256) == 0
