"""Scores of a prediction table (row_id, dim, y, y_hat).

Everything is built from mergeable aggregates; rank statistics use prefix sums
over distinct values, never pairs of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.functions import losses as L
from medley.functions.mixing import DIGITS, mix
from medley.functions.numeric import cosine_agg, pearson_agg, safe_divide
from medley.operators.ordered import Ordered, Running, row_numbers, value_ranks
from medley.operators.pooling import dot, pack
from medley.session import cut

REDUCTIONS = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def reduce_scores(per_group: DataFrame, score: str, reduction: str | None, name: str | None = None) -> DataFrame:
    """Reduce per-group scores, undefined ones skipped; 'none' keeps them."""
    if reduction in (None, "none"):
        return per_group
    if reduction not in REDUCTIONS:
        raise ValueError(f"invalid reduction {reduction!r}; choose from {[*REDUCTIONS, 'none']}")
    return per_group.agg(REDUCTIONS[reduction](score).alias(name or score))


def row_cosine(pred: DataFrame, key: str = "row_id") -> DataFrame:
    return pred.groupBy(key).agg(cosine_agg("y", "y_hat").alias("cosine"))


def row_pearson(pred: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that are constant (so also all-zero rows) on either side have no score."""
    return pred.groupBy(key).agg(pearson_agg("y", "y_hat").alias("pearson"))


def column_pearson(pred: DataFrame) -> DataFrame:
    return pred.groupBy("dim").agg(pearson_agg("y", "y_hat").alias("pearson"))


def all_pairs_mean_cosine(pred: DataFrame) -> DataFrame:
    """Mean cosine over every (truth row, predicted row) pair.

    The mean of all cosines is the inner product of the two mean unit vectors,
    so the pairs are never formed.  Zero rows count as cosine 0.
    """
    rows = pack(pred, "row_id", ["y", "y_hat"]).withColumns(
        {"_ny": F.sqrt(dot("y", "y")), "_np": F.sqrt(dot("y_hat", "y_hat"))}
    )
    cells = rows.select("_ny", "_np", F.posexplode(F.arrays_zip("y", "y_hat")).alias("dim", "c"))
    unit = lambda x, norm: F.coalesce(safe_divide(F.col(x), F.col(norm)), F.lit(0.0))
    units = cells.select("dim", unit("c.y", "_ny").alias("a"), unit("c.y_hat", "_np").alias("b"))
    sums = units.groupBy("dim").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return sums.agg(F.sum(F.col("a") * F.col("b")).alias("cosine"))


def errors(pred: DataFrame, *keys: str) -> DataFrame:
    return pred.groupBy(*keys).agg(
        L.mae().alias("mae"), L.mse().alias("mse"), F.sqrt(L.mse()).alias("rmse")
    )


def column_r2(pred: DataFrame) -> DataFrame:
    """1 - SSE / SST per dim; a constant truth scores 1 when exact, else 0."""
    return pred.groupBy("dim").agg(r2_agg().alias("r2"))


def r2_agg() -> Column:
    e = F.col("y") - F.col("y_hat")
    sse, sst = F.sum(e * e), F.var_pop("y") * F.count("y")
    flat = F.min("y") == F.max("y")
    return F.when(flat, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - safe_divide(sse, sst))


def average_ranks(pred: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their 1-based average rank inside ``keys``."""
    ranks = value_ranks(pred, keys, value)
    return ranks.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2)


def auroc(pred: DataFrame, keys: list[str], label: str = "y", score: str = "y_hat") -> DataFrame:
    """Rank AUROC per key; float labels are truncated to int; one-class keys are NULL."""
    flagged = pred.select(*keys, score, F.col(label).cast("int").alias("_flag"))
    positive = (F.col("_flag") == 1).cast("long")
    ranks = value_ranks(flagged, keys, score, {"pos": positive, "neg": 1 - positive})
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    total = F.sum("pos").cast("double") * F.sum("neg")
    return ranks.groupBy(*keys).agg(safe_divide(wins, total).alias("auroc"))


RADIX_BITS = 3


def kendall(pred: DataFrame, keys: list[str], y: str = "y", p: str = "y_hat") -> DataFrame:
    """Kendall tau-b per key in n log n rows.

    Discordant pairs are counted as inversions: the rank of ``p`` is read as
    base-8 digits, and two rows are ordered wrongly exactly at the highest digit
    where their ranks differ.  For every digit level the rows sharing the higher
    digits are walked in ``y`` order, and each row adds the larger digits already
    seen: a few prefix sums over (level, higher digits).
    """
    group = list(keys)
    if not group:
        pred, group = pred.withColumn("_all", F.lit(0)), ["_all"]
    pairs = pred.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(
        *group, F.col(y).alias("_y"), F.col(p).alias("_p")
    ).agg(F.count(F.lit(1)).alias("c"))
    pairs = cut(pairs)  # read by every count below
    size = pairs.groupBy(*group).agg(F.sum("c").alias("n")).agg(F.max("n")).first()[0] or 1
    levels = max(1, -(-(size - 1).bit_length() // RADIX_BITS))
    by_p = pairs.groupBy(*group, "_p").agg(F.sum("c").alias("t"))
    codes = (
        Ordered(by_p, group, ["_p"])
        .with_running(Running("code", "sum", F.col("t"), inclusive=False))
        .rows()
        .select(*group, "_p", "code")
    )
    coded = pairs.join(codes, [*group, "_p"]).withColumn(
        "level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    )
    shift = f"level * {RADIX_BITS}"
    digits = coded.select(
        *group,
        "_y",
        "code",
        "c",
        "level",
        F.expr(f"shiftright(code, {shift} + {RADIX_BITS})").alias("high"),
        F.expr(f"cast(shiftright(code, {shift}) & {2**RADIX_BITS - 1} as int)").alias("digit"),
    )
    above = range(1, 2**RADIX_BITS)
    walked = Ordered(digits, [*group, "level", "high"], ["_y", "code"]).with_running(
        *[
            Running(f"_ge{d}", "sum", F.when(F.col("digit") >= d, F.col("c")).otherwise(0), inclusive=False)
            for d in above
        ]
    )
    larger = F.get(F.array(*[F.col(f"_ge{d}") for d in above], F.lit(0).cast("long")), F.col("digit"))
    inversions = walked.rows().groupBy(*group).agg(F.sum(F.col("c").cast("double") * larger).alias("inv"))
    choose2 = lambda c: c.cast("double") * (c - 1) / 2
    tie = lambda df, c, name: df.groupBy(*group).agg(F.sum(choose2(F.col(c))).alias(name), F.sum(c).alias(f"{name}_n"))
    ties_y = tie(pairs.groupBy(*group, "_y").agg(F.sum("c").alias("t")), "t", "n1")
    ties_p = tie(by_p, "t", "n2").drop("n2_n")
    ties_both = tie(pairs, "c", "n3").drop("n3_n")
    joined = ties_y.join(ties_p, group).join(ties_both, group).join(inversions, group)
    n0 = choose2(F.col("n1_n"))
    top = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("inv")
    tau = safe_divide(top, F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2"))))
    return joined.select(*keys, tau.alias("kendall"))


def mask_accuracy(pred: DataFrame, truth: Column, guess: Column) -> DataFrame:
    return pred.agg(F.avg((truth == guess).cast("int")).alias("accuracy"))


def bundle(pred: DataFrame) -> DataFrame:
    """Pearson, RMSE and Kendall over all cells flattened."""
    simple = pred.agg(pearson_agg("y", "y_hat").alias("pearson"), F.sqrt(L.mse()).alias("rmse"))
    tau = kendall(pred, [])
    return simple.withColumn("kendall", tau.scalar())


def by_part(pred: DataFrame) -> DataFrame:
    """Column Pearson, row Pearson, cosine and R2 for dims 0-1 ('first') and the rest."""
    parted = pred.withColumn("part", F.when(F.col("dim") < 2, "first").otherwise("rest"))
    rows = parted.groupBy("part", "row_id").agg(
        pearson_agg("y", "y_hat").alias("rp"), cosine_agg("y", "y_hat").alias("cs")
    )
    row_level = rows.groupBy("part").agg(
        F.avg("rp").alias("row_pearson"), F.avg("cs").alias("cosine")
    )
    columns = parted.groupBy("part", "dim").agg(pearson_agg("y", "y_hat").alias("cp"), r2_agg().alias("r2"))
    column_level = columns.groupBy("part").agg(F.avg("cp").alias("column_pearson"), F.avg("r2").alias("r2"))
    return row_level.join(column_level, "part")


# --- bootstrap ---------------------------------------------------------------

_SUMS = ["n", "se", "ae", "sy", "sp", "syy", "spp", "syp"]
SMALL = 100_000  # rows whose sums may go to every task
BLOCK = 1_000  # rows whose weights for all replicates are held at once
CELLS = 1 << 20  # (replicate, row) counts of a slice of rows; 8 MB
DRAWS = 20_000  # rows a task draws for


def row_sums(pred: DataFrame) -> DataFrame:
    """Per row, the sums every metric below needs."""
    y, p = F.col("y"), F.col("y_hat")
    e = p - y
    return pred.groupBy("row_id").agg(
        F.count("y").cast("double").alias("n"),
        F.sum(e * e).alias("se"),
        F.sum(F.abs(e)).alias("ae"),
        F.sum(y).alias("sy"),
        F.sum(p).alias("sp"),
        F.sum(y * y).alias("syy"),
        F.sum(p * p).alias("spp"),
        F.sum(y * p).alias("syp"),
    )


def metric_from_sums(metric: str) -> Column:
    c = F.col
    if metric == "rmse":
        return F.sqrt(c("se") / c("n"))
    if metric == "mae":
        return c("ae") / c("n")
    if metric == "pearson":
        cov = c("syp") - c("sy") * c("sp") / c("n")
        var_y = c("syy") - c("sy") * c("sy") / c("n")
        var_p = c("spp") - c("sp") * c("sp") / c("n")
        return safe_divide(cov, F.sqrt(var_y * var_p))
    raise ValueError(f"unknown metric {metric!r}; choose from rmse, mae, pearson")


def bootstrap(
    pred: DataFrame, metric: str, resamples: int = 500, alpha: float = 0.05, seed: int = 0, method: str = "poisson"
) -> DataFrame:
    """(metric, lower, upper) percentile bounds over ``resamples`` draws of rows.

    'poisson' gives every row an independent Poisson(1) weight per replicate: no
    join, and the shuffle carries one partial row per task and replicate.
    'resample' draws n rows with replacement per replicate.  Up to ``SMALL`` rows, their
    sums (8 numbers each) go to every task, which adds up the rows it draws; beyond, the
    draws of a block of rows go to the slices of the rows they pick, four bytes a draw.

    Replicates are never rows: a task keeps one vector of sums per replicate and adds
    blocks of rows to all of them by a matrix product.
    """
    sums = row_sums(pred)
    if method == "resample":
        sums = cut(sums)  # counted and read
        small = sums.count() <= SMALL
        totals = (_resampled if small else _sent_draws)(sums, resamples, seed)
    elif method == "poisson":
        totals = _weighted(sums, resamples, seed)
    else:
        raise ValueError("method must be 'resample' or 'poisson'")
    values = totals.filter(F.col("n") > 0).select(metric_from_sums(metric).alias("value"))
    # `resamples` values in all, so the built-in exact percentile is bounded
    return values.agg(
        F.lit(metric).alias("metric"),
        F.percentile("value", F.lit(alpha / 2)).alias("lower"),
        F.percentile("value", F.lit(1 - alpha / 2)).alias("upper"),
    )


def _hashes(names: list[str], seeds: range) -> np.ndarray:
    """``mix(seed, name)`` for all names and seeds, a row per name."""
    first = [hashlib.md5(f"{s}:".encode()) for s in seeds]

    def digest(start, name: bytes) -> bytes:
        whole = start.copy()
        whole.update(name)
        return whole.digest()[:8]

    made = b"".join([digest(start, name) for name in (n.encode() for n in names) for start in first])
    return (np.frombuffer(made, ">u8").reshape(len(names), len(first)) >> np.uint64(64 - 4 * DIGITS)).astype(np.int64)


def _totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("b").agg(*[F.sum(s).alias(s) for s in _SUMS])


_PARTS = "b int, " + ", ".join(f"{s} double" for s in _SUMS)


def _in_tasks(rows: DataFrame, resamples: int, add: Callable) -> DataFrame:
    """(b, sums) added up over tasks; ``add(totals, batch)`` adds a batch of rows to a task's totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((resamples, len(_SUMS)))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                add(totals, batch.slice(start, BLOCK))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(resamples, dtype=np.int32)), *[pa.array(totals[:, i]) for i in range(len(_SUMS))]], ["b", *_SUMS]
        )

    return _totals(rows.mapInArrow(run, _PARTS))


def _weighted(sums: DataFrame, resamples: int, seed: int) -> DataFrame:
    cuts = np.array(poisson_cuts())
    seeds = range(seed, seed + resamples)

    def add(totals: np.ndarray, batch: pa.RecordBatch) -> None:
        weights = np.searchsorted(cuts, _hashes(batch.column(0).to_pylist(), seeds), side="right")
        values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
        totals += weights.T.astype(float) @ values

    named = sums.filter(F.col("row_id").isNotNull()).select(F.col("row_id").cast("string"), *_filled())
    return _in_tasks(named, resamples, add)


def _filled() -> list[Column]:
    return [F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in _SUMS]


def _resampled(sums: DataFrame, resamples: int, seed: int) -> DataFrame:
    """All draws of a few rows: each task takes a part of the row numbers."""
    values = sums.orderBy("row_id").select(*_SUMS).toPandas().fillna(0.0).to_numpy(dtype=float)
    seeds = range(seed, seed + resamples)

    def add(totals: np.ndarray, batch: pa.RecordBatch) -> None:
        picks = _hashes(batch.column(0).to_pylist(), seeds) % len(values)
        for b in range(resamples):
            totals[b] += values[picks[:, b]].sum(axis=0)

    numbers = sums.sparkSession.range(1, len(values) + 1).select(F.col("id").cast("string").alias("rn"))
    return _in_tasks(numbers, resamples, add)


def _sent_draws(sums: DataFrame, resamples: int, seed: int) -> DataFrame:
    """All draws of many rows, without a row per draw.

    The rows' sums lie in slices of row numbers.  A task draws for a block of row numbers and sends each slice its
    draws as one array of integers (replicate, place in the slice).  A slice counts them and adds its rows by a
    matrix product: it holds about ``CELLS`` integers, whatever the number of rows.
    """
    numbered = cut(row_numbers(sums, [], ["row_id"]))  # counted and read
    total = numbered.count()
    seeds = range(seed, seed + resamples)
    size = max(1, CELLS // resamples)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                names = batch.column(0).slice(start, BLOCK).to_pylist()
                picks = (_hashes(names, seeds) % total).ravel()
                slices = picks // size
                code = np.tile(np.arange(resamples) * size, len(names)) + picks % size
                order = np.argsort(slices, kind="stable")
                found, starts = np.unique(slices[order], return_index=True)
                ends = pa.array(np.append(starts, len(code)), pa.int32())
                draws = pa.ListArray.from_arrays(ends, pa.array(code[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(found), draws], ["slice", "draws"])

    def add(drawn: pa.Table, rows: pa.Table) -> pa.Table:
        values = np.zeros((size, len(_SUMS)))
        values[rows.column("at").to_numpy()] = np.stack([rows.column(s).to_numpy() for s in _SUMS], axis=1)
        draws = [one.flatten().to_numpy() for one in drawn.column("draws").chunks]
        times = np.bincount(np.concatenate([np.zeros(0, np.int32), *draws]), minlength=resamples * size)
        times = times.reshape(resamples, size).astype(float)
        finite = np.isfinite(values)
        totals = times @ np.where(finite, values, 0.0)
        for i in np.flatnonzero(~finite.all(axis=1)):  # no draw of an infinite value adds nothing
            totals[times[:, i] > 0] += np.where(finite[i], 0.0, values[i])
        return pa.table([pa.array(np.arange(resamples, dtype=np.int32)), *[pa.array(c) for c in totals.T]], ["b", *_SUMS])

    spark = sums.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // DRAWS))
    numbers = spark.range(1, total + 1, 1, tasks).select(F.col("id").cast("string").alias("rn"))
    drawn = numbers.mapInArrow(draw, "slice long, draws array<int>")
    place = F.col("rn") - 1
    rows = numbered.select(F.floor(place / size).alias("slice"), (place % size).cast("int").alias("at"), *_filled())
    return _totals(drawn.groupBy("slice").cogroup(rows.groupBy("slice")).applyInArrow(add, _PARTS))


def poisson_cuts() -> list[int]:
    """Integer thresholds of the Poisson(1) distribution on the hash range."""
    from math import exp, factorial

    from medley.functions.mixing import RANGE

    cuts, acc = [], 0.0
    for k in range(12):
        acc += exp(-1) / factorial(k)
        cuts.append(int(acc * RANGE))
    return cuts
