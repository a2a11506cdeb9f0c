"""Early-stop detection on metric series, in one go or batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medley.operators.ordered import Ordered, Running


def early_stop(
    series: DataFrame,
    run: str,
    order: list[str],
    value: str,
    patience: int = 100,
    mode: str = "maximize",
    min_delta: float | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """(run, stop_step, best_step, best, steps) per run; ``stop_step`` NULL if not stopped.

    Without ``min_delta`` a value equal to the best so far counts as an improvement; with
    it only one that beats the last improvement by ``min_delta`` or more.  The best is
    the value of the last improvement.  NaN and NULL are no gain and never the best.  The run stops at the first step that is ``patience`` steps past the last
    improvement, counted from the first step if there was none.  All
    running values are cut into slices, so one very long run is spread out.

    ``state`` is the result for the steps already seen; ``series`` then holds the
    steps that follow.  A stopped run keeps its result.
    """
    if mode not in ("maximize", "minimize"):
        raise ValueError("mode must be 'maximize' or 'minimize'")
    sign = 1.0 if mode == "maximize" else -1.0
    prior = ["_steps0", "_best0", "_last0"]
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = series.withColumn("_v", F.when(usable, F.col(value) * sign))
    if state is None:
        rows = rows.withColumns({"_steps0": F.lit(0).cast("long"), "_best0": F.lit(None).cast("double"), "_last0": F.lit(None).cast("long")})
    else:
        known = state.filter(F.col("stop_step").isNull()).select(
            run, F.col("steps").alias("_steps0"), (F.col("best") * sign).alias("_best0"), F.col("best_step").alias("_last0")
        )
        stopped = state.filter(F.col("stop_step").isNotNull()).select(run)
        rows = rows.join(stopped, run, "left_anti").join(known, run, "left").fillna(0, ["_steps0"])
    ordered = (
        Ordered(rows.select(run, *order, "_v", *prior), [run], order)
        .with_running(
            Running("_seen", "sum", F.lit(1).cast("long"), inclusive=False),
            Running("_before", "max", F.col("_v"), inclusive=False),
        )
        .with_column("_step", F.col("_seen") + F.col("_steps0"))
        .with_column("_top", F.greatest("_before", "_best0"))
    )
    if min_delta:
        gain = F.col("_gain")
        ordered = ordered.with_join(_gains(ordered.rows(), run, abs(min_delta)), [run, "_step"])
    else:
        beats = F.col("_v").isNotNull() & (F.col("_top").isNull() | (F.col("_v") >= F.col("_top")))
        gain = F.when(beats, F.col("_step"))
    gained = (
        ordered.with_column("_gain", gain)
        .with_running(Running("_gained", "max", F.col("_gain")))
        .with_column("_last", F.greatest("_gained", "_last0"))
        .rows()
        .select(run, "_step", "_v", "_gain", "_last", "_best0")
    )
    waited = F.col("_step") - F.coalesce("_last", F.lit(-1))
    stops = gained.filter(waited >= patience).groupBy(run).agg(F.min("_step").alias("stop_step"))
    seen = gained.join(stops, run, "left").filter(F.col("stop_step").isNull() | (F.col("_step") <= F.col("stop_step")))
    fresh = seen.groupBy(run).agg(
        F.max("stop_step").alias("stop_step"),
        F.max("_last").alias("best_step"),
        (F.coalesce(F.max_by("_v", "_gain"), F.max("_best0")) * sign).alias("best"),
        (F.max("_step") + 1).alias("steps"),
    )
    if state is None:
        return fresh
    untouched = state.join(fresh.select(run), run, "left_anti")
    return fresh.unionByName(untouched.select(*fresh.columns))


def _gains(rows: DataFrame, run: str, min_delta: float) -> DataFrame:
    """(run, _step, _gain) of the steps that beat the last improvement by ``min_delta``.

    Each of them is a record, above all values before it, so only the records of a run are walked
    through, in order, while the run itself stays cut into slices.  The walk goes from gain to gain by
    binary search, since records rise, and holds one number of a run besides the rows that are passing:
    what one gain leads to depends on its exact value, so no summary of a slice is shorter than its records.
    """
    records = rows.filter(F.col("_v").isNotNull() & (F.col("_top").isNull() | (F.col("_v") > F.col("_top"))))
    kind = rows.schema[run].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run, best, started = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = pc.fill_null(batch.column(0).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(np.diff(codes)) + 1)
            reach = batch.column(2).to_numpy(zero_copy_only=False) - min_delta
            gained = []
            for start, end in zip(starts, np.append(starts[1:], batch.num_rows)):
                if not started or batch.column(0)[int(start)].as_py() != open_run:
                    open_run, started = batch.column(0)[int(start)].as_py(), True
                    best = batch.column(3)[int(start)].as_py()
                at = int(start)
                while at < end:
                    if best is not None:
                        at += int(np.searchsorted(reach[at:end], best))
                        if at == end:
                            break
                    gained.append(at)
                    best = batch.column(2)[at].as_py()
                    at += 1
            if gained:
                own = batch.take(pa.array(gained))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(1)], [run, "_step", "_gain"])

    ordered = records.select(run, "_step", "_v", "_best0").repartition(run).sortWithinPartitions(run, "_step")
    return ordered.mapInArrow(walk, f"`{run}` {kind}, _step long, _gain long")
