"""Accumulating operators on streams: running means, metric sums, early stop.

What has been seen so far lives in Spark's state store, one small row per key, kept with
the query's checkpoint: a batch reads and writes the keys it touches, and what a query
has found is read from the last committed state, however many batches there were.
A restart with the same work folder goes on from that state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from medley.functions.numeric import safe_divide


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1000) -> DataFrame:
    """A Parquet table, one file or a folder of part files, as a stream of ``files`` per trigger."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def _drain(stream: DataFrame, work: str) -> bool:
    """Run the stream over everything available, then stop; whether any batch was ever committed.

    The updates themselves go nowhere: the state store is the result.
    """
    query = (
        stream.writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/checkpoint/commits")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(place) and len(files.listStatus(place)) > 0


def _accumulated(stream: DataFrame, keys: list[StructField], values: str, work: str) -> DataFrame:
    """(keys, values) as the state store holds them; ``values`` names and types the state's fields in order."""
    spark = stream.sparkSession
    fields = StructType.fromDDL(values)
    if not _drain(stream, work):  # nothing has arrived
        return spark.createDataFrame([], StructType([*keys, *fields.fields]))
    state = spark.read.format("statestore").load(f"{work}/checkpoint")
    value = "value.groupState" if "groupState" in state.schema["value"].dataType.names else "value"
    held = F.col(value).cast(fields)  # by position: Spark names the fields of its own aggregates alike
    names = [k.name for k in keys]
    return state.select(*[F.col("key")[k].alias(k) for k in names], held.alias("_v")).select(*names, "_v.*")


def running_means(stream: DataFrame, key: str, value: str, work: str) -> DataFrame:
    """(key, n, mean) after the stream; updated per key as rows arrive."""
    sums = stream.groupBy(key).agg(F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("total"))
    held = _accumulated(sums, [sums.schema[key]], "n long, total double", work)
    return held.select(key, "n", safe_divide(F.col("total"), F.col("n")).alias("mean"))


def metric_sums(stream: DataFrame, keys: list[str], work: str, epoch: str | None = None) -> DataFrame:
    """Sufficient statistics of (y, y_hat) per key; a new epoch key is a reset.

    ``epoch`` names the key that counts epochs, whole numbers from 0.  Then only the highest
    epoch seen is kept: a batch drops the state of those before it, and rows that come late for them.
    Without it every epoch's sums stay.
    """
    if epoch is not None and epoch not in keys:
        raise ValueError(f"the epoch {epoch!r} must be one of the keys {keys}")
    grouped = keys
    if epoch is not None:  # an epoch as a point in time, so that the watermark, one epoch back, drops what is older
        moment = F.timestamp_seconds(F.col(epoch) + 2)  # the watermark starts at 0, and drops what is not after it
        stream = stream.withColumn("_epoch", moment).withWatermark("_epoch", "1 second")
        grouped = ["_epoch", *[k for k in keys if k != epoch]]
    y, p = F.col("y").cast("double"), F.col("y_hat").cast("double")
    sums = stream.groupBy(*grouped).agg(
        F.count("y").alias("n"),
        F.sum(y).alias("sy"),
        F.sum(p).alias("sp"),
        F.sum(y * y).alias("syy"),
        F.sum(p * p).alias("spp"),
        F.sum(y * p).alias("syp"),
    )
    held = _accumulated(sums, [sums.schema[k] for k in grouped], "n long, sy double, sp double, syy double, spp double, syp double", work)
    if epoch is not None:
        held = held.withColumn(epoch, F.unix_seconds("_epoch") - 2).select(*keys, *held.columns[len(grouped) :])
    return held


def metrics_from_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mse, pearson) from the accumulated sums."""
    c = F.col
    cov = c("syp") - c("sy") * c("sp") / c("n")
    var_y = c("syy") - c("sy") * c("sy") / c("n")
    var_p = c("spp") - c("sp") * c("sp") / c("n")
    positive = (var_y > 0) & (var_p > 0)
    return sums.select(
        *keys,
        "n",
        ((c("syy") - 2 * c("syp") + c("spp")) / c("n")).alias("mse"),
        F.when(positive, safe_divide(cov, F.sqrt(var_y * var_p))).alias("pearson"),
    )


_STATE = "steps long, best double, last long, stop long"


def _walk(values: np.ndarray, state: tuple, patience: int, min_delta: float | None) -> tuple:
    """The state (steps, best, last improvement, stop) after further values, NaN where there is none."""
    steps, best, last, stop = state
    if stop is not None or not len(values):
        return state
    above = -np.inf if best is None else best
    known = np.where(np.isnan(values), -np.inf, values)
    if min_delta:
        gained, at = [], 0
        while at < len(values):  # from gain to gain
            hits = np.flatnonzero(known[at:] - min_delta >= above) if above > -np.inf else np.flatnonzero(~np.isnan(values[at:]))
            if not len(hits):
                break
            at += int(hits[0])
            gained.append(at)
            above = values[at]
            at += 1
        gains = np.zeros(len(values), bool)
        gains[gained] = True
    else:
        before = np.maximum.accumulate(np.append(above, known))[:-1]
        gains = ~np.isnan(values) & (known >= before)
    number = np.arange(steps, steps + len(values))
    latest = np.maximum.accumulate(np.where(gains, number, -1 if last is None else last))
    over = np.flatnonzero(number - latest >= patience)
    end = int(over[0]) if len(over) else len(values) - 1
    seen = np.flatnonzero(gains[: end + 1])
    if len(seen):
        best, last = float(values[seen[-1]]), int(number[seen[-1]])
    return steps + end + 1, best, last, int(number[end]) if len(over) else None


def early_stop_stream(
    stream: DataFrame, run: str, order: list[str], value: str, work: str, patience: int = 100, mode: str = "maximize",
    min_delta: float | None = None,
) -> DataFrame:
    """(run, stop_step, best_step, best, steps) of an arriving series, by the rules of ``early.early_stop``.

    A run's rows must arrive batch after batch in order; inside a batch they may come in any.  The state of a run
    is four numbers in the state store; a batch touches the runs it has rows of.  A task holds the values of one
    run of one batch, so the batch size (files per trigger) bounds its memory; long histories at rest are for the
    batch operator, which cuts a run into slices.
    """
    if mode not in ("maximize", "minimize"):
        raise ValueError("mode must be 'maximize' or 'minimize'")
    sign = 1.0 if mode == "maximize" else -1.0
    delta = abs(min_delta) if min_delta else None

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (0, None, None, None)
        if before[3] is None:  # a stopped run keeps its result
            rows = pd.concat(list(parts)).sort_values(order, kind="stable", na_position="first")
            values = rows["_v"].to_numpy(dtype=float, na_value=np.nan) * sign
            state.update(_walk(values, before, patience, delta))
        yield pd.DataFrame({"steps": [state.get[0]]})

    rows = stream.select(run, *order, F.col(value).cast("double").alias("_v"))
    states = rows.groupBy(run).applyInPandasWithState(update, "steps long", _STATE, "update", GroupStateTimeout.NoTimeout)
    held = _accumulated(states, [rows.schema[run]], _STATE, work)
    return held.select(
        run, F.col("stop").alias("stop_step"), F.col("last").alias("best_step"), (F.col("best") * sign).alias("best"), "steps"
    )
