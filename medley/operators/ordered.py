"""Running aggregates and ranks without one task per key.

A plain window sends a whole key to one task.  Here the rows are range
partitioned on (keys, order), so a hot key is cut into many slices; each slice
is aggregated, the slice totals are accumulated (at most one row per key and
slice) and added to the running value inside the slice.  The number of slices
follows the written bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medley.session import cut, scratch_path, written_bytes

SLICE_BYTES = 16 * 1024 * 1024  # of a slice as written, packed; narrow rows take 16 times that where they are sorted
TASK_BYTES = 2 * 1024 * 1024  # of slices as written that a task sorts
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}
_SLICE = "_slice"
_TIE = "_tie"


@dataclass(frozen=True)
class Running:
    """One running column: ``kind`` of ``column``, current row included or not."""

    name: str
    kind: str
    column: Column
    inclusive: bool = True


class Ordered:
    """Rows cut into ordered slices; ``order`` with ``keys`` should be a total order.

    ``ties=True`` adds a random last sort key, so that even a mass of equal rows
    is spread over slices; the written table fixes the draw.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list, slices: int | None = None, ties: bool = False):
        spark = df.sparkSession
        n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys = list(keys)
        self.order = [F.col(c) if isinstance(c, str) else c for c in order]
        if ties:
            df = df.withColumn(_TIE, F.rand(7))
            self.order.append(F.col(_TIE))
        # the slice number depends on sampled bounds: fix it before it is used twice
        self.df, path = self._sliced(df, n)
        size = written_bytes(spark, path)
        if slices is None and (enough := -(-size // SLICE_BYTES)) > n:
            # more rows than the usual number of slices should take: cut the written rows into as many as they need
            n = enough
            self.df, _ = self._sliced(self.df.drop(_SLICE), n)
        self.tasks = max(1, min(n, -(-size // TASK_BYTES)))
        self.placed = False

    def _sliced(self, df: DataFrame, n: int) -> tuple[DataFrame, str]:
        ranged = df.repartitionByRange(n, *[F.col(k) for k in self.keys], *self.order)
        path = scratch_path(df.sparkSession, "slices")
        return cut(ranged.withColumn(_SLICE, F.spark_partition_id()), path), path

    def with_running(self, *specs: Running) -> "Ordered":
        group = [*self.keys, _SLICE]
        totals = self.df.groupBy(*group).agg(
            *[_AGG[s.kind](s.column).alias(f"_t{i}") for i, s in enumerate(specs)]
        )
        earlier = Window.partitionBy(*self.keys).orderBy(_SLICE).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = totals.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(group)],
            *[_AGG[s.kind](f"_t{i}").over(earlier).alias(f"_c{i}") for i, s in enumerate(specs)],
            F.count(F.lit(1)).over(earlier).alias("_earlier"),
        ).filter("_earlier > 0").drop("_earlier")
        match = None
        for i, k in enumerate(group):
            same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
            match = same if match is None else match & same
        # the slices are ranges, so at most one key continues into each of them:
        # the carry has no more rows than there are slices and may be broadcast
        # slices are placed here: adaptive coalescing would fill a task with the packed bytes of many
        placed = self.df if self.placed else self.df.repartition(self.tasks, *group)
        joined = placed.join(F.broadcast(carry), match, "left").drop(*[f"_k{i}" for i in range(len(group))])
        base = Window.partitionBy(*group).orderBy(*self.order)
        columns = {}
        for i, s in enumerate(specs):
            frame = base.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
            local, carried = _AGG[s.kind](s.column).over(frame), F.col(f"_c{i}")
            if s.kind == "sum":
                value = F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
            elif s.kind == "max":
                value = F.greatest(local, carried)
            else:
                value = F.least(local, carried)
            columns[s.name] = value
        out = self._with(joined.withColumns(columns).drop(*[f"_c{i}" for i in range(len(specs))]))
        out.placed = True
        return out

    def with_row_number(self, name: str) -> "Ordered":
        return self.with_running(Running(name, "sum", F.lit(1).cast("long")))

    def with_column(self, name: str, column: Column) -> "Ordered":
        return self._with(self.df.withColumn(name, column))

    def with_join(self, other: DataFrame, on: list[str]) -> "Ordered":
        """Columns of ``other``, at most one row per ``on``, attached where they exist."""
        return self._with(self.df.join(other, on, "left"))

    def rows(self) -> DataFrame:
        return self.df.drop(_SLICE, _TIE)

    def _with(self, df: DataFrame) -> "Ordered":
        other = object.__new__(Ordered)
        other.keys, other.order, other.df = self.keys, self.order, df
        other.tasks, other.placed = self.tasks, self.placed
        return other


def row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Dense ids from 0 in no particular order, without a sort or a shuffle of the rows.

    The rows are written once with their place in their partition; the partitions' row counts,
    a row per partition, are accumulated to offsets and broadcast.
    """
    placed = cut(df.withColumn("_place", F.monotonically_increasing_id()))  # the partition's number, then the row's in 33 bits
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    joined = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return joined.withColumn(name, F.col("_offset") + at).drop("_place", "_part", "_offset")


def row_numbers(df: DataFrame, keys: list[str], order: list, name: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)``, cut into slices."""
    return Ordered(df, keys, order, ties=True).with_row_number(name).rows()


def value_ranks(df: DataFrame, keys: list[str], value: str, extra: dict | None = None) -> DataFrame:
    """One row per distinct (keys, value): ``n`` copies, ``n_before`` smaller rows.

    ``extra`` maps a name to an expression summed per distinct value; each also
    gets a ``<name>_before`` prefix sum.  Ties never reach the shuffle.
    """
    extra = extra or {}
    counted = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in extra.items()]
    )
    names = ["n", *extra]
    return (
        Ordered(counted, keys, [value])
        .with_running(*[Running(f"{k}_before", "sum", F.col(k), inclusive=False) for k in names])
        .rows()
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles: (keys, q, value).

    Works from distinct-value counts and prefix sums, so no task ever holds a
    group's values the way the built-in exact percentile does.
    """
    clean = df.filter(F.col(value).isNotNull()).select(*keys, value)
    group = list(keys)
    if not group:
        clean, group = clean.withColumn("_all", F.lit(0)), ["_all"]
    ranked = value_ranks(clean, group, value)
    totals = ranked.groupBy(*group).agg(F.sum("n").alias("_total"))
    spread = ranked.join(totals, group).withColumn(
        "q", F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    )
    pos = (F.col("_total") - 1) * F.col("q")
    inside = lambda at: (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
    low, high = F.floor(pos), F.ceil(pos)
    picked = (
        spread.filter(inside(low) | inside(high))
        .groupBy(*group, "q")
        .agg(
            F.max(F.when(inside(low), F.col(value))).alias("_lo"),
            F.max(F.when(inside(high), F.col(value))).alias("_hi"),
            F.max(pos - low).alias("_frac"),
        )
    )
    result = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    return picked.select(*keys, "q", result.alias(value))
