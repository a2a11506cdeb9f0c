"""Pool the vectors of a set's members into one vector per set.

Entries are narrow (set key, member link) and vectors are wide.  When the
vectors are few enough to broadcast (their size is measured), the plan moves
the entries: they are shuffled by set, then the vectors are attached and
reduced in place to one block of accumulators per set (see ``blocks``).
Otherwise, where the entries are so many that their vectors would weigh more than
some copies of the vector table, the entries are still what is shuffled: by set to
a few large tasks, each of which gets a copy of the vectors.  Else entries and
vectors are joined by link and the joined rows, still one array per entry, are
shuffled by set once.  Vectors of floats travel as floats.  Sets with an outsized number of
entries are not shuffled whole; each task reduces its part of them to a block,
and the blocks are merged (see ``hot``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.operators.blocks import Spec, reduce_beside, reduce_placed, reduce_spread
from medley.operators.hot import TASK_BYTES, counted_profile, profile, split_hot

BROADCAST_BYTES = 128 * 1024 * 1024
COPY_BYTES = 256 * 1024 * 1024  # of vectors that a task may hold, and of entries beside them
HELD_BYTES = 48  # of an entry that a task holds
LINK_BYTES = 64  # of an entry where it waits for its vector

STATS = {
    "sum": F.sum,
    "mean": F.avg,
    "var": F.var_pop,
    "std": F.stddev_pop,
    "min": F.min,
    "max": F.max,
}


def pool_blocks(
    entries: DataFrame,
    features: DataFrame,
    key: str,
    link: str,
    stats: list[str],
    vec: str = "vec",
    weight: str | None = None,
    sums: list[str] | None = None,
    threshold: int | None = None,
    sketch: DataFrame | None = None,
    measured: tuple[int, int, bool] | None = None,
) -> DataFrame:
    """(key, n, size, one array per statistic, sum_<column> per column of ``sums``) for each set with members.

    ``n`` counts members; ``size`` counts them per dimension where some vectors are shorter and is NULL
    otherwise.  NULL entries are skipped as in SQL, a dimension without any has NULL.  ``weight`` names a
    column of ``entries`` that the values are multiplied with in ``sum``; where it is NULL the member has
    no value.  No member becomes a row per dimension: see ``blocks``.  ``measured``: the ``vector_bytes`` of
    ``features`` where the caller has them.
    """
    spec = Spec(tuple(stats), tuple(sums or ()), weight is not None)
    needed = dict.fromkeys([key, link, *([weight] if weight else []), *spec.sums])
    vectors = features.select(link, vec)
    total, widest, narrow = measured or vector_bytes(vectors, vec)
    if narrow:
        vectors = vectors.withColumn(vec, F.col(vec).cast("array<float>"))
    rows, tasks, hot = counted_profile(entries if sketch is None else sketch, key, widest, threshold)
    small = total <= BROADCAST_BYTES
    copies = 0 if small else copies_worth(entries, vectors, link, total, rows, widest // (2 if narrow else 1))

    def attach(part: DataFrame) -> DataFrame:
        return part.join(F.broadcast(vectors), link) if small else by_link(part, vectors, link, total, sketch)

    ordinary, outsized = split_hot(entries.select(*needed), key, hot)
    if copies:
        pooled = reduce_beside(ordinary, vectors, key, link, vec, spec, weight, copies)
    else:
        placed = attach(ordinary.repartition(tasks, key)) if small else attach(ordinary).repartition(tasks, key)
        pooled = reduce_placed(placed, key, vec, spec, weight)
    return pooled if outsized is None else pooled.unionByName(reduce_spread(attach(outsized), key, vec, spec, weight))


def copies_worth(entries: DataFrame, vectors: DataFrame, link: str, total: int, rows: int, row_bytes: int) -> int:
    """Tasks that the entries need where each gets a copy of the vectors, ``total`` bytes; 0 if copies don't pay.

    They pay where they are less than half of what the vectors of all ``rows`` entries weigh, at ``row_bytes`` each.
    """
    copies = max(entries.sparkSession.sparkContext.defaultParallelism, -(-rows * HELD_BYTES // COPY_BYTES))
    fits = total <= COPY_BYTES and entries.schema[link].dataType == vectors.schema[link].dataType
    return copies if fits and 2 * copies * total < rows * row_bytes else 0


def by_link(entries: DataFrame, vectors: DataFrame, link: str, total: int, sketch: DataFrame | None = None) -> DataFrame:
    """Entries with their vectors, ``total`` bytes of them, in as many tasks as both need.

    Links that many entries share are not placed: the vectors of those few are broadcast.  ``sketch``: rows
    that are cheaper to count than ``entries`` and hold theirs.
    """
    count, hot = profile(entries if sketch is None else sketch, link, LINK_BYTES)
    tasks = max(count, -(-total // TASK_BYTES))
    ordinary, shared = split_hot(entries, link, hot)
    met = ordinary.repartition(tasks, link).join(vectors.repartition(tasks, link), link)
    if shared is None:
        return met
    return met.unionByName(shared.join(F.broadcast(vectors.filter(F.col(link).isin(hot))), link))


def vector_bytes(vectors: DataFrame, vec: str) -> tuple[int, int, bool]:
    """(bytes of all vectors as they are sent, bytes of the longest one at 8 an entry, whether they are sent as floats).

    Vectors whose values are all floats, as those that were stored so, are sent in 4 bytes an entry and widened after.
    """
    lost = F.exists(vec, lambda x: ~x.eqNullSafe(x.cast("float").cast("double")))
    found = vectors.agg(
        F.sum(F.size(vec)).alias("entries"), F.max(F.size(vec)).alias("widest"), F.max(F.coalesce(lost, F.lit(False))).alias("lost")
    ).first()
    entries, narrow = max(0, found["entries"] or 0), not found["lost"]
    return (4 if narrow else 8) * entries, 8 * max(1, found["widest"] or 1), narrow


def pool_members(
    entries: DataFrame,
    features: DataFrame,
    key: str,
    link: str,
    stats: list[str],
    vec: str = "vec",
    threshold: int | None = None,
) -> DataFrame:
    """(key, dim, n, one column per statistic); sets without members give no row."""
    return cells_of(pool_blocks(entries, features, key, link, stats, vec, threshold=threshold), key, stats)


def cells_of(pooled: DataFrame, key: str, arrays: list[str], n: str = "n") -> DataFrame:
    """(key, dim, n, arrays) from one row per set to one per set and dimension."""
    first = F.col(arrays[0])
    size = F.coalesce("size", F.transform(first, lambda x: F.col("n")))
    dims = F.transform(first, lambda x, i: i)
    items = F.arrays_zip(dims.alias("dim"), size.alias(n), *arrays)
    return pooled.select(key, F.inline(items))


def pool_vectors(df: DataFrame, keys: list[str], vec: str, dims: int, stats: list[str]) -> DataFrame:
    """Pool rows that already carry their vector: one array per statistic.

    One aggregate column per dimension, one shuffle; for few dimensions and
    few groups, where partial aggregation shrinks the rows.
    """
    columns = [STATS[s](F.col(vec)[d]).alias(f"_{s}_{d}") for s in stats for d in range(dims)]
    pooled = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *columns)
    arrays = [F.array(*[F.col(f"_{s}_{d}") for d in range(dims)]).alias(s) for s in stats]
    return pooled.select(*keys, "n", *arrays)


def pool_long(df: DataFrame, keys: list[str], value: str, stats: list[str], dim: str = "dim") -> DataFrame:
    """(keys, dim, n, statistics) from (keys, dim, value) rows."""
    return df.groupBy(*keys, dim).agg(
        F.count(F.lit(1)).alias("n"), *[STATS[s](value).alias(s) for s in stats]
    )


def pack(cells: DataFrame, key: str, values: list[str], *extra: Column) -> DataFrame:
    """(key, dim, values) to one array per value in dim order.

    A group holds one row per dimension, so its size is the vector length.
    """
    items = F.sort_array(F.collect_list(F.struct("dim", *values)))
    rows = cells.groupBy(key).agg(items.alias("_items"), *extra)
    kept = [c for c in rows.columns if c != "_items"]
    return rows.select(*kept, *[F.col(f"_items.{v}").alias(v) for v in values])


def unpack(df: DataFrame, keys: list[str], arrays: list[str], dim: str = "dim") -> DataFrame:
    """Arrays of equal length to (keys, dim, one column per array)."""
    zipped = df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias(dim, "_item"))
    return zipped.select(*keys, dim, *[F.col(f"_item.{a}").alias(a) for a in arrays])


def neighbourhood(
    entries: DataFrame,
    features: DataFrame,
    key: str,
    link: str,
    centre: str = "mean",
    vec: str = "vec",
    measured: tuple[int, int, bool] | None = None,
) -> DataFrame:
    """(key, n, pooled): concat(centre, var, min, max); centre is mean or sum."""
    if centre not in ("mean", "sum"):
        raise ValueError("centre must be 'mean' or 'sum'")
    stats = [centre, "var", "min", "max"]
    pooled = pool_blocks(entries, features, key, link, stats, vec, measured=measured)
    return pooled.select(key, "n", F.concat(*stats).alias("pooled"))


def neighbourhood_size_scaled(
    entries: DataFrame, features: DataFrame, key: str, link: str, vec: str = "vec"
) -> DataFrame:
    """concat(p, p / n) for the mean-centred pooling p."""
    pooled = neighbourhood(entries, features, key, link, "mean", vec)
    scaled = F.transform("pooled", lambda x: x / F.col("n"))
    return pooled.select(key, "n", F.concat("pooled", scaled).alias("pooled"))


def mean_vectors_clamped(
    entries: DataFrame, features: DataFrame, key: str, link: str, present: Column, vec: str = "vec"
) -> DataFrame:
    """(key, n, mean): sum over present members / max(present members, 1), an array per set.

    A set whose members are all absent gives zeros, not NaN.
    """
    marked = entries.select(
        key, link, F.when(present, 1.0).alias("_w"), F.coalesce(present, F.lit(False)).cast("double").alias("_present")
    )
    pooled = pool_blocks(marked, features, key, link, ["sum"], vec, weight="_w", sums=["_present"])
    n = F.col("sum__present").cast("long")
    mean = F.transform("sum", lambda s: F.coalesce(s, F.lit(0.0)) / F.greatest("sum__present", F.lit(1.0)))
    return pooled.select(key, n.alias("n"), mean.alias("mean"))


def mean_pool_clamped(
    entries: DataFrame, features: DataFrame, key: str, link: str, present: Column, vec: str = "vec"
) -> DataFrame:
    """(key, dim, n, mean) of ``mean_vectors_clamped``."""
    return unpack(mean_vectors_clamped(entries, features, key, link, present, vec), [key, "n"], ["mean"]).select(
        key, "dim", "n", "mean"
    )


def weighted_pool(
    entries: DataFrame,
    features: DataFrame,
    key: str,
    link: str,
    weight: str,
    carrier: str,
    carriers: list,
    vec: str = "vec",
) -> DataFrame:
    """(key, dominant, pooled): concat(sum(vec * weight), mean weight, one-hot of
    the most used carrier).  ``carriers`` is in id order; equal counts go to the
    lower id.  Carrier counts ride along as columns of the same aggregation."""
    counts = [f"_c{i}" for i in range(len(carriers))]
    marked = entries.select(
        key,
        link,
        weight,
        F.col(weight).isNotNull().cast("double").alias("_known"),
        *[(F.col(carrier) == F.lit(c)).cast("double").alias(n) for n, c in zip(counts, carriers)],
    )
    rows = pool_blocks(marked, features, key, link, ["sum"], vec, weight, [weight, "_known", *counts])
    tallies = F.array(*[F.col(f"sum_{n}") for n in counts])
    rows = rows.withColumn("_top", (F.array_position(tallies, F.array_max(tallies)) - 1).cast("int"))
    one_hot = F.array(*[(F.col("_top") == i).cast("double") for i in range(len(carriers))])
    mean = F.try_divide(F.col(f"sum_{weight}"), F.col("sum__known"))
    return rows.select(
        key,
        F.get(F.array(*[F.lit(c) for c in carriers]), F.col("_top")).alias("dominant"),
        F.concat("sum", F.array(mean), one_hot).alias("pooled"),
    )


def softmax_vectors(
    entries: DataFrame, features: DataFrame, key: str, link: str, score: str, vec: str = "vec"
) -> DataFrame:
    """(key, pooled): members weighted by softmax of ``score`` inside the set, an array per set.

    ``features`` carries the score of each member.  The set's maximum is
    aggregated and joined back; numerator and denominator are plain sums.
    """
    scored = entries.select(key, link).join(features.select(link, score), link)
    peak = scored.groupBy(key).agg(F.max(score).alias("_peak"))
    weighted = scored.join(peak, key).select(key, link, F.exp(F.col(score) - F.col("_peak")).alias("_w"))
    pooled = pool_blocks(weighted, features, key, link, ["sum"], vec, "_w", ["_w"], sketch=entries.select(key, link))
    return pooled.select(key, F.transform("sum", lambda s: s / F.col("sum__w")).alias("pooled"))


def softmax_pool(
    entries: DataFrame, features: DataFrame, key: str, link: str, score: str, vec: str = "vec"
) -> DataFrame:
    """(key, dim, pooled) of ``softmax_vectors``."""
    return unpack(softmax_vectors(entries, features, key, link, score, vec), [key], ["pooled"])


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_digest(vec: Column | str) -> Column:
    """Position-weighted sum: a scalar that changes when entries move."""
    weighted = F.transform(vec, lambda x, i: x * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x)
