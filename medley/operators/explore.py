"""Exploration: singles against mixtures, coverage, co-occurrence, frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medley.functions.numeric import cosine_of, pearson_of, safe_divide
from medley.operators.hot import placed
from medley.operators.ordered import exact_quantiles
from medley.operators.pooling import cells_of, dot, pool_blocks, unpack
from medley.session import cut

TILE = 1024  # dims: a square of them takes 8 MB
ENTRY_BYTES = 128  # of an entry where entries are sorted or grouped

# --- distances to all other rows ---------------------------------------------


def mean_distance_to_others(rows: DataFrame, key: str, vec: str, kind: str) -> DataFrame:
    """(key, distance): mean over all other rows, without forming pairs.

    cosine / pearson: 1 - (u.S - 1) / (n - 1) with unit rows u and their sum S.
    squared: (n|x|^2 - 2 x.S + Q) / (n - 1) with Q the sum of squared norms.
    A row without a direction (zero for cosine, constant for pearson) gets NULL and is
    none of the others; so does a row without others.
    """
    if kind not in ("cosine", "pearson", "squared"):
        raise ValueError("kind must be cosine, pearson or squared")
    # per-row scalars are computed once, below the explode
    mean = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x) / F.size(vec)
    rows = rows.select(key, vec, (mean if kind == "pearson" else F.lit(0.0)).alias("_m"), dot(vec, vec).alias("_sq"))
    # a sum of squares is not below its rounding error: what is, comes from a constant vector
    spread = F.greatest(F.col("_sq") - F.size(vec) * F.col("_m") * F.col("_m"), F.lit(0.0))
    norm = F.when(spread > 1e-15 * F.col("_sq"), F.sqrt(spread))
    rows = rows.withColumn("_norm", F.lit(1.0) if kind == "squared" else norm)
    cells = rows.filter("_norm is not null").select("_m", "_norm", F.posexplode(vec).alias("dim", "v"))
    unit = (F.col("v") - F.col("_m")) / F.col("_norm")
    per_dim = cells.groupBy("dim").agg(
        F.sum(unit).alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n")
    )
    # one row per dim: the sorted list is as long as the vector
    packed = per_dim.agg(
        F.struct(
            F.sort_array(F.collect_list(F.struct("dim", "s"))).getField("s").alias("s"),
            F.sum("s").alias("total"),
            F.sum("q").alias("q"),
            F.max("n").alias("n"),
        ).alias("all")
    )
    scored = rows.withColumn("_all", packed.scalar())
    along = F.try_divide(dot(vec, "_all.s") - F.col("_m") * F.col("_all.total"), F.col("_norm"))
    others = F.col("_all.n") - 1
    if kind == "squared":
        value = F.try_divide(F.col("_all.n") * F.col("_sq") - 2 * along + F.col("_all.q"), others)
    else:
        value = 1 - F.try_divide(along - 1, others)
    return scored.select(key, value.alias("distance"))


# --- singles and mixtures ----------------------------------------------------


def with_size(entries: DataFrame, threshold: int | None = None) -> DataFrame:
    """Entries with ``size``, the number of entries of their stimulus; those without a stimulus are left out.

    Stimuli are counted where their entries lie, in tasks by the number of entries; the entries of an outsized
    stimulus (see ``hot``) stay where they are and get its count by broadcast.
    """
    ordinary, outsized = placed(entries.filter("stimulus IS NOT NULL"), "stimulus", ENTRY_BYTES, threshold)
    sized = ordinary.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("stimulus")))
    if outsized is None:
        return sized
    sizes = outsized.groupBy("stimulus").agg(F.count(F.lit(1)).alias("size"))
    return sized.unionByName(outsized.join(F.broadcast(sizes), "stimulus").select(*sized.columns))


def singles(entries: DataFrame, threshold: int | None = None) -> DataFrame:
    """Entries of one-component stimuli; one aggregation, no join back.

    ``max`` of the columns of a one-row group is that row.  Tasks are as many as the entries need.
    """
    rest = [c for c in entries.columns if c != "stimulus"]
    ordinary, outsized = placed(entries, "stimulus", ENTRY_BYTES, threshold)

    def only(part: DataFrame) -> DataFrame:
        counted = part.groupBy("stimulus").agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in rest])
        return counted.filter("_n = 1").drop("_n").select(*entries.columns)

    # a key is outsized by an estimate, so it may have one row after all
    return only(ordinary) if outsized is None else only(ordinary).unionByName(only(outsized))


def single_mean_vectors(entries: DataFrame, ratings: DataFrame, dims: int) -> DataFrame:
    """(cid, n, mean): mean rating vector over the rated singles of a component, zeros if none."""
    rated = singles(entries.select("stimulus", "cid")).join(ratings.select("stimulus", "rating"), "stimulus", "left")
    sums = rated.groupBy("cid").agg(
        F.count("rating").alias("n"), *[F.sum(F.col("rating")[d]).alias(f"_{d}") for d in range(dims)]
    )
    mean = F.array(*[F.coalesce(safe_divide(F.col(f"_{d}"), F.col("n")), F.lit(0.0)) for d in range(dims)])
    return sums.select("cid", "n", mean.alias("mean"))


def single_means(entries: DataFrame, ratings: DataFrame, dims: int) -> DataFrame:
    """(cid, dim, n, mean) in long form."""
    return unpack(single_mean_vectors(entries, ratings, dims), ["cid", "n"], ["mean"])


def expected_ratings(entries: DataFrame, ratings: DataFrame, dims: int) -> DataFrame:
    """(stimulus, dim, known, expected) for mixtures: mean over its known components."""
    return cells_of(expected_vectors(entries, ratings, dims), "stimulus", ["expected"], "known")


def expected_vectors(entries: DataFrame, ratings: DataFrame, dims: int) -> DataFrame:
    """(stimulus, n, size, expected): the same with an array per mixture."""
    known = cut(single_mean_vectors(entries, ratings, dims))
    mixed = with_size(entries.select("stimulus", "cid")).filter("size > 1").select("stimulus", "cid")
    return expected_of(mixed, known, entries.select("stimulus", "cid"))


def expected_of(mixed: DataFrame, known: DataFrame, sketch: DataFrame | None = None, measured: tuple[int, int, bool] | None = None) -> DataFrame:
    """(stimulus, n, size, expected) of the mixtures ``mixed(stimulus, cid)`` from ``known(cid, mean)``; see ``pool_blocks``."""
    pooled = pool_blocks(mixed, known, "stimulus", "cid", ["mean"], "mean", sketch=sketch, measured=measured)
    return pooled.withColumnRenamed("mean", "expected")


def component_history(entries: DataFrame, ratings: DataFrame) -> DataFrame:
    """(cid, dilution, rating_row, n_obs): the rated observations of every single component.

    Equal observations are collapsed to a count.  The history is kept once per
    component; a mixture refers to it by ``cid``.
    """
    observed = singles(entries.select("stimulus", "cid", "dilution")).join(
        ratings.select("stimulus", "rating_row"), "stimulus"
    )
    return observed.groupBy("cid", "dilution", "rating_row").agg(F.count(F.lit(1)).alias("n_obs"))


def mixture_history(entries: DataFrame, ratings: DataFrame) -> DataFrame:
    """(stimulus, cid, n_entries, observations, distinct, low, high): a mixture's
    components with the extent of their histories.

    Copying a component's list into every mixture that uses it would emit
    mixtures x observations rows; the link and the summary say the same, and
    ``component_history`` holds the lists.
    """
    extent = component_history(entries, ratings).groupBy("cid").agg(
        F.sum("n_obs").alias("observations"),
        F.count(F.lit(1)).alias("distinct"),
        F.min("dilution").alias("low"),
        F.max("dilution").alias("high"),
    )
    mixed = with_size(entries.select("stimulus", "cid")).filter("size > 1")
    links = mixed.groupBy("stimulus", "cid").agg(F.count(F.lit(1)).alias("n_entries"))
    return links.join(extent, "cid").select("stimulus", "cid", "n_entries", "observations", "distinct", "low", "high")


def component_observations(entries: DataFrame, ratings: DataFrame) -> DataFrame:
    """(cid, dilution, rating, n_obs): the history with its rating vectors."""
    found = component_history(entries, ratings)
    vectors = ratings.groupBy("rating_row").agg(F.first("rating").alias("rating"))
    return found.join(vectors, "rating_row").select("cid", "dilution", "rating_row", "rating", "n_obs")


def mixture_observations(entries: DataFrame, ratings: DataFrame) -> DataFrame:
    """(stimulus, cid, dilution, rating, n_obs): for every mixture the observations of its
    components, one row each, so a mixture's list may be of any length.

    This copies a component's history into each mixture that uses it; where the link is
    enough, ``mixture_history`` and ``component_observations`` say the same in less.
    """
    mixed = with_size(entries.select("stimulus", "cid")).filter("size > 1").select("stimulus", "cid").distinct()
    return mixed.join(component_observations(entries, ratings), "cid").select(
        "stimulus", "cid", "dilution", "rating_row", "rating", "n_obs"
    )


def measured_against_components(entries: DataFrame, ratings: DataFrame, dims: int) -> DataFrame:
    """(stimulus, dim, y, y_hat) for rated mixtures whose components all have rated singles."""
    return unpack(measured_vectors(entries, ratings, dims), ["stimulus"], ["y", "y_hat"])


def measured_vectors(entries: DataFrame, ratings: DataFrame, dims: int) -> DataFrame:
    """(stimulus, y, y_hat): the same with an array per mixture."""
    known = cut(single_mean_vectors(entries, ratings, dims).filter("n > 0"))
    rated = entries.select("stimulus", "cid").join(ratings.select("stimulus"), "stimulus", "left_semi")
    mixed = with_size(rated).filter("size > 1")
    # drop mixtures with an unknown component while rows are narrow
    hits = mixed.join(known.select("cid"), "cid").groupBy("stimulus").agg(
        F.count(F.lit(1)).alias("_known"), F.max("size").alias("_size")
    )
    complete = mixed.join(hits.filter("_known = _size").select("stimulus"), "stimulus", "left_semi")
    pooled = pool_blocks(
        complete.select("stimulus", "cid"), known, "stimulus", "cid", ["mean"], "mean", sketch=entries.select("stimulus", "cid")
    )
    truth = ratings.select("stimulus", F.col("rating").alias("y"))
    return pooled.join(truth, "stimulus").select("stimulus", "y", F.col("mean").alias("y_hat"))


def additivity_test(entries: DataFrame, ratings: DataFrame, dims: int) -> DataFrame:
    """(n, cosine_distance, pearson): measured mixtures against the mean of their components."""
    rows = measured_vectors(entries, ratings, dims)
    scores = rows.select(cosine_of("y", "y_hat").alias("c"), pearson_of("y", "y_hat").alias("r"))
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.avg(1 - F.col("c")).alias("cosine_distance"), F.avg("r").alias("pearson")
    )


# --- matrices over dimensions ------------------------------------------------


def gram(rows: DataFrame, vec: str, dims: int, tile: int | None = None) -> DataFrame:
    """(a, b, s): sum over rows of v[a] * v[b].

    Each partition multiplies its batches with numpy and emits one dims x dims
    block; Spark adds the blocks.  No pair of cells is ever a row.  From more than
    ``TILE`` dims on, or with a ``tile`` given, no task holds a whole square: see ``_tiled_gram``.
    """
    if tile is not None or dims > TILE:
        return _tiled_gram(rows, vec, dims, tile or TILE)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((dims, dims)), False
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vec].to_numpy()).astype(float)
                total += x.T @ x
                seen = True
        if seen:
            a, b = np.indices((dims, dims))
            yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "s": total.ravel()})

    parts = rows.select(vec).mapInPandas(blocks, "a int, b int, s double")
    return parts.groupBy("a", "b").agg(F.sum("s").alias("s"))


def _tiled_gram(rows: DataFrame, vec: str, dims: int, tile: int) -> DataFrame:
    """The same in tiles of ``tile`` x ``tile``: a row sends a pair of slices to each pair of tiles (one of the
    two triangles), spread over several tasks by the partition it comes from, and a task adds up a tile at a time."""
    starts = range(0, dims, tile)
    pairs = [(i, j) for i in starts for j in starts if i <= j]
    spread = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(pairs))
    piece = lambda at: F.slice(vec, at + 1, tile)
    sent = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), piece(i).alias("x"), piece(j).alias("y")) for i, j in pairs])
    )
    pieces = rows.select(sent.alias("_p"), (F.spark_partition_id() % spread).alias("_task")).select("_p.*", "_task")
    placed = pieces.repartition("i", "j", "_task").sortWithinPartitions("i", "j")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None

        def cells() -> pd.DataFrame:
            a, b = np.indices(total.shape)
            out = pd.DataFrame({"a": a.ravel() + at[0], "b": b.ravel() + at[1], "s": total.ravel()})
            return out if at[0] == at[1] else pd.concat([out, out.rename(columns={"a": "b", "b": "a"})])

        for batch in batches:
            for pair, own in batch.groupby(["i", "j"], sort=True):
                x, y = (np.stack(own[c].to_numpy()).astype(float) for c in "xy")
                if pair != at:
                    if at is not None:
                        yield cells()[["a", "b", "s"]]
                    at, total = pair, np.zeros((x.shape[1], y.shape[1]))
                total += x.T @ y
        if at is not None:
            yield cells()[["a", "b", "s"]]

    parts = placed.select("i", "j", "x", "y").mapInPandas(blocks, "a int, b int, s double")
    return parts.groupBy("a", "b").agg(F.sum("s").alias("s"))


def co_occurrence(rows: DataFrame, key: str, vec: str, dims: int, quantile: float, tile: int | None = None) -> DataFrame:
    """(a, b, n): rows where both dims reach their own quantile."""
    cells = rows.select(key, F.posexplode(vec).alias("dim", "v"))
    cuts = exact_quantiles(cells, ["dim"], "v", [quantile])
    # one row per dim: the threshold list is as long as the vector
    packed = cuts.agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).getField("v").alias("t"))
    marked = rows.withColumn("_t", packed.scalar()).select(
        F.zip_with(vec, "_t", lambda x, t: (x >= t).cast("double")).alias("_hit")
    )
    return gram(marked, "_hit", dims, tile).select("a", "b", F.round("s").cast("long").alias("n"))


def correlation_matrix(rows: DataFrame, vec: str, dims: int, tile: int | None = None) -> DataFrame:
    """(a, b, r): Pearson between dims; NULL for constant dims.

    The columns are centred on their means first, then one gram pass.
    """
    cells = rows.select(F.posexplode(vec).alias("dim", "v"))
    means = cells.groupBy("dim").agg(F.avg("v").alias("m"))
    packed = means.agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).getField("m").alias("m"))
    centred = rows.withColumn("_m", packed.scalar()).select(
        F.zip_with(vec, "_m", lambda x, m: x - m).alias("_c")
    )
    products = gram(centred, "_c", dims, tile)
    variance = products.filter("a = b")
    left = variance.select("a", F.col("s").alias("va"))
    right = variance.select("b", F.col("s").alias("vb"))
    r = safe_divide(F.col("s"), F.sqrt(F.col("va") * F.col("vb")))
    return products.join(left, "a").join(right, "b").select("a", "b", r.alias("r"))


# --- frequencies, sets, histograms -------------------------------------------


def frequency(df: DataFrame, key: str) -> DataFrame:
    """(key, n), most common first, ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key))


def five_number_summary(df: DataFrame, key: str) -> DataFrame:
    """Quantiles 0, .25, .5, .75, 1 of the key frequencies: (q, n)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n_rows"))
    return exact_quantiles(counts, [], "n_rows", [0.0, 0.25, 0.5, 0.75, 1.0]).withColumnRenamed("n_rows", "n")


def membership_regions(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """(in_<name>..., n): keys per combination of set memberships."""
    names = list(sets)
    tagged = None
    for name, frame in sets.items():
        part = frame.select(key, *[F.lit(name == other).alias(f"in_{other}") for other in names])
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = tagged.groupBy(key).agg(*[F.max(f"in_{n}").alias(f"in_{n}") for n in names])
    return flags.groupBy(*[f"in_{n}" for n in names]).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n) with ``bins`` equal bins, the last one closed; bounds default to min and max."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo = F.lit(low) if low is not None else bounds.select("lo").scalar()
    hi = F.lit(high) if high is not None else bounds.select("hi").scalar()
    placed = df.select(F.col(value).alias("_x")).withColumns({"_lo": lo, "_hi": hi})
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.floor(F.try_divide(F.col("_x") - F.col("_lo"), width)) + 1
    bin_no = F.least(F.coalesce(slot, F.lit(1)), F.lit(bins)).cast("int")
    inside = placed.filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
    return inside.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage(entries: DataFrame, known: DataFrame, key: str, link: list[str]) -> DataFrame:
    """Per set: members found in ``known``, percent covered, complete and any flags."""
    marks = known.select(*link).distinct().withColumn("_hit", F.lit(1))
    hits = entries.join(marks, link, "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    return hits.groupBy(key).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("_hit").alias("found"),
        (F.avg("_hit") * 100).alias("percent"),
        (F.min("_hit") == 1).alias("complete"),
        (F.max("_hit") == 1).alias("seen"),
    )


def class_balance(cells: DataFrame, mask: Column, at_least: int = 5) -> DataFrame:
    """(dim, pos, neg, weight = neg / pos) for dims with enough positives."""
    counts = cells.groupBy("dim").agg(
        F.sum(mask.cast("long")).alias("pos"), F.sum((~mask).cast("long")).alias("neg")
    )
    enough = counts.filter(F.col("pos") >= at_least)
    return enough.withColumn("weight", safe_divide(F.col("neg"), F.col("pos")))
