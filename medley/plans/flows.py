"""Composed flows: raw definitions to tidy tables, dataset to fold scores, mixtures to models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.functions import lists as A
from medley.operators import explore as X
from medley.operators import joins as J
from medley.operators import metrics as M
from medley.operators import models as ML
from medley.operators import pooling as P
from medley.operators import selection as SEL
from medley.operators import tidy as T
from medley.operators.ordered import exact_quantiles
from medley.session import cut, scratch_path

PART_BYTES = 4 * 1024**3  # of mixture rows that are made at a time

# Elements whose symbols disqualify a compound text.
UNWANTED_ELEMENTS = [
    "Na", "K", "Ca", "Mg", "Cr", "B", "Si", "Ti", "Fe", "Al", "Co", "Zn", "Cu", "V", "Bi", "He",
    "As", "I", "Sb", "Pb", "Ni", "Os", "Se", "Hg", "Ar", "Cd", "Kr", "Rn", "Se", "Ta", "U", "Xe",
    "Cd", "Mo", "Sn", "Tl", "Te", "Y", "Be",
]
# Stimuli whose component has no structure.
EXCLUDED_STIMULI = ["AN759", "AN873", "AN874"]


def tidy_labels(
    raw: DataFrame, key: str, flags: list[str], ratings: list[str], overall: list[str], excluded: list
) -> DataFrame:
    """Stacked task labels to one row per distinct rating: merge, scale, exclude, build vectors.

    Ratings are divided by 5, overall attributes by 10; vectors list the overall
    attributes first (dims 0 and 1).
    """
    merged = T.merge_duplicates(raw, key, [*overall, *ratings], flags)
    scaled = merged.withColumns(
        {**{r: F.col(r) / 5 for r in ratings}, **{o: F.col(o) / 10 for o in overall}}
    )
    kept = scaled.filter(~F.col(key).isin(excluded)) if excluded else scaled
    return kept.select(
        key,
        *flags,
        F.array(*ratings).alias("rata"),
        F.array(*overall).alias("overall"),
        F.array(*overall, *ratings).alias("all_ratings"),
    )


def tidy_inputs(
    singles: DataFrame,
    definitions: DataFrame,
    components: DataFrame,
    known: DataFrame,
    compounds: DataFrame,
    excluded: list,
) -> DataFrame:
    """Single and mixture definitions to the long component table.

    ``singles(stimulus, cid, dilution, solvent)``, ``definitions(stimulus,
    components)``, ``components(component, cid, dilution, solvent)``,
    ``compounds(cid, compound_id)``.  Solvent ids are coded by frequency before
    the exclusion, as excluded rows count too.
    """
    fields = ["cid", "dilution", "solvent"]
    mixed = J.expand_definition(definitions, "stimulus", "components", components, fields, fields)
    single = singles.select(
        "stimulus",
        F.lit(0).alias("pos"),
        T.empty_column("component", "bigint"),
        "cid",
        "dilution",
        F.lower("solvent").alias("solvent"),
    )
    # read twice by the next step (rows with and without detail): written once
    stacked = cut(J.present_in(T.trim_strings(single.unionByName(mixed)), known, ["stimulus"]))
    wanted = T.drop_shadowed(stacked, ["stimulus", "cid", "dilution", "solvent", "pos"], "component")
    # read twice below (solvent counts, per-component bounds): written once
    wanted = cut(wanted)
    codes = T.ids_by_frequency(wanted, "solvent", "solvent_id").select("solvent", "solvent_id")
    coded = wanted.join(codes, "solvent")
    kept = coded.filter(~F.col("stimulus").isin(excluded)) if excluded else coded
    linked = J.lookup(kept, "cid", compounds, "compound_id", "compound_id", pass_through=False)
    return T.min_max_position(linked, "cid", "dilution", "weakness")


def regrouped_inputs(tidy: DataFrame) -> DataFrame:
    """The long component table as one row of lists per stimulus: cids, compound_ids, components
    and dilution_info, the list of the dilutions, solvent ids and weaknesses.

    ``components`` is NULL for a stimulus of one entry without a component.
    """
    fields = ["cid", "compound_id", "component", "dilution", "solvent_id", "weakness"]
    rows = T.regroup(tidy, "stimulus", ["pos"], fields)
    info = F.array("dilution", F.col("solvent_id").cast("array<double>"), "weakness")
    return rows.select(
        "stimulus",
        F.col("cid").alias("cids"),
        F.col("compound_id").alias("compound_ids"),
        A.null_if_all_null_single("component").alias("components"),
        info.alias("dilution_info"),
    )


def fold_scores(pred: DataFrame, split: DataFrame) -> DataFrame:
    """(fold, mae, rmse, row_pearson, cosine) on the test rows of every fold."""
    tests = split.filter("part = 'test'").select("fold", "row_id")
    cells = pred.join(tests, "row_id")
    errors = M.errors(cells, "fold").select("fold", "mae", "rmse")
    y, p = F.col("y"), F.col("y_hat")
    rows = cells.groupBy("fold", "row_id").agg(
        M.pearson_agg("y", "y_hat").alias("r"), M.cosine_agg("y", "y_hat").alias("c")
    )
    shape = rows.groupBy("fold").agg(F.avg("r").alias("row_pearson"), F.avg("c").alias("cosine"))
    return errors.join(shape, "fold")


def compare_over_folds(pred: DataFrame) -> DataFrame:
    """(model, part, folds, and mean and sample deviation over folds of mae, pearson and cosine) of predictions by
    several models: ``pred(model, fold, part, row_id, dim, y, y_hat)``.

    Pearson and cosine are means over rows inside a fold, undefined ones left out.  A model with one fold has no deviation.
    """
    by_row = pred.groupBy("model", "fold", "part", "row_id").agg(
        M.pearson_agg("y", "y_hat").alias("r"), M.cosine_agg("y", "y_hat").alias("c"),
        F.sum(F.abs(F.col("y") - F.col("y_hat"))).alias("e"), F.count("y").alias("n"),
    )
    by_fold = by_row.groupBy("model", "fold", "part").agg(
        F.try_divide(F.sum("e"), F.sum("n")).alias("mae"), F.avg("r").alias("pearson"), F.avg("c").alias("cosine")
    )
    spread = [f(m).alias(f"{m}_{name}") for m in ("mae", "pearson", "cosine") for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return by_fold.groupBy("model", "part").agg(F.count(F.lit(1)).alias("folds"), *spread)


def mixture_model(
    entries: DataFrame,
    features: DataFrame,
    ratings: DataFrame,
    width: int,
    targets: list[int],
    trees: int = 3,
    depth: int = 3,
) -> DataFrame:
    """Pool component vectors of rated mixtures, append the expected rating, fit a gate and a
    regressor per target dim, and score the hybrid: (dim, n, mask_accuracy, mae)."""
    columns = {d: f"y{d}" for d in targets}
    rows = mixture_rows(entries, features, ratings, width, targets)
    cells = rows.select(
        "stimulus",
        F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).alias("y")) for d, c in columns.items()])).alias("_c"),
    ).select("stimulus", "_c.dim", "_c.y")
    # one threshold per target dim reaches the driver
    cuts = {r["dim"]: r["y"] for r in exact_quantiles(cells, ["dim"], "y", [0.5]).collect()}
    gates = ML.fit_gates(rows, columns, cuts, trees, depth)
    values = ML.fit_above(rows, {d: c for d, c in columns.items() if d in gates}, cuts, trees, depth)
    guess = ML.hybrid(ML.score(rows, gates, "stimulus", "gate"), ML.score(rows, values, "stimulus"), "stimulus")
    limits = F.create_map(*[F.lit(x) for d in cuts for x in (d, cuts[d])])
    both = cells.join(guess, ["stimulus", "dim"]).withColumn("t", limits[F.col("dim")])
    return both.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(((F.col("y") > F.col("t")) == (F.col("y_hat") > 0)).cast("int")).alias("mask_accuracy"),
        F.avg(F.abs(F.col("y") - F.col("y_hat"))).alias("mae"),
    )


def mixture_rows(
    entries: DataFrame, features: DataFrame, ratings: DataFrame, width: int, targets: list[int], held: Column | None = None
) -> DataFrame:
    """(stimulus, y<dim>..., features) of rated mixtures: pooled component vectors and the expected rating.

    The rows are a written table, with a column ``_held`` if that is given.  Where they are many, they are made a
    part of the stimuli after the other, so that no more than a part is ever shuffled, and mixtures alone are pooled.
    """
    measured = P.vector_bytes(features, "vec")
    parts = max(1, -(-ratings.count() * (4 * measured[1] + 8 * width) // PART_BYTES))
    if parts == 1:
        rated = J.present_in(entries, ratings, ["stimulus"])
        pooled = P.neighbourhood(rated, features, "stimulus", "vec_id", measured=measured)
        return cut(_rows_of(pooled, X.expected_vectors(entries, ratings, width), ratings, targets, held))
    rated = cut(J.present_in(entries.select("stimulus", "cid", "vec_id"), ratings, ["stimulus"]))
    mixed = cut(X.with_size(rated).filter("size > 1").select("stimulus", "cid", "vec_id"))
    known = cut(X.single_mean_vectors(entries, ratings, width))
    measured_known = P.vector_bytes(known, "mean")
    path = scratch_path(entries.sparkSession, "cut")
    for i in range(parts):
        mine = F.pmod(F.xxhash64("stimulus"), F.lit(parts)) == i  # not the hash that places rows in tasks
        own = mixed.filter(mine)
        pooled = P.neighbourhood(own, features, "stimulus", "vec_id", measured=measured)
        expected = X.expected_of(own.select("stimulus", "cid"), known, measured=measured_known)
        rows = cut(_rows_of(pooled, expected, ratings.filter(mine), targets, held), path, mode="append", compression="zstd")
    return rows


def _rows_of(pooled: DataFrame, expected: DataFrame, ratings: DataFrame, targets: list[int], held: Column | None) -> DataFrame:
    vectors = pooled.select("stimulus", "pooled").join(expected.select("stimulus", "expected"), "stimulus")
    wide = vectors.join(ratings.select("stimulus", "rating"), "stimulus").select(
        "stimulus", F.concat("pooled", "expected").alias("x"), *[F.col("rating")[d].alias(f"y{d}") for d in targets]
    )
    rows = ML.assemble(wide, "x").drop("x")
    return rows if held is None else rows.withColumn("_held", F.coalesce(held, F.lit(False)))


def nested_model(
    rows: DataFrame,
    key: str,
    targets: dict[int, str],
    held: Column | None,
    trees: int = 3,
    depth: int = 3,
    share: float = 0.8,
    quantile: float = 0.5,
    keep: int | None = None,
    step: int = 10,
    folds: int = 3,
) -> DataFrame:
    """(part, n, mask_accuracy, mae, r2, cosine, pearson) of the two-stage model on the rows it was fitted on and on held ones.

    ``rows(key, features, one column per target)``; ``held`` is true for rows that nothing is fitted on (None: ``rows``
    are a written table that says so in ``_held``).  On the
    others: a threshold per target (their quantile), a gate for values above it, and a regressor of those values;
    a target with fewer than five values above, or none below, is predicted as 0.  With ``keep``, dims are first
    eliminated down to at least that many for every target with ten values above, and the union of what is kept
    is used.  ``mask_accuracy`` and ``mae`` are over all cells, ``r2`` and ``pearson`` are means over targets
    (without undefined ones), ``cosine`` is the mean over all pairs of a true and a predicted row.
    """
    parted = rows if held is None else cut(rows.withColumn("_held", F.coalesce(held, F.lit(False))))
    train = parted.filter("NOT _held")
    cell = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).cast("double").alias("y")) for d, c in targets.items()]))
    cells = parted.select(F.col(key).alias("row_id"), "_held", cell.alias("_c")).select("row_id", "_held", "_c.dim", "_c.y")
    # a threshold and a count per target reach the driver
    limits = {r.dim: r.y for r in exact_quantiles(cells.filter("NOT _held"), ["dim"], "y", [quantile]).collect()}
    columns = {d: c for d, c in targets.items() if d in limits}
    above = {d: train.filter(F.col(c) > limits[d]).select(key, "features", F.col(c).alias("y")) for d, c in columns.items()}
    if keep is not None and columns:
        width = len(train.first()["features"])
        counts = train.agg(*[F.count(F.when(F.col(c) > limits[d], 1)).alias(f"n{d}") for d, c in columns.items()]).first()
        chosen: set[int] = set()
        for d in columns:
            if counts[f"n{d}"] >= 10:
                renamed = above[d].withColumnRenamed(key, "row_id")
                chosen |= set(SEL.eliminate(renamed, width, folds, step, min(keep, width), trees, depth)[0])
        if chosen:
            slicer = VectorSlicer(inputCol="features", outputCol="_kept", indices=sorted(chosen))
            narrow = lambda df: slicer.transform(df).drop("features").withColumnRenamed("_kept", "features")
            parted, train = narrow(parted), narrow(train)
    gates = ML.fit_gates(train, columns, limits, trees, depth)
    values = ML.fit_above(train, {d: columns[d] for d in gates}, limits, trees, depth, share)
    guess = ML.hybrid(ML.score(parted, gates, key, "gate"), ML.score(parted, values, key), key)
    gate = ML.score(parted, gates, key, "gate").select(F.col(key).alias("row_id"), "dim", "gate")
    scored = cells.join(guess.select(F.col(key).alias("row_id"), "dim", "y_hat"), ["row_id", "dim"], "left").join(
        gate, ["row_id", "dim"], "left"
    )
    at = F.create_map(*[F.lit(x) for d, limit in limits.items() for x in (d, limit)]) if limits else F.lit(None)
    pred = cut(
        scored.select(
            "row_id", "dim", "_held", "y", F.coalesce("y_hat", F.lit(0.0)).alias("y_hat"),
            F.coalesce(F.col("gate") > 0.5, F.lit(False)).alias("_on"), (F.col("y") > at[F.col("dim")]).alias("_above"),
        )
    )
    return reduce(DataFrame.unionByName, [_part_scores(pred, part, flag) for part, flag in (("train", False), ("held", True))])


def _part_scores(pred: DataFrame, part: str, held: bool) -> DataFrame:
    own = pred.filter(F.col("_held") == held)
    flat = own.agg(
        F.countDistinct("row_id").alias("n"),
        F.avg((F.col("_above") == F.col("_on")).cast("int")).alias("mask_accuracy"),
        F.avg(F.abs(F.col("y") - F.col("y_hat"))).alias("mae"),
    )
    mean = lambda scores, name: scores.agg(F.avg(name)).scalar()
    return flat.withColumns(
        {
            "part": F.lit(part),
            "r2": mean(M.column_r2(own), "r2"),
            "cosine": M.all_pairs_mean_cosine(own).scalar(),
            "pearson": mean(M.column_pearson(own), "pearson"),
        }
    ).select("part", "n", "mask_accuracy", "mae", "r2", "cosine", "pearson")
