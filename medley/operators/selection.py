"""Feature ranking and elimination."""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medley.functions.mixing import mix
from medley.functions.numeric import pearson_agg, safe_divide


def mutual_information(rows: DataFrame, vec: str, target: str, bins: int = 8) -> DataFrame:
    """(dim, mi) in nats between each binned feature dim and a discrete target.

    ``rows`` carries the feature vector and the target together, so the cells
    need no join by row.  Features are cut into equal-width bins per dim; only
    bin bounds and bin counts are shuffled.
    """
    cells = rows.select(F.col(target).alias("target"), F.posexplode(vec).alias("dim", "v"))
    bounds = cells.groupBy("dim").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.least(F.floor(safe_divide(F.col("v") - F.col("_lo"), width)), F.lit(bins - 1))
    binned = cells.join(bounds, "dim").select("dim", "target", F.coalesce(slot, F.lit(0)).alias("bin"))
    joint = binned.groupBy("dim", "bin", "target").agg(F.count(F.lit(1)).alias("n"))
    # at most bins x classes rows per dim from here on
    by_bin = joint.groupBy("dim", "bin").agg(F.sum("n").alias("nb"))
    by_target = joint.groupBy("dim", "target").agg(F.sum("n").alias("nt"))
    total = joint.groupBy("dim").agg(F.sum("n").alias("na"))
    both = joint.join(by_bin, ["dim", "bin"]).join(by_target, ["dim", "target"]).join(total, "dim")
    p = F.col("n") / F.col("na")
    term = p * F.log(F.col("n") * F.col("na") / (F.col("nb") * F.col("nt")))
    return both.groupBy("dim").agg(F.sum(term).alias("mi"))


def eliminate(
    rows: DataFrame, width: int, folds: int = 3, step: int = 10, keep: int = 20, trees: int = 5, depth: int = 3
) -> tuple[list[int], list[tuple[int, float]]]:
    """Recursive feature elimination with cross-validated MAE.

    ``rows(row_id, features vector, y)``.  Each round fits boosted trees per fold
    on the current dims, scores the held-out fold, then drops the ``step`` dims
    of lowest importance.  Returns the dims of the best round and all scores.
    Only importances and scores reach the driver.  A fit is kept until a dim that
    its trees use is dropped (see ``_used``).
    """
    data = rows.select("features", "y", (mix(0, "row_id") % folds).alias("_fold")).persist()
    try:
        return _eliminate(data, list(range(width)), folds, step, keep, trees, depth)
    finally:
        data.unpersist()


def _eliminate(
    data: DataFrame, current: list[int], folds: int, step: int, keep: int, trees: int, depth: int
) -> tuple[list[int], list[tuple[int, float]]]:
    history: list[tuple[int, float]] = []
    best: tuple[float, list[int]] | None = None
    model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, seed=1)
    found: dict[int | None, tuple[dict[int, float], float | None]] = {}  # fold, or None for all rows: (importances, error)
    while True:
        sliced = _sliced(data, current)
        for fold in range(folds):
            if fold not in found or not _used(found[fold][0]) <= set(current):
                fitted = model.fit(sliced.filter(F.col("_fold") != fold))
                held = fitted.transform(sliced.filter(F.col("_fold") == fold))
                error = held.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
                found[fold] = (_importances(fitted, current), error)
        mae = sum(found[fold][1] for fold in range(folds)) / folds
        history.append((len(current), mae))
        if best is None or mae <= best[0]:
            best = (mae, list(current))
        if len(current) <= keep:
            break
        if None not in found or not _used(found[None][0]) <= set(current):
            found[None] = (_importances(model.fit(sliced), current), None)
        current = _stronger(current, found[None][0], min(step, len(current) - keep))
    return best[1], history


def _sliced(data: DataFrame, dims: list[int]) -> DataFrame:
    return VectorSlicer(inputCol="features", outputCol="x", indices=dims).transform(data)


def _importances(model, dims: list[int]) -> dict[int, float]:
    return dict(zip(dims, model.featureImportances.toArray().tolist()))


def _used(importances: dict[int, float]) -> set[int]:
    """Dims that the trees split on.

    A tree takes the best split of all dims at each node, so without a dim that none takes the same fit
    comes out, tree for tree: bins are found per dim, and rows are drawn by their place alone.
    """
    return {d for d, weight in importances.items() if weight != 0}


def _stronger(dims: list[int], importances: dict[int, float], drop: int) -> list[int]:
    """Without the ``drop`` dims of least importance, equal ones from the lowest on."""
    weakest = set(sorted(dims, key=lambda d: (importances[d], dims.index(d)))[:drop])
    return [d for d in dims if d not in weakest]


def union_masks(masks: list[DataFrame]) -> DataFrame:
    """Dims selected for any target."""
    return reduce(DataFrame.unionByName, [m.select("dim") for m in masks]).distinct()


@dataclass(frozen=True)
class Level:
    """One level of a path: dims left, error on the fold, and the model with the dims that it was fitted on."""

    dims: list[int]
    error: float | None
    model: object
    fitted: list[int]
    importances: dict[int, float]


@dataclass(frozen=True)
class Selection:
    """What ``select_features`` found, as tables.

    ``history(target, cv, dims_left, mae)``: mean over the folds, a row per level;
    ``choices(target, cv, dims, mae, pearson, chosen)``: the best level of each cv setting with its
    score on the held part, and whether it is the target's choice; ``masks(target, dim)``: the dims
    of the choices.
    """

    history: DataFrame
    choices: DataFrame
    masks: DataFrame

    def union(self) -> DataFrame:
        """(dim, targets): dims that any target keeps, with the number of targets that do."""
        return self.masks.groupBy("dim").agg(F.count(F.lit(1)).alias("targets"))


def select_features(
    rows: DataFrame,
    targets: dict[int, str],
    width: int,
    cvs: tuple[int, ...] = (3, 5, 10),
    step: int = 10,
    keep: int = 1,
    trees: int = 5,
    depth: int = 3,
    share: float = 1.0,
    parallel: int = 8,
    seed: int = 42,
) -> Selection:
    """Recursive elimination for several targets and cross-validation settings, with a held-out choice.

    ``rows(row_id, features, one column per target)``.  A fifth of the rows, by a hash of the row id, is held out.
    On the rest every fold of every setting walks its own path: boosted trees on the dims left, mean absolute
    error on the fold, the ``step`` dims of least importance go (equal ones from the lowest dim on), until
    ``keep`` are left.  The number of dims with the least mean error wins, the smallest of equal ones, and a path
    over all training rows gives the dims.  Of the settings, the one whose model has the highest Pearson
    correlation on the held rows is chosen, the first of equal ones; one without a correlation is worse than any.
    Rows whose target is NULL take no part in it.

    All paths are independent, so they are run side by side, ``parallel`` at a time, whatever target and setting
    they belong to.  Importances and scores reach the driver: a number per dim or level of a path.  A path fits
    anew only when a dim that its trees use is dropped (see ``_used``); until then model and error stay the same.
    """
    if min(cvs) < 2 or step < 1 or not 1 <= keep <= width:
        raise ValueError("at least two folds, a step of one or more, and between one and all dims to keep")
    spark = rows.sparkSession
    fold_of = {cv: f"_fold{cv}" for cv in cvs}
    data = rows.select(
        "features",
        *dict.fromkeys(targets.values()),
        (mix(seed, "row_id") % 5 == 0).alias("_held"),
        *[(mix(seed + cv, "row_id") % cv).alias(name) for cv, name in fold_of.items()],
    ).persist()

    def sliced(target: int, dims: list[int]) -> DataFrame:
        known = data.withColumn("y", F.col(targets[target]).cast("double")).filter("y IS NOT NULL")
        return known.withColumnRenamed("features", "x") if len(dims) == width else _sliced(known, dims)

    if trees == 1 and share == 1.0:  # the first boosted tree is a plain one, which takes half the jobs
        estimator = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=depth, seed=1)
    else:
        estimator = GBTRegressor(
            featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, subsamplingRate=share, seed=1
        )
    fit = estimator.fit

    def walk(target: int, cv: int, fold: int | None) -> list[Level]:
        """The levels of one path, from all dims on."""
        dims, levels, made = list(range(width)), [], None
        while True:
            if made is None or not _used(made.importances) <= set(dims):
                train = sliced(target, dims).filter("NOT _held")
                model = fit(train if fold is None else train.filter(F.col(fold_of[cv]) != fold))
                error = None
                if fold is not None:
                    outside = model.transform(train.filter(F.col(fold_of[cv]) == fold))
                    error = outside.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
                made = Level(dims, error, model, dims, _importances(model, dims))
            levels.append(replace(made, dims=dims))
            if len(dims) <= keep:
                return levels
            dims = _stronger(dims, made.importances, min(step, len(dims) - keep))

    def held_pearson(target: int, level: Level) -> float | None:
        scored = level.model.transform(sliced(target, level.fitted).filter("_held"))
        return scored.agg(pearson_agg("y", "prediction")).first()[0]

    try:
        with ThreadPoolExecutor(parallel) as pool:
            folds = [(t, cv, fold) for t in targets for cv in cvs for fold in range(cv)]
            whole = [(t, 0, None) for t in targets]  # the path over all training rows is the same for every setting
            paths = dict(zip([*folds, *whole], pool.map(lambda p: walk(*p), [*folds, *whole])))
            errors: dict[tuple[int, int], dict[int, list[float]]] = defaultdict(lambda: defaultdict(list))
            for (target, cv, fold), levels in paths.items():
                if fold is not None:
                    for level in levels:
                        errors[target, cv][len(level.dims)] += [] if level.error is None else [level.error]
            history = [
                (target, cv, left, sum(e) / len(e) if e else None) for (target, cv), at in errors.items() for left, e in at.items()
            ]
            best = {}
            for target, cv in errors:
                scored = [(mae, left) for t, c, left, mae in history if (t, c) == (target, cv) and mae is not None]
                best[target, cv] = min(scored, default=(None, keep))
            picked = {
                (target, cv): next(level for level in paths[target, 0, None] if len(level.dims) == left) for (target, cv), (_, left) in best.items()
            }
            masks = {at: level.dims for at, level in picked.items()}
            models = {(target, tuple(level.dims)): level for (target, _), level in picked.items()}
            found = dict(zip(models, pool.map(lambda m: held_pearson(m[0][0], m[1]), models.items())))
    finally:
        data.unpersist()
    pearson = {(target, cv): found[target, tuple(dims)] for (target, cv), dims in masks.items()}
    choice = {t: max(cvs, key=lambda cv: -2.0 if pearson[t, cv] is None else pearson[t, cv]) for t in targets}
    choices = [
        (t, cv, len(masks[t, cv]), best[t, cv][0], pearson[t, cv], choice[t] == cv) for t in targets for cv in cvs
    ]
    return Selection(
        spark.createDataFrame(history, "target int, cv int, dims_left int, mae double"),
        spark.createDataFrame(choices, "target int, cv int, dims int, mae double, pearson double, chosen boolean"),
        spark.createDataFrame([(t, d) for t in targets for d in masks[t, choice[t]]], "target int, dim int"),
    )
