"""One Spark ML model per rating dimension, and label-level structure."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.functions.mixing import mix
from medley.functions.numeric import cosine_agg, pearson_agg
from medley.operators.metrics import r2_agg
from medley.operators.scoring import gated
from medley.session import cut

MAX_DEPTH = 30  # Spark's limit
PARALLEL = 4  # models fitted at a time, so that small jobs share the cluster
BINNED_BYTES = 8 * 1024**3  # of rows that boosted trees keep in memory or on the executors' disks while models are fitted


def assemble(rows: DataFrame, vec: str) -> DataFrame:
    """Array column to the ML vector column ``features``."""
    return rows.withColumn("features", array_to_vector(vec))


def _checked(depth: int) -> int:
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"trees may be {MAX_DEPTH} levels deep, not {depth}")
    return depth


def _for_each(targets: list, fit: Callable, parallel: int = PARALLEL) -> dict:
    """target -> fit(target), a few at a time; what has no model is left out."""
    with ThreadPoolExecutor(parallel) as pool:
        return {t: model for t, model in zip(targets, pool.map(fit, targets)) if model is not None}


def at_a_time(train: DataFrame) -> int:
    """Models to fit side by side: each keeps its rows while it is fitted, 4 bytes a feature."""
    first = train.select("features").filter("features IS NOT NULL").first()
    kept = 0 if first is None else train.count() * (4 * first["features"].size + 48)
    return max(1, min(PARALLEL, BINNED_BYTES // max(1, kept)))


def regressor(trees: int, depth: int, rate: float = 0.1, share: float = 0.8) -> GBTRegressor:
    """Boosted trees, each on a ``share`` of the rows."""
    return GBTRegressor(
        labelCol="y", maxIter=trees, maxDepth=_checked(depth), stepSize=rate, subsamplingRate=share, seed=1
    )


def fit_regressors(train: DataFrame, targets: dict[int, str], trees: int = 20, depth: int = 5, share: float = 0.8) -> dict:
    """dim -> fitted boosted trees; ``train`` should be persisted by the caller."""

    def fit(dim: int):
        rows = train.select("features", F.col(targets[dim]).alias("y")).filter("y IS NOT NULL")
        return regressor(trees, depth, share=share).fit(rows)

    return _for_each(list(targets), fit)


def fit_linear(train: DataFrame, targets: dict[int, str], logistic: bool = False) -> dict:
    """dim -> linear or logistic head."""

    def fit(dim: int):
        head = LogisticRegression(labelCol="y") if logistic else LinearRegression(labelCol="y")
        return head.fit(train.select("features", F.col(targets[dim]).cast("double").alias("y")))

    return _for_each(list(targets), fit)


def fit_gates(
    train: DataFrame, targets: dict[int, str], thresholds: dict[int, float], trees: int = 20, depth: int = 5, at_least: int = 5
) -> dict:
    """dim -> classifier of y > threshold with positives weighted by neg / pos.

    Dims with fewer than ``at_least`` positives, or without negatives, get none.
    The class counts of all dims come from one pass.
    """
    counts = train.agg(
        *[F.sum((F.col(c) > thresholds[d]).cast("long")).alias(f"p{d}") for d, c in targets.items()],
        F.count(F.lit(1)).alias("n"),
    ).first()
    _checked(depth)

    def fit(dim: int):
        pos = counts[f"p{dim}"] or 0
        neg = counts["n"] - pos
        if pos < at_least or neg == 0:
            return None
        on = F.col(targets[dim]) > thresholds[dim]
        rows = train.select(
            "features", on.cast("double").alias("y"), F.when(on, neg / pos).otherwise(1.0).alias("weight")
        )
        return GBTClassifier(labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, seed=1).fit(rows)

    return _for_each(list(targets), fit, at_a_time(train))


def fit_above(train: DataFrame, targets: dict[int, str], limits: dict[int, float], trees: int, depth: int, share: float = 0.8) -> dict:
    """dim -> boosted trees fitted on the rows whose target is above its limit."""

    def fit(dim: int):
        y = F.col(targets[dim])
        return regressor(trees, depth, share=share).fit(train.filter(y > limits[dim]).select("features", y.alias("y")))

    return _for_each(list(targets), fit, at_a_time(train))


def score(rows: DataFrame, models: dict, key: str, out: str = "y_hat") -> DataFrame:
    """(key, dim, out) with every model's prediction: one pass over the rows, a column per model."""
    scored = reduce(_score_beside, models.items(), rows.select(key, "features"))
    cells = [F.struct(F.lit(dim).alias("dim"), F.col(f"_p{dim}").alias(out)) for dim in models]
    if not cells:
        return rows.select(key, F.lit(None).cast("int").alias("dim"), F.lit(None).cast("double").alias(out)).limit(0)
    return scored.select(key, F.inline(F.array(*cells)))


def _score_beside(rows: DataFrame, one: tuple) -> DataFrame:
    dim, model = one
    named = model.copy().setPredictionCol(f"_p{dim}")
    scored = named.transform(rows)
    return scored.select(*rows.columns, f"_p{dim}")


def hybrid(gates: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, dim, y_hat): the regressor's value where the gate is on, else 0; no gate means off."""
    joined = values.join(gates.select(key, "dim", "gate"), [key, "dim"], "left")
    on = F.coalesce(F.col("gate") > 0.5, F.lit(False))
    return joined.select(key, "dim", gated(on, F.col("y_hat")).alias("y_hat"))


def sweep(
    train: DataFrame, row: str, depths: list[int], rates: list[float], trees: int = 5, share: float = 0.8, seed: int = 1
) -> DataFrame:
    """(depth, rate, rmse): one validation score per configuration of ``train(row, features, y)``.

    A fifth of the rows, chosen by a hash of the row id, validates all configurations.
    """
    held = mix(seed, row) % 5 == 0
    fitted, valid = train.filter(~held), train.filter(held)

    def score_one(config: tuple[int, float]) -> float:
        model = regressor(trees, config[0], config[1], share).fit(fitted)
        return model.transform(valid).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]

    found = _for_each(list(product(depths, rates)), score_one)
    rows = [(depth, float(rate), float(rmse)) for (depth, rate), rmse in found.items()]
    return train.sparkSession.createDataFrame(rows, "depth int, rate double, rmse double")


def grid_scores(
    rows: DataFrame, key: str, targets: dict[int, str], held: Column, grid: dict[str, list], trees: int = 5, depth: int = 3, parallel: int = PARALLEL
) -> DataFrame:
    """One row per combination of ``grid`` with its scores on the held rows: (parameters, n, mae, rmse, r2, cosine,
    row_pearson, column_pearson).

    ``rows(key, features, one column per target)``; a regressor per target and combination is fitted on the rows
    that are not ``held``.  ``grid`` maps names among trees, depth, rate and share to the values to try.  Means over
    rows or targets leave undefined scores out.  All fits are independent and run a few at a time; a combination's
    scores are one row, and no prediction reaches the driver.
    """
    if unknown := set(grid) - {"trees", "depth", "rate", "share"}:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    spark = rows.sparkSession
    parted = cut(rows.withColumn("_held", F.coalesce(held, F.lit(False))))
    train, valid = parted.filter("NOT _held"), parted.filter("_held")
    cell = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).cast("double").alias("y")) for d, c in targets.items()]))
    truth = valid.select(F.col(key).alias("row_id"), cell.alias("_c")).select("row_id", "_c.dim", "_c.y")

    def score_one(values: tuple) -> tuple:
        config = {"trees": trees, "depth": depth, "rate": 0.1, "share": 0.8, **dict(zip(grid, values))}
        model = regressor(config["trees"], config["depth"], config["rate"], config["share"])
        models = {d: model.fit(train.select("features", F.col(c).cast("double").alias("y")).filter("y IS NOT NULL")) for d, c in targets.items()}
        pred = truth.join(score(valid, models, key).withColumnRenamed(key, "row_id"), ["row_id", "dim"])
        by_row = pred.groupBy("row_id").agg(cosine_agg("y", "y_hat").alias("c"), pearson_agg("y", "y_hat").alias("r"))
        by_dim = pred.groupBy("dim").agg(
            pearson_agg("y", "y_hat").alias("r"), r2_agg().alias("r2"), F.count("y").alias("n"),
            F.sum(F.abs(F.col("y") - F.col("y_hat"))).alias("a"), F.sum((F.col("y") - F.col("y_hat")) ** 2).alias("s"),
        )
        rows_ = by_row.agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("cosine"), F.avg("r").alias("row_pearson"))
        dims_ = by_dim.agg(
            F.try_divide(F.sum("a"), F.sum("n")).alias("mae"), F.sqrt(F.try_divide(F.sum("s"), F.sum("n"))).alias("rmse"),
            F.avg("r2").alias("r2"), F.avg("r").alias("column_pearson"),
        )
        one, other = rows_.first(), dims_.first()
        return (*values, one.n, other.mae, other.rmse, other.r2, one.cosine, one.row_pearson, other.column_pearson)

    found = _for_each(list(product(*grid.values())), score_one, parallel)
    kinds = {"trees": "int", "depth": "int", "rate": "double", "share": "double"}
    schema = ", ".join(f"{name} {kinds[name]}" for name in grid)
    scores = ", ".join(f"{name} double" for name in ("mae", "rmse", "r2", "cosine", "row_pearson", "column_pearson"))
    typed = [tuple(float(v) if kinds.get(n) == "double" else v for n, v in zip([*grid, *[""] * 7], row)) for row in found.values()]
    return spark.createDataFrame(typed, f"{schema}, n long, {scores}")


def label_clusters(edges: DataFrame, k: int, iterations: int = 10, start: str = "random") -> DataFrame:
    """(dim, cluster) from a weighted label graph (a, b, n), by power iteration from random values or degrees."""
    graph = edges.filter("a < b AND n > 0").select(
        F.col("a").cast("long"), F.col("b").cast("long"), F.col("n").cast("double").alias("w")
    )
    found = PowerIterationClustering(k=k, maxIter=iterations, initMode=start, srcCol="a", dstCol="b", weightCol="w").assignClusters(graph)
    return found.select(F.col("id").cast("int").alias("dim"), "cluster")


def project(rows: DataFrame, key: str, vec: str, k: int = 2) -> DataFrame:
    """(key, coords) on the first k principal components."""
    data = assemble(rows, vec)
    model = PCA(k=k, inputCol="features", outputCol="_p").fit(data)
    return model.transform(data).select(key, vector_to_array("_p").alias("coords"))


def save_model(model: GBTRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_and_score(path: str, rows: DataFrame, key: str) -> DataFrame:
    """Predictions of a stored regressor for new rows."""
    model = GBTRegressionModel.load(path)
    return model.transform(rows.select(key, "features")).select(key, F.col("prediction").alias("y_hat"))

