"""Loss scores that need row- or dim-level sums before the final scalar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.functions import losses as L


def column_weighted_mse(pred: DataFrame, weights: DataFrame) -> DataFrame:
    """Squared errors weighted per dim by ``weights(dim, weight)``.

    The squared errors are averaged per dim before the join, so the weights meet
    one row per dim rather than every cell.
    """
    e = F.col("y") - F.col("y_hat")
    per_dim = pred.groupBy("dim").agg(F.sum(e * e).alias("se"), F.count("y").alias("n"))
    return per_dim.join(weights, "dim").agg((F.sum(F.col("weight") * F.col("se")) / F.sum("n")).alias("score"))


def _cell_parts(focal: bool) -> list[Column]:
    bce = L.focal() if focal else F.avg(
        L.bce_with_logits_cell(F.col("y_hat"), (F.col("y") > 0).cast("double"))
    )
    return [bce.alias("bce"), F.sqrt(L.mse() + L.EPS).alias("rmse")]


def _mean_cosine_loss(rows: DataFrame) -> DataFrame:
    """1 - mean cosine with the norm product floored at 1e-8."""
    return rows.agg((1 - F.avg(F.col("dot") / F.greatest(F.col("norms"), F.lit(1e-8)))).alias("cosine"))


def _row_parts(pred: DataFrame) -> DataFrame:
    y, p, n = F.col("y"), F.col("y_hat"), F.count("y")
    return pred.groupBy("row_id").agg(
        F.sum(y * p).alias("dot"),
        (F.sqrt(F.sum(y * y)) * F.sqrt(F.sum(p * p))).alias("norms"),
        (F.covar_pop("y", "y_hat") * n).alias("cov"),
        (F.var_pop("y_hat") * n).alias("vp"),
        (F.var_pop("y") * n).alias("vy"),
    )


def composite(
    pred: DataFrame, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0, delta: float = 1.0, focal: bool = False
) -> DataFrame:
    """alpha*BCE + beta*RMSE + gamma*(1 - row Pearson) + delta*(1 - cosine)."""
    pearson = F.col("cov") / (F.sqrt(F.col("vp") + L.EPS) * F.sqrt(F.col("vy") + L.EPS))
    cells = pred.agg(*_cell_parts(focal))
    rows = _row_parts(pred)
    row_losses = rows.agg(
        F.avg(1 - pearson).alias("pearson"),
        (1 - F.avg(F.col("dot") / F.greatest(F.col("norms"), F.lit(1e-8)))).alias("cosine"),
    )
    c = F.col
    total = alpha * c("bce") + beta * c("rmse") + gamma * c("pearson") + delta * c("cosine")
    return _side_by_side(cells, row_losses).select(total.alias("score"))


def composite_uncertain(pred: DataFrame, log_vars: list[float] | None = None, focal: bool = False) -> DataFrame:
    """The four sub-losses mixed as exp(-s)*L + s; Pearson is pooled around column means."""
    log_vars = log_vars or [0.0] * 4
    n = F.count("y")
    per_dim = pred.groupBy("dim").agg(
        n.alias("n"),
        (F.covar_pop("y", "y_hat") * n).alias("cov"),
        (F.var_pop("y_hat") * n).alias("vp"),
        (F.var_pop("y") * n).alias("vy"),
    )
    mean = lambda c: F.sum(c) / F.sum("n")
    pooled = per_dim.agg((1 - mean("cov") / (F.sqrt(mean("vp") * mean("vy")) + L.EPS)).alias("pearson"))
    parts = _side_by_side(pred.agg(*_cell_parts(focal)), pooled, _mean_cosine_loss(_row_parts(pred)))
    names = ["bce", "rmse", "pearson", "cosine"]
    return parts.select(L.uncertainty([F.col(c) for c in names], log_vars).alias("score"))


def _side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of one-row frames in one row, attached as scalar subqueries."""
    out = first
    for other in others:
        for name in other.columns:
            out = out.withColumn(name, other.select(name).scalar())
    return out


TABLE_SCORES = {
    "combined": composite,
    "combined_uncertain": composite_uncertain,
    "column_weighted": column_weighted_mse,
}


def score(pred: DataFrame, name: str, **options) -> DataFrame:
    """(score) of any loss by name: those of ``losses.LOSSES`` and those above that need a table."""
    if name in TABLE_SCORES:
        return TABLE_SCORES[name](pred, **options)
    if name not in L.LOSSES:
        raise ValueError(f"unknown loss {name!r}; choose from {sorted({*L.LOSSES, *TABLE_SCORES})}")
    return pred.agg(L.loss(name, **options).alias("score"))


def two_part(
    pred: DataFrame, name: str, weight_first: float = 1.0, weight_rest: float = 1.0, uncertain: bool = False, **options
) -> DataFrame:
    """(score): weight * MSE(dims 0-1) + weight * L(the other dims, counted from 0), for every loss by name.

    ``weighted_mse`` weighs its own two parts and takes the place of the whole second
    term.  ``uncertain`` mixes both as exp(-s)*L + s with s = 0.
    """
    first = pred.filter("dim < 2").agg(L.mse().alias("first"))
    rest = score(pred.filter("dim >= 2").withColumn("dim", F.col("dim") - 2), name, **options)
    both = _side_by_side(first, rest.withColumnRenamed("score", "rest"))
    if uncertain:
        return both.select(L.uncertainty([F.col("first"), F.col("rest")], [0.0, 0.0]).alias("score"))
    if name == "weighted_mse":
        return both.select(F.col("rest").alias("score"))
    return both.select((weight_first * F.col("first") + weight_rest * F.col("rest")).alias("score"))
