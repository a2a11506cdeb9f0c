"""Loss scores as aggregate expressions over cells (dim, y, y_hat).

Each function returns one aggregate Column, so several scores share one pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from medley.functions.numeric import sigmoid

EPS = 1e-6


def _cols(y: str, p: str) -> tuple[Column, Column]:
    return F.col(y), F.col(p)


def _when(mask: Column | None, value: Column) -> Column:
    return value if mask is None else F.when(mask, value)


def mae(y="y", p="y_hat", where: Column | None = None) -> Column:
    t, x = _cols(y, p)
    return F.avg(_when(where, F.abs(x - t)))


def mse(y="y", p="y_hat", where: Column | None = None) -> Column:
    t, x = _cols(y, p)
    return F.avg(_when(where, (x - t) * (x - t)))


def bce_with_logits_cell(logit: Column, target: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def bce_with_logits(y="y", p="y_hat", where: Column | None = None) -> Column:
    t, x = _cols(y, p)
    return F.avg(_when(where, bce_with_logits_cell(x, t)))


def tweedie(power: float = 1.8, y="y", p="y_hat", where: Column | None = None) -> Column:
    """Mean of y*mu^(1-p)/(1-p) - mu^(2-p)/(2-p), inputs floored, power clamped."""
    power = min(max(power, 1.01), 1.99)
    t, x = (F.greatest(c, F.lit(EPS)) for c in _cols(y, p))
    cell = t * F.pow(x, F.lit(1 - power)) / (1 - power) - F.pow(x, F.lit(2 - power)) / (2 - power)
    return F.avg(_when(where, cell))


def huber(delta: float = 1.0, y="y", p="y_hat", where: Column | None = None) -> Column:
    t, x = _cols(y, p)
    e = F.abs(x - t)
    return F.avg(_when(where, F.when(e < delta, e * e * (0.5 / delta)).otherwise(e - 0.5 * delta)))


def log_cosh(y="y", p="y_hat", where: Column | None = None) -> Column:
    t, x = _cols(y, p)
    e = F.abs(x - t)
    return F.avg(_when(where, e + F.log1p(F.exp(-2 * e)) - math.log(2.0)))


def pinball(tau: float = 0.5, y="y", p="y_hat", where: Column | None = None) -> Column:
    if not 0 < tau < 1:
        raise ValueError("tau must lie strictly between 0 and 1")
    t, x = _cols(y, p)
    d = t - x
    return F.avg(_when(where, F.greatest(tau * d, (tau - 1) * d)))


def weighted_mse(weight_first: float = 1.0, weight_rest: float = 1.0, dim="dim") -> Column:
    """Separate means for dims < 2 and the rest."""
    first = F.col(dim) < 2
    return weight_first * mse(where=first) + weight_rest * mse(where=~first)


def column_weighted_mse(weight="weight", y="y", p="y_hat") -> Column:
    t, x = _cols(y, p)
    return F.avg(F.col(weight) * (x - t) * (x - t))


def tweedie_huber(power: float = 1.8, delta: float = 1.0, y="y", p="y_hat") -> Column:
    """Tweedie on cells with y = 0 plus Huber on the others; an empty side counts 0."""
    zero = F.col(y) == 0
    return F.coalesce(tweedie(power, y, p, zero), F.lit(0.0)) + F.coalesce(huber(delta, y, p, ~zero), F.lit(0.0))


def hurdle(tau: float = 0.1, alpha: float = 10.0, mask_weight: float = 1.0, reg_weight: float = 1.0) -> Column:
    """Cross entropy of sigmoid(alpha(x - tau)) against y > 0, plus masked MSE over all cells."""
    t, x = _cols("y", "y_hat")
    prob = F.least(F.greatest(sigmoid(alpha * (x - tau)), F.lit(EPS)), F.lit(1 - EPS))
    positive = t > 0
    bce = F.avg(-F.when(positive, F.log(prob)).otherwise(F.log(1 - prob)))
    squares = F.avg(F.when(positive, (x - t) * (x - t)).otherwise(0.0))
    return mask_weight * bce + reg_weight * squares


def two_output_hurdle(logit="logit", y="y", p="y_hat") -> Column:
    """mean BCE(logit, y > 0) / n+  +  SSE over positives / n+, n+ at least 1."""
    t, x = _cols(y, p)
    positive = (t > 0).cast("double")
    count = F.greatest(F.sum(positive), F.lit(1.0))
    bce = F.avg(bce_with_logits_cell(F.col(logit), positive))
    return bce / count + F.sum(positive * (x - t) * (x - t)) / count


def focal(alpha: float = 0.25, gamma: float = 2.0, y="y", p="y_hat") -> Column:
    """Sigmoid focal loss of the logits ``p`` against y > 0."""
    t, x = _cols(y, p)
    target = (t > 0).cast("double")
    prob = sigmoid(x)
    hit = prob * target + (1 - prob) * (1 - target)
    balance = alpha * target + (1 - alpha) * (1 - target)
    return F.avg(balance * bce_with_logits_cell(x, target) * F.pow(1 - hit, F.lit(gamma)))


def uncertainty(parts: list[Column], log_vars: list[float]) -> Column:
    """Sum of exp(-s) * loss + s."""
    total = F.lit(0.0)
    for part, s in zip(parts, log_vars, strict=True):
        total = total + math.exp(-s) * part + s
    return total


LOSSES = {
    "mae": mae,
    "mse": mse,
    "bce": bce_with_logits,
    "tweedie": tweedie,
    "weighted_mse": weighted_mse,
    "huber": huber,
    "logcosh": log_cosh,
    "quantile": pinball,
    "asym_mse": column_weighted_mse,
    "mixed": tweedie_huber,
    "hurdle": hurdle,
    "hurdle_two_output": two_output_hurdle,
    "focal": focal,
}


def loss(name: str, **options) -> Column:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; choose from {sorted(LOSSES)}")
    return LOSSES[name](**options)


def two_part(name: str, weight_first: float = 1.0, weight_rest: float = 1.0, uncertain: bool = False, **options) -> Column:
    """weight * MSE(dims < 2) + weight * L(dims >= 2), or the log-variance mix of both."""
    if name not in ("mae", "mse", "bce", "tweedie", "huber", "logcosh", "quantile"):
        raise ValueError(f"{name!r} cannot be restricted to a part of the dims")
    first = F.col("dim") < 2
    a, b = mse(where=first), LOSSES[name](where=~first, **options)
    if uncertain:
        return uncertainty([a, b], [0.0, 0.0])
    return weight_first * a + weight_rest * b
