"""Guarded arithmetic, activations and small physical laws as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 (the session runs ANSI mode)."""
    return F.try_divide(a, b)


def pearson_agg(y: str, p: str) -> Column:
    """Pearson correlation as one aggregate; NULL when either side is constant."""
    constant = (F.min(y) == F.max(y)) | (F.min(p) == F.max(p))
    r = safe_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p))
    return F.when(~constant, r)


def cosine_agg(y: str, p: str) -> Column:
    """Cosine similarity as one aggregate; NULL when either side is all zero."""
    a, b = F.col(y), F.col(p)
    return safe_divide(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b)))


def _total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x)


def cosine_of(y: str, p: str) -> Column:
    """Cosine similarity of two array columns of one length; NULL when either side is all zero."""
    product = lambda a, b: _total(F.zip_with(a, b, lambda u, v: u * v))
    return safe_divide(product(y, p), F.sqrt(product(y, y)) * F.sqrt(product(p, p)))


def pearson_of(y: str, p: str) -> Column:
    """Pearson correlation of two array columns of one length; NULL when either side is constant."""
    constant = (F.array_min(y) == F.array_max(y)) | (F.array_min(p) == F.array_max(p))
    centred = lambda vec: F.transform(vec, lambda x: x - _total(F.col(vec)) / F.size(vec))
    pairs = F.zip_with(centred(y), centred(p), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sums = F.aggregate(
        pairs,
        F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb")),
        lambda s, x: F.struct(
            (s["ab"] + x["a"] * x["b"]).alias("ab"), (s["aa"] + x["a"] * x["a"]).alias("aa"), (s["bb"] + x["b"] * x["b"]).alias("bb")
        ),
        lambda s: safe_divide(s["ab"], F.sqrt(s["aa"]) * F.sqrt(s["bb"])),
    )
    return F.when(~constant, sums)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def hardtanh01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


ACTIVATIONS = {"sigmoid": sigmoid, "relu": relu, "hardtanh": hardtanh01, "softplus": softplus}


def activation(name: str, x: Column) -> Column:
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}; choose from {sorted(ACTIVATIONS)}")
    return ACTIVATIONS[name](x)


# Fixed value: Boltzmann constant in eV/K as used by the temperature laws.
BOLTZMANN_EV = 8.63e-5


def temperature_law(law: str, params: list[Column], temp: Column) -> Column:
    """'arrhenius' logA - C*Ea/T; 'vft_mit' logA - C*Ea/(T - T0); 'vft_cmu' c1*exp(-c2/(T - c3))."""
    scale = math.log10(math.e) / BOLTZMANN_EV
    if law == "arrhenius":
        return params[0] - safe_divide(F.lit(scale) * params[1], temp)
    if law == "vft_mit":
        return params[0] - safe_divide(F.lit(scale) * params[1], temp - params[2])
    if law == "vft_cmu":
        return params[0] * F.exp(-safe_divide(params[1], temp - params[2]))
    raise ValueError(f"unknown law {law!r}; choose from arrhenius, vft_cmu, vft_mit")


def scaled_distance(cosine: Column, weight: float = 0.5, bias: float = 0.5, act: str = "hardtanh") -> Column:
    """Activation of weight * (1 - cosine) + bias."""
    return activation(act, F.lit(weight) * (F.lit(1.0) - cosine) + F.lit(bias))
