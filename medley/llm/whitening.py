"""Whitening of embeddings by a covariance over the distinct vectors, weighted by multiplicity.

Identical integer vectors are grouped first, so each distinct one is held, fitted and
whitened once, however often it is repeated; its rows get the result by a join back.
Tasks add up exact integer sums, then centred matrix products (dims x dims a task);
what reaches the driver is a mean and the leading components, a few vectors of the
embedding's width.

Vectors of different lengths are different spaces: each length is fitted by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.session import cut

HOT_ROWS = 10_000
HOT_SHARE = 1_000  # at most this many vectors can have more than one HOT_SHARE-th of the rows
LONGEST = 2**63


@dataclass(frozen=True)
class Model:
    """The fit of the vectors of one length: total weight, exact sums, leading components."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    axes: np.ndarray  # a row per component
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]


def integer_rows(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, key, x) of every row whose vector has finite entries only: x = floor(scale * entry),
    key the SHA-256 of x.  A NULL vector, one with NULL, NaN or infinite entries, and an empty one,
    which has no component, give no row; a product beyond a long is held at its end."""
    entries = F.col("embedding").cast("array<double>")
    fair = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = F.coalesce(F.forall(entries, lambda c: F.coalesce(fair(c), F.lit(False))), F.lit(False))
    x = F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    rows = embeddings.filter(whole & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long"), x.alias("x"))
    return rows.select("vec_id", F.unhex(F.sha2(F.col("x").cast("string").cast("binary"), 256)).alias("key"), "x")


def _matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) for each length among these vectors."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        same = vectors if len(places) == len(vectors) else vectors.take(pa.array(places))
        yield int(length), places, same.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _exact_sums(x: np.ndarray, weights: np.ndarray) -> list[int]:
    reach = max(abs(int(x.max())), abs(int(x.min()))) * int(weights.sum())
    if reach < LONGEST:
        return (weights @ x).tolist()
    return [sum(int(v) * int(w) for v, w in zip(column, weights)) for column in x.T]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per length: total weight and weighted sums of this task, exact."""
    totals: dict[int, list] = {}
    for batch in batches:
        weights = batch.column(1).to_numpy(zero_copy_only=False)
        for length, places, x in _matrices(batch.column(0)):
            n, sums = totals.get(length, (0, [0] * length))
            more = _exact_sums(x, weights[places])
            totals[length] = [n + int(weights[places].sum()), [a + b for a, b in zip(sums, more)]]
    numbers = pa.list_(pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(totals), pa.int32()),
            pa.array([n for n, _ in totals.values()], pa.int64()),
            pa.array([[Decimal(s) for s in sums] for _, sums in totals.values()], numbers),
        ],
        ["length", "n", "sums"],
    )


def _products(means: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of this task's weighted products of centred vectors, by length."""
        totals = {length: np.zeros((length, length)) for length in means}
        seen = set()
        for batch in batches:
            weights = batch.column(1).to_numpy(zero_copy_only=False)
            for length, places, x in _matrices(batch.column(0)):
                centred = x - means[length]
                totals[length] += (centred * weights[places][:, None]).T @ centred
                seen.add(length)
        for length in seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(length, length, np.int32)),
                    pa.array(np.arange(length, dtype=np.int32)),
                    pa.array(list(totals[length]), pa.list_(pa.float64())),
                ],
                ["length", "a", "products"],
            )

    return run


def fit(distinct: DataFrame, weight: Column, components: int) -> dict[int, Model]:
    """length -> model of the vectors ``x`` under ``weight``."""
    data = distinct.select("x", weight.cast("long").alias("w"))
    parts = data.mapInArrow(_moments, "length int, n long, sums array<decimal(38,0)>")
    found = parts.select("length", "n", F.posexplode("sums").alias("a", "s"))
    sums: dict[int, list[int]] = {}
    total: dict[int, int] = {}
    for r in found.groupBy("length", "a").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("length", "a").collect():
        sums.setdefault(r.length, []).append(int(r.s))
        total[r.length] = r.n
    means = {d: np.array([float(Fraction(s, total[d])) for s in of]) for d, of in sums.items()}

    def leading(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        length = int(key[0])
        covariance = np.stack(rows.sort_values("a")["products"].to_numpy()) / total[length]
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        first = np.argsort(values)[::-1][:components]
        # below its own rounding error an eigenvalue is none
        real = np.where(values[first] > length * np.finfo(float).eps * values.max(), values[first], 0.0)
        trace = float(np.trace(covariance))
        return pd.DataFrame({"length": length, "value": real, "axis": list(vectors[:, first].T), "trace": trace})

    blocks = data.mapInArrow(_products(means), "length int, a int, products array<double>")
    added = blocks.groupBy("length", "a").agg(vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"))
    axes = added.groupBy("length").applyInPandas(leading, "length int, value double, axis array<double>, trace double")
    of_length: dict[int, list] = {}
    for r in axes.collect():
        of_length.setdefault(r.length, []).append(r)
    models = {}
    for length, rows in of_length.items():
        rows.sort(key=lambda r: -r.value)
        models[length] = Model(
            total[length],
            tuple(sums[length]),
            means[length],
            np.array([r.axis for r in rows]),
            np.array([r.value for r in rows]),
            rows[0].trace,
        )
    return models


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n * x - S)^2 over the entries of each row, exact; None where no long holds it."""
    reach = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if reach * reach * len(sums) < LONGEST:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [value if value < LONGEST else None for value in exact]


def _whiten(models: dict[int, Model]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, places, x in _matrices(batch.column(1)):
                model = models[length]
                with np.errstate(divide="ignore", invalid="ignore"):
                    made = (x - model.mean) @ model.axes.T / np.sqrt(model.values)
                made = [[v if e > 0 else None for v, e in zip(row, model.values)] for row in made.tolist()]
                own = pa.array(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(own),
                        pa.array(np.full(len(places), length, np.int32)),
                        batch.column(2).take(own),
                        pa.array(deviations(x, model.n, model.sums), pa.int64()),
                        pa.array(made, pa.list_(pa.float64())),
                    ],
                    ["key", "length", "copies", "deviation", "whitened"],
                )

    return run


def _identity_errors(spaces: DataFrame, weight: Column, components: int) -> DataFrame:
    """(length, identity_error): largest entry of the whitened vectors' covariance minus the identity.

    Centred on their own means; the table of means has a row per length."""
    w = [F.get("whitened", F.lit(i)) for i in range(components)]
    at = [f"_m{i}" for i in range(components)]
    means = spaces.groupBy("length").agg(
        F.sum(weight).alias("_n"), *[(F.sum(weight * w[i]) / F.sum(weight)).alias(at[i]) for i in range(components)]
    )
    centred = spaces.join(F.broadcast(means), "length")
    apart = [
        F.abs(F.sum(weight * (w[i] - F.col(at[i])) * (w[j] - F.col(at[j]))) / F.max("_n") - float(i == j))
        for i in range(components)
        for j in range(i + 1)
    ]
    worst = F.greatest(*apart) if len(apart) > 1 else apart[0]
    return centred.groupBy("length").agg(worst.alias("identity_error"))


def whiten(embeddings: DataFrame, components: int = 4, scale: int = 256, by_copies: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row that takes
    part (see ``integer_rows``) and its leading components, at most ``components`` and the vector's length.

    Every distinct vector has weight one in the fit, or the number of its rows (``by_copies``).
    ``n`` is the total weight, ``deviation`` NULL where it does not fit a long.  A component without
    variance (a constant column, a single vector) has NULL for ``whitened`` and is left out of
    ``identity_error``, which is NULL if none is left; ``explained`` is NULL if nothing varies.
    Equal eigenvalues have any orthonormal axes.  Repeated rows and rows without an id each get
    their own result; an empty table gives an empty one.  Other columns are not read.

    ``hot_rows``: a vector with more rows than this, and more than a thousandth of all, is joined
    back by broadcast, so no task gets the rows of a vector that a great part of them shares.
    """
    spark = embeddings.sparkSession
    rows = integer_rows(embeddings, scale)
    distinct = cut(rows.groupBy("key", "x").agg(F.count(F.lit(1)).alias("copies")))
    weight = F.col("copies") if by_copies else F.lit(1).cast("long")
    models = fit(distinct, weight, components)
    spaces = cut(
        distinct.select("key", "x", "copies").mapInArrow(
            _whiten(models), "key binary, length int, copies long, deviation long, whitened array<double>"
        )
    )
    facts = spark.createDataFrame(
        [(d, m.n, m.explained) for d, m in models.items()], "length int, n long, explained array<double>"
    )
    # a row per length, no more than the driver already holds
    facts = facts.join(cut(_identity_errors(spaces, weight, components)), "length")
    everything = spaces.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > max(hot_rows, everything // HOT_SHARE)
    frequent = spaces.filter(hot)
    narrow = rows.select("vec_id", "key")
    if frequent.isEmpty():
        met = narrow.join(spaces, "key")
    else:  # at most HOT_SHARE rows are broadcast
        rare = narrow.join(F.broadcast(frequent.select("key")), "key", "left_anti")
        met = narrow.join(F.broadcast(frequent), "key").unionByName(rare.join(spaces.filter(~hot), "key"))
    told = met.join(F.broadcast(facts), "length")
    cells = told.select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of")
    )
    return cells.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("of.whitened").alias("whitened"),
        F.col("of.explained").alias("explained"),
        "identity_error",
    )
