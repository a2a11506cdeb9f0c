"""Reproducible row splits as tables (fold, row_id, part)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.functions.mixing import mix
from medley.operators.ordered import row_numbers


def shuffled(df: DataFrame, row: str, seed: int) -> DataFrame:
    """(row, i, n): position of every row in a seeded hash order, and the row count.

    The order is (hash, row), total for unique rows, so the split depends only on
    the row ids and the seed.
    """
    hashed = df.select(row, mix(seed, row).alias("_h"))
    placed = row_numbers(hashed, [], ["_h", row], "i").withColumn("i", F.col("i") - 1)
    return placed.select(row, "i").withColumn("n", df.select(F.count(F.lit(1))).scalar())


def _floor(c: Column) -> Column:
    return F.floor(c).cast("long")


def kfold(df: DataFrame, row: str, k: int = 5, val_size: float = 0.1, seed: int = 0) -> DataFrame:
    """k rows per input row: test once, otherwise train or validation.

    Test folds are every k-th row of the hash order.  The validation block is
    ``val_size`` of all rows, cut from the remaining ones at a place that moves
    with the fold; its bounds follow from the position, so no further ranking.
    """
    if k < 2 or not 0 <= val_size < 1 - 1 / k:
        raise ValueError("need k >= 2 and 0 <= val_size < 1 - 1/k")
    share = (1 - 1 / k - val_size) / (1 - 1 / k)
    spread = shuffled(df, row, seed).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    i, n, fold = F.col("i"), F.col("n"), F.col("fold")
    before = _floor((i + (k - 1) - fold) / k)
    rest = n - _floor((n + (k - 1) - fold) / k)
    turned = (i - before + fold * _floor(rest / k)) % F.greatest(rest, F.lit(1))
    part = (
        F.when(i % k == fold, "test").when(turned < _floor(share * rest), "train").otherwise("val")
    )
    return spread.select("fold", row, part.alias("part"))


def train_val_test(
    df: DataFrame, row: str, test_size: float = 0.2, val_size: float = 0.1, seed: int = 0
) -> DataFrame:
    """(row, part): ceil(test * n) test rows, then ceil(val / (1 - test) * rest) validation rows."""
    if test_size + val_size >= 1:
        raise ValueError("test_size + val_size must be less than 1")
    i, n = F.col("i"), F.col("n")
    tests = F.ceil(F.lit(test_size) * n).cast("long")
    vals = F.ceil(F.lit(val_size / (1 - test_size)) * (n - tests)).cast("long")
    part = F.when(i < tests, "test").when(i < tests + vals, "val").otherwise("train")
    return shuffled(df, row, seed).select(row, part.alias("part"))


def shuffle_and_cut(df: DataFrame, row: str, valid_share: float, seed: int = 0) -> DataFrame:
    """(row, part): the first floor((1 - valid_share) * n) shuffled rows train, the rest validate."""
    cut = F.floor(F.lit(1 - valid_share) * F.col("n")).cast("long")
    return shuffled(df, row, seed).select(row, F.when(F.col("i") < cut, "train").otherwise("val").alias("part"))


def balanced_folds(df: DataFrame, row: str, labels: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """(fold, row): round robin inside each signature of "label = 0" indicators.

    Signatures with fewer than k rows share one group, in order of their signature, so
    rows of like labels are spread over the folds there too.
    """
    signed = df.select(
        row, F.concat(*[F.when(F.col(c) == 0, "0").otherwise("1") for c in labels]).alias("_sig"), mix(seed, row).alias("_h")
    )
    sizes = signed.groupBy("_sig").agg(F.count(F.lit(1)).alias("_n"))
    grouped = signed.join(sizes, "_sig").withColumn("_group", F.when(F.col("_n") < k, "rare").otherwise(F.col("_sig")))
    numbered = row_numbers(grouped.select(row, "_group", "_sig", "_h"), ["_group"], ["_sig", "_h", row], "_i")
    return numbered.select(((F.col("_i") - 1) % k).cast("int").alias("fold"), row)


def take_part(df: DataFrame, split: DataFrame, row: str, fold: int | None, part: str) -> DataFrame:
    """Rows of one part (of one fold)."""
    chosen = split.filter(F.col("part") == part)
    if fold is not None:
        chosen = chosen.filter(F.col("fold") == fold)
    return df.join(chosen.select(row), row, "left_semi")
