"""Lookups and membership joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medley.functions.lists import split_list
from medley.operators.tidy import keep_first


def present_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_semi")


def absent_from_all(df: DataFrame, key: str, others: list[DataFrame]) -> DataFrame:
    """Rows whose key occurs in none of the other tables."""
    seen = reduce(DataFrame.unionByName, [o.select(key) for o in others])
    return df.join(seen, key, "left_anti")


def left_with_first(df: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Left join against the right side reduced to its first row per key."""
    return df.join(keep_first(right, on, order), on, "left")


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, out: str, pass_through: bool) -> DataFrame:
    """Replace a key by ``table(key, value)``; unknown keys pass through or give NULL."""
    found = df.join(table.select(key, F.col(value).alias("_found")), key, "left")
    result = F.coalesce("_found", F.col(key).cast(dict(table.dtypes)[value])) if pass_through else F.col("_found")
    return found.withColumn(out, result).drop("_found")


def gather(df: DataFrame, features: DataFrame, link: str, vec: str, dims: int, fill: float | None = None) -> DataFrame:
    """Attach a feature vector by link; a missing one is NULL, or ``dims`` copies of ``fill``."""
    joined = df.join(features.select(link, vec), link, "left")
    if fill is None:
        return joined
    return joined.withColumn(vec, F.coalesce(vec, F.array_repeat(F.lit(float(fill)), dims)))


def expand_definition(
    definitions: DataFrame, key: str, text: str, components: DataFrame, fields: list[str], order: list[str]
) -> DataFrame:
    """A ';' list of component ids to one row per entry with the component's fields.

    ``components(component, fields)`` may list an id twice: the first row under
    ``order`` wins.  The position in the list is kept as ``pos``.  An id that is not
    defined is an error; ``undefined_components`` lists those.
    """
    first = keep_first(components.select("component", *fields), ["component"], order)
    known = first.withColumn("_known", F.lit(True))
    joined = _entries(definitions, key, text).join(known, "component", "left")
    clash = F.raise_error(F.concat(F.lit("no component "), F.col("component").cast("string")))
    checked = joined.filter(F.when(F.col("_known"), F.lit(True)).otherwise(clash.cast("boolean")))
    return checked.select(key, "pos", "component", *fields)


def undefined_components(definitions: DataFrame, key: str, text: str, components: DataFrame) -> DataFrame:
    """(key, pos, component) of the list entries that no component row defines."""
    entries = _entries(definitions, key, text).select(key, "pos", "component")
    return entries.join(components.select("component"), "component", "left_anti").select(key, "pos", "component")


def _entries(definitions: DataFrame, key: str, text: str) -> DataFrame:
    return definitions.select(key, F.posexplode(split_list(text, "bigint")).alias("pos", "component"))


def disagreements(a: DataFrame, b: DataFrame, on: list[str], left: str, right: str, tolerance: float) -> DataFrame:
    """Rows of both sources whose values differ by more than ``tolerance``."""
    both = a.join(b, on)
    return both.filter(F.abs(F.col(left) - F.col(right)) > tolerance)


def side_by_side(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two long feature blocks (key, dim, v) of the same rows as one block.

    The second block's dims follow the first's; keys must occur in both.  The blocks are put
    together by key in one shuffle.
    """
    width = first.agg(F.max("dim") + 1).scalar()
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    of_row = Window.partitionBy(key)  # the cells of one row
    met = both.withColumns({"_first": F.min("_side").over(of_row), "_last": F.max("_side").over(of_row), "_w": width})
    dim = (F.col("dim") + F.when(F.col("_side") == 1, F.col("_w")).otherwise(0)).cast("int")
    return met.filter("_first < _last").withColumn("dim", dim).drop("_side", "_first", "_last", "_w")
