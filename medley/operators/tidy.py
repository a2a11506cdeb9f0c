"""Cleaning: projections, filters, deduplication, ids, per-key scaling, regrouping."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.operators.ordered import row_ids, row_numbers

# --- projections -------------------------------------------------------------


def all_but(df: DataFrame, *names: str) -> list[str]:
    """Column names except ``names``, order kept."""
    return [c for c in df.columns if c not in names]


def matching(df: DataFrame, pattern: str = r"\d+") -> list[str]:
    """Column names fully matching a pattern; the default picks numeric names."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def lower_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Lower-case the given names; columns that collide are merged by logical or (0/1).

    Columns are renamed by position first: names that differ only in case cannot
    be told apart in a case-insensitive session.
    """
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    groups: dict[str, list[int]] = {}
    kept = []
    for i, name in enumerate(df.columns):
        if name in names:
            groups.setdefault(name.lower(), []).append(i)
        else:
            kept.append(F.col(f"_c{i}").alias(name))
    merged = []
    for low, places in groups.items():
        if len(places) == 1:
            merged.append(F.col(f"_c{places[0]}").alias(low))
        else:
            flags = [F.coalesce(F.col(f"_c{i}") != 0, F.lit(False)) for i in places]
            merged.append(reduce(lambda a, b: a | b, flags).cast("int").alias(low))
    return plain.select(*kept, *merged)


def strip_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.toDF(*[c.removesuffix(suffix) for c in df.columns])


def rounded_key(names: list[str], digits: int = 6, sep: str = "-") -> Column:
    """Text key of rounded columns, fixed-point so equal numbers give equal text."""
    return F.concat_ws(sep, *[F.round(c, digits).cast(f"decimal(38,{digits})").cast("string") for c in names])


def empty_column(name: str, kind: str = "string") -> Column:
    return F.lit(None).cast(kind).alias(name)


def drop_null_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the named columns that hold any NULL or NaN (one pass)."""
    types = dict(df.dtypes)
    bad = lambda c: F.col(c).isNull() | F.isnan(c) if types[c] in ("double", "float") else F.col(c).isNull()
    flags = df.agg(*[F.max(bad(c).cast("int")).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if flags[c] == 1])


def drop_rare_columns(df: DataFrame, names: list[str], threshold: int = 40) -> DataFrame:
    """Drop the named columns with fewer than ``threshold`` nonzero values (one pass)."""
    counts = df.agg(*[F.sum((F.coalesce(F.col(c), F.lit(0)) != 0).cast("long")).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if (counts[c] or 0) < threshold])


# --- filters -----------------------------------------------------------------


def with_any_task(df: DataFrame, tasks: list[str]) -> DataFrame:
    """Rows with at least one of the task flags set."""
    unknown = [t for t in tasks if t not in df.columns]
    if unknown or not tasks:
        raise ValueError(f"unknown task {unknown}; the table has {df.columns}")
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(t) != 0, F.lit(False)) for t in tasks]))


def drop_all_zero(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose named columns are all zero are dropped."""
    return df.filter(~F.forall(F.array(*names), lambda x: x == 0))


def without_tokens(df: DataFrame, text: str, banned: list[str]) -> DataFrame:
    """Rows whose text holds none of the banned words (whole words, lexical)."""
    return df.filter(~F.col(text).rlike(word_pattern(banned)))


def word_pattern(words: list[str]) -> str:
    return r"(?:^|[^A-Za-z])(?:" + "|".join(re.escape(w) for w in words) + r")(?:[^A-Za-z]|$)"


# --- deduplication and flags -------------------------------------------------


def merge_duplicates(df: DataFrame, key: str, values: list[str], flags: list[str], digits: int = 6) -> DataFrame:
    """Rows of one key whose values agree to ``digits`` become one: flags by max, values kept.

    Grouping on the rounded numbers replaces a text key.  The kept values are
    those of the smallest row, so the result does not depend on row order.
    """
    rounded = {f"_r{i}": F.round(v, digits) for i, v in enumerate(values)}
    kept = F.min(F.struct(*values)).alias("_kept")
    merged = df.withColumns(rounded).groupBy(key, *rounded).agg(*[F.max(f).alias(f) for f in flags], kept)
    return merged.select(key, *flags, *[F.col("_kept")[v].alias(v) for v in values])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key under ``order`` (then the other columns), NULL after every value: an
    aggregation, so it combines map-side and no key is sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    lead = order + [c for c in rest if c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*nulls_last(lead))).alias("_row"))
    return first.select(*keys, *[F.col("_row")[c].alias(c) for c in lead if c not in keys])


def nulls_last(names: list[str]) -> list[Column]:
    """Columns for a struct to order by: each after a flag that puts its NULLs last."""
    return [c for name in names for c in (F.col(name).isNull().alias(f"_null_{name}"), F.col(name))]


def mark_first(df: DataFrame, key: str, order: list[str], first: str = "A", later: str = "B") -> DataFrame:
    """Collapse equal rows to ``copies`` and prefix the key text: the first row of a key
    under ``order`` gets ``first``, every later one ``later``.

    NULL comes after every value.  Of several copies of the first row one is first and
    the rest are later.  The minimum per key is aggregated and joined back; no window per key.
    """
    columns = df.columns
    lead = nulls_last(order + [c for c in columns if c not in order and c != key])
    distinct = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    smallest = distinct.groupBy(key).agg(F.min(F.struct(*lead)).alias("_min"))
    joined = distinct.join(smallest, key).withColumn("_first", F.struct(*lead) == F.col("_min"))
    tags = F.when(
        F.col("_first"),
        F.array(
            F.struct(F.lit(first).alias("tag"), F.lit(1).cast("long").alias("n")),
            F.struct(F.lit(later).alias("tag"), (F.col("copies") - 1).alias("n")),
        ),
    ).otherwise(F.array(F.struct(F.lit(later).alias("tag"), F.col("copies").alias("n"))))
    spread = joined.select(*columns, F.explode(tags).alias("_t")).filter("_t.n > 0")
    named = F.concat(F.col("_t.tag"), F.col(key).cast("string"))
    return spread.select(named.alias(key), *all_but(df, key), F.col("_t.n").alias("copies"))


def drop_shadowed(df: DataFrame, keys: list[str], detail: str) -> DataFrame:
    """Drop exact copies, then rows with NULL ``detail`` whose keys occur on another row.

    Among distinct rows of one key at most one has NULL detail, so it is shadowed
    exactly when a row with detail exists: an anti join of the NULL-detail rows
    against the keys of the others.
    """
    columns = df.columns
    rest = [c for c in columns if c not in keys and c != detail]
    if rest:
        raise ValueError(f"columns {rest} are neither key nor detail")
    full = df.filter(F.col(detail).isNotNull()).distinct()
    bare = df.filter(F.col(detail).isNull()).distinct()
    alone = bare.join(full.select(*keys), keys, "left_anti")
    return full.unionByName(alone.select(*columns))


def min_max_position(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Position of a value between its key's min and max, in [0, 1]; a constant key gives 1."""
    bounds = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    place = F.when(width == 0, 1.0).otherwise(F.try_divide(F.col(value) - F.col("_lo"), width))
    return df.join(bounds, key).withColumn(out, place).drop("_lo", "_hi")


# --- ids ---------------------------------------------------------------------


def ids_by_first_seen(df: DataFrame, key: str, order: list[str], out: str = "id") -> DataFrame:
    """(key, id): dense ids from 0 in order of first appearance."""
    seen = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_pos"))
    numbered = row_numbers(seen, [], ["_pos", key], out)
    return numbered.select(key, (F.col(out) - 1).alias(out))


def ids_by_frequency(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    """(key, n, id): dense ids from 0, most frequent first, ties by key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    numbered = row_numbers(counts, [], [F.desc("n"), F.asc(key)], out)
    return numbered.select(key, "n", (F.col(out) - 1).alias(out))


def surrogate_ids(df: DataFrame, order: list | None = None, out: str = "row_id") -> DataFrame:
    """Dense row numbers from 0 under a total order, cut into slices; without an order no row is moved."""
    if not order:
        return row_ids(df, out)
    numbered = row_numbers(df, [], order, out)
    return numbered.withColumn(out, F.col(out) - 1)


# --- shape changes -----------------------------------------------------------


def pivot_first(df: DataFrame, keys: list[str], column: str, values: list[str], value: str, order: list[str]) -> DataFrame:
    """Pivot with the first value under ``order`` that is not NULL; the value list is given, so no extra pass."""
    picked = F.min(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_value"))))
    wide = df.groupBy(*keys).pivot(column, values).agg(picked)
    return wide.select(*keys, *[F.col(f"`{v}`._value").alias(v) for v in values])


def regroup(df: DataFrame, key: str, order: list[str], values: list[str], chunk: int | None = None) -> DataFrame:
    """Long rows to parallel lists: (key, one array per value), sorted by ``order`` and then by the values.

    Each key gives one row with its whole lists.  With ``chunk``, for keys too large for
    a row, (key, base, one array per value): lists of at most ``chunk`` entries, where
    ``base`` is the number of the key's entries before, so that base + place is the place
    in the whole list.
    """
    lead = order + [v for v in values if v not in order]
    if chunk is None:
        rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*lead))).alias("_items"))
        return rows.select(key, *[F.col("_items")[v].alias(v) for v in values])
    numbered = row_numbers(df, [key], lead, "_rn")
    placed = numbered.withColumn("base", (F.floor((F.col("_rn") - 1) / chunk) * chunk).cast("long"))
    items = F.sort_array(F.collect_list(F.struct("_rn", *values)))
    rows = placed.groupBy(key, "base").agg(items.alias("_items"))
    return rows.select(key, "base", *[F.col("_items")[v].alias(v) for v in values])


def stage_report(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(step, rule, before, removed, after) of successive row filters in a single pass.

    Each row is charged to the first rule it fails (a NULL verdict fails).
    """
    failed = F.lit(len(rules))
    for i in range(len(rules) - 1, -1, -1):
        failed = F.when(F.coalesce(rules[i][1], F.lit(False)), failed).otherwise(F.lit(i))
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(failed == i, 1)).alias(f"r{i}") for i in range(len(rules))],
    )
    steps, gone = [], F.lit(0).cast("long")
    for i, (name, _) in enumerate(rules):
        before = F.col("total") - gone
        gone = gone + F.col(f"r{i}")
        steps.append(
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(name).alias("rule"),
                before.alias("before"),
                F.col(f"r{i}").alias("removed"),
                (F.col("total") - gone).alias("after"),
            )
        )
    return counts.select(F.inline(F.array(*steps)))
