"""Find keys that hold an outsized share of the rows, and treat them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_BYTES = 64 * 1024 * 1024  # of rows with their vectors, per task
SHARE = 5_000  # a key with more than 1 / SHARE of all rows is outsized; there can be no more than SHARE
SKETCH = 4 * SHARE  # keys tracked: the sketch is sure to hold every key above 4 / (3 * SKETCH) of the rows


def tasks_of(df: DataFrame, row_bytes: int) -> int:
    """Tasks that the rows of ``df`` need when a row takes ``row_bytes`` where it is sorted or grouped.

    Adaptive coalescing fills a task with packed bytes, of which narrow rows take a tenth of that.
    """
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-df.count() * row_bytes // TASK_BYTES))


def profile(df: DataFrame, key: str, row_bytes: int, threshold: int | None = None) -> tuple[int, list]:
    """(tasks, outsized keys) for rows that take ``row_bytes`` each once they are wide.

    The rows are counted and their keys sketched in one scan of the key column.
    Tasks follow the bytes, since adaptive coalescing would only see the narrow
    rows.  A key is outsized when it holds more than its share of all rows and more
    than one task should take; ``threshold`` rows may be given instead.  The list
    steers the plan and never changes a result.
    """
    return counted_profile(df, key, row_bytes, threshold)[1:]


def counted_profile(df: DataFrame, key: str, row_bytes: int, threshold: int | None = None) -> tuple[int, int, list]:
    """(rows, tasks, outsized keys): ``profile`` with the number of rows."""
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(`{key}`, {SHARE}, {SKETCH})").alias("top")).first()
    per_task = max(1, TASK_BYTES // max(1, row_bytes))
    limit = max(per_task, found["rows"] // SHARE) if threshold is None else threshold
    hot = [i["item"] for i in found["top"] or [] if i["item"] is not None and i["count"] > limit]
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found["rows"], max(floor, -(-found["rows"] // per_task)), hot


def placed(df: DataFrame, key: str, row_bytes: int, threshold: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows with their key in one of as many tasks as their number needs, rows of outsized keys where they lie or None)."""
    tasks, hot = profile(df, key, row_bytes, threshold)
    ordinary, outsized = split_hot(df, key, hot)
    return ordinary.repartition(tasks, key), outsized


def split_hot(df: DataFrame, key: str, hot: list) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None)."""
    if not hot:
        return df, None
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return df.filter(~is_hot), df.filter(is_hot)
