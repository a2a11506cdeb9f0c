"""Reproducible hashing that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 15
RANGE = 16**DIGITS  # hashes are below this: 60 bits


def mix(seed: Column | int, value: Column | str) -> Column:
    """Pseudo-random integer in [0, RANGE) from (seed, value).

    The leading hexadecimal digits of the MD5 of 'seed:value': draws of different
    seeds are unrelated, and the range is far wider than any row count.
    """
    seed_col = F.lit(seed) if isinstance(seed, int) else seed
    value_col = F.col(value) if isinstance(value, str) else value
    text = F.concat(seed_col.cast("string"), F.lit(":"), value_col.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def mix_sql(seed: str, value: str) -> str:
    """The same hash as SQL text."""
    text = f"CAST(({seed}) AS VARCHAR) || ':' || CAST(({value}) AS VARCHAR)"
    return f"CAST('0x' || substr(md5({text}), 1, {DIGITS}) AS BIGINT)"
