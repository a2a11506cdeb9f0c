"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"  # the white space of the text contracts: [\x20\x09-\x0D]


BATCH_ROWS = 1000
BATCH_BYTES = 16 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Limits Arrow batches in this session: rows hold whole texts here, and the usual
    10,000 of them would be many megabytes in the JVM and in Python at once."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_white_space(text: Column) -> Column:
    """The text with every white-space character deleted; NULL counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for char in WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def size_in_words(text: Column) -> Column:
    """Number of maximal runs of other characters than white space; NULL has none.

    Each run is replaced by one letter and the letters are counted, which makes no
    object for each word as a list of matches would.
    """
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), "[^ \\t-\\r]+", "w")
    return F.length(without_white_space(letters)).cast("long")
