"""Stand-in views over the test tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 64  # length of the embedding vectors in the test tables


def round_to(column: Column | str, digits: int = 6) -> Column:
    """Round a double in place: nearest integer of x * 10^digits, divided back.

    Unlike the built-in round it does not go through decimals, and it keeps the
    sign of zero as the checking engine does.
    """
    value = F.col(column) if isinstance(column, str) else column
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixture_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per component entry of a stimulus."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stimulus"),
        F.col("l_partkey").alias("cid"),
        F.col("l_discount").alias("dilution"),
        F.col("l_returnflag").alias("solvent"),
        F.col("l_suppkey").alias("component"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, vec) with doubles."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
    )


def vector_count(spark: SparkSession, sf_dir: str) -> Column:
    """count(*) of the vectors as a scalar subquery."""
    return table(spark, sf_dir, "embeddings").select(F.count(F.lit(1))).scalar()


def long_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, dim, v)."""
    return vectors(spark, sf_dir).select("vec_id", F.posexplode("vec").alias("dim", "v"))


def linked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component entries with ``vec_id``, the link to their component's vector."""
    return mixture_component(spark, sf_dir).withColumn(
        "vec_id", F.col("cid") % vector_count(spark, sf_dir)
    )


def stimulus_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse non-negative ratings: (row_id, dim, y)."""
    return long_vectors(spark, sf_dir).select(
        F.col("vec_id").alias("row_id"), "dim", F.greatest("v", F.lit(0.0)).alias("y")
    )


def _pairs(spark: SparkSession, sf_dir: str, clip: bool) -> DataFrame:
    truth = vectors(spark, sf_dir).select(
        F.col("vec_id").alias("row_id"),
        F.col("vec").alias("y"),
        ((F.col("vec_id") + 1) % vector_count(spark, sf_dir)).alias("other"),
    )
    guess = vectors(spark, sf_dir).select(F.col("vec_id").alias("other"), F.col("vec").alias("y_hat"))
    both = truth.join(guess, "other").select(
        "row_id", F.posexplode(F.arrays_zip("y", "y_hat")).alias("dim", "pair")
    )
    y = F.col("pair.y")
    return both.select(
        "row_id",
        "dim",
        (F.greatest(y, F.lit(0.0)) if clip else y).alias("y"),
        F.col("pair.y_hat").alias("y_hat"),
    )


def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, dim, y, y_hat): clipped ratings against the next row's vector."""
    return _pairs(spark, sf_dir, clip=True)


def signed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``prediction`` without clipping."""
    return _pairs(spark, sf_dir, clip=False)


def stimulus_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated stimuli (finished orders) with their rating vector."""
    rated = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    keyed = rated.select(
        F.col("o_orderkey").alias("stimulus"),
        (F.col("o_orderkey") % vector_count(spark, sf_dir)).alias("vec_id"),
    )
    ratings = vectors(spark, sf_dir).select(
        "vec_id", F.transform("vec", lambda x: F.greatest(x, F.lit(0.0))).alias("rating")
    )
    return keyed.join(ratings, "vec_id").select("stimulus", F.col("vec_id").alias("rating_row"), "rating")


# --- SQL fragments -----------------------------------------------------------

CTE = {
    "mc": "SELECT l_orderkey AS stimulus, l_partkey AS cid, l_discount AS dilution, "
    "l_returnflag AS solvent, l_suppkey AS component FROM lineitem",
    "nv": "SELECT count(*) AS n FROM embeddings",
    "el": "SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, "
    "CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "lab": "SELECT vec_id AS row_id, dim, greatest(v, 0) AS y FROM el",
    "pr": "SELECT a.vec_id AS row_id, a.dim, greatest(a.v, 0) AS y, b.v AS y_hat "
    "FROM el a JOIN el b ON b.vec_id = (a.vec_id + 1) % (SELECT n FROM nv) AND b.dim = a.dim",
    "sp": "SELECT a.vec_id AS row_id, a.dim, a.v AS y, b.v AS y_hat "
    "FROM el a JOIN el b ON b.vec_id = (a.vec_id + 1) % (SELECT n FROM nv) AND b.dim = a.dim",
    "sr": "SELECT o_orderkey AS stimulus, o_orderkey % (SELECT n FROM nv) AS rating_row "
    "FROM orders WHERE o_orderstatus = 'F'",
    "sz": "SELECT l_orderkey AS stimulus, count(*) AS n FROM lineitem GROUP BY 1",
}


def with_views(names: str, body: str, **more: str) -> str:
    """SQL text with the named views, then ``more``, as common table expressions."""
    parts = [f"{n} AS ({CTE[n]})" for n in names.split()]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH " + ", ".join(parts) + " " + body
