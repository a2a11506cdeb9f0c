"""Vector scoring: linear layers, conditioning, gating, normalisation, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.functions.numeric import activation
from medley.operators.pooling import dot


def add_fractions(vec: str, fractions: str, how: str) -> Column:
    """'concat' appends the fractions; 'multiply' scales every entry, a missing fraction is 1."""
    if how == "concat":
        return F.concat(vec, fractions)
    if how == "multiply":
        factor = F.coalesce(F.get(F.col(fractions), F.lit(0)), F.lit(1.0))
        return F.transform(vec, lambda x: x * factor)
    raise ValueError("how must be 'concat' or 'multiply'")


def linear(rows: DataFrame, key: str, vec: str, parameters: DataFrame) -> DataFrame:
    """(key, out, score): x W^T + b with ``parameters(out, w, bias)``.

    The parameter table is a model, a few vectors: it rides along as one scalar
    subquery and every row scores itself in place, without a join or a shuffle.
    """
    packed = parameters.agg(F.sort_array(F.collect_list(F.struct("out", "w", "bias"))).alias("model"))
    scored = rows.select(key, vec).withColumn("_model", packed.scalar())
    each = scored.select(key, vec, F.explode("_model").alias("_m"))
    return each.select(key, F.col("_m.out").alias("out"), (dot(F.col(vec), F.col("_m.w")) + F.col("_m.bias")).alias("score"))


def film(rows: DataFrame, key: str, vec: str, condition: str, gamma: DataFrame, beta: DataFrame, act: str) -> DataFrame:
    """(key, out, score): act(gamma(c)) * x + act(beta(c)); ``out`` is the dim of x.

    Both layers ride along as one scalar subquery, so a row conditions itself in place.
    """
    layers = gamma.select("out", F.col("w").alias("gw"), F.col("bias").alias("gb")).join(
        beta.select("out", F.col("w").alias("bw"), F.col("bias").alias("bb")), "out"
    )
    packed = layers.agg(F.sort_array(F.collect_list(F.struct("out", "gw", "gb", "bw", "bb"))).alias("model"))
    each = rows.select(key, vec, condition).withColumn("_model", packed.scalar())
    each = each.select(key, vec, condition, F.explode("_model").alias("_m")).filter(
        (F.col("_m.out") >= 0) & (F.col("_m.out") < F.size(vec))
    )
    scale = activation(act, dot(F.col(condition), F.col("_m.gw")) + F.col("_m.gb"))
    shift = activation(act, dot(F.col(condition), F.col("_m.bw")) + F.col("_m.bb"))
    return each.select(key, F.col("_m.out").alias("out"), (scale * F.get(F.col(vec), F.col("_m.out")) + shift).alias("score"))


def gated(gate: Column, value: Column) -> Column:
    """Value where the gate is on, else 0."""
    return F.when(gate, value).otherwise(F.lit(0.0))


def hurdle_outputs(logit: Column, raw: Column) -> tuple[Column, Column]:
    """(gate probability, positive part) of a two-output head."""
    return activation("sigmoid", logit), activation("softplus", raw)


def partial_normalise(cells: DataFrame, kind: str, eps: float = 1e-6) -> DataFrame:
    """Scale y and y_hat of dims >= 2 with the truth's statistics per dim; dims 0-1 unchanged.

    'zscore': (x - mean) / (std + eps); 'minmax': (x - min) / (max - min + eps).
    """
    if kind == "zscore":
        stats = [F.avg("y").alias("_shift"), (F.stddev_samp("y") + eps).alias("_scale")]
    elif kind == "minmax":
        stats = [F.min("y").alias("_shift"), (F.max("y") - F.min("y") + eps).alias("_scale")]
    else:
        raise ValueError("kind must be 'zscore' or 'minmax'")
    per_dim = cells.groupBy("dim").agg(*stats)
    scaled = lambda c: F.when(F.col("dim") < 2, F.col(c)).otherwise((F.col(c) - F.col("_shift")) / F.col("_scale"))
    joined = cells.join(per_dim, "dim")
    return joined.withColumns({"y": scaled("y"), "y_hat": scaled("y_hat")}).drop("_shift", "_scale")


def split_parts(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dims 0-1, dims from 2 on)."""
    return cells.filter("dim < 2"), cells.filter("dim >= 2")


def directed_edges(bonds: DataFrame, graph: str, src: str = "src", dst: str = "dst", ordered: bool = True) -> DataFrame:
    """Both directions of every undirected bond; ``ordered``: each graph together, by (src, dst).

    One explode instead of a union, so the bonds are read once.  Graphs are placed by
    hash and sorted where they lie: no order between graphs, and no range sort.
    """
    rest = [c for c in bonds.columns if c not in (src, dst)]
    ends = F.explode(
        F.array(F.struct(F.col(src).alias("s"), F.col(dst).alias("d")), F.struct(F.col(dst).alias("s"), F.col(src).alias("d")))
    )
    both = bonds.select(*rest, ends.alias("_e"))
    edges = both.select(*rest, F.col("_e.s").alias(src), F.col("_e.d").alias(dst))
    return edges.repartition(graph).sortWithinPartitions(graph, src, dst) if ordered else edges
