"""Loss scores over the prediction views, one row each."""

from __future__ import annotations

from pyspark.sql import functions as F

from medley.functions import losses as L
from medley.operators import scores as S
from medley.plans import views as V
from medley.plans.registry import query

PR = "nv el pr"
SP = "nv el sp"
E2 = "(y_hat - y) * (y_hat - y)"
BCE = "greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))"
TW = ("greatest(y, 1e-6) * pow(greatest(y_hat, 1e-6), 1 - 1.8::DOUBLE) / (1 - 1.8::DOUBLE)"
      " - pow(greatest(y_hat, 1e-6), 2 - 1.8::DOUBLE) / (2 - 1.8::DOUBLE)")
HUB = "CASE WHEN abs(y_hat - y) < {d} THEN 0.5 * {e2} / {d} ELSE abs(y_hat - y) - 0.5 * {d} END".format(d="0.1::DOUBLE", e2=E2)


def _score(name: str, expr: str, view: str = "pr", digits: int = 6):
    views = PR if view == "pr" else SP
    sql = V.with_views(views, f"SELECT round({expr}, {digits}) AS score FROM {view}")

    def register(build):
        def run(spark, sf):
            cells = (V.prediction if view == "pr" else V.signed_pair)(spark, sf)
            return cells.agg(V.round_to(build(), digits).alias("score"))

        query(name, sql)(run)
        return build

    return register


@_score("L1_tweedie", f"avg({TW})")
def tweedie():
    return L.tweedie(1.8)


@_score("L2_weighted_mse", f"0.7 * avg({E2}) FILTER (WHERE dim < 2) + 1.3 * avg({E2}) FILTER (WHERE dim >= 2)")
def weighted_mse():
    return L.weighted_mse(0.7, 1.3)


@_score(
    "L3_uncertainty",
    f"exp(-0.2::DOUBLE) * avg({E2}) + 0.2 + exp(0.1::DOUBLE) * avg(abs(y_hat - y)) - 0.1",
)
def uncertainty():
    return L.uncertainty([L.mse(), L.mae()], [0.2, -0.1])


@_score("L4_huber", f"avg({HUB})", "sp")
def huber():
    return L.huber(0.1)


@_score("L5_log_cosh", "avg(ln(cosh(y_hat - y)))", "sp")
def log_cosh():
    return L.log_cosh()


@_score("L6_pinball", "avg(greatest(0.3 * (y - y_hat), (0.3 - 1) * (y - y_hat)))", "sp")
def pinball():
    return L.pinball(0.3)


@query(
    "L7_column_weighted_mse",
    V.with_views(
        PR,
        f"SELECT round(avg(weight * {E2}), 6) AS score FROM pr JOIN wt USING (dim)",
        wt="SELECT dim, 1 / (1 + avg(y)) AS weight FROM pr GROUP BY dim",
    ),
)
def column_weighted(spark, sf):
    cells = V.prediction(spark, sf)
    weights = cells.groupBy("dim").agg((1 / (1 + F.avg("y"))).alias("weight"))
    return S.column_weighted_mse(cells, weights).select(V.round_to("score", 6).alias("score"))


@_score(
    "L8_tweedie_huber",
    f"coalesce(avg({TW}) FILTER (WHERE y = 0), 0) + coalesce(avg({HUB}) FILTER (WHERE y <> 0), 0)",
)
def tweedie_huber():
    return L.tweedie_huber(1.8, 0.1)


@_score(
    "L9_hurdle",
    "avg(CASE WHEN y > 0 THEN -ln(least(greatest(1 / (1 + exp(-10 * (y_hat - 0.1))), 1e-6), 1 - 1e-6)) "
    "ELSE -ln(1 - least(greatest(1 / (1 + exp(-10 * (y_hat - 0.1))), 1e-6), 1 - 1e-6)) END) "
    f"+ avg(CASE WHEN y > 0 THEN {E2} ELSE 0 END)",
)
def hurdle():
    return L.hurdle(0.1, 10.0, 1.0, 1.0)


@query(
    "L10_two_output_hurdle",
    V.with_views(
        PR,
        f"""SELECT round(avg({BCE}) / greatest(sum(t), 1) + sum(t * (p - y) * (p - y)) / greatest(sum(t), 1), 6) AS score
        FROM (SELECT y, greatest(y_hat, 0) AS p, 10 * (y_hat - 0.1) AS x, CAST(y > 0 AS DOUBLE) AS t FROM pr)""",
    ),
)
def two_output(spark, sf):
    cells = V.prediction(spark, sf).select(
        "y", F.greatest("y_hat", F.lit(0.0)).alias("y_hat"), (10 * (F.col("y_hat") - 0.1)).alias("logit")
    )
    return cells.agg(V.round_to(L.two_output_hurdle(), 6).alias("score"))


_COMPOSITE_PARTS = f"""(SELECT avg({BCE}) AS bce, sqrt(avg((x - y) * (x - y)) + 1e-6) AS rmse
 FROM (SELECT y, y_hat AS x, CAST(y > 0 AS DOUBLE) AS t FROM pr))"""
_COS_PART = """(SELECT 1 - avg(s / greatest(n, 1e-8)) AS cosine FROM
 (SELECT sum(y * y_hat) AS s, sqrt(sum(y * y)) * sqrt(sum(y_hat * y_hat)) AS n FROM pr GROUP BY row_id))"""


@query(
    "L11_composite",
    V.with_views(
        PR,
        f"""SELECT round(0.5 * bce + 1.0 * rmse + 0.8 * pearson + 0.3 * cosine, 6) AS score FROM {_COMPOSITE_PARTS}, {_COS_PART},
        (SELECT avg(1 - c / (sqrt(vp + 1e-6) * sqrt(vy + 1e-6))) AS pearson FROM (SELECT covar_pop(y, y_hat) * count(*) AS c,
         var_pop(y_hat) * count(*) AS vp, var_pop(y) * count(*) AS vy FROM pr GROUP BY row_id))""",
    ),
)
def composite(spark, sf):
    scored = S.composite(V.prediction(spark, sf), alpha=0.5, beta=1.0, gamma=0.8, delta=0.3)
    return scored.select(V.round_to("score", 6).alias("score"))


@query(
    "L12_composite_uncertain",
    V.with_views(
        PR,
        f"""SELECT round(bce * exp(-0.1::DOUBLE) + 0.1 + rmse * exp(-0.2::DOUBLE) + 0.2 + pearson * exp(-0.3::DOUBLE) + 0.3
          + cosine * exp(-0.4::DOUBLE) + 0.4, 6) AS score FROM {_COMPOSITE_PARTS}, {_COS_PART},
        (SELECT 1 - avg((y_hat - mp) * (y - my)) / (sqrt(avg((y_hat - mp) ** 2) * avg((y - my) ** 2)) + 1e-6) AS pearson
         FROM pr JOIN (SELECT dim, avg(y) AS my, avg(y_hat) AS mp FROM pr GROUP BY dim) USING (dim))""",
    ),
)
def composite_uncertain(spark, sf):
    scored = S.composite_uncertain(V.prediction(spark, sf), [0.1, 0.2, 0.3, 0.4])
    return scored.select(V.round_to("score", 6).alias("score"))


@query(
    "L13_focal",
    V.with_views(
        PR,
        f"""SELECT round(avg((0.25 * t + 0.75 * (1 - t)) * ({BCE}) * pow(1 - (s * t + (1 - s) * (1 - t)), 2)), 6) AS score
        FROM (SELECT y_hat AS x, 1 / (1 + exp(-y_hat)) AS s, CAST(y > 0 AS DOUBLE) AS t FROM pr)""",
    ),
)
def focal(spark, sf):
    return V.prediction(spark, sf).agg(V.round_to(L.focal(), 6).alias("score"))


@query(
    "L14_mae_mse_bce",
    V.with_views(
        PR,
        f"""SELECT round(avg(abs(x - t)), 6) AS mae, round(avg((x - t) * (x - t)), 6) AS mse, round(avg({BCE}), 6) AS bce
        FROM (SELECT y_hat AS x, y AS t FROM pr)""",
    ),
)
def basics(spark, sf):
    return V.prediction(spark, sf).agg(
        *[V.round_to(L.loss(n), 6).alias(n) for n in ("mae", "mse", "bce")]
    )


@_score(
    "L15_two_part",
    "0.6 * avg((y_hat - y) * (y_hat - y)) FILTER (WHERE dim < 2) + 1.4 * avg(ln(cosh(y_hat - y))) FILTER (WHERE dim >= 2)",
)
def two_part():
    return L.two_part("logcosh", 0.6, 1.4)


@_score(
    "L15_two_part_uncertain",
    f"avg({E2}) FILTER (WHERE dim < 2) + avg({HUB}) FILTER (WHERE dim >= 2)",
)
def two_part_uncertain():
    return L.two_part("huber", uncertain=True, delta=0.1)


def _two_part(name: str, loss: str, rest: str, **options):
    """A two-part objective 0.6 * MSE(dims 0-1) + 1.4 * rest, as query and SQL."""
    sql = V.with_views(
        PR,
        f"""SELECT round(0.6::DOUBLE * (SELECT avg({E2}) FROM pr WHERE dim < 2) + 1.4::DOUBLE * ({rest}), 6) AS score""",
        rp="SELECT row_id, dim - 2 AS dim, y, y_hat FROM pr WHERE dim >= 2",
    )

    def run(spark, sf):
        chosen = dict(options)
        if "weights" in chosen:
            dims = spark.range(V.DIMS - 2).select(F.col("id").cast("int").alias("dim"))
            chosen["weights"] = dims.withColumn("weight", F.lit(1) + F.col("dim") % 3)
        scored = S.two_part(V.prediction(spark, sf), loss, 0.6, 1.4, **chosen)
        return scored.select(V.round_to("score", 6).alias("score"))

    query(name, sql)(run)


_two_part(
    "L15_two_part_mixed",
    "mixed",
    f"""SELECT coalesce(avg({TW}) FILTER (WHERE y = 0), 0) + coalesce(avg({HUB}) FILTER (WHERE y <> 0), 0) FROM rp""",
    delta=0.1,
)
_two_part(
    "L15_two_part_weighted_columns",
    "column_weighted",
    f"SELECT sum((1 + dim % 3) * {E2}) / count(*) FROM rp",
    weights=None,
)
_two_part(
    "L15_two_part_composite",
    "combined",
    """SELECT 0.5 * bce + 1.0 * rmse + 0.8 * pearson + 0.3 * cosine FROM
    (SELECT avg(greatest(y_hat, 0) - y_hat * CAST(y > 0 AS INTEGER) + ln(1 + exp(-abs(y_hat)))) AS bce,
      sqrt(avg((y_hat - y) * (y_hat - y)) + 1e-6) AS rmse FROM rp),
    (SELECT 1 - avg(s / greatest(n, 1e-8)) AS cosine, avg(1 - c / (sqrt(vp + 1e-6) * sqrt(vy + 1e-6))) AS pearson FROM
     (SELECT sum(y * y_hat) AS s, sqrt(sum(y * y)) * sqrt(sum(y_hat * y_hat)) AS n, covar_pop(y, y_hat) * count(*) AS c,
       var_pop(y_hat) * count(*) AS vp, var_pop(y) * count(*) AS vy FROM rp GROUP BY row_id))""",
    alpha=0.5,
    beta=1.0,
    gamma=0.8,
    delta=0.3,
)
