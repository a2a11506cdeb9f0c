"""Similarity, error and rank metrics over the prediction views."""

from __future__ import annotations

from pyspark.sql import functions as F

from medley.functions.mixing import mix_sql
from medley.operators import explore as X
from medley.operators import metrics as M
from medley.operators import pooling as P
from medley.plans import views as V
from medley.plans.registry import query

R6 = V.round_to
PR = "nv el pr"
SP = "nv el sp"

CORR = "CASE WHEN min(y) = max(y) OR min(y_hat) = max(y_hat) THEN NULL ELSE corr(y, y_hat) END"
COS = "sum(y * y_hat) / nullif(sqrt(sum(y * y)) * sqrt(sum(y_hat * y_hat)), 0)"


@query("V1_row_cosine", V.with_views(PR, f"SELECT row_id, round({COS}, 6) AS cosine FROM pr GROUP BY row_id"))
def row_cosine(spark, sf):
    return M.row_cosine(V.prediction(spark, sf)).select("row_id", R6("cosine").alias("cosine"))


@query(
    "V1_mean_cosine",
    V.with_views(
        SP,
        f"SELECT round(avg(c), 6) AS cosine, round(avg(1 - c), 6) AS distance FROM "
        f"(SELECT {COS} AS c FROM sp GROUP BY row_id)",
    ),
)
def mean_cosine(spark, sf):
    rows = M.row_cosine(V.signed_pair(spark, sf))
    return rows.agg(R6(F.avg("cosine")).alias("cosine"), R6(F.avg(1 - F.col("cosine"))).alias("distance"))


ALL_PAIRS_SQL = V.with_views(
    PR,
    """SELECT round(avg(coalesce(d / nullif(na * nb, 0), 0)), 9) AS cosine FROM
    (SELECT a.row_id, b.row_id AS other, sum(a.y * b.y_hat) AS d, sqrt(sum(a.y * a.y)) AS na,
     sqrt(sum(b.y_hat * b.y_hat)) AS nb FROM pr a JOIN pr b ON a.dim = b.dim GROUP BY a.row_id, b.row_id)""",
)


@query("V2_all_pairs_cosine", ALL_PAIRS_SQL)
def all_pairs_cosine(spark, sf):
    return M.all_pairs_mean_cosine(V.prediction(spark, sf)).select(V.round_to("cosine", 9).alias("cosine"))


@query(
    "J10_truth_by_prediction",
    V.with_views(
        SP,
        """SELECT round(avg(d / (na * nb)), 9) AS cosine FROM
        (SELECT sum(a.y * b.y_hat) AS d, sqrt(sum(a.y * a.y)) AS na, sqrt(sum(b.y_hat * b.y_hat)) AS nb
         FROM sp a JOIN sp b ON a.dim = b.dim GROUP BY a.row_id, b.row_id)""",
    ),
)
def truth_by_prediction(spark, sf):
    return M.all_pairs_mean_cosine(V.signed_pair(spark, sf)).select(V.round_to("cosine", 9).alias("cosine"))


@query(
    "V3_row_pearson",
    V.with_views(PR, f"SELECT row_id, round({CORR}, 6) AS pearson FROM pr GROUP BY row_id"),
)
def row_pearson(spark, sf):
    return M.row_pearson(V.prediction(spark, sf)).select("row_id", R6("pearson").alias("pearson"))


@query(
    "V3_mean_row_pearson",
    V.with_views(PR, f"SELECT round(avg(r), 6) AS pearson FROM (SELECT {CORR} AS r FROM pr GROUP BY row_id)"),
)
def mean_row_pearson(spark, sf):
    scores = M.reduce_scores(M.row_pearson(V.prediction(spark, sf)), "pearson", "mean")
    return scores.select(R6("pearson").alias("pearson"))


@query(
    "V4_column_pearson",
    V.with_views(
        PR,
        f"""SELECT round(avg(r), 6) AS mean, round(sum(r), 6) AS sum, round(max(r), 6) AS max, round(min(r), 6) AS min
        FROM (SELECT {CORR} AS r FROM pr GROUP BY dim)""",
    ),
)
def column_pearson(spark, sf):
    scores = M.column_pearson(V.prediction(spark, sf))
    return scores.agg(*[R6(M.REDUCTIONS[r]("pearson")).alias(r) for r in ("mean", "sum", "max", "min")])


@query(
    "V4_column_pearson_none",
    V.with_views(PR, f"SELECT dim, round({CORR}, 6) AS pearson FROM pr GROUP BY dim"),
)
def column_pearson_none(spark, sf):
    scores = M.reduce_scores(M.column_pearson(V.prediction(spark, sf)), "pearson", "none")
    return scores.select("dim", R6("pearson").alias("pearson"))


_TAU = """sum(CAST(sign(a.y - b.y) * sign(a.y_hat - b.y_hat) AS DOUBLE))
 / sqrt(sum(CAST(a.y <> b.y AS INTEGER)) * CAST(sum(CAST(a.y_hat <> b.y_hat AS INTEGER)) AS DOUBLE))"""


@query(
    "V5_kendall_per_column",
    V.with_views(
        PR,
        f"""SELECT a.dim, round({_TAU}, 6) AS kendall FROM pr a JOIN pr b ON a.dim = b.dim AND a.row_id < b.row_id
        GROUP BY a.dim""",
    ),
)
def kendall(spark, sf):
    return M.kendall(V.prediction(spark, sf), ["dim"]).select("dim", R6("kendall").alias("kendall"))


@query(
    "V5_kendall_reduced",
    V.with_views(
        PR,
        f"""SELECT round(avg(t), 6) AS mean, round(sum(t), 6) AS sum, round(max(t), 6) AS max, round(min(t), 6) AS min
        FROM (SELECT {_TAU} AS t FROM pr a JOIN pr b ON a.dim = b.dim AND a.row_id < b.row_id GROUP BY a.dim)""",
    ),
)
def kendall_reduced(spark, sf):
    taus = M.kendall(V.prediction(spark, sf), ["dim"])
    return taus.agg(*[R6(M.REDUCTIONS[r]("kendall")).alias(r) for r in ("mean", "sum", "max", "min")])


@query(
    "V6_errors",
    V.with_views(
        PR,
        """SELECT round(avg(abs(y_hat - y)), 6) AS mae, round(avg((y_hat - y) * (y_hat - y)), 6) AS mse,
        round(sqrt(avg((y_hat - y) * (y_hat - y))), 6) AS rmse FROM pr""",
    ),
)
def errors(spark, sf):
    return M.errors(V.prediction(spark, sf)).select(*[R6(c).alias(c) for c in ("mae", "mse", "rmse")])


_R2 = "1 - sum((y - y_hat) * (y - y_hat)) / nullif(var_pop(y) * count(y), 0)"


@query(
    "V7_r2",
    V.with_views(PR, f"SELECT round(avg(r2), 6) AS r2 FROM (SELECT {_R2} AS r2 FROM pr GROUP BY dim)"),
)
def r2(spark, sf):
    return M.column_r2(V.prediction(spark, sf)).agg(R6(F.avg("r2")).alias("r2"))


@query(
    "V8_auroc",
    V.with_views(
        PR,
        """SELECT dim, round((sum(CASE WHEN y >= 0.1 THEN rk END) - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auroc FROM
        (SELECT dim, y, count(*) OVER (PARTITION BY dim) AS n, sum(CAST(y >= 0.1 AS INTEGER)) OVER (PARTITION BY dim)::DOUBLE AS p,
         rank() OVER (PARTITION BY dim ORDER BY y_hat) + (count(*) OVER (PARTITION BY dim, y_hat) - 1) / 2.0 AS rk FROM pr)
        GROUP BY dim, n, p""",
    ),
)
def auroc(spark, sf):
    flagged = V.prediction(spark, sf).withColumn("y", F.when(F.col("y") >= 0.1, 1.0).otherwise(0.0))
    return M.auroc(flagged, ["dim"]).select("dim", R6("auroc").alias("auroc"))


@query(
    "V8_auroc_task_flags",
    """WITH f AS (SELECT l.doc_id, d.n_chars AS score, t.task, t.flag FROM labels l JOIN documents d USING (doc_id),
      LATERAL (SELECT 'quality' AS task, l.quality AS flag UNION ALL SELECT 'toxic', l.toxic) t)
    SELECT task, round((sum(CASE WHEN flag = 1 THEN rk END) - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auroc FROM
    (SELECT task, flag, count(*) OVER (PARTITION BY task) AS n, sum(flag) OVER (PARTITION BY task)::DOUBLE AS p,
     rank() OVER (PARTITION BY task ORDER BY score) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS rk FROM f)
    GROUP BY task, n, p""",
)
def auroc_flags(spark, sf):
    labels = V.table(spark, sf, "labels")
    scores = V.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("y_hat"))
    flags = labels.select(
        "doc_id",
        F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("task", "y"),
    )
    cells = flags.join(scores, "doc_id").withColumn("y", F.col("y").cast("double"))
    return M.auroc(cells, ["task"]).select("task", R6("auroc").alias("auroc"))


@query(
    "V9_mask_accuracy",
    V.with_views(PR, "SELECT round(avg(CAST((y > 0.05) = (y_hat > 0.05) AS INTEGER)), 6) AS accuracy FROM pr"),
)
def mask_accuracy(spark, sf):
    scored = M.mask_accuracy(V.prediction(spark, sf), F.col("y") > 0.05, F.col("y_hat") > 0.05)
    return scored.select(R6("accuracy").alias("accuracy"))


@query(
    "V10_metric_bundle",
    V.with_views(
        PR,
        """SELECT round(pearson, 6) AS pearson, round(rmse, 6) AS rmse, round(kendall, 6) AS kendall FROM
        (SELECT corr(y, y_hat) AS pearson, sqrt(avg((y - y_hat) * (y - y_hat))) AS rmse FROM pr),
        (SELECT sum(CAST(sign(a.y - b.y) * sign(a.y_hat - b.y_hat) AS DOUBLE))
          / sqrt(sum(CAST(a.y <> b.y AS INTEGER)) * CAST(sum(CAST(a.y_hat <> b.y_hat AS INTEGER)) AS DOUBLE)) AS kendall
         FROM pr a JOIN pr b ON a.row_id * 64 + a.dim < b.row_id * 64 + b.dim)""",
    ),
)
def bundle(spark, sf):
    return M.bundle(V.prediction(spark, sf)).select(*[R6(c).alias(c) for c in ("pearson", "rmse", "kendall")])


@query(
    "V11_by_part",
    V.with_views(
        PR,
        f"""SELECT part, round(row_pearson, 6) AS row_pearson, round(cosine, 6) AS cosine,
        round(column_pearson, 6) AS column_pearson, round(r2, 6) AS r2 FROM
        (SELECT part, avg(rp) AS row_pearson, avg(cs) AS cosine FROM
          (SELECT CASE WHEN dim < 2 THEN 'first' ELSE 'rest' END AS part, row_id, {CORR} AS rp, {COS} AS cs
           FROM pr GROUP BY 1, 2) GROUP BY part) JOIN
        (SELECT part, avg(cp) AS column_pearson, avg(r2) AS r2 FROM
          (SELECT CASE WHEN dim < 2 THEN 'first' ELSE 'rest' END AS part, dim, {CORR} AS cp, {_R2} AS r2
           FROM pr GROUP BY 1, 2) GROUP BY part) USING (part)""",
    ),
)
def by_part(spark, sf):
    scores = M.by_part(V.prediction(spark, sf))
    return scores.select("part", *[R6(c).alias(c) for c in scores.columns if c != "part"])


_SUMS_SQL = """SELECT row_id, CAST(count(y) AS DOUBLE) AS n, sum((y_hat - y) * (y_hat - y)) AS se, sum(abs(y_hat - y)) AS ae,
 sum(y) AS sy, sum(y_hat) AS sp, sum(y * y) AS syy, sum(y_hat * y_hat) AS spp, sum(y * y_hat) AS syp FROM pr GROUP BY row_id"""
_METRIC_SQL = {
    "rmse": "sqrt(sum(w * se) / sum(w * n))",
    "pearson": "(sum(w * syp) - sum(w * sy) * sum(w * sp) / sum(w * n)) / sqrt("
    "(sum(w * syy) - sum(w * sy) * sum(w * sy) / sum(w * n)) * (sum(w * spp) - sum(w * sp) * sum(w * sp) / sum(w * n)))",
}


def _bootstrap_sql(metric: str, poisson: bool) -> str:
    if poisson:
        hashed = mix_sql("b", "row_id")
        weight = " + ".join(f"CAST(h >= {c} AS INTEGER)" for c in M.poisson_cuts())
        drawn = f"SELECT b, s.*, {weight} AS w FROM (SELECT b, s.*, {hashed} AS h FROM s, range(500) t(b)) s"
    else:
        drawn = (
            "SELECT d.b, r.*, 1 AS w FROM (SELECT b, "
            + mix_sql("b", "rn")
            + " % (SELECT count(*) FROM s) + 1 AS pick FROM r, range(500) t(b)) d JOIN r ON r.rn = d.pick"
        )
    return V.with_views(
        PR,
        f"""SELECT '{metric}' AS metric, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper
        FROM (SELECT b, {_METRIC_SQL[metric]} AS v FROM ({drawn}) GROUP BY b)""",
        s=_SUMS_SQL,
        r="SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM s",
    )


@query("V12_bootstrap_rmse", _bootstrap_sql("rmse", False))
def bootstrap_rmse(spark, sf):
    bounds = M.bootstrap(V.prediction(spark, sf), "rmse", method="resample")
    return bounds.select("metric", R6("lower").alias("lower"), R6("upper").alias("upper"))


@query("V12_bootstrap_pearson", _bootstrap_sql("pearson", False))
def bootstrap_pearson(spark, sf):
    bounds = M.bootstrap(V.prediction(spark, sf), "pearson", method="resample")
    return bounds.select("metric", R6("lower").alias("lower"), R6("upper").alias("upper"))


@query("V12_bootstrap_poisson", _bootstrap_sql("rmse", True))
def bootstrap_poisson(spark, sf):
    bounds = M.bootstrap(V.prediction(spark, sf), "rmse")
    return bounds.select("metric", R6("lower").alias("lower"), R6("upper").alias("upper"))


def _others_sql(value: str) -> str:
    return V.with_views(
        "el",
        f"""SELECT row_id, round(avg(d), 6) AS distance FROM (SELECT a.vec_id AS row_id, b.vec_id, {value} AS d
        FROM el a JOIN el b ON a.dim = b.dim AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id) GROUP BY row_id""",
    )


@query("V13_cosine_to_others", _others_sql("1 - sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)))"))
def cosine_to_others(spark, sf):
    found = X.mean_distance_to_others(V.vectors(spark, sf), "vec_id", "vec", "cosine")
    return found.select(F.col("vec_id").alias("row_id"), R6("distance").alias("distance"))


@query("V13_pearson_to_others", _others_sql("1 - corr(a.v, b.v)"))
def pearson_to_others(spark, sf):
    found = X.mean_distance_to_others(V.vectors(spark, sf), "vec_id", "vec", "pearson")
    return found.select(F.col("vec_id").alias("row_id"), R6("distance").alias("distance"))


@query("J9_squared_distance_to_others", _others_sql("sum((a.v - b.v) * (a.v - b.v))"))
def squared_to_others(spark, sf):
    found = X.mean_distance_to_others(V.vectors(spark, sf), "vec_id", "vec", "squared")
    return found.select(F.col("vec_id").alias("row_id"), R6("distance").alias("distance"))


# --- singles, mixtures and the additivity test -------------------------------

SINGLES = dict(
    rated="SELECT sr.stimulus, el.dim, greatest(el.v, 0) AS y FROM sr JOIN el ON el.vec_id = sr.rating_row",
    singles="SELECT mc.stimulus, mc.cid, mc.dilution FROM mc JOIN sz USING (stimulus) WHERE sz.n = 1",
    means="""SELECT s.cid, d.dim, count(r.y) AS n, coalesce(avg(r.y), 0) AS mean FROM singles s
      CROSS JOIN (SELECT CAST(unnest(range(64)) AS INTEGER) AS dim) d
      LEFT JOIN rated r ON r.stimulus = s.stimulus AND r.dim = d.dim GROUP BY s.cid, d.dim""",
)
SINGLE_VIEWS = "mc sz nv sr el"


@query(
    "G17_single_component_means",
    V.with_views(SINGLE_VIEWS, "SELECT cid, dim, n, round(mean, 6) AS mean FROM means", **SINGLES),
)
def single_means(spark, sf):
    cells = X.single_means(V.mixture_component(spark, sf), V.stimulus_rating(spark, sf), V.DIMS)
    return cells.select("cid", "dim", "n", R6("mean").alias("mean"))


@query(
    "G18_expected_mixture_rating",
    V.with_views(
        SINGLE_VIEWS,
        """SELECT mc.stimulus, m.dim, count(*) AS known, round(avg(m.mean), 6) AS expected FROM mc JOIN sz USING (stimulus)
        JOIN means m USING (cid) WHERE sz.n > 1 GROUP BY mc.stimulus, m.dim""",
        **SINGLES,
    ),
)
def expected_rating(spark, sf):
    cells = X.expected_ratings(V.mixture_component(spark, sf), V.stimulus_rating(spark, sf), V.DIMS)
    return cells.select("stimulus", "dim", "known", R6("expected").alias("expected"))


_HISTORY = """SELECT s.cid, s.dilution, sr.rating_row, count(*) AS n_obs FROM mc s JOIN sz USING (stimulus) JOIN sr USING (stimulus)
 WHERE sz.n = 1 GROUP BY 1, 2, 3"""


@query("G19_component_history", V.with_views("mc sz nv sr", "SELECT * FROM h", h=_HISTORY))
def history(spark, sf):
    return X.component_history(V.mixture_component(spark, sf), V.stimulus_rating(spark, sf))


@query(
    "G19_mixture_history",
    V.with_views(
        "mc sz nv sr",
        """SELECT m.stimulus, m.cid, m.n_entries, CAST(sum(n_obs) AS BIGINT) AS observations, count(*) AS "distinct", min(dilution) AS low, max(dilution) AS high
        FROM (SELECT stimulus, cid, count(*) AS n_entries FROM mc JOIN sz USING (stimulus) WHERE sz.n > 1 GROUP BY ALL) m JOIN h USING (cid)
        GROUP BY m.stimulus, m.cid, m.n_entries""",
        h=_HISTORY,
    ),
)
def mixture_history(spark, sf):
    return X.mixture_history(V.mixture_component(spark, sf), V.stimulus_rating(spark, sf))


_RATING_SUM = "SELECT sr.rating_row, sum(greatest(el.v, 0)) AS total FROM (SELECT DISTINCT rating_row FROM sr) sr JOIN el ON el.vec_id = sr.rating_row GROUP BY 1"


@query(
    "G19_component_observations",
    V.with_views(
        "mc sz nv sr el",
        "SELECT cid, dilution, rating_row, CAST(64 AS INTEGER) AS dims, round(total, 6) AS total, n_obs FROM h JOIN rt USING (rating_row)",
        h=_HISTORY,
        rt=_RATING_SUM,
    ),
)
def component_observations(spark, sf):
    found = X.component_observations(V.mixture_component(spark, sf), V.stimulus_rating(spark, sf))
    return _with_totals(found, "cid", "dilution", "rating_row")


def _with_totals(found, *keys):
    total = F.aggregate("rating", F.lit(0.0), lambda s, x: s + x)
    return found.select(*keys, F.size("rating").alias("dims"), R6(total).alias("total"), "n_obs")


@query(
    "G19_mixture_observations",
    V.with_views(
        "mc sz nv sr el",
        """SELECT m.stimulus, m.cid, dilution, rating_row, CAST(64 AS INTEGER) AS dims, round(total, 6) AS total, n_obs
        FROM (SELECT DISTINCT stimulus, cid FROM mc JOIN sz USING (stimulus) WHERE sz.n > 1) m JOIN h USING (cid) JOIN rt USING (rating_row)""",
        h=_HISTORY,
        rt=_RATING_SUM,
    ),
)
def mixture_observations(spark, sf):
    found = X.mixture_observations(V.mixture_component(spark, sf), V.stimulus_rating(spark, sf))
    return _with_totals(found, "stimulus", "cid", "dilution", "rating_row")


_CHAIN = """SELECT mc.stimulus, r.dim, r.y, avg(m.mean) AS y_hat FROM mc JOIN sz USING (stimulus) JOIN means m USING (cid)
 JOIN rated r ON r.stimulus = mc.stimulus AND r.dim = m.dim WHERE sz.n > 1 AND m.n > 0 GROUP BY mc.stimulus, r.dim, r.y
 HAVING count(*) = max(sz.n)"""


@query(
    "J12_composed_lookup",
    V.with_views(
        SINGLE_VIEWS,
        "SELECT stimulus, dim, round(y, 6) AS y, round(y_hat, 6) AS y_hat FROM chain",
        **SINGLES,
        chain=_CHAIN,
    ),
)
def composed_lookup(spark, sf):
    cells = X.measured_against_components(V.mixture_component(spark, sf), V.stimulus_rating(spark, sf), V.DIMS)
    return cells.select("stimulus", "dim", R6("y").alias("y"), R6("y_hat").alias("y_hat"))


@query(
    "V14_additivity_test",
    V.with_views(
        SINGLE_VIEWS,
        f"""SELECT count(*) AS n, round(avg(1 - c), 6) AS cosine_distance, round(avg(r), 6) AS pearson FROM
        (SELECT stimulus, {COS} AS c, {CORR} AS r FROM chain GROUP BY stimulus)""",
        **SINGLES,
        chain=_CHAIN,
    ),
)
def additivity(spark, sf):
    scores = X.additivity_test(V.mixture_component(spark, sf), V.stimulus_rating(spark, sf), V.DIMS)
    return scores.select("n", R6("cosine_distance").alias("cosine_distance"), R6("pearson").alias("pearson"))
