"""List functions, vector scoring and the exploration reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from medley.functions import lists as A
from medley.functions import numeric as N
from medley.operators import explore as X
from medley.operators import joins as J
from medley.operators import ordered as O
from medley.operators import pooling as P
from medley.operators import scoring as S
from medley.operators import tidy as T
from medley.operators.hot import tasks_of
from medley.plans import views as V
from medley.plans.registry import query
from medley.plans.tidy_queries import definition_text

R6 = V.round_to

_POS = "CAST(row_number() OVER (PARTITION BY stimulus ORDER BY cid) - 1 AS INTEGER)"


@query("A1_split_list", V.with_views("mc", f"SELECT stimulus, {_POS} AS pos, cid FROM mc"))
def split_list(spark, sf):
    # a blank is appended to show that empty parts are dropped
    text = F.concat(F.col("components"), F.lit(";;"))
    return definition_text(spark, sf).select("stimulus", F.posexplode(A.split_list(text, "bigint")).alias("pos", "cid"))


@query(
    "A2_join_list",
    V.with_views("mc", "SELECT stimulus, string_agg(CAST(cid AS VARCHAR), ';' ORDER BY cid) AS components FROM mc GROUP BY stimulus"),
)
def join_list(spark, sf):
    return definition_text(spark, sf).select("stimulus", "components")


_PAR = "row_number() OVER (PARTITION BY stimulus ORDER BY cid, dilution, component)"


@query(
    "A3_explode_parallel",
    V.with_views(
        "mc",
        f"""SELECT stimulus, CAST({_PAR} - 1 AS INTEGER) AS pos, cid, dilution,
        CASE WHEN count(*) OVER (PARTITION BY stimulus) = 1 THEN NULL ELSE component END AS component FROM mc""",
    ),
)
def explode_parallel(spark, sf):
    entries = V.mixture_component(spark, sf).select("stimulus", "cid", "dilution", "component")
    rows = T.regroup(entries, "stimulus", ["cid", "dilution", "component"], ["cid", "dilution", "component"])
    lists = rows.withColumn("component", F.when(F.size("cid") > 1, F.col("component")))
    return A.explode_parallel(lists, ["cid", "dilution", "component"])


@query(
    "A4_map_elements",
    V.with_views("mc", """SELECT stimulus, string_agg(CASE solvent WHEN 'A' THEN '0' WHEN 'N' THEN '1' ELSE '2' END, ';' ORDER BY cid, solvent) AS codes
    FROM mc GROUP BY stimulus"""),
)
def map_elements(spark, sf):
    entries = V.mixture_component(spark, sf).select("stimulus", "cid", "solvent")
    rows = T.regroup(entries, "stimulus", ["cid", "solvent"], ["solvent"])
    return rows.select("stimulus", A.join_list(A.map_elements("solvent", {"A": 0, "N": 1, "R": 2})).alias("codes"))


@query("A5_flatten", V.with_views("mc", "SELECT cid, count(*) AS n FROM mc GROUP BY cid"))
def flatten(spark, sf):
    flat = definition_text(spark, sf).select(F.explode(A.split_list("components", "bigint")).alias("cid"))
    return flat.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


@query("A6_null_list", "SELECT o_orderkey, o_orderstatus = 'P' AS missing, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS first FROM orders")
def null_list(spark, sf):
    lists = V.table(spark, sf, "orders").select(
        "o_orderkey", F.array(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))).alias("lst")
    )
    cleaned = lists.withColumn("lst", A.null_if_all_null_single("lst"))
    return cleaned.select("o_orderkey", F.col("lst").isNull().alias("missing"), F.get("lst", F.lit(0)).alias("first"))


@query("A7_wrap_scalar", "SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS length, quality AS first FROM documents LEFT JOIN labels USING (doc_id)")
def wrap_scalar(spark, sf):
    joined = V.table(spark, sf, "documents").select("doc_id").join(V.table(spark, sf, "labels"), "doc_id", "left")
    lists = joined.select("doc_id", A.wrap("quality").alias("lst"))
    return lists.select("doc_id", F.size("lst").alias("length"), F.get("lst", F.lit(0)).alias("first"))


@query(
    "A8_nested_list",
    V.with_views(
        "mc",
        """SELECT stimulus, CAST(b AS INTEGER) AS block, CAST(pos AS INTEGER) AS pos, CASE WHEN b = 0 THEN dilution ELSE component END AS value FROM
        (SELECT *, row_number() OVER (PARTITION BY stimulus ORDER BY dilution, component) - 1 AS pos FROM mc), range(2) t(b)""",
    ),
)
def nested_list(spark, sf):
    entries = V.mixture_component(spark, sf).select("stimulus", "dilution", F.col("component").cast("double"))
    rows = T.regroup(entries, "stimulus", ["dilution", "component"], ["dilution", "component"])
    nested = rows.select("stimulus", F.array("dilution", "component").alias("info"))
    blocks = nested.select("stimulus", F.posexplode("info").alias("block", "items"))
    return blocks.select("stimulus", "block", F.posexplode("items").alias("pos", "value"))


_PADDED = """SELECT l.stimulus, CAST(p.pos AS INTEGER) AS pos, coalesce(l2.cid, {fill}) AS value FROM (SELECT DISTINCT stimulus FROM mc) l
 CROSS JOIN range({k}) p(pos) LEFT JOIN (SELECT stimulus, cid, row_number() OVER (PARTITION BY stimulus ORDER BY cid) - 1 AS pos FROM mc) l2
 ON l2.stimulus = l.stimulus AND l2.pos = p.pos"""


@query(
    "A9_pad_list",
    V.with_views(
        "mc sz",
        f"""SELECT stimulus, {_POS} AS pos, cid AS value FROM mc UNION ALL
        SELECT stimulus, CAST(p AS INTEGER), -999 FROM sz, range(10) t(p) WHERE p >= n""",
    ),
)
def pad_list(spark, sf):
    lists = definition_text(spark, sf).select("stimulus", A.split_list("components", "bigint").alias("cids"))
    padded = lists.select("stimulus", A.pad("cids", 10, F.lit(A.PADDING).cast("long")).alias("cids"))
    return padded.select("stimulus", F.posexplode("cids").alias("pos", "value"))


@query(
    "A9_pad_nested",
    "SELECT vec_id, CAST(b AS INTEGER) AS block, CAST(p AS INTEGER) AS pos, round(CASE WHEN b < 4 AND p < 16 THEN CAST(embedding[b * 16 + p + 1] AS DOUBLE) ELSE -999 END, 6) AS value "
    "FROM embeddings, range(5) t(b), range(18) s(p)",
)
def pad_nested(spark, sf):
    nested = V.vectors(spark, sf).select("vec_id", _blocks("vec").alias("blocks"))
    padded = nested.select("vec_id", A.pad_nested("blocks", 5, 18, float(A.PADDING)).alias("blocks"))
    rows = padded.select("vec_id", F.posexplode("blocks").alias("block", "items"))
    return rows.select("vec_id", "block", F.posexplode("items").alias("pos", "value")).withColumn("value", R6("value"))


def _blocks(vec: str):
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.slice(F.col(vec), b * 16 + 1, 16))


@query("A10_fit_list", V.with_views("mc", _PADDED.format(fill=0, k=3)))
def fit_list(spark, sf):
    lists = definition_text(spark, sf).select("stimulus", A.split_list("components", "bigint").alias("cids"))
    fitted = lists.select("stimulus", A.fit("cids", 3, F.lit(0).cast("long")).alias("cids"))
    return fitted.select("stimulus", F.posexplode("cids").alias("pos", "value"))


@query(
    "A11_coverage",
    V.with_views(
        "mc sz",
        """SELECT stimulus, count(*) AS members, CAST(sum(CAST(k.cid IS NOT NULL AS INTEGER)) AS BIGINT) AS found,
        round(avg(CAST(k.cid IS NOT NULL AS INTEGER)) * 100, 6) AS percent, bool_and(k.cid IS NOT NULL) AS complete,
        bool_or(k.cid IS NOT NULL) AS seen FROM mc JOIN sz USING (stimulus) LEFT JOIN
        (SELECT DISTINCT cid FROM mc JOIN sz USING (stimulus) WHERE n = 1) k USING (cid) WHERE sz.n > 1 GROUP BY stimulus""",
    ),
)
def coverage(spark, sf):
    entries = V.mixture_component(spark, sf)
    mixed = X.with_size(entries).filter("size > 1")
    found = X.coverage(mixed, X.singles(entries), "stimulus", ["cid"])
    return found.withColumn("percent", R6("percent"))


_TYPES = ["ECONOMY", "SMALL", "LARGE"]


@query(
    "A12_one_hot",
    """SELECT p_partkey, CAST(pos AS INTEGER) AS pos, CAST(CASE pos WHEN 0 THEN p_type = 'ECONOMY' WHEN 1 THEN p_type = 'SMALL'
    WHEN 2 THEN p_type = 'LARGE' ELSE p_type NOT IN ('ECONOMY', 'SMALL', 'LARGE') END AS INTEGER) AS flag FROM part, range(4) t(pos)""",
)
def one_hot(spark, sf):
    coded = V.table(spark, sf, "part").select("p_partkey", A.one_hot("p_type", _TYPES).alias("v"))
    return coded.select("p_partkey", F.posexplode("v").alias("pos", "flag"))


@query(
    "A13_node_vector",
    """SELECT p_partkey, CAST(sum(CASE WHEN hit THEN pos + 1 ELSE 0 END) AS BIGINT) AS digest, CAST(max(pos) + 1 AS INTEGER) AS width FROM
    (SELECT p_partkey, pos, CASE WHEN pos < 3 THEN p_type = ['ECONOMY', 'SMALL', 'LARGE'][pos + 1]
      WHEN pos = 3 THEN p_type NOT IN ('ECONOMY', 'SMALL', 'LARGE')
      WHEN pos < 54 THEN p_size = pos - 4 ELSE p_size NOT BETWEEN 0 AND 49 END AS hit FROM part, range(55) t(pos)) GROUP BY p_partkey""",
)
def node_vector(spark, sf):
    coded = V.table(spark, sf, "part").select(
        "p_partkey", A.one_hot_row({"p_type": _TYPES, "p_size": list(range(50))}).alias("v")
    )
    digest = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return coded.select("p_partkey", digest.alias("digest"), F.size("v").alias("width"))


_EDGE_BYTES = 128  # of an edge where edges are grouped


@query(
    "A14_directed_edges",
    """SELECT l_orderkey AS graph_id, src, dst, count(*) AS n FROM (SELECT l_orderkey, l_partkey AS src, l_suppkey AS dst FROM lineitem
    WHERE l_partkey <> l_suppkey UNION ALL SELECT l_orderkey, l_suppkey, l_partkey FROM lineitem WHERE l_partkey <> l_suppkey) GROUP BY ALL""",
)
def directed_edges(spark, sf):
    keys = ["graph_id", "src", "dst"]
    pairs = V.mixture_component(spark, sf).filter("cid <> component").select(
        F.col("stimulus").alias("graph_id"), F.col("cid").alias("src"), F.col("component").alias("dst")
    )
    tasks = tasks_of(pairs, _EDGE_BYTES)
    bonds = pairs.repartition(tasks, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    edges = S.directed_edges(bonds, "graph_id", ordered=False)
    return edges.repartition(2 * tasks, *keys).groupBy(*keys).agg(F.sum("n").alias("n"))


@query(
    "A15_add_fractions",
    V.with_views(
        "mc nv el",
        """SELECT stimulus, cid, component, dilution, round(sum((dim + 1) * v) + 65 * dilution, 6) AS concat,
        round(sum((dim + 1) * v * dilution), 6) AS multiply FROM (SELECT DISTINCT stimulus, cid, component, dilution FROM mc) m
        JOIN el ON el.vec_id = m.cid % (SELECT n FROM nv) GROUP BY stimulus, cid, component, dilution""",
    ),
)
def add_fractions(spark, sf):
    entries = V.linked_components(spark, sf).select("stimulus", "cid", "component", "dilution", "vec_id").distinct()
    rows = entries.join(V.vectors(spark, sf).select("vec_id", "vec"), "vec_id").withColumn("fraction", F.array("dilution"))
    return rows.select(
        "stimulus",
        "cid",
        "component",
        "dilution",
        R6(P.vector_digest(S.add_fractions("vec", "fraction", "concat"))).alias("concat"),
        R6(P.vector_digest(S.add_fractions("vec", "fraction", "multiply"))).alias("multiply"),
    )


_LINEAR = dict(w="SELECT label AS out, dim, avg(v) AS w FROM el GROUP BY label, dim")


def _class_model(spark, sf):
    means = P.pool_vectors(V.vectors(spark, sf), ["label"], "vec", V.DIMS, ["mean"])
    return means.select(F.col("label").alias("out"), F.col("mean").alias("w"), (F.col("label") / 10).alias("bias"))


@query(
    "A16_linear_scoring",
    V.with_views(
        "el",
        "SELECT vec_id, out, round(sum(v * w) + out / 10, 6) AS score FROM el JOIN w USING (dim) GROUP BY vec_id, out",
        **_LINEAR,
    ),
)
def linear_scoring(spark, sf):
    scored = S.linear(V.vectors(spark, sf), "vec_id", "vec", _class_model(spark, sf))
    return scored.select("vec_id", "out", R6("score").alias("score"))


@query(
    "A17_film_scoring",
    V.with_views(
        "nv el",
        """SELECT x.vec_id, x.dim AS out, round(1 / (1 + exp(-g)) * x.v + 1 / (1 + exp(-b)), 6) AS score FROM el x JOIN
        (SELECT c.vec_id, g.vec_id AS dim, sum(c.v * g.v) AS g, sum(c.v * c2.v) + 0.5::DOUBLE AS b FROM el c JOIN el g ON g.vec_id < 64 AND g.dim = c.dim
         JOIN el c2 ON c2.vec_id = 64 + g.vec_id AND c2.dim = c.dim GROUP BY c.vec_id, g.vec_id) p ON p.vec_id = (x.vec_id + 1) % (SELECT n FROM nv) AND p.dim = x.dim""",
    ),
)
def film_scoring(spark, sf):
    vecs = V.vectors(spark, sf)
    n = V.vector_count(spark, sf)
    rows = vecs.select("vec_id", "vec", ((F.col("vec_id") + 1) % n).alias("other")).join(
        vecs.select(F.col("vec_id").alias("other"), F.col("vec").alias("condition")), "other"
    )
    layer = lambda first, bias: vecs.filter(F.col("vec_id").between(first, first + V.DIMS - 1)).select(
        (F.col("vec_id") - first).cast("int").alias("out"), F.col("vec").alias("w"), F.lit(bias).alias("bias")
    )
    scored = S.film(rows, "vec_id", "vec", "condition", layer(0, 0.0), layer(64, 0.5), "sigmoid")
    return scored.select("vec_id", "out", R6("score").alias("score"))


@query(
    "A18_activations",
    V.with_views(
        "el",
        """SELECT vec_id, dim, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(greatest(v, 0), 6) AS relu,
        round(least(greatest(v, 0), 1), 6) AS hardtanh, round(ln(1 + exp(v)), 6) AS softplus FROM el""",
    ),
)
def activations(spark, sf):
    cells = V.long_vectors(spark, sf)
    return cells.select("vec_id", "dim", *[R6(N.activation(a, F.col("v"))).alias(a) for a in N.ACTIVATIONS])


@query(
    "A19_hurdle_output",
    V.with_views(
        "nv el pr",
        """SELECT row_id, dim, round(1 / (1 + exp(-10 * (y_hat - 0.1))), 6) AS gate, round(ln(1 + exp(y_hat)), 6) AS positive,
        round(CASE WHEN y_hat > 0.1 THEN ln(1 + exp(y_hat)) ELSE 0 END, 6) AS gated FROM pr""",
    ),
)
def hurdle_output(spark, sf):
    logit = 10 * (F.col("y_hat") - 0.1)
    gate, positive = S.hurdle_outputs(logit, F.col("y_hat"))
    cells = V.prediction(spark, sf)
    return cells.select(
        "row_id", "dim", R6(gate).alias("gate"), R6(positive).alias("positive"), R6(S.gated(logit > 0, positive)).alias("gated")
    )


def _normalise_sql(shift: str, scale: str) -> str:
    scaled = "round(CASE WHEN dim < 2 THEN {c} ELSE ({c} - s) / (d + 1e-6) END, 6) AS {c}"
    return V.with_views(
        "nv el pr",
        f"""SELECT row_id, dim, {scaled.format(c='y')}, {scaled.format(c='y_hat')} FROM pr JOIN
        (SELECT dim, {shift} AS s, {scale} AS d FROM pr GROUP BY dim) USING (dim)""",
    )


@query("A20_partial_zscore", _normalise_sql("avg(y)", "stddev_samp(y)"))
def partial_zscore(spark, sf):
    scaled = S.partial_normalise(V.prediction(spark, sf), "zscore")
    return scaled.select("row_id", "dim", R6("y").alias("y"), R6("y_hat").alias("y_hat"))


@query("A20_partial_minmax", _normalise_sql("min(y)", "max(y) - min(y)"))
def partial_minmax(spark, sf):
    scaled = S.partial_normalise(V.prediction(spark, sf), "minmax")
    return scaled.select("row_id", "dim", R6("y").alias("y"), R6("y_hat").alias("y_hat"))


_C = "log10(exp(1.0::DOUBLE)) / 8.63e-5"


@query(
    "A21_temperature_laws",
    f"""SELECT p_partkey, round(a - {_C} * e / t, 6) AS arrhenius, round(a - {_C} * e / (t - t0), 6) AS vft_mit,
    round(a * exp(-e / (t - t0)), 6) AS vft_cmu FROM
    (SELECT p_partkey, p_retailprice / 1000 AS a, p_size / 100.0::DOUBLE AS e, p_size * 1.0::DOUBLE AS t0, p_retailprice / 3 AS t FROM part)""",
)
def temperature_laws(spark, sf):
    a, e, t0 = F.col("p_retailprice") / 1000, F.col("p_size") / 100, F.col("p_size") * 1.0
    temp = F.col("p_retailprice") / 3
    part = V.table(spark, sf, "part")
    return part.select("p_partkey", *[R6(N.temperature_law(k, [a, e, t0], temp)).alias(k) for k in ("arrhenius", "vft_mit", "vft_cmu")])


@query(
    "A22_scaled_distance",
    V.with_views(
        "nv el sp",
        """SELECT row_id, round(least(greatest(0.5 * (1 - c) + 0.5, 0), 1), 6) AS score FROM
        (SELECT row_id, sum(y * y_hat) / (sqrt(sum(y * y)) * sqrt(sum(y_hat * y_hat))) AS c FROM sp GROUP BY row_id)""",
    ),
)
def scaled_distance(spark, sf):
    from medley.operators.metrics import row_cosine

    rows = row_cosine(V.signed_pair(spark, sf))
    return rows.select("row_id", R6(N.scaled_distance(F.col("cosine"))).alias("score"))


@query(
    "A23_two_part_vectors",
    V.with_views("el", "SELECT vec_id, CASE WHEN dim < 2 THEN 'first' ELSE 'rest' END AS part, count(*) AS n, round(sum(v), 6) AS total FROM el GROUP BY 1, 2"),
)
def two_parts(spark, sf):
    first, rest = S.split_parts(V.long_vectors(spark, sf))
    tagged = first.withColumn("part", F.lit("first")).unionByName(rest.withColumn("part", F.lit("rest")))
    return tagged.groupBy("vec_id", "part").agg(F.count(F.lit(1)).alias("n"), R6(F.sum("v")).alias("total"))


@query(
    "A24_side_by_side",
    V.with_views(
        "nv el",
        """SELECT vec_id, dim, round(v, 6) AS v FROM el UNION ALL
        SELECT (vec_id + 1) % (SELECT n FROM nv), dim + 64, round(v, 6) FROM el""",
    ),
)
def side_by_side(spark, sf):
    first = V.long_vectors(spark, sf)
    n = V.vector_count(spark, sf)
    second = first.select(((F.col("vec_id") + 1) % n).alias("vec_id"), "dim", "v")
    return J.side_by_side(first, second, "vec_id").select("vec_id", "dim", R6("v").alias("v"))


@query(
    "P12_broadcast_mixture_vector",
    V.with_views(
        "mc nv el sr",
        """SELECT stimulus, cid, n, round(a + b, 6) AS digest FROM (SELECT stimulus, cid, count(*) AS n FROM mc GROUP BY ALL) e JOIN
        (SELECT vec_id, sum((dim + 1) * v) AS a FROM el GROUP BY vec_id) c ON c.vec_id = cid % (SELECT n FROM nv) JOIN sr USING (stimulus) JOIN
        (SELECT vec_id, sum((dim + 65) * greatest(v, 0)) AS b FROM el GROUP BY vec_id) m ON m.vec_id = rating_row""",
    ),
)
def mixture_vector(spark, sf):
    entries = V.linked_components(spark, sf).groupBy("stimulus", "cid", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    members = entries.join(V.vectors(spark, sf).select("vec_id", "vec"), "vec_id")
    joined = members.join(V.stimulus_rating(spark, sf), "stimulus")
    return joined.select("stimulus", "cid", "n", R6(P.vector_digest(F.concat("vec", "rating"))).alias("digest"))


# --- exploration reports -----------------------------------------------------


@query(
    "G20_column_quantiles",
    V.with_views(
        "el lab",
        """SELECT dim, CAST(0.75 AS DOUBLE) AS q, round(quantile_cont(y, 0.75), 6) AS y FROM lab GROUP BY dim UNION ALL
        SELECT dim, CAST(0.7 AS DOUBLE), round(quantile_cont(y, 0.7), 6) FROM lab GROUP BY dim""",
    ),
)
def column_quantiles(spark, sf):
    found = O.exact_quantiles(V.stimulus_label(spark, sf), ["dim"], "y", [0.75, 0.7])
    return found.select("dim", "q", R6("y").alias("y"))


@query(
    "G21_co_occurrence",
    V.with_views(
        "el lab",
        """SELECT a.dim AS a, b.dim AS b, count(*) AS n FROM hit a JOIN hit b USING (row_id) GROUP BY 1, 2 ORDER BY 1, 2""",
        hit="SELECT row_id, lab.dim FROM lab JOIN (SELECT dim, quantile_cont(y, 0.75) AS t FROM lab GROUP BY dim) USING (dim) WHERE y >= t",
    ),
)
def co_occurrence(spark, sf):
    rows = _rating_vectors(spark, sf)
    return X.co_occurrence(rows, "row_id", "vec", V.DIMS, 0.75).filter("n > 0")


def _rating_vectors(spark, sf):
    return V.vectors(spark, sf).select(
        F.col("vec_id").alias("row_id"), F.transform("vec", lambda x: F.greatest(x, F.lit(0.0))).alias("vec")
    )


@query(
    "G22_correlation_matrix",
    V.with_views(
        "el lab",
        "SELECT a.dim AS a, b.dim AS b, round(corr(a.y, b.y), 6) AS r FROM lab a JOIN lab b USING (row_id) GROUP BY 1, 2",
    ),
)
def correlation_matrix(spark, sf):
    found = X.correlation_matrix(_rating_vectors(spark, sf), "vec", V.DIMS)
    return found.select("a", "b", R6("r").alias("r"))


@query("G23_top_columns", V.with_views("el lab", "SELECT dim, round(avg(y), 6) AS mean FROM lab GROUP BY dim ORDER BY avg(y) DESC, dim LIMIT 10"))
def top_columns(spark, sf):
    means = V.stimulus_label(spark, sf).groupBy("dim").agg(F.avg("y").alias("mean"))
    return means.orderBy(F.desc("mean"), "dim").limit(10).select("dim", R6("mean").alias("mean"))


_SETS = dict(
    a="SELECT DISTINCT cid FROM mc WHERE solvent = 'A' AND dilution > 0.08",
    b="SELECT DISTINCT cid FROM mc JOIN sz USING (stimulus) WHERE n = 1",
    c="SELECT DISTINCT cid FROM mc JOIN sz USING (stimulus) WHERE n > 6",
)


@query(
    "G24_membership_regions",
    V.with_views(
        "mc sz",
        """SELECT bool_or(ia) AS in_a, bool_or(ib) AS in_b, bool_or(ic) AS in_c, count(*) AS n FROM (SELECT cid, bool_or(t = 1) AS ia, bool_or(t = 2) AS ib,
        bool_or(t = 3) AS ic FROM (SELECT cid, 1 AS t FROM a UNION ALL SELECT cid, 2 FROM b UNION ALL SELECT cid, 3 FROM c) GROUP BY cid) GROUP BY ia, ib, ic""",
        **_SETS,
    ),
)
def membership_regions(spark, sf):
    entries = V.mixture_component(spark, sf)
    sets = {
        "a": entries.filter("solvent = 'A' AND dilution > 0.08"),
        "b": X.singles(entries),
        "c": X.with_size(entries).filter("size > 6"),
    }
    return X.membership_regions(sets, "cid")


@query(
    "G25_histogram",
    """SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 15)) + 1, 15) AS INTEGER) AS bin, count(*) AS n FROM orders,
    (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1""",
)
def histogram(spark, sf):
    return X.histogram(V.table(spark, sf, "orders").select("o_totalprice"), "o_totalprice", 15)


@query(
    "G26_five_number_summary",
    "SELECT q, round(n, 6) AS n FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS q, "
    "unnest(quantile_cont(CAST(n AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0])) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey))",
)
def five_number_summary(spark, sf):
    return X.five_number_summary(V.mixture_component(spark, sf), "cid").select("q", R6("n").alias("n"))


@query(
    "G27_fold_summary",
    V.with_views(
        "nv el pr",
        """SELECT 'next_row' AS model, round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std, round(avg(rmse), 6) AS rmse_mean,
        round(stddev_samp(rmse), 6) AS rmse_std FROM (SELECT label AS fold, avg(abs(y - y_hat)) AS mae, sqrt(avg((y - y_hat) ** 2)) AS rmse
        FROM pr JOIN embeddings ON vec_id = row_id GROUP BY label)""",
    ),
)
def fold_summary(spark, sf):
    from medley.operators.metrics import errors

    folds = V.vectors(spark, sf).select(F.col("vec_id").alias("row_id"), F.col("label").alias("fold"))
    per_fold = errors(V.prediction(spark, sf).join(folds, "row_id"), "fold").withColumn("model", F.lit("next_row"))
    summary = per_fold.groupBy("model").agg(
        *[R6(f(m)).alias(f"{m}_{s}") for m in ("mae", "rmse") for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    )
    return summary


@query(
    "G28_class_balance",
    V.with_views(
        "el lab",
        """SELECT dim, CAST(sum(CAST(y > 0.25 AS INTEGER)) AS BIGINT) AS pos, CAST(sum(CAST(y <= 0.25 AS INTEGER)) AS BIGINT) AS neg,
        round(sum(CAST(y <= 0.25 AS INTEGER)) / sum(CAST(y > 0.25 AS INTEGER)), 6) AS weight FROM lab GROUP BY dim HAVING sum(CAST(y > 0.25 AS INTEGER)) >= 5""",
    ),
)
def class_balance(spark, sf):
    found = X.class_balance(V.stimulus_label(spark, sf), F.col("y") > 0.25, 5)
    return found.withColumn("weight", R6("weight"))
