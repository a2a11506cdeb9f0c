"""Sources, splits, models, streams and the composed flows."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from medley.functions import lists as A
from medley.functions.featurise import featurise, text_key
from medley.functions.mixing import mix, mix_sql
from medley.operators import explore as X
from medley.operators import metrics as M
from medley.operators import models as ML
from medley.operators import pooling as P
from medley.operators import selection as SEL
from medley.operators import splits as SP
from medley.operators import tidy as T
from medley.plans import flows as PL
from medley.plans import panel as PN
from medley.plans import raw as RAW
from medley.plans import views as V
from medley.plans.registry import query
from medley.plans.tidy_queries import EARLY_STOP_SQL, definition_text
from medley.schemas import OVERALL, RATINGS, SUBMISSION
from medley.session import cut, scratch_path
from medley.sources import catalog as C
from medley.sources import tables as S
from medley.streaming import accumulate as ST

R6 = V.round_to

# --- datasets ----------------------------------------------------------------


def _dataset(name: str, output: str):
    def load(spark, sf) -> C.Dataset:
        ratings = V.stimulus_rating(spark, sf)
        labels = ratings.select(
            "stimulus",
            F.col("rating").alias("all_ratings"),
            F.slice("rating", 3, V.DIMS).alias("ratings"),
            F.slice("rating", 1, 2).alias("overall"),
        ).select("stimulus", F.col(output).alias("rating"))
        compounds = V.table(spark, sf, "part").select(F.col("p_partkey").alias("cid"), "p_name")
        return C.Dataset(name, compounds, V.mixture_component(spark, sf), labels)

    return C.register(name)(load)


_dataset("ratings", "ratings")
_dataset("ratings_all", "all_ratings")
_dataset("ratings_overall", "overall")


# --- sources -----------------------------------------------------------------


@query("S1_read_table", "SELECT CAST(o_orderkey AS VARCHAR) AS stimulus, o_custkey AS cid, o_totalprice AS dilution, o_orderpriority AS solvent FROM orders")
def read_table(spark, sf):
    path = scratch_path(spark, "single")
    orders = V.table(spark, sf, "orders")
    raw = orders.select(
        F.col("o_orderkey").cast("string").alias("stimulus"),
        F.col("o_custkey").alias("cid"),
        F.col("o_totalprice").alias("dilution"),
        F.col("o_orderpriority").alias("solvent"),
    )
    S.write_table(raw, path, "csv")
    schema = T_.StructType(
        [
            T_.StructField("stimulus", T_.StringType()),
            T_.StructField("cid", T_.LongType()),
            T_.StructField("dilution", T_.DoubleType()),
            T_.StructField("solvent", T_.StringType()),
        ]
    )
    return S.read_table(spark, path, schema)


@query("S2_keyed_table", "SELECT p_partkey AS cid, p_name FROM part")
def keyed_table(spark, sf):
    return S.keyed_table(V.table(spark, sf, "part").select(F.col("p_partkey").alias("cid"), "p_name"), ["cid"])


@query("S2_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return S.duplicate_keys(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


_CELLS = V.with_views("el", "SELECT vec_id, dim, round(v, 6) AS v FROM el")


@query("S3_decode_list", _CELLS)
def decode_list(spark, sf):
    from medley.functions.lists import decode_list as decode

    text = V.vectors(spark, sf).select("vec_id", F.concat(F.lit("["), F.array_join(F.transform("vec", lambda x: x.cast("string")), ", "), F.lit("]")).alias("t"))
    return text.select("vec_id", F.posexplode(decode("t")).alias("dim", "v")).withColumn("v", R6("v"))


@query("S4_decode_brackets", _CELLS)
def decode_brackets(spark, sf):
    from medley.functions.lists import decode_brackets as decode

    text = V.vectors(spark, sf).select("vec_id", F.concat(F.lit("[ "), F.array_join(F.transform("vec", lambda x: x.cast("string")), " , "), F.lit(" ]")).alias("t"))
    return text.select("vec_id", F.posexplode(decode("t")).alias("dim", "v")).withColumn("v", R6("v"))


@query(
    "S5_decode_braces",
    V.with_views("el", "SELECT vec_id, CAST(dim // 16 AS INTEGER) AS block, CAST(dim % 16 AS INTEGER) AS pos, round(v, 6) AS v FROM el"),
)
def decode_braces(spark, sf):
    from medley.functions.lists import decode_braces as decode

    block = lambda b: F.concat(
        F.lit("'{"), F.array_join(F.transform(F.slice("vec", b * 16 + 1, 16), lambda x: x.cast("string")), ", "), F.lit("}'")
    )
    text = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), block), ", "), F.lit("]"))
    rows = V.vectors(spark, sf).select("vec_id", F.posexplode(decode(text)).alias("block", "items"))
    return rows.select("vec_id", "block", F.posexplode("items").alias("pos", "v")).withColumn("v", R6("v"))


@query(
    "S6_catalog",
    V.with_views(
        "mc nv sr",
        "SELECT name, count(*) AS n_entries, CAST(width AS INTEGER) AS width FROM mc JOIN sr USING (stimulus), "
        "(VALUES ('ratings', 62), ('ratings_all', 64), ('ratings_overall', 2)) t(name, width) GROUP BY name, width",
    ),
)
def catalog(spark, sf):
    parts = []
    for name in ("ratings", "ratings_all", "ratings_overall"):
        joined = C.open_dataset(name, spark, sf).joined()
        parts.append(
            joined.agg(F.count(F.lit(1)).alias("n_entries"), F.max(F.size("rating")).alias("width")).select(
                F.lit(name).alias("name"), "n_entries", "width"
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "S7_describe_dataset",
    V.with_views(
        "mc sz nv sr",
        """SELECT 'ratings_all' AS name, 'cid' AS id_column, 'dilution,solvent' AS fraction_columns, 'rating' AS output_column,
        count(*) AS n_stimuli, CAST(sum(n) AS BIGINT) AS n_entries, max(n) AS longest, (SELECT count(*) FROM sr) AS n_labels,
        CAST(64 AS INTEGER) AS label_width, (SELECT count(*) FROM part) AS n_compounds FROM sz""",
    ),
)
def describe_dataset(spark, sf):
    return C.describe_dataset(C.open_dataset("ratings_all", spark, sf))


@query("S8_write_table", "SELECT l_orderkey AS stimulus, count(*) AS n FROM lineitem GROUP BY 1")
def write_table(spark, sf):
    path = scratch_path(spark, "sizes")
    sizes = V.mixture_component(spark, sf).groupBy("stimulus").agg(F.count(F.lit(1)).alias("n"))
    S.write_table(sizes, path)
    return spark.read.parquet(path)


@query("S9_materialise", V.with_views("el", "SELECT vec_id, dim, round(v * v, 6) AS v FROM el"))
def materialise(spark, sf):
    path = scratch_path(spark, "features")
    build = lambda: V.long_vectors(spark, sf).select("vec_id", "dim", R6(F.col("v") * F.col("v")).alias("v"))
    S.materialise(spark, path, build)

    def never():
        raise AssertionError("stored features must be reused")

    return S.materialise(spark, path, never)


def _kfold_sql(ids: str, k: int = 5, val: float = 0.1, seed: int = 0) -> str:
    share = (1 - 1 / k - val) / (1 - 1 / k)
    return f"""SELECT CAST(fold AS INTEGER) AS fold, row_id, CASE WHEN i % {k} = fold THEN 'test'
      WHEN (i - (i + {k - 1} - fold) // {k} + fold * (rest // {k})) % greatest(rest, 1) < CAST(floor({share!r}::DOUBLE * rest) AS BIGINT) THEN 'train' ELSE 'val' END AS part
    FROM (SELECT *, n - (n + {k - 1} - fold) // {k} AS rest FROM (SELECT row_id, row_number() OVER (ORDER BY {mix_sql(str(seed), 'row_id')}, row_id) - 1 AS i,
      count(*) OVER () AS n FROM ({ids})) r, range({k}) t(fold))"""


_ORDER_IDS = "SELECT o_orderkey AS row_id FROM orders"


def _order_ids(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))


@query("M1_kfold_split", _kfold_sql(_ORDER_IDS))
def kfold(spark, sf):
    return SP.kfold(_order_ids(spark, sf), "row_id")


@query(
    "S10_split_store",
    f"WITH s AS ({_kfold_sql(_ORDER_IDS)}) SELECT row_id, part, (SELECT count(DISTINCT fold) FROM s)::BIGINT AS n_splits, "
    "TRUE AS absent FROM s WHERE fold = 2",
)
def split_store(spark, sf):
    path = scratch_path(spark, "split")
    S.save_split(SP.kfold(_order_ids(spark, sf), "row_id"), path)
    absent = S.load_split(spark, path, 99) is None and S.load_split(spark, path + "-none", 0) is None
    n_splits = S.count_splits(spark, path)
    return S.load_split(spark, path, 2).select(
        "row_id", "part", F.lit(n_splits).cast("long").alias("n_splits"), F.lit(absent).alias("absent")
    )


@query("S11_vector_store", V.with_views("el", "SELECT vec_id AS row_id, dim, round(v, 6) AS v FROM el"))
def vector_store(spark, sf):
    path = scratch_path(spark, "vectors")
    rows = V.vectors(spark, sf).select(F.col("vec_id").alias("row_id"), "vec")
    S.store_vectors(rows, path)
    labels = V.stimulus_label(spark, sf).select("row_id").distinct()
    loaded = S.load_vectors(spark, path, labels)
    return loaded.select("row_id", F.posexplode("vec").alias("dim", "v")).withColumn("v", R6("v"))


@query(
    "S12_feature_mask",
    V.with_views("el", "SELECT vec_id, dim, round(v, 6) AS v FROM el WHERE dim IN (SELECT dim FROM el GROUP BY dim HAVING avg(v) > 0)"),
)
def feature_mask(spark, sf):
    path = scratch_path(spark, "mask")
    cells = V.long_vectors(spark, sf)
    S.save_mask(cells.groupBy("dim").agg(F.avg("v").alias("m")).filter("m > 0"), path)
    return S.apply_mask(cells, spark.read.parquet(path)).select("vec_id", "dim", R6("v").alias("v"))


@query(
    "S13_stage_report",
    """WITH d AS (SELECT documents.*, quality FROM documents LEFT JOIN labels USING (doc_id)), r AS (SELECT count(*) AS a,
      count(*) FILTER (WHERE quality IS NOT NULL) AS b, count(*) FILTER (WHERE quality IS NOT NULL AND n_chars BETWEEN 20 AND 6000) AS c,
      count(*) FILTER (WHERE quality IS NOT NULL AND n_chars BETWEEN 20 AND 6000 AND NOT contains(text, ';')) AS e FROM d)
    SELECT 1 AS step, 'labelled' AS rule, a AS before, a - b AS removed, b AS after FROM r UNION ALL
    SELECT 2, 'length', b, b - c, c FROM r UNION ALL SELECT 3, 'no mixture', c, c - e, e FROM r""",
)
def stage_report(spark, sf):
    docs = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id", "left")
    rules = [
        ("labelled", F.col("quality").isNotNull()),
        ("length", F.col("n_chars").between(20, 6000)),
        ("no mixture", ~F.col("text").contains(";")),
    ]
    return T.stage_report(docs, rules)


@query(
    "H1_featurise_hook",
    "SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents",
)
def featurise_hook(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    vectors, _ = featurise(docs, "text", lambda texts: [[len(t), t.count(" ")] for t in texts])
    keyed = docs.select("doc_id", text_key("text").alias("text_key"))
    return keyed.join(vectors, "text_key").select("doc_id", F.col("vec")[0].alias("chars"), F.col("vec")[1].alias("blanks"))


# --- splits ------------------------------------------------------------------


@query(
    "M2_train_val_test",
    f"""SELECT row_id, CASE WHEN i < t THEN 'test' WHEN i < t + CAST(ceil(0.125::DOUBLE * (n - t)) AS BIGINT) THEN 'val' ELSE 'train' END AS part FROM
    (SELECT *, CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS t FROM (SELECT row_id, row_number() OVER (ORDER BY {mix_sql('3', 'row_id')}, row_id) - 1 AS i,
     count(*) OVER () AS n FROM ({_ORDER_IDS})))""",
)
def train_val_test(spark, sf):
    return SP.train_val_test(_order_ids(spark, sf), "row_id", 0.2, 0.1, seed=3)


@query(
    "M3_balanced_folds",
    f"""SELECT CAST((row_number() OVER (PARTITION BY sig ORDER BY own, {mix_sql('0', 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold, doc_id FROM
    (SELECT doc_id, CAST(quality <> 0 AS VARCHAR) || CAST(toxic <> 0 AS VARCHAR) AS own, CASE WHEN count(*) OVER (PARTITION BY quality = 0, toxic = 0) < 5 THEN 'rare'
     ELSE CAST(quality = 0 AS VARCHAR) || CAST(toxic = 0 AS VARCHAR) END AS sig FROM labels)""",
)
def balanced_folds(spark, sf):
    return SP.balanced_folds(V.table(spark, sf, "labels"), "doc_id", ["quality", "toxic"])


@query(
    "M4_shuffle_and_cut",
    f"""SELECT row_id, CASE WHEN i < CAST(floor(0.75::DOUBLE * n) AS BIGINT) THEN 'train' ELSE 'val' END AS part FROM
    (SELECT row_id, row_number() OVER (ORDER BY {mix_sql('11', 'row_id')}, row_id) - 1 AS i, count(*) OVER () AS n FROM ({_ORDER_IDS}))""",
)
def shuffle_and_cut(spark, sf):
    return SP.shuffle_and_cut(_order_ids(spark, sf), "row_id", 0.25, seed=11)


@query(
    "M5_rows_of_part",
    f"SELECT o_orderkey AS row_id, o_totalprice FROM orders WHERE o_orderkey IN (SELECT row_id FROM ({_kfold_sql(_ORDER_IDS)}) WHERE fold = 1 AND part = 'val')",
)
def rows_of_part(spark, sf):
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    return SP.take_part(rows, SP.kfold(rows, "row_id"), "row_id", 1, "val")


# --- models ------------------------------------------------------------------


def _learning_rows(spark, sf, targets):
    """Vectors as features; target d mixes three entries so trees have something to find."""
    mixed = lambda d: F.greatest(F.col("vec")[d] + 0.5 * F.col("vec")[d + 1] * F.signum(F.col("vec")[d + 2]), F.lit(0.0))
    rows = V.vectors(spark, sf).select(F.col("vec_id").alias("row_id"), "vec", *[mixed(d).alias(f"y{d}") for d in targets])
    return cut(ML.assemble(rows, "vec").drop("vec"))


@query("M6_boosted_regressors")
def boosted_regressors(spark, sf):
    rows = _learning_rows(spark, sf, [0, 1])
    models = ML.fit_regressors(rows, {0: "y0", 1: "y1"}, trees=5, depth=3)
    return ML.score(rows, models, "row_id")


@query("M7_weighted_gates")
def weighted_gates(spark, sf):
    rows = _learning_rows(spark, sf, [0, 1])
    gates = ML.fit_gates(rows, {0: "y0", 1: "y1"}, {0: 0.05, 1: 0.05}, trees=3, depth=3)
    return ML.score(rows, gates, "row_id", "gate")


@query(
    "M8_hybrid_prediction",
    V.with_views(
        "nv el pr",
        "SELECT row_id, dim, round(CASE WHEN y_hat > 0.05 THEN y_hat ELSE 0 END, 6) AS y_hat FROM pr",
    ),
)
def hybrid_prediction(spark, sf):
    cells = V.prediction(spark, sf)
    gates = cells.select("row_id", "dim", (F.col("y_hat") > 0.05).cast("double").alias("gate"))
    return ML.hybrid(gates, cells.select("row_id", "dim", "y_hat"), "row_id").withColumn("y_hat", R6("y_hat"))


@query("M9_feature_elimination")
def feature_elimination(spark, sf):
    rows = _learning_rows(spark, sf, [0])
    kept, _ = SEL.eliminate(rows.withColumnRenamed("y0", "y"), V.DIMS, folds=2, step=22, keep=20, trees=2, depth=2)
    # the selected dims, applied to the long features
    mask = spark.createDataFrame([(d,) for d in kept], "dim int")
    return S.apply_mask(V.long_vectors(spark, sf), mask)


_BINNED = """SELECT el.vec_id, el.dim, label, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 8)), 7) END AS bin FROM el JOIN
 (SELECT dim, min(v) AS lo, max(v) AS hi FROM el GROUP BY dim) USING (dim)"""


@query(
    "M10_mutual_information",
    V.with_views(
        "el",
        """SELECT dim, round(sum(n / na * ln(n * na / (nb * nt))), 6) AS mi FROM (SELECT dim, n::DOUBLE AS n, sum(n) OVER (PARTITION BY dim)::DOUBLE AS na,
        sum(n) OVER (PARTITION BY dim, bin)::DOUBLE AS nb, sum(n) OVER (PARTITION BY dim, label)::DOUBLE AS nt FROM
        (SELECT dim, bin, label, count(*) AS n FROM binned GROUP BY ALL)) GROUP BY dim""",
        binned=_BINNED,
    ),
)
def mutual_information(spark, sf):
    found = SEL.mutual_information(V.vectors(spark, sf), "vec", "label")
    return found.select("dim", R6("mi").alias("mi"))


@query("M11_linear_heads")
def linear_heads(spark, sf):
    rows = _learning_rows(spark, sf, [0, 1])
    flagged = rows.withColumn("on", (F.col("y1") > 0.05).cast("double"))
    linear = ML.score(rows, ML.fit_linear(rows, {0: "y0"}), "row_id")
    return linear.unionByName(ML.score(rows, ML.fit_linear(flagged, {1: "on"}, logistic=True), "row_id"))


@query("M12_grid_sweep")
def grid_sweep(spark, sf):
    rows = _learning_rows(spark, sf, [0]).select("row_id", "features", F.col("y0").alias("y"))
    return ML.sweep(rows, "row_id", [2, 3], [0.1, 0.3], trees=2)


@query("M13_label_clusters")
def label_clusters(spark, sf):
    rows = V.vectors(spark, sf).select(
        F.col("vec_id").alias("row_id"), F.transform("vec", lambda x: F.greatest(x, F.lit(0.0))).alias("vec")
    )
    return ML.label_clusters(X.co_occurrence(rows, "row_id", "vec", V.DIMS, 0.75), k=7)


@query("M14_projection")
def projection(spark, sf):
    found = ML.project(V.vectors(spark, sf), "vec_id", "vec")
    return found.select("vec_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


@query("M15_stored_model")
def stored_model(spark, sf):
    path = scratch_path(spark, "model")
    rows = _learning_rows(spark, sf, [0])
    model = ML.fit_regressors(rows, {0: "y0"}, trees=3, depth=3)[0]
    ML.save_model(model, path)
    out = scratch_path(spark, "predictions")
    S.write_table(ML.load_and_score(path, rows, "row_id"), out, "csv")
    return spark.read.schema("row_id bigint, y_hat double").csv(out, header=True)


# Models with an answer in closed form: a single tree of one level over a 0/1 feature gives
# the two group means, a line gives the regression sums, two dims give a rotation.

_FLAG = "CAST(embedding[1] > 0 AS INTEGER)"
_GROUPED = f"SELECT vec_id AS row_id, {_FLAG} AS flag, CAST(embedding[2] AS DOUBLE) AS x, dim, v FROM el JOIN embeddings USING (vec_id)"


def _flagged_rows(spark, sf, dims, numeric=False):
    """One feature per row, a flag or a number, and the chosen dims as targets."""
    flag = (F.col("vec")[0] > 0).cast("double")
    feature = F.col("vec")[1] if numeric else flag
    targets = [F.col("vec")[d].alias(f"y{d}") for d in dims]
    rows = V.vectors(spark, sf).select(F.col("vec_id").alias("row_id"), F.array(feature).alias("x"), *targets)
    return ML.assemble(rows, "x").drop("x")


@query(
    "M6_group_means",
    V.with_views("el", "SELECT row_id, dim, round(avg(v) OVER (PARTITION BY dim, flag), 6) AS y_hat FROM g", g=_GROUPED),
)
def group_means(spark, sf):
    rows = cut(_flagged_rows(spark, sf, range(V.DIMS)))
    models = ML.fit_regressors(rows, {d: f"y{d}" for d in range(V.DIMS)}, trees=1, depth=1, share=1.0)
    return ML.score(rows, models, "row_id").withColumn("y_hat", R6("y_hat"))


@query(
    "M7_group_gates",
    V.with_views(
        "el",
        """SELECT row_id, dim, CAST(p * a_neg > n * a_pos AS DOUBLE) AS gate FROM (SELECT row_id, dim,
          sum(CAST(v > 0.02 AS INTEGER)) OVER (PARTITION BY dim, flag) AS p, sum(CAST(v <= 0.02 AS INTEGER)) OVER (PARTITION BY dim, flag) AS n,
          sum(CAST(v > 0.02 AS INTEGER)) OVER (PARTITION BY dim) AS a_pos, sum(CAST(v <= 0.02 AS INTEGER)) OVER (PARTITION BY dim) AS a_neg
         FROM g WHERE dim < 8)""",
        g=_GROUPED,
    ),
)
def group_gates(spark, sf):
    rows = cut(_flagged_rows(spark, sf, range(8)))
    gates = ML.fit_gates(rows, {d: f"y{d}" for d in range(8)}, {d: 0.02 for d in range(8)}, trees=1, depth=1)
    return ML.score(rows, gates, "row_id", "gate")


@query(
    "M9_planted_feature",
    V.with_views("el", "SELECT vec_id, dim, round(v, 6) AS v FROM el WHERE dim = 5"),
)
def planted_feature(spark, sf):
    flags = F.transform(F.slice("vec", 1, 8), lambda x: (x > 0).cast("double"))
    rows = V.vectors(spark, sf).select(F.col("vec_id").alias("row_id"), flags.alias("x"), flags[5].alias("y"))
    kept, _ = SEL.eliminate(ML.assemble(rows, "x").drop("x"), 8, folds=2, step=4, keep=1, trees=1, depth=1)
    mask = spark.createDataFrame([(d,) for d in kept], "dim int")
    return S.apply_mask(V.long_vectors(spark, sf), mask).withColumn("v", R6("v"))


# four targets, each the weighted sum of two planted flags of its own; two flags serve two targets
_PLANTED = {0: (5, 12), 1: (12, 20), 2: (33, 47), 3: (50, 5)}
_PLANTED_SQL = "SELECT unnest([{}]) AS target, unnest([{}]) AS dim".format(
    ", ".join(str(t) for t, dims in _PLANTED.items() for _ in dims), ", ".join(str(d) for dims in _PLANTED.values() for d in dims)
)


@functools.lru_cache(maxsize=1)
def _planted_selection(spark, sf):
    flags = F.transform("vec", lambda x: (x > 0).cast("double"))
    rows = V.vectors(spark, sf).select(F.col("vec_id").alias("row_id"), flags.alias("x"))
    planted = [(4 * F.col("x")[a] + 2 * F.col("x")[b]).alias(f"y{t}") for t, (a, b) in _PLANTED.items()]
    rows = ML.assemble(rows.select("*", *planted), "x").drop("x")
    return SEL.select_features(
        rows, {t: f"y{t}" for t in _PLANTED}, V.DIMS, cvs=(3, 5, 10), step=10, keep=2, trees=1, depth=2
    )


@query(
    "M9_union_of_masks",
    V.with_views(
        "el",
        """SELECT vec_id, dim, targets, round(v, 6) AS v FROM el JOIN
        (SELECT dim, count(*) AS targets FROM p GROUP BY dim) USING (dim)""",
        p=_PLANTED_SQL,
    ),
)
def union_of_masks(spark, sf):
    union = _planted_selection(spark, sf).union()
    return V.long_vectors(spark, sf).join(F.broadcast(union), "dim").select("vec_id", "dim", "targets", R6("v").alias("v"))


@query(
    "M9_scores_by_setting",
    V.with_views(
        "el",
        """SELECT target, unnest([3, 5, 10]) AS cv, CAST(2 AS INTEGER) AS dims, 0.0::DOUBLE AS mae, 1.0::DOUBLE AS pearson, rows
        FROM (SELECT DISTINCT target FROM p), (SELECT count(*) AS rows FROM embeddings)""",
        p=_PLANTED_SQL,
    ),
)
def scores_by_setting(spark, sf):
    choices = _planted_selection(spark, sf).choices
    size = V.vector_count(spark, sf).alias("rows")
    return choices.select("target", "cv", "dims", R6("mae").alias("mae"), R6("pearson").alias("pearson"), size)


@query(
    "M11_regression_lines",
    V.with_views(
        "el",
        """SELECT row_id, dim, round(icept + slope * x, 6) AS y_hat FROM g JOIN
        (SELECT dim, regr_slope(v, x) AS slope, regr_intercept(v, x) AS icept FROM g GROUP BY dim) USING (dim)""",
        g=_GROUPED,
    ),
)
def regression_lines(spark, sf):
    rows = cut(_flagged_rows(spark, sf, range(V.DIMS), numeric=True))
    models = ML.fit_linear(rows, {d: f"y{d}" for d in range(V.DIMS)})
    return ML.score(rows, models, "row_id").withColumn("y_hat", R6("y_hat"))


@query(
    "M12_sweep_of_group_means",
    V.with_views(
        "el",
        """SELECT CAST(depth AS INTEGER) AS depth, rate, rmse FROM (SELECT round(sqrt(avg((v - m) * (v - m))), 6) AS rmse FROM
          (SELECT v, flag FROM h WHERE held) JOIN (SELECT flag, avg(v) AS m FROM h WHERE NOT held GROUP BY flag) USING (flag)),
        range(1, 3) d(depth), (SELECT unnest([0.1::DOUBLE, 0.3::DOUBLE]) AS rate)""",
        g=_GROUPED,
        h=f"SELECT v, flag, {mix_sql('1', 'row_id')} % 5 = 0 AS held FROM g WHERE dim = 3",
    ),
)
def sweep_of_group_means(spark, sf):
    rows = _flagged_rows(spark, sf, [3]).withColumnRenamed("y3", "y")
    return ML.sweep(rows, "row_id", [1, 2], [0.1, 0.3], trees=1, share=1.0).withColumn("rmse", R6("rmse"))


@query(
    "M13_separate_blocks",
    """SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, a < 20 AND b < 20 OR a >= 52 AND b >= 52 AS together
    FROM range(64) x(a), range(64) y(b) WHERE a < b AND (a < 20 OR a >= 52) AND (b < 20 OR b >= 52) AND (SELECT count(*) FROM embeddings) > 0""",
)
def separate_blocks(spark, sf):
    rows = V.vectors(spark, sf).select(
        F.col("vec_id").alias("row_id"), F.transform("vec", lambda x: F.greatest(x, F.lit(0.0))).alias("vec")
    )
    pairs = X.co_occurrence(rows, "row_id", "vec", V.DIMS, 0.75)
    blocks = pairs.filter("a < 20 AND b < 20 OR a >= 52 AND b >= 52")
    found = ML.label_clusters(blocks, k=2, iterations=20, start="degree")
    later = F.explode(F.sequence(F.col("dim") + 1, F.lit(V.DIMS))).alias("b")
    others = found.select(F.col("dim").alias("b"), F.col("cluster").alias("cb"))
    both = found.select(F.col("dim").alias("a"), F.col("cluster").alias("ca"), later).join(others, "b")
    return both.select("a", "b", (F.col("ca") == F.col("cb")).alias("together"))


@query(
    "M14_rotation",
    """WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
    t AS (SELECT atan2(2 * covar_samp(a, b), var_samp(a) - var_samp(b)) / 2 AS turn FROM v)
    SELECT vec_id, round(abs(a * cos(turn) + b * sin(turn)), 6) AS x, round(abs(b * cos(turn) - a * sin(turn)), 6) AS y FROM v, t""",
)
def rotation(spark, sf):
    found = ML.project(V.vectors(spark, sf).withColumn("vec", F.slice("vec", 1, 2)), "vec_id", "vec")
    return found.select("vec_id", *[R6(F.abs(F.col("coords")[i])).alias(n) for i, n in enumerate("xy")])


@query(
    "M15_stored_group_means",
    V.with_views("el", "SELECT row_id, round(avg(v) OVER (PARTITION BY flag), 6) AS y_hat FROM g WHERE dim = 4", g=_GROUPED),
)
def stored_group_means(spark, sf):
    path, out = scratch_path(spark, "model"), scratch_path(spark, "predictions")
    rows = _flagged_rows(spark, sf, [4])
    ML.save_model(ML.fit_regressors(rows, {4: "y4"}, trees=1, depth=1, share=1.0)[4], path)
    S.write_table(ML.load_and_score(path, rows, "row_id"), out, "csv")
    return spark.read.schema("row_id bigint, y_hat double").csv(out, header=True).withColumn("y_hat", R6("y_hat"))


# --- streams -----------------------------------------------------------------


def _events_over_time(spark, sf, run):
    """``run(stream)`` four times, as the events arrive in order of time, a quarter after the other; the last result.

    Each quarter is written by all tasks and taken by one trigger; ``run`` starts again from its own state.
    """
    source = scratch_path(spark, "events")
    events = V.table(spark, sf, "events")
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(second, [0.25, 0.5, 0.75], 1000)).first()[0] or []
    found = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        after = F.lit(True) if low is None else second > low
        upto = F.lit(True) if high is None else second <= high
        events.filter(after & upto).repartition("user_id").write.mode("append").parquet(source)
        files = len(spark.read.schema(events.schema).parquet(source).inputFiles())
        found = run(ST.file_stream(spark, source, events.schema, files=max(1, files)))
    return found


@query("T1_running_mean_stream", "SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def running_mean_stream(spark, sf):
    work = scratch_path(spark, "t1")
    means = _events_over_time(spark, sf, lambda stream: ST.running_means(stream, "user_id", "value", work))
    # the order of arrival shows in the last digits of a sum: they go first, so that a tie is a tie
    return means.withColumn("mean", F.round(F.round("mean", 9), 6))


@query(
    "T2_metric_stream",
    V.with_views(
        "nv el pr",
        "SELECT dim, count(*) AS n, round(avg((y - y_hat) * (y - y_hat)), 6) AS mse, round(corr(y, y_hat), 6) AS pearson FROM pr GROUP BY dim",
    ),
)
def metric_stream(spark, sf):
    source = scratch_path(spark, "cells")
    cells = V.prediction(spark, sf)
    cells.repartition(6, "row_id").write.parquet(source)
    stream = ST.file_stream(spark, source, cells.schema, files=2)
    sums = ST.metric_sums(stream, ["dim"], scratch_path(spark, "t2"))
    scores = ST.metrics_from_sums(sums, ["dim"])
    return scores.select("dim", "n", R6("mse").alias("mse"), R6("pearson").alias("pearson"))


@query("T3_early_stop_stream", EARLY_STOP_SQL)
def early_stop_stream(spark, sf):
    work = scratch_path(spark, "t3")
    detect = lambda stream: ST.early_stop_stream(stream, "user_id", ["ts", "event_id"], "value", work, patience=10)
    found = _events_over_time(spark, sf, detect)
    return found.withColumn("best", R6("best"))


# --- composed flows ----------------------------------------------------------


@query(
    "E1_tidy_labels",
    """SELECT stimulus, task1, task2, pos, round(CASE WHEN pos < 2 THEN v / 10 ELSE v / 5 END, 6) AS y FROM
    (SELECT stimulus, task1, task2, CAST(unnest(range(4)) AS INTEGER) AS pos, unnest([t, d, q, p]) AS v FROM
     (SELECT l_partkey AS stimulus, max(CAST(l_returnflag = 'A' AS INTEGER)) AS task1, max(CAST(l_linestatus = 'F' AS INTEGER)) AS task2,
      min(l_tax) AS t, min(l_discount) AS d, min(l_quantity) AS q, min(l_extendedprice) AS p FROM lineitem WHERE l_partkey NOT IN (0, 7)
      GROUP BY l_partkey, round(l_tax, 6), round(l_discount, 6), round(l_quantity, 6), round(l_extendedprice, 6)))""",
)
def tidy_labels(spark, sf):
    raw = V.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("stimulus"),
        (F.col("l_returnflag") == "A").cast("int").alias("task1"),
        (F.col("l_linestatus") == "F").cast("int").alias("task2"),
        "l_tax",
        "l_discount",
        "l_quantity",
        "l_extendedprice",
    )
    tidy = PL.tidy_labels(
        raw, "stimulus", ["task1", "task2"], ["l_quantity", "l_extendedprice"], ["l_tax", "l_discount"], [0, 7]
    )
    return tidy.select("stimulus", "task1", "task2", F.posexplode("all_ratings").alias("pos", "y")).withColumn("y", R6("y"))


_E1_SQL = V.with_views(
    "mc",
    """SELECT stimulus, pos, component, cid, dilution, solvent, solvent_id, compound_id, round(weakness, 6) AS weakness FROM
    (SELECT kept.*, c.compound_id, CASE WHEN max(dilution) OVER (PARTITION BY cid) = min(dilution) OVER (PARTITION BY cid) THEN 1 ELSE
     (dilution - min(dilution) OVER (PARTITION BY cid)) / (max(dilution) OVER (PARTITION BY cid) - min(dilution) OVER (PARTITION BY cid)) END AS weakness
     FROM (SELECT w.*, s.solvent_id FROM wanted w JOIN codes s USING (solvent) WHERE stimulus NOT IN (3, 20000005)) kept
     LEFT JOIN (SELECT p_partkey AS cid, p_size AS compound_id FROM part WHERE p_size > 10) c USING (cid))""",
    first="SELECT cid, dilution, solvent FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY dilution, solvent) AS rn FROM mc) WHERE rn = 1",
    stacked="""SELECT 20000000 + s_suppkey AS stimulus, CAST(0 AS INTEGER) AS pos, NULL::BIGINT AS component, s_suppkey AS cid, s_nationkey / 100.0::DOUBLE AS dilution,
      'nt' AS solvent FROM supplier UNION ALL SELECT d.stimulus, d.pos, d.cid, f.cid, f.dilution, f.solvent FROM
      (SELECT stimulus, cid, CAST(row_number() OVER (PARTITION BY stimulus ORDER BY cid) - 1 AS INTEGER) AS pos FROM mc) d JOIN first f USING (cid)""",
    wanted="""SELECT * FROM stacked WHERE stimulus IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' UNION ALL
      SELECT 20000000 + s_suppkey FROM supplier WHERE s_acctbal > 0)""",
    codes="SELECT solvent, row_number() OVER (ORDER BY count(*) DESC, solvent) - 1 AS solvent_id FROM wanted GROUP BY solvent",
)


@query("E1_tidy_inputs", _E1_SQL)
def tidy_inputs(spark, sf):
    return _tidy_inputs(spark, sf).withColumn("weakness", R6("weakness"))


@query(
    "E1_regrouped_inputs",
    f"""SELECT stimulus, string_agg(CAST(cid AS VARCHAR), ';' ORDER BY pos) AS cids, string_agg(CAST(component AS VARCHAR), ';' ORDER BY pos) AS components,
    count(compound_id) AS known, round(sum(dilution), 6) AS dilution, CAST(sum(solvent_id * (place + 1)) AS DOUBLE) AS solvents, round(sum(weakness), 6) AS weakness
    FROM (SELECT *, row_number() OVER (PARTITION BY stimulus ORDER BY pos) - 1 AS place FROM ({_E1_SQL})) GROUP BY stimulus""",
)
def regrouped_inputs(spark, sf):
    # weakness is rounded before it is summed, as in the SQL
    tidy = _tidy_inputs(spark, sf).withColumn("weakness", R6("weakness"))
    rows = PL.regrouped_inputs(tidy)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    placed = F.transform(F.get("dilution_info", F.lit(1)), lambda v, i: v * (i + 1))
    return rows.select(
        "stimulus",
        A.join_list("cids").alias("cids"),
        A.join_list("components").alias("components"),
        F.size(F.filter("compound_ids", lambda c: c.isNotNull())).cast("long").alias("known"),
        R6(total(F.get("dilution_info", F.lit(0)))).alias("dilution"),
        total(placed).alias("solvents"),
        R6(total(F.get("dilution_info", F.lit(2)))).alias("weakness"),
    )


def _raw_files(spark, sf) -> RAW.RawFiles:
    """The stand-ins of the raw tables, written as the CSV files that the tasks ship."""
    folder = scratch_path(spark, "raw")

    def put(name, df):
        S.write_table(df, f"{folder}/{name}", "csv")
        return f"{folder}/{name}"

    entries = [F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate([*OVERALL, *RATINGS])]
    vectors = V.table(spark, sf, "embeddings")
    rated = lambda k: vectors.filter(F.col("vec_id") % k == 0).select(
        F.lit("x").alias("unused"), *entries[::-1], F.concat(F.lit("V"), "vec_id").alias("stimulus")
    )
    supplier = V.table(spark, sf, "supplier")
    name = lambda c: F.concat(F.lit("V"), c).alias("stimulus")
    singles = supplier.select(
        name(F.col("s_suppkey") + 100000).alias("stimulus"), F.col("s_suppkey").alias("molecule"),
        (F.col("s_nationkey") / 100).alias("dilution"), F.lit(" NT").alias("solvent"), F.lit("L").alias("Intensity_label"),
    )
    mixtures = definition_text(spark, sf).select(name("stimulus").alias("id"), "components")
    components = V.mixture_component(spark, sf).groupBy(F.col("cid").alias("id")).agg(F.min(F.struct("dilution", "solvent")).alias("_d"))
    parts = V.table(spark, sf, "part").filter("p_size > 10")
    return RAW.RawFiles(
        {"Task1": put("one", rated(2)), "Task2_single": put("single", rated(3)), "Task2_mix": put("mix", rated(5))},
        put("singles", singles),
        put("mixtures", mixtures),
        put("components", components.select("id", F.col("id").alias("molecule"), "_d.dilution", "_d.solvent")),
        put("compounds", parts.select(F.col("p_size").alias("compound_id"), F.col("p_partkey").alias("CID"), F.lit("C").alias("SMILES"), F.lit("").alias("is_solvent"))),
        [put("form", singles.select("stimulus"))],
    )


_RAW_RATED = ", ".join(str(i + 2) for i in range(len(RATINGS)))


@query(
    "E1_labels_from_csv",
    f"""SELECT 'V' || CAST(vec_id AS VARCHAR) AS stimulus, CAST(vec_id % 2 = 0 AS INTEGER) AS Task1, CAST(vec_id % 3 = 0 AS INTEGER) AS Task2_single,
    CAST(vec_id % 5 = 0 AS INTEGER) AS Task2_mix, round(list_sum(list_transform([{_RAW_RATED}], lambda i: (i - 1) * CAST(embedding[i + 1] AS DOUBLE))) / 5, 6) AS rata,
    round((CAST(embedding[1] AS DOUBLE) + 2 * CAST(embedding[2] AS DOUBLE)) / 10, 6) AS overall
    FROM embeddings WHERE (vec_id % 2 = 0 OR vec_id % 3 = 0 OR vec_id % 5 = 0) AND vec_id NOT IN (6, 10)""",
)
def labels_from_csv(spark, sf):
    labels, _ = RAW.tidy_from_csv(spark, _raw_files(spark, sf), ["V6", "V10"])
    digests = [R6(P.vector_digest(c)).alias(c) for c in ("rata", "overall")]
    return labels.select("stimulus", "Task1", "Task2_single", "Task2_mix", *digests)


@query(
    "E1_inputs_from_csv",
    V.with_views(
        "mc",
        """SELECT stimulus, pos, component, cid, dilution, solvent, dense_rank() OVER (ORDER BY uses DESC, solvent) - 1 AS solvent_id, c.compound_id,
        round(CASE WHEN hi = lo THEN 1 ELSE (dilution - lo) / (hi - lo) END, 6) AS weakness FROM
        (SELECT *, max(dilution) OVER (PARTITION BY cid) AS hi, min(dilution) OVER (PARTITION BY cid) AS lo FROM
          (SELECT *, count(*) OVER (PARTITION BY solvent) AS uses FROM wanted) WHERE stimulus NOT IN ('V6', 'V10', 'V100003'))
        LEFT JOIN (SELECT p_partkey AS cid, p_size AS compound_id FROM part WHERE p_size > 10) c USING (cid)""",
        known="""SELECT vec_id AS id FROM embeddings WHERE (vec_id % 2 = 0 OR vec_id % 3 = 0 OR vec_id % 5 = 0) AND vec_id NOT IN (6, 10)
         UNION SELECT s_suppkey + 100000 FROM supplier""",
        defined="SELECT cid, min(ROW(dilution, solvent)) AS d FROM mc GROUP BY cid",
        placed="""SELECT stimulus AS id, CAST(row_number() OVER (PARTITION BY stimulus ORDER BY cid) - 1 AS INTEGER) AS pos, cid FROM mc""",
        wanted="""SELECT 'V' || CAST(id AS VARCHAR) AS stimulus, pos, cid AS component, cid, d[1] AS dilution, d[2] AS solvent FROM placed JOIN defined USING (cid)
         WHERE id IN (SELECT id FROM known) UNION ALL
         SELECT 'V' || CAST(s_suppkey + 100000 AS VARCHAR), 0, NULL, s_suppkey, s_nationkey / 100, 'nt' FROM supplier""",
    ),
)
def inputs_from_csv(spark, sf):
    _, inputs = RAW.tidy_from_csv(spark, _raw_files(spark, sf), ["V6", "V10", "V100003"])
    return inputs.select("stimulus", "pos", "component", "cid", "dilution", "solvent", "solvent_id", "compound_id", R6("weakness").alias("weakness"))


def _tidy_inputs(spark, sf):
    supplier = V.table(spark, sf, "supplier")
    single_id = F.col("s_suppkey") + 20000000
    singles = supplier.select(
        single_id.alias("stimulus"),
        F.col("s_suppkey").alias("cid"),
        (F.col("s_nationkey") / 100).alias("dilution"),
        F.lit(" NT").alias("solvent"),
    )
    components = V.mixture_component(spark, sf).select(F.col("cid").alias("component"), "cid", "dilution", "solvent")
    rated = V.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("stimulus"))
    known = rated.unionByName(supplier.filter("s_acctbal > 0").select(single_id.alias("stimulus")))
    compounds = V.table(spark, sf, "part").filter("p_size > 10").select(
        F.col("p_partkey").alias("cid"), F.col("p_size").alias("compound_id")
    )
    return PL.tidy_inputs(singles, definition_text(spark, sf), components, known, compounds, [3, 20000005])


# --- the panel study ---------------------------------------------------------

_PANEL_OVERALL, _PANEL_RATINGS = ["error", "signup"], ["click", "purchase", "view"]
_PANEL_STEPS = ["structure known", "no unwanted element", "no charge", "one molecule", "molecular weight", "has carbon"]


def _panel(spark, sf) -> PN.Panel:
    """Events as panel ratings: users are stimuli at two dilutions, parts their compounds, three subjects."""
    events = V.table(spark, sf, "events")
    odd = F.col("event_id") % 2 == 1
    raw = events.select(
        F.col("user_id").alias("Stimulus"),
        F.when(F.col("event_id") % 3 == 0, 0.001).otherwise(0.1).alias("Dilution"),
        F.col("event_type").alias("Descriptor"),
        F.col("value").alias("1"),
        F.when(odd, F.col("value") * 2).alias("2"),
        F.when(odd & (F.col("event_id") % 5 == 0), F.lit(50.0)).alias("3"),
        "event_id",
    )
    parts = V.table(spark, sf, "part").filter("p_partkey % 7 > 0").select(
        F.col("p_partkey").alias("CID"),
        F.concat_ws(" ", "p_name", "p_type").alias("IsomericSMILES"),
        F.col("p_brand").alias("IUPACName"),
        (F.col("p_size") * 15).cast("string").alias("name"),
    )
    raw = raw.join(parts, raw["Stimulus"] == parts["CID"], "left")
    rules = PN.cleaning_rules(banned=[*PL.UNWANTED_ELEMENTS, "hot"], weight=F.col("name").cast("double"))
    return PN.panel_data(raw, ["event_id"], _PANEL_RATINGS, _PANEL_OVERALL, rules)


_PANEL_PIVOT = ", ".join(
    f"arg_min(mean, event_id) FILTER (WHERE event_type = '{d}') AS {d}" for d in _PANEL_OVERALL + _PANEL_RATINGS
)
_PANEL_VIEWS = dict(
    m="""SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 0.001::DOUBLE ELSE 0.1::DOUBLE END AS dilution, event_type, event_id,
     CASE WHEN event_id % 10 = 5 THEN (value + value * 2 + 50) / 3 WHEN event_id % 2 = 1 THEN (value + value * 2) / 2 ELSE value END / 100 AS mean FROM events""",
    w=f"SELECT user_id, dilution, {_PANEL_PIVOT} FROM m GROUP BY user_id, dilution",
    d="""SELECT w.*, p_partkey AS cid, p_name || ' ' || p_type AS structure, p_size * 15 AS weight FROM w
     LEFT JOIN part ON p_partkey = user_id AND p_partkey % 7 > 0""",
    f="""SELECT *, CASE WHEN structure IS NULL THEN 1 WHEN regexp_matches(structure, '(^|[^A-Za-z])hot([^A-Za-z]|$)') THEN 2
     WHEN structure LIKE '%.%' THEN 4 WHEN weight NOT BETWEEN 20 AND 600 THEN 5 WHEN NOT regexp_matches(structure, '[Cc]') THEN 6 ELSE 7 END AS fails FROM d""",
    k="""SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY dilution) = 1 THEN 'A' ELSE 'B' END || CAST(user_id AS VARCHAR) AS stimulus,
     dense_rank() OVER (ORDER BY user_id) - 1 AS cmp FROM f WHERE fails = 7""",
)


@query(
    "E1_panel_labels",
    V.with_views(
        "mc",
        """SELECT stimulus, CAST(1 AS INTEGER) AS panel, round(error, 6) AS error, round(signup, 6) AS signup, round(click, 6) AS click,
        round(coalesce(error, 0) + 2 * coalesce(signup, 0) + 3 * coalesce(click, 0) + 4 * coalesce(purchase, 0) + 5 * coalesce(view, 0), 6) AS digest FROM k""",
        **_PANEL_VIEWS,
    ),
)
def panel_labels(spark, sf):
    labels = _panel(spark, sf).labels
    whole = F.transform("ratings_intensity_pleasantness", lambda x: F.coalesce(x, F.lit(0.0)))
    cells = [R6(c).alias(c) for c in ("error", "signup", "click")]
    return labels.select("stimulus", "panel", *cells, R6(P.vector_digest(whole)).alias("digest"))


@query(
    "E1_panel_inputs",
    V.with_views(
        "mc",
        """SELECT k.stimulus, k.cid, k.dilution, CAST(k.cmp AS BIGINT) AS cmp, CAST(2 AS INTEGER) AS info, k.structure AS smiles FROM k""",
        **_PANEL_VIEWS,
    ),
)
def panel_inputs(spark, sf):
    panel = _panel(spark, sf)
    rows = panel.inputs.select(
        "stimulus",
        F.col("CID")[0].alias("cid"),
        F.col("dilution")[0].alias("dilution"),
        F.col("cmp_ids")[0].alias("cmp"),
        F.size("dilution_info").alias("info"),
    )
    return rows.join(panel.compounds.withColumnsRenamed({"CID": "cid", "SMILES": "smiles"}), "cid")


@query(
    "E1_panel_report",
    V.with_views(
        "mc",
        f"""SELECT CAST(i AS INTEGER) AS step, rule, (SELECT count(*) FROM f WHERE fails >= i) AS before,
        (SELECT count(*) FROM f WHERE fails = i) AS removed, (SELECT count(*) FROM f WHERE fails > i) AS after
        FROM (SELECT unnest(range(1, 7)) AS i, unnest({_PANEL_STEPS}) AS rule)""",
        **_PANEL_VIEWS,
    ),
)
def panel_report(spark, sf):
    return _panel(spark, sf).report


# --- published tables ---


@query("S8_published_versions", "SELECT o_orderkey, o_orderstatus FROM orders")
def published_versions(spark, sf):
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    path = scratch_path(spark, "published")
    S.publish(orders.filter("o_orderstatus = 'F'"), path)
    S.publish(orders, path)
    return S.open_published(spark, path)


# --- submissions -------------------------------------------------------------


@query(
    "S8_submission_table",
    "SELECT 'S' || CAST(vec_id AS VARCHAR) AS stimulus, "
    + ", ".join(f'round(greatest(CAST(embedding[{i + 1}] AS DOUBLE), 0), 6) AS "{name}"' for i, name in enumerate(RATINGS))
    + " FROM embeddings",
)
def submission_table(spark, sf):
    key = F.concat(F.lit("S"), F.col("vec_id").cast("string")).alias("stimulus")
    cells = V.long_vectors(spark, sf).filter(F.col("dim") < len(RATINGS))
    scored = cells.select(key, "dim", R6(F.greatest("v", F.lit(0.0))).alias("y_hat"))
    form = V.vectors(spark, sf).select(key)
    path = scratch_path(spark, "submission")
    S.write_submission(scored, form, path)
    return S.read_table(spark, path, SUBMISSION)


@query(
    "E2_fold_scores",
    V.with_views(
        "nv el pr",
        """SELECT fold, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(row_pearson, 6) AS row_pearson, round(cosine, 6) AS cosine FROM
        (SELECT fold, avg(abs(y - y_hat)) AS mae, sqrt(avg((y - y_hat) * (y - y_hat))) AS rmse FROM pr JOIN tests USING (row_id) GROUP BY fold) JOIN
        (SELECT fold, avg(r) AS row_pearson, avg(c) AS cosine FROM (SELECT fold, row_id, corr(y, y_hat) AS r,
         sum(y * y_hat) / (sqrt(sum(y * y)) * sqrt(sum(y_hat * y_hat))) AS c FROM pr JOIN tests USING (row_id) GROUP BY ALL) GROUP BY fold) USING (fold)""",
        tests=f"SELECT fold, row_id FROM ({_kfold_sql('SELECT vec_id AS row_id FROM embeddings')}) WHERE part = 'test'",
    ),
)
def fold_scores(spark, sf):
    ids = V.vectors(spark, sf).select(F.col("vec_id").alias("row_id"))
    scores = PL.fold_scores(V.prediction(spark, sf), SP.kfold(ids, "row_id"))
    return scores.select("fold", *[R6(c).alias(c) for c in scores.columns if c != "fold"])


@query("E3_mixture_model")
def mixture_model(spark, sf):
    return PL.mixture_model(
        V.linked_components(spark, sf), V.vectors(spark, sf), V.stimulus_rating(spark, sf), V.DIMS, [2, 3]
    )


@query("E3_nested_model")
def nested_model(spark, sf):
    targets = [2, 3]
    rows = PL.mixture_rows(
        V.linked_components(spark, sf), V.vectors(spark, sf), V.stimulus_rating(spark, sf), V.DIMS, targets, mix(3, "stimulus") % 5 == 0
    )
    found = PL.nested_model(rows, "stimulus", {d: f"y{d}" for d in targets}, None)
    return found


@query(
    "E3_nested_group_means",
    V.with_views(
        "el",
        """SELECT part, count(DISTINCT row_id) AS n, round(avg(CAST((v > t) = gate AS INTEGER)), 6) AS mask_accuracy, round(avg(abs(v - y_hat)), 6) AS mae,
        round((SELECT avg(r2) FROM c WHERE c.part = s.part), 6) AS r2, round((SELECT sum(a * b) FROM u WHERE u.part = s.part), 6) AS cosine,
        round((SELECT avg(r) FROM c WHERE c.part = s.part), 6) AS pearson FROM s GROUP BY part""",
        g=_GROUPED,
        h=f"SELECT row_id, flag, dim, v, CASE WHEN {mix_sql('3', 'row_id')} % 5 = 0 THEN 'held' ELSE 'train' END AS part FROM g WHERE dim BETWEEN 2 AND 9",
        limits="SELECT dim, quantile_cont(v, 0.5) AS t FROM h WHERE part = 'train' GROUP BY dim",
        counts="""SELECT dim, flag, sum(CAST(v > t AS INTEGER)) AS p, sum(CAST(v <= t AS INTEGER)) AS n, avg(v) FILTER (WHERE v > t) AS high
         FROM h JOIN limits USING (dim) WHERE part = 'train' GROUP BY dim, flag""",
        rules="""SELECT dim, flag, p * sum(n) OVER (PARTITION BY dim) > n * sum(p) OVER (PARTITION BY dim) AS gate, high FROM counts""",
        s="SELECT h.*, t, gate, CASE WHEN gate THEN high ELSE 0 END AS y_hat FROM h JOIN limits USING (dim) JOIN rules USING (dim, flag)",
        c="""SELECT part, dim, 1 - sum((v - y_hat) * (v - y_hat)) / (var_pop(v) * count(*)) AS r2,
         CASE WHEN min(y_hat) < max(y_hat) THEN corr(v, y_hat) END AS r FROM s GROUP BY part, dim""",
        norms="SELECT row_id, sqrt(sum(v * v)) AS nv, sqrt(sum(y_hat * y_hat)) AS ny FROM s GROUP BY row_id",
        u="SELECT part, dim, avg(v / nv) AS a, avg(CASE WHEN ny > 0 THEN y_hat / ny ELSE 0 END) AS b FROM s JOIN norms USING (row_id) GROUP BY part, dim",
    ),
)
def nested_group_means(spark, sf):
    dims = range(2, 10)
    rows = _flagged_rows(spark, sf, dims)
    found = PL.nested_model(
        rows, "row_id", {d: f"y{d}" for d in dims}, mix(3, "row_id") % 5 == 0, trees=1, depth=1, share=1.0
    )
    return found.select("part", "n", *[R6(c).alias(c) for c in ("mask_accuracy", "mae", "r2", "cosine", "pearson")])


_MODELS = {"plain": "y_hat", "positive": "greatest(y_hat, 0)", "squashed": "1 / (1 + exp(-y_hat))"}


@query(
    "E2_models_over_folds",
    V.with_views(
        "nv el pr",
        """SELECT model, part, count(*) AS folds, """
        + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in ("mae", "pearson", "cosine"))
        + """ FROM (SELECT model, fold, part, sum(e) / sum(n) AS mae, avg(r) AS pearson, avg(c) AS cosine FROM byrow GROUP BY ALL) GROUP BY ALL""",
        tagged=f"""SELECT p.*, label AS fold, CASE WHEN {mix_sql('5', 'row_id')} % 5 = 0 THEN 'held' ELSE 'train' END AS part
         FROM pr p JOIN embeddings ON vec_id = row_id""",
        models=" UNION ALL ".join(f"SELECT '{name}' AS model, fold, part, row_id, dim, y, {x} AS y_hat FROM tagged" for name, x in _MODELS.items()),
        byrow="""SELECT model, fold, part, row_id, sum(abs(y - y_hat)) AS e, count(y) AS n,
         CASE WHEN min(y) < max(y) AND min(y_hat) < max(y_hat) THEN corr(y, y_hat) END AS r,
         CASE WHEN sum(y * y) > 0 AND sum(y_hat * y_hat) > 0 THEN sum(y * y_hat) / (sqrt(sum(y * y)) * sqrt(sum(y_hat * y_hat))) END AS c
         FROM models GROUP BY ALL""",
    ),
)
def models_over_folds(spark, sf):
    folds = V.vectors(spark, sf).select(F.col("vec_id").alias("row_id"), F.col("label").alias("fold"))
    part = F.when(mix(5, "row_id") % 5 == 0, "held").otherwise("train")
    cells = V.prediction(spark, sf).join(folds, "row_id").withColumn("part", part)
    kinds = F.array(*[F.struct(F.lit(name).alias("model"), F.expr(x.replace(", 0)", ", 0D)")).alias("p")) for name, x in _MODELS.items()])
    pred = cells.withColumn("_m", F.explode(kinds)).select("_m.model", "fold", "part", "row_id", "dim", "y", F.col("_m.p").alias("y_hat"))
    found = PL.compare_over_folds(pred)
    return found.select(*[R6(c).alias(c) if c.endswith(("_mean", "_std")) else F.col(c) for c in found.columns])


@query(
    "M12_grid_of_group_means",
    V.with_views(
        "el",
        """SELECT CAST(depth AS INTEGER) AS depth, CAST(1 AS INTEGER) AS trees, o.* FROM (SELECT count(DISTINCT row_id) AS n, round(avg(abs(v - m)), 6) AS mae, round(sqrt(avg((v - m) * (v - m))), 6) AS rmse,
          round((SELECT avg(r2) FROM c), 6) AS r2, round((SELECT avg(cs) FROM w), 6) AS cosine, round((SELECT avg(r) FROM w), 6) AS row_pearson,
          round((SELECT avg(r) FROM c), 6) AS column_pearson FROM s) o, range(1, 3) d(depth)""",
        g=_GROUPED,
        h=f"SELECT row_id, flag, dim, v, {mix_sql('1', 'row_id')} % 5 = 0 AS held FROM g WHERE dim BETWEEN 2 AND 5",
        s="SELECT h.*, m FROM h JOIN (SELECT dim, flag, avg(v) AS m FROM h WHERE NOT held GROUP BY dim, flag) USING (dim, flag) WHERE held",
        c="""SELECT dim, 1 - sum((v - m) * (v - m)) / (var_pop(v) * count(*)) AS r2, corr(v, m) AS r FROM s GROUP BY dim""",
        w="SELECT row_id, sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))) AS cs, corr(v, m) AS r FROM s GROUP BY row_id",
    ),
)
def grid_of_group_means(spark, sf):
    rows = _flagged_rows(spark, sf, range(2, 6))
    grid = {"depth": [1, 2], "trees": [1], "share": [1.0]}
    found = ML.grid_scores(rows, "row_id", {d: f"y{d}" for d in range(2, 6)}, mix(1, "row_id") % 5 == 0, grid).drop("share")
    return found.select("depth", "trees", "n", *[R6(c).alias(c) for c in ("mae", "rmse", "r2", "cosine", "row_pearson", "column_pearson")])
