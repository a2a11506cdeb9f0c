"""Projections, filters, joins, deduplication, ids and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from medley.functions import lists as A
from medley.operators import explore as X
from medley.operators import joins as J
from medley.operators import ordered as O
from medley.operators import tidy as T
from medley.plans import views as V
from medley.plans.registry import query

R6 = V.round_to


# --- projections -------------------------------------------------------------


@query("P1_select_rename", "SELECT o_orderkey AS stimulus, o_orderpriority AS priority, o_custkey AS panel FROM orders")
def select_rename(spark, sf):
    orders = V.table(spark, sf, "orders").drop("o_orderdate", "o_totalprice", "o_orderstatus")
    renamed = orders.withColumnsRenamed(
        {"o_orderkey": "stimulus", "o_custkey": "panel", "o_orderpriority": "priority"}
    )
    return renamed.select("stimulus", "priority", "panel")


@query("P2_all_but", "SELECT * EXCLUDE (c_name, c_mktsegment) FROM customer")
def all_but(spark, sf):
    df = V.table(spark, sf, "customer")
    return df.select(*T.all_but(df, "c_name", "c_mktsegment"))


_NUMERIC = ", ".join(f'round(CAST(embedding[{d + 1}] AS DOUBLE), 6) AS "{d}"' for d in range(64))


def _numeric_wide(spark, sf):
    return V.vectors(spark, sf).select("vec_id", "label", *[R6(F.col("vec")[d]).alias(str(d)) for d in range(V.DIMS)])


@query("P3_numeric_names", f"SELECT {_NUMERIC} FROM embeddings")
def numeric_names(spark, sf):
    wide = _numeric_wide(spark, sf)
    return wide.select(*T.matching(wide))


@query(
    "P4_columns_to_array",
    """SELECT p_partkey, 0 AS pos, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL
    SELECT p_partkey, 1, p_retailprice FROM part""",
)
def columns_to_array(spark, sf):
    packed = V.table(spark, sf, "part").select(
        "p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("both")
    )
    return packed.select("p_partkey", F.posexplode("both").alias("pos", "value"))


@query("P5_tag_columns", "SELECT doc_id, 1 AS task1, 0 AS task2_single, 0 AS task2_mix FROM labels")
def tag_columns(spark, sf):
    return V.table(spark, sf, "labels").select("doc_id").withColumns(
        {"task1": F.lit(1), "task2_single": F.lit(0), "task2_mix": F.lit(0)}
    )


@query(
    "P6_fixed_scaling",
    """SELECT l_orderkey, round(l_quantity / 5, 6) AS rating, round(l_extendedprice / 10, 6) AS intensity,
    round(l_tax / 100, 6) AS panel FROM lineitem""",
)
def fixed_scaling(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey",
        R6(F.col("l_quantity") / 5).alias("rating"),
        R6(F.col("l_extendedprice") / 10).alias("intensity"),
        R6(F.col("l_tax") / 100).alias("panel"),
    )


@query("P7_trim_strings", "SELECT doc_id, md5(trim(text)) AS text_md5, trim(lang) AS lang FROM documents")
def trim_strings(spark, sf):
    trimmed = T.trim_strings(V.table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return trimmed.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang")


@query("P8_lower_column", "SELECT p_partkey, lower(p_type) AS p_type FROM part")
def lower_column(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("p_type"))


@query(
    "P8_lower_names_merged",
    "SELECT doc_id, CAST(quality <> 0 OR toxic <> 0 AS INTEGER) AS flag, quality AS kept FROM labels",
)
def lower_names(spark, sf):
    labels = V.table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("Flag"), F.col("toxic").alias("flag"), F.col("quality").alias("Kept")
    )
    return T.lower_names(labels, ["Flag", "flag", "Kept"])


@query("P9_strip_suffix", "SELECT user_id, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY user_id")
def strip_suffix(spark, sf):
    grouped = V.table(spark, sf, "events").groupBy(F.col("user_id")).agg(
        R6(F.avg("value")).alias("value_mean"), F.count(F.lit(1)).alias("n_mean")
    )
    return T.strip_suffix(grouped, "_mean")


@query(
    "P10_rounded_key",
    """SELECT key, count(*) AS n FROM (SELECT concat_ws('-', CAST(CAST(round(l_discount, 6) AS DECIMAL(38,6)) AS VARCHAR),
    CAST(CAST(round(l_tax, 6) AS DECIMAL(38,6)) AS VARCHAR), CAST(CAST(round(l_quantity, 6) AS DECIMAL(38,6)) AS VARCHAR)) AS key
    FROM lineitem) GROUP BY key""",
)
def rounded_key(spark, sf):
    keyed = V.table(spark, sf, "lineitem").select(T.rounded_key(["l_discount", "l_tax", "l_quantity"]).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("P11_empty_column", "SELECT p_partkey, CAST(NULL AS VARCHAR) AS components, CAST(NULL AS DOUBLE) AS rata FROM part")
def empty_column(spark, sf):
    return V.table(spark, sf, "part").select(
        "p_partkey", T.empty_column("components"), T.empty_column("rata", "double")
    )


@query(
    "P13_drop_null_columns",
    "SELECT d.doc_id, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def drop_null_columns(spark, sf):
    joined = V.table(spark, sf, "documents").select("doc_id", "n_chars").join(
        V.table(spark, sf, "labels"), "doc_id", "left"
    )
    return T.drop_null_columns(joined, ["n_chars", "quality", "toxic"])


@query("P14_drop_rare_columns", "SELECT doc_id, CAST(n_chars > 100 AS INTEGER) AS common FROM documents")
def drop_rare_columns(spark, sf):
    flags = V.table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") > 100).cast("int").alias("common"), (F.col("doc_id") == 0).cast("int").alias("rare")
    )
    return T.drop_rare_columns(flags, ["common", "rare"], 40)


# --- filters -----------------------------------------------------------------


@query("F1_any_task_flag", "SELECT doc_id, quality, toxic FROM labels WHERE quality <> 0 OR toxic <> 0")
def any_task(spark, sf):
    return T.with_any_task(V.table(spark, sf, "labels"), ["quality", "toxic"])


@query("F2_exclusion_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def exclusion(spark, sf):
    orders = V.table(spark, sf, "orders")
    return orders.filter(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@query("F3_positive_ids", "SELECT cid, count(*) AS n FROM (SELECT l_partkey AS cid FROM lineitem) WHERE cid > 0 GROUP BY cid")
def positive_ids(spark, sf):
    return V.mixture_component(spark, sf).filter("cid > 0").groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


_LABELLED = "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def _labelled_documents(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "n_chars").join(
        V.table(spark, sf, "labels"), "doc_id", "left"
    )


@query("F4_drop_null_key", f"SELECT doc_id, quality FROM ({_LABELLED}) WHERE quality IS NOT NULL")
def drop_null_key(spark, sf):
    return _labelled_documents(spark, sf).dropna(subset=["quality"]).select("doc_id", "quality")


@query("F5_drop_all_zero", "SELECT doc_id, quality, toxic FROM labels WHERE NOT (quality = 0 AND toxic = 0)")
def drop_all_zero(spark, sf):
    return T.drop_all_zero(V.table(spark, sf, "labels"), ["quality", "toxic"])


@query(
    "F6_text_contains",
    """SELECT doc_id, contains(text, '.') AS multi_part, contains(text, ';') AS mixture,
    regexp_matches(text, '[Cc]') AS has_letter FROM documents WHERE contains(text, '.') OR NOT contains(text, ';')""",
)
def text_contains(spark, sf):
    docs = V.table(spark, sf, "documents")
    text = F.col("text")
    kept = docs.filter(text.contains(".") | ~text.contains(";"))
    return kept.select(
        "doc_id",
        text.contains(".").alias("multi_part"),
        text.contains(";").alias("mixture"),
        text.rlike("[Cc]").alias("has_letter"),
    )


_BANNED = ["ring", "bolt", "gear"]


@query(
    "F7_banned_tokens",
    "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(?:^|[^A-Za-z])(?:ring|bolt|gear)(?:[^A-Za-z]|$)')",
)
def banned_tokens(spark, sf):
    return T.without_tokens(V.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", _BANNED)


@query(
    "F8_inclusive_range",
    "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN CAST(900.1 AS DOUBLE) AND CAST(950.0 AS DOUBLE)",
)
def inclusive_range(spark, sf):
    part = V.table(spark, sf, "part")
    return part.filter(F.col("p_retailprice").between(900.1, 950.0)).select("p_partkey", "p_retailprice")


@query(
    "F9_all_or_any_members",
    V.with_views(
        "mc sz",
        """SELECT stimulus, bool_and(k.cid IS NOT NULL) AS complete, bool_or(k.cid IS NOT NULL) AS seen
        FROM mc LEFT JOIN (SELECT DISTINCT cid FROM mc JOIN sz USING (stimulus) WHERE n = 1) k USING (cid) GROUP BY stimulus""",
    ),
)
def members(spark, sf):
    entries = V.mixture_component(spark, sf)
    return X.coverage(entries, X.singles(entries), "stimulus", ["cid"]).select("stimulus", "complete", "seen")


@query(
    "F10_size_filter",
    V.with_views("mc sz", "SELECT stimulus, n AS size FROM sz WHERE n = 3 OR n > 5"),
)
def size_filter(spark, sf):
    sizes = V.mixture_component(spark, sf).groupBy("stimulus").agg(F.count(F.lit(1)).alias("size"))
    return sizes.filter((F.col("size") == 3) | (F.col("size") > 5))


@query(
    "F11_threshold_masks",
    V.with_views(
        "el lab",
        """SELECT row_id, lab.dim, y > t AS mask FROM lab JOIN (SELECT dim, quantile_cont(y, 0.5) AS t FROM lab GROUP BY dim) USING (dim)""",
    ),
)
def threshold_masks(spark, sf):
    cells = V.stimulus_label(spark, sf)
    cuts = O.exact_quantiles(cells, ["dim"], "y", [0.5]).select("dim", F.col("y").alias("t"))
    return cells.join(cuts, "dim").select("row_id", "dim", (F.col("y") > F.col("t")).alias("mask"))


@query(
    "F12_padding_rows",
    V.with_views(
        "mc nv",
        "SELECT cid >= (SELECT n FROM nv) AS padding, count(*) AS n FROM mc GROUP BY 1",
    ),
)
def padding_rows(spark, sf):
    entries = V.mixture_component(spark, sf).select(F.col("cid").alias("vec_id"))
    gathered = J.gather(entries, V.vectors(spark, sf), "vec_id", "vec", V.DIMS, A.PADDING)
    return gathered.select(A.is_padding("vec", float(A.PADDING)).alias("padding")).groupBy("padding").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "F13_fetch_sample",
    V.with_views(
        "mc",
        """SELECT r.row_id, mc.stimulus, mc.cid, mc.dilution, r.price FROM mc JOIN
        (SELECT o_orderkey AS stimulus, o_totalprice AS price, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders) r
        USING (stimulus) WHERE r.row_id = 7""",
    ),
)
def fetch_sample(spark, sf):
    orders = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("stimulus"), F.col("o_totalprice").alias("price")
    )
    row = T.surrogate_ids(orders, ["stimulus"]).filter("row_id = 7")
    return row.join(V.mixture_component(spark, sf), "stimulus").select("row_id", "stimulus", "cid", "dilution", "price")


# --- joins -------------------------------------------------------------------


@query(
    "J1_inputs_with_labels",
    V.with_views(
        "mc", "SELECT stimulus, cid, dilution, o_totalprice AS label FROM mc JOIN orders ON o_orderkey = stimulus"
    ),
)
def inputs_with_labels(spark, sf):
    labels = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("stimulus"), F.col("o_totalprice").alias("label")
    )
    return V.mixture_component(spark, sf).join(labels, "stimulus").select("stimulus", "cid", "dilution", "label")


@query(
    "J2_semi_join",
    V.with_views(
        "mc", "SELECT stimulus, cid FROM mc WHERE stimulus IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"
    ),
)
def semi_join(spark, sf):
    rated = V.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("stimulus"))
    return J.present_in(V.mixture_component(spark, sf), rated, ["stimulus"]).select("stimulus", "cid")


@query(
    "J3_anti_join",
    """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    AND doc_id NOT IN (SELECT page_id FROM pages) AND doc_id NOT IN (SELECT item_id FROM benchmark)""",
)
def anti_join(spark, sf):
    t = lambda n, c: V.table(spark, sf, n).select(F.col(c).alias("doc_id"))
    others = [t("labels", "doc_id"), t("pages", "page_id"), t("benchmark", "item_id")]
    return J.absent_from_all(t("documents", "doc_id"), "doc_id", others)


@query(
    "J4_left_join_first",
    V.with_views(
        "mc",
        """SELECT p_partkey AS cid, p_size, stimulus, dilution FROM part LEFT JOIN
        (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY stimulus, dilution, component) AS rn FROM mc) f
        ON f.cid = p_partkey AND rn = 1""",
    ),
)
def left_join_first(spark, sf):
    part = V.table(spark, sf, "part").select(F.col("p_partkey").alias("cid"), "p_size")
    right = V.mixture_component(spark, sf).select("cid", "stimulus", "dilution", "component")
    joined = J.left_with_first(part, right, ["cid"], ["stimulus", "dilution", "component"])
    return joined.select("cid", "p_size", "stimulus", "dilution")


_RICH = "(SELECT s_suppkey AS component, s_nationkey AS code FROM supplier WHERE s_acctbal > 0)"


@query(
    "J5_lookup_pass_through",
    V.with_views(
        "mc",
        f"""SELECT stimulus, component, coalesce(code, CAST(component AS INTEGER)) AS mapped, code AS mapped_or_null
        FROM mc LEFT JOIN {_RICH} USING (component)""",
    ),
)
def lookup(spark, sf):
    table = V.table(spark, sf, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("component"), F.col("s_nationkey").alias("code")
    )
    entries = V.mixture_component(spark, sf).select("stimulus", "component")
    mapped = J.lookup(entries, "component", table, "code", "mapped", True)
    return J.lookup(mapped, "component", table, "code", "mapped_or_null", False)


def definition_text(spark, sf):
    """The ';' list of component ids of every stimulus."""
    lists = T.regroup(V.mixture_component(spark, sf).select("stimulus", "cid"), "stimulus", ["cid"], ["cid"])
    return lists.select("stimulus", A.join_list("cid").alias("components"))


@query(
    "J6_expand_definition",
    V.with_views(
        "mc",
        """SELECT d.stimulus, d.pos, d.cid AS component, f.dilution, f.solvent FROM
        (SELECT stimulus, cid, CAST(row_number() OVER (PARTITION BY stimulus ORDER BY cid) - 1 AS INTEGER) AS pos FROM mc) d JOIN
        (SELECT cid, dilution, solvent FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY dilution, solvent) AS rn FROM mc)
         WHERE rn = 1) f USING (cid)""",
    ),
)
def expand_definition(spark, sf):
    components = V.mixture_component(spark, sf).select(F.col("cid").alias("component"), "dilution", "solvent")
    expanded = J.expand_definition(
        definition_text(spark, sf), "stimulus", "components", components, ["dilution", "solvent"], ["dilution", "solvent"]
    )
    return expanded.select("stimulus", "pos", "component", "dilution", "solvent")


@query(
    "J7_feature_gather",
    V.with_views(
        "mc nv el",
        """SELECT mc.stimulus, mc.cid, round(coalesce(e.first, -999), 6) AS first, round(coalesce(e.total, -999 * 64), 6) AS total
        FROM mc LEFT JOIN (SELECT vec_id, sum(v) AS total, max(v) FILTER (WHERE dim = 0) AS first FROM el GROUP BY vec_id) e
        ON e.vec_id = mc.cid""",
    ),
)
def feature_gather(spark, sf):
    entries = V.mixture_component(spark, sf).select("stimulus", "cid", F.col("cid").alias("vec_id"))
    gathered = J.gather(entries, V.vectors(spark, sf), "vec_id", "vec", V.DIMS, A.PADDING)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return gathered.select("stimulus", "cid", R6(F.col("vec")[0]).alias("first"), R6(total).alias("total"))


_SINGLE_KEYS = "SELECT DISTINCT solvent, dilution, cid FROM mc JOIN sz USING (stimulus) WHERE n = 1"


@query(
    "J8_composite_membership",
    V.with_views(
        "mc sz",
        f"""SELECT stimulus, cid, dilution, solvent FROM mc WHERE EXISTS (SELECT 1 FROM ({_SINGLE_KEYS}) k
        WHERE k.solvent = mc.solvent AND k.dilution = mc.dilution AND k.cid = mc.cid)""",
    ),
)
def composite_membership(spark, sf):
    entries = V.mixture_component(spark, sf)
    found = J.present_in(entries, X.singles(entries), ["solvent", "dilution", "cid"])
    return found.select("stimulus", "cid", "dilution", "solvent")


@query(
    "J11_reconcile_sources",
    """SELECT o_orderkey AS stimulus, round(o_totalprice, 2) AS total_a, round(s, 2) AS total_b FROM orders JOIN
    (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    WHERE abs(o_totalprice - s) > 0.005""",
)
def reconcile(spark, sf):
    a = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("stimulus"), F.col("o_totalprice").alias("a"))
    b = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("stimulus")).agg(
        F.sum("l_extendedprice").alias("b")
    )
    differing = J.disagreements(a, b, ["stimulus"], "a", "b", 0.005)
    return differing.select("stimulus", V.round_to("a", 2).alias("total_a"), V.round_to("b", 2).alias("total_b"))


# --- deduplication, grouping -------------------------------------------------


@query(
    "G1_merge_duplicates",
    """SELECT l_partkey AS stimulus, max(CAST(l_returnflag = 'A' AS INTEGER)) AS task1, max(CAST(l_linestatus = 'F' AS INTEGER)) AS task2,
    min(l_discount) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY l_partkey, round(l_discount, 6), round(l_tax, 6)""",
)
def merge_duplicates(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("stimulus"),
        (F.col("l_returnflag") == "A").cast("int").alias("task1"),
        (F.col("l_linestatus") == "F").cast("int").alias("task2"),
        "l_discount",
        "l_tax",
    )
    return T.merge_duplicates(rows, "stimulus", ["l_discount", "l_tax"], ["task1", "task2"])


@query(
    "G2_keep_first",
    V.with_views(
        "mc",
        """SELECT stimulus, dilution, cid, component FROM (SELECT *, row_number() OVER
        (PARTITION BY stimulus ORDER BY dilution, cid, component) AS rn FROM mc) WHERE rn = 1""",
    ),
)
def keep_first(spark, sf):
    entries = V.mixture_component(spark, sf).select("stimulus", "dilution", "cid", "component")
    return T.keep_first(entries, ["stimulus"], ["dilution", "cid", "component"])


@query("G3_unique_values", V.with_views("mc", "SELECT DISTINCT cid, solvent FROM mc"))
def unique_values(spark, sf):
    return V.mixture_component(spark, sf).select("cid", "solvent").distinct()


@query("G4_frequency_table", V.with_views("mc", "SELECT cid, count(*) AS n FROM mc GROUP BY cid ORDER BY n DESC, cid"))
def frequency(spark, sf):
    return X.frequency(V.mixture_component(spark, sf), "cid")


@query(
    "G5_counts",
    V.with_views(
        "mc sz",
        """SELECT count(*) AS n_rows, count(DISTINCT cid) AS n_components, count(DISTINCT stimulus) AS n_stimuli,
        (SELECT max(n) FROM sz) AS longest FROM mc""",
    ),
)
def counts(spark, sf):
    entries = V.mixture_component(spark, sf)
    per_stimulus = entries.groupBy("stimulus").agg(F.count(F.lit(1)).alias("n"))
    totals = per_stimulus.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_stimuli"), F.max("n").alias("longest")
    )
    return totals.withColumn("n_components", entries.select("cid").distinct().select(F.count(F.lit(1))).scalar())


@query(
    "G6_row_mean_skipping_nulls",
    f"""SELECT doc_id, round((n_chars + coalesce(quality, 0) + coalesce(toxic, 0)) /
    (1 + CAST(quality IS NOT NULL AS INTEGER) + CAST(toxic IS NOT NULL AS INTEGER))::DOUBLE, 6) AS mean FROM ({_LABELLED})""",
)
def row_mean(spark, sf):
    values = F.filter(F.array(*[F.col(c).cast("double") for c in ("n_chars", "quality", "toxic")]), lambda x: x.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    mean = F.try_divide(total, F.size(values))
    return _labelled_documents(spark, sf).select("doc_id", R6(mean).alias("mean"))


_TYPES = ["click", "error", "login", "purchase", "view"]


@query(
    "G7_pivot_first",
    "SELECT user_id, day, "
    + ", ".join(f"max(value) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES)
    + """ FROM (SELECT user_id, CAST(dayofyear(ts) AS INTEGER) AS day, event_type, value, row_number() OVER
    (PARTITION BY user_id, dayofyear(ts), event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 GROUP BY user_id, day""",
)
def pivot_first(spark, sf):
    events = V.table(spark, sf, "events").withColumn("day", F.dayofyear("ts"))
    return T.pivot_first(events, ["user_id", "day"], "event_type", _TYPES, "value", ["ts", "event_id"])


@query(
    "G8_regroup_lists",
    V.with_views(
        "mc",
        """SELECT stimulus, string_agg(CAST(cid AS VARCHAR), ';' ORDER BY cid, component, solvent) AS cids,
        string_agg(CAST(component AS VARCHAR), ';' ORDER BY cid, component, solvent) AS components,
        string_agg(solvent, ';' ORDER BY cid, component, solvent) AS solvents FROM mc GROUP BY stimulus""",
    ),
)
def regroup(spark, sf):
    entries = V.mixture_component(spark, sf)
    rows = T.regroup(entries, "stimulus", ["cid", "component", "solvent"], ["cid", "component", "solvent"])
    return rows.select(
        "stimulus",
        A.join_list("cid").alias("cids"),
        A.join_list("component").alias("components"),
        A.join_list("solvent").alias("solvents"),
    )


# --- windows and ids ---------------------------------------------------------


@query(
    "W1_first_later_prefix",
    V.with_views(
        "mc",
        """SELECT CASE WHEN rn = 1 THEN 'A' ELSE 'B' END || CAST(stimulus AS VARCHAR) AS stimulus, dilution, cid, count(*) AS copies FROM
        (SELECT stimulus, dilution, cid, row_number() OVER (PARTITION BY stimulus ORDER BY dilution, cid) AS rn FROM mc) GROUP BY ALL""",
    ),
)
def first_later(spark, sf):
    rows = V.mixture_component(spark, sf).select("stimulus", "dilution", "cid")
    return T.mark_first(rows, "stimulus", ["dilution", "cid"])


@query(
    "W2_drop_shadowed_duplicates",
    V.with_views(
        "mc",
        """SELECT stimulus, cid, dilution, solvent, detail FROM (SELECT *, count(*) OVER (PARTITION BY stimulus, cid, dilution, solvent) AS n
        FROM (SELECT DISTINCT * FROM (SELECT stimulus, cid, dilution, solvent, component AS detail FROM mc UNION ALL
          SELECT stimulus, cid, dilution, solvent, NULL FROM mc WHERE solvent <> 'A' UNION ALL
          SELECT stimulus + 10000000, cid, dilution, solvent, NULL FROM mc WHERE solvent = 'A'))) WHERE NOT (n > 1 AND detail IS NULL)""",
    ),
)
def drop_shadowed(spark, sf):
    entries = V.mixture_component(spark, sf)
    keys = ["stimulus", "cid", "dilution", "solvent"]
    full = entries.select(*keys, F.col("component").alias("detail"))
    bare = entries.select(
        F.when(F.col("solvent") == "A", F.col("stimulus") + 10000000).otherwise(F.col("stimulus")).alias("stimulus"),
        "cid", "dilution", "solvent", F.lit(None).cast("long").alias("detail"),
    )
    return T.drop_shadowed(full.unionByName(bare), keys, "detail")


@query(
    "W3_min_max_position",
    V.with_views(
        "mc",
        """SELECT stimulus, cid, dilution, round(CASE WHEN hi = lo THEN 1 ELSE (dilution - lo) / (hi - lo) END, 6) AS weakness FROM
        (SELECT *, min(dilution) OVER (PARTITION BY cid) AS lo, max(dilution) OVER (PARTITION BY cid) AS hi FROM mc)""",
    ),
)
def min_max_position(spark, sf):
    placed = T.min_max_position(V.mixture_component(spark, sf), "cid", "dilution", "weakness")
    return placed.select("stimulus", "cid", "dilution", R6("weakness").alias("weakness"))


@query(
    "W4_ids_by_first_seen",
    V.with_views(
        "mc",
        """SELECT cid, row_number() OVER (ORDER BY s, d, cid) - 1 AS id FROM (SELECT cid, stimulus AS s, dilution AS d FROM
        (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY stimulus, dilution) AS rn FROM mc) WHERE rn = 1)""",
    ),
)
def ids_by_first_seen(spark, sf):
    return T.ids_by_first_seen(V.mixture_component(spark, sf), "cid", ["stimulus", "dilution"])


@query(
    "W5_ids_by_frequency",
    V.with_views(
        "mc",
        "SELECT cid, n, row_number() OVER (ORDER BY n DESC, cid) - 1 AS id FROM (SELECT cid, count(*) AS n FROM mc GROUP BY cid)",
    ),
)
def ids_by_frequency(spark, sf):
    return T.ids_by_frequency(V.mixture_component(spark, sf), "cid")


@query("W6_surrogate_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders")
def surrogate_ids(spark, sf):
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return T.surrogate_ids(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_id")


@query(
    "W6_ids_without_order",
    "SELECT unnest(range(count(*))) AS row_id, 1::BIGINT AS n FROM orders",
)
def ids_without_order(spark, sf):
    ids = T.surrogate_ids(V.table(spark, sf, "orders").select("o_orderkey"))
    return ids.groupBy("row_id").agg(F.countDistinct("o_orderkey").alias("n"))


@query(
    "W7_running_mean",
    """SELECT user_id, event_id, count(*) OVER w AS n, round(avg(value) OVER w, 9) AS mean FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_mean(spark, sf):
    events = V.table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    rows = O.Ordered(events, ["user_id"], ["ts", "event_id"]).with_running(
        O.Running("n", "sum", F.lit(1).cast("long")), O.Running("total", "sum", F.col("value"))
    )
    return rows.rows().select("user_id", "event_id", "n", V.round_to(F.col("total") / F.col("n"), 9).alias("mean"))


EARLY_STOP_SQL = """WITH s AS (SELECT user_id, value, row_number() OVER w - 1 AS step, max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, max(CASE WHEN before IS NULL OR value >= before THEN step END) OVER (PARTITION BY user_id ORDER BY step) AS last FROM s),
e AS (SELECT *, min(CASE WHEN step - last >= 10 THEN step END) OVER (PARTITION BY user_id) AS stop FROM i)
SELECT user_id, stop AS stop_step, max(last) AS best_step, round(max(value), 6) AS best, max(step) + 1 AS steps
FROM e WHERE stop IS NULL OR step <= stop GROUP BY user_id, stop"""


@query("W8_early_stop", EARLY_STOP_SQL)
def early_stop(spark, sf):
    from medley.operators.early import early_stop as detect

    events = V.table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    found = detect(events, "user_id", ["ts", "event_id"], "value", patience=10)
    return found.select("user_id", "stop_step", "best_step", R6("best").alias("best"), "steps")


@query(
    "W9_average_ranks",
    V.with_views(
        "el lab",
        """SELECT DISTINCT dim, round(y, 9) AS y, rank() OVER (PARTITION BY dim ORDER BY y) + (count(*) OVER (PARTITION BY dim, y) - 1) / 2.0::DOUBLE AS avg_rank
        FROM lab""",
    ),
)
def average_ranks(spark, sf):
    from medley.operators.metrics import average_ranks as ranks

    found = ranks(V.stimulus_label(spark, sf), ["dim"], "y")
    return found.select("dim", V.round_to("y", 9).alias("y"), "avg_rank")


# --- order, sets -------------------------------------------------------------


@query("O1_multi_key_sort", V.with_views("mc", "SELECT stimulus, dilution, cid FROM mc ORDER BY stimulus, dilution DESC, cid"))
def multi_key_sort(spark, sf):
    return V.mixture_component(spark, sf).select("stimulus", "dilution", "cid").orderBy("stimulus", F.desc("dilution"), "cid")


@query(
    "O2_sort_inside_key",
    V.with_views("mc", "SELECT cid, dilution, stimulus, row_number() OVER (PARTITION BY cid ORDER BY dilution, stimulus) AS rn FROM mc"),
)
def sort_inside_key(spark, sf):
    rows = V.mixture_component(spark, sf).select("cid", "dilution", "stimulus")
    return O.row_numbers(rows, ["cid"], ["dilution", "stimulus"])


@query("O3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "O4_reorder_by_cluster",
    V.with_views(
        "el",
        """SELECT dim, cluster, row_number() OVER (ORDER BY cluster, dim) - 1 AS place, round(mean, 6) AS mean FROM
        (SELECT dim, avg(v) AS mean, CASE WHEN avg(v) > 0 THEN 1 ELSE 0 END AS cluster FROM el GROUP BY dim)""",
    ),
)
def reorder_by_cluster(spark, sf):
    means = V.long_vectors(spark, sf).groupBy("dim").agg(F.avg("v").alias("mean"))
    clusters = means.select("dim", F.when(F.col("mean") > 0, 1).otherwise(0).alias("cluster"))
    placed = T.surrogate_ids(means.join(clusters, "dim"), ["cluster", "dim"], "place")
    return placed.select("dim", "cluster", "place", R6("mean").alias("mean"))


@query(
    "O5_best_configuration",
    """SELECT o_orderpriority AS model, max_by(o_orderstatus, (score, o_orderstatus)) AS config, round(max(score), 6) AS score FROM
    (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 6) AS score FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def best_configuration(spark, sf):
    scores = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model"), "o_orderstatus").agg(
        R6(F.avg("o_totalprice")).alias("score")
    )
    best = F.max_by("o_orderstatus", F.struct("score", "o_orderstatus"))
    return scores.groupBy("model").agg(best.alias("config"), F.max("score").alias("score"))


@query(
    "U1_union_by_name",
    "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
)
def union_by_name(spark, sf):
    a = V.table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment")
    b = V.table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance")
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "U2_difference",
    "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def difference(spark, sf):
    customers = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    urgent = V.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return customers.subtract(urgent.select(F.col("o_custkey").alias("id")))


_BOTH = "(SELECT l_partkey AS id FROM lineitem {op} SELECT l_suppkey FROM lineitem)"


@query(
    "U3_union_intersection",
    f"SELECT 'union' AS kind, id FROM {_BOTH.format(op='UNION')} UNION ALL SELECT 'both', id FROM {_BOTH.format(op='INTERSECT')}",
)
def union_intersection(spark, sf):
    entries = V.mixture_component(spark, sf)
    a, b = entries.select(F.col("cid").alias("id")).distinct(), entries.select(F.col("component").alias("id")).distinct()
    either = a.union(b).distinct().select(F.lit("union").alias("kind"), "id")
    return either.union(a.intersect(b).select(F.lit("both"), "id"))


@query(
    "U4_singletons_appended",
    """SELECT l_orderkey AS stimulus, l_partkey AS cid, 'mixture' AS origin FROM lineitem UNION ALL
    SELECT -1 - p_partkey, p_partkey, 'single' FROM part WHERE p_size > 0""",
)
def singletons_appended(spark, sf):
    mixtures = V.mixture_component(spark, sf).select("stimulus", "cid").withColumn("origin", F.lit("mixture"))
    part = V.table(spark, sf, "part").select("p_partkey", "p_size")
    singles = T.with_any_task(part, ["p_size"]).select(
        (-1 - F.col("p_partkey")).alias("stimulus"), F.col("p_partkey").alias("cid"), F.lit("single").alias("origin")
    )
    return mixtures.unionByName(singles)
