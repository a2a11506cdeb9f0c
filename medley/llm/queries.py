"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medley.llm import bitpack, conversations, digest_index, langid, licenses, mixing, packing, pii, pseudo_lm, simhash, token_counts, topk, whitening
from medley.llm.common import bound_batches, table
from medley.llm.tokens import vocabulary_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return add


@query(
    "op1_segment_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0)
                  AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    ), r AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op1_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, F.col("vec_id") % 20 == 0, k=20)


@query("op2_anchor_simhash")
def op2_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query(
    "op3_digest_index",
    """
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
             sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
      FROM documents
    ), g AS (
      SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d
    )
    SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
)
def op3_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digest_index.fresh_index(spark).ingest(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op4_crf_language")
def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagged = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return tagged.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


@query("op5_patience_licenses")
def op5_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


@query("op6_deficit_packing")
def op6_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op7_pseudo_likelihood")
def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score_words(table(spark, sf_dir, "documents"))


@query(
    "op8_threshold_mixing",
    """
    WITH d AS (
      SELECT doc_id, source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
      FROM documents
    ), s AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
    ), w AS (
      SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
             source_size * 2.0::DOUBLE AS room
      FROM s
    ), f AS (
      SELECT *, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget,
             coalesce(sum(room) OVER (ORDER BY room / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER (ORDER BY room / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM w
    ), l AS (
      SELECT *, (budget - filled) / rest AS level FROM f
    ), h AS (
      SELECT level AS height FROM l WHERE level * weight <= room ORDER BY room / weight, level LIMIT 1
    ), t AS (
      SELECT source, source_size, least(room, coalesce((SELECT height FROM h) * weight, room)) AS target FROM l
    ), b AS (
      SELECT source, source_size, target,
             CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole
      FROM t
    ), r AS (
      SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS here
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
    )
    SELECT doc_id, size, source_size, target,
           CAST(size * least(2, whole + CASE WHEN 2 * upto - here <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM r
    """,
)
def op8_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op9_checked_pii")
def op9_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(table(spark, sf_dir, "documents")))


@query("op10_bit_packed_tokens")
def op10_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = bitpack.token_folder(spark)
    manifest = bitpack.write_token_files(
        table(spark, sf_dir, "documents"), folder, vocabulary_file("word_bpe_49k.json")
    )
    return bitpack.read_token_files(spark, folder, manifest)


@query("op11_integer_repair", conversations.plain_sql())
def op11_integer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


@query("op12_batch_token_counts")
def op12_batch_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), limit=512)


@query("op13_multiplicity_whitening")
def op13_multiplicity_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)
