"""Exact dedup against a persistent digest index, with DataFrame functions only.

The index is a table bucketed and sorted by digest.  A batch of documents is
reduced to one row per digest, compared with the index by a sort-merge anti-join
that leaves the index where it lies, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medley.llm.common import without_white_space
from medley.session import cut

INDEX_SCHEMA = "digest binary, keep_id long, keep_row long, copies long, batch string"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, points) of every row: SHA-256 of the text without white space
    (UTF-8; a NULL text counts as empty) and the code points of the text as it is."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long"),
        F.unhex(F.sha2(without_white_space(text).cast("binary"), 256)).alias("digest"),
        F.coalesce(F.length(text), F.lit(0)).alias("points"),
    )


class DigestIndex:
    """A persistent index; open it again by its name (and by its path in a new session)."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        """``buckets`` defaults to ``spark.sql.shuffle.partitions``: a shuffle by digest then
        lands in the buckets as they are, and each append writes one file per bucket.
        ``path``: folder of the table, for use beyond this session's catalog."""
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path
        if not spark.catalog.tableExists(name):
            place = f"LOCATION '{path}'" if path else ""
            spark.sql(
                f"CREATE TABLE {name} ({INDEX_SCHEMA}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {place}"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, fresh: DataFrame) -> None:
        fresh.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.name)

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Appends what is new in ``docs`` and returns one row per document:
        doc_id, row, digest, keep_id, group_size, kept.

        Of equal texts in the batch the one with the most code points stays, then the
        smallest doc_id (NULL last), then one of the repeated rows.  A text that the
        index already has is not kept again: keep_id names the document that was.
        ``group_size`` counts the copies in this batch and those counted when the text
        was first stored.  An empty batch gives no rows and leaves the index as it is.
        """
        batch = uuid.uuid4().hex
        rows = cut(digests(docs).withColumn("row", F.monotonically_increasing_id()))
        order = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")
        groups = cut(
            rows.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("here"))
        )
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").select(
            "digest",
            F.col("best.doc_id").alias("keep_id"),
            F.col("best.row").alias("keep_row"),
            F.col("here").alias("copies"),
            F.lit(batch).alias("batch"),
        )
        self._append(fresh)
        known = F.col("batch") != F.lit(batch)
        decided = cut(
            groups.select("digest", "here")
            .join(self.rows().hint("merge"), "digest")
            .select(
                "digest",
                "keep_id",
                F.when(~known, F.col("keep_row")).alias("keep_row"),
                (F.col("here") + F.when(known, F.col("copies")).otherwise(F.lit(0))).alias("group_size"),
            )
        )
        return rows.join(decided, "digest").select(
            "doc_id",
            "row",
            "digest",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index under a name of its own, in the session's warehouse."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")


def keep_first_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that are new to the index, one for each text, with the columns they came with.

    The winners are found by (digest, doc_id); repeated rows of a winner (same id,
    same text without white space) are reduced to one, which costs a shuffle of those alone.
    Without repeated rows the texts are shuffled once.
    """
    marked = docs.withColumns(
        {
            "__digest": F.unhex(F.sha2(without_white_space(F.col("text").cast("string")).cast("binary"), 256)),
            "__id": F.col("doc_id").cast("long"),
        }
    )
    verdict = index.ingest(docs)
    winners = verdict.filter("kept").select("digest", F.col("keep_id").alias("winner"))
    twins = (
        verdict.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("twins"))
    )
    chosen = cut(
        winners.join(twins, "digest").select(
            F.col("digest").alias("__key"), F.col("winner").alias("__winner"), F.col("twins").alias("__twins")
        )
    )
    found = marked.join(
        chosen, (F.col("__digest") == F.col("__key")) & F.col("__id").eqNullSafe(F.col("__winner"))
    )
    single = found.filter("__twins = 1").select(docs.columns)
    if chosen.filter("__twins > 1").isEmpty():  # the usual case: no second way, no second shuffle
        return single
    text = F.col("text").cast("string")
    order = F.struct((-F.coalesce(F.length(text), F.lit(0))).alias("points"), text.alias("text"))
    repeated = found.filter("__twins > 1")
    best = repeated.groupBy("__digest").agg(
        F.min_by(F.struct(*[F.col(c) for c in docs.columns]), order).alias("best")
    )
    return single.union(best.select("best.*"))
