"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet into the shared folder and reads it back as the next stage's docs.
All but the last return rows of documents with the columns they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medley.llm import digest_index, langid, mixing, packing, simhash
from medley.llm.common import bound_batches, table
from medley.llm.tokens import vocabulary_file
from medley.session import cut

#: SQL cannot express the first, third and last stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the learned languages, also those that switch between some; a NULL text, one
    without letters, and one that no language has a fair share of goes."""
    bound_batches(spark)
    found = langid.identify(docs.withColumns({"__lang": _or_null(docs, "lang_pred"), "__score": _or_null(docs, "score")}), langid.train(docs))
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.SURE))
    own = {"lang_pred": F.col("__lang"), "score": F.col("__score")}
    return kept.select([own[c].alias(c) if c in own else F.col(c) for c in docs.columns])


def _or_null(docs: DataFrame, column: str):
    return F.col(column) if column in docs.columns else F.lit(None).cast("string")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then the smallest id."""
    return digest_index.keep_first_copies(docs, digest_index.fresh_index(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (three-word shingles, two bits): the one with the smallest id."""
    bound_batches(spark)
    return simhash.keep_first_of_groups(docs, width=3, threshold=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    bound_batches(spark)
    pieces = packing.pack(docs, vocabulary_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "source", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
