"""Reading, writing and reusing tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.errors import AnalysisException

from medley.schemas import SUBMISSION
from medley.session import delete

MANIFEST = "current"  # names the version of a published table; a name that Spark's readers do not skip


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Headered CSV with an explicit schema; quoted headers and a BOM are accepted.

    Columns are found by their name in the header, in any order; others are left
    out.  A missing column is an error, and so is a value that is not of its type.
    """
    header = [c.removeprefix("\ufeff").strip('"') for c in spark.read.csv(path, header=True, inferSchema=False).columns]
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {missing}; its header is {header}")
    wanted = {f.name: f for f in schema}
    found = StructType([wanted.get(c, StructField(f"_unused{i}", StringType())) for i, c in enumerate(header)])
    rows = spark.read.schema(found).csv(path, header=True, enforceSchema=True, mode="FAILFAST")
    return rows.select([f"`{f.name}`" for f in schema])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def keyed_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table itself, after checking that the key is unique."""
    clash = duplicate_keys(df, keys).limit(1).collect()
    if clash:
        raise ValueError(f"key {keys} is not unique, e.g. {clash[0].asDict()}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet or CSV table."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_submission(pred: DataFrame, form: DataFrame, path: str) -> None:
    """(stimulus, dim, y_hat) as the wide CSV of the submission form: ``stimulus`` and the rating columns in order.

    ``form(stimulus)`` lists the stimuli asked for.  Each of them must have a prediction for every rating;
    predictions of other stimuli are left out.  The columns are pivoted by an aggregate, one shuffle.
    """
    names = SUBMISSION.fieldNames()[1:]
    columns = [F.max(F.when(F.col("dim") == d, F.col("y_hat"))).alias(name) for d, name in enumerate(names)]
    asked = form.select("stimulus").distinct()
    wide = asked.join(pred.groupBy("stimulus").agg(*columns), "stimulus", "left")
    whole = F.lit(True)
    for name in names:
        whole = whole & F.col(f"`{name}`").isNotNull()
    missing = wide.filter(~whole).select("stimulus").limit(3).collect()
    if missing:
        raise ValueError(f"no prediction for every rating of {[r.stimulus for r in missing]}")
    write_table(wide.select("stimulus", *[f"`{n}`" for n in names]), path, "csv")


def publish(df: DataFrame, path: str, keep: int = 1) -> str:
    """Writes the rows as a new version of the table at ``path`` and makes it the current one; its name.

    A version is a folder of its own, written whole before the manifest names it, and the manifest is replaced
    by a rename: readers see one version or the other, a failed write changes nothing, and of two writers the
    later one wins without mixing files.  The ``keep`` versions before the new one stay for readers that have
    them open; older ones are deleted.
    """
    spark = df.sparkSession
    root = path.rstrip("/")
    version = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    write_table(df, f"{root}/{version}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    draft, manifest = hadoop.Path(f"{root}/_draft-{version}"), hadoop.Path(f"{root}/{MANIFEST}")
    files = draft.getFileSystem(conf)
    out = files.create(draft, True)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(draft.toUri(), conf).rename(draft, manifest, options)
    done = sorted(v for v in _versions(spark, root) if v < version and is_complete(spark, f"{root}/{v}"))
    for old in done[: max(0, len(done) - keep)]:
        delete(spark, f"{root}/{old}")
    return version


def _versions(spark: SparkSession, root: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return [s.getPath().getName() for s in found if s.getPath().getName().startswith("version-")]


def open_published(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of a published table, or None when none was published."""
    root = path.rstrip("/")
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")
    if not manifest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(manifest):
        return None
    version = spark.read.text(f"{root}/{MANIFEST}").first().value
    return spark.read.parquet(f"{root}/{version}")


def open_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored Parquet table, or None when nothing is there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write of the table was committed: its marker is there."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Stored table if it was written to its end, else build, store and read back."""
    if not is_complete(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


# --- splits ------------------------------------------------------------------

SPLIT_ROWS = 1_000_000  # rows of a split that a task sorts and writes, about 110 MB in memory


def save_split(split: DataFrame, path: str) -> None:
    """One folder per fold, so reading a fold touches only its files.

    A task sorts its rows by fold before it writes them, so tasks follow the number of rows."""
    tasks = max(1, -(-split.count() // SPLIT_ROWS))
    write_table(split.repartition(tasks, *split.columns), path, partition_by=["fold"])


def load_split(spark: SparkSession, path: str, fold: int) -> DataFrame | None:
    """(row, part) of one fold; None when the split or the fold is missing."""
    stored = open_if_present(spark, path)
    if stored is None:
        return None
    rows = stored.filter(F.col("fold") == fold)
    return None if rows.isEmpty() else rows.drop("fold")


def count_splits(spark: SparkSession, path: str) -> int:
    stored = open_if_present(spark, path)
    return 0 if stored is None else stored.select("fold").distinct().count()


# --- vectors and masks -------------------------------------------------------


def store_vectors(df: DataFrame, path: str) -> None:
    """(row_id, vec) to Parquet."""
    write_table(df.select("row_id", "vec"), path)


def load_vectors(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """Stored vectors, after checking that they and the labels cover the same rows."""
    vectors = spark.read.parquet(path)
    ids, wanted = vectors.select("row_id"), labels.select("row_id")
    extra = ids.join(wanted, "row_id", "left_anti").limit(1).collect()
    missing = wanted.join(ids, "row_id", "left_anti").limit(1).collect()
    if extra or missing:
        raise ValueError(f"vectors and labels differ: extra {extra}, missing {missing}")
    return vectors


def save_mask(mask: DataFrame, path: str) -> None:
    """(dim) of the selected features."""
    write_table(mask.select("dim"), path)


def apply_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Long features restricted to the selected dims."""
    return cells.join(mask.select("dim").distinct(), "dim", "left_semi")
