"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "medley", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume: UTC, AQE with skew-join
    splitting, Arrow transfer.  Anything given in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster without
    the setting is an error, since a machine-local folder dies with its node.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="medley-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per context: a driver that put it
    on its own path only does not have it there."""
    context = spark.sparkContext
    if getattr(context, "_medley_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="medley-package-"), "medley.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    context._medley_shipped = True


_owners: ContextVar[tuple[list[str], ...]] = ContextVar("medley_scratch_owners", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns the scratch tables that are made inside, and deletes them at the end, also after an error.

    Results that are still to be read belong inside, or must be written elsewhere first.  Threads
    started inside make tables of their own unless they are given this context.
    """
    made: list[str] = []
    token = _owners.set((*_owners.get(), made))
    try:
        yield
    finally:
        _owners.reset(token)
        for path in made:
            delete(spark, path)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table's folder, if it is there."""
    files, place = _files(spark, path)
    files.delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path for a written table inside the shared folder; the innermost ``scratch`` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if owners := _owners.get():
        owners[-1].append(path)
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, path: str | None = None, **how: str) -> DataFrame:
    """Write the rows to the shared folder, under a name of their own or ``path``, and go on from there.

    This fixes the rows, so a lost executor cannot re-draw them, and unlike a
    checkpoint it is columnar: later steps read only the columns they use and
    the planner knows the size.  What was shuffled for it goes when it is written.
    ``how``: options of the writer, such as its mode.
    """
    path = path or scratch_path(df.sparkSession, "cut")
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path, **how)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_bytes(spark: SparkSession, path: str) -> int:
    """Size of a written table, from its file system."""
    files, place = _files(spark, path)
    return files.getContentSummary(place).getLength()
