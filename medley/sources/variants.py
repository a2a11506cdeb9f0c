"""Datasets kept as three CSV files: compounds, inputs with list columns, labels with a vector as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medley.functions import lists as A
from medley.sources.catalog import Dataset, register
from medley.sources.tables import keyed_table, read_table

# Label column of each variant, and whether its inputs carry dilutions.
VARIANTS = {
    "training": ("rata", True),
    "training_all": ("rata_intensity_pleasantness", True),
    "training_intensity": ("intensity_pleasantness", True),
    "leaderboard": ("rata", True),
    "test": ("rata", True),
    "descriptors": ("rata", False),
    "panel": ("ratings", True),
    "panel_all": ("ratings_intensity_pleasantness", True),
    "panel_intensity": ("intensity_pleasantness", True),
}
FRACTIONS = ("dilution", "solvent_id", "weakness")  # the parallel lists of dilution_info, in this order


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def long_inputs(wide: DataFrame, fractions: bool) -> DataFrame:
    """(stimulus, pos, cid, dilution, solvent_id, weakness) from one row of lists per stimulus.

    A list that is missing or shorter than the ids gives NULL there.
    """
    ids = A.decode_list("cmp_ids", "bigint")
    info = A.decode_list("dilution_info", "array<double>") if fractions else F.lit(None).cast("array<array<double>>")
    decoded = wide.select("stimulus", ids.alias("ids"), info.alias("info"))
    entries = decoded.select("stimulus", "info", F.posexplode("ids").alias("pos", "cid"))
    part = lambda i: F.get(F.get("info", F.lit(i)), F.col("pos"))
    return entries.select("stimulus", "pos", "cid", *[part(i).alias(name) for i, name in enumerate(FRACTIONS)])


def load_variant(
    spark: SparkSession,
    folder: str,
    name: str,
    compounds: str = "compounds",
    inputs: str = "inputs",
    labels: str = "labels",
) -> Dataset:
    """The bundle of one variant from three CSV files in ``folder``, given by their names
    without the ending; compounds have a unique CID."""
    output, fractions = VARIANTS[name]
    lists = ["stimulus", "cmp_ids", *(["dilution_info"] if fractions else [])]
    found = read_table(spark, f"{folder}/{compounds}.csv", _strings("CID", "SMILES"))
    found = keyed_table(found.select(F.col("CID").cast("bigint").alias("cid"), F.col("SMILES").alias("smiles")), ["cid"])
    wide = read_table(spark, f"{folder}/{inputs}.csv", _strings(*lists))
    rated = read_table(spark, f"{folder}/{labels}.csv", _strings("stimulus", output))
    return Dataset(
        name,
        found,
        long_inputs(wide, fractions),
        rated.select("stimulus", A.decode_list(output).alias(output)),
        fraction_columns=FRACTIONS if fractions else (),
        output_column=output,
    )


def _register(name: str) -> None:
    register(name)(lambda spark, folder: load_variant(spark, folder, name))


for _name in VARIANTS:
    _register(_name)
