"""Dataset bundles and their catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """Three lazy tables and the roles of their columns.

    ``compounds(compound...)``, ``inputs`` in long form, one row per component
    entry, and ``labels`` with one vector column per variant.
    """

    name: str
    compounds: DataFrame
    inputs: DataFrame
    labels: DataFrame
    id_column: str = "cid"
    fraction_columns: tuple[str, ...] = ("dilution", "solvent")
    output_column: str = "rating"
    feature_columns: tuple[str, ...] = field(default_factory=tuple)

    def roles(self) -> dict:
        return {
            "id_column": self.id_column,
            "fraction_columns": list(self.fraction_columns),
            "output_column": self.output_column,
            "feature_columns": list(self.feature_columns),
        }

    def joined(self) -> DataFrame:
        """Component entries of labelled stimuli with the label vector."""
        return self.inputs.join(self.labels.select("stimulus", self.output_column), "stimulus")

    def register(self) -> None:
        """Temp views <name>_compounds, <name>_inputs, <name>_labels."""
        for part in ("compounds", "inputs", "labels"):
            getattr(self, part).createOrReplaceTempView(f"{self.name}_{part}")


CATALOG: dict[str, Callable[[SparkSession, str], Dataset]] = {}


def register(name: str) -> Callable:
    def add(loader: Callable[[SparkSession, str], Dataset]):
        CATALOG[name] = loader
        return loader

    return add


def open_dataset(name: str, spark: SparkSession, location: str) -> Dataset:
    if name not in CATALOG:
        raise ValueError(f"unknown dataset {name!r}; choose from {sorted(CATALOG)}")
    return CATALOG[name](spark, location)


def describe_dataset(ds: Dataset) -> DataFrame:
    """One row: name, roles, and sizes of the bundle."""
    per_stimulus = ds.inputs.groupBy("stimulus").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_stimulus.agg(
        F.count(F.lit(1)).alias("n_stimuli"), F.sum("n").alias("n_entries"), F.max("n").alias("longest")
    )
    labels = ds.labels.agg(F.count(F.lit(1)).alias("n_labels"), F.max(F.size(ds.output_column)).alias("label_width"))
    out = sizes.withColumns({c: labels.select(c).scalar() for c in labels.columns})
    out = out.withColumn("n_compounds", ds.compounds.select(F.count(F.lit(1))).scalar())
    return out.select(
        F.lit(ds.name).alias("name"),
        F.lit(ds.id_column).alias("id_column"),
        F.lit(",".join(ds.fraction_columns)).alias("fraction_columns"),
        F.lit(ds.output_column).alias("output_column"),
        "*",
    )
