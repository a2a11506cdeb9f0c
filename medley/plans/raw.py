"""From the raw CSV files of the tasks to tidy labels and inputs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from medley.plans import flows as PL
from medley.schemas import COMPONENT, COMPOUND, MIXTURE, OVERALL, RATINGS, SINGLE_STIMULUS, TASKS
from medley.sources.tables import read_table

_RATED = T_.StructType(
    [T_.StructField("stimulus", T_.StringType()), *[T_.StructField(r, T_.DoubleType()) for r in [*OVERALL, *RATINGS]]]
)
_STIMULUS = T_.StructType([_RATED["stimulus"]])


@dataclass(frozen=True)
class RawFiles:
    """Places of the raw files, all headered CSV; columns are found by name, others are left out.

    ``labels`` maps a task flag to a file of ratings by stimulus; ``forms`` list further stimuli that are known.
    """

    labels: dict[str, str]
    singles: str
    mixtures: str
    components: str
    compounds: str
    forms: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self):
        if unknown := set(self.labels) - set(TASKS):
            raise ValueError(f"unknown tasks {sorted(unknown)}; choose from {TASKS}")


def plain(name: str) -> str:
    """A rating's name as a column that needs no quoting."""
    return name.replace(".", "_")


def raw_labels(spark: SparkSession, files: RawFiles) -> DataFrame:
    """The label files stacked: stimulus, a flag per task, the overall attributes and the ratings."""

    def one(task: str) -> DataFrame:
        rows = read_table(spark, files.labels[task], _RATED)
        flags = [F.lit(int(t == task)).alias(t) for t in TASKS]
        return rows.select(F.trim("stimulus").alias("stimulus"), *flags, *[F.col(f"`{r}`").alias(plain(r)) for r in [*OVERALL, *RATINGS]])

    return reduce(DataFrame.unionByName, [one(task) for task in files.labels])


def tidy_from_csv(
    spark: SparkSession, files: RawFiles, excluded: Sequence[str] = tuple(PL.EXCLUDED_STIMULI)
) -> tuple[DataFrame, DataFrame]:
    """(labels, inputs): ``flows.tidy_labels`` of all label files, and ``flows.tidy_inputs``, long, of the definitions.

    Equal ratings of a stimulus from several tasks are one row with all its flags.  Stimuli that neither a
    label file nor a form names are left out of the inputs; the excluded ones of both.
    """
    stacked = raw_labels(spark, files)
    labels = PL.tidy_labels(stacked, "stimulus", TASKS, [plain(r) for r in RATINGS], OVERALL, list(excluded))
    asked = [read_table(spark, form, _STIMULUS).select(F.trim("stimulus").alias("stimulus")) for form in files.forms]
    rated = stacked.select("stimulus")
    if excluded:  # an excluded stimulus is not one that data exist for
        rated = rated.filter(~F.col("stimulus").isin(list(excluded)))
    known = reduce(DataFrame.unionByName, asked, rated)
    singles = read_table(spark, files.singles, SINGLE_STIMULUS).select(
        F.trim("stimulus").alias("stimulus"), F.col("molecule").alias("cid"), "dilution", "solvent"
    )
    mixtures = read_table(spark, files.mixtures, MIXTURE).select(F.trim("id").alias("stimulus"), "components")
    components = read_table(spark, files.components, COMPONENT).select(
        F.col("id").cast("long").alias("component"), F.col("molecule").alias("cid"), "dilution", "solvent"
    )
    compounds = read_table(spark, files.compounds, COMPOUND).select(F.col("CID").alias("cid"), "compound_id").distinct()
    return labels, PL.tidy_inputs(singles, mixtures, components, known, compounds, list(excluded))
