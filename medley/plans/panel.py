"""The panel study: ratings of many subjects to cleaned labels, inputs and compounds.

The raw table has a row per stimulus, dilution and descriptor, a column per subject, named
by the subject's number, and the details of the stimulus' compound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.operators import joins as J
from medley.operators import tidy as T
from medley.plans.flows import UNWANTED_ELEMENTS
from medley.schemas import OVERALL, PANEL_RATINGS
from medley.session import cut

DETAILS = ["IsomericSMILES", "IUPACName", "name"]


def panel_means(raw: DataFrame, descriptors: list[str], order: list[str]) -> DataFrame:
    """(Stimulus, Dilution, one column per descriptor): the mean over the subjects who answered, of 100.

    The first row under ``order`` counts where a descriptor was rated twice; a descriptor nobody rated is NULL.
    """
    subjects = [F.col(f"`{c}`").cast("double") for c in T.matching(raw, r"\d+")]
    if not subjects:
        raise ValueError("the panel table has no column named by a subject's number")
    total = sum((F.coalesce(s, F.lit(0.0)) for s in subjects), F.lit(0.0))
    answers = sum((s.isNotNull().cast("int") for s in subjects), F.lit(0))
    rated = raw.withColumn("_mean", F.try_divide(total, answers) / 100)
    return T.pivot_first(rated, ["Stimulus", "Dilution"], "Descriptor", descriptors, "_mean", order)


def panel_table(raw: DataFrame, descriptors: list[str], order: list[str]) -> DataFrame:
    """The pivoted means with the details of the compound that the stimulus names; without one they are NULL."""
    details = T.keep_first(raw.filter("CID IS NOT NULL").select("CID", *DETAILS, *order), ["CID"], order).drop(*order)
    means = panel_means(raw, descriptors, order)
    return means.join(details, means["Stimulus"] == details["CID"], "left").withColumnRenamed("Stimulus", "stimulus")


def cleaning_rules(
    structure: str = "IsomericSMILES", banned: list[str] = UNWANTED_ELEMENTS, weight: Column | None = None, low: float = 20, high: float = 600
) -> list[tuple[str, Column]]:
    """(name, condition to stay) of the cleaning steps, in order.  All but the weight read the structure's text."""
    text = F.col(structure)
    rules = [
        ("structure known", text.isNotNull()),
        ("no unwanted element", ~text.rlike(T.word_pattern(banned))),
        ("no charge", ~text.rlike(r"[+-]\d*\]")),
        ("one molecule", ~text.contains(".")),
    ]
    if weight is not None:
        rules.append(("molecular weight", weight.between(low, high)))
    return [*rules, ("has carbon", text.rlike("[Cc]"))]


@dataclass(frozen=True)
class Panel:
    """``labels``, ``inputs`` and ``compounds`` of a cleaned panel table, and the ``report`` of its cleaning."""

    labels: DataFrame
    inputs: DataFrame
    compounds: DataFrame
    report: DataFrame


def panel_data(
    raw: DataFrame,
    order: list[str],
    ratings: list[str] = PANEL_RATINGS,
    overall: list[str] = OVERALL,
    rules: list[tuple[str, Column]] | None = None,
) -> Panel:
    """The whole flow: pivot, clean, and lay out as the task data are.

    labels: ``stimulus``, ``panel`` (1), a column per attribute, and the vectors ``ratings``,
    ``intensity_pleasantness`` and ``ratings_intensity_pleasantness`` (overall attributes first);
    inputs: ``stimulus`` and the one-entry lists ``CID``, ``dilution``, ``cmp_ids`` (dense ids in order of
    first appearance) and ``dilution_info`` (dilution and carrier 0); compounds: ``CID``, ``SMILES``.
    A stimulus' lowest dilution gets the prefix A, the others B; a NULL dilution or id is an empty list.
    """
    rules = cleaning_rules() if rules is None else rules
    whole = cut(panel_table(raw, [*overall, *ratings], order))
    keep = F.lit(True)
    for _, stays in rules:
        keep = keep & F.coalesce(stays, F.lit(False))
    clean = whole.filter(keep)
    named = cut(T.mark_first(clean.withColumn("_id", F.col("stimulus")), "stimulus", ["Dilution"]).drop("copies"))
    labels = named.select(
        "stimulus",
        F.lit(1).alias("panel"),
        *overall,
        *ratings,
        F.array(*ratings).alias("ratings"),
        F.array(*overall).alias("intensity_pleasantness"),
        F.array(*overall, *ratings).alias("ratings_intensity_pleasantness"),
    )
    ids = T.ids_by_first_seen(named, "CID", ["_id", "Dilution"], "_cmp")
    coded = J.lookup(named, "CID", ids, "_cmp", "_cmp", pass_through=False)
    listed = lambda c: F.when(F.col(c).isNull(), F.slice(F.array(c), 1, 0)).otherwise(F.array(c))
    inputs = coded.select(
        "stimulus",
        listed("CID").alias("CID"),
        listed("Dilution").alias("dilution"),
        F.array("_cmp").alias("cmp_ids"),
        F.array(listed("Dilution"), F.array(F.lit(0.0))).alias("dilution_info"),
    )
    compounds = T.keep_first(named.select("CID", F.col("IsomericSMILES").alias("SMILES"), "_id", "Dilution"), ["CID"], ["_id", "Dilution"])
    return Panel(labels, inputs, compounds.select("CID", "SMILES"), T.stage_report(whole, rules))
