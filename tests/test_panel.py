"""The panel flow from raw CSV to labels, inputs, compounds and report, and the submission sink."""

import pytest
from pyspark.sql import functions as F

from medley.plans import panel as PN
from medley.schemas import OVERALL, PANEL_RATINGS, RATINGS, SUBMISSION
from medley.session import scratch_path
from medley.sources import tables as S

DETAILS = {7: ("CC(=O)O", "acid", "a"), 8: ("[Na+].[Cl-]", "salt", "b"), 9: ("O", "water", "c"), 10: ("CCO", "e", "d"), 11: (None, "n", "n"), 12: ("c1[Si]c1", "s", "s")}


@pytest.fixture(scope="module")
def raw(spark):
    """Two dilutions of 7, one of the others; an answer missing, a descriptor rated twice, a stimulus without details."""
    rows = []

    def add(stimulus, dilution, descriptor, one, two):
        rows.append((stimulus, dilution, descriptor, stimulus if stimulus in DETAILS else None, *DETAILS.get(stimulus, (None,) * 3), one, two, len(rows)))

    for stimulus in (10, 12, 7, 8, 9, 11, 99):
        add(stimulus, 0.1, "Intensity", 80.0, 40.0)
        add(stimulus, 0.1, "Acid", 10.0, None)
        add(stimulus, 0.1, "Acid", 99.0, 99.0)
        add(stimulus, 0.1, "Sweet", None, None)
    add(7, 0.001, "Intensity", 20.0, 30.0)
    schema = "Stimulus long, Dilution double, Descriptor string, CID long, IsomericSMILES string, IUPACName string, name string, `1` double, `22` double, line long"
    return spark.createDataFrame(rows, schema).repartition(3)


def test_panel_flow(raw):
    panel = PN.panel_data(raw, ["line"])
    labels = {r.stimulus: r for r in panel.labels.collect()}
    assert sorted(labels) == ["A10", "A7", "B7"]
    assert panel.labels.columns[:2] == ["stimulus", "panel"] and {r.panel for r in labels.values()} == {1}
    # the lowest dilution is A
    assert labels["A7"].Intensity == 0.25 and labels["B7"].Intensity == 0.6 and labels["A7"].Acid is None
    # the first row that rates a descriptor counts, subjects without an answer do not
    assert labels["B7"].Acid == 0.1 and labels["B7"].Sweet is None
    whole = labels["B7"].ratings_intensity_pleasantness
    assert whole == labels["B7"].intensity_pleasantness + labels["B7"].ratings
    assert len(labels["B7"].ratings) == len(PANEL_RATINGS) and whole[0] == 0.6 and len(OVERALL) == 2
    inputs = {r.stimulus: r for r in panel.inputs.collect()}
    assert {k: (r.CID, r.dilution, r.cmp_ids, r.dilution_info) for k, r in inputs.items()} == {
        "A7": ([7], [0.001], [0], [[0.001], [0.0]]),
        "B7": ([7], [0.1], [0], [[0.1], [0.0]]),
        "A10": ([10], [0.1], [1], [[0.1], [0.0]]),
    }
    assert {r.CID: r.SMILES for r in panel.compounds.collect()} == {7: "CC(=O)O", 10: "CCO"}
    report = [(r.rule, r.before, r.removed, r.after) for r in panel.report.orderBy("step").collect()]
    assert report == [
        ("structure known", 8, 2, 6), ("no unwanted element", 6, 2, 4), ("no charge", 4, 0, 4), ("one molecule", 4, 0, 4), ("has carbon", 4, 1, 3),
    ]


def test_each_rule_alone(spark):
    texts = ["CC", "C[N+](C)C", "CC.O", "O", "C[Si]C", "[NH4+2]", None]
    frame = spark.createDataFrame([(t, float(i)) for i, t in enumerate(texts)], "IsomericSMILES string, w double")
    rules = dict(PN.cleaning_rules(weight=F.col("w"), low=1, high=5))
    stays = lambda name: [t for t in texts if t in {r[0] for r in frame.filter(rules[name]).collect()}]
    assert stays("no charge") == ["CC", "CC.O", "O", "C[Si]C"]
    assert stays("one molecule") == ["CC", "C[N+](C)C", "O", "C[Si]C", "[NH4+2]"]
    assert stays("no unwanted element") == ["CC", "C[N+](C)C", "CC.O", "O", "[NH4+2]"]
    assert stays("molecular weight") == texts[1:6]
    assert stays("has carbon") == ["CC", "C[N+](C)C", "CC.O", "C[Si]C"]


def test_panel_without_subjects_or_rows(raw):
    with pytest.raises(ValueError):
        PN.panel_data(raw.drop("1", "22"), ["line"])
    empty = PN.panel_data(raw.limit(0), ["line"])
    assert empty.labels.count() == empty.inputs.count() == empty.compounds.count() == 0


def test_submission_round_trip(spark):
    cells = spark.range(3).select(F.concat(F.lit("S"), "id").alias("stimulus"), F.posexplode(F.sequence(F.lit(0), F.lit(len(RATINGS) - 1))).alias("dim", "p"))
    pred = cells.select("stimulus", "dim", (F.col("p") / 10).alias("y_hat"))
    form = spark.createDataFrame([("S0",), ("S2",), ("S2",)], "stimulus string")
    path = scratch_path(spark, "form")
    S.write_submission(pred, form, path)
    back = S.read_table(spark, path, SUBMISSION)
    assert back.columns == ["stimulus", *RATINGS]
    assert {r["stimulus"]: list(r)[1:] for r in back.collect()} == {s: [d / 10 for d in range(len(RATINGS))] for s in ("S0", "S2")}
    for bad in (form.union(spark.createDataFrame([("S9",)], "stimulus string")), form):
        part = pred if bad is not form else pred.filter("dim <> 32 OR stimulus <> 'S2'")
        with pytest.raises(ValueError, match="no prediction"):
            S.write_submission(part, bad, scratch_path(spark, "form"))
