"""Raw task files, as shipped, to tidy labels and inputs."""

import pytest

from medley.plans import raw as RAW
from medley.schemas import OVERALL, RATINGS


@pytest.fixture
def files(tmp_path):
    def put(name, text):
        (tmp_path / name).write_bytes(text.encode())
        return str(tmp_path / name)

    def ratings(rows, columns):
        head = ["stimulus", "NoOdor", *columns]
        return "\n".join([",".join(f'"{c}"' for c in head), *[",".join([s, "0", *[str(v) for v in [value] * len(columns)]]) for s, value in rows]]) + "\n"

    columns = [*OVERALL, *RATINGS]
    return RAW.RawFiles(
        {
            "Task1": put("t1.csv", ratings([("S1", 5), ("S2", 10), ("X9", 1)], columns)),
            "Task2_single": put("t2.csv", ratings([("S1", 5), (" S2", 2.5)], columns[::-1])),
            "Task2_mix": put("t3.csv", ratings([("301", 0)], columns)),
        },
        put("singles.csv", "﻿stimulus,molecule,dilution,solvent,Intensity_label\nS1,7,0.1,PG,L\nS2,7,0.001,pg ,H\nS8,9,1,PG,L\nX9,7,0.5,nt,L\n"),
        put("mixtures.csv", '"id","components"\n"301","2;1"\n"302","1"\n"999","1"\n'),
        put("components.csv", '"id","molecule","dilution","solvent"\n"1",-1,1,"nt"\n"2",7,0.01,"pg"\n'),
        put("compounds.csv", "compound_id,CID,SMILES,is_solvent\n0,-1,,TRUE\n1,7,CC,\n"),
        [put("form.csv", "stimulus,Green\n302,\n")],
    )


def test_labels(spark, files):
    labels, _ = RAW.tidy_from_csv(spark, files, ["X9"])
    got = {(r.stimulus, r.Task1, r.Task2_single, r.Task2_mix): r for r in labels.collect()}
    # the same ratings of S1 from two files are one row with both flags, different ones of S2 are two
    assert sorted(got) == [("301", 0, 0, 1), ("S1", 1, 1, 0), ("S2", 0, 1, 0), ("S2", 1, 0, 0)]
    one = got["S1", 1, 1, 0]
    assert one.rata == [1.0] * len(RATINGS) and one.overall == [0.5, 0.5] and one.all_ratings == one.overall + one.rata


def test_inputs(spark, files):
    _, inputs = RAW.tidy_from_csv(spark, files, ["X9"])
    rows = sorted((r.stimulus, r.pos, r.component, r.cid, r.compound_id, r.dilution, r.solvent, r.solvent_id) for r in inputs.collect())
    assert rows == [
        ("301", 0, 2, 7, 1, 0.01, "pg", 0),
        ("301", 1, 1, -1, 0, 1.0, "nt", 1),
        ("302", 0, 1, -1, 0, 1.0, "nt", 1),
        ("S1", 0, None, 7, 1, 0.1, "pg", 0),
        ("S2", 0, None, 7, 1, 0.001, "pg", 0),
    ]
    place = {r.stimulus: r.weakness for r in inputs.filter("cid = 7").collect()}
    assert place["S1"] == 1.0 and place["S2"] == 0.0 and place["301"] == pytest.approx(0.009 / 0.099)


def test_unknown_task_and_missing_column(spark, files, tmp_path):
    with pytest.raises(ValueError, match="unknown tasks"):
        RAW.RawFiles({"Task9": "x"}, "", "", "", "")
    (tmp_path / "t1.csv").write_text("stimulus,Green\nS1,1\n")
    with pytest.raises(ValueError, match="no column"):
        RAW.tidy_from_csv(spark, files)
