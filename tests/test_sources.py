import zipfile

import pytest
from pyspark.sql import functions as F

from hustings.operators import tables as T
from hustings.sources import artefacts, sinks, workbooks


def book(path, rows):
    """A workbook with one sheet; texts shared, inline or as numbers."""
    shared = sorted({v for r in rows for v in r if isinstance(v, str)})
    cells = []
    for i, r in enumerate(rows, 1):
        for j, v in enumerate(r):
            if v is None:
                continue
            at = f"{chr(65 + j)}{i}"
            if isinstance(v, str):
                cells.append(f'<c r="{at}" t="s"><v>{shared.index(v)}</v></c>' if len(v) % 2 else f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
            else:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Count" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData><row>{''.join(cells)}</row></sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    rows = [["Electorate", 1200, None], ["Seats:", 3], [], ["Description", "Name", "Votes"], ["Red", "A", 10.0], ["Blue", "B", 7.5], ["Total", None, 17.5], ["Green", "late", 1]]
    book(tmp_path / "one.xlsx", rows)
    cells = workbooks.workbook_cells(spark, f"{tmp_path}/*.xlsx")
    assert cells.count() == sum(v is not None for r in rows for v in r)
    assert workbooks.labelled(cells, "seats").first()["number"] == 3
    got = workbooks.candidate_rows(cells, "Description", {"party": "Description", "name": "Name", "votes": "Votes"}).orderBy("row").collect()
    assert [(r["party"], r["name"], r["votes"]) for r in got] == [("Red", "A", "10"), ("Blue", "B", "7.5")]
    assert workbooks.one(spark, f"{tmp_path}/*.xlsx").endswith("one.xlsx")
    book(tmp_path / "two.xlsx", rows)
    with pytest.raises(ValueError):
        workbooks.one(spark, f"{tmp_path}/*.xlsx")
    assert workbooks.place("AB12") == (11, 27)


def test_cube_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("z1", "a", 1.0), ("z1", "b", 2.0), ("z2", "b", 5.0)], "zone string, code string, value double")
    sinks.write_cube(cells, str(tmp_path / "cube"), "t", "zone", "code", "value", ["a", "b"])
    back = T.flatten_cube(spark.read.text(str(tmp_path / "cube")).withColumnRenamed("value", "json"), first="zone")
    assert sorted((r["zone"], r["code"], r["value"]) for r in back.collect()) == [("z1", "a", 1.0), ("z1", "b", 2.0), ("z2", "a", 0.0), ("z2", "b", 5.0)]
    sinks.write_csv(cells, str(tmp_path / "csv"), "zone")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    sinks.write_document(cells.filter("code = 'b'"), str(tmp_path / "doc"), "zone", "value")
    assert spark.read.text(str(tmp_path / "doc")).first()["value"] == '{"z1":2.0,"z2":5.0}'


def test_cells_that_files_leave_out(spark, tmp_path):
    """Rich texts, phonetic runs, truth values, formulas without a value, cells and rows without a reference, merged ranges, other name spaces and paths."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = (
        '<row r="2"><c r="B2" t="s"><v>0</v></c><c><v>2.50</v></c><c t="b"><v>1</v></c><c t="str"><f>A1</f><v>made</v></c><c><f>1+1</f></c></row>'
        '<row><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c t="e"><v>#N/A</v></c></row>'
    )
    with zipfile.ZipFile(tmp_path / "odd.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://x"><sheets><sheet name="S" r:id="a"/><sheet name="T" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/s.xml"/><Relationship Id="b" Target="worksheets/../worksheets/t.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData>{sheet}</sheetData><mergeCells><mergeCell ref="B2:C3"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/t.xml", f"<worksheet {main}><sheetData/></worksheet>")
    data = (tmp_path / "odd.xlsx").read_bytes()
    assert list(workbooks.parse(data)) == [
        ("S", 1, 1, "rich", None), ("S", 1, 2, "2.50", 2.5), ("S", 1, 3, "TRUE", None), ("S", 1, 4, "made", None), ("S", 2, 0, "inline", None), ("S", 2, 1, "#N/A", None),
    ]
    assert [c for c in workbooks.parse(data, fill_merged=True)][6:] == [("S", 1, 2, "rich", None), ("S", 2, 1, "rich", None), ("S", 2, 2, "rich", None)]
    with pytest.raises(ValueError):
        workbooks.place("12")


def test_tables_of_sheets(spark, tmp_path):
    """Names of columns in the row below the header, filler rows of 0, a second table that repeats the header, and blank rows."""
    rows = [["Electorate", 900], ["Candidate", None, "First"], [None, "Party", "Preference"], ["Ann", "Red", 5], ["0", 0, 0], [], ["Bob", "Blue", 7], [], [], ["Cy", "Red", 1], ["Candidate", "Party", "First"], ["Dee", "x", 3]]
    book(tmp_path / "c.xlsx", rows)
    cells = workbooks.workbook_cells(spark, f"{tmp_path}/c.xlsx")
    columns = {"name": "Candidate", "party": "Party", "votes": "First"}
    got = workbooks.tables_of(cells, "Candidate", columns, {"electorate": "Elect"}, blanks=2).orderBy("row").collect()
    assert [(r["name"], r["party"], r["votes"], r["electorate"]) for r in got] == [("Ann", "Red", "5", "900.0"), ("Bob", "Blue", "7", "900.0")]
    far = workbooks.candidate_rows(cells, "Candidate", columns, blanks=3).collect()
    assert {r["name"] for r in far} == {"Ann", "0", "Bob", "Cy"}


def test_other_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("z1", 1.23456789), ("z2", -0.5)], "zone string, x double").withColumn("y", F.col("x"))
    sinks.write_lines(cells, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    assert sinks.snapped(cells, 5).orderBy("zone").first()["x"] == 1.23457


def test_artefacts_come_back(spark, tmp_path):
    """Lookups, graphs, elections, models and shares are written and read; counts that don't fit are refused."""
    import json

    import numpy as np

    rows = spark.createDataFrame([("z2", "a", 0.9, 1, 10.0), ("z1", "a", 1.0, 0, 30.0), ("z3", "b", 1.0, 0, 5.0)], "zone string, area string, share double, split int, people double")
    published = spark.createDataFrame([("a", 50.0), ("b", 5.0), ("c", 5.0)], "area string, people double")
    facts = artefacts.write_lookup(rows, str(tmp_path / "lookup"), "zone", published)
    assert facts == {"rows": 3.0, "split": 1.0, "error": 15.0, "error_share": 0.25}
    back = artefacts.read_lookup(spark, str(tmp_path / "lookup" / "table"), "zone string, area string, share double, split int, people double")
    assert [r["zone"] for r in back.collect()] == ["z1", "z2", "z3"] and json.loads(spark.read.text(str(tmp_path / "lookup" / "meta")).first()["value"]) == facts
    zones = spark.createDataFrame([(i,) for i in range(4)], "zone long")
    edges = spark.createDataFrame([(0, 1, "boundary", 2.0, None, None), (1, 2, "crossing", 0.0, 9.0, "ferry")], "a long, b long, kind string, shared double, gap double, via string")
    touches = spark.createDataFrame([(0, 2, 1.0, 2.0)], "a long, b long, x double, y double")
    made = artefacts.adjacency(zones, edges, touches)
    meta = json.loads(made.first()["json"])["meta"]
    assert meta == {"zones": 4, "edges": 2, "boundary": 1, "crossing": 1, "touches": 1, "pieces": 2, "least": 0, "mean": 1, "most": 2}
    z, e, t = artefacts.read_adjacency(made)
    assert z.count() == 4 and e.filter("via = 'ferry'").first()["gap"] == 9 and t.first()["y"] == 2
    with pytest.raises(Exception, match="fit the lists"):
        artefacts.read_adjacency(made.select(F.regexp_replace("json", '"edges":2.0', '"edges":3.0').alias("json")))[0].collect()
    areas = spark.createDataFrame([("n", 100, ["sum differs"]), ("m", 50, [])], "area string, electorate int, flags array<string>")
    candidates = spark.createDataFrame([("n", "A", "x", 5.0), ("n", "B", "y", 9.0), ("n", "C", "x", 6.0)], "area string, name string, party string, votes double")
    artefacts.write_elections(areas, candidates, str(tmp_path / "elections"), ["a note"])
    doc = json.loads(spark.read.text(str(tmp_path / "elections")).first()["value"])
    n = doc["results"][1]
    assert (doc["areas"], doc["flagged"], doc["notes"]) == (2, 1, ["a note"]) and [c["name"] for c in n["candidates"]] == ["B", "C", "A"]
    assert n["party_votes"] == [{"party": "x", "votes": 11.0}, {"party": "y", "votes": 9.0}]
    matrix = np.array([[2.0, 0.5], [0.5, 1.0]])
    artefacts.write_model(spark, str(tmp_path / "model"), {"cov": matrix, "parties": ("x", "y"), "beta": -0.35})
    assert artefacts.read_model(spark, str(tmp_path / "model")) == {"cov": matrix.tolist(), "parties": ["x", "y"], "beta": -0.35}
    assert artefacts.triangle(matrix) == [2.0, 0.5, 1.0] and np.allclose(artefacts.from_triangle([2.0, 0.5, 1.0]), matrix)
    artefacts.write_shares(spark.createDataFrame([("z", 0.25, 0.75)], "zone string, x double, y double"), str(tmp_path / "shares"), ["x", "y"])
    assert list(spark.read.parquet(str(tmp_path / "shares")).first()["shares"]) == [0.25, 0.75]
