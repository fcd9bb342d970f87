"""Graph and map checks, features, election pipeline, count sheets, GeoJSON and the ballot, on fixtures with known answers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.functions import ballot as B
from hustings.operators import checks as C
from hustings.operators import election as E
from hustings.operators import features as X
from hustings.operators import fits
from hustings.operators import graph as G
from hustings.sources import geojson as J
from hustings.sources import sheets as S


def counts(df):
    return {r["check"]: r["faults"] for r in df.collect()}


def test_graph_faults(spark):
    zones = spark.createDataFrame([(i,) for i in range(5)], "zone long")
    good = [(0, 1, "boundary", 2.0, None), (1, 2, "boundary", 1.0, None), (2, 3, "crossing", 0.0, 50.0), (3, 4, "boundary", 9.0, None)]
    schema = "a long, b long, kind string, shared double, gap double"
    touches = spark.createDataFrame([(0, 3)], "a long, b long")
    assert not any(counts(C.graph_faults(zones, spark.createDataFrame(good, schema), touches)).values())
    bad = [*good[:2], (2, 1, "boundary", 1.0, None), (3, 3, "boundary", 1.0, None), (1, 9, "boundary", 1.0, None), (0, 3, "boundary", 0.001, None), (0, 2, "crossing", 1.0, None)]
    found = counts(C.graph_faults(zones.unionByName(zones.limit(1)), spark.createDataFrame(bad, schema), touches))
    assert found == {"zone twice": 1, "unknown zone": 1, "loop": 1, "edge twice": 1, "thin boundary": 1, "crossing without gap": 1, "alone": 1, "edge and touch": 1, "further pieces": 1}


def test_border_changes_and_map_faults(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    got = sorted(map(tuple, C.border_changes(pairs((1, 2), (2, 3)), pairs((2, 3), (3, 4), (4, 5)), pairs((3, 4))).collect()))
    assert got == [("gained", 3, 4), ("gained", 4, 5), ("lost", 1, 2), ("not a touch", 4, 5)]
    zones = spark.createDataFrame([(1, 0.5), (2, None), (2, 3.0)], "zone long, share double")
    codes = spark.createDataFrame([(1,), (3,)], "zone long")
    found = counts(C.map_faults(zones, {"share": 4.0}, {"share": (0.0, 1.0)}, codes))
    assert found == {"zone twice": 1, "share null": 1, "share out of range": 1, "share total": 1, "codes differ": 3}


def test_gaps(spark):
    """Two islands beside a strip of land: the gap over water is found, that over land isn't, hops and ranks are right."""
    cells = {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (3, 1), 5: (3, 2), 6: (2, 2), 7: (1, 2), 8: (0, 2), 9: (8, 8)}
    corners = [(z, 0, 0, k, float(x + i), float(y + j)) for z, (x, y) in cells.items() for k, (i, j) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    vertices = spark.createDataFrame(corners, "zone long, part int, ring int, seq int, x double, y double")
    ring = [(z, 0, float(x + a), float(y + b), float(x + c), float(y + d)) for z, (x, y) in cells.items() for a, b, c, d in ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))]
    rings = spark.createDataFrame(ring, "part long, ring int, x1 double, y1 double, x2 double, y2 double")
    declared = spark.createDataFrame([(0, 8)], "a long, b long")
    rows = C.gap_audit(G.segments(vertices), rings, declared, 1.0, metres=False, cap=9, near=4).collect()
    by = {(r["a"], r["b"]): r for r in rows}
    assert by[0, 8]["hops"] == 8 and by[0, 8]["declared"] and not by[0, 8]["suspicious"] and by[1, 7]["suspicious"] and by[1, 7]["hops"] == 6
    assert all(r["gap"] <= 1.0 for r in rows) and not any(9 in p for p in by)
    assert [r["hops"] for r in rows] == sorted(r["hops"] for r in rows)
    edges = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "a long, b long")
    hops = {(r["a"], r["b"]): r["hops"] for r in C.pair_hops(edges, spark.createDataFrame([(0, 2), (0, 4), (1, 0)], "a long, b long")).collect()}
    assert hops == {(0, 2): 2, (0, 4): None, (1, 0): 1}
    assert [tuple(r) for r in C.few_neighbours(spark.range(6).withColumnRenamed("id", "zone"), edges).collect()] == [(3, 0), (0, 1), (2, 1), (4, 1), (5, 1)]
    report = C.degree_report(spark.range(6).withColumnRenamed("id", "zone"), edges).first()
    assert (report["least"], report["mean"], report["most"], report["alone"]) == (0, 1.0, 2, 1)
    gap = C.least_gaps(spark.createDataFrame([(0, 8)], "a long, b long"), vertices).first()["gap"]
    assert abs(gap - 111_320.0) < 1


def test_geojson_round_trip(spark, tmp_path):
    """Holes and parts come back, on a grid; features without geometry stay; faults are found."""
    rings = [("a", 0, 0, [(0, 0), (4, 0), (4, 4), (0, 4)]), ("a", 0, 1, [(1, 1), (2, 1), (2, 2)]), ("a", 1, 0, [(9, 9), (9.000004, 9.5), (8, 8)]), ("b", 0, 0, [(5, 5), (6, 5), (6, 6)])]
    corners = spark.createDataFrame([(z, p, r, k, float(x), float(y)) for z, p, r, points in rings for k, (x, y) in enumerate(points)], "zone string, part int, ring int, seq int, x double, y double")
    zones = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "zone string, people int")
    J.write_collection(J.as_features(corners, zones), str(tmp_path / "map"))
    text = spark.read.text(str(tmp_path / "map")).first()["value"]
    assert [f["properties"] for f in json.loads(text)["features"]] == [{"code": z, "people": n} for z, n in (("a", 3), ("b", 4), ("c", 5))]
    found = J.features(spark, str(tmp_path / "map"))
    back = J.vertices(found, "code")
    want = corners.withColumns({c: F.bround(c, 5) for c in ("x", "y")})
    assert found.count() == 3 and back.exceptAll(want).count() == 0 and back.count() == want.count()
    assert J.ring_faults(found, "code").count() == 0
    bad = {"features": [{"properties": {"code": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [2, 0], [5, 5]], [[0, 0], [1, 1], [0, 0]]]}}]}
    faults = J.ring_faults(J.features_of(spark.createDataFrame([(json.dumps(bad),)], "json string")), "code").collect()
    assert sorted((r["ring"], r["points"], r["closed"]) for r in faults) == [(0, 4, False), (1, 3, True)]
    near = spark.createDataFrame([("a", 0, 0, 0, 1.0, 1.0), ("a", 0, 0, 1, 1.000001, 1.0)], corners.schema)
    assert J.snapped_duplicates(near).count() == 1


SHEET = [
    ("n", 1, "A1", "x", 60.0, 0.0), ("n", 1, "B", "y", 20.0, 0.0), ("n", 1, "A2", "x", 12.0, 0.0), ("n", 1, "C", "z", 8.0, 0.0),
]


def test_events_with_surpluses(spark):
    """A surplus, an exclusion with another party's votes, a stage with two sources, one that doesn't balance, and one to somebody elected."""
    first = {"A1": ("x", 60.0), "B": ("y", 20.0), "A2": ("x", 12.0), "C": ("z", 8.0), "D": ("y", 6.0), "E": ("z", 4.0)}
    stages = [
        {"A1": -25.0, "A2": 20.0, "B": 3.0, "C": 1.0, "nt": 1.0},  # surplus of A1
        {"E": -4.0, "C": 3.0, "D": 1.0, "nt": 0.0},  # exclusion
        {"C": -12.0, "B": 6.0, "D": 5.0, "nt": 1.0},  # exclusion of a pile with 4 from others: of x and z
        {"D": -12.0, "B": 10.0, "nt": 0.5},  # doesn't balance
    ]
    rows = [("n", k + 2, c, p, v, 35.0, s.get(c, 0.0), s["nt"]) for k, s in enumerate(stages) for c, (p, v) in first.items()]
    rows += [("m", 2, c, p, v, 35.0, {"D": -6.0, "E": -4.0, "B": 10.0}.get(c, 0.0), 0.0) for c, (p, v) in first.items()]
    rows += [("k", 2, c, p, v, 35.0, {"E": -4.0, "A1": 4.0}.get(c, 0.0), 0.0) for c, (p, v) in first.items()]
    found = E.events(spark.createDataFrame(rows, "area string, stage int, candidate string, party string, first_pref double, quota double, transfer double, nt double")).collect()
    got = {(r["area"], r["stage"]): r for r in found}
    assert set(got) == {("n", 2), ("n", 3), ("n", 4)}
    assert got["n", 2]["kind"] == "surplus" and got["n", 2]["votes_moved"] == 25 and got["n", 2]["other_party_share"] == 0
    assert got["n", 3]["kind"] == "exclusion" and {c["candidate"]: c["votes"] for c in got["n", 3]["continuing"]} == {"A2": 0, "B": 0, "C": 3, "D": 1}
    assert abs(got["n", 4]["other_party_share"] - 1 / 12) < 1e-9
    events = spark.createDataFrame(found)
    cleaned = E.clean(events, ["x", "y", "z"])
    # A1 has a running mate; E and C are the last of theirs but for each other.
    assert sorted((r["area"], r["stage"]) for r in cleaned.collect()) == [("n", 4)]
    rates = {r["party"]: r["rate"] for r in E.exhaustion_rates(cleaned, ["x", "y", "z"]).collect()}
    assert rates == {"x": 0.15, "y": 0.15, "z": round(1 / 12, 4)}
    received = E.receipts(cleaned, ["x", "y", "z"])
    assert {r["dst"]: round(r["share"], 6) for r in received.collect()} == {"y": 1.0, "x": 0.0}
    assert {(r["src"], r["dst"]): (r["events"], r["available"]) for r in E.availability(received).collect()} == {("z", "y"): (1, 1), ("z", "x"): (1, 1)}


def test_votes_as_cast_and_seats(spark):
    voters = spark.createDataFrame([(1, "a", 100.0), (1, "b", 60.0), (1, "c", 10.0), (2, "a", 5.0), (2, "b", 5.0), (2, "c", 5.0), (3, "a", 0.0), (3, "b", 0.0), (3, "c", 0.0)], "area int, party string, votes double")
    bars = spark.createDataFrame([(p, 0.2) for p in "abc"], "party string, threshold double")
    moves = [[0, 0.5, 0.5], [0.6, 0, 0.4], [0.25, 0.75, 0]]
    transfers = spark.createDataFrame([("abc"[i], "abc"[j], moves[i][j]) for i in range(3) for j in range(3) if moves[i][j]], "src string, dst string, w double")
    rates = spark.createDataFrame([(p, 0.1) for p in "abc"], "party string, rate double")
    plain = E.ballots_cast(voters, F.lit(0.5), None, transfers, rates, True)
    assert {(r["area"], r["party"]): r["votes"] for r in plain.collect()}[1, "a"] == 50
    cast = E.ballots_cast(voters, F.lit(0.5), bars, transfers, rates, True, tactical=True)
    got = {(r["area"], r["party"]): r["votes"] for r in cast.collect()}
    assert got[1, "c"] == 0 and abs(got[1, "a"] + got[1, "b"] - (80 + 5 * 0.9)) < 1e-9 and got[1, "b"] < 30 + 5 * 0.9 * 0.75
    won = {(r["area"], r["party"]): r["seats"] for r in E.seats(cast, "abc", "fptp", 1, moves, [0.1] * 3).collect()}
    assert won[1, "a"] == 1 and won[2, "a"] == 1 and sum(v for (a, _), v in won.items() if a == 3) == 0
    stv = {(r["area"], r["party"]): r["seats"] for r in E.seats(plain, "abc", "stv", 3, moves, [0.1] * 3).collect()}
    assert sum(v for (a, _), v in stv.items() if a == 1) == 3 and stv[1, "a"] >= stv[1, "b"] and sum(v for (a, _), v in stv.items() if a == 3) == 0
    pie = {r["party"]: (r["begin"], r["end"]) for r in E.wedges(spark.createDataFrame([("a", 2), ("c", 1), ("a", 1)], "party string, seats int"), ["c", "b", "a"]).collect()}
    assert pie == {"c": (0.0, 0.25), "a": (0.25, 1.0)}
    with pytest.raises(ValueError):
        E.seats(plain, "abc", "list", 1, moves, [0.1] * 3)


def test_ballot():
    votes = {"a": 10.0, "b": 20.0, "c": 5.0, "d": 1.0}
    start = B.Ballot.of("abcd")
    out = start.standing(["c"], False)
    assert out.hosts(votes) == {"a": "a", "b": "b", "c": None, "d": "d"} and out.steerable(votes) == ("a", "b", "d")
    joined = out.merge(["c", "a"])
    assert [e.members for e in joined.entries] == [("a", "c"), ("b",), ("d",)] and joined.host("c", votes) == "a" and joined.entry("c").stands
    twice = joined.merge(["d", "b"])
    assert [e.members for e in twice.entries] == [("b", "d"), ("a", "c")] and twice.tracked("d", votes) == "b"
    back = twice.unmerge("a")
    assert [e.members for e in back.entries] == [("b", "d"), ("a",), ("c",)] and not back.entry("c").stands and back.tracked("c", votes) == "b" or back.tracked("c", votes) == "a"
    assert joined.label("c", {"a": "Al"}, {}) == "Al-c" and joined.label("c", {}, {frozenset("ac"): "Union"}) == "Union"
    assert start.merge(["a"]) is start and start.unmerge("a") is start
    terms = B.party_terms("ab", {"b": (0.2, None)})
    assert (terms[0].spread, terms[1].spread, terms[1].between, terms[1].steepness) == (0.05, 0.2, 0.05, 50.0)
    with pytest.raises(ValueError):
        start.merge(["x"])


def test_unknown_parties_fail(spark):
    rows = spark.createDataFrame([("Red", "R"), ("", None), (None, None)], "raw string, standard string")
    assert [r["p"] for r in rows.select(B.known_party(F.col("raw"), F.col("standard")).alias("p")).collect()] == ["R", None, None]
    with pytest.raises(Exception, match="unknown party Blue"):
        spark.createDataFrame([("Blue", None)], rows.schema).select(B.known_party(F.col("raw"), F.col("standard"))).collect()


def grid_cells(spark, rows, path="p", sheet="s"):
    cells = [(path, sheet, i, j, str(v), float(v) if isinstance(v, (int, float)) else None) for i, r in enumerate(rows) for j, v in enumerate(r) if v is not None]
    return spark.createDataFrame(cells, "path string, sheet string, row int, col int, text string, number double")


def test_wide_count_sheets(spark):
    """A long count goes on in a second block that repeats the last stage; a sheet without all candidates is refused."""
    rows = [
        ["Count"], [None, None, "Stage 1", "Stage 2", "Stage 3"], [None, None, "", "x", "y"], [None, "Ann", 10, 2, -3], [None, "Bob", 5, -2, 1], [None, "Non-transferable", None, None, 2],
        [], [None, None, "Stage 3", "Stage 4"], [None, "Ann", 99, 7], [None, "Bob", 99, -7], [None, "Non transferable votes", 99, 0],
    ]
    names = spark.createDataFrame([("p", "s", "Ann"), ("p", "s", "Bob"), ("p", "t", "Ann"), ("p", "t", "Cy")], "path string, sheet string, name string")
    cells = grid_cells(spark, rows).unionByName(grid_cells(spark, [r if r[1:2] != ["Bob"] else [None, "Bo"] for r in rows], sheet="t").filter("text <> 'Stage 3' or row > 5"))
    # The second block begins with stage 3: only blocks with Stage 1 in front would be lost.
    got = {(r["stage"], r["candidate"]): r["transfer"] for r in S.wide_stages(cells, names).collect() if r["sheet"] == "s"}
    assert got == {(2, "Ann"): 2, (2, "Bob"): -2, (2, None): 0, (3, "Ann"): -3, (3, "Bob"): 1, (3, None): 2, (4, "Ann"): 7, (4, "Bob"): -7, (4, None): 0}
    assert [(r["path"], r["sheet"]) for r in S.refused(cells, S.wide_stages(cells, names)).collect()] == [("p", "t")]
    assert {r["election"] for r in S.units({"one": S.wide_stages(cells, names), "two": S.wide_stages(cells, names).drop("path")}).collect()} == {"one", "two"}


def test_printed_sheets_prove_themselves(spark):
    """Columns begin where totals chain; an area with a wrong total gives nothing."""
    def area(name, start, wrong=0.0):
        rows = []
        for who, first, moves in (("u", 10.0, (2.0, -12.0)), ("v", 8.0, (-8.0, None)), ("w", 5.0, (6.0, 12.0))):
            total = first
            for k, m in enumerate(moves):
                total += m or 0.0
                if m is not None:
                    rows.append((name, who, start + 2 * k, m))
                rows.append((name, who, start + 2 * k + 1, total + (wrong if who == "w" and k else 0.0)))
        return rows

    # Printed before the columns of "two": a first preference, as sheets have it.
    grid = spark.createDataFrame(area("one", 3) + area("two", 4) + [("two", c, 3, v) for c, v in (("u", 10.0), ("v", 8.0), ("w", 5.0))] + area("bad", 3, 1.0), "area string, candidate string, col int, value double")
    first = spark.createDataFrame([(a, c, v) for a in ("one", "two", "bad") for c, v in (("u", 10.0), ("v", 8.0), ("w", 5.0))], "area string, candidate string, first_pref double")
    got = S.chained_columns(grid, first, (2, 3, 4)).collect()
    assert {r["area"] for r in got} == {"one", "two"} and {r["start"] for r in got if r["area"] == "one"} == {3}
    assert {(r["candidate"], r["stage"]): r["transfer"] for r in got if r["area"] == "two"} == {("u", 2): 2, ("u", 3): -12, ("v", 2): -8, ("v", 3): 0, ("w", 2): 6, ("w", 3): 12}


def test_lines_and_cells_of_pages(spark):
    edges = spark.createDataFrame([(1, x) for x in (10.0, 10.8, 12.5, 50.0, 51.0, 90.0)], "page int, x double")
    lines = S.rules(edges, ["page"], "x")
    assert [r["x"] for r in lines.orderBy("line").collect()] == [10.0, 50.0, 90.0]
    glyphs = [(1, 0, i, t, x, x + 5) for i, (t, x) in enumerate([("A", 12.0), ("n", 17.0), ("n", 22.0), ("7", 52.0), ("5", 57.0), ("x", 60.0)])]
    got = S.page_cells(spark.createDataFrame(glyphs, "page int, band int, seq int, text string, x0 double, x1 double"), lines).collect()
    assert {r["col"]: r["text"] for r in got} == {0: "Ann", 1: "75x"}


def test_features(spark):
    cells = spark.createDataFrame([("z1", "c", 3.0), ("z1", "p", 1.0), ("z2", "c", 0.0), ("z2", "p", 0.0), ("z3", "p", 4.0)], "zone string, code string, value double")
    got = {r["zone"]: (r["c"], r["cp"]) for r in X.share_table(cells, {"c": (["c"], None), "cp": (["c"], ["p"])}).collect()}
    assert got == {"z1": (0.75, 3.0), "z2": (None, None), "z3": (0.0, 0.0)}
    children = spark.createDataFrame([("z1", "s", 3.0, 10.0), ("z2", "s", 1.0, 5.0), ("z3", "t", 0.0, 2.0)], "zone string, parent string, pool double, base double")
    parents = spark.createDataFrame([("s", 8.0), ("t", 6.0)], "parent string, free double")
    assert {r["zone"]: r["free"] for r in X.from_parents(children, parents, ["free"]).collect()} == {"z1": 0.6, "z2": 0.4, "z3": 0.0}
    zones = spark.createDataFrame([("z1", 10.0, 0.2, 0.8), ("z2", 30.0, 0.6, 0.4)], "zone string, electorate double, a double, b double")
    every = X.layers({"council": spark.createDataFrame([("z1", "d1"), ("z2", "d1")], "zone string, area string"), "west": spark.createDataFrame([("z1", "w1"), ("z2", "w2")], "zone string, area string")})
    assert X.to_areas(zones, every.filter("layer = 'council'"), "electorate", ["a"]).first()["a"] == pytest.approx(0.5)
    results = spark.createDataFrame([("council", "d1", 40, 20), ("west", "w1", 10, 0), ("west", "w9", 5, 5)], "layer string, area string, electorate long, votes long")
    row = X.design(zones, every, results, ["a"]).collect()
    assert len(row) == 1 and row[0]["a"] == pytest.approx(0.5) and row[0]["y"] == pytest.approx(math.log(0.5)) and row[0]["w"] == 40
    prefs = spark.createDataFrame([("council", "d1", "a", 9.0), ("west", "w2", "b", 0.0)], "layer string, area string, party string, first_prefs double")
    seen = {(r["layer"], r["area"], r["party"]): (round(r["share"], 6), round(r["votes"], 6), r["stood"]) for r in X.observations(zones.withColumnRenamed("electorate", "voters"), every, prefs, {"council": 0.5, "west": 0.6}, ["a", "b"]).collect()}
    assert seen == {("council", "d1", "a"): (0.5, 10.0, True), ("council", "d1", "b"): (0.5, 10.0, False), ("west", "w2", "a"): (0.6, 10.8, False), ("west", "w2", "b"): (0.4, 7.2, False)}
    with pytest.raises(Exception, match="two areas"):
        X.layers({"c": spark.createDataFrame([("z1", "d1"), ("z1", "d2")], "zone string, area string")}).collect()
    register = spark.createDataFrame([("d1", 0.4)], "area string, share double")
    areas = every.filter("layer = 'council'").select("zone", "area")
    whole = X.aligned(zones.drop("electorate"), register, zones.select("zone", "electorate"), areas)
    assert {r["zone"]: (r["electorate"], r["turnout"], r["share"]) for r in whole.collect()} == {"z1": (10.0, 1.0, 0.4), "z2": (30.0, 1.0, 0.4)}
    with pytest.raises(Exception, match="no electorate for zone z2"):
        X.aligned(zones.drop("electorate"), register, zones.filter("zone = 'z1'").select("zone", "electorate"), areas).collect()
    assert X.complete(zones.withColumn("n", F.when(F.col("zone") == "z1", 1.0)), {"a": ("a", "electorate"), "b": ("b", "n")}) == ["a"]
    voters = spark.createDataFrame([("z1", 10.0, None, [1.0, 3.0]), ("z2", 10.0, 0.5, [0.0, 0.0])], "zone string, e double, t double, s array<double>")
    assert {r["zone"]: (r["votes"], list(r["shares"])) for r in X.zone_voters(voters).collect()} == {"z1": (10.0, [0.25, 0.75]), "z2": (5.0, [0.0, 0.0])}
    typed = X.joined_attributes(spark.createDataFrame([("z1",), ("z9",)], "zone string"), spark.createDataFrame([("z1", "7")], "zone string, pop string"), "zone", {"pop": "long"}).collect()
    assert {r["zone"]: r["pop"] for r in typed} == {"z1": 7, "z9": None}


def test_fits_over_folds_and_regions(spark):
    """Folds: a fitting penalty predicts areas left out; regions: shifted zones meet results, and combined shares sum to 1."""
    rng = np.random.default_rng(2)
    parties, blocs = ["a", "b", "c"], ["l", "l", "r"]
    x = rng.normal(size=(48, 2))
    slopes = np.array([[1.0, 0.2], [0.8, 0.3], [-1.2, 0.0]])
    p = np.exp(0.2 + x @ slopes.T)
    p /= p.sum(axis=1, keepdims=True)
    zones = spark.createDataFrame([(z, z % 12, 1.0 + z % 3, float(x[z, 0]), float(x[z, 1])) for z in range(48)], "zone long, area long, weight double, f double, g double")
    weight = 1.0 + np.arange(48) % 3
    shares = np.array([np.average(p[np.arange(48) % 12 == a], axis=0, weights=weight[np.arange(48) % 12 == a]) for a in range(12)])
    areas = spark.createDataFrame([(a, a % 3, 100.0, *map(float, shares[a])) for a in range(12)], "area long, fold long, votes double, a double, b double, c double")
    predicted = fits.out_of_sample(zones, areas, ["f", "g"], parties, blocs, [(0.001, 0.001), (50.0, 50.0)], tau=1.0).cache()
    curve = fits.cross_validated(predicted).collect()
    assert predicted.count() == 2 * 12 * 3 and (curve[0]["ridge"], curve[0]["kl"] < 0.02) == (0.001, True) and curve[1]["kl"] > 2 * curve[0]["kl"]
    code = np.arange(48) % 12
    model = fits.fit_blocs(x, code, weight, shares, np.full(12, 100.0), blocs, 0.001, 100.0)
    assert np.abs(model.slopes[0] - model.slopes[1]).max() < 0.01 < np.abs(model.slopes[0] - model.slopes[2]).max()
    steep = fits.steepened(model, x, code, weight, shares, np.full(12, 100.0), 1.5)
    assert np.allclose(steep.slopes, 1.5 * model.slopes) and np.abs(np.average(steep.predict(x), axis=0, weights=weight) - shares.mean(axis=0)).max() < 0.05
    cov = np.eye(3) - 1 / 3
    prior = spark.createDataFrame([("c", int(z % 4), z, float(weight[z]), *map(float, p[z])) for z in range(48)], "layer string, region long, zone long, voters double, a double, b double, c double")
    result = spark.createDataFrame([("c", r, 0.5, 0.3, 0.2) for r in range(4)], "layer string, region long, a double, b double, c double")
    shifts = fits.region_shifts(prior, result, parties, cov, 0.01).cache()
    assert shifts.count() == 12 and max(abs(r["s"]) for r in shifts.groupBy("region").agg(F.sum("shift").alias("s")).collect()) < 1e-9
    out = fits.combined(prior.drop("layer").withColumnRenamed("region", "c_area"), shifts.withColumn("layer", F.lit("c_area")), parties, cov, {"c_area": 0.01})
    rows = out.join(prior.select("zone", "voters", "region"), "zone").groupBy("region").agg(*[(F.sum(F.col("voters") * F.col(q)) / F.sum("voters")).alias(q) for q in parties]).collect()
    assert len(rows) == 4 and all(abs(r["a"] - 0.5) < 0.02 and abs(r["a"] + r["b"] + r["c"] - 1) < 1e-9 for r in rows)


def test_edges_are_not_gathered_as_a_small_table(spark, tmp_path, monkeypatch):
    """Rows that explode adds aren't in Spark's guess of a size: tables of edges, points and ring edges that grow with the zones are sorted, not broadcast."""
    cells = spark.range(900).select(F.col("id").alias("zone"), (F.col("id") % 30).cast("double").alias("x"), F.floor(F.col("id") / 30).cast("double").alias("y"))
    cells.write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    edges = cells.select(F.col("zone").alias("a"), F.explode(F.array(F.col("zone") + 1, F.col("zone") + 30)).alias("b")).filter("b < 900 and (b = a + 30 or b % 30 > 0)")
    monkeypatch.setattr(G, "MOST_SENT", 3)
    plans, cut = [], G._cut

    def seen(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return cut(frame)

    monkeypatch.setattr(G, "_cut", seen)
    monkeypatch.setattr(C, "_cut", seen)
    got = {r["zone"]: r["hops"] for r in G.frontier_hops(edges, 0, 7).collect()}
    assert got == {x + 30 * y: x + y for x in range(8) for y in range(8) if x + y <= 7}
    assert all("BroadcastHashJoin" not in p for p in plans[6:])
    made = sum("Generate explode" in p for p in plans)
    assert made == 1, "the edges are made once"
    plans.clear()
    pairs = spark.createDataFrame([(0, 61), (5, 5), (3, 899), (31, 32), (0, 33)], "a long, b long")
    hops = {(r["a"], r["b"]): r["hops"] for r in C.pair_hops(edges, pairs, 5).collect()}
    assert hops == {(0, 61): 3, (5, 5): None, (3, 899): None, (31, 32): 1, (0, 33): 4}
    assert sum("Generate explode" in p for p in plans) == 1
    near = G.proximity(cells, 1.0)
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()


def test_strips_follow_the_edges(spark):
    """A tall stack of squares: a point meets the edges at its own height, however many stand above."""
    n = 2000
    corners = ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))
    edges = spark.range(n).select(F.col("id").alias("part"), F.lit(0).alias("ring"), F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(k, "abcd", strict=True)]) for k in corners])).alias("s"))
    edges = edges.select("part", "ring", F.col("s.a").alias("x1"), (F.col("part") * 2 + F.col("s.b")).alias("y1"), F.col("s.c").alias("x2"), (F.col("part") * 2 + F.col("s.d")).alias("y2"))
    points = spark.range(2 * n).select("id", F.lit(0.5).alias("x"), (F.col("id") + 0.5).alias("y"))
    found = G.contains(points, edges)
    assert {r["id"] for r in found.filter("inside").collect()} == set(range(0, 2 * n, 2))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert f"/ {(2 * n - 1) / 256}" not in plan, "strips are as narrow as edges are many"
