"""Every query against its SQL, on the smallest tables."""

import math

import pytest

from hustings.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL


def plain(value):
    if hasattr(value, "asDict"):
        return [plain(x) for x in value]
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return float(value) if type(value).__name__ == "Decimal" else value


def same(spark, duck, df, sql):
    relation = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted(str([plain(x) for x in row]) for row in df.select(columns).collect())
    want = sorted(str([plain(x) for x in row]) for row in relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, QUERIES[name](spark, SMALL), ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_searches_give_whole_maps(spark):
    """Each run of a search query gives every zone one of its regions; regions are in one piece, and the score is that of the map."""
    import numpy as np

    from hustings.operators import search as Q
    from hustings.plans import searches as P
    from hustings.plans.graphs import _edges

    zones = {r["zone"]: r for r in P.zones_of(spark, SMALL).collect()}
    order = sorted(zones)
    place = {z: i for i, z in enumerate(order)}
    near = [[] for _ in order]
    for r in _edges(spark, SMALL).select("a", "b").collect():
        near[place[r["a"]]].append(place[r["b"]])
        near[place[r["b"]]].append(place[r["a"]])
    column = lambda c: np.array([float(zones[z][c]) for z in order])
    table = Q.Zones(column("people"), near, column("area"), column("x"), column("y"))
    for name in ("search_build", "search_recombine"):
        rows = QUERIES[name](spark, SMALL).collect()
        assert len(rows) == len(order) * len(P.RUNS)
        for run, n, _ in P.RUNS:
            mine = {place[r["zone"]]: r["region"] for r in rows if r["run"] == run}
            score = next(r["score"] for r in rows if r["run"] == run)
            kept = Q.Regions(table, n, 1, P.SETTINGS)
            kept.adopt([mine[i] for i in range(len(order))])
            assert set(mine.values()) == set(range(n)) and abs(kept.score() - score) < 1e-5 * max(1, abs(score))
            left, pieces = set(mine), []
            while left:
                walk = [left.pop()]
                for z in walk:
                    for w in near[z]:
                        if w in left and mine[w] == mine[z]:
                            left.discard(w)
                            walk.append(w)
                pieces.append(mine[walk[0]])
            assert len(pieces) == n


def test_fits_give_whole_tables(spark):
    """Transfer rows and posterior shares sum to 1; the least divergence comes first."""
    rows = QUERIES["transfer_fit"](spark, SMALL).collect()
    for src in {r["src"] for r in rows}:
        assert abs(sum(r["w"] for r in rows if r["src"] == src) - 1) < 0.001
    shares = QUERIES["support_posterior"](spark, SMALL).collect()
    assert shares and all(abs(r["automobile"] + r["building"] + r["furniture"] - 1) < 1e-4 for r in shares)
    curve = [r["kl"] for r in QUERIES["support_cross_validation"](spark, SMALL).collect()]
    assert curve == sorted(curve)
