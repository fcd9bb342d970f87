"""Queries on checks of maps, votes as cast, model tables and count sheets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import election as E
from ..operators import estimators as M
from ..operators import features as X
from ..operators import fits
from ..operators import graph as G
from ..operators import tables as O
from ..sources import geojson as J
from ..sources import sheets as S
from .bindings import LATTICE_SQL, PARTIES, VOTES_SQL, exhaustion, lattice, lattice_vertices, table, transfers, votes
from .elections import _INDEX, SEATS, STV_SQL, _piles, _standing_sql
from .graphs import _edges

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {LATTICE_SQL}, loops AS (SELECT count(*) AS n FROM cells WHERE p_size = 1), strange AS (SELECT count(*) AS n FROM cells WHERE p_size = 2), thin AS (SELECT count(*) AS n FROM edges WHERE a % 5 = 0)
SELECT * FROM (SELECT 'zone twice' AS check, 0::BIGINT AS faults UNION ALL SELECT 'unknown zone', n FROM strange UNION ALL SELECT 'loop', n FROM loops UNION ALL SELECT 'edge twice', 0 UNION ALL SELECT 'thin boundary', n FROM thin
  UNION ALL SELECT 'crossing without gap', 0 UNION ALL SELECT 'alone', 0 UNION ALL SELECT 'edge and touch', 0 UNION ALL SELECT 'further pieces', 0)""")
def graph_checks(spark, d):
    """What a neighbour graph must not have, with loops, unknown zones and slivers put in."""
    cells = lattice(spark, d)
    edges = _edges(spark, d).select("a", "b", F.lit("boundary").alias("kind"), F.when(F.col("a") % 5 == 0, 0.001).otherwise(F.col("shared")).alias("shared"), F.lit(None).cast("double").alias("gap"))
    extra = cells.filter("p_size in (1, 2)").select(F.col("zone").alias("a"), F.when(F.col("p_size") == 1, F.col("zone")).otherwise(-F.col("zone") - 1).alias("b"), F.lit("boundary").alias("kind"), F.lit(1.0).alias("shared"), F.lit(None).cast("double").alias("gap"))
    found = G.segments(lattice_vertices(cells))
    return C.graph_faults(cells.select("zone"), edges.unionByName(extra), G.point_touches(found, edges).select("a", "b"))


@query(f"""WITH {LATTICE_SQL}, t AS (SELECT a.zone AS a, b.zone AS b FROM cells a JOIN cells b ON b.y = a.y + 1 AND abs(b.x - a.x) = 1), s AS (SELECT a, b FROM edges WHERE a % 11 <> 0 UNION ALL SELECT a, b FROM t WHERE a % 13 = 0 UNION ALL SELECT a, a + 1000000 FROM edges WHERE a % 17 = 0 AND b = a + 1)
SELECT 'lost' AS change, a, b FROM (SELECT a, b FROM edges EXCEPT ALL SELECT a, b FROM s) UNION ALL SELECT 'gained', a, b FROM (SELECT a, b FROM s EXCEPT ALL SELECT a, b FROM edges)
UNION ALL SELECT 'not a touch', a, b FROM (SELECT a, b FROM s EXCEPT ALL SELECT a, b FROM edges) WHERE (a, b) NOT IN (SELECT (a, b) FROM t)""")
def border_changes(spark, d):
    """Borders that a simplified map lost and gained; only such may be gained as touched in a point before."""
    found = G.segments(lattice_vertices(lattice(spark, d)))
    edges = _edges(spark, d).select("a", "b")
    touches = G.point_touches(found, edges).select("a", "b")
    strange = edges.filter("a % 17 = 0 and b = a + 1").select("a", (F.col("a") + 1_000_000).alias("b"))
    simple = edges.filter("a % 11 <> 0").unionByName(touches.filter("a % 13 = 0")).unionByName(strange)
    return C.border_changes(edges, simple, touches)


WATER_SQL = """cells AS (SELECT p_partkey AS zone, p_partkey % 40 AS x, p_partkey // 40 AS y FROM part WHERE p_size % 3 <> 0),
edges AS (SELECT a.zone AS a, b.zone AS b FROM cells a JOIN cells b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)),
s AS (SELECT zone, x AS px, y AS py, x + 1 AS qx, y AS qy FROM cells UNION ALL SELECT zone, x, y + 1, x + 1, y + 1 FROM cells UNION ALL SELECT zone, x, y, x, y + 1 FROM cells UNION ALL SELECT zone, x + 1, y, x + 1, y + 1 FROM cells),
o AS (SELECT px, py, qx, qy, min(zone) AS zone FROM s GROUP BY ALL HAVING count(*) = 1),
p AS (SELECT DISTINCT zone, x, y FROM (SELECT zone, px AS x, py AS y FROM o UNION ALL SELECT zone, qx, qy FROM o)),
near AS (SELECT a.zone AS a, b.zone AS b, min((sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), (a.x + b.x) / 2, (a.y + b.y) / 2)) AS m FROM p a JOIN p b ON a.zone < b.zone AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1 GROUP BY ALL),
water AS (SELECT a, b, m[1] AS gap FROM near WHERE (a, b) NOT IN (SELECT (a, b) FROM edges) AND NOT EXISTS (SELECT 1 FROM cells c WHERE c.x = floor(m[2]) AND c.y = floor(m[3]))),
ways AS (SELECT a AS f, b AS t FROM edges UNION ALL SELECT b, a FROM edges),
walk(a, b, zone, h) AS (SELECT a, b, a, 0 FROM water UNION SELECT w.a, w.b, t, h + 1 FROM walk w JOIN ways ON f = zone WHERE h < 5),
hops AS (SELECT a, b, min(h) AS hops FROM walk WHERE zone = b AND h > 0 GROUP BY ALL)"""


@query(f"WITH RECURSIVE {WATER_SQL} SELECT a, b, round(gap, 6) AS gap, CAST(hops AS INT) AS hops, a % 7 = 0 AS declared, (hops IS NULL OR hops >= 4) AND a % 7 <> 0 AS suspicious FROM water LEFT JOIN hops USING (a, b)")
def gap_audit(spark, d):
    """Cells close to each other over water: how far apart they are by land, and whether a crossing is declared."""
    cells = lattice(spark, d).filter("p_size % 3 <> 0")
    corners = lattice_vertices(cells)
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(e).alias("e")) for a, b, c, e in ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))])
    rings = cells.select(F.col("zone").alias("part"), F.lit(0).alias("ring"), "x", "y", F.explode(sides).alias("s"))
    rings = rings.select("part", "ring", *[(F.col(v) + F.col(f"s.{n}")).cast("double").alias(name) for v, n, name in (("x", "a", "x1"), ("y", "b", "y1"), ("x", "c", "x2"), ("y", "e", "y2"))])
    segments = G.segments(corners)
    declared = G.proximity(G.margin_points(segments), 1.0).select("a", "b").filter("a % 7 = 0")
    found = C.gap_audit(segments, rings, declared, 1.0, metres=False, cap=5, near=4)
    return found.select("a", "b", F.round("gap", 6).alias("gap"), "hops", "declared", "suspicious")


@query(f"""WITH {LATTICE_SQL}, s AS (SELECT a FROM edges UNION ALL SELECT b FROM edges), g AS (SELECT zone, count(s.a) AS degree FROM cells LEFT JOIN s ON s.a = zone GROUP BY 1)
SELECT min(degree) AS least, round(avg(degree), 6) AS mean, max(degree) AS most, count(*) FILTER (degree = 0) AS alone FROM g""")
def degree_report(spark, d):
    return C.degree_report(lattice(spark, d), _edges(spark, d))


@query(f"""WITH {LATTICE_SQL}, b AS (SELECT a.zone AS a, b.zone AS b FROM cells a JOIN cells b ON b.zone = a.zone + 205 WHERE a.zone % 50 = 3)
SELECT a, b, round(sqrt(pow(cos(radians((m + n) / 2)) * (p - q) * 111320, 2) + pow((n - m) * 111320, 2)), 3) AS gap FROM (SELECT b.a, b.b, (u.y + 1) / 1000 AS m, v.y / 1000 AS n, (CASE WHEN v.x > u.x THEN u.x + 1 ELSE u.x END) / 1000 AS p, (CASE WHEN v.x > u.x THEN v.x ELSE v.x + 1 END) / 1000 AS q
  FROM b JOIN cells u ON u.zone = b.a JOIN cells v ON v.zone = b.b)""")
def crossing_gaps(spark, d):
    """Metres between declared pairs of cells of a thousandth of a degree, at their closest corners."""
    cells = lattice(spark, d)
    pairs = cells.filter("zone % 50 = 3").select(F.col("zone").alias("a"), (F.col("zone") + 205).alias("b")).join(cells.select(F.col("zone").alias("b")), "b").select("a", "b")
    corners = lattice_vertices(cells).select("zone", (F.col("x") / 1000).alias("x"), (F.col("y") / 1000).alias("y"))
    return C.least_gaps(pairs, corners).withColumn("gap", F.round("gap", 3))


@query(f"WITH {LATTICE_SQL} SELECT a, b, CAST(1 AS DOUBLE) AS shared FROM edges")
def geojson_round_trip(spark, d):
    """Cells written as GeoJSON and read back have the same neighbours."""
    cells = lattice(spark, d)
    made = J.as_features(lattice_vertices(cells), cells.select("zone", "p_size"))
    features = made.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "feature", F.lit("]}")).alias("json"))
    corners = J.vertices(J.features_of(features), "code").withColumn("zone", F.col("zone").cast("long"))
    return G.shared_boundaries(G.segments(corners), metres=False)


#: The standing rule at a turnout of 60 %, then the tactical steps over what is counted.
CAST_SQL = f"""{_standing_sql(f"(0.14 + 0.002 * {_INDEX}) * sum(votes) OVER (PARTITION BY area)").removeprefix("WITH ").split("SELECT area, party, votes, stands")[0].rstrip()},
standing AS (SELECT area, party, 0.6 * CASE WHEN stands THEN votes + coalesce(gain, 0) ELSE 0 END AS votes, stands FROM s LEFT JOIN g USING (area, party)),
seen AS (SELECT *, max(votes) OVER w AS lead, sum(votes) OVER w AS whole FROM standing WINDOW w AS (PARTITION BY area)),
able_ AS (SELECT *, CASE WHEN votes > 0 THEN exp(-((lead - votes) / whole) / 0.08) ELSE 0 END AS viable FROM seen WHERE whole > 0),
sure AS (SELECT *, viable / sum(viable) OVER (PARTITION BY area) AS sh FROM able_), unsure AS (SELECT *, greatest(0, 1 - sum(sh * sh) OVER (PARTITION BY area)) AS doubt FROM sure),
leave AS (SELECT *, votes * 0.28 * doubt * (1 - viable) AS moving FROM unsure),
ways AS (SELECT f.area, f.party AS src, o.party AS dst, f.moving, o.viable, o.viable * coalesce(w, 0) AS pull FROM leave f JOIN leave o ON o.area = f.area AND o.party <> f.party AND o.votes > 0 LEFT JOIN transfers tr ON tr.src = f.party AND tr.dst = o.party WHERE f.moving > 0),
weighed AS (SELECT *, CASE WHEN sum(pull) OVER (PARTITION BY area, src) > 0 THEN pull ELSE viable END AS wt FROM ways),
come AS (SELECT area, dst AS party, sum(part) AS gain FROM (SELECT *, moving * wt / nullif(sum(wt) OVER (PARTITION BY area, src), 0) AS part FROM weighed) GROUP BY ALL),
tactical AS (SELECT area, party, votes - greatest(moving, 0) + coalesce(gain, 0) AS cast_votes FROM leave LEFT JOIN come USING (area, party))"""


def _cast(spark, d):
    bars = spark.createDataFrame([(p, 0.14 + i * 0.002) for i, p in enumerate(PARTIES)], "party string, threshold double")
    return E.ballots_cast(votes(spark, d, skewed=True), F.lit(0.6), bars, transfers(spark, d), exhaustion(spark, d), True, tactical=True)


@query(f"WITH {CAST_SQL} SELECT s.area, s.party, s.stands, round(coalesce(cast_votes, s.votes), 6) AS votes FROM standing s LEFT JOIN tactical t USING (area, party)")
def votes_as_cast(spark, d):
    """First past the post: turnout, then parties that don't stand, then tactical votes."""
    return _cast(spark, d).select("area", "party", "stands", F.round("votes", 6).alias("votes"))


@query(f"""WITH RECURSIVE {STV_SQL}, last AS (SELECT area, won FROM count_ QUALIFY row_number() OVER (PARTITION BY area ORDER BY step DESC) = 1), u AS (SELECT area, unnest(won) AS seats, unnest([0, 1, 2, 3, 4]) AS i FROM last)
SELECT area, party, CAST(seats AS INT) AS seats FROM u JOIN parties USING (i)""")
def region_seats_stv(spark, d):
    """Seats by party and area under transferable votes, long."""
    moves = {(r["src"], r["dst"]): r["w"] for r in transfers(spark, d).collect()}
    rates = {r["party"]: r["rate"] for r in exhaustion(spark, d).collect()}
    return E.seats(votes(spark, d, skewed=True), PARTIES, "stv", SEATS, [[moves.get((p, q), 0.0) for q in PARTIES] for p in PARTIES], [rates.get(p, 0.0) for p in PARTIES])


@query(f"""WITH {CAST_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY cast_votes DESC, party) AS rk FROM tactical), n AS (SELECT party, count(*) FILTER (rk = 1 AND cast_votes > 0) AS seats FROM w GROUP BY 1)
SELECT party, seats, round(coalesce(sum(seats) OVER (ORDER BY party ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(seats) OVER (), 6) AS begin, round(sum(seats) OVER (ORDER BY party) / sum(seats) OVER (), 6) AS "end" FROM n""")
def seat_wedges(spark, d):
    """Seats won first past the post, and each party's wedge of the circle."""
    won = E.seats(_cast(spark, d), PARTIES, "fptp", 1, [], [])
    found = E.wedges(won.groupBy("party").agg(F.sum("seats").alias("seats")), PARTIES)
    return found.select("party", "seats", F.round("begin", 6).alias("begin"), F.round("end", 6).alias("end"))


EVENTS_OF_COUNTS = f"""{STV_SQL}, b AS (SELECT *, lag(live) OVER w AS was, lag(exhausted) OVER w AS was_out FROM count_ WINDOW w AS (PARTITION BY area ORDER BY step)),
g AS (SELECT area, step, unnest(range(0, 5)) AS p, unnest(live) AS l, unnest(was) AS m FROM b WHERE step > 0),
o AS (SELECT *, coalesce(sum(greatest(l - m, 0)) OVER (PARTITION BY area, p ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gained FROM g),
happened AS (SELECT b.area, b.step, b.party, m AS moved, exhausted - was_out AS nt FROM b JOIN o ON o.area = b.area AND o.step = b.step AND o.p = b.party WHERE kind = 'excluded' AND gained / m <= 0.25)"""


def _events(spark, d):
    from pyspark.sql import Window as W

    counted = _piles(spark, d).select("area", E.stv("votes", "matrix", "rates", SEATS, len(PARTIES), stages=True).alias("c"))
    steps = counted.select("area", "c.quota", F.posexplode("c.stages").alias("stage", "s"))
    long = steps.select("area", "quota", "stage", F.col("s.exhausted").alias("exhausted"), F.posexplode("s.live").alias("candidate", "held"))
    by = W.partitionBy("area", "candidate").orderBy("stage")
    moves = long.withColumns({"transfer": F.col("held") - F.lag("held").over(by), "nt": F.col("exhausted") - F.lag("exhausted").over(by), "party": F.col("candidate")}).filter("transfer is not null")
    first = long.filter("stage = 0").select("area", "candidate", F.col("held").alias("first_pref"))
    return E.clean(E.events(moves.join(first, ["area", "candidate"])), range(len(PARTIES)))


@query(f"""WITH RECURSIVE {EVENTS_OF_COUNTS} SELECT i AS party, coalesce(round_even(sum(nt) / sum(moved), 4), 0.15) AS rate FROM parties LEFT JOIN happened ON happened.party = i GROUP BY 1""")
def clean_exhaustion(spark, d):
    """What was lost of the piles that parties passed on, over clean events of the counts; 0.15 without one."""
    return E.exhaustion_rates(_events(spark, d), range(len(PARTIES)))


def transfer_fit(spark, d):
    """Transfer rows fitted on clean events, drawn to their blocs'; events are as few as counts have stages."""
    received = E.receipts(_events(spark, d), range(len(PARTIES)))
    rows = received.orderBy("event", "dst").collect()
    events = sorted({(r["event"], r["src"]) for r in rows})
    at = {e: i for i, (e, _) in enumerate(events)}
    counts, there = np.zeros((len(events), len(PARTIES))), np.zeros((len(events), len(PARTIES)), int)
    for r in rows:
        counts[at[r["event"]], r["dst"]] += r["share"]
        there[at[r["event"]], r["dst"]] = 1
    drawn, _, _ = M.transfer_matrix(counts, there, np.array([s for _, s in events], int), ["l", "l", "r", "r", "c"])
    found = [(PARTIES[i], PARTIES[j], round(float(drawn[i, j]), 4)) for i in range(len(PARTIES)) for j in range(len(PARTIES)) if i != j]
    return spark.createDataFrame(found, "src string, dst string, w double")


QUERIES["transfer_fit"] = transfer_fit


@query(f"""WITH {VOTES_SQL}, t AS (SELECT area, sum(votes) AS base, coalesce(sum(votes) FILTER (party IN ('AUTOMOBILE', 'BUILDING')), 0) AS ab, coalesce(sum(votes) FILTER (party = 'BUILDING'), 0) AS b, coalesce(sum(votes) FILTER (party = 'MACHINERY'), 0) AS pool FROM votes GROUP BY 1),
c AS (SELECT c_nationkey AS area, count(*) FILTER (c_acctbal > 0) / count(*) AS up FROM customer GROUP BY 1), n AS (SELECT n_nationkey AS area, n_regionkey AS parent FROM nation), q AS (SELECT parent, CAST(count(*) AS DOUBLE) * 10 AS detail FROM n GROUP BY 1)
SELECT area AS zone, round(ab / base, 6) AS left_share, round(b / nullif(ab, 0), 6) AS within, round(up - ab / base, 6) AS lapsed, round(detail * pool / sum(pool) OVER (PARTITION BY parent) / base, 6) AS detail FROM t JOIN c USING (area) JOIN n USING (area) JOIN q USING (parent)""")
def feature_table(spark, d):
    """Shares of areas, what a share has lost, and detail that is only known of the parent, dealt by the share of a pool."""
    cells = votes(spark, d).select(F.col("area").alias("zone"), F.col("party").alias("code"), F.col("votes").alias("value"))
    shares = X.share_table(cells, {"left_share": (PARTIES[:2], None), "within": (PARTIES[1:2], PARTIES[:2])})
    up = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg((F.count_if(F.col("c_acctbal") > 0) / F.count("*")).alias("up"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), F.col("n_regionkey").alias("parent"))
    base = cells.groupBy("zone").agg(F.sum("value").alias("base"), F.coalesce(F.sum(F.when(F.col("code") == PARTIES[4], F.col("value"))), F.lit(0.0)).alias("pool"))
    parents = nation.groupBy("parent").agg((F.count("*") * 10.0).alias("detail"))
    detail = X.from_parents(base.join(nation, "zone"), parents, ["detail"])
    return shares.join(up, "zone").join(detail, "zone").select("zone", *[F.round(c, 6).alias(c) for c in ("left_share", "within")], F.round(X.lapsed(F.col("up"), F.col("left_share")), 6).alias("lapsed"), F.round("detail", 6).alias("detail"))


LAYERS_SQL = "z AS (SELECT c_custkey AS zone, CAST(1 + c_custkey % 5 AS DOUBLE) AS electorate, c_acctbal / 10000 AS x FROM customer), l AS (SELECT 'nation' AS layer, c_custkey AS zone, c_nationkey AS area FROM customer UNION ALL SELECT 'part', c_custkey, CAST(c_custkey % 7 AS INT) FROM customer)"


def _layers(spark, d):
    customer = table(spark, d, "customer")
    zones = customer.select(F.col("c_custkey").alias("zone"), (1 + F.col("c_custkey") % 5).cast("double").alias("electorate"), (F.col("c_acctbal") / 10000).alias("x"), F.col("c_mktsegment").alias("segment"))
    member = {"nation": customer.select(F.col("c_custkey").alias("zone"), F.col("c_nationkey").alias("area")), "part": customer.select(F.col("c_custkey").alias("zone"), (F.col("c_custkey") % 7).cast("int").alias("area"))}
    return zones, X.layers(member)


@query(f"WITH {LAYERS_SQL} SELECT layer, area, round(sum(electorate * x) / sum(electorate), 6) AS x, round(ln((30 + area) / (100 + area)), 6) AS y, CAST(100 + area AS DOUBLE) AS w FROM z JOIN l USING (zone) WHERE area <> 3 GROUP BY ALL")
def turnout_design(spark, d):
    """Means of areas of two layers by electors, beside their log turnout; an area without votes is left out."""
    zones, every = _layers(spark, d)
    results = every.select("layer", "area").distinct().select("layer", "area", (100 + F.col("area")).alias("electorate"), F.when(F.col("area") == 3, 0).otherwise(30 + F.col("area")).alias("votes"))
    return X.design(zones, every, results, ["x"]).select("layer", "area", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "w")


@query(f"""WITH {LAYERS_SQL}, s AS (SELECT layer, area, sum(electorate) AS v, sum(electorate) FILTER (c_mktsegment = 'BUILDING') AS b FROM z JOIN l USING (zone) JOIN customer ON c_custkey = zone GROUP BY ALL)
SELECT layer, area, party, round(CASE party WHEN 'BUILDING' THEN coalesce(b, 0) ELSE v - coalesce(b, 0) END / v, 6) AS share, round(CASE party WHEN 'BUILDING' THEN coalesce(b, 0) ELSE v - coalesce(b, 0) END * CASE layer WHEN 'nation' THEN 0.5 ELSE 0.7 END, 6) AS votes, area % 2 = 0 AND party = 'BUILDING' AS stood
FROM s CROSS JOIN (VALUES ('BUILDING'), ('others')) p(party) WHERE area <> 5""")
def standing_observations(spark, d):
    """What parties would have in the areas of two layers, and where they stood."""
    zones, every = _layers(spark, d)
    known = zones.select("zone", F.col("electorate").alias("voters"), (F.col("segment") == "BUILDING").cast("double").alias("BUILDING"), (F.col("segment") != "BUILDING").cast("double").alias("others"))
    prefs = every.select("layer", "area").distinct().filter("area <> 5").select("layer", "area", F.lit("BUILDING").alias("party"), F.when(F.col("area") % 2 == 0, 5.0).otherwise(0.0).alias("first_prefs"))
    found = X.observations(known, every, prefs, {"nation": 0.5, "part": 0.7}, ["BUILDING", "others"])
    return found.select("layer", "area", "party", F.round("share", 6).alias("share"), F.round("votes", 6).alias("votes"), "stood")


@query("""WITH a AS (SELECT c_nationkey, count(DISTINCT c_custkey) AS electorate, count(o_orderkey) AS polled, count(o_orderkey) FILTER (o_orderstatus <> 'P') AS valid FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT CAST(sum(electorate) AS BIGINT) AS electorate, CAST(sum(polled) AS BIGINT) AS polled, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(polled) - sum(valid) AS BIGINT) AS rejected, round(sum(polled) / sum(electorate), 6) AS turnout FROM a""")
def election_totals(spark, d):
    """Electors, votes polled, valid and rejected, and turnout, over all areas."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("polled"), F.count_if(F.col("o_orderstatus") != "P").alias("valid"))
    areas = table(spark, d, "customer").join(orders, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("electorate"), F.coalesce(F.sum("polled"), F.lit(0)).alias("polled"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"))
    return E.totals(areas).withColumn("turnout", F.round("turnout", 6))


@query(f"""WITH {LAYERS_SQL}, s AS (SELECT layer, area, round(sum(electorate), 6) AS votes FROM z JOIN l USING (zone) GROUP BY ALL)
SELECT layer, area, party, votes FROM s CROSS JOIN (VALUES ('x'), ('y')) p(party) WHERE NOT (layer = 'nation' AND party = 'x' AND area % 6 = 0)""")
def standing_without_pacts(spark, d):
    """Observations of who stood, but for areas in which a party stood down for another."""
    zones, every = _layers(spark, d)
    parties = spark.createDataFrame([("x",), ("y",)], "party string")
    seen = every.join(zones, "zone").groupBy("layer", "area").agg(F.round(F.sum("electorate"), 6).alias("votes")).join(F.broadcast(parties))
    pacts = spark.createDataFrame([("nation", "x", a) for a in range(0, 25, 6)], "layer string, party string, area int")
    return E.without_pacts(seen, pacts).select("layer", "area", "party", "votes")


@query("""WITH n AS (SELECT n_name, row_number() OVER (ORDER BY first, n_name) - 1 AS code, n_nationkey FROM (SELECT n_name, n_nationkey, min(c_custkey) AS first FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL))
SELECT c_custkey AS zone, CAST(code AS INT) AS region FROM customer JOIN n ON n_nationkey = c_nationkey""")
def real_regions(spark, d):
    """Zones' regions as numbers, in the order in which their names first appear."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    zones = table(spark, d, "customer").select(F.col("c_custkey").alias("zone"), "c_nationkey").join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey")).select("zone", "n_name")
    _, found = O.region_index(zones, zones, "zone", "n_name", "zone")
    return found.select("zone", F.col("region").cast("int").alias("region"))


@query("""WITH o AS (SELECT c_custkey % 40 AS zone, c_nationkey % 6 AS area, sum(greatest(c_acctbal, 0)) AS amount FROM customer GROUP BY ALL), k AS (SELECT *, sum(amount) OVER (PARTITION BY zone) AS whole FROM o),
m AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY amount DESC, area) AS rk, sum(amount) OVER (PARTITION BY zone) AS kept FROM k WHERE amount >= 1e-6 * whole)
SELECT zone, string_agg(area || ':' || printf('%.6f', round(amount / kept, 6)), ',' ORDER BY rk) AS others FROM m WHERE rk > 1 GROUP BY 1""")
def overlap_others(spark, d):
    """What zones overlap beside their greatest area, the largest first."""
    overlaps = table(spark, d, "customer").groupBy((F.col("c_custkey") % 40).alias("zone"), (F.col("c_nationkey") % 6).alias("area")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("amount"))
    found = O.other_areas(overlaps, "zone", "area", "amount")
    text = F.transform("others", lambda o: F.concat(o["area"].cast("string"), F.lit(":"), F.format_string("%.6f", o["share"])))
    return found.select("zone", F.array_join(text, ",").alias("others"))


SHEETS_SQL = """n AS (SELECT l_orderkey AS area, l_linenumber AS candidate, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY ALL),
t AS (SELECT area, candidate, unnest([1, 2]) AS k, unnest([q, -q * d]) AS transfer FROM n WHERE area % 140 <> 0 OR area NOT IN (SELECT area FROM n WHERE candidate = 1)),
m AS (SELECT *, max(abs(transfer)) OVER (PARTITION BY area, k) > 1e-9 AS moved FROM t)"""


@query(f"WITH {SHEETS_SQL} SELECT area, candidate, dense_rank() OVER (PARTITION BY area ORDER BY k) + 1 AS stage, round(transfer, 6) AS transfer FROM m WHERE moved")
def proved_stages(spark, d):
    """Transfers of printed sheets whose totals chain; sheets with a wrong total give none."""
    sheets = table(spark, d, "lineitem").filter("l_orderkey % 20 = 0").groupBy(F.col("l_orderkey").alias("area"), F.col("l_linenumber").alias("candidate"))
    lines = sheets.agg(F.max("l_extendedprice").alias("first_pref"), F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    moves = [F.col("l_quantity"), -F.col("l_quantity") * F.col("l_discount")]
    wrong = F.when((F.col("area") % 140 == 0) & (F.col("candidate") == 1), 1.0).otherwise(0.0)
    start = (3 + F.col("area") % 40 / 20).cast("int")
    totals = [F.col("first_pref") + moves[0], F.col("first_pref") + moves[0] + moves[1] + wrong]
    printed = F.array(*[F.struct((start + i).alias("col"), v.alias("value")) for i, v in enumerate((moves[0], totals[0], moves[1], totals[1]))])
    grid = lines.select("area", "candidate", F.inline(printed))
    found = S.chained_columns(grid, lines.select("area", "candidate", "first_pref"), (3, 4))
    return found.select("area", "candidate", "stage", F.round("transfer", 6).alias("transfer"))


def _support(spark, d):
    """Zones and areas of a support model: customers by nation, three parties out of the segments."""
    parties = PARTIES[:3]
    customer = table(spark, d, "customer").filter(F.col("c_mktsegment").isin(parties))
    area = F.col("c_nationkey").cast("long")
    zones = customer.groupBy(area.alias("area"), (F.col("c_custkey") % 4).alias("k")).agg(F.count("*").cast("double").alias("weight"), F.avg(F.col("c_acctbal") / 10000).alias("f"), F.avg((F.length("c_name") % 5 + F.col("c_custkey") % 3).cast("double")).alias("g"))
    zones = zones.withColumn("zone", F.col("area") * 4 + F.col("k")).drop("k")
    seen = customer.groupBy(area.alias("area")).pivot("c_mktsegment", parties).agg(F.count(F.lit(1)).cast("double")).na.fill(0.0)
    total = sum((F.col(p) for p in parties), F.lit(0.0))
    return parties, zones, seen.select("area", (F.col("area") % 4).alias("fold"), total.alias("votes"), *[(F.col(p) / total).alias(p) for p in parties])


def support_cross_validation(spark, d):
    """Divergence of left-out folds by two penalties, the least first: a group for each fold and pair."""
    parties, zones, areas = _support(spark, d)
    found = fits.out_of_sample(zones, areas, ["f", "g"], parties, ["l", "l", "r"], [(0.1, 3.16), (1.0, 10.0)])
    return fits.cross_validated(found).select("ridge", "within", F.round("kl", 6).alias("kl"))


def support_posterior(spark, d):
    """Shares of zones once the results of their areas have moved a prior, by region and brought together."""
    parties, zones, areas = _support(spark, d)
    prior = zones.select("zone", F.col("weight").alias("voters"), F.col("area").alias("nation"), *[F.lit(1 / 3).alias(p) for p in parties])
    cov = (np.eye(3) - 1 / 3) * 0.5
    shifts = fits.region_shifts(prior.select(F.lit("nation").alias("layer"), F.col("nation").alias("region"), "zone", "voters", *parties), areas.select(F.lit("nation").alias("layer"), F.col("area").alias("region"), *parties), parties, cov)
    found = fits.combined(prior, shifts, parties, cov, {"nation": 0.05})
    return found.select("zone", *[F.round(p, 5).alias(p.lower()) for p in parties])


QUERIES |= {"support_cross_validation": support_cross_validation, "support_posterior": support_posterior}
