"""Queries on the zone graph, its geometry and the score of an assignment."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import graph as G
from ..operators import scoring as R
from .bindings import LATTICE_SQL, lattice, lattice_vertices, table

QUERIES, ORACLES = {}, {}
#: A square with a hole, and a triangle, as rings: (part, ring, [(x, y), ...]).
POLYGON = ((0, 0, ((-0.2, -0.2), (0.15, -0.2), (0.15, 0.15), (-0.2, 0.15))), (0, 1, ((-0.05, -0.05), (0.05, -0.05), (0.05, 0.05), (-0.05, 0.05))), (1, 0, ((0.16, -0.1), (0.3, 0.0), (0.16, 0.1))))
SIZES_SQL = "region AS (SELECT zone, CAST(p_size <= 25 AS INT) AS region FROM cells)"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _edges(spark, d):
    return G.shared_boundaries(G.segments(lattice_vertices(lattice(spark, d))), metres=False)


def _classes(spark, d):
    return lattice(spark, d).select("zone", (F.col("p_size") <= 25).cast("int").alias("region"))


@query(f"WITH {LATTICE_SQL} SELECT a, b, CAST(1 AS DOUBLE) AS shared FROM edges")
def lattice_shared_boundary(spark, d):
    return _edges(spark, d)


@query("""WITH cells AS (SELECT p_partkey AS zone, p_partkey % 40 AS x, p_partkey // 40 AS y FROM part)
SELECT a.zone AS a, b.zone AS b, CAST(greatest(a.x, b.x) AS DOUBLE) AS x, CAST(greatest(a.y, b.y) AS DOUBLE) AS y FROM cells a JOIN cells b ON b.y = a.y + 1 AND abs(b.x - a.x) = 1""")
def lattice_point_touch(spark, d):
    found = G.segments(lattice_vertices(lattice(spark, d)))
    return G.point_touches(found, _edges(spark, d)).select("a", "b", "at.x", "at.y")


@query("""WITH cells AS (SELECT p_partkey AS zone, p_partkey % 40 AS x, p_partkey // 40 AS y FROM part),
s AS (SELECT zone, x AS px, y AS py, x + 1 AS qx, y AS qy FROM cells UNION ALL SELECT zone, x, y + 1, x + 1, y + 1 FROM cells
  UNION ALL SELECT zone, x, y, x, y + 1 FROM cells UNION ALL SELECT zone, x + 1, y, x + 1, y + 1 FROM cells),
o AS (SELECT px, py, qx, qy, min(zone) AS zone FROM s GROUP BY ALL HAVING count(*) = 1)
SELECT DISTINCT zone, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (SELECT zone, px AS x, py AS y FROM o UNION ALL SELECT zone, qx, qy FROM o)""")
def lattice_margin(spark, d):
    return G.margin_points(G.segments(lattice_vertices(lattice(spark, d))))


@query(f"""WITH {LATTICE_SQL}, s AS (SELECT a FROM edges UNION ALL SELECT b FROM edges), g AS (SELECT zone, count(s.a) AS degree FROM cells LEFT JOIN s ON s.a = zone GROUP BY 1)
SELECT degree, count(*) AS zones FROM g GROUP BY 1""")
def graph_degree(spark, d):
    zones = lattice(spark, d).select(F.col("zone").alias("a"))
    return G.degrees(zones, _edges(spark, d)).groupBy("degree").agg(F.count("*").alias("zones"))


@query("SELECT p_partkey AS zone, CAST(p_partkey % 40 + p_partkey // 40 AS INT) AS hops FROM part WHERE p_partkey % 40 + p_partkey // 40 <= 12")
def graph_hops(spark, d):
    """Steps from zone 0, at most 12, by frontiers."""
    return G.frontier_hops(_edges(spark, d), 0, 12)


@query(f"""WITH RECURSIVE {LATTICE_SQL}, {SIZES_SQL},
e AS (SELECT a, b FROM edges JOIN region x ON x.zone = a JOIN region y ON y.zone = b WHERE x.region = y.region),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk(zone, root) AS (SELECT zone, zone FROM cells UNION SELECT s.b, walk.root FROM walk JOIN s ON s.a = walk.zone WHERE walk.root < s.b)
SELECT zone, min(root) AS component FROM walk GROUP BY 1""")
def graph_components(spark, d):
    """Connected pieces of the two classes."""
    inside = G.with_regions(_edges(spark, d), _classes(spark, d)).filter("ra = rb")
    return G.components(lattice(spark, d).select("zone"), inside)


@query(f"""WITH {LATTICE_SQL}, c(a, b) AS (VALUES (0::BIGINT, 81::BIGINT), (5, 125)) SELECT a, b, 'boundary' AS kind FROM edges
UNION ALL SELECT a, b, 'crossing' FROM c WHERE (a, b) NOT IN (SELECT (a, b) FROM edges)""")
def crossing_edges(spark, d):
    """Edges and declared crossings, by name."""
    names = lattice(spark, d).select("zone", F.concat(F.lit("cell "), F.col("zone").cast("string")).alias("name"))
    declared = spark.createDataFrame([("cell 0", "cell 81"), ("cell 125", "cell 5")], "name_a string, name_b string")
    return G.crossing_edges(_edges(spark, d).select("a", "b"), declared, names)


@query(f"""WITH {LATTICE_SQL}, {SIZES_SQL} SELECT count(*) AS cut, count(*) FILTER (x.region = 1) AS from_first FROM edges JOIN region x ON x.zone = a JOIN region y ON y.zone = b WHERE x.region <> y.region""")
def cut_edges(spark, d):
    return G.cut_edges(_edges(spark, d), _classes(spark, d)).agg(F.count("*").alias("cut"), F.count_if(F.col("ra") == 1).alias("from_first"))


@query(f"""WITH {LATTICE_SQL}, c AS (SELECT x.p_brand AS ra, y.p_brand AS rb FROM edges JOIN cells x ON x.zone = a JOIN cells y ON y.zone = b WHERE x.p_brand <> y.p_brand)
SELECT region, count(*) AS cut FROM (SELECT ra AS region FROM c UNION ALL SELECT rb FROM c) GROUP BY 1""")
def cut_by_region(spark, d):
    return G.cut_by_region(_edges(spark, d), lattice(spark, d).select("zone", F.col("p_brand").alias("region")))


@query(f"""WITH {LATTICE_SQL}, {SIZES_SQL}, c AS (SELECT a, b FROM edges JOIN region x ON x.zone = a JOIN region y ON y.zone = b WHERE x.region <> y.region)
SELECT a AS zone FROM c UNION SELECT b FROM c""")
def region_frontier(spark, d):
    return G.frontier(_edges(spark, d), _classes(spark, d))


POINTS_SQL = "p AS (SELECT vec_id AS zone, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label, 1 + vec_id % 7 AS people FROM embeddings)"


def _points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("zone"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label", (1 + F.col("vec_id") % 7).alias("people"))


@query(f"WITH {POINTS_SQL} SELECT a.zone AS a, b.zone AS b, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 6) AS gap FROM p a JOIN p b ON a.zone < b.zone AND sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) <= 0.02")
def proximity_gap(spark, d):
    return G.proximity(_points(spark, d).select("zone", "x", "y"), 0.02).withColumn("gap", F.round("gap", 6))


def _ring_edges():
    return [(p, r, *a, *b) for p, r, pts in POLYGON for a, b in zip(pts, (*pts[1:], pts[0]), strict=True)]


@query(f"""WITH {POINTS_SQL}, e(part, ring, x1, y1, x2, y2) AS (VALUES {", ".join(f"({a}, {b}, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE)" for a, b, c, d, e, f in _ring_edges())}),
r AS (SELECT zone, part, ring, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS odd FROM p, e GROUP BY ALL),
q AS (SELECT zone, part, bool_or(odd AND ring = 0) AND NOT bool_or(odd AND ring > 0) AS inside FROM r GROUP BY ALL)
SELECT zone AS id, bool_or(inside) AS inside FROM q GROUP BY 1""")
def point_in_polygon(spark, d):
    edges = spark.createDataFrame(_ring_edges(), "part int, ring int, x1 double, y1 double, x2 double, y2 double")
    return G.contains(_points(spark, d).select(F.col("zone").alias("id"), "x", "y"), edges)


@query("SELECT * FROM (VALUES (0, round(0.1225 - 0.01, 6)::DOUBLE, round((0.1225 * -0.025) / 0.1125, 6)::DOUBLE, round((0.1225 * -0.025) / 0.1125, 6)::DOUBLE), (1, 0.014::DOUBLE, round(0.62 / 3, 6)::DOUBLE, 0::DOUBLE), (2, 0::DOUBLE, 1::DOUBLE, 1::DOUBLE)) t(zone, area, x, y)")
def ring_centroid(spark, d):
    """Centres of a square with a hole, of a triangle, and of a ring without area."""
    rings = [(p, 0, r, i, x, y) for p, r, pts in POLYGON for i, (x, y) in enumerate(pts)] + [(2, 0, 0, i, float(x), 1.0) for i, x in enumerate((0, 1, 2))]
    vertices = spark.createDataFrame([(a, b, c, i, float(x), float(y)) for a, b, c, i, x, y in rings], "zone int, part int, ring int, seq int, x double, y double")
    return G.ring_centroids(vertices).select("zone", *[F.round(c, 6).alias(c) for c in ("area", "x", "y")])


MOMENTS_SQL = f"""{POINTS_SQL}, s AS (SELECT label AS region, CAST(count(*) AS DOUBLE) AS area, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS sxx, count(*) / (2 * pi()) AS own,
  CAST(sum(people) AS DOUBLE) AS n, sum(people * x) AS px, sum(people * y) AS py, sum(people * (x * x + y * y)) AS pxx FROM p GROUP BY 1)"""


@query(f"""WITH {MOMENTS_SQL} SELECT region, round(2 * pi() * (sxx - (sx * sx + sy * sy) / area + own) / (area * area), 6) AS land, round(2 * pi() * (pxx - (px * px + py * py) / n) / (n * area), 6) AS people FROM s""")
def compactness(spark, d):
    """Second moments of regions of unit cells, of land and of people."""
    zones = _points(spark, d).select(F.col("label").alias("region"), "x", "y", F.lit(1.0).alias("area"), F.lit(1 / (2 * math.pi)).alias("own"), F.col("people").cast("double").alias("people"))
    sums = R.region_sums(zones)
    return sums.select("region", F.round(R.land(), 6).alias("land"), F.round(R.people(), 6).alias("people"))


ZONES_SQL = """z AS (SELECT c_custkey % 18 AS region, count(*) AS zones, CAST(sum(greatest(c_acctbal, 0)) AS DOUBLE) AS people, sum(greatest(c_acctbal, 0) * c_nationkey) / nullif(sum(greatest(c_acctbal, 0)), 0) AS value FROM customer GROUP BY 1),
t AS (SELECT sum(people) / 18 AS target FROM z)"""


def _regions(spark, d):
    """Customers in 18 regions, balances as people, nation keys as what they are like."""
    c = table(spark, d, "customer").select((F.col("c_custkey") % 18).alias("region"), F.greatest("c_acctbal", F.lit(0.0)).alias("people"), F.col("c_nationkey").cast("double").alias("v"))
    return c.groupBy("region").agg(F.count("*").alias("zones"), F.sum("people").alias("people"), F.try_divide(F.sum(F.col("people") * F.col("v")), F.sum("people")).alias("value"))


@query(f"WITH {ZONES_SQL} SELECT region, zones, round(people, 2) AS people, round((people - target) / target, 6) AS deviation, round(CASE WHEN people >= 0.2 * target THEN 0 ELSE 1 + pow(1 - people / (0.2 * target), 2) / (people / (0.2 * target)) END, 6) AS floor_cost FROM z, t")
def population_equality(spark, d):
    regions = _regions(spark, d)
    target = F.sum("people").over(W.partitionBy()) / 18
    return regions.withColumn("target", target).select("region", "zones", F.round("people", 2).alias("people"), F.round((F.col("people") - F.col("target")) / F.col("target"), 6).alias("deviation"), F.round(S.floor_cost(F.col("people"), F.col("target")), 6).alias("floor_cost"))


@query(f"""WITH {ZONES_SQL}, m AS (SELECT sum(people * value) / sum(people) AS mean FROM z),
x AS (SELECT sum(pow((people - target) / target, 2)) AS equality, sum(pow(value - mean, 2)) AS alike, max(abs(people - target) / target) AS worst,
  sum(CASE WHEN people >= 0.2 * target THEN 0 ELSE 1 + pow(1 - people / (0.2 * target), 2) / (people / (0.2 * target)) END) AS floors, stddev_pop(value) AS spread FROM z, t, m)
SELECT round(equality, 6) AS equality, round(alike, 6) AS alike, round(worst, 6) AS worst, round(spread, 6) AS spread, round((2 * equality + 1 * alike / 0.5) / 3 + 300000 * floors, 6) AS score FROM x""")
def region_score(spark, d):
    """Weighted terms of an assignment, over the sum of weights, and the floor's price beside them."""
    sums = _regions(spark, d).withColumns({"target": F.sum("people").over(W.partitionBy()) / 18, "mean": F.sum(F.col("people") * F.col("value")).over(W.partitionBy()) / F.sum("people").over(W.partitionBy())})
    return R.score(sums, {"equality": (2.0, 1.0), "alike": (1.0, 0.5)})


#: Cells by brand: people, a value that is like their size, and three parties by key; sizes of a typical move from zone to zone.
BRANDS = 25
MAP_SQL = f"""{LATTICE_SQL}, zones AS (SELECT zone, p_brand AS region, x, y, 1 + p_size % 7 AS people, p_size / 50 AS value, zone % 3 AS party FROM cells),
v AS (SELECT region, party, CAST(sum(people) AS DOUBLE) AS votes FROM zones GROUP BY ALL),
m AS (SELECT region, party, votes, (votes - coalesce((SELECT max(o.votes) FROM v o WHERE o.region = v.region AND o.party <> v.party), 0)) / sum(votes) OVER (PARTITION BY region) AS margin FROM v),
c AS (SELECT p.region AS ra, q.region AS rb FROM edges JOIN zones p ON p.zone = a JOIN zones q ON q.zone = b WHERE p.region <> q.region),
k AS (SELECT region, count(*) AS cut FROM (SELECT ra AS region FROM c UNION ALL SELECT rb FROM c) GROUP BY 1),
s AS (SELECT region, count(*) AS zones, CAST(sum(people) AS DOUBLE) AS people, CAST(count(*) AS DOUBLE) AS area, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS sxx, count(*) / (2 * pi()) AS own,
  sum(people * x) AS px, sum(people * y) AS py, sum(people * (x * x + y * y)) AS pxx, sum(value * people) / sum(people) AS value FROM zones GROUP BY 1),
w AS (SELECT CAST(sum(people) AS DOUBLE) / {BRANDS} AS target, sum(value * people) / sum(people) AS mean FROM zones),
r AS (SELECT s.region, zones, people, target, mean, (people - target) / target AS deviation, 2 * pi() * (sxx - (sx * sx + sy * sy) / area + own) / (area * area) AS land,
  2 * pi() * (pxx - (px * px + py * py) / people) / (people * area) AS people_land, value, coalesce(cut, 0) AS cut FROM s JOIN w ON true LEFT JOIN k USING (region))"""


def _map(spark, d):
    """(zones, edges, votes) of the lattice, regions being brands."""
    cells = lattice(spark, d)
    zones = cells.select(
        "zone", F.col("p_brand").alias("region"), "x", "y", F.lit(1.0).alias("area"), F.lit(1 / (2 * math.pi)).alias("own"), (1 + F.col("p_size") % 7).cast("double").alias("people"),
        (F.col("p_size") / 50).alias("value"), (1 + F.col("p_size") % 7).cast("double").alias("n"), (F.col("zone") % 3).alias("party"),
    )
    return zones, _edges(spark, d), zones.groupBy("region", "party").agg(F.sum("people").alias("votes"))


@query(f"""WITH {MAP_SQL}, f AS (SELECT region, party AS winner, margin FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY margin DESC, party) AS i FROM m) WHERE i = 1)
SELECT region, zones, people, round(deviation, 6) AS deviation, round(land, 6) AS land, round(people_land, 6) AS people_land, round(value, 6) AS value, cut, winner, round(margin, 6) AS margin FROM r JOIN f USING (region)""")
def region_summary(spark, d):
    """All readouts of a map's regions."""
    found = R.summary(*_map(spark, d), BRANDS)
    rounded = [F.round(c, 6).alias(c) for c in ("deviation", "land", "people_land", "value", "margin")]
    return found.select("region", "zones", "people", "cut", "winner", *rounded)


@query(f"""WITH {MAP_SQL}, g AS (SELECT count(*) AS n, CAST(sum(people * people) AS DOUBLE) / count(*) AS people_sigma FROM zones),
e AS (SELECT 2.0 * count(*) / (SELECT n FROM g) / 24 AS cut_sigma FROM edges),
x AS (SELECT sum(pow(people - target, 2)) / any_value(people_sigma) AS people, sum(land - 1) / (25.0 / any_value(n)) AS shape, sum(people_land - 1) / (25.0 / any_value(n)) AS people_shape, sum(cut) / 2 / any_value(cut_sigma) AS cut,
  sum(pow(value - mean, 2)) / (2 * 0.05 * 0.3 * 25 / any_value(n)) AS average, sum(1 / (1 + exp((coalesce(m.margin, 0) - 0) * 50))) / (0.05 * 25 / any_value(n) * 50 / 4) AS margin, max(abs(deviation)) AS worst, stddev_pop(value) AS spread,
  sum(CASE WHEN people >= 0.2 * target THEN 0 ELSE 1 + pow(1 - people / (0.2 * target), 2) / (people / (0.2 * target)) END) AS floors FROM r JOIN g ON true JOIN e ON true LEFT JOIN m ON m.region = r.region AND m.party = 0)
SELECT round(people, 6) AS people, round(shape, 6) AS shape, round(people_shape, 6) AS people_shape, round(cut, 6) AS cut, round(average, 6) AS average, round(margin, 6) AS margin, round(worst, 6) AS worst, round(spread, 6) AS spread,
  round((people + 0.5 * shape + 0.5 * people_shape + cut + 2 * average + margin) / 6 + 300000 * floors, 5) AS score FROM x""")
def map_score(spark, d):
    """All terms of the score of a map: people, both shapes, cut, a demographic near its mean, a party's margin in the regions, and floors."""
    zones, edges, votes = _map(spark, d)
    one = zones.agg(F.count("*").alias("n"), F.avg(F.col("people") * F.col("people")).alias("people")).first()
    n, step = one["n"], BRANDS / max(1, one["n"])
    sigmas = {"people": one["people"] or 1.0, "shape": step, "people_shape": step, "cut": 2.0 * edges.count() / max(1, n) / 24, "average": 2 * 0.05 * 0.3 * step, "margin": 0.05 * step * 50 / 4}
    weights = {"people": 1.0, "shape": 0.5, "people_shape": 0.5, "cut": 1.0, "average": 2.0, "margin": 1.0}
    return R.terms(R.summary(zones, edges, votes, BRANDS), R.margins(votes).filter("party = 0"), sigmas, weights, 0.0, 50.0)


@query(f"""WITH {ZONES_SQL}, m AS (SELECT sum(people * value) / sum(people) AS mean FROM z)
SELECT region, round(pow(value - mean, 2), 6) AS average, round(-pow(least(abs(value - mean), 0.4), 2), 6) AS extreme, round(1 / (1 + exp((value - 12) * 3)), 6) AS gerrymander, value >= 12 AS won FROM z, m""")
def demographic_terms(spark, d):
    every = W.partitionBy()
    sums = _regions(spark, d).withColumn("mean", F.sum(F.col("people") * F.col("value")).over(every) / F.sum("people").over(every))
    v, m = F.col("value"), F.col("mean")
    return sums.select(
        "region", F.round(S.term("average", v, m), 6).alias("average"), F.round(S.term("extreme", v, m, cap=0.4), 6).alias("extreme"),
        F.round(S.term("gerrymander", v, m, threshold=12.0, steepness=3.0), 6).alias("gerrymander"), (v >= 12).alias("won"),
    )


@query("SELECT CAST(n AS BIGINT) AS n, round(exp(ln(0.55) + greatest(0, least(1, (ln(1400000 / n) - ln(17254)) / (ln(76318) - ln(17254)))) * (ln(0.62) - ln(0.55))), 6) AS level FROM range(1, 501) t(n)")
def turnout_level_curve(spark, d):
    """Turnout by number of regions, between the measured anchors."""
    return spark.range(1, 501).select(F.col("id").alias("n"), F.round(S.turnout_level(F.lit(1_400_000.0) / F.col("id"), (17254.0, 0.55), (76318.0, 0.62)), 6).alias("level"))
