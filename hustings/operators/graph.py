"""Exact topology of zones, and queries on their graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import segment_metres

#: Declared names are a list written by hand.
MOST_DECLARED = 10_000
#: Strips into which a polygon's height is cut.
STRIPS = 256
#: Rows of a frontier that are sent to the edges.
MOST_SENT = 10_000


def segments(vertices: DataFrame) -> DataFrame:
    """Rings as vertices (zone, part, ring, seq, x, y) -> zone and its undirected segments (p, q), lesser end first.

    Open rings are closed; segments without length are dropped.
    """
    ring = W.partitionBy("zone", "part", "ring").orderBy("seq")
    whole = W.partitionBy("zone", "part", "ring").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = F.struct(F.col("x"), F.col("y"))
    after = F.coalesce(F.lead(at).over(ring), F.first(at).over(whole))
    ends = vertices.select("zone", at.alias("a"), after.alias("b")).filter("a <> b")
    return ends.select("zone", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()


def shared_boundaries(found: DataFrame, least: float = 0.01, metres: bool = True) -> DataFrame:
    """Pairs of zones with a segment in common, and its length; slivers under `least` are left out.

    Segments are grouped, and pairs made within a segment's owners: two as a rule, so nothing grows by squares.
    """
    owners = found.groupBy("p", "q").agg(F.sort_array(F.collect_set("zone")).alias("zones")).filter(F.size("zones") > 1)
    pairs = owners.select("p", "q", F.posexplode("zones").alias("i", "a"), "zones").select("p", "q", "a", F.explode(F.slice("zones", F.col("i") + 2, F.size("zones"))).alias("b"))
    length = segment_metres(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y")) if metres else F.hypot(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y"))
    return pairs.groupBy("a", "b").agg(F.sum(length).alias("shared")).filter(F.col("shared") >= least)


def point_touches(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that share a vertex and no boundary, with the least such point."""
    ends = found.select("zone", F.explode(F.array("p", "q")).alias("at")).distinct()
    owners = ends.groupBy("at").agg(F.sort_array(F.collect_set("zone")).alias("zones")).filter(F.size("zones") > 1)
    pairs = owners.select("at", F.posexplode("zones").alias("i", "a"), "zones").select("at", "a", F.explode(F.slice("zones", F.col("i") + 2, F.size("zones"))).alias("b"))
    return pairs.join(edges.select("a", "b"), ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min("at").alias("at"))


def margin_points(found: DataFrame) -> DataFrame:
    """Ends of the segments that one zone alone has."""
    alone = found.groupBy("p", "q").agg(F.count("*").alias("n"), F.min("zone").alias("zone")).filter("n = 1")
    return alone.select("zone", F.explode(F.array("p", "q")).alias("at")).distinct().select("zone", "at.x", "at.y")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(zones: DataFrame, edges: DataFrame) -> DataFrame:
    """zones (a) -> degree, 0 for those without edges."""
    return zones.join(both_ways(edges).groupBy("a").agg(F.count("*").alias("degree")), "a", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def frontier_hops(edges: DataFrame, start: int, cap: int) -> DataFrame:
    """The same by frontiers: the edges are made once, each round joins only the zones it reached, and cuts its lineage. Steps go both ways, so
    what a round reaches anew is what the last two rounds don't have."""
    spark = edges.sparkSession
    around = _cut(both_ways(edges))
    before, frontier = None, _cut(spark.createDataFrame([(start, 0)], "zone long, hops int"))
    rounds, n = [frontier], 1
    for step in range(1, cap + 1):
        near = around.join(_small(frontier.select(F.col("zone").alias("a")), n), "a", "left_semi").select(F.col("b").alias("zone")).distinct()
        for old in (before, frontier):
            if old is not None:
                near = near.join(_small(old.select("zone"), n), "zone", "left_anti")
        before, frontier = frontier, _cut(near.withColumn("hops", F.lit(step)))
        counted, found = n, frontier.count()
        if not found:
            break
        rounds.append(frontier)
        n = max(found, counted)
    return reduce(DataFrame.unionByName, rounds)


def _small(df: DataFrame, n: int) -> DataFrame:
    """A table of n rows at most, as counted: few are sent to the other side, which stays where it is; else both are sorted. Spark's own guess doesn't count
    the rows that explode adds, so it would gather millions of them on the driver as a small table."""
    return F.broadcast(df) if n <= MOST_SENT else df.hint("merge")


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and not context.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(given or "/tmp/checkpoints")
    return df.checkpoint()


def components(zones: DataFrame, edges: DataFrame) -> DataFrame:
    """zones (zone) -> zone, component: the least zone it is connected with. Alone counts.

    Stars are pulled together until they stand still, in about log(zones) rounds; each round's edges are no more than
    the last one's.
    """
    now, mark = _cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = _cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == mark:
            break
        mark = seen
    return zones.join(now.withColumnsRenamed({"u": "zone", "v": "component"}), "zone", "left").withColumn("component", F.coalesce("component", "zone"))


def resolved(wanted: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """wanted with the zone of its `name`; a name that no zone or more than one has is refused. `wanted` is a literal list, checked to be short."""
    if wanted.limit(MOST_DECLARED + 1).count() > MOST_DECLARED:
        raise ValueError(f"more than {MOST_DECLARED} names")
    found = names.select(F.col("name").alias(name), "zone").join(F.broadcast(wanted.select(name).distinct()), name).groupBy(name).agg(F.min("zone").alias("zone"), F.count("*").alias("zones"))
    joined = _cut(wanted.join(found, name, "left"))
    if bad := joined.filter("zones is null or zones > 1").select(name).first():
        raise ValueError(f"{bad[0]!r} isn't the name of one zone")
    return joined.drop("zones")


def crossing_edges(edges: DataFrame, declared: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with declared crossings (name_a, name_b) added. Unknown and ambiguous names are refused, and pairs that share a boundary already."""
    both = resolved(resolved(declared, names, "name_a").withColumnRenamed("zone", "za"), names, "name_b")
    fresh = both.select(F.least("za", "zone").alias("a"), F.greatest("za", "zone").alias("b"))
    if bad := edges.select("a", "b").join(F.broadcast(fresh), ["a", "b"]).first():
        raise ValueError(f"zones {bad['a']} and {bad['b']} share a boundary already")
    return edges.withColumn("kind", F.lit("boundary")).unionByName(fresh.withColumn("kind", F.lit("crossing")), allowMissingColumns=True)


def with_regions(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """edges with the regions of both ends, ra and rb."""
    a = assignment.select(F.col("zone").alias("a"), F.col("region").alias("ra"))
    b = assignment.select(F.col("zone").alias("b"), F.col("region").alias("rb"))
    return edges.join(a, "a").join(b, "b")


def cut_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    return with_regions(edges, assignment).filter("ra <> rb")


def cut_by_region(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges that leave each region; both ends count, so they sum to twice the cut edges."""
    return cut_edges(edges, assignment).select(F.explode(F.array("ra", "rb")).alias("region")).groupBy("region").agg(F.count("*").alias("cut"))


def frontier(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Zones with a neighbour in another region."""
    return cut_edges(edges, assignment).select(F.explode(F.array("a", "b")).alias("zone")).distinct()


def proximity(points: DataFrame, radius: float, middle: bool = False) -> DataFrame:
    """points (zone, x, y) -> pairs within `radius`, and the least distance: cells of that width, each
    point in its own, its neighbours' points looked up in the nine around. With `middle`, also where the middle of the closest points lies."""
    cells = points.withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = cells.select(F.col("zone").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(steps).alias("s"), "cx", "cy").select("b", "bx", "by", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    gap = F.sqrt(F.pow(F.col("bx") - F.col("x"), 2) + F.pow(F.col("by") - F.col("y"), 2))
    near = cells.withColumnRenamed("zone", "a").join(spread.hint("merge"), ["cx", "cy"]).filter("a < b").withColumn("gap", gap).filter(F.col("gap") <= radius)
    if middle:
        best = near.groupBy("a", "b").agg(F.min(F.struct("gap", ((F.col("x") + F.col("bx")) / 2).alias("mx"), ((F.col("y") + F.col("by")) / 2).alias("my"))).alias("m"))
        return best.select("a", "b", "m.gap", "m.mx", "m.my")
    return near.groupBy("a", "b").agg(F.min("gap").alias("gap"))


def contains(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points (id, x, y) inside polygons given as ring edges (part, ring, x1, y1, x2, y2), ring 0 the outer one.

    Crossings of a ray are counted by ring: odd within the outer ring, even within each hole. The height is cut into strips; an
    edge goes to the strips that it passes, so a point meets the edges at its own height only, by an equi-join. There are STRIPS, or as many
    as edges if these are more; strips are no lower than the edges' mean height, so that an edge passes two or three in the mean.
    """
    bounds = edges.agg(
        F.min(F.least("y1", "y2")).alias("low"), F.max(F.greatest("y1", "y2")).alias("high"), F.count("*").alias("n"), F.avg(F.abs(F.col("y2") - F.col("y1"))).alias("mean")
    ).first()
    low, high = bounds["low"] or 0.0, bounds["high"] or 0.0
    width = (high - low) / STRIPS or 1.0
    if bounds["n"] > STRIPS:
        width = min(width, max(bounds["mean"], (high - low) / bounds["n"])) or 1.0
    strip = lambda y: F.floor((y - low) / width)
    passed = edges.filter("y1 <> y2").withColumn("strip", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))))
    hit = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    inner = points.filter(F.col("y").between(low, high)).withColumn("strip", strip(F.col("y")))
    odd = inner.join(_small(passed, bounds["n"]), "strip").filter(hit).groupBy("id", "part", "ring").agg((F.count("*") % 2 == 1).alias("odd")).filter("odd")
    parts = odd.groupBy("id", "part").agg((F.bool_or(F.col("ring") == 0) & ~F.bool_or(F.col("ring") > 0)).alias("inside"))
    found = parts.groupBy("id").agg(F.bool_or("inside").alias("inside"))
    return points.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("inside", F.lit(False)).alias("inside"))


def ring_centroids(vertices: DataFrame) -> DataFrame:
    """Area-weighted centre of each zone's rings, holes taken off; the mean of the outer vertices without area."""
    ring = W.partitionBy("zone", "part", "ring").orderBy("seq")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x2, y2 = (F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in ("x", "y"))
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sums = vertices.withColumns({"x2": x2, "y2": y2}).withColumn("cross", cross).groupBy("zone", "part", "ring").agg(
        F.sum("cross").alias("twice"), F.sum((F.col("x") + F.col("x2")) * F.col("cross")).alias("cx"), F.sum((F.col("y") + F.col("y2")) * F.col("cross")).alias("cy"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"),
    )
    area = F.abs(F.col("twice") / 2) * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    weighed = sums.withColumns({"area": area, "gx": F.try_divide("cx", 3 * F.col("twice")), "gy": F.try_divide("cy", 3 * F.col("twice"))})
    outer = F.col("ring") == 0
    return weighed.groupBy("zone").agg(F.sum("area").alias("area"), *[
        F.coalesce(F.try_divide(F.sum(F.col("area") * F.col(g)), F.sum("area")), F.avg(F.when(outer, F.col(m)))).alias(n) for g, m, n in (("gx", "mx", "x"), ("gy", "my", "y"))
    ])
