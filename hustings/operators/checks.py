"""Checks of a zone graph and of its map, and the audit of gaps between zones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import segment_metres
from .graph import _cut, both_ways, components, contains, degrees, margin_points, proximity, shared_boundaries


def _counted(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("faults")).select(F.lit(name).alias("check"), "faults")


def graph_faults(zones: DataFrame, edges: DataFrame, touches: DataFrame, least: float = 0.01) -> DataFrame:
    """zones (zone), edges (a, b, kind, shared, gap), touches (a, b) -> check, faults: what a neighbour graph must not have."""
    codes = zones.select("zone")
    ends = both_ways(edges).select(F.col("a").alias("zone")).distinct()
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    touching = touches.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    known = edges.join(codes.withColumnRenamed("zone", "a"), "a", "left_semi").join(codes.withColumnRenamed("zone", "b"), "b", "left_semi").filter("a <> b")
    pieces = components(codes, known.select("a", "b")).select("component").distinct()
    tests = {
        "zone twice": codes.groupBy("zone").count().filter("count > 1"),
        "unknown zone": ends.join(codes, "zone", "left_anti"),
        "loop": edges.filter("a = b"),
        "edge twice": pair.groupBy("a", "b").count().filter("count > 1"),
        "thin boundary": edges.filter((F.col("kind") == "boundary") & (F.coalesce("shared", F.lit(0.0)) < least)),
        "crossing without gap": edges.filter((F.col("kind") == "crossing") & (F.col("gap").isNull() | (F.coalesce("shared", F.lit(0.0)) != 0))),
        "alone": codes.join(ends, "zone", "left_anti"),
        "edge and touch": pair.intersect(touching),
        "further pieces": pieces.orderBy("component").offset(1),
    }
    return reduce(DataFrame.unionByName, (_counted(name, bad) for name, bad in tests.items()))


def border_changes(full: DataFrame, simple: DataFrame, touches: DataFrame) -> DataFrame:
    """Pairs (a, b) of two versions of the edges: those lost, those gained, and those gained that didn't touch before: change, a, b."""
    lost, gained = full.select("a", "b").exceptAll(simple.select("a", "b")), simple.select("a", "b").exceptAll(full.select("a", "b"))
    strange = gained.join(touches.select("a", "b"), ["a", "b"], "left_anti")
    return reduce(DataFrame.unionByName, (rows.select(F.lit(name).alias("change"), "a", "b") for name, rows in (("lost", lost), ("gained", gained), ("not a touch", strange))))


def map_faults(zones: DataFrame, totals: dict[str, float], ranges: dict[str, tuple[float, float]], codes: DataFrame) -> DataFrame:
    """zones (zone, columns) -> check, faults, by one aggregation and one join with the codes wanted: zones twice, nulls and values out of range by
    column, totals that differ, and codes on one side only."""
    checks = [(F.count("*") - F.count_distinct("zone")).cast("long").alias("zone twice")]
    checks += [F.count_if(F.col(c).isNull()).alias(f"{c} null") for c in ranges]
    checks += [F.count_if(~F.col(c).between(*r)).alias(f"{c} out of range") for c, r in ranges.items()]
    checks += [(F.abs(F.sum(c) - total) > 1e-6 * abs(total)).cast("long").alias(f"{c} total") for c, total in totals.items()]
    row = zones.agg(*checks)
    sides = zones.select("zone", F.lit(1).alias("_have")).join(codes.select("zone", F.lit(1).alias("_want")), "zone", "full_outer").filter("_have is null or _want is null")
    return row.unpivot([], row.columns, "check", "faults").unionByName(_counted("codes differ", sides))


def least_gaps(pairs: DataFrame, corners: DataFrame) -> DataFrame:
    """Declared pairs (a, b) of zones and vertices (zone, x, y) in degrees -> the pair's closest vertices and their distance in metres, at
    their own latitude. Vertices are compared within a declared pair only."""
    points = corners.select("zone", "x", "y").distinct()
    left = pairs.join(points.selectExpr("zone as a", "x as ax", "y as ay"), "a")
    both = left.join(points.selectExpr("zone as b", "x as bx", "y as by"), "b")
    # The closest by the scale of the pair's own middle latitude; measured again between the two.
    middle = both.withColumn("scale", F.cos(F.radians(F.avg((F.col("ay") + F.col("by")) / 2).over(W.partitionBy("a", "b")))))
    apart = F.pow((F.col("ax") - F.col("bx")) * F.col("scale"), 2) + F.pow(F.col("ay") - F.col("by"), 2)
    best = middle.groupBy("a", "b").agg(F.min(F.struct(apart.alias("d"), "ax", "ay", "bx", "by")).alias("m"))
    return best.select("a", "b", segment_metres(F.col("m.ax"), F.col("m.ay"), F.col("m.bx"), F.col("m.by")).alias("gap"))


def pair_hops(edges: DataFrame, pairs: DataFrame, cap: int = 40) -> DataFrame:
    """Steps over edges between the zones of each pair, null if more than `cap`. All pairs are walked at once from both ends, by frontiers of
    (pair, zone), in turn: a pair has met when its frontiers share a zone, and then leaves. The edges are made once, each round cuts its lineage, and as
    steps go both ways a round's zones are new if the last two of its side don't have them."""
    around = _cut(both_ways(edges).select(F.col("a").alias("zone"), F.col("b").alias("next")))
    open_pairs = _cut(pairs.select("a", "b").distinct())
    key = ["a", "b", "zone"]
    fronts = [open_pairs.filter("a <> b").select("a", "b", F.col(end).alias("zone")) for end in ("a", "b")]
    lasts: list[DataFrame | None] = [None, None]
    found = open_pairs.filter("false").select("a", "b", F.lit(0).alias("hops"))
    for step in range(1, cap + 1):
        side = (step - 1) % 2
        front, last = fronts[side], lasts[side]
        near = front.join(around.hint("merge"), "zone").select("a", "b", F.col("next").alias("zone")).distinct()
        for old in (front, last):
            if old is not None:
                near = near.join(old, key, "left_anti")
        near = _cut(near)
        met = _cut(near.join(fronts[1 - side], key, "left_semi").select("a", "b").distinct().withColumn("hops", F.lit(step)))
        found = found.unionByName(met)
        lasts[side], fronts = front, [f.join(met, ["a", "b"], "left_anti") for f in ((near, fronts[1]) if side == 0 else (fronts[0], near))]
        if fronts[side].isEmpty():
            break
    return open_pairs.join(found, ["a", "b"], "left")


def gap_audit(segments: DataFrame, rings: DataFrame, declared: DataFrame, radius: float, least: float = 0.01, metres: bool = True, cap: int = 40, near: int = 4) -> DataFrame:
    """Which zones lie close to each other without a boundary, over water rather than land: a, b, gap, hops, declared, suspicious.

    segments of zones (zone, p, q), ring edges (part, ring, x1, y1, x2, y2) of all of them, declared crossings (a, b). Points of the
    margin meet by proximity; a gap whose middle lies in a zone is land; the others are ranked, unreachable ones first, then by hops
    over land and gap. Suspicious is what is `near` steps apart or more, or unreachable, and not declared.
    """
    shared = _cut(shared_boundaries(segments, least, metres).select("a", "b"))
    close = _cut(proximity(_cut(margin_points(segments)), radius, middle=True).join(shared.hint("merge"), ["a", "b"], "left_anti").withColumn("id", F.xxhash64("a", "b")))
    land = contains(close.select("id", F.col("mx").alias("x"), F.col("my").alias("y")), rings).filter("inside").select("id")
    water = _cut(close.join(land, "id", "left_anti").select("a", "b", "gap"))
    walked = water.join(pair_hops(shared, water, cap), ["a", "b"]).join(declared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("declared")), ["a", "b"], "left")
    known = walked.withColumn("declared", F.coalesce("declared", F.lit(False)))
    return known.withColumn("suspicious", (F.col("hops").isNull() | (F.col("hops") >= near)) & ~F.col("declared")).orderBy(F.col("hops").isNotNull(), "hops", "gap", "a", "b")


def few_neighbours(zones: DataFrame, edges: DataFrame, most: int = 1) -> DataFrame:
    """Zones with `most` neighbours or fewer, the fewest first."""
    return degrees(zones.select(F.col("zone").alias("a")), edges).filter(F.col("degree") <= most).orderBy("degree", "a")


def degree_report(zones: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: least, mean and most neighbours, and zones without any."""
    return degrees(zones.select(F.col("zone").alias("a")), edges).agg(F.min("degree").alias("least"), F.round(F.avg("degree"), 6).alias("mean"), F.max("degree").alias("most"), F.count_if(F.col("degree") == 0).alias("alone"))
