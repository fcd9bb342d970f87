"""Tables that models are fitted on: shares of zones, regions' designs, observations of elections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share_table(cells: DataFrame, shares: Mapping[str, tuple[Sequence[str], Sequence[str] | None]]) -> DataFrame:
    """cells (zone, code, value) -> a column for each share: the sum of its codes over that of its base's codes (all codes if none
    are given), null without a base. One aggregation for all columns."""
    amount = lambda codes: F.sum(F.when(F.col("code").isin(list(codes)), F.col("value")).otherwise(0.0)) if codes is not None else F.sum("value")
    return cells.groupBy("zone").agg(*[F.try_divide(amount(codes), F.nullif(amount(base), F.lit(0.0))).alias(name) for name, (codes, base) in shares.items()])


def from_parents(children: DataFrame, parents: DataFrame, names: Sequence[str]) -> DataFrame:
    """children (zone, parent, pool, base) and parents (parent, names...) -> zone and each name's parent amount, dealt to zones by
    their share of the parent's pool, over the zone's base. A parent without a pool deals nothing."""
    part = F.coalesce(F.try_divide("pool", F.nullif(F.sum("pool").over(W.partitionBy("parent")), F.lit(0.0))), F.lit(0.0))
    dealt = children.withColumn("part", part).join(parents, "parent")
    return dealt.select("zone", *[F.try_divide(F.col(n) * F.col("part"), F.nullif(F.col("base"), F.lit(0.0))).alias(n) for n in names])


def lapsed(then: Column, now: Column) -> Column:
    """What a share has lost since; negative if it grew."""
    return then - now


def to_areas(zones: DataFrame, membership: DataFrame, weight: str, names: Sequence[str]) -> DataFrame:
    """Means of zones by area, weighted within the area: area, `weight` (its sum) and the names."""
    means = [F.try_divide(F.sum(F.col(weight) * F.col(n)), F.nullif(F.sum(F.when(F.col(n).isNotNull(), F.col(weight))), F.lit(0.0))).alias(n) for n in names]
    return zones.join(membership.select("zone", "area"), "zone").groupBy("area").agg(F.sum(weight).alias(weight), *means)


def layers(memberships: Mapping[str, DataFrame]) -> DataFrame:
    """(layer, zone, area): each zone's area in every layer of elections; a zone in two areas of one layer is refused."""
    every = reduce(DataFrame.unionByName, (m.select(F.lit(name).alias("layer"), "zone", "area") for name, m in memberships.items()))
    seen = F.count("*").over(W.partitionBy("layer", "zone"))
    fault = F.raise_error(F.concat_ws(" ", F.lit("in two areas of"), "layer", F.lit(": zone"), F.col("zone").cast("string")))
    return every.withColumn("_n", seen).withColumn("area", F.when(F.col("_n") == 1, F.col("area")).otherwise(fault.cast(every.schema["area"].dataType))).drop("_n")


def design(zones: DataFrame, every: DataFrame, results: DataFrame, names: Sequence[str]) -> DataFrame:
    """zones (zone, electorate, names...), layers (layer, zone, area), results (layer, area, electorate, votes) -> by layer and area: means
    weighted by electors, y (log turnout) and w (its electorate). Areas without electors or zones are left out."""
    by = ["layer", "area"]
    means = [(F.sum(F.col("electorate") * F.col(n)) / F.sum("electorate")).alias(n) for n in names]
    known = every.join(zones, "zone").groupBy(*by).agg(*means)
    seen = results.filter("electorate > 0 and votes > 0").select(*by, F.log(F.col("votes") / F.col("electorate")).alias("y"), F.col("electorate").cast("double").alias("w"))
    return known.join(seen, by)


def observations(zones: DataFrame, every: DataFrame, results: DataFrame, turnout: Mapping[str, float], parties: Sequence[str]) -> DataFrame:
    """zones (zone, voters, a share for each party), layers, results (layer, area, party, first_prefs) -> layer, area, party, share, votes, stood: what a
    party would have in an area, and whether it stood there. Only areas with results."""
    sums = every.join(zones, "zone").groupBy("layer", "area").agg(F.sum("voters").alias("voters"), *[F.sum(F.col("voters") * F.col(f"`{p}`")).alias(p) for p in parties])
    level = F.create_map(*[F.lit(x) for pair in turnout.items() for x in pair])
    long = sums.unpivot(["layer", "area", "voters"], list(parties), "party", "mass").select("layer", "area", "party", F.try_divide("mass", "voters").alias("share"), (F.col("mass") * F.try_element_at(level, F.col("layer"))).alias("votes"))
    ran = results.groupBy("layer", "area", "party").agg((F.sum("first_prefs") > 0).alias("stood"))
    return long.join(results.select("layer", "area").distinct(), ["layer", "area"], "left_semi").join(ran, ["layer", "area", "party"], "left").withColumn("stood", F.coalesce("stood", F.lit(False)))


def aligned(features: DataFrame, register: DataFrame, electorate: DataFrame, areas: DataFrame, turnout: DataFrame | None = None) -> DataFrame:
    """All that a fit needs of a zone, by zone: features, register (area, shares...), electorate, area, and turnout (index 1.0 where there is
    none). A zone that one of them lacks is a failure, not a row less."""
    index = turnout.select("zone", F.col("index").cast("double").alias("turnout")) if turnout is not None else None
    joined = features.join(areas.select("zone", "area"), "zone", "left").join(electorate.select("zone", F.col("electorate").cast("double").alias("electorate")), "zone", "left").join(register, "area", "left")
    joined = joined.join(index, "zone", "left") if index is not None else joined.withColumn("turnout", F.lit(1.0))
    lacking = F.when(F.col("area").isNull(), "area").when(F.col("electorate").isNull(), "electorate").when(F.col(next(c for c in register.columns if c != "area")).isNull(), "register")
    fault = F.raise_error(F.concat_ws(" ", F.lit("no"), lacking, F.lit("for zone"), F.col("zone").cast("string"))).cast("double")
    return joined.withColumns({"turnout": F.coalesce("turnout", F.lit(1.0)), "electorate": F.when(lacking.isNull(), F.col("electorate")).otherwise(fault)})


def joined_attributes(geometry: DataFrame, attributes: DataFrame, key: str, types: Mapping[str, str]) -> DataFrame:
    """Geometry with attributes by key, typed; a zone without attributes has nulls."""
    return geometry.join(attributes.select(key, *[F.col(c).cast(t).alias(c) for c, t in types.items()]), key, "left")


def complete(zones: DataFrame, terms: Mapping[str, tuple[str, str]]) -> list[str]:
    """The terms (name -> value and count columns) that every zone has both numbers for: others can't be steered."""
    found = zones.agg(*[F.coalesce(F.bool_and(F.col(v).isNotNull() & F.col(n).isNotNull() & ~F.isnan(F.col(v).cast("double"))), F.lit(False)).alias(name) for name, (v, n) in terms.items()]).first()
    return [name for name in terms if found[name]]


def zone_voters(zones: DataFrame) -> DataFrame:
    """zones (zone, e, t, s) -> zone, votes (electors times turnout, 1 where unknown) and shares that sum to 1, as they are if they sum to nothing."""
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return zones.select("zone", (F.col("e") * F.coalesce("t", F.lit(1.0))).alias("votes"), F.when(total > 0, F.transform("s", lambda x: x / total)).otherwise(F.col("s")).alias("shares"))
