"""The score of an assignment: one aggregation by region, and one over the regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores as S
from .graph import cut_by_region


def region_sums(zones: DataFrame) -> DataFrame:
    """zones (region, x, y, area, own, people) -> all sums by region that the penalties need, in one shuffle."""
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    weighted = {"s": "area", "p": "people"}
    moments = [F.sum(F.col(w) * v).alias(f"{k}{n}") for k, w in weighted.items() for n, v in (("x", F.col("x")), ("y", F.col("y")), ("xx", r2))]
    return zones.groupBy("region").agg(F.count("*").alias("zones"), F.sum("area").alias("area"), F.sum("people").alias("people"), F.sum("own").alias("own"), *moments)


def land() -> Column:
    return S.land_penalty(*map(F.col, ("area", "sx", "sy", "sxx", "own")))


def people() -> Column:
    return S.people_penalty(*map(F.col, ("people", "px", "py", "pxx", "area")))


def margins(votes: DataFrame) -> DataFrame:
    """votes (region, party, votes) -> region, party, share, margin over the best other party as a share of all; 0 without votes."""
    by_region = W.partitionBy("region")
    ranked = votes.withColumns({
        "total": F.sum("votes").over(by_region), "rank": F.row_number().over(by_region.orderBy(F.desc("votes"), "party")), "best": F.max("votes").over(by_region),
        "second": F.coalesce(F.nth_value("votes", 2).over(by_region.orderBy(F.desc("votes"), "party").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0.0)),
    })
    rival = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("best"))
    share = lambda x: F.coalesce(F.try_divide(x, F.nullif(F.col("total"), F.lit(0.0))), F.lit(0.0))
    return ranked.select("region", "party", "votes", share(F.col("votes")).alias("share"), share(F.col("votes") - rival).alias("margin"))


def summary(zones: DataFrame, edges: DataFrame, votes: DataFrame, n: int) -> DataFrame:
    """zones (zone, region, x, y, area, own, people, value, n), edges (a, b), votes (region, party, votes) -> a row for each region:
    people, zones, deviation, both penalties, its demographic value (the mean of all where nobody counts), edges it shares, and its winner.

    One aggregation by region, one by (region, party), one join of edges with regions; all else is over the regions.
    """
    sums = region_sums(zones).join(zones.groupBy("region").agg(F.sum(F.col("value") * F.col("n")).alias("vs"), F.sum("n").alias("vn")), "region")
    whole = sums.agg((F.sum("people") / n).alias("target"), F.try_divide(F.sum("vs"), F.sum("vn")).alias("mean"))
    cut = cut_by_region(edges, zones.select("zone", "region"))
    first = margins(votes).filter("margin >= 0").groupBy("region").agg(F.min(F.struct((-F.col("margin")).alias("less"), F.col("party"))).alias("first"))
    return (
        sums.join(F.broadcast(whole)).join(cut, "region", "left").join(first, "region", "left")
        .select(
            "region", "zones", "people", "target", "mean", ((F.col("people") - F.col("target")) / F.col("target")).alias("deviation"), land().alias("land"), people().alias("people_land"),
            F.coalesce(F.try_divide("vs", F.nullif(F.col("vn"), F.lit(0.0))), F.col("mean")).alias("value"), F.coalesce("cut", F.lit(0)).alias("cut"), F.col("first.party").alias("winner"), (-F.col("first.less")).alias("margin"),
        )
    )


def terms(regions: DataFrame, party: DataFrame, sigmas: dict[str, float], weights: dict[str, float], threshold: float, steepness: float) -> DataFrame:
    """regions of summary(), a party's margins by region -> one row: all terms of the score, measured in typical moves, the worst deviation, the
    spread of the value, and the score: weighted terms over the sum of weights, and the floors' price beside them."""
    off = F.col("people") - F.col("target")
    away = F.col("value") - F.col("mean")
    priced = regions.join(party.select("region", F.col("margin").alias("own")), "region", "left").agg(
        F.sum(off * off / sigmas["people"]).alias("people"), F.sum((F.col("land") - 1) / sigmas["shape"]).alias("shape"), F.sum((F.col("people_land") - 1) / sigmas["people_shape"]).alias("people_shape"),
        (F.sum("cut") / 2 / sigmas["cut"]).alias("cut"), F.sum(away * away / sigmas["average"]).alias("average"),
        F.sum(S.term("gerrymander", F.coalesce("own", F.lit(0.0)), F.lit(0.0), threshold, steepness) / sigmas["margin"]).alias("margin"),
        F.max(F.abs(off / F.col("target"))).alias("worst"), F.stddev_pop("value").alias("spread"), F.sum(S.floor_cost(F.col("people"), F.col("target"))).alias("floors"),
    )
    weighed = sum((F.col(name) * w for name, w in weights.items()), F.lit(0.0)) / (sum(weights.values()) or 1.0)
    return priced.select(*[F.round(c, 6).alias(c) for c in ("people", "shape", "people_shape", "cut", "average", "margin", "worst", "spread")], F.round(weighed + S.FLOOR_PRICE * F.col("floors"), 5).alias("score"))


def score(regions: DataFrame, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """regions (people, target, value, mean) -> one row: each term, the worst deviation, the spread, and the score.

    weights: (weight, size of a typical move) by term. Only the ratios of weights matter; the floor's price doesn't share in them.
    """
    off = (F.col("people") - F.col("target")) / F.col("target")
    away = F.col("value") - F.col("mean")
    terms = regions.agg(
        F.sum(off * off).alias("equality"), F.sum(away * away).alias("alike"), F.max(F.abs(off)).alias("worst"),
        F.stddev_pop("value").alias("spread"), F.sum(S.floor_cost(F.col("people"), F.col("target"))).alias("floors"),
    )
    total = sum(w for w, _ in weights.values()) or 1.0
    weighed = sum((F.col(name) * w / sigma for name, (w, sigma) in weights.items()), F.lit(0.0))
    names = ("equality", "alike", "worst", "spread")
    return terms.select(*[F.round(n, 6).alias(n) for n in names], F.round(weighed / total + S.FLOOR_PRICE * F.col("floors"), 6).alias("score"))
