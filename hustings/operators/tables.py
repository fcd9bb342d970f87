"""Census tables and results: flatten, index, merge, apportion, assign, reconcile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUBE = (
    "struct<name:string,label:string,table:struct<dimensions:array<struct<count:int,variable:struct<name:string,label:string>,"
    "categories:array<struct<code:string,label:string>>>>,values:array<double>>>"
)


def flatten_cube(cubes: DataFrame, column: str = "json", first: str | None = None) -> DataFrame:
    """Nested tables of one or two dimensions (JSON text) -> zone, code, label, value.

    Fails on tables of other shapes, on a wrong number of values, and if the first variable isn't `first`.
    """
    t = F.from_json(column, CUBE)["table"]
    held = cubes.select(t["dimensions"].alias("d"), t["values"].alias("v"))
    wide = F.when(F.size("d") == 2, F.size(F.col("d")[1]["categories"])).otherwise(1)
    fine = F.size("d").isin(1, 2) & (F.size("v") == F.size(F.col("d")[0]["categories"]) * wide)
    if first:
        fine &= F.col("d")[0]["variable"]["name"] == first
    checked = held.select("*", F.when(~F.coalesce(fine, F.lit(False)), F.raise_error(F.lit("not a table of this form"))).alias("bad"), wide.alias("w")).filter("bad is null")
    zones = checked.select("d", "v", "w", F.posexplode(F.col("d")[0]["categories"]).alias("zi", "zone"))
    one = F.array(F.struct(F.lit("all").alias("code"), F.lit("all").alias("label")))
    categories = F.when(F.size("d") == 2, F.expr("d[1].categories")).otherwise(one)
    cells = zones.select("v", "w", "zi", F.col("zone.code").alias("zone"), F.posexplode(categories).alias("ci", "category"))
    return cells.select("zone", "category.code", "category.label", F.element_at("v", F.col("zi") * F.col("w") + F.col("ci") + 1).alias("value"))


def weighted_index(cells: DataFrame, weights: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    """cells (by, code, value) with weights (code, weight) -> index and its own denominator n.

    A null weight leaves a category out of both. Codes on one side only are a failure, counted in `unmatched`.
    """
    joined = cells.join(F.broadcast(weights.withColumn("_known", F.lit(True))), "code", "left")
    kept = F.when(F.col("weight").isNotNull(), F.col("value"))
    return joined.groupBy(*by).agg(
        F.bround(F.try_divide(F.sum(kept * F.col("weight")), F.nullif(F.sum(kept), F.lit(0.0))), 6).alias("index"),
        F.coalesce(F.sum(kept), F.lit(0.0)).alias("n"),
        F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).cast("long").alias("unmatched"),
    )


def full_merge(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """All tables side by side by key; what a table lacks is null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table, key, "full_outer")
    return out


def apportion(zones: DataFrame, area: str, zone: str, weight: str, register: str) -> DataFrame:
    """Whole numbers that sum to each area's register, by largest remainder; ties by zone. No weight, no share."""
    by_area = W.partitionBy(area)
    exact = F.col(register) * F.col(weight) / F.nullif(F.sum(weight).over(by_area), F.lit(0.0))
    shared = zones.withColumn("_exact", F.coalesce(exact, F.lit(0.0))).withColumn("_floor", F.floor("_exact"))
    short = F.when(F.sum(weight).over(by_area) > 0, F.col(register) - F.sum("_floor").over(by_area)).otherwise(0)
    rank = F.row_number().over(by_area.orderBy(F.round(F.col("_exact") - F.col("_floor"), 9).desc(), F.col(zone)))
    return shared.withColumns({"_short": short, "_rank": rank}).select(
        *zones.columns, (F.col("_floor") + F.when(F.col("_rank") <= F.col("_short"), 1).otherwise(0)).cast("long").alias("apportioned")
    )


def majority_overlap(overlaps: DataFrame, zone: str, area: str, amount: str, split_below: float = 0.95, sliver: float = 1e-6) -> DataFrame:
    """Each zone's area of greatest overlap, ties by area; its share of what is kept, and whether it is split."""
    by_zone = W.partitionBy(zone)
    kept = overlaps.withColumn("_all", F.sum(amount).over(by_zone)).filter(F.col(amount) >= sliver * F.col("_all"))
    best = kept.groupBy(zone).agg(
        F.min_by(F.col(area), F.struct(-F.col(amount), F.col(area))).alias(area), F.max(amount).alias("_most"), F.sum(amount).alias("_kept"), F.count("*").alias("n_areas")
    )
    share = F.try_divide(F.col("_most"), F.col("_kept"))
    return best.select(zone, area, F.round(share, 6).alias("share"), (share < split_below).cast("int").alias("split"), "n_areas")


def other_areas(overlaps: DataFrame, zone: str, area: str, amount: str, sliver: float = 1e-6) -> DataFrame:
    """zone and `others`: the areas that a zone overlaps beside its greatest, as (area, share), the largest first; slivers left out."""
    by_zone = W.partitionBy(zone)
    kept = overlaps.withColumn("_all", F.sum(amount).over(by_zone)).filter(F.col(amount) >= sliver * F.col("_all"))
    ranked = kept.withColumns({"_rank": F.row_number().over(by_zone.orderBy(F.desc(amount), area)), "_kept": F.sum(amount).over(by_zone)})
    share = F.round(F.col(amount) / F.col("_kept"), 6)
    rest = ranked.filter("_rank > 1").groupBy(zone).agg(F.sort_array(F.collect_list(F.struct("_rank", F.col(area), share.alias("share")))).alias("_o"))
    return rest.select(zone, F.transform("_o", lambda o: F.struct(o[area].alias("area"), o["share"].alias("share"))).alias("others"))


def region_index(zones: DataFrame, names: DataFrame, zone: str, name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Sets of regions by zone as numbers: names numbered from 0 as they first appear, and each zone's number; a zone without a region is a failure."""
    coded = encode(names, name, order)
    joined = zones.join(F.broadcast(coded) if coded.count() <= 10_000 else coded, name, "left")
    fault = F.raise_error(F.concat(F.lit("no region for zone "), F.col(zone).cast("string"))).cast("int")
    return coded, joined.select(zone, F.coalesce("code", fault).alias("region"))


def upper_median(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """by and `median`: the middle element of each group, the upper of two; not interpolated. Equal values are counted first, so a
    group is never one array; nulls say nothing."""
    counts = rows.select(*by, value.alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    group = W.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    at = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(group)})
    return at.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min("_v").alias("median"))


def encode(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names numbered from 0 in the order in which they first appear."""
    first = rows.groupBy(name).agg(F.min(order).alias("_first"))
    return first.select(name, (F.row_number().over(W.orderBy("_first", name)) - 1).alias("code"))


def filled_party(rows: DataFrame, party: Column, manual: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """party and party_source: read, filled by hand only where blank, then overridden, with what was declared kept."""
    joined = rows.withColumn("_read", party).join(F.broadcast(manual), key, "left").join(F.broadcast(override), key, "left")
    filled = F.coalesce("_read", "manual_party")
    return joined.withColumns({
        "party_as_declared": filled,
        "party": F.coalesce("override_party", filled),
        "party_source": F.when(F.col("override_party").isNotNull(), "assumed").when(F.col("_read").isNotNull(), "read").when(F.col("manual_party").isNotNull(), "manual").otherwise("unknown"),
    }).drop("_read", "manual_party", "override_party")


def reconciled(parts: DataFrame, totals: DataFrame, key: str, part: str, total: str, tolerance: float = 0.0) -> DataFrame:
    """Sums of parts beside stated totals: found, stated, ok and flags; a total without parts is missing."""
    summed = parts.groupBy(key).agg(F.sum(part).alias("found"), F.count("*").alias("n_parts"))
    joined = totals.select(key, F.col(total).alias("stated")).join(summed, key, "left")
    gap = F.abs(F.col("found") - F.col("stated"))
    ok = F.coalesce(gap <= tolerance * F.abs("stated"), F.lit(False))
    flags = F.array_compact(F.array(F.when(F.col("found").isNull(), "missing"), F.when(F.col("found").isNotNull() & ~ok, "sum differs")))
    return joined.withColumns({"ok": ok, "flags": flags})


def running_totals(stages: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """What each row's key held before it."""
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return stages.withColumn("before", F.coalesce(F.sum(value).over(upto), F.lit(0.0)))


def age_shares(cells: DataFrame, adult: int = 18, old: int = 65) -> DataFrame:
    """cells (zone, code, value), codes beginning with an age -> adults by zone, and the share of them who are old; 0 without adults."""
    age = F.regexp_extract("code", r"^(\d+)", 1).try_cast("int")
    sums = cells.groupBy("zone").agg(*[F.coalesce(F.sum(F.when(age >= at, F.col("value"))), F.lit(0.0)).alias(n) for n, at in (("adults", adult), ("old", old))])
    return sums.select("zone", "adults", F.coalesce(F.try_divide("old", "adults"), F.lit(0.0)).alias("old_share"))
