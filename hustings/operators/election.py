"""Election counting over long tables (area, party, votes) and over arrays in party order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most of a party's vote that leaves in a tactical vote, and how fast viability falls with the gap.
TACTICAL_MOST, VIABILITY_SCALE = 0.28, 0.08


def winners(votes: DataFrame) -> DataFrame:
    """votes (area, party, votes) -> winner (ties: the earlier party), share, and majority over the runner-up."""
    by_area = W.partitionBy("area")
    order = by_area.orderBy(F.desc("votes"), "party")
    ranked = votes.withColumns({"rank": F.row_number().over(order), "second": F.lead("votes").over(order), "total": F.sum("votes").over(by_area)})
    return ranked.filter("rank = 1").select(
        "area", F.col("party").alias("winner"), "votes", "total", F.try_divide("votes", "total").alias("share"), (F.col("votes") - F.coalesce("second", F.lit(0))).alias("majority"), (F.col("votes") == F.col("second")).alias("tie")
    )


def standing_votes(votes: DataFrame, thresholds: DataFrame, transfers: DataFrame, exhaustion: DataFrame, by_share: bool) -> DataFrame:
    """votes with `stands` and `counted`: what each party has once absent parties' votes have moved, once.

    thresholds (party, threshold), transfers (src, dst, w), exhaustion (party, rate) are small and joined by party.
    An area where none would stand keeps its largest; an absent party without a preference among those standing stays home.
    """
    by_area = W.partitionBy("area")
    bar = F.col("threshold") * F.sum("votes").over(by_area) if by_share else F.col("threshold")
    known = votes.join(F.broadcast(thresholds), "party").join(F.broadcast(exhaustion), "party")
    able = known.withColumn("able", (F.col("votes") > 0) & (F.col("votes") >= bar))
    largest = F.row_number().over(by_area.orderBy(F.desc("votes"), "party")) == 1
    stood = able.withColumn("none", ~F.max("able").over(by_area)).withColumn("largest", largest)
    stood = stood.withColumn("stands", F.col("able") | (F.col("none") & F.col("largest") & (F.col("votes") > 0)))
    absent = stood.filter(~F.col("stands") & (F.col("votes") > 0)).select("area", F.col("party").alias("src"), (F.col("votes") * (1 - F.col("rate"))).alias("moving"))
    there = stood.filter("stands").select("area", F.col("party").alias("dst"))
    moved = absent.join(F.broadcast(transfers), "src").join(there, ["area", "dst"]).withColumn("all_w", F.sum("w").over(W.partitionBy("area", "src")))
    gained = moved.groupBy("area", "dst").agg(F.sum(F.try_divide(F.col("moving") * F.col("w"), F.nullif(F.col("all_w"), F.lit(0.0)))).alias("gain")).withColumnRenamed("dst", "party")
    return stood.join(gained, ["area", "party"], "left").select(
        "area", "party", "votes", "stands", F.when(F.col("stands"), F.col("votes") + F.coalesce("gain", F.lit(0.0))).otherwise(0.0).alias("counted")
    )


def tactical_votes(votes: DataFrame, transfers: DataFrame, most: float = TACTICAL_MOST, scale: float = VIABILITY_SCALE) -> DataFrame:
    """votes with `cast_votes`: voters of parties that can't win leave, where the seat is in doubt, for those that can.

    All movements are fixed before any is made; less than a pile leaves it, so their order doesn't matter.
    """
    by_area = W.partitionBy("area")
    viable = F.when(F.col("votes") > 0, F.exp(-((F.col("lead") - F.col("votes")) / F.col("total")) / scale)).otherwise(0.0)
    known = votes.withColumns({"lead": F.max("votes").over(by_area), "total": F.sum("votes").over(by_area)}).filter("total > 0").withColumn("viable", viable)
    mass = F.sum("viable").over(by_area)
    known = known.withColumn("_share", F.col("viable") / mass).withColumn("doubt", F.greatest(F.lit(0.0), 1 - F.sum(F.col("_share") * F.col("_share")).over(by_area)))
    known = known.withColumn("moving", F.col("votes") * most * F.col("doubt") * (1 - F.col("viable")))
    src = known.filter("moving > 0").select("area", F.col("party").alias("src"), "moving")
    dst = known.filter("votes > 0").select("area", F.col("party").alias("dst"), "viable")
    by_src = W.partitionBy("area", "src")
    pairs = src.join(dst, "area").filter("src <> dst").join(F.broadcast(transfers), ["src", "dst"], "left").withColumn("pull", F.col("viable") * F.coalesce("w", F.lit(0.0)))
    weight = F.when(F.sum("pull").over(by_src) > 0, F.col("pull")).otherwise(F.col("viable"))
    gains = pairs.withColumn("weight", weight).withColumn("all_weight", F.sum("weight").over(by_src)).groupBy("area", "dst").agg(F.sum(F.try_divide(F.col("moving") * F.col("weight"), F.nullif(F.col("all_weight"), F.lit(0.0)))).alias("gain"))
    return known.join(gains.withColumnRenamed("dst", "party"), ["area", "party"], "left").select(
        "area", "party", "votes", (F.col("votes") - F.greatest("moving", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("cast_votes")
    )


def stv(votes: str, transfers: str, exhaustion: str, seats: int, parties: int, stages: bool = False) -> Column:
    """A single-transferable count over an array of votes in party order: struct<quota, live, won, exhausted, stages>.

    Real-valued quota total / (seats + 1). Each round the fullest pile takes a seat at a quota and keeps the rest; else the
    weakest goes, less what exhausts, to those still there, by its transfer row; the last one standing takes what is left.
    Ties go to the earliest party both ways. The count is one fold on an array, without a shuffle.
    `votes`, `transfers` (array of rows) and `exhaustion` are columns by name. With `stages`, each step is kept, a
    pile without a destination is exhausted, and the last one standing keeps its votes above the seats' quotas.
    """
    live = "array_max(zip_with(s.live, s.here, (v, h) -> CASE WHEN h THEN v END))"
    bottom = live.replace("array_max", "array_min")
    at = "array_position(zip_with(s.live, s.here, (v, h) -> CASE WHEN h THEN v END), {}) - 1"
    snap = (
        "concat(s.stages, array(named_struct('kind', {kind}, 'party', {party}, 'live', {live}, 'won', {won}, 'exhausted', {exhausted})))"
        if stages
        else "s.stages"
    )

    def state(live: str, here: str, won: str, left: str, exhausted: str, kind: str, party: str) -> str:
        kept = snap.format(kind=f"'{kind}'", party=party, live="n.live", won="n.won", exhausted="n.exhausted") if stages else snap
        made = f"named_struct('live', {live}, 'won', {won}, 'exhausted', {exhausted})"
        return f"transform(array({made}), n -> named_struct('live', n.live, 'here', {here}, 'won', n.won, 'left', {left}, 'exhausted', n.exhausted, 'quota', s.quota, 'stages', {kept}))[0]"

    elect = state(
        "transform(s.live, (v, p) -> CASE WHEN p = t.top THEN greatest(0D, v - s.quota) ELSE v END)",
        "zip_with(n.live, transform(s.here, (h, p) -> struct(h, p)), (v, x) -> x.h AND (x.p <> t.top OR v > 0))",
        "transform(s.won, (w, p) -> CASE WHEN p = t.top THEN w + 1 ELSE w END)", "s.left - 1", "s.exhausted", "elected", "t.top",
    )
    rest = "greatest(0D, v - s.left * s.quota)" if stages else "0D"
    last = state(
        f"transform(s.live, (v, p) -> CASE WHEN p = t.top THEN {rest} ELSE v END)", "s.here",
        "transform(s.won, (w, p) -> CASE WHEN p = t.top THEN w + s.left ELSE w END)", "0", "s.exhausted", "elected", "t.top",
    )
    weights = f"zip_with(s.here, transform({transfers}[t.low], (w, p) -> struct(w, p)), (h, x) -> CASE WHEN h AND x.p <> t.low THEN x.w ELSE 0D END)"
    out = state(
        "zip_with(transform(s.live, (v, p) -> CASE WHEN p = t.low THEN 0D ELSE v END), u.w, (v, w) -> v + coalesce(try_divide(u.pot * w, u.total), 0D))",
        "transform(s.here, (h, p) -> h AND p <> t.low)", "s.won", "s.left",
        f"s.exhausted + s.live[t.low] * {exhaustion}[t.low]" + (" + CASE WHEN u.total > 0 THEN 0D ELSE u.pot END" if stages else ""), "excluded", "t.low",
    )
    out = (
        f"transform(transform(array({weights}), w -> named_struct('w', w, 'total', aggregate(w, 0D, (a, x) -> a + x), 'pot', s.live[t.low] * (1 - {exhaustion}[t.low]))), u -> {out})[0]"
    )
    ends = f"named_struct('best', {live}, 'top', cast({at.format(live)} as int), 'low', cast({at.format(bottom)} as int), 'n', size(filter(s.here, h -> h)))"
    step = f"transform(array({ends}), t -> CASE WHEN t.best >= s.quota THEN {elect} WHEN t.n = 1 THEN {last} ELSE {out} END)[0]"
    total = f"aggregate({votes}, 0D, (a, x) -> a + x)"
    none = "array_repeat(0, size(" + votes + "))"
    first = "array(named_struct('kind', 'first preferences', 'party', -1, 'live', " + votes + ", 'won', " + none + ", 'exhausted', 0D))"
    kind = "array<struct<kind:string,party:int,live:array<double>,won:array<int>,exhausted:double>>"
    start = f"named_struct('live', {votes}, 'here', transform({votes}, v -> v > 0), 'won', {none}, 'left', {seats}, 'exhausted', 0D, 'quota', {total} / {seats + 1}D, 'stages', cast({first if stages else 'array()'} as {kind}))"
    return F.expr(f"aggregate(sequence(1, {parties + seats}), {start}, (s, i) -> CASE WHEN s.left <= 0 OR s.quota <= 0 OR NOT exists(s.here, h -> h) THEN s ELSE {step} END)")


def ballot_map(parties: DataFrame, transfers: DataFrame, exhaustion: DataFrame) -> DataFrame:
    """parties (party, host; host null where excluded) -> (src, dst, w): where each party's votes go on this ballot.

    A member's votes go to its host; an excluded party's, less what exhausts, to the hosts, by the sum of its preferences for their members.
    """
    member = parties.filter("host is not null").select(F.col("party").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("w"))
    out = parties.filter("host is null").select(F.col("party").alias("src"))
    pull = (
        out.join(F.broadcast(transfers), "src").join(parties.filter("host is not null").select(F.col("party").alias("dst"), "host"), "dst")
        .groupBy("src", "host").agg(F.sum("w").alias("w"))
        .join(exhaustion.withColumnRenamed("party", "src"), "src")
    )
    share = F.try_divide((1 - F.col("rate")) * F.col("w"), F.nullif(F.sum("w").over(W.partitionBy("src")), F.lit(0.0)))
    return member.unionByName(pull.select("src", F.col("host").alias("dst"), share.alias("w")).filter("w is not null"))


def on_ballot(votes: DataFrame, mapping: DataFrame) -> DataFrame:
    """votes sent through a ballot's map."""
    return votes.withColumnRenamed("party", "src").join(F.broadcast(mapping), "src").groupBy("area", F.col("dst").alias("party")).agg(F.sum(F.col("votes") * F.col("w")).alias("votes"))


def merged_transfers(parties: DataFrame, transfers: DataFrame, national: DataFrame) -> DataFrame:
    """Transfer rows of the hosts: members' rows weighted by their votes, internal flows left out, each row to 1."""
    src = parties.filter("host is not null").join(national, "party").select(F.col("party").alias("src"), F.col("host").alias("src_host"), F.greatest("votes", F.lit(1e-9)).alias("v"))
    dst = parties.filter("host is not null").select(F.col("party").alias("dst"), F.col("host").alias("dst_host"))
    rows = transfers.join(F.broadcast(src), "src").join(F.broadcast(dst), "dst").filter("src_host <> dst_host")
    sums = rows.groupBy("src_host", "dst_host").agg(F.sum(F.col("v") * F.col("w")).alias("w"))
    return sums.select(F.col("src_host").alias("src"), F.col("dst_host").alias("dst"), F.try_divide("w", F.sum("w").over(W.partitionBy("src_host"))).alias("w"))


def events(stages: DataFrame) -> DataFrame:
    """Stages (area, stage, candidate, party, first_pref, quota, transfer, nt) -> events with one source.

    A stage whose sources were all below the quota excludes them, others pass on a surplus. Left out are stages with several
    sources, such as don't balance to 1 %, and such as give votes to candidates that are out or elected. For an exclusion
    other_party_share is what of the pile came from other parties; for a surplus, 1 if another party's parcel elected it. `continuing` has all
    candidates who could receive, with what they got.
    """
    before = W.partitionBy("area", "candidate").orderBy("stage").rowsBetween(W.unboundedPreceding, -1)
    by_stage = W.partitionBy("area", "stage")
    held = F.col("first_pref") + F.coalesce(F.sum("transfer").over(before), F.lit(0.0))
    source = F.col("transfer") < -1e-6
    known = stages.withColumns({"prev": held, "source": source}).withColumns({
        "sources": F.count_if("source").over(by_stage), "source_party": F.max(F.when(F.col("source"), F.col("party"))).over(by_stage), "many_parties": F.size(F.collect_set(F.when(F.col("source"), F.col("party"))).over(by_stage)) > 1,
        "moved": -F.sum(F.when(F.col("source"), F.col("transfer")).otherwise(0.0)).over(by_stage), "balance": F.sum("transfer").over(by_stage) + F.col("nt"),
        "exclusion": F.min(F.when(F.col("source"), F.col("prev") < F.col("quota") - 1e-6)).over(by_stage),
    })
    own = ~F.col("many_parties") & (F.col("source_party") == F.col("party"))
    crossed = (F.col("prev") < F.col("quota") - 1e-6) & (F.col("prev") + F.col("transfer") >= F.col("quota") - 1e-6)
    known = known.withColumns({
        "other": F.coalesce(F.sum(F.when((F.col("transfer") > 0) & ~own, F.col("transfer"))).over(before), F.lit(0.0)),
        "parcel": F.last(F.when(crossed, (~own).cast("double")), ignorenulls=True).over(before),
        "out": F.coalesce(F.max(F.col("source") & F.col("exclusion")).over(before), F.lit(False)),
    })
    going = ~F.col("source") & ~F.col("out") & (F.col("prev") < F.col("quota") - 1e-6)
    astray = F.sum(F.when(~F.col("source") & ~going, F.col("transfer")).otherwise(0.0)).over(by_stage)
    share = F.when(F.col("exclusion"), F.try_divide("other", "prev")).when(F.col("first_pref") >= F.col("quota") - 1e-6, 0.0).otherwise(F.coalesce("parcel", F.lit(0.0)))
    there = F.sort_array(F.collect_list(F.when(going, F.struct("candidate", "party", F.greatest(F.lit(0.0), F.col("transfer")).alias("votes")))).over(by_stage))
    ready = known.withColumns({"astray": astray, "receivers": F.count_if(going & (F.col("transfer") > 0)).over(by_stage), "continuing": there})
    fine = F.col("source") & (F.col("sources") == 1) & (F.abs("balance") <= 0.01 * F.col("moved")) & (F.abs("astray") <= 0.01)
    return ready.filter(fine).select(
        "area", "stage", F.when(F.col("exclusion"), "exclusion").otherwise("surplus").alias("kind"), "party", F.col("moved").alias("votes_moved"),
        F.col("nt").alias("non_transferable"), share.alias("other_party_share"), "receivers", "continuing",
    )


def clean(found: DataFrame, parties: Sequence[str], most_other: float = 0.25) -> DataFrame:
    """Events that tell where a party's own voters go: of these parties, with no running mate still there, and little of other parties in the pile."""
    mate = F.exists("continuing", lambda c: c["party"] == F.col("party"))
    return found.filter(F.col("party").isin(list(parties)) & ~mate & (F.col("other_party_share") <= most_other))


def exhaustion_rates(cleaned: DataFrame, parties: Sequence[str], fallback: float = 0.15) -> DataFrame:
    """(party, rate): what of the votes that a party passed on went nowhere, to 4 places; `fallback` for one without events."""
    sums = cleaned.groupBy("party").agg(F.sum("non_transferable").alias("nt"), F.sum("votes_moved").alias("moved"))
    every = cleaned.sparkSession.createDataFrame([(p,) for p in parties], cleaned.select("party").schema)
    return every.join(sums, "party", "left").select("party", F.coalesce(F.bround(F.try_divide("nt", F.nullif(F.col("moved"), F.lit(0.0))), 4), F.lit(fallback)).alias("rate"))


def receipts(cleaned: DataFrame, parties: Sequence[str]) -> DataFrame:
    """(event, src, dst, share) over the parties that could receive in an event, shares of what these received; events in which they got nothing are left out."""
    events_ = cleaned.withColumn("event", F.xxhash64("area", "stage"))
    got = events_.select("event", F.col("party").alias("src"), F.explode("continuing").alias("c")).filter(F.col("c.party").isin(list(parties)))
    sums = got.groupBy("event", "src", F.col("c.party").alias("dst")).agg(F.sum("c.votes").alias("votes"))
    whole = F.sum("votes").over(W.partitionBy("event"))
    return sums.withColumn("_all", whole).filter("_all > 0").select("event", "src", "dst", (F.col("votes") / F.col("_all")).alias("share"))


def availability(received: DataFrame) -> DataFrame:
    """(src, dst, events, available): how many events a party has, and in how many each other could receive."""
    by_src = received.groupBy("src").agg(F.count_distinct("event").alias("events"))
    return received.groupBy("src", "dst").agg(F.count_distinct("event").alias("available")).join(F.broadcast(by_src), "src")


def ballots_cast(voters: DataFrame, level: Column, thresholds: DataFrame | None, transfers: DataFrame, exhaustion: DataFrame, fptp: bool, tactical: bool = False) -> DataFrame:
    """voters (area, party, votes: electors times turnout index) -> area, party, votes as cast, stands: brought to the turnout level, then parties that
    don't stand lose theirs, then, under first past the post, tactical voters move."""
    cast = voters.withColumn("votes", F.greatest(F.lit(0.0), F.col("votes")) * level)
    if thresholds is not None:
        found = standing_votes(cast, thresholds, transfers, exhaustion, by_share=fptp)
        cast = found.select("area", "party", F.col("counted").alias("votes"), "stands")
    else:
        cast = cast.withColumn("stands", F.col("votes") > 0).select("area", "party", "votes", "stands")
    if tactical and fptp:
        moved = tactical_votes(cast.select("area", "party", "votes"), transfers).select("area", "party", F.col("cast_votes").alias("_cast"))
        cast = cast.join(moved, ["area", "party"], "left").select("area", "party", F.coalesce("_cast", "votes").alias("votes"), "stands")
    return cast


def seats(cast: DataFrame, parties: Sequence[str], kind: str, n: int, moves: Sequence[Sequence[float]], rates: Sequence[float]) -> DataFrame:
    """Votes as cast -> area, party, seats: one for the winner under fptp (ties to the earlier party), a transferable count for n under stv."""
    if kind == "fptp":
        won = winners(cast).select("area", F.col("winner").alias("party"), F.when(F.col("votes") > 0, 1).otherwise(0).alias("seats"))
        return cast.select("area", "party").join(won, ["area", "party"], "left").select("area", "party", F.coalesce("seats", F.lit(0)).alias("seats"))
    if kind != "stv":
        raise ValueError(f"election {kind}")
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in moves])
    piles = cast.groupBy("area").pivot("party", list(parties)).agg(F.sum("votes")).na.fill(0.0, list(parties))
    counted = piles.select("area", F.array(*[F.col(f"`{p}`") for p in parties]).alias("votes")).withColumns({"matrix": rows, "rates": F.array(*[F.lit(float(r)) for r in rates])})
    won = counted.select("area", stv("votes", "matrix", "rates", n, len(parties))["won"].alias("won"))
    names = F.array(*map(F.lit, parties))
    return won.select("area", F.explode(F.arrays_zip(names.alias("party"), F.col("won").alias("seats"))).alias("z")).select("area", "z.party", "z.seats")


def wedges(won: DataFrame, order: Sequence[str]) -> DataFrame:
    """(party, seats) -> where each party's wedge of all seats begins and ends, in turns of the circle, in the parties' order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("party"))
    whole = F.sum("seats").over(W.partitionBy())
    upto = F.sum("seats").over(W.partitionBy(F.lit(1)).orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    sums = won.groupBy("party").agg(F.sum("seats").alias("seats")).withColumn("place", place)
    return sums.withColumns({"end": F.coalesce(F.try_divide(upto, F.nullif(whole, F.lit(0))), F.lit(0.0)), "share": F.coalesce(F.try_divide("seats", F.nullif(whole, F.lit(0))), F.lit(0.0))}).select(
        "party", "seats", (F.col("end") - F.col("share")).alias("begin"), "end"
    )


def totals(areas: DataFrame) -> DataFrame:
    """areas (electorate, polled, valid) -> one row: their sums, rejected votes and turnout."""
    sums = areas.agg(*[F.sum(c).alias(c) for c in ("electorate", "polled", "valid")])
    return sums.select("*", (F.col("polled") - F.col("valid")).alias("rejected"), F.try_divide("polled", F.nullif(F.col("electorate"), F.lit(0))).alias("turnout"))


def without_pacts(seen: DataFrame, pacts: DataFrame) -> DataFrame:
    """Observations of who stood, less those where a party stood down for another: pacts (layer, party, area) is a list written by hand."""
    return seen.join(F.broadcast(pacts), ["layer", "party", "area"], "left_anti")


def ballot_order(entries: DataFrame, order: Sequence[str]) -> DataFrame:
    """entries (members, ...) with the place each has on the ballot: mergers first, then by the parties' order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.element_at("members", 1))
    return entries.withColumn("place", F.row_number().over(W.orderBy((F.size("members") > 1).desc(), F.when(F.size("members") > 1, 0).otherwise(place), "members")))
