"""Queries that count elections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import election as E
from .bindings import PARTIES, PARTY_SQL, SKEWED_SQL, TRANSFERS_SQL, VOTES_SQL, exhaustion, table, transfers, votes

QUERIES, ORACLES = {}, {}
SEATS = 3


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {VOTES_SQL}, l AS (SELECT area, party, 0.6 * votes AS votes FROM votes), t AS (SELECT *, sum(votes) OVER (PARTITION BY area) AS total FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY votes DESC, party) AS rk, lead(votes) OVER (PARTITION BY area ORDER BY votes DESC, party) AS second FROM t),
n AS (SELECT area, count(*) FILTER (votes >= 0.18 * total) AS standing FROM t GROUP BY 1)
SELECT n_name AS area, party AS winner, round(votes, 6) AS votes, round(votes / total, 6) AS share, round(votes - second, 6) AS majority, standing FROM r JOIN n USING (area) JOIN nation ON n_nationkey = area WHERE rk = 1""")
def regional_election_report(spark, d):
    """Who wins each nation at a turnout of 60 %, by how much, and how many parties would stand."""
    cast = votes(spark, d).withColumn("votes", F.col("votes") * 0.6)
    bar = F.col("votes") >= 0.18 * F.sum("votes").over(W.partitionBy("area"))
    standing = cast.withColumn("stands", bar).groupBy("area").agg(F.count_if("stands").alias("standing"))
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    won = E.winners(cast).join(standing, "area").join(F.broadcast(names), F.col("n_nationkey") == F.col("area"))
    return won.select(F.col("n_name").alias("area"), "winner", *[F.round(c, 6).alias(c) for c in ("votes", "share", "majority")], "standing")


@query(f"WITH {TRANSFERS_SQL} SELECT src, dst, round(w, 6) AS w FROM transfers")
def transfer_shares_matrix(spark, d):
    return transfers(spark, d).withColumn("w", F.round("w", 6))


@query(f"WITH {TRANSFERS_SQL} SELECT party, round(rate, 6) AS rate FROM exhaustion")
def exhaustion_rate(spark, d):
    return exhaustion(spark, d).withColumn("rate", F.round("rate", 6))


def _standing_sql(bar: str) -> str:
    return f"""WITH {SKEWED_SQL}, {TRANSFERS_SQL}, k AS (SELECT *, votes > 0 AND votes >= {bar} AS able, row_number() OVER (PARTITION BY area ORDER BY votes DESC, party) AS rk, sum(votes) OVER (PARTITION BY area) AS total FROM skewed),
s AS (SELECT *, able OR (NOT bool_or(able) OVER (PARTITION BY area) AND rk = 1) AS stands FROM k),
m AS (SELECT a.area, b.party, a.votes * (1 - rate) * w / nullif(sum(w) OVER (PARTITION BY a.area, a.party), 0) AS gain FROM s a JOIN exhaustion e ON e.party = a.party JOIN transfers t ON t.src = a.party JOIN s b ON b.area = a.area AND b.party = t.dst AND b.stands WHERE NOT a.stands AND a.votes > 0),
g AS (SELECT area, party, sum(gain) AS gain FROM m GROUP BY ALL)
SELECT area, party, votes, stands, round(CASE WHEN stands THEN votes + coalesce(gain, 0) ELSE 0 END, 6) AS counted FROM s LEFT JOIN g USING (area, party)"""


def _standing(spark, d, by_share):
    bars = spark.createDataFrame([(p, (0.14 if by_share else 125.0) + i * (0.002 if by_share else 2.0)) for i, p in enumerate(PARTIES)], "party string, threshold double")
    found = E.standing_votes(votes(spark, d, skewed=True), bars, transfers(spark, d), exhaustion(spark, d), by_share)
    return found.select("area", "party", "votes", "stands", F.round("counted", 6).alias("counted"))


_INDEX = "(CASE party WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END)"


@query(_standing_sql(f"125 + 2 * {_INDEX}"))
def standing_rule_stv(spark, d):
    """Parties stand from a number of votes; what the others had moves on."""
    return _standing(spark, d, False)


@query(_standing_sql(f"(0.14 + 0.002 * {_INDEX}) * sum(votes) OVER (PARTITION BY area)"))
def standing_rule_fptp(spark, d):
    """Parties stand from a share of the votes."""
    return _standing(spark, d, True)


TACTICAL_SQL = f"""{VOTES_SQL}, {TRANSFERS_SQL}, a AS (SELECT *, max(votes) OVER w AS lead, sum(votes) OVER w AS total FROM votes WINDOW w AS (PARTITION BY area)),
v AS (SELECT *, CASE WHEN votes > 0 THEN exp(-((lead - votes) / total) / 0.08) ELSE 0 END AS viable FROM a),
x AS (SELECT *, viable / sum(viable) OVER (PARTITION BY area) AS sh FROM v), y AS (SELECT *, greatest(0, 1 - sum(sh * sh) OVER (PARTITION BY area)) AS doubt FROM x),
z AS (SELECT *, votes * 0.28 * doubt * (1 - viable) AS moving FROM y),
p AS (SELECT s.area, s.party AS src, t.party AS dst, s.moving, t.viable, t.viable * coalesce(w, 0) AS pull FROM z s JOIN z t ON t.area = s.area AND t.party <> s.party AND t.votes > 0 LEFT JOIN transfers tr ON tr.src = s.party AND tr.dst = t.party WHERE s.moving > 0),
q AS (SELECT *, CASE WHEN sum(pull) OVER (PARTITION BY area, src) > 0 THEN pull ELSE viable END AS wt FROM p),
r AS (SELECT *, moving * wt / nullif(sum(wt) OVER (PARTITION BY area, src), 0) AS gain FROM q), g AS (SELECT area, dst AS party, sum(gain) AS gain FROM r GROUP BY ALL),
tactical AS (SELECT area, party, votes, votes - greatest(moving, 0) + coalesce(gain, 0) AS cast_votes FROM z LEFT JOIN g USING (area, party))"""


@query(f"WITH {TACTICAL_SQL} SELECT area, party, votes, round(cast_votes, 6) AS cast_votes FROM tactical")
def tactical_votes(spark, d):
    return E.tactical_votes(votes(spark, d), transfers(spark, d)).withColumn("cast_votes", F.round("cast_votes", 6))


@query(f"""WITH {TACTICAL_SQL}, s AS (SELECT area, party, cast_votes / sum(cast_votes) OVER (PARTITION BY area) AS share FROM tactical),
m AS (SELECT a.area, a.party, a.share, max(b.share) AS rival FROM s a JOIN s b ON b.area = a.area AND b.party <> a.party GROUP BY ALL)
SELECT area, party, round(share - rival, 6) AS margin, round(1 / (1 + exp((share - rival) * 25)), 6) AS term FROM m""")
def party_margin(spark, d):
    """Each party's lead over its best rival as votes are cast, and the term that rewards it: the top two by area suffice."""
    cast = E.tactical_votes(votes(spark, d), transfers(spark, d))
    by_area = W.partitionBy("area")
    shares = cast.withColumn("share", F.col("cast_votes") / F.sum("cast_votes").over(by_area))
    top = by_area.orderBy(F.desc("share"), "party")
    ranked = shares.withColumns({"rank": F.row_number().over(top), "best": F.max("share").over(by_area)})
    second = F.max(F.when(F.col("rank") == 2, F.col("share"))).over(by_area)
    margin = F.col("share") - F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("best"))
    out = ranked.withColumn("second", second).withColumn("margin", margin)
    return out.select("area", "party", F.round("margin", 6).alias("margin"), F.round(S.term("gerrymander", F.col("margin"), F.lit(0.0), threshold=0.0, steepness=25.0), 6).alias("term"))


def _piles(spark, d):
    """A row for each nation, votes as an array in party order, with the transfer rows and exhaustion beside them."""
    order = F.array(*map(F.lit, PARTIES))
    rows = votes(spark, d, skewed=True).withColumn("i", F.array_position(order, F.col("party")))
    piles = rows.groupBy("area").pivot("party", PARTIES).agg(F.sum("votes")).na.fill(0.0).select("area", F.array(*PARTIES).alias("votes"))
    moves = transfers(spark, d).groupBy("src").pivot("dst", PARTIES).agg(F.sum("w")).na.fill(0.0)
    matrix = moves.agg(F.sort_array(F.collect_list(F.struct("src", F.array(*PARTIES).alias("row")))).alias("m")).select(F.transform("m", lambda x: x["row"]).alias("matrix"))
    rates = exhaustion(spark, d).agg(F.sort_array(F.collect_list(F.struct("party", "rate"))).alias("e")).select(F.transform("e", lambda x: x["rate"]).alias("rates"))
    return piles.join(F.broadcast(matrix), F.lit(True)).join(F.broadcast(rates), F.lit(True))


#: The same count as a recursion over lists.
STV_SQL = f"""{SKEWED_SQL}, {TRANSFERS_SQL},
full_t AS (SELECT p.i AS si, q.i AS di, coalesce(w, 0) AS w FROM parties p CROSS JOIN parties q LEFT JOIN transfers t ON t.src = p.party AND t.dst = q.party),
rows_t AS (SELECT si, list(w ORDER BY di) AS r FROM full_t GROUP BY 1), mat AS (SELECT list(r ORDER BY si) AS t FROM rows_t), ex AS (SELECT list(rate ORDER BY party) AS e FROM exhaustion),
piles AS (SELECT area, list(coalesce(votes, 0) ORDER BY i) AS v FROM (SELECT DISTINCT area FROM skewed) CROSS JOIN parties LEFT JOIN skewed USING (area, party) GROUP BY 1),
count_(area, step, live, here, won, seats_left, quota, exhausted, kind, party) AS (
  SELECT area, 0, v, list_transform(v, lambda x: x > 0), [0, 0, 0, 0, 0], {SEATS}, list_sum(v) / {SEATS + 1}.0, 0::DOUBLE, 'first preferences', -1 FROM piles
  UNION ALL
  SELECT area, step + 1,
    CASE act WHEN 'elect' THEN list_transform(live, lambda x, i: CASE WHEN i = top THEN greatest(0, x - quota) ELSE x END) WHEN 'last' THEN list_transform(live, lambda x, i: CASE WHEN i = top THEN greatest(0, x - seats_left * quota) ELSE x END)
      ELSE list_transform(live, lambda x, i: CASE WHEN i = low THEN 0 ELSE x + CASE WHEN wsum > 0 THEN live[low] * (1 - e[low]) * ws[i] / wsum ELSE 0 END END) END,
    CASE act WHEN 'elect' THEN list_transform(here, lambda h, i: h AND (i <> top OR live[i] - quota > 0)) WHEN 'last' THEN here ELSE list_transform(here, lambda h, i: h AND i <> low) END,
    CASE act WHEN 'elect' THEN list_transform(won, lambda n, i: CASE WHEN i = top THEN n + 1 ELSE n END) WHEN 'last' THEN list_transform(won, lambda n, i: CASE WHEN i = top THEN n + seats_left ELSE n END) ELSE won END,
    CASE act WHEN 'elect' THEN seats_left - 1 WHEN 'last' THEN 0 ELSE seats_left END, quota,
    exhausted + CASE WHEN act = 'out' THEN live[low] * e[low] + CASE WHEN wsum > 0 THEN 0 ELSE live[low] * (1 - e[low]) END ELSE 0 END,
    CASE WHEN act = 'out' THEN 'excluded' ELSE 'elected' END, CAST(CASE WHEN act = 'out' THEN low ELSE top END - 1 AS INT)
  FROM (SELECT *, CASE WHEN best >= quota THEN 'elect' WHEN n = 1 THEN 'last' ELSE 'out' END AS act, list_transform(t[low], lambda x, i: CASE WHEN here[i] AND i <> low THEN x ELSE 0 END) AS ws,
      list_sum(list_transform(t[low], lambda x, i: CASE WHEN here[i] AND i <> low THEN x ELSE 0 END)) AS wsum
    FROM (SELECT *, list_position(masked, list_max(masked)) AS top, list_position(masked, list_min(masked)) AS low, list_max(masked) AS best
      FROM (SELECT *, list_transform(live, lambda x, i: CASE WHEN here[i] THEN x END) AS masked, len(list_filter(here, lambda h: h)) AS n FROM count_ WHERE seats_left > 0 AND quota > 0 AND len(list_filter(here, lambda h: h)) > 0), mat, ex)))"""


@query(f"WITH RECURSIVE {STV_SQL} SELECT area, won[1] AS automobile, won[2] AS building, won[3] AS furniture, won[4] AS household, won[5] AS machinery FROM count_ QUALIFY row_number() OVER (PARTITION BY area ORDER BY step DESC) = 1")
def stv_seats(spark, d):
    """Three seats a nation by transferable votes, one fold an area."""
    counted = _piles(spark, d).select("area", E.stv("votes", "matrix", "rates", SEATS, len(PARTIES)).alias("c"))
    return counted.select("area", *[F.col("c.won")[i].alias(p.lower()) for i, p in enumerate(PARTIES)])


@query(f"""WITH RECURSIVE {STV_SQL} SELECT area, step AS stage, kind, party, round(list_sum(live), 6) AS live, round(list_sum(won) * quota, 6) AS locked, round(exhausted, 6) AS exhausted FROM count_""")
def stv_stages(spark, d):
    """Each step of the counts: what is live, held and exhausted."""
    counted = _piles(spark, d).select("area", E.stv("votes", "matrix", "rates", SEATS, len(PARTIES), stages=True).alias("c"))
    stages = counted.select("area", "c.quota", F.posexplode("c.stages").alias("stage", "s"))
    live, won = (F.aggregate(F.col(f"s.{n}"), F.lit(0.0), lambda a, x: a + x) for n in ("live", "won"))
    return stages.select("area", "stage", "s.kind", "s.party", F.round(live, 6).alias("live"), F.round(won * F.col("quota"), 6).alias("locked"), F.round("s.exhausted", 6).alias("exhausted"))


@query(f"""WITH RECURSIVE {STV_SQL} SELECT area, round(0 - (2 * won[1] + live[1] / quota), 6) AS term
FROM count_ QUALIFY row_number() OVER (PARTITION BY area ORDER BY step DESC) = 1""")
def stv_gerrymander_value(spark, d):
    """What a party has of its next seat, and a bonus for each it won; negated, as a term to be made small."""
    counted = _piles(spark, d).select("area", E.stv("votes", "matrix", "rates", SEATS, len(PARTIES), stages=True).alias("c"))
    return counted.select("area", F.round(0 - (2 * F.col("c.won")[0] + F.col("c.live")[0] / F.col("c.quota")), 6).alias("term"))


def _ballot(spark, hosts):
    return spark.createDataFrame([(p, hosts.get(p, p)) for p in PARTIES], "party string, host string")


@query(f"""WITH {VOTES_SQL}, {TRANSFERS_SQL}, m AS (SELECT party AS src, party AS dst, 1::DOUBLE AS w FROM parties WHERE party <> 'BUILDING'
UNION ALL SELECT src, dst, (1 - rate) * w / sum(w) OVER () FROM transfers JOIN exhaustion ON party = src WHERE src = 'BUILDING')
SELECT area, dst AS party, round(sum(votes * w), 6) AS votes FROM votes JOIN m ON src = party GROUP BY ALL""")
def ballot_exclude(spark, d):
    """One party isn't on the ballot: its votes go on, less what exhausts."""
    mapping = E.ballot_map(_ballot(spark, {"BUILDING": None}), transfers(spark, d), exhaustion(spark, d))
    return E.on_ballot(votes(spark, d), mapping).withColumn("votes", F.round("votes", 6))


@query(f"""WITH {VOTES_SQL}, {TRANSFERS_SQL}, h AS (SELECT party, CASE WHEN party = 'MACHINERY' THEN 'HOUSEHOLD' ELSE party END AS host FROM parties), n AS (SELECT party, sum(votes) AS v FROM votes GROUP BY 1),
r AS (SELECT a.host AS src, b.host AS dst, sum(v * w) AS w FROM transfers JOIN h a ON a.party = src JOIN h b ON b.party = dst JOIN n ON n.party = src WHERE a.host <> b.host GROUP BY ALL)
SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM r""")
def ballot_merge(spark, d):
    """Two parties as one: the transfer rows of the parties on the ballot."""
    national = votes(spark, d).groupBy("party").agg(F.sum("votes").alias("votes"))
    return E.merged_transfers(_ballot(spark, {"MACHINERY": "HOUSEHOLD"}), transfers(spark, d), national).withColumn("w", F.round("w", 6))


@query(f"""WITH {VOTES_SQL}, {TRANSFERS_SQL}, s AS (SELECT *, votes / sum(votes) OVER (PARTITION BY area) AS share FROM votes), a AS (SELECT *, share >= 0.19 AS stood FROM s),
m AS (SELECT x.area, y.party, x.share * w / sum(w) OVER (PARTITION BY x.area, x.party) AS gain FROM a x JOIN transfers ON src = x.party JOIN a y ON y.area = x.area AND y.party = dst AND y.stood WHERE NOT x.stood),
g AS (SELECT area, party, sum(gain) AS gain FROM m GROUP BY ALL)
SELECT area, party, round(share + coalesce(gain, 0), 6) AS share FROM a LEFT JOIN g USING (area, party) WHERE stood""")
def ballot_mapping(spark, d):
    """Shares of voters as shares on the ballots they found, where nobody stays at home."""
    by_area = W.partitionBy("area")
    shares = votes(spark, d).withColumn("votes", F.col("votes") / F.sum("votes").over(by_area))
    bars = spark.createDataFrame([(p, 0.19) for p in PARTIES], "party string, threshold double")
    nobody = spark.createDataFrame([(p, 0.0) for p in PARTIES], "party string, rate double")
    found = E.standing_votes(shares, bars, transfers(spark, d), nobody, by_share=False)
    return found.filter("stands").select("area", "party", F.round("counted", 6).alias("share"))


@query(f"""WITH RECURSIVE {STV_SQL}, b AS (SELECT *, lag(live) OVER w AS was, lag(exhausted) OVER w AS was_out FROM count_ WINDOW w AS (PARTITION BY area ORDER BY step)),
g AS (SELECT area, step, unnest(range(0, 5)) AS p, unnest(live) AS l, unnest(was) AS m, quota FROM b WHERE step > 0),
o AS (SELECT *, coalesce(sum(greatest(l - m, 0)) OVER (PARTITION BY area, p ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gained FROM g),
c AS (SELECT area, step, count(*) FILTER (l > m) AS receivers FROM g GROUP BY ALL)
SELECT b.area, b.step AS stage, 'exclusion' AS kind, b.party, round(m, 6) AS votes_moved, round(exhausted - was_out, 6) AS non_transferable, round(gained / m, 6) AS other_party_share, receivers
FROM b JOIN o ON o.area = b.area AND o.step = b.step AND o.p = b.party JOIN c ON c.area = b.area AND c.step = b.step WHERE kind = 'excluded'""")
def transfer_events(spark, d):
    """Exclusions and surpluses as events with one source, out of the stages of the counts; stages that don't balance aren't events."""
    counted = _piles(spark, d).select("area", "votes", E.stv("votes", "matrix", "rates", SEATS, len(PARTIES), stages=True).alias("c"))
    steps = counted.select("area", "votes", "c.quota", F.posexplode("c.stages").alias("stage", "s"))
    long = steps.select("area", "quota", "stage", F.col("s.exhausted").alias("exhausted"), F.posexplode("s.live").alias("candidate", "held"))
    by = W.partitionBy("area", "candidate").orderBy("stage")
    moves = long.withColumns({"transfer": F.col("held") - F.lag("held").over(by), "nt": F.col("exhausted") - F.lag("exhausted").over(by), "party": F.col("candidate")}).filter("transfer is not null")
    first = long.filter("stage = 0").select("area", "candidate", F.col("held").alias("first_pref"))
    found = E.events(moves.join(first, ["area", "candidate"]))
    return found.select("area", "stage", "kind", "party", *[F.round(c, 6).alias(c) for c in ("votes_moved", "non_transferable", "other_party_share")], "receivers")
