"""Queries that fit the models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import estimators as M
from .bindings import VOTES_SQL, table, votes

QUERIES, ORACLES = {}, {}
FLOOR = 0.002
ROUNDS = 25


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


OBSERVED_SQL = f"""{VOTES_SQL}, nat AS (SELECT party, sum(votes) / (SELECT sum(votes) FROM votes) AS p FROM votes GROUP BY 1),
obs AS (SELECT area, party, sum(votes) OVER (PARTITION BY area) AS weight, votes / sum(votes) OVER (PARTITION BY area) AS y, p FROM votes JOIN nat USING (party)),
err AS (SELECT area, party, ln(greatest(y, {FLOOR})) - ln(greatest(p, {FLOOR})) AS e FROM obs)"""


def _observed(spark, d):
    """Shares by area beside the national ones, which stand for a prior."""
    found = votes(spark, d)
    national = found.groupBy("party").agg(F.sum("votes").alias("all_votes")).withColumn("p", F.col("all_votes") / F.sum("all_votes").over(W.partitionBy())).select("party", "p")
    total = F.sum("votes").over(W.partitionBy("area"))
    return found.withColumns({"weight": total, "y": F.col("votes") / total}).join(F.broadcast(national), "party")


@query("""WITH z AS (SELECT n_regionkey AS region, n_nationkey AS zone, c_mktsegment AS party, CAST(count(*) AS DOUBLE) AS votes FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
s AS (SELECT *, sum(votes) OVER (PARTITION BY zone) AS iz, sum(votes) OVER (PARTITION BY region, party) / sum(votes) OVER (PARTITION BY region) AS rs FROM z),
v AS (SELECT party, sqrt(sum(iz * pow(votes / iz - rs, 2)) / sum(iz)) AS v_spread, sum(votes) AS av FROM s GROUP BY 1),
r AS (SELECT party, stddev_pop(rs) AS r_spread FROM (SELECT DISTINCT region, party, rs FROM s) GROUP BY 1)
SELECT party, round(v_spread, 6) AS v_spread, round(r_spread, 6) AS r_spread, round(av / sum(av) OVER (), 6) AS national FROM v JOIN r USING (party)""")
def spread_constants(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("region"))
    zones = votes(spark, d).join(F.broadcast(nation), "area").withColumnRenamed("area", "zone")
    return M.spread(zones).select("party", *[F.round(c, 6).alias(c) for c in ("v_spread", "r_spread", "national")])


@query("""WITH s AS (SELECT c_mktsegment AS party, CAST(n AS DOUBLE) AS votes, (n * 7 + c_nationkey * 5) % 100 < n - 80 AS stood FROM
  (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)),
u AS (SELECT DISTINCT party, votes FROM s), b AS (SELECT party, 0::DOUBLE AS bar FROM u UNION SELECT party, coalesce((votes + lead(votes) OVER (PARTITION BY party ORDER BY votes)) / 2, votes * 1.5) FROM u),
c AS (SELECT b.party, bar, sum(CAST((votes >= bar) = stood AS INT)) AS ok, count(*) AS n, bool_and(stood) AS every FROM b JOIN s USING (party) GROUP BY ALL),
m AS (SELECT *, max(ok) OVER (PARTITION BY party) AS most FROM c)
SELECT party, round(CASE WHEN bool_and(every) THEN 0 ELSE median(bar) END, 6) AS threshold, round(max(most) / max(n), 6) AS accuracy FROM m WHERE ok = most GROUP BY 1""")
def standing_threshold_fit(spark, d):
    n = F.col("votes").cast("long")
    seen = votes(spark, d).select("party", "votes", ((n * 7 + F.col("area") * 5) % 100 < n - 80).alias("stood"))
    return M.standing_threshold(seen).select("party", F.round("threshold", 6).alias("threshold"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {OBSERVED_SQL} SELECT x.party AS a, y.party AS b, round(var_samp(x.e - y.e), 6) AS variation, count(*) AS n FROM err x JOIN err y ON x.area = y.area AND x.party < y.party GROUP BY ALL")
def log_ratio_variation(spark, d):
    return M.log_ratio_variation(_observed(spark, d), FLOOR).withColumn("variation", F.round("variation", 6))


@query(f"WITH {OBSERVED_SQL} SELECT round(sum(CASE WHEN y > 0 THEN weight * y * ln(y / p) ELSE 0 END) / sum(weight * y), 6) AS kl FROM obs")
def kl_divergence(spark, d):
    return M.kl(_observed(spark, d)).select(F.round("kl", 6).alias("kl"))


@query(f"WITH {OBSERVED_SQL} SELECT round(sqrt(avg(pow(x.e - y.e, 2))), 6) AS rms FROM err x JOIN err y ON x.area = y.area AND x.party < y.party")
def log_ratio_rms(spark, d):
    return M.log_ratio_rms(_observed(spark, d), FLOOR).select(F.round("rms", 6).alias("rms"))


def _mm_sql() -> str:
    steps = ["w0 AS (SELECT dst, 1::DOUBLE / count(*) OVER () AS w FROM won)"]
    for i in range(ROUNDS):
        steps.append(f"l{i} AS (SELECT t.dst, votes, casts / sum(w) OVER (PARTITION BY event) AS load FROM there t JOIN w{i} USING (dst)), v{i} AS (SELECT dst, sum(votes) / sum(load) AS v FROM l{i} GROUP BY 1), w{i + 1} AS (SELECT dst, v / sum(v) OVER () AS w FROM v{i})")
    return ", ".join(steps)


@query(f"""WITH {VOTES_SQL}, ev AS (SELECT area AS event, party AS dst, votes FROM votes WHERE (area + length(party)) % 4 <> 0), won AS (SELECT dst, sum(votes) AS won FROM ev GROUP BY 1),
there AS (SELECT *, sum(votes) OVER (PARTITION BY event) AS casts FROM ev), {_mm_sql()} SELECT dst, round(w, 6) AS w FROM w{ROUNDS}""")
def choice_weights_mm(spark, d):
    """Preferences from choices among varying sets, by a fixed number of rounds."""
    events = votes(spark, d).filter((F.col("area") + F.length("party")) % 4 != 0).select(F.col("area").alias("event"), F.col("party").alias("dst"), "votes")
    return M.choice_weights(events, ROUNDS).withColumn("w", F.round("w", 6))


REGIONS_SQL = "r AS (SELECT c_mktsegment AS layer, c_nationkey, avg(c_acctbal) / 1000 AS x, ln(count(*)) AS y, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY ALL)"


@query(f"""WITH {REGIONS_SQL}, m AS (SELECT *, sum(w * x) OVER p / sum(w) OVER p AS mx, sum(w * y) OVER p / sum(w) OVER p AS my FROM r WINDOW p AS (PARTITION BY layer)),
s AS (SELECT sum(w * (x - mx) * (y - my)) / sum(w * pow(x - mx, 2)) AS slope FROM m)
SELECT layer, round(max(slope), 6) AS slope, round(max(my) - max(slope) * max(mx), 6) AS intercept FROM m, s GROUP BY 1""")
def turnout_wls(spark, d):
    regions = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("layer"), "c_nationkey").agg((F.avg("c_acctbal") / 1000).alias("x"), F.log(F.count("*")).alias("y"), F.count("*").cast("double").alias("w"))
    return M.turnout_slope(regions).select("layer", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""WITH z AS (SELECT c_custkey AS zone, c_acctbal / 10000 AS x, CAST(1 + c_custkey % 5 AS DOUBLE) AS w FROM customer), a AS (SELECT *, exp(0.4 * x) AS raw FROM z),
b AS (SELECT *, raw * sum(w) OVER () / sum(raw * w) OVER () AS one FROM a), c AS (SELECT *, greatest(0.85, least(1.15, one)) AS held FROM b)
SELECT zone, round(held * sum(w) OVER () / sum(held * w) OVER (), 6) AS index FROM c""")
def turnout_index(spark, d):
    zones = table(spark, d, "customer").select(F.col("c_custkey").alias("zone"), (F.col("c_acctbal") / 10000).alias("x"), (1 + F.col("c_custkey") % 5).cast("double").alias("w"))
    return M.turnout_index(zones, "x", "w", 0.4, (0.85, 1.15)).select("zone", F.round("index", 6).alias("index"))
