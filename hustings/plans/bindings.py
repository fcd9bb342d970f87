"""The domain bound to the benchmark tables: zones are customers, areas nations, parties market segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
EVENTS_SQL = "(SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events))"
#: SQL of the same bindings, as common table expressions.
VOTES_SQL = "votes AS (SELECT c_nationkey AS area, c_mktsegment AS party, CAST(count(*) AS DOUBLE) AS votes FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"
SKEWED_SQL = VOTES_SQL + ", skewed AS (SELECT area, party, votes * CASE WHEN party = 'AUTOMOBILE' THEN 3 ELSE 1 END AS votes FROM votes)"
PARTY_SQL = "parties(i, party) AS (VALUES (0, 'AUTOMOBILE'), (1, 'BUILDING'), (2, 'FURNITURE'), (3, 'HOUSEHOLD'), (4, 'MACHINERY'))"
TRANSFERS_SQL = (
    PARTY_SQL
    + f""", ev AS (SELECT * FROM {EVENTS_SQL}),
steps AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
moves AS (SELECT src, dst, count(*) AS n FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
transfers AS (SELECT p.party AS src, q.party AS dst, n / sum(n) OVER (PARTITION BY src) AS w FROM moves
  JOIN ev a ON a.event_type = src JOIN ev b ON b.event_type = dst JOIN parties p ON p.i = a.i JOIN parties q ON q.i = b.i),
ends AS (SELECT event_type, count(*) FILTER (last) AS n_last, count(*) AS n FROM
  (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS last FROM events) GROUP BY 1),
exhaustion AS (SELECT party, CAST(n_last AS DOUBLE) / n AS rate FROM ends JOIN ev USING (event_type) JOIN parties USING (i))"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def votes(spark: SparkSession, sf_dir: str, skewed: bool = False) -> DataFrame:
    """Orders by nation and segment; with `skewed`, the first segment's three times."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))
    out = customer.join(orders, "c_custkey").groupBy(F.col("c_nationkey").alias("area"), F.col("c_mktsegment").alias("party")).agg(F.sum("n").cast("double").alias("votes"))
    return out.withColumn("votes", F.col("votes") * F.when(F.col("party") == PARTIES[0], 3).otherwise(1)) if skewed else out


def _ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_user = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_type", F.lead("event_type").over(by_user).alias("next"))


def _party_of_event(events: DataFrame) -> DataFrame:
    """Event types in order stand for parties in order; there are a handful."""
    kinds = events.select("event_type").distinct()
    names = F.array(*map(F.lit, PARTIES))
    return kinds.select("event_type", F.get(names, F.row_number().over(W.orderBy("event_type")) - 1).alias("party"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): where users go from each kind of event, own kind left out, each row to 1."""
    events = _ordered_events(spark, sf_dir)
    party = _party_of_event(events)
    moves = events.filter("next is not null and next <> event_type").groupBy("event_type", "next").agg(F.count("*").alias("n"))
    share = moves.withColumn("w", F.col("n") / F.sum("n").over(W.partitionBy("event_type")))
    return (
        share.join(F.broadcast(party.withColumnRenamed("party", "src")), "event_type")
        .join(F.broadcast(party.withColumnsRenamed({"party": "dst", "event_type": "next"})), "next")
        .select("src", "dst", "w")
    )


def exhaustion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(party, rate): the share of a kind's events that are their user's last."""
    events = _ordered_events(spark, sf_dir)
    rate = events.groupBy("event_type").agg((F.count_if(F.col("next").isNull()) / F.count("*")).alias("rate"))
    return rate.join(F.broadcast(_party_of_event(events)), "event_type").select("party", "rate")


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as unit cells, 40 in a row: zone, x, y, p_size, p_brand."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("zone"), (F.col("p_partkey") % 40).alias("x"), F.expr("p_partkey div 40").alias("y"), "p_size", "p_brand", "p_name")


def lattice_vertices(cells: DataFrame) -> DataFrame:
    """Rings of the cells, as vertices."""
    corners = F.array(*[F.struct(F.lit(k).alias("seq"), (F.col("x") + i).cast("double").alias("x"), (F.col("y") + j).cast("double").alias("y")) for k, (i, j) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    return cells.select("zone", F.lit(0).alias("part"), F.lit(0).alias("ring"), F.explode(corners).alias("c")).select("zone", "part", "ring", "c.*")


LATTICE_SQL = """cells AS (SELECT p_partkey AS zone, p_partkey % 40 AS x, p_partkey // 40 AS y, p_size, p_brand FROM part),
edges AS (SELECT a.zone AS a, b.zone AS b FROM cells a JOIN cells b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))"""
