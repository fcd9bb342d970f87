"""Queries on tables: ingest, normalise, merge, apportion, assign, reconcile."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tables as O
from .bindings import PARTIES, VOTES_SQL, table, votes

QUERIES, ORACLES = {}, {}
#: Weights of the categories of an index; one is left out.
WEIGHTS = (("AUTOMOBILE", 1.0), ("BUILDING", 0.0), ("FURNITURE", 0.5), ("HOUSEHOLD", 0.5), ("MACHINERY", None))
WEIGHTS_SQL = "weights(code, weight) AS (VALUES ('AUTOMOBILE', 1.0), ('BUILDING', 0.0), ('FURNITURE', 0.5), ('HOUSEHOLD', 0.5), ('MACHINERY', NULL))"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _cells(spark, d):
    return votes(spark, d).select(F.col("area").cast("string").alias("zone"), F.col("party").alias("code"), F.col("votes").alias("value"))


def _cube(spark, d):
    """The nation by segment counts as one nested table, written out as JSON."""
    cells = _cells(spark, d)
    categories = [{"code": p, "label": p.title()} for p in PARTIES]
    labels = F.array(*[F.struct(F.lit(c["code"]).alias("code"), F.lit(c["label"]).alias("label")) for c in categories])
    rows = cells.groupBy("zone").pivot("code", PARTIES).sum("value").na.fill(0.0)
    every = rows.agg(F.sort_array(F.collect_list(F.struct(F.col("zone"), F.array(*PARTIES).alias("values")))).alias("rows"))
    zones = F.transform("rows", lambda r: F.struct(r["zone"].alias("code"), r["zone"].alias("label")))

    def dimension(name, items):
        return F.struct(F.size(items).alias("count"), F.struct(F.lit(name).alias("name"), F.lit(name).alias("label")).alias("variable"), items.alias("categories"))

    body = F.struct(F.array(dimension("ZONE", zones), dimension("SEGMENT", labels)).alias("dimensions"), F.flatten(F.transform("rows", lambda r: r["values"])).alias("values"))
    return every.select(F.to_json(F.struct(F.lit("segments").alias("name"), F.lit("Segments").alias("label"), body.alias("table"))).alias("json"))


@query(f"""WITH {VOTES_SQL} SELECT CAST(area AS VARCHAR) AS zone, party AS code, party[1] || lower(party[2:]) AS label, coalesce(votes, 0) AS value
FROM (SELECT DISTINCT area FROM votes) CROSS JOIN (SELECT DISTINCT party FROM votes) LEFT JOIN votes USING (area, party)""")
def census_cube_flatten(spark, d):
    """A nested table, written and read back, in long form."""
    return O.flatten_cube(_cube(spark, d), first="ZONE")


@query(f"""WITH {VOTES_SQL}, {WEIGHTS_SQL}
SELECT CAST(area AS VARCHAR) AS zone, round_even(sum(votes * weight) / sum(votes) FILTER (weight IS NOT NULL), 6) AS index,
  sum(votes) FILTER (weight IS NOT NULL) AS n, CAST(0 AS BIGINT) AS unmatched FROM votes JOIN weights ON party = code GROUP BY ALL""")
def weighted_index(spark, d):
    weights = spark.createDataFrame(list(WEIGHTS), "code string, weight double")
    return O.weighted_index(_cells(spark, d), weights)


@query(f"""WITH {VOTES_SQL} SELECT CAST(area AS VARCHAR) AS zone, sum(votes) FILTER (party = 'AUTOMOBILE') AS automobile, sum(votes) FILTER (party = 'BUILDING') AS building,
  sum(votes) FILTER (party = 'FURNITURE') AS furniture, sum(votes) FILTER (party = 'HOUSEHOLD') AS household, sum(votes) FILTER (party = 'MACHINERY') AS machinery FROM votes GROUP BY ALL""")
def category_pivot(spark, d):
    cells = _cells(spark, d).withColumn("slug", X.slug(F.concat(F.col("code"), F.lit(" (segment)"))))
    return cells.groupBy("zone").pivot("slug", [p.lower() for p in PARTIES]).sum("value")


@query(f"""WITH {VOTES_SQL}, {WEIGHTS_SQL},
z AS (SELECT area, sum(votes * weight) / sum(votes) FILTER (weight IS NOT NULL) AS x, sum(votes) FILTER (weight IS NOT NULL) AS n FROM votes JOIN weights ON party = code GROUP BY ALL)
SELECT r_name AS parent, round(sum(x * n) / sum(n), 6) AS value, sum(n) AS n FROM z JOIN nation ON n_nationkey = area JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def index_by_parent(spark, d):
    """An index of larger areas, by its own denominator."""
    weights = spark.createDataFrame(list(WEIGHTS), "code string, weight double").filter("weight is not null")
    zones = votes(spark, d).withColumnRenamed("party", "code").join(F.broadcast(weights), "code").groupBy("area").agg((F.sum(F.col("votes") * F.col("weight")) / F.sum("votes")).alias("x"), F.sum("votes").alias("n"))
    parents = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("area"), F.col("r_name").alias("parent"))
    return zones.join(F.broadcast(parents), "area").groupBy("parent").agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("value"), F.sum("n").alias("n"))


@query("""WITH a AS (SELECT c_nationkey AS area, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
b AS (SELECT s_nationkey AS area, count(*) AS suppliers FROM supplier GROUP BY 1),
c AS (SELECT c_nationkey AS area, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000 GROUP BY 1)
SELECT area, customers, suppliers, orders FROM a FULL JOIN b USING (area) FULL JOIN c USING (area)""")
def attribute_merge(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("customers"))
    sellers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.count("*").alias("suppliers"))
    nation = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("area"))
    big = table(spark, d, "orders").filter("o_totalprice > 400000").join(nation, F.col("o_custkey") == F.col("c_custkey")).groupBy("area").agg(F.count("*").alias("orders"))
    return O.full_merge([rich, sellers, big], "area")


@query(r"""SELECT o_orderpriority AS label, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug,
regexp_replace(replace(lower(o_orderpriority), '&', ' and '), '[^a-z]', '', 'g') AS key, regexp_replace(o_orderpriority || ' 12', '\d+$', '') AS stem, count(*) AS n FROM orders GROUP BY ALL""")
def label_normalise(spark, d):
    label = F.col("o_orderpriority")
    return table(spark, d, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n")).select(
        "label", X.slug(F.col("label")).alias("slug"), X.area_key(F.col("label")).alias("key"), X.without_digits(F.concat("label", F.lit(" 12"))).alias("stem"), "n"
    )


@query("""WITH raw AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || '.' ELSE c_mktsegment END AS raw FROM customer),
m(k, p) AS (VALUES ('automobile', 'Auto'), ('building.', 'Build'), ('furniture', 'Furn'), ('household.', 'House')),
r AS (SELECT c_custkey, c_nationkey, coalesce(a.p, b.p) AS party FROM raw LEFT JOIN m a ON a.k = rtrim(lower(raw), '.') LEFT JOIN m b ON b.k = rtrim(lower(raw), '.') || '.'),
f AS (SELECT *, coalesce(party, CASE WHEN c_nationkey = 3 THEN 'Manual' END) AS filled FROM r)
SELECT CASE WHEN c_nationkey = 5 THEN 'Pact' ELSE filled END AS party, filled AS party_as_declared,
  CASE WHEN c_nationkey = 5 THEN 'assumed' WHEN party IS NOT NULL THEN 'read' WHEN c_nationkey = 3 THEN 'manual' ELSE 'unknown' END AS party_source, count(*) AS n FROM f GROUP BY ALL""")
def party_standardise(spark, d):
    raw = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit("."))).otherwise(F.col("c_mktsegment"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("area"), raw.alias("raw"))
    names = {"automobile": "Auto", "building.": "Build", "furniture": "Furn", "household.": "House"}
    manual = spark.createDataFrame([(3, "Manual")], "area long, manual_party string")
    override = spark.createDataFrame([(5, "Pact")], "area long, override_party string")
    out = O.filled_party(rows, X.mapped(F.col("raw"), names), manual, override, "area")
    return out.groupBy("party", "party_as_declared", "party_source").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_orderkey, sum(l_extendedprice) AS found, count(*) AS n_parts FROM lineitem GROUP BY 1)
SELECT CASE WHEN found IS NULL THEN 'missing' WHEN abs(found - o_totalprice) <= 0.5 * abs(o_totalprice) THEN '' ELSE 'sum differs' END AS flags,
  coalesce(abs(found - o_totalprice) <= 0.5 * abs(o_totalprice), false) AS ok, count(*) AS n, CAST(sum(n_parts) AS BIGINT) AS parts FROM orders LEFT JOIN p ON l_orderkey = o_orderkey GROUP BY ALL""")
def reconcile_totals(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    out = O.reconciled(lines, table(spark, d, "orders"), "o_orderkey", "l_extendedprice", "o_totalprice", 0.5)
    return out.groupBy(F.array_join("flags", ", ").alias("flags"), "ok").agg(F.count("*").alias("n"), F.sum("n_parts").alias("parts"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unmatched_areas(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("""WITH reg AS (SELECT c_nationkey, count(*) AS register FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
e AS (SELECT c_custkey, c_nationkey, register, greatest(c_acctbal, 0) AS w, sum(greatest(c_acctbal, 0)) OVER (PARTITION BY c_nationkey) AS tw FROM customer JOIN reg USING (c_nationkey)),
f AS (SELECT *, CASE WHEN tw > 0 THEN register * w / tw ELSE 0 END AS exact FROM e),
g AS (SELECT *, CASE WHEN tw > 0 THEN register - sum(floor(exact)) OVER (PARTITION BY c_nationkey) ELSE 0 END AS short,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY round(exact - floor(exact), 9) DESC, c_custkey) AS rk FROM f)
SELECT c_custkey AS zone, c_nationkey AS area, CAST(floor(exact) + CASE WHEN rk <= short THEN 1 ELSE 0 END AS BIGINT) AS apportioned FROM g""")
def apportion_largest_remainder(spark, d):
    zones = table(spark, d, "customer").select(F.col("c_custkey").alias("zone"), F.col("c_nationkey").alias("area"), F.greatest("c_acctbal", F.lit(0.0)).alias("weight"))
    register = votes(spark, d).groupBy("area").agg(F.sum("votes").cast("long").alias("register"))
    return O.apportion(zones.join(F.broadcast(register), "area"), "area", "zone", "weight", "register").select("zone", "area", "apportioned")


@query("""WITH n AS (SELECT c_nationkey AS area, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1)
SELECT area, n_regionkey AS parent, round(n / sum(n) OVER (PARTITION BY n_regionkey), 6) AS share, round(1000 * n / sum(n) OVER (PARTITION BY n_regionkey), 6) AS detail FROM n JOIN nation ON n_nationkey = area""")
def apportion_child_share(spark, d):
    """A parent's detail dealt to its children by their share of its total."""
    children = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").cast("double").alias("n")).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("area"))
    total = F.sum("n").over(W.partitionBy("n_regionkey"))
    return children.select("area", F.col("n_regionkey").alias("parent"), F.round(F.col("n") / total, 6).alias("share"), F.round(1000 * F.col("n") / total, 6).alias("detail"))


OVERLAP_SQL = """o AS (SELECT l_partkey AS zone, l_suppkey AS area, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
t AS (SELECT *, sum(q) OVER (PARTITION BY zone) AS tot FROM o), k AS (SELECT * FROM t WHERE q >= 1e-6 * tot),
r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY q DESC, area) AS rk, sum(q) OVER (PARTITION BY zone) AS kept, count(*) OVER (PARTITION BY zone) AS n_areas FROM k),
best AS (SELECT zone, area, round(q / kept, 6) AS share, CAST(q / kept < 0.10 AS INT) AS split, n_areas FROM r WHERE rk = 1)"""


def _overlaps(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("zone"), F.col("l_suppkey").alias("area")).agg(F.sum("l_quantity").alias("q"))


@query(f"WITH {OVERLAP_SQL} SELECT * FROM best")
def majority_overlap(spark, d):
    return O.majority_overlap(_overlaps(spark, d), "zone", "area", "q", split_below=0.10)


@query(f"""WITH {OVERLAP_SQL}, published AS (SELECT area, sum(q) AS published FROM o GROUP BY 1),
z AS (SELECT zone, sum(q) AS q FROM o GROUP BY 1), assigned AS (SELECT area, sum(q) AS assigned FROM best JOIN z USING (zone) GROUP BY 1)
SELECT area, coalesce(assigned, 0) AS assigned, published, abs(coalesce(assigned, 0) - published) AS error FROM published LEFT JOIN assigned USING (area) ORDER BY error DESC, area LIMIT 5""")
def assignment_accuracy_top5(spark, d):
    """The five areas whose assigned amount is furthest from what they have."""
    overlaps = _overlaps(spark, d)
    best = O.majority_overlap(overlaps, "zone", "area", "q").select("zone", "area")
    assigned = overlaps.groupBy("zone").agg(F.sum("q").alias("q")).join(best, "zone").groupBy("area").agg(F.sum("q").alias("assigned"))
    published = overlaps.groupBy("area").agg(F.sum("q").alias("published"))
    out = published.join(assigned, "area", "left").na.fill(0.0, ["assigned"]).withColumn("error", F.abs(F.col("assigned") - F.col("published")))
    return out.orderBy(F.desc("error"), "area").limit(5).select("area", "assigned", "published", "error")


@query("""WITH s AS (SELECT c_nationkey AS area, list_sort(list(CASE WHEN c_acctbal > 0 AND c_acctbal < 1.5 THEN c_acctbal * 100 ELSE c_acctbal END)) AS v FROM customer GROUP BY 1)
SELECT area, round(v[len(v) // 2 + 1], 6) AS upper_median, len(v) AS n FROM s""")
def missing_electorate(spark, d):
    """The figure that stands in for a missing one: the upper middle of an area's."""
    balance = X.percent(F.col("c_acctbal"))
    customer = table(spark, d, "customer").select(F.col("c_nationkey").alias("area"), "c_acctbal")
    middle = O.upper_median(customer, ["area"], balance).select("area", F.round("median", 6).alias("upper_median"))
    return middle.join(customer.groupBy("area").agg(F.count("*").alias("n")), "area")


@query(f"""WITH {VOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY votes DESC, party) AS rk FROM votes)
SELECT party, sum(votes) AS votes, count(*) AS stood, count(*) FILTER (rk = 1) AS seats, round(sum(votes) / (SELECT sum(votes) FROM votes), 6) AS share FROM r GROUP BY 1""")
def election_summary(spark, d):
    by_area = W.partitionBy("area").orderBy(F.desc("votes"), "party")
    parties = votes(spark, d).withColumn("rank", F.row_number().over(by_area)).groupBy("party").agg(F.sum("votes").alias("votes"), F.count("*").alias("stood"), F.count_if(F.col("rank") == 1).alias("seats"))
    return parties.withColumn("share", F.round(F.col("votes") / F.sum("votes").over(W.partitionBy()), 6))


@query("""WITH f AS (SELECT c_mktsegment AS name, min(c_custkey) AS first FROM customer GROUP BY 1) SELECT name, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS code FROM f""")
def dictionary_encode(spark, d):
    return O.encode(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "name"), "name", "c_custkey")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, q, coalesce(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s""")
def running_totals(spark, d):
    stages = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return O.running_totals(stages, ["l_orderkey"], ["l_linenumber"], "q")


@query(f"""WITH {VOTES_SQL}, t AS (SELECT area, sum(votes) AS x FROM votes GROUP BY 1), m AS (SELECT min(x) AS lo, max(x) AS hi FROM t),
p AS (SELECT lo, hi, CASE WHEN hi > lo THEN 0.08 * (hi - lo) WHEN hi <> 0 THEN 0.05 * abs(hi) ELSE 1 END AS pad FROM m)
SELECT area, x, row_number() OVER (ORDER BY x DESC, area) AS place, round((x - greatest(0, lo - pad)) / (hi + pad - greatest(0, lo - pad)), 6) AS bar FROM t, p""")
def result_bars(spark, d):
    """Areas by a statistic, with the length of their bars between padded ends."""
    totals = votes(spark, d).groupBy("area").agg(F.sum("votes").alias("x"))
    ends = totals.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    pad = F.when(F.col("hi") > F.col("lo"), 0.08 * (F.col("hi") - F.col("lo"))).when(F.col("hi") != 0, 0.05 * F.abs("hi")).otherwise(1.0)
    ends = ends.select(F.greatest(F.lit(0.0), F.col("lo") - pad).alias("low"), (F.col("hi") + pad).alias("high"))
    place = F.row_number().over(W.orderBy(F.desc("x"), "area")).cast("long")
    return totals.join(F.broadcast(ends), F.lit(True)).select("area", "x", place.alias("place"), F.round((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")), 6).alias("bar"))


@query(f"""WITH {VOTES_SQL}, n AS (SELECT n_name AS party, sum(votes) AS votes FROM votes JOIN nation ON n_nationkey = area GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY votes DESC, party) AS rk FROM n), k AS (SELECT *, party = 'NATION_7' AS pin FROM r),
s AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY pin DESC, rk) AS o FROM k) WHERE o <= 5)
SELECT party, votes, rk AS place, CAST(coalesce(rk - lag(rk) OVER (ORDER BY rk), rk) > 1 AS BOOLEAN) AS gap FROM s""")
def top5_with_pins(spark, d):
    """Five rows by votes, pinned ones always among them; a gap marks where places are left out."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("party"))
    totals = votes(spark, d).groupBy("area").agg(F.sum("votes").alias("votes")).join(F.broadcast(names), "area")
    ranked = totals.withColumn("place", F.row_number().over(W.orderBy(F.desc("votes"), "party")).cast("long")).withColumn("pin", F.col("party") == "NATION_7")
    shown = ranked.orderBy(F.desc("pin"), "place").limit(5)
    step = F.col("place") - F.lag("place").over(W.orderBy("place"))
    return shown.select("party", "votes", "place", (F.coalesce(step, F.col("place")) > 1).alias("gap"))


@query("""SELECT 'orders without customer' AS check, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'duplicate orders', (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders)
UNION ALL SELECT 'negative quantity', (SELECT count(*) FROM lineitem WHERE l_quantity < 0)
UNION ALL SELECT 'nations without region', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region))
UNION ALL SELECT 'balance out of range', (SELECT count(*) FROM customer WHERE c_acctbal NOT BETWEEN -1000 AND 10000)
UNION ALL SELECT 'repeated order lines', (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)""")
def quality_assertions(spark, d):
    """Counts of rows that break a rule; 0 is fine."""
    o, c, l, n, r = (table(spark, d, t) for t in ("orders", "customer", "lineitem", "nation", "region"))
    twice = o.groupBy("o_orderkey").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    lines = l.groupBy("l_orderkey", "l_linenumber").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    checks = {
        "orders without customer": o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").agg(F.count("*").alias("n")),
        "duplicate orders": twice, "repeated order lines": lines,
        "negative quantity": l.agg(F.count_if(F.col("l_quantity") < 0).alias("n")),
        "nations without region": n.join(r, n["n_regionkey"] == r["r_regionkey"], "left_anti").agg(F.count("*").alias("n")),
        "balance out of range": c.agg(F.count_if(~F.col("c_acctbal").between(-1000, 10000)).alias("n")),
    }
    out = None
    for name, found in checks.items():
        row = found.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
