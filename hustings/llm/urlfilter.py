"""URL filters: a sort-merge range join of urls with prefix rules.

A host is keyed by its labels in reverse, each followed by LABEL_END, so that a rule's host and all
its subdomains are one interval of keys, [key, key with its last LABEL_END turned into AFTER). Such
intervals nest or are disjoint. A sweep over the sorted boundaries keeps the stack of the rules that
are open; each boundary carries the stack that holds behind it. Urls are merged with the boundaries
in key order, and each takes over the stack of the last boundary before it; of its rules, those whose
path starts the url's path fit, and the longest wins (host and path together; then the longer host).

Work is dealt out by (bucket of the two last labels, salt), so a host with a third of all urls is swept in
`salts` tasks; boundaries, which are few beside urls, are copied to each salt, those of rules with
one label to each bucket. No url meets more rules than are open at its key.

Cases: a null url, or one without ://, has an empty host and path, and fits no rule: hosts of rules are
not empty. Repeated urls are judged each. Equal rules count once; of rules alike in host and path, block
stands before allow. Hosts with control characters can only widen a stack: each rule is held against the
host itself. Other columns of the input are passed by, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower

LABEL_END, AFTER = "\x01", "\x02"
#: The rules of op1, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """Labels in reverse, each ended."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), LABEL_END), F.lit(LABEL_END))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Rules as rows of literals; a rule without a host or with a control character in it is refused."""
    for verdict, host, _ in rules:
        if verdict not in ("allow", "block") or not host or any(c < "!" for c in host):
            raise ValueError(f"not a rule: {verdict} {host!r}")
    return spark.range(1).select(
        F.inline(F.array(*[F.struct(*map(F.lit, r)) for r in rules])).alias("verdict", "host", "path")
    )


def boundaries(rules: DataFrame) -> DataFrame:
    """Where the stack of open rules changes, and the stack from there on: (key, labels, stack)."""
    by_host = (
        rules.groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .groupBy("host")
        .agg(F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    )
    labels = F.split("host", "\\.")
    enclosing = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    chain = by_host.select("host", F.explode(enclosing).alias("outer_host"))
    stacks = (
        chain.join(by_host.select(F.col("host").alias("outer_host"), "own"), "outer_host")
        .groupBy("host")
        .agg(
            F.flatten(F.collect_list("own")).alias("open"),
            F.flatten(F.collect_list(F.when(F.col("outer_host") != F.col("host"), F.col("own")))).alias("after"),
        )
        .select("host", "open", "after", key_of(F.col("host")).alias("key"))
    )
    start = F.struct(F.col("key").alias("key"), F.col("open").alias("stack"))
    close = F.concat(F.expr("left(key, length(key) - 1)"), F.lit(AFTER))
    end = F.struct(close.alias("key"), F.col("after").alias("stack"))
    return stacks.select("host", F.inline(F.array(start, end)))


#: Rows that a sweep is to have at most, if hosts are even, and the fewest sweeps of a bucket.
SWEEP_ROWS, LEAST_SALTS = 250_000, 64


def judged(urls: DataFrame, rules: DataFrame, default: str = "allow", buckets: int = 8, salts: int | None = None) -> DataFrame:
    """urls (page_id, url) -> page_id, host, path, rule, verdict. One shuffle of the urls.

    Rows of a bucket of hosts are dealt over `salts` sweeps by their place, as many as the number of rows asks for, so that neither a host nor a
    row that stands there very often fills one."""
    salts = salts or max(LEAST_SALTS, -(-urls.count() // (buckets * SWEEP_ROWS)))
    host, path = host_path(F.col("url"))
    keyed = urls.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("place"))

    def bucket(of: Column) -> Column:
        return F.pmod(F.xxhash64(F.substring_index(of, ".", -2)), F.lit(buckets)).cast("int")

    points = keyed.select(
        bucket(F.col("host")).alias("bucket"),
        F.pmod(F.xxhash64("page_id", "path", "place"), F.lit(salts)).cast("int").alias("salt"),
        key_of(F.col("host")).alias("key"),
        F.lit(1).alias("kind"),
        F.struct("page_id", "host", "path").alias("page"),
        F.lit(None).cast("array<struct<host:string,path:string,verdict:string>>").alias("stack"),
    )
    all_buckets = F.sequence(F.lit(0), F.lit(buckets - 1))
    own = F.when(F.locate(".", F.col("host")) == 0, all_buckets).otherwise(F.array(bucket(F.col("host"))))
    marks = (
        boundaries(rules)
        .select(F.explode(own).alias("bucket"), "key", "stack")
        .select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", "stack")
        .select("bucket", "salt", "key", F.lit(0).alias("kind"), F.lit(None).cast(points.schema["page"].dataType).alias("page"), "stack")
    )
    order = W.partitionBy("bucket", "salt").orderBy("key", "kind")
    open_rules = F.last("stack", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    swept = points.unionByName(marks).withColumn("open", open_rules).filter("kind = 1")

    def fits(r: Column) -> Column:
        at = F.col("page.host")
        return ((at == r["host"]) | F.endswith(at, F.concat(F.lit("."), r["host"]))) & F.startswith(
            F.col("page.path"), r["path"]
        )

    ranked = F.transform(
        F.filter(F.coalesce("open", F.array().cast(swept.schema["open"].dataType)), fits),
        lambda r: F.struct(
            (F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("host_size"),
            r["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict"),
        ),
    )
    best = swept.select("page.*", F.array_max(ranked).alias("best"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.concat(F.col("best.host"), F.col("best.path")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the url of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, rule_table(spark, RULES))


OP1_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
keyed AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM keyed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM keyed LEFT JOIN best USING (page_id)
"""
