from hustings.llm import urlfilter as U

from tests.conftest import SMALL
from tests.test_catalog import same


def test_equals_sql(spark, duck):
    same(spark, duck, U.op1_url_filters(spark, SMALL), U.OP1_SQL)


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in __import__("re").split("[/?#]", rest, maxsplit=1)[0])
    path = __import__("re").split("[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [(len(h) + len(p), len(h), h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] + best[3] if best else None, best[4] if best else "allow"


def test_against_brute_force(spark):
    rules = (("block", "a.b", "/x"), ("allow", "a.b", "/x/y"), ("block", "b", "/"), ("allow", "c.a.b", ""), ("block", "a.b", "/x/y"), ("allow", "d", "/q"))
    hosts = ["a.b", "c.a.b", "xa.b", "b", "z.b", "d", "e.d", "", "A.B", "a.b:80", "a..b", "b\x01a", "c.a\x02.b"]
    paths = ["", "/", "/x", "/x/y/z", "/q?x=/x", "?/x", "#f", "/x#y"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "a.b/x", "://a.b/x", "ftp://u@a.b/x://b/"]
    urls += urls[:5]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.judged(pages, U.rule_table(spark, rules), buckets=3, salts=4).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty_table(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string"), U.rule_table(spark, U.RULES)).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    """A row that stands there very often is judged each time; other columns are passed by."""
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "https://www.net/es/x")] * 500 + [(None, None), (2, "http://a.com" + "/x" * 20000)], "page_id long, url string")
    extras = {c: F.lit("x") for c in ("host", "path", "rule", "verdict", "salt", "key", "kind", "open", "place", "stack")}
    got = U.judged(pages.withColumns(extras), U.rule_table(spark, U.RULES)).groupBy("page_id", "rule", "verdict").count().collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "net/es/", "block", 500), (None, None, "allow", 1), (2, "com/", "allow", 1)]))
