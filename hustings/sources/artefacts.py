"""Tables and documents that one step of the pipeline hands to the next: lookups, neighbour graphs, elections, models, shares of zones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import both_ways, components
from .sinks import write_csv

ADJACENCY = "struct<meta:map<string,double>,zones:array<string>,edges:array<struct<a:string,b:string,kind:string,shared:double,gap:double,via:string>>,touches:array<struct<a:string,b:string,x:double,y:double>>>"


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header as typed columns; a value that doesn't fit its type is a failure."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def write_lookup(rows: DataFrame, path: str, key: str, published: DataFrame | None = None) -> dict[str, float]:
    """A lookup (key, area, share, split) as sorted CSV, and what is to be known of it as JSON beside it: rows, split ones, and by how
    much the zones' people (column people) fail the areas' published (area, people). The same is returned."""
    facts = rows.agg(F.count("*").cast("double").alias("rows"), F.sum(F.col("split").cast("double")).alias("split")).first().asDict()
    if published is not None:
        found = rows.groupBy("area").agg(F.sum("people").alias("found"))
        gap = F.abs(F.coalesce("found", F.lit(0.0)) - F.col("people"))
        error = published.join(found, "area", "left").agg(F.sum(gap).alias("error"), F.try_divide(F.sum(gap), F.sum("people")).alias("error_share")).first()
        facts |= error.asDict()
    write_csv(rows, f"{path}/table", key)
    document = F.struct(*[F.lit(v).alias(k) for k, v in facts.items()])
    rows.sparkSession.range(1).select(F.to_json(document).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return facts


def adjacency(zones: DataFrame, edges: DataFrame, touches: DataFrame) -> DataFrame:
    """One row of JSON: zones in order, edges (a, b, kind, shared, gap, via), point touches (a, b, x, y), and counts that describe them: zones, edges,
    boundary, crossing and touching pairs, pieces, and the least, mean and most neighbours."""
    pieces = components(zones.select("zone"), edges.select("a", "b")).agg(F.count_distinct("component").cast("double").alias("pieces"))
    degree = zones.select(F.col("zone").alias("a")).join(both_ways(edges).groupBy("a").agg(F.count("*").alias("d")), "a", "left").agg(*[f(F.coalesce("d", F.lit(0))).cast("double").alias(n) for f, n in ((F.min, "least"), (F.avg, "mean"), (F.max, "most"))])
    listed = lambda df, columns, name: df.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    every = (
        zones.agg(F.sort_array(F.collect_list(F.col("zone").cast("string"))).alias("zones"))
        .join(listed(edges.select(F.col("a").cast("string"), F.col("b").cast("string"), "kind", "shared", "gap", "via"), ("a", "b", "kind", "shared", "gap", "via"), "edges"))
        .join(listed(touches.select(F.col("a").cast("string"), F.col("b").cast("string"), "x", "y"), ("a", "b", "x", "y"), "touches"))
        .join(pieces).join(degree)
    )
    kind = lambda k: F.size(F.filter("edges", lambda e: e["kind"] == k)).cast("double")
    counts = {"zones": F.size("zones"), "edges": F.size("edges"), "boundary": kind("boundary"), "crossing": kind("crossing"), "touches": F.size("touches"), "pieces": F.col("pieces"), "least": F.col("least"), "mean": F.col("mean"), "most": F.col("most")}
    meta = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), v.cast("double"))])
    return every.select(F.to_json(F.struct(meta.alias("meta"), "zones", "edges", "touches")).alias("json"))


def read_adjacency(documents: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(zones, edges, touches) of adjacency documents; one whose counts don't fit its lists is a failure."""
    doc = documents.select(F.from_json(column, ADJACENCY).alias("d"))
    fits = (F.size("d.zones") == F.col("d.meta")["zones"]) & (F.size("d.edges") == F.col("d.meta")["edges"]) & (F.size("d.touches") == F.col("d.meta")["touches"])
    checked = doc.withColumn("bad", F.when(~F.coalesce(fits, F.lit(False)), F.raise_error(F.lit("counts don't fit the lists")))).filter("bad is null")
    return checked.select(F.explode("d.zones").alias("zone")), checked.select(F.inline("d.edges")), checked.select(F.inline("d.touches"))


def write_elections(areas: DataFrame, candidates: DataFrame, path: str, notes: Sequence[str] = ()) -> None:
    """Areas (area, electorate, valid, flags ...) and candidates (area, name, party, votes ...) as one JSON document: areas in order with their
    candidates, the most votes first, party sums in order of votes, how many areas there are and how many have flags, and notes."""
    columns = [c for c in candidates.columns if c != "area"]
    listed = candidates.groupBy("area").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), *columns))).alias("c"))
    sums = candidates.groupBy("area", "party").agg(F.sum("votes").alias("votes")).groupBy("area").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "party", "votes"))).alias("p"))
    whole = areas.join(listed, "area", "left").join(sums, "area", "left")
    without = lambda name, keep: F.transform(name, lambda x: F.struct(*[x[k].alias(k) for k in keep]))
    row = whole.select(*areas.columns, without("p", ("party", "votes")).alias("party_votes"), without("c", columns).alias("candidates"))
    every = row.agg(F.count("*").alias("areas"), F.count_if(F.size("flags") > 0).alias("flagged"), F.sort_array(F.collect_list(F.struct(*row.columns))).alias("results"))
    every.select(F.to_json(F.struct(F.array(*map(F.lit, notes)).cast("array<string>").alias("notes"), "areas", "flagged", "results")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_model(spark: SparkSession, path: str, arrays: Mapping[str, np.ndarray | Sequence | float | str]) -> None:
    """A fitted model as one JSON document: names with numbers, texts, lists or matrices."""
    import json

    plain = {k: v.tolist() if isinstance(v, np.ndarray) else list(v) if isinstance(v, tuple) else v for k, v in arrays.items()}
    spark.createDataFrame([(json.dumps(plain, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def triangle(matrix: np.ndarray, digits: int = 5) -> list[float]:
    """The upper triangle of a symmetric matrix, row by row, its diagonal included."""
    return [round(float(matrix[i, j]), digits) for i in range(len(matrix)) for j in range(i, len(matrix))]


def from_triangle(values: Sequence[float]) -> np.ndarray:
    size = int((np.sqrt(8 * len(values) + 1) - 1) / 2)
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = values
    return out + out.T - np.diag(np.diag(out))


def write_shares(shares: DataFrame, path: str, parties: Sequence[str]) -> None:
    """Shares of zones as Parquet, an array in the parties' order beside each zone."""
    shares.select("zone", F.array(*[F.col(f"`{p}`").cast("double") for p in parties]).alias("shares")).write.mode("overwrite").parquet(path)
