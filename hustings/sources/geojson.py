"""GeoJSON in and out: features as a table of vertices, and back on a grid of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RING = "array<array<double>>"
COLLECTION = "struct<type:string,features:array<struct<type:string,properties:map<string,string>,geometry:string>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """The features of all collections under a path: properties (a map of texts) and geometry (JSON text, null if it has none)."""
    text = spark.read.text(path, wholetext=True)
    return features_of(text.select(F.col("value").alias("json")))


def features_of(collections: DataFrame, column: str = "json") -> DataFrame:
    """The same of collections in a column."""
    return collections.select(F.explode(F.from_json(column, COLLECTION)["features"]).alias("f")).select("f.properties", "f.geometry")


def vertices(found: DataFrame, code: str) -> DataFrame:
    """Features -> (zone, part, ring, seq, x, y): every ring, holes included, of polygons and multipolygons, closing vertices left out."""
    kind = F.get_json_object("geometry", "$.type")
    raw = F.get_json_object("geometry", "$.coordinates")
    parts = F.when(kind == "MultiPolygon", F.from_json(raw, f"array<array<{RING}>>")).when(kind == "Polygon", F.array(F.from_json(raw, f"array<{RING}>")))
    rings = found.select(F.col("properties")[code].alias("zone"), F.posexplode(parts).alias("part", "rings")).select("zone", "part", F.posexplode("rings").alias("ring", "points"))
    ended = F.element_at("points", 1) == F.element_at("points", -1)
    open_ring = F.when((F.size("points") > 1) & ended, F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points"))
    return rings.select("zone", "part", "ring", F.posexplode(open_ring).alias("seq", "p")).select("zone", "part", "ring", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def ring_faults(found: DataFrame, code: str) -> DataFrame:
    """Rings of fewer than four points, or that don't come back to their first: (zone, part, ring, points, closed)."""
    kind = F.get_json_object("geometry", "$.type")
    raw = F.get_json_object("geometry", "$.coordinates")
    parts = F.when(kind == "MultiPolygon", F.from_json(raw, f"array<array<{RING}>>")).otherwise(F.array(F.from_json(raw, f"array<{RING}>")))
    rings = found.select(F.col("properties")[code].alias("zone"), F.posexplode(parts).alias("part", "rings")).select("zone", "part", F.posexplode("rings").alias("ring", "points"))
    facts = rings.select("zone", "part", "ring", F.size("points").alias("points"), (F.element_at("points", 1) == F.element_at("points", -1)).alias("closed"))
    return facts.filter("points < 4 or not closed")


def as_features(corners: DataFrame, properties: DataFrame, zone: str = "zone", digits: int = 5) -> DataFrame:
    """(zone, part, ring, seq, x, y) and properties by zone -> zone and `feature`, GeoJSON text with coordinates on a grid, halves to
    even. A zone is joined with its properties by zone; one without vertices has no geometry."""
    point = F.array(F.bround("x", digits), F.bround("y", digits))
    rings = corners.groupBy("zone", "part", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", point.alias("p")))).alias("s"))
    closed = rings.withColumn("points", F.transform("s", lambda v: v["p"])).withColumn("points", F.concat("points", F.slice("points", 1, 1)))
    parts = closed.groupBy("zone", "part").agg(F.sort_array(F.collect_list(F.struct("ring", "points"))).alias("r")).select("zone", "part", F.transform("r", lambda v: v["points"]).alias("rings"))
    whole = parts.groupBy("zone").agg(F.sort_array(F.collect_list(F.struct("part", "rings"))).alias("p")).select(F.col("zone").alias("_zone"), F.transform("p", lambda v: v["rings"]).alias("coordinates"))
    columns = [c for c in properties.columns if c != zone]
    joined = properties.join(whole, properties[zone] == whole["_zone"], "left")
    geometry = F.when(F.col("coordinates").isNotNull(), F.struct(F.lit("MultiPolygon").alias("type"), F.col("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col(zone).alias("code"), *columns).alias("properties"), geometry.alias("geometry"))
    return joined.select(zone, F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_collection(made: DataFrame, path: str, zone: str = "zone") -> None:
    """Features as one collection in one text file, in order of zone. Maps of an area have thousands of features."""
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(zone).alias("z"), F.col("feature").alias("f")))), lambda v: v["f"]), ",")
    text: Column = F.concat(F.lit('{"type":"FeatureCollection","features":['), every, F.lit("]}"))
    made.agg(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def snapped_duplicates(corners: DataFrame, digits: int = 5) -> DataFrame:
    """Neighbouring vertices of a ring that a grid makes one: (zone, part, ring, seq)."""
    by = W.partitionBy("zone", "part", "ring").orderBy("seq")
    at = F.struct(F.bround("x", digits), F.bround("y", digits))
    return corners.withColumn("_same", at == F.lag(at).over(by)).filter("_same").select("zone", "part", "ring", "seq")
