"""Writers: sorted CSV, line JSON, nested tables and single documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, key: str) -> None:
    """One sorted file with a header; nulls as empty fields. For tables of zones, thousands of rows."""
    df.orderBy(key).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_cube(cells: DataFrame, path: str, name: str, zone: str, code: str, value: str, categories: list[str]) -> None:
    """Cells as one nested table that `flatten_cube` reads: zones in order, values row by row."""
    wide = cells.groupBy(F.col(zone).cast("string").alias("zone")).pivot(code, categories).agg(F.sum(value)).na.fill(0)
    rows = wide.agg(F.sort_array(F.collect_list(F.struct("zone", F.array(*[F.col(f"`{c}`").cast("double") for c in categories]).alias("v")))).alias("rows"))
    zones = F.transform("rows", lambda r: F.struct(r["zone"].alias("code"), r["zone"].alias("label")))
    labels = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(c).alias("label")) for c in categories])

    def dimension(label: str, items):
        return F.struct(F.size(items).alias("count"), F.struct(F.lit(label).alias("name"), F.lit(label).alias("label")).alias("variable"), items.alias("categories"))

    body = F.struct(F.array(dimension(zone, zones), dimension(code, labels)).alias("dimensions"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("values"))
    rows.select(F.to_json(F.struct(F.lit(name).alias("name"), F.lit(name).alias("label"), body.alias("table")))).coalesce(1).write.mode("overwrite").text(path)


def write_document(df: DataFrame, path: str, key: str, value: str) -> None:
    """A table of zones as one JSON object by key: {"zone": {...}, ...}."""
    df.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value)))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def snapped(vertices: DataFrame, digits: int = 5) -> DataFrame:
    """Coordinates on a grid of so many digits, halves to even."""
    return vertices.withColumns({c: F.bround(c, digits) for c in ("x", "y")})
