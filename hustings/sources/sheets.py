"""Count sheets as stages: wide sheets by their headers, printed ones by the totals that prove them right."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def wide_stages(cells: DataFrame, names: DataFrame, nontransferable: str = "^non.?transferable", label_columns: int = 3) -> DataFrame:
    """cells of workbooks (path, sheet, row, col, text, number) and candidates (path, sheet, name) -> path, sheet, stage, candidate (null for
    what wasn't transferred), transfer.

    A row with `Stage 1` in its first columns begins a block; its `Stage n` cells name columns. A long count goes on in a further block, which repeats the
    last stage: the first block's is kept. Stage 1 is no transfer. A sheet that lacks a candidate or the row of what wasn't transferred is refused.
    """
    by = ["path", "sheet"]
    text = F.btrim("text")
    number = F.regexp_extract(text, r"(?i)^stage\s+(\d+)$", 1)
    heads = cells.withColumn("stage", F.when(number != "", number.cast("int"))).filter("stage is not null")
    blocks = heads.withColumn("first", F.min("col").over(W.partitionBy(*by, "row"))).filter("first < 6").select(*by, F.col("row").alias("block"), "col", "stage")
    starts = blocks.select(*by, "block").distinct()
    after = starts.withColumn("next", F.lead("block").over(W.partitionBy(*by).orderBy("block")))
    inside = cells.join(after, by).filter((F.col("row") > F.col("block")) & (F.col("row") < F.coalesce("next", F.lit(1 << 30))))
    label = inside.filter(F.col("col") < label_columns).select(*by, "block", "row", F.lower(text).alias("label"))
    own = names.select(*by, F.col("name").alias("candidate"), F.lower(F.btrim("name")).alias("label"))
    lines = label.join(own, [*by, "label"]).select(*by, "block", "row", "candidate")
    rest = label.filter(F.col("label").rlike(nontransferable)).groupBy(*by, "block").agg(F.min("row").alias("row")).withColumn("candidate", F.lit(None).cast("string"))
    rows = lines.unionByName(rest)
    wanted = names.groupBy(*by).agg(F.count_distinct("name").alias("wanted"))
    found = starts.join(rows.groupBy(*by, "block").agg(F.count_distinct("candidate").alias("found"), F.count_if(F.col("candidate").isNull()).alias("nt")), [*by, "block"], "left").join(wanted, by)
    fine = found.filter("found = wanted and nt = 1").select(*by, "block")
    lacking = found.filter("found is null or found <> wanted or nt <> 1").select(*by).distinct()
    values = rows.join(fine, [*by, "block"], "left_semi").join(blocks, [*by, "block"]).join(cells.select(*by, "row", "col", "number"), [*by, "row", "col"], "left")
    first = values.filter("stage > 1").withColumn("_first", F.min("block").over(W.partitionBy(*by, "stage"))).filter("block = _first")
    return first.join(lacking, by, "left_anti").select(*by, "stage", "candidate", F.coalesce("number", F.lit(0.0)).alias("transfer"))


def refused(cells: DataFrame, stages: DataFrame) -> DataFrame:
    """Sheets that have stages by their headers but gave none."""
    headed = cells.filter(F.btrim("text").rlike(r"(?i)^stage\s+1$")).select("path", "sheet").distinct()
    return headed.join(stages.select("path", "sheet").distinct(), ["path", "sheet"], "left_anti")


def chained_columns(grid: DataFrame, first: DataFrame, starts: Sequence[int], tolerance: float = 0.02) -> DataFrame:
    """Where the pairs of columns (transfer, total) of a printed sheet begin: grid (area, candidate, col, value) and first preferences (area, candidate,
    first_pref) -> area, start, ok, bad, transfers from there as (candidate, stage, transfer).

    For each start, transfers add up along a row, and printed totals either agree or don't; the start with most that agree, less five for each that
    doesn't, is taken. An area whose best start still has a total that disagrees gives no stages.
    """
    tries = grid.join(first, ["area", "candidate"]).withColumn("start", F.explode(F.array(*map(F.lit, starts)))).filter("col >= start")
    step = tries.withColumns({"stage": ((F.col("col") - F.col("start")) / 2).cast("int"), "is_total": (F.col("col") - F.col("start")) % 2 == 1})
    pairs = step.groupBy("area", "candidate", "start", "stage").agg(F.max(F.when(~F.col("is_total"), F.col("value"))).alias("transfer"), F.max(F.when(F.col("is_total"), F.col("value"))).alias("total"), F.first("first_pref").alias("first_pref"))
    running = F.col("first_pref") + F.sum(F.coalesce("transfer", F.lit(0.0))).over(W.partitionBy("area", "candidate", "start").orderBy("stage").rowsBetween(W.unboundedPreceding, 0))
    agrees = F.when(F.col("total").isNotNull(), F.abs(F.col("total") - running) < tolerance)
    proved = pairs.withColumn("agrees", agrees)
    marks = proved.groupBy("area", "start").agg(F.count_if("agrees").alias("ok"), F.count_if(~F.col("agrees")).alias("bad"))
    best = marks.groupBy("area").agg(F.max(F.struct((F.col("ok") - 5 * F.col("bad")).alias("mark"), (-F.col("start")).alias("less"), "ok", "bad")).alias("b")).select("area", (-F.col("b.less")).alias("start"), "b.ok", "b.bad")
    kept = proved.join(best.filter("bad = 0"), ["area", "start"])
    moved = F.max(F.abs(F.coalesce("transfer", F.lit(0.0)))).over(W.partitionBy("area", "stage")) > 1e-9
    numbered = kept.withColumn("_moved", moved).filter("_moved").withColumn("number", F.dense_rank().over(W.partitionBy("area").orderBy("stage")) + 1)
    return numbered.select("area", "start", "ok", "candidate", F.col("number").alias("stage"), F.coalesce("transfer", F.lit(0.0)).alias("transfer"))


def rules(edges: DataFrame, by: Sequence[str], at: str, apart: float = 2.0) -> DataFrame:
    """Ruled lines out of the edges that a page draws: edges within `apart` of the one before are one line, at its first edge."""
    order = W.partitionBy(*by).orderBy(at)
    first = F.coalesce(F.col(at) - F.lag(at).over(order) > apart, F.lit(True))
    return edges.select(*by, at).distinct().withColumn("_new", first).withColumn("line", F.sum(F.col("_new").cast("int")).over(order)).groupBy(*by, "line").agg(F.min(at).alias(at))


def page_cells(glyphs: DataFrame, columns: DataFrame, jump: float = 1.0) -> DataFrame:
    """Glyphs in the order drawn (page, band, seq, text, x0, x1) and column lines (page, x) -> page, band, col, text: a cell goes on as long as the next
    glyph begins where the last ended; only after a gap or a jump back is the column looked up."""
    drawn = W.partitionBy("page", "band").orderBy("seq")
    breaks = F.coalesce(F.abs(F.col("x0") - F.lag("x1").over(drawn)) > jump, F.lit(True))
    pieces = glyphs.withColumn("_break", breaks).withColumn("piece", F.sum(F.col("_break").cast("int")).over(drawn))
    first = pieces.groupBy("page", "band", "piece").agg(F.min_by("x0", "seq").alias("x0"), F.min("seq").alias("seq"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda g: g["text"]), "").alias("text"))
    lines = columns.groupBy("page").agg(F.sort_array(F.collect_list("x")).alias("lines"))
    placed = first.join(lines, "page").withColumn("col", F.size(F.filter("lines", lambda x: x <= F.col("x0") + jump)) - 1)
    return placed.groupBy("page", "band", "col").agg(F.btrim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda g: g["text"]), "")).alias("text"))


def units(readers: dict[str, DataFrame]) -> DataFrame:
    """Stages of several formats as one table, by election."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("election", F.lit(name)) for name, df in readers.items()))
