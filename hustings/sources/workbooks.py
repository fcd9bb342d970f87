"""Workbooks (OOXML) as tables of cells, and tables of candidates out of such cells.

Files are read by Spark as binary, so any store it reads will do; a workbook is parsed where its bytes are, with
the standard library alone.
"""

from __future__ import annotations

import functools
import io
import itertools
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row int, col int, text string, number double"


def place(reference: str) -> tuple[int, int]:
    """A1 -> (0, 0), as (row, column): letters are a number without a zero, to the base 26."""
    letters = reference.rstrip("0123456789")
    if not letters or letters == reference or not letters.isalpha():
        raise ValueError(f"{reference!r} is no cell")
    column = sum((ord(c) & 31) * 26**i for i, c in enumerate(reversed(letters)))
    return int(reference[len(letters) :]) - 1, column - 1


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _elements(book: zipfile.ZipFile, name: str, wanted: frozenset[str], begun: frozenset[str] = frozenset()) -> Iterator[ElementTree.Element]:
    """The elements of these names at their ends, or where they begin, one by one; each is emptied once it has ended."""
    with book.open(name) as file:
        for event, element in ElementTree.iterparse(file, events=("start", "end")):
            tag = _tag(element)
            if tag in (begun if event == "start" else wanted):
                yield element
            if event == "end" and tag in wanted | begun:
                element.clear()


def _plain_text(element: ElementTree.Element) -> str:
    """All runs of a rich text, without its phonetic ones."""
    spoken = {id(t) for r in element.iter() if _tag(r) == "rPh" for t in r.iter()}
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t" and id(t) not in spoken)


class Workbook:
    """A workbook's sheets, each read in one pass without holding it; shared texts are read once."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        files = set(self.zip.namelist())
        self.texts = [_plain_text(e) for e in _elements(self.zip, "xl/sharedStrings.xml", frozenset({"si"}))] if "xl/sharedStrings.xml" in files else []
        parts = {e.get("Id"): posixpath.normpath(posixpath.join("/xl", e.get("Target"))).lstrip("/") for e in _elements(self.zip, "xl/_rels/workbook.xml.rels", frozenset({"Relationship"}))}
        linked = lambda e: next(v for k, v in e.attrib.items() if k.endswith("}id"))
        self.sheets = {e.get("name"): parts[linked(e)] for e in _elements(self.zip, "xl/workbook.xml", frozenset({"sheet"}))}

    def _value(self, cell: ElementTree.Element) -> tuple[str, float | None] | None:
        """Text and number of a cell; none if it is empty, or a formula without a kept value."""
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return _plain_text(cell), None
        raw = next((v.text for v in cell if _tag(v) == "v"), None)
        if raw is None:
            return None
        if kind == "s":
            return self.texts[int(raw)], None
        if kind == "b":
            return ("TRUE" if raw == "1" else "FALSE"), None
        if kind != "n":
            return raw, None
        number = float(raw)
        return (f"{number:.0f}" if number.is_integer() else raw), number

    def cells(self, sheet: str, fill_merged: bool = False) -> Iterator[tuple[int, int, str, float | None]]:
        """(row, column, text, number) of each cell with a value. Cells and rows without a reference follow the last one. With
        `fill_merged`, all cells of a merged range have its first one's value."""
        at, heads = [-1, -1], {}
        for element in _elements(self.zip, self.sheets[sheet], frozenset({"c", "mergeCell"}), begun=frozenset({"row"})):
            name = _tag(element)
            if name == "row":
                at = [int(element.get("r")) - 1 if element.get("r") else at[0] + 1, -1]
                continue
            if name == "mergeCell":
                first, _, last = element.get("ref").partition(":")
                (top, left), (bottom, right) = place(first), place(last or first)
                if fill_merged and (top, left) in heads:
                    for row, col in itertools.product(range(top, bottom + 1), range(left, right + 1)):
                        if (row, col) != (top, left):
                            yield (row, col, *heads[top, left])
                continue
            at = list(place(element.get("r"))) if element.get("r") else [at[0], at[1] + 1]
            if (value := self._value(element)) is not None:
                if fill_merged:
                    heads[at[0], at[1]] = value
                yield (*at, *value)


def parse(data: bytes, fill_merged: bool = False) -> Iterator[tuple[str, int, int, str, float | None]]:
    """(sheet, row, column, text, number) of each cell with a value in all sheets."""
    book = Workbook(data)
    for sheet in book.sheets:
        for cell in book.cells(sheet, fill_merged):
            yield (sheet, *cell)


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks under a path or pattern, a task for each file."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(file, *cell) for cell in parse(content)], columns=["path", "sheet", "row", "col", "text", "number"]).astype({"row": "int32", "col": "int32", "number": "float64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, CELLS)


def one(spark: SparkSession, pattern: str) -> str:
    """The one file that a pattern names; none or several are a failure."""
    found = [r["path"] for r in spark.read.format("binaryFile").load(pattern).select("path").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{pattern} must name one file")
    return found[0]


def labelled(cells: DataFrame, label: str) -> DataFrame:
    """By sheet, the first value to the right of the first cell that begins with a label, in any case."""
    by = ["path", "sheet"]
    heads = cells.filter(F.lower(F.btrim("text")).startswith(label.lower())).groupBy(*by).agg(F.min(F.struct("row", "col")).alias("at"))
    right = cells.join(heads, by).filter((F.col("row") == F.col("at.row")) & (F.col("col") > F.col("at.col")))
    return right.groupBy(*by).agg(F.min_by("text", "col").alias("text"), F.min_by("number", "col").alias("number"))


def candidate_rows(cells: DataFrame, header: str, columns: dict[str, str], stop: str = "^(total|note|\\*)", blanks: int = 1) -> DataFrame:
    """Rows under the row that holds `header`: to the first that matches `stop` in its column, repeats the header, or
    ends a run of `blanks` rows without a value there.

    columns: name in the result -> what its header begins with; one that the header's row lacks is looked for in the row below it.
    """
    by = ["path", "sheet"]
    low = F.lower(F.btrim("text"))
    top = cells.filter(low.startswith(header.lower())).groupBy(*by).agg(F.min(F.struct("row", "col")).alias("at"))
    under = cells.join(top, by).filter(F.col("row") >= F.col("at.row"))
    named = F.coalesce(*[F.when(low.startswith(begin.lower()), F.lit(name)) for name, begin in columns.items()])
    heads = under.filter(F.col("row") <= F.col("at.row") + 1).select(*by, "row", "col", named.alias("name")).filter("name is not null")
    names = heads.groupBy(*by, "name").agg(F.min(F.struct("row", "col")).alias("first")).select(*by, "name", "first.col", F.col("first.row").alias("head_row"))
    # Candidates begin below the last row that names a column.
    starts = names.groupBy(*by).agg(F.max("head_row").alias("head_row"))
    body = under.join(starts, by).filter(F.col("row") > F.col("head_row"))
    key = body.filter((F.col("col") == F.col("at.col")) & (low != "")).select(*by, "row", "head_row", low.alias("key"))
    order = W.partitionBy(*by).orderBy("row")
    gap = F.col("row") - F.coalesce(F.lag("row").over(order), F.col("head_row")) - 1
    ends = F.col("key").rlike(stop) | F.col("key").startswith(header.lower()) | (gap >= blanks)
    kept = key.withColumn("ended", F.max(ends.cast("int")).over(order)).filter("ended = 0").select(*by, "row")
    return body.join(names.drop("head_row"), [*by, "col"]).join(kept, [*by, "row"], "left_semi").groupBy(*by, "row").pivot("name", list(columns)).agg(F.first("text"))


def tables_of(cells: DataFrame, header: str, columns: dict[str, str], labels: dict[str, str], **ends) -> DataFrame:
    """Every sheet that holds candidates: its rows, with the values beside its labels (name in the result -> what the label begins with). Rows in
    which all columns are blank or 0, as templates leave them, aren't candidates."""
    rows = candidate_rows(cells, header, columns, **ends)
    filled = [F.coalesce(F.btrim(c), F.lit("")).isin("", "0") for c in columns]
    rows = rows.filter(~functools.reduce(lambda a, b: a & b, filled))
    for name, begin in labels.items():
        rows = rows.join(labelled(cells, begin).select("path", "sheet", F.coalesce(F.col("number").cast("string"), F.col("text")).alias(name)), ["path", "sheet"], "left")
    return rows
