"""Column functions that normalise labels, names and printed numbers."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def slug(label: Column, longest: int = 40) -> Column:
    """A column name from a label: no bracketed notes, lower case, runs of other signs as one underscore."""
    plain = F.lower(F.regexp_replace(label, r"\([^)]*\)", ""))
    return F.substring(F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "_"), F.lit("_")), 1, longest)


def plain_spaces(text: Column) -> Column:
    """Dashes and quotes as ASCII, white space of any script as single spaces. Canonical composition is `composed`."""
    return F.btrim(F.regexp_replace(F.translate(text, "–—’", "--'"), r"(?U)\s+", " "))


def composed(text: Column) -> Column:
    """Unicode's composed form; Spark has no built-in for it."""

    def compose(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(compose, StringType())(text)


def area_key(name: Column) -> Column:
    """The letters of a name, for joins between spellings: lower case, & as and, nothing else."""
    return F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), "[^a-z]", "")


def parent_area(zone_name: Column) -> Column:
    """Some_Place_N5 -> Some Place."""
    return F.replace(F.regexp_replace(zone_name, r"_[A-Z]+\d+$", ""), F.lit("_"), F.lit(" "))


def without_digits(code: Column) -> Column:
    """A code without the digits it ends in."""
    return F.regexp_replace(code, r"\d+$", "")


def printed_number(text: Column) -> Column:
    """1,234 -> 1234.0; null for what isn't a number."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def whole_number(text: Column) -> Column:
    """A printed number rounded to a whole one, halves to even; null for what isn't a number."""
    return F.bround(printed_number(text), 0).cast("long")


def amount(text: Column) -> Column:
    """A printed number; 0 where nothing is printed, null for what isn't a number."""
    return F.when(F.btrim(F.coalesce(text, F.lit(""))).isin("", "-"), 0.0).otherwise(printed_number(text))


def normal_spaces(text: Column) -> Column:
    """`plain_spaces` of the composed form."""
    return plain_spaces(composed(text))


def file_stem(path: Column) -> Column:
    """The name of a file without folders and ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def percent(share: Column) -> Column:
    """Shares printed as fractions (0 to 1.5) in percent."""
    return F.when((share > 0) & (share < 1.5), share * 100).otherwise(share)


def skip_row(label: Column) -> Column:
    """Rows of a count sheet that aren't candidates."""
    return label.rlike("(?i)^(non.?transferable|total|stage|exhausted|result|quota)")


def mapped(raw: Column, names: Mapping[str, str]) -> Column:
    """The standard label of a raw one: as it is, without its dot, or with one; null if none is known."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    low = F.lower(F.btrim(raw))
    tries = (low, F.rtrim(low, F.lit(".")), F.concat(F.rtrim(low, F.lit(".")), F.lit(".")))
    return F.coalesce(*[F.try_element_at(table, key) for key in tries])


def set_name(members: Column, special: Mapping[str, str]) -> Column:
    """A merger's name: special by its set of members, else the members joined."""
    key = F.array_join(F.array_sort(members), "+")
    table = F.create_map(*[F.lit(x) for pair in special.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.array_join(members, "-"))
