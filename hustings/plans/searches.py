"""Searches for maps over the lattice: no SQL says the same; tests hold their rows, connectedness and scores to the scorer's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.search import Settings, search
from .bindings import lattice
from .graphs import _edges

QUERIES, ORACLES = {}, {}
RUNS = ((0, 4, 7), (1, 18, 7))
#: Cells are squares of one unit; all terms of the score that the lattice has data for.
SETTINGS = Settings(steps=2000, people_weight=1.0, cut_weight=1.0, shape_weight=0.5, people_shape_weight=0.5)


def zones_of(spark, d):
    return lattice(spark, d).select("zone", (1 + F.col("p_size") % 7).alias("people"), F.lit(1.0).alias("area"), "x", "y")


def _searched(spark, d, mode):
    runs = spark.createDataFrame(list(RUNS), "run int, n int, seed int")
    return search(zones_of(spark, d), _edges(spark, d), runs, SETTINGS, mode).select("run", "n", "seed", "zone", "region", F.round("score", 6).alias("score"))


def search_build(spark, d):
    """Regions grown from far seeds."""
    return _searched(spark, d, "build")


def search_optimise(spark, d):
    """Grown, then improved zone by zone."""
    return _searched(spark, d, "optimise")


def search_recombine(spark, d):
    """Grown, then improved by moves and recombinations of two regions."""
    return _searched(spark, d, "recombine")


QUERIES.update({f.__name__: f for f in (search_build, search_optimise, search_recombine)})
