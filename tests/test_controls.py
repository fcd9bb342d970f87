import math

import pytest
from pyspark.sql import functions as F

from hustings.functions import controls as C
from hustings.operators import tables as T
from hustings.operators.search import Settings


def test_weights_stand_on_the_ladder():
    assert [C.nearest_weight(w) for w in (0.0, 0.191, 0.498, 0.52, 0.73, 3.14, 7.3, 9.75)] == [0, 0.19, 0.5, 0.5, 0.75, 3.1, 7.5, 10.0]
    assert all(C.nearest_weight(w) == w for w in C.WEIGHTS)


def test_sliders():
    got = C.settings_from({"people_weight": 0.0, "cut_weight": -1.0, "shape_weight": -0.719, "temperature": 0.5, "recombine_every": 1.4})
    assert got == {"people_weight": 1.0, "cut_weight": 0.0, "shape_weight": 0.19, "temperature": 10**0.5, "recombine_every": 25}
    assert C.settings_from({"recombine_every": 3.0})["recombine_every"] == math.inf and C.speed(-1) == 0.01 and C.speed(1) == 10
    assert Settings(**C.settings_from({"people_weight": 0.3, "recombine_every": 3.0})).recombine_every == math.inf
    assert C.one_compactness(0.1, 1.0, 10.0) == 1.0 and C.one_compactness(0, 1, 1) == 0 and set(C.three_weights(0.73).values()) == {0.75}
    for bad in ({"speed": 0.0}, {"cut_weight": 2.0}):
        with pytest.raises(ValueError):
            C.settings_from(bad)


def test_colours_and_ages(spark):
    got = [r["c"] for r in spark.range(2).orderBy("id").select(C.colour(F.col("id")).alias("c")).collect()]
    assert got == ["hsl(0.0, 62%, 56%)", "hsl(137.5, 71%, 65%)"]
    cells = spark.createDataFrame([("z", "17 years", 5.0), ("z", "18", 6.0), ("z", "65+", 2.0), ("y", "3", 1.0)], "zone string, code string, value double")
    assert {r["zone"]: (r["adults"], r["old_share"]) for r in T.age_shares(cells).collect()} == {"z": (8.0, 0.25), "y": (0.0, 0.0)}
