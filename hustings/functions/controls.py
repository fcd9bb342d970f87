"""Settings of a search from where sliders stand: each control is a ladder of the values it can take."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far apart weights are in hundredths, up to which weight.
RUNGS = ((0.5, 1), (1.0, 5), (5.0, 10), (1000.0, 50))
#: Degrees of hue from region to region, saturations and lights that they take in turn.
GOLDEN_ANGLE, SATURATIONS, LIGHTS = 137.508, (62, 71, 80), (56, 65)


def _weights() -> list[float]:
    out, at = [0.0], 0
    for end, apart in RUNGS:
        while at + apart <= round(end * 100):
            at += apart
            out.append(at / 100)
    return out


WEIGHTS = _weights()


def nearest_weight(weight: float) -> float:
    """The weight on the ladder that is next to this one, the upper of two alike."""
    above = min(bisect_left(WEIGHTS, weight), len(WEIGHTS) - 1)
    below = max(0, above - 1)
    return WEIGHTS[above] if WEIGHTS[above] - weight <= weight - WEIGHTS[below] + 1e-12 else WEIGHTS[below]


@dataclass(frozen=True)
class Slider:
    """A logarithmic slider from `low` to `high`, in powers of ten. `off` is the end at which it is switched off, if any: "low" or "high"."""

    low: float
    high: float
    off: str | None = None

    def value(self, place: float) -> float:
        if not self.low - 1e-9 <= place <= self.high + 1e-9:
            raise ValueError(f"place {place} is not between {self.low} and {self.high}")
        if self.off == "low" and place - self.low < 1e-9:
            return 0.0
        if self.off == "high" and self.high - place < 1e-9:
            return math.inf
        return math.pow(10, place)


#: The controls of a search, by the field of its settings. Population has no off.
SLIDERS = {
    "people_weight": Slider(-1.0, 1.0), "cut_weight": Slider(-1.0, 1.0, "low"), "shape_weight": Slider(-1.0, 1.0, "low"),
    "people_shape_weight": Slider(-1.0, 1.0, "low"), "temperature": Slider(-1.0, 1.0), "recombine_every": Slider(0.0, 3.0, "high"),
}


def settings_from(places: Mapping[str, float]) -> dict[str, float]:
    """Fields of a search's Settings from the places of its sliders: weights on the ladder, whole moves between recombinations."""
    if unknown := set(places) - set(SLIDERS):
        raise ValueError(f"no slider {sorted(unknown)[0]}")
    out = {}
    for name, place in places.items():
        value = SLIDERS[name].value(place)
        out[name] = nearest_weight(value) if name.endswith("weight") else value if math.isinf(value) or name == "temperature" else int(value + 0.5)
    return out


def speed(place: float) -> float:
    """Moves a second beside the usual: two decades below the middle of the slider, one above."""
    return math.pow(10, max(place, 0.0) + 2 * min(place, 0.0))


def one_compactness(land: float, people: float, cut: float) -> float:
    """One weight for three: their geometric mean; 0 if one of them is off."""
    return nearest_weight(math.prod((land, people, cut)) ** (1 / 3))


def three_weights(compactness: float) -> dict[str, float]:
    """The same weight for land, people and cuts."""
    return dict.fromkeys(("shape_weight", "people_shape_weight", "cut_weight"), nearest_weight(compactness))


def colour(region: Column) -> Column:
    """Hues a golden angle apart, saturations and lights in turn."""
    turn = lambda values: F.get(F.array(*map(F.lit, values)), (region % len(values)).cast("int"))
    return F.format_string("hsl(%.1f, %d%%, %d%%)", (region * GOLDEN_ANGLE) % 360, turn(SATURATIONS), turn(LIGHTS))
