"""Fits over folds and regions: cross-validated penalties, predictions out of sample, regional shifts and their combination.

Folds and regions are independent, so each is one group of applyInPandas; what goes with each is a table of zones of one study area.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .estimators import fit_shift, minimise, zero_sum_basis


@dataclass(frozen=True)
class SupportModel:
    """Intercepts by party and slopes by party and feature; features are held to `low` and `high` and standardised by mean and deviation."""

    intercepts: np.ndarray
    slopes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    slack: float = 0.5

    def prepared(self, features: np.ndarray) -> np.ndarray:
        width = self.slack * (self.high - self.low)
        return (np.clip(features, self.low - width, self.high + width) - self.mean) / np.where(self.deviation == 0, 1.0, self.deviation)

    def predict(self, features: np.ndarray) -> np.ndarray:
        z = self.intercepts + self.prepared(features) @ self.slopes.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_blocs(features: np.ndarray, area: np.ndarray, weight: np.ndarray, shares: np.ndarray, votes: np.ndarray, blocs: Sequence[str], ridge: float = 0.1, within: float = 3.16, floor: float = 1e-12) -> SupportModel:
    """A multinomial logit of zones scored on areas, with two ridges: slopes are a bloc's mean, held by `ridge`, and what a party adds to
    it, held by `within`; so parties of one bloc differ only as far as results ask for it."""
    low, high, mean, deviation = features.min(axis=0), features.max(axis=0), features.mean(axis=0), features.std(axis=0)
    parties, areas, wide = shares.shape[1], shares.shape[0], features.shape[1]
    x = (features - mean) / np.where(deviation == 0, 1.0, deviation)
    part = weight / np.bincount(area, weight, areas)[area]
    member = np.array([[b == c for c in dict.fromkeys(blocs)] for b in blocs], float)
    average = member @ (member / member.sum(axis=0)).T  # parties x parties: a bloc's mean for each of its parties

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        base, slopes = theta[:parties], theta[parties:].reshape(parties, wide)
        z = base + x @ slopes.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        seen = np.zeros((areas, parties))
        np.add.at(seen, area, part[:, None] * p)
        seen = np.maximum(seen, floor)
        common = average @ slopes
        own = slopes - common
        value = -(votes[:, None] * shares * np.log(seen)).sum() / votes.sum() + ridge * (common**2).sum() / 2 + within * (own**2).sum() / 2
        push = -(votes[:, None] * shares / seen / votes.sum())[area] * part[:, None]
        dz = p * (push - (push * p).sum(axis=1, keepdims=True))
        return float(value), np.concatenate([dz.sum(axis=0), (dz.T @ x + ridge * common + within * own).ravel()])

    theta = minimise(loss, np.zeros(parties * (1 + wide)))
    return SupportModel(theta[:parties], theta[parties:].reshape(parties, wide), low, high, mean, deviation)


def steepened(model: SupportModel, features: np.ndarray, area: np.ndarray, weight: np.ndarray, shares: np.ndarray, votes: np.ndarray, tau: float = 1.1) -> SupportModel:
    """Slopes times tau, and intercepts fitted again, so that totals stay right."""
    steep = SupportModel(model.intercepts, tau * model.slopes, model.low, model.high, model.mean, model.deviation, model.slack)
    lean = steep.prepared(features) @ steep.slopes.T
    areas = shares.shape[0]
    part = weight / np.bincount(area, weight, areas)[area]

    def loss(base: np.ndarray) -> tuple[float, np.ndarray]:
        z = base + lean
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        seen = np.zeros_like(shares)
        np.add.at(seen, area, part[:, None] * p)
        seen = np.maximum(seen, 1e-12)
        push = -(votes[:, None] * shares / seen / votes.sum())[area] * part[:, None]
        return float(-(votes[:, None] * shares * np.log(seen)).sum() / votes.sum()), (p * (push - (push * p).sum(axis=1, keepdims=True))).sum(axis=0)

    base = minimise(loss, model.intercepts.copy())
    return SupportModel(base, steep.slopes, model.low, model.high, model.mean, model.deviation, model.slack)


def out_of_sample(zones: DataFrame, areas: DataFrame, features: Sequence[str], parties: Sequence[str], blocs: Sequence[str], penalties: Sequence[tuple[float, float]], tau: float = 1.1) -> DataFrame:
    """zones (zone, area, weight, features...), areas (area, fold, votes, a share for each party) -> ridge, within, fold, area, party, y, p: what a
    model fitted on the other folds says of an area. One group for each fold and pair of penalties."""
    spark = zones.sparkSession
    tries = spark.createDataFrame([(float(a), float(b)) for a, b in penalties], "ridge double, within double")
    cases = areas.select(F.col("fold").alias("left_out")).distinct().join(F.broadcast(tries))
    table = zones.join(areas, "area").withColumn("_all", F.lit(1))
    sent = cases.withColumn("_all", F.lit(1)).join(table, "_all").drop("_all")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ridge, within, fold = (rows[c].iloc[0] for c in ("ridge", "within", "left_out"))
        rows = rows.sort_values(["area", "zone"])
        known = rows[rows["fold"] != fold]
        heads = known.drop_duplicates("area")
        code = pd.Index(heads["area"]).get_indexer(known["area"])
        x, y, votes = known[list(features)].to_numpy(float), heads[list(parties)].to_numpy(float), heads["votes"].to_numpy(float)
        model = fit_blocs(x, code, known["weight"].to_numpy(float), y, votes, blocs, ridge, within)
        model = steepened(model, x, code, known["weight"].to_numpy(float), y, votes, tau)
        rest = rows[rows["fold"] == fold]
        p = model.predict(rest[list(features)].to_numpy(float)) * rest[["weight"]].to_numpy(float)
        summed = pd.DataFrame(p, columns=list(parties)).assign(area=rest["area"].to_numpy()).groupby("area").sum()
        summed = summed.div(summed.sum(axis=1), axis=0)
        seen = rest.drop_duplicates("area").set_index("area")
        out = summed.reset_index().melt("area", var_name="party", value_name="p")
        out["y"] = [float(seen.loc[a, q]) for a, q in zip(out["area"], out["party"], strict=True)]
        out["votes"] = [float(seen.loc[a, "votes"]) for a in out["area"]]
        return out.assign(ridge=ridge, within=within, fold=fold)[["ridge", "within", "fold", "area", "party", "votes", "y", "p"]]

    kind = dict(areas.dtypes)
    return sent.groupBy("left_out", "ridge", "within").applyInPandas(one, f"ridge double, within double, fold {kind['fold']}, area {kind['area']}, party string, votes double, y double, p double")


def cross_validated(predicted: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Divergence of the results from out_of_sample() by penalties, per vote, the least first."""
    term = F.when(F.col("y") > 0, F.col("votes") * F.col("y") * F.log(F.col("y") / F.greatest("p", F.lit(floor)))).otherwise(0.0)
    return predicted.groupBy("ridge", "within").agg((F.sum(term) / F.sum(F.col("votes") * F.col("y"))).alias("kl")).orderBy("kl", "ridge", "within")


def region_shifts(zones: DataFrame, results: DataFrame, parties: Sequence[str], covariance: np.ndarray, noise: float = 0.05) -> DataFrame:
    """zones (layer, region, zone, voters, a prior share for each party), results (layer, region, a share for each party) -> layer, region, party, shift: the log
    ratio by which a region's prior moves to meet its result. One group for each region of a layer."""
    by = ["layer", "region"]
    seen = results.select(*by, *[F.col(f"`{p}`").alias(f"seen_{i}") for i, p in enumerate(parties)])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        target = rows[[f"seen_{i}" for i in range(len(parties))]].iloc[0].to_numpy(float)
        rows = rows.sort_values("zone")
        shift = fit_shift(rows[list(parties)].to_numpy(float), rows["voters"].to_numpy(float), np.maximum(target, 1e-6), covariance, noise)
        return pd.DataFrame({"layer": rows["layer"].iloc[0], "region": rows["region"].iloc[0], "party": list(parties), "shift": shift})

    kind = dict(zones.dtypes)
    return zones.join(F.broadcast(seen), by).groupBy(*by).applyInPandas(one, f"layer {kind['layer']}, region {kind['region']}, party string, shift double")


def combined(zones: DataFrame, shifts: DataFrame, parties: Sequence[str], covariance: np.ndarray, doubt: Mapping[str, float]) -> DataFrame:
    """zones (zone, voters, a prior share for each party, and a region for each layer of `doubt`), shifts of region_shifts() -> zone and each party's
    share with all layers' shifts brought together: weighted by certainty, the prior's own being one of them.

    Zones with the same regions in all layers have one shift; there are few such combinations, and each is solved once.
    """
    layers, basis = list(doubt), zero_sum_basis(len(parties))
    prior = np.linalg.inv(basis.T @ covariance @ basis + 1e-9 * np.eye(len(parties) - 1))
    wide = shifts.groupBy("layer", "region").pivot("party", list(parties)).agg(F.first("shift")).select("layer", F.col("region").cast("string").alias("region"), F.array(*[F.col(f"`{p}`") for p in parties]).alias("s"))
    every = zones.select(*layers).distinct()
    for name in layers:
        every = every.join(F.broadcast(wide.filter(F.col("layer") == name).select(F.col("region").alias(name), F.col("s").alias(f"s_{name}"))), name, "left")

    def solve(batches):
        for table in batches:
            out = []
            for _, row in table.iterrows():
                sure, pull = prior.copy(), np.zeros(len(parties) - 1)
                for name in layers:
                    s = row[f"s_{name}"]
                    if s is not None:
                        certainty = np.eye(len(parties) - 1) / doubt[name] ** 2
                        sure += certainty
                        pull += certainty @ (basis.T @ np.asarray(s, float))
                out.append((basis @ np.linalg.solve(sure, pull)).tolist())
            yield table[layers].assign(move=out)

    kinds = dict(zones.dtypes)
    moves = every.mapInPandas(solve, ", ".join(f"`{n}` {kinds[n]}" for n in layers) + ", move array<double>")
    joined = zones.join(moves, layers, "left")
    raw = F.array(*[F.col(f"`{p}`") * F.exp(F.coalesce(F.get("move", F.lit(i)), F.lit(0.0))) for i, p in enumerate(parties)])
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return joined.withColumn("raw", raw).select("zone", *[(F.get("raw", F.lit(i)) / total).alias(p) for i, p in enumerate(parties)])
