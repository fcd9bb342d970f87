"""The search for maps: N connected regions of zones, grown, then improved by moves and recombinations.

One search is a chain of small random steps and can't be dealt out; many searches, one for each number of
regions, seed and setting, can. Each runs whole in one Python task. All terms of the score but the cut are functions of a region's
sums, so a zone is a row of masses, a move adds and takes rows, and one function prices any number of rows at once: regions as
they are, as they would be, and all parts into which a tree can be cut. The scorer in `scoring` is the same on tables, and
checks what a search returns.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ballots import Election

FLOOR_SHARE, FLOOR_PRICE = 0.2, 300_000.0
SEAL_EVERY = 25
#: Columns of a row of masses; those of the terms come behind them, a sum and a count for each.
PEOPLE, AREA, AX, AY, ARR, OWN, PX, PY, PRR = range(9)


@dataclass(frozen=True)
class Term:
    """What a search wants of a demographic or a party: mode average, extreme or gerrymander.

    `spread` and `between` are its spread from zone to zone and between regions; a party is the place of its votes in `Election`.
    """

    name: str
    mode: str = "off"
    weight: float = 0.0
    threshold: float = 0.5
    steepness: float = 10.0
    above: bool = True
    spread: float = 0.1
    between: float = 0.1
    party: int | None = None

    def __post_init__(self):
        if self.mode not in ("off", "average", "extreme", "gerrymander"):
            raise ValueError(f"mode {self.mode}")


@dataclass(frozen=True)
class Settings:
    """What a search weighs, and how long it runs."""

    steps: int = 2000
    temperature: float = 1.0
    recombine_every: int = 25
    people_weight: float = 1.0
    cut_weight: float = 1.0
    shape_weight: float = 0.0
    people_shape_weight: float = 0.0
    terms: tuple[Term, ...] = ()
    election: Election | None = None
    branch_moves: bool = True

    def __post_init__(self):
        if self.steps < 0 or self.temperature <= 0 or self.recombine_every < 1:
            raise ValueError("steps, temperature and the interval of recombinations must be positive")
        if min(self.people_weight, self.cut_weight, self.shape_weight, self.people_shape_weight, *(t.weight for t in self.terms), 0.0) < 0:
            raise ValueError("a weight is negative")

    @property
    def live(self) -> list[tuple[int, Term]]:
        return [(i, t) for i, t in enumerate(self.terms) if t.mode != "off" and t.weight > 0]

    @property
    def all_weights(self) -> float:
        """The sum by which the weighted terms are divided; 1 if nothing is weighed."""
        return self.people_weight + self.cut_weight + self.shape_weight + self.people_shape_weight + sum(t.weight for _, t in self.live) or 1.0


@dataclass
class Zones:
    """Masses of zones and their neighbours. x and y are metres (or any unit of length) from a common centre."""

    people: np.ndarray
    near: list[Sequence[int]]
    area: np.ndarray | None = None
    x: np.ndarray | None = None
    y: np.ndarray | None = None
    values: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def masses(self) -> np.ndarray:
        n, p = len(self.people), np.asarray(self.people, float)
        a, x, y = (np.zeros(n) if v is None else np.asarray(v, float) for v in (self.area, self.x, self.y))
        rr = x * x + y * y
        columns = [p, a, a * x, a * y, a * rr, a * a / (2 * math.pi), p * x, p * y, p * rr]
        for value, count in self.values:
            columns += [np.asarray(value, float) * count, np.asarray(count, float)]
        return np.column_stack(columns)


class Pricing:
    """The terms of the score, on rows of masses."""

    def __init__(self, masses: np.ndarray, mean_degree: float, n: int, settings: Settings):
        self.settings, self.n = settings, n
        zones, all_ = max(1, len(masses)), masses.sum(axis=0)
        self.target = all_[PEOPLE] / n
        # Sizes of a typical move, in which the terms are measured.
        self.people_sigma = max(float((masses[:, PEOPLE] ** 2).sum()) / zones, 1e-12)
        self.shape_sigma = n / zones
        self.cut_sigma = max(mean_degree / 24, 1e-12)
        self.floor_at = self.target * FLOOR_SHARE
        self.has_area = all_[AREA] > 0
        self.means = [float(all_[9 + 2 * i] / all_[10 + 2 * i]) if all_[10 + 2 * i] else 0.0 for i in range(len(settings.terms))]
        self.parties = [(t.party, i) for i, t in enumerate(settings.terms) if t.party is not None]
        self.sigmas = [self._sigma(t, n, zones) for t in settings.terms]

    def _sigma(self, t: Term, n: int, zones: int) -> float:
        step, election = t.spread * n / zones, self.settings.election
        if t.party is not None and t.mode == "gerrymander" and election and election.kind == "stv":
            return max(1e-9, step * (election.seats + 1))
        return max(1e-12, step * max(0.0, t.steepness) / 4 if t.mode == "gerrymander" else 2 * t.between * step)

    def share(self, rows: np.ndarray, i: int) -> np.ndarray:
        """A term's value in each row; the mean of all zones where nobody counts."""
        total, count = rows[:, 9 + 2 * i], rows[:, 10 + 2 * i]
        return np.where(count > 0, total / np.where(count > 0, count, 1.0), self.means[i])

    def _curve(self, t: Term, i: int, x: np.ndarray) -> np.ndarray:
        if t.mode == "gerrymander":
            by = (x - t.threshold if t.above else t.threshold - x) * max(0.0, t.steepness)
            return 1 / (1 + np.exp(np.clip(by, -700, 700)))
        gap = x - self.means[i]
        return gap * gap if t.mode == "average" else -np.minimum(np.abs(gap), t.between) ** 2

    def term(self, t: Term, i: int, rows: np.ndarray) -> np.ndarray:
        """What a term adds by row, lower being better, before it is divided by its typical move."""
        election = self.settings.election
        if t.party is None or t.mode != "gerrymander":
            return self._curve(t, i, self.share(rows, i))
        if election and (election.kind == "stv" or election.changes_votes):
            votes = np.maximum(0.0, rows[:, [9 + 2 * j for _, j in self.parties]]) * election.level
            own = [p for p, _ in self.parties].index(t.party)
            cast = np.array([election.cast(v) for v in votes]) if election.changes_votes else votes
            if election.kind == "stv":
                value = np.array([election.value(v, own) for v in cast])
                return -value if t.above else value
            return self._curve(t, i, election.margins(cast, own))
        rivals = [self.share(rows, j) for p, j in self.parties if p != t.party]
        return self._curve(t, i, self.share(rows, i) - (np.max(rivals, axis=0) if rivals else 0.0))

    def shape(self, rows: np.ndarray) -> np.ndarray:
        """Second moment of a region's land about its centre; 1 for a disc."""
        area, bare = rows[:, AREA], not rows[:, AREA].min(initial=1.0) > 0
        if bare:
            area = np.where(area > 0, area, 1.0)
        moment = rows[:, ARR] - (rows[:, AX] ** 2 + rows[:, AY] ** 2) / area + rows[:, OWN]
        out = 2 * math.pi * moment / (area * area)
        return np.where(rows[:, AREA] > 0, out, 1.0) if bare else out

    def people_shape(self, rows: np.ndarray) -> np.ndarray:
        """The same of where people live, beside the region's area."""
        people, area = rows[:, PEOPLE], rows[:, AREA]
        bare = not (people.min(initial=1.0) > 0 and area.min(initial=1.0) > 0)
        if bare:
            fine = (people > 0) & (area > 0)
            people, area = np.where(fine, people, 1.0), np.where(fine, area, 1.0)
        out = 2 * math.pi * (rows[:, PRR] - (rows[:, PX] ** 2 + rows[:, PY] ** 2) / people) / (people * area)
        return np.where(fine, out, 1.0) if bare else out

    def parts(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Each term by row, in typical moves, unweighed."""
        out = {"people": (rows[:, PEOPLE] - self.target) ** 2 / self.people_sigma}
        if self.has_area:
            out["shape"] = (self.shape(rows) - 1) / self.shape_sigma
            out["people_shape"] = (self.people_shape(rows) - 1) / self.shape_sigma
        return out | {f"term:{t.name}": self.term(t, i, rows) / self.sigmas[i] for i, t in self.settings.live}

    def cost(self, rows: np.ndarray) -> np.ndarray:
        """The weighted terms by row, floors left out."""
        w, off = self.settings, rows[:, PEOPLE] - self.target
        out = (w.people_weight / self.people_sigma) * off * off
        if self.has_area and w.shape_weight:
            out += w.shape_weight * (self.shape(rows) - 1) / self.shape_sigma
        if self.has_area and w.people_shape_weight:
            out += w.people_shape_weight * (self.people_shape(rows) - 1) / self.shape_sigma
        for i, t in w.live:
            out += t.weight / self.sigmas[i] * self.term(t, i, rows)
        return out / w.all_weights

    def floors(self, people: np.ndarray) -> np.ndarray:
        """What a region under its floor costs, unpriced."""
        if self.floor_at <= 0:
            return np.zeros(len(people))
        s = np.maximum(people / self.floor_at, 1e-6)
        return np.where(people >= self.floor_at, 0.0, 1 + (1 - s) ** 2 / s)

    def cut(self, edges):
        return self.settings.cut_weight * edges / self.cut_sigma / self.settings.all_weights


def spanning_forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (x, y) of n places join what those before them don't: Kruskal's forest, by Boruvka's rounds. Each piece takes its
    earliest link out; pieces so joined are one in the next round, of which there are about log(n)."""
    kept, at = [np.zeros(0, np.int64)], np.arange(len(x))
    while len(at):
        first = np.full(n, len(at))
        for side in (x, y):
            np.minimum.at(first, side, np.arange(len(at)))
        pieces = np.flatnonzero(first < len(at))
        link = first[pieces]
        kept.append(np.unique(at[link]))
        up = np.arange(n)
        up[pieces] = np.where(x[link] == pieces, y[link], x[link])
        # Two pieces that take one link point at each other; the lesser stays.
        both = (up[up] == np.arange(n)) & (np.arange(n) < up)
        up[both] = np.flatnonzero(both)
        while not np.array_equal(higher := up[up], up):
            up = higher
        tops = up == np.arange(n)
        label, n = (np.cumsum(tops) - 1)[up], int(tops.sum())
        x, y = label[x], label[y]
        out = x != y
        x, y, at = x[out], y[out], at[out]
    return np.sort(np.concatenate(kept))


def preorder(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tree's n - 1 links, from its root 0: places in preorder, their parents and subtree sizes, both by place in preorder. The links, each there and
    back, make one tour; how far each is from the tour's end is found by doubling."""
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)
    m = n - 1
    start = np.r_[x, y]
    by = np.argsort(start, kind="stable")
    ends = np.cumsum(np.bincount(start, minlength=n))
    after = np.arange(1, 2 * m + 1)
    after[ends - 1] = np.r_[0, ends[:-1]]
    spot = np.empty(2 * m, np.int64)
    spot[by] = np.arange(2 * m)
    back = np.r_[np.arange(m, 2 * m), np.arange(m)]
    after = by[after[spot[back]]]
    last = np.flatnonzero(after == by[0])
    after[last] = last
    left = np.ones(2 * m, np.int64)
    left[last] = 0
    for _ in range((2 * m).bit_length()):
        left += left[after]
        after = after[after]
    when = 2 * m - 1 - left
    there = when[:m] < when[m:]
    child, parent = np.where(there, y, x), np.where(there, x, y)
    enter, leave = np.minimum(when[:m], when[m:]), np.maximum(when[:m], when[m:])
    entered = np.full(2 * m, -1)
    entered[enter] = child
    order = np.r_[0, entered[entered >= 0]]
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    up, size = np.zeros(n, np.int64), np.full(n, n)
    up[at[child]], size[at[child]] = at[parent], (leave - enter + 1) // 2
    return order, up, size


class Regions:
    """Zones and which region each is in (-1: none yet), with all sums of the regions kept as zones move."""

    def __init__(self, zones: Zones, n: int, seed: int, settings: Settings):
        if not 1 <= n <= max(1, len(zones.people)):
            raise ValueError(f"{n} regions of {len(zones.people)} zones")
        self.near = [list(map(int, ws)) for ws in zones.near]
        counts = np.fromiter(map(len, self.near), np.int64, len(self.near))
        # All links both ways: those of zone z are links[first[z]:first[z + 1]].
        self.first, self.links = np.r_[0, np.cumsum(counts)], np.fromiter(chain.from_iterable(self.near), np.int32, int(counts.sum()))
        self.masses, self.n, self.settings = zones.masses(), n, settings
        degree = sum(map(len, self.near)) / max(1, len(self.near))
        self.price = Pricing(self.masses, degree, n, settings)
        self.rng = np.random.default_rng(seed)
        self._draws: list[float] = []
        # The assignment is one array, which single zones are read from and put into by `assign`.
        self.home = np.full(len(self.near), -1, np.int32)
        self.assign = memoryview(self.home)
        self.spot = np.full(len(self.near), -1, np.int32)
        self.sums, self.size = np.zeros((n, self.masses.shape[1])), [0] * n
        self.cut, self.best, self.best_assign, self._changed = 0, math.inf, None, set()
        self.border: list[int] = []
        self.place: dict[int, int] = {}

    def draw(self) -> float:
        if not self._draws:
            self._draws = self.rng.random(1024).tolist()
        return self._draws.pop()

    # Growing

    def seeds(self) -> list[int]:
        """Zones far from each other: each the farthest, in steps, from those before; one on an island not reached yet comes first. Ties to the first."""
        far = [math.inf] * len(self.near)
        out = [int(self.draw() * len(self.near))]
        while True:
            far[out[-1]], layer, steps = 0, [out[-1]], 0
            while layer:
                steps += 1
                after = []
                for z in layer:
                    for w in self.near[z]:
                        if far[w] > steps:
                            far[w] = steps
                            after.append(w)
                layer = after
            if len(out) == self.n:
                return out
            out.append(far.index(max(far)))

    def build(self) -> int:
        """Regions claim zones in turn, the least populous first, each the open neighbour that costs least; pockets that one region
        encloses go to it. Fails where an island has no region, since its zones could join none."""
        self.taken_by_zone = np.zeros(len(self.near), np.int32)
        self.taken = memoryview(self.taken_by_zone)
        self.open: list[dict[int, int]] = [{} for _ in range(self.n)]
        self.islands()
        for region, zone in enumerate(self.seeds()):
            self.claim(zone, region)
        left, steps = len(self.near) - self.n, 0
        queue = [(float(self.sums[r, PEOPLE]), r) for r in range(self.n)]
        heapq.heapify(queue)
        while left:
            steps += 1
            if steps % SEAL_EVERY == 0:
                sealed = self.seal()
                left -= sealed
                if sealed:
                    queue = [(float(self.sums[r, PEOPLE]), r) for r in range(self.n)]
                    heapq.heapify(queue)
                if not left:
                    break
            while queue and not self.open[queue[0][1]]:
                heapq.heappop(queue)
            if not queue:
                raise ValueError(f"{left} zones can't be reached from any region: fewer regions than islands")
            region = queue[0][1]
            self.claim(self.cheapest(region), region)
            heapq.heapreplace(queue, (float(self.sums[region, PEOPLE]), region))
            left -= 1
        self.settle()
        return steps

    def cheapest(self, region: int) -> int:
        mine = self.open[region]
        zones = np.fromiter(mine, np.int64, len(mine))
        others = self.taken_by_zone[zones] - np.fromiter(mine.values(), np.int64, len(mine))
        delta = self.price.cost(self.sums[region] + self.masses[zones]) + self.price.cut(others)
        return int(zones[delta == delta.min()].min())

    def islands(self) -> None:
        """Pieces of zones without a region, at first the islands; of each, how often it touches which region, and those that changed since they
        were looked at."""
        self.piece, self.touched, self.changed = [-1] * len(self.near), [], set()
        for start in range(len(self.near)):
            if self.piece[start] < 0:
                self.piece[start] = len(self.touched)
                walk = [start]
                for z in walk:
                    for w in self.near[z]:
                        if self.piece[w] < 0:
                            self.piece[w] = len(self.touched)
                            walk.append(w)
                self.touched.append({})

    def claim(self, zone: int, region: int, whole: bool = False) -> None:
        """With `whole`, all of the zone's piece is claimed, and needn't be kept."""
        assign, taken, mine, piece = self.assign, self.taken, self.open[region], self.piece[zone]
        assign[zone] = region
        self.sums[region] += self.masses[zone]
        self.size[region] += 1
        touched, free = self.touched[piece], []
        for w in self.near[zone]:
            taken[w] += 1
            owner = assign[w]
            if owner < 0:
                mine[w] = mine.get(w, 0) + 1
                free.append(w)
            else:
                self.open[owner].pop(zone, None)
                if not whole and w != zone:
                    if touched[owner] > 1:
                        touched[owner] -= 1
                    else:
                        del touched[owner]
        mine.pop(zone, None)
        if free and not whole:
            touched[region] = touched.get(region, 0) + len(free)
            self.changed.add(piece)
            if len(free) > 1:
                self.part(free, piece)

    def part(self, starts: list[int], piece: int) -> None:
        """What a claim leaves of a piece, from the zones beside the claimed one: pieces are walked in turn, step by step, until all have met or one is
        left; the others, walked to their ends, become pieces of their own. So the largest is never walked further than the others."""
        owner = {w: i for i, w in enumerate(starts)}
        root, walks, at = list(range(len(starts))), [[w] for w in starts], [0] * len(starts)
        left = set(range(len(starts)))
        while len(left) > 1:
            ended = False
            for i, walk in enumerate(walks):
                if at[i] >= len(walk):
                    continue
                z = walk[at[i]]
                at[i] += 1
                for w in self.near[z]:
                    if self.assign[w] >= 0:
                        continue
                    other = owner.get(w)
                    if other is None:
                        owner[w] = i
                        walk.append(w)
                    elif root[other] != root[i]:
                        old, new = root[other], root[i]
                        root = [new if r == old else r for r in root]
                        left.discard(old)
                        if len(left) == 1:
                            return
                ended = ended or at[i] >= len(walk)
            if ended:
                for top in sorted(left - {root[i] for i in range(len(walks)) if at[i] < len(walks[i])}):
                    if len(left) == 1:
                        return
                    left.discard(top)
                    self.piece_apart([z for i, walk in enumerate(walks) if root[i] == top for z in walk], piece)

    def piece_apart(self, zones: list[int], of: int) -> None:
        touched, was = {}, self.touched[of]
        for z in zones:
            self.piece[z] = len(self.touched)
            for w in self.near[z]:
                if self.assign[w] >= 0:
                    touched[self.assign[w]] = touched.get(self.assign[w], 0) + 1
        for region, times in touched.items():
            was[region] -= times
            if not was[region]:
                del was[region]
        self.changed.add(len(self.touched))
        self.touched.append(touched)

    def seal(self) -> int:
        """Gives pieces without a region that touch one region only to it; how many zones. Only pieces that changed since the last time can be such."""
        count = 0
        for piece in sorted(self.changed):
            if len(self.touched[piece]) != 1:
                continue
            region = next(iter(self.touched[piece]))
            walk = [next(z for z in self.open[region] if self.piece[z] == piece)]
            self.piece[walk[0]] = -1
            for z in walk:
                for w in self.near[z]:
                    if self.assign[w] < 0 and self.piece[w] >= 0:
                        self.piece[w] = -1
                        walk.append(w)
            for z in walk:
                self.claim(z, region, whole=True)
            self.touched[piece] = {}
            count += len(walk)
        self.changed.clear()
        return count

    def adopt(self, assign: Sequence[int]) -> None:
        """Starts from a map, whether its regions are connected or not."""
        if len(assign) != len(self.near) or not all(0 <= int(r) < self.n for r in assign):
            raise ValueError("a map gives each zone one of the regions")
        self.home[:] = assign
        self.settle()

    def settle(self) -> None:
        """All sums from the assignment, as they are kept from here on."""
        self.sums = np.zeros((self.n, self.masses.shape[1]))
        np.add.at(self.sums, self.home, self.masses)
        self.size = np.bincount(self.home, minlength=self.n).tolist()
        at = np.repeat(np.arange(len(self.near), dtype=np.int32), np.diff(self.first))
        at, to = (ends[self.home[at] != self.home[self.links]] for ends in (at, self.links))
        self.cut = int((at < to).sum())
        self.costs, self.floors = self.price.cost(self.sums), self.price.floors(self.sums[:, PEOPLE])
        self.border = np.unique(at).tolist()
        self.place = {z: i for i, z in enumerate(self.border)}
        self.best, self.best_assign, self._changed = self.score(), self.home.copy(), set()

    def around(self, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of some zones: from where, and to where."""
        counts = self.first[zones + 1] - self.first[zones]
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(zones, counts), self.links[np.repeat(self.first[zones], counts) + inner]

    # Scoring

    def score(self) -> float:
        return float(self.costs.sum()) + float(self.price.cut(self.cut)) + FLOOR_PRICE * float(self.floors.sum())

    def components(self) -> dict[str, float]:
        """The terms of the score in typical moves, unweighed, the worst deviation and the means of the penalties."""
        rows = self.sums
        out = {name: float(v.sum()) for name, v in self.price.parts(rows).items()} | {"cut": self.cut / self.price.cut_sigma, "floor": float(self.floors.sum())}
        out["max_deviation"] = float(np.abs(rows[:, PEOPLE] / self.price.target - 1).max())
        if self.price.has_area:
            out |= {"mean_shape": float(self.price.shape(rows).mean()), "mean_people_shape": float(self.price.people_shape(rows).mean())}
        return out

    def keep_best(self) -> None:
        score = self.score()
        if score < self.best:
            changed = np.fromiter(self._changed, np.int64, len(self._changed))
            self.best_assign[changed] = self.home[changed]
            self.best = score
            self._changed.clear()

    def touch(self, zone: int) -> None:
        """Whether a zone stands at a border, in the list that moves are drawn from."""
        home = self.assign[zone]
        beside = any(self.assign[w] != home for w in self.near[zone])
        at = self.place.get(zone)
        if beside and at is None:
            self.place[zone] = len(self.border)
            self.border.append(zone)
        elif not beside and at is not None:
            last = self.border.pop()
            del self.place[zone]
            if last != zone:
                self.border[at] = last
                self.place[last] = at

    # Moving

    def cut_off(self, zone: int) -> list[int]:
        """What falls off the zone's region without it: all pieces but the largest. Pieces are walked in turn, step by step, so that
        the largest needn't be walked to its end."""
        home = self.assign[zone]
        starts = [w for w in self.near[zone] if self.assign[w] == home]
        if len(starts) < 2:
            return []
        owner = {w: i for i, w in enumerate(starts)}
        root = list(range(len(starts)))

        def top(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        walks = [[w] for w in starts]
        at = [0] * len(starts)
        open_pieces = len(starts)
        while True:
            moved = False
            for i in range(len(starts)):
                if at[i] >= len(walks[i]):
                    continue
                moved = True
                z = walks[i][at[i]]
                at[i] += 1
                for w in self.near[z]:
                    if w == zone or self.assign[w] != home:
                        continue
                    other = owner.get(w)
                    if other is None:
                        owner[w] = i
                        walks[i].append(w)
                    elif top(other) != top(i):
                        root[top(other)] = top(i)
                        open_pieces -= 1
                        if open_pieces == 1:
                            return []
            unfinished = {top(i) for i in range(len(starts)) if at[i] < len(walks[i])}
            sizes: dict[int, int] = {}
            for i, walk in enumerate(walks):
                sizes[top(i)] = sizes.get(top(i), 0) + len(walk)
            done = [s for t, s in sizes.items() if t not in unfinished]
            if not moved or (len(unfinished) == 1 and sizes[next(iter(unfinished))] >= max(done, default=0)):
                first: dict[int, int] = {}
                for z, i in owner.items():
                    first[top(i)] = min(first.get(top(i), z), z)
                keep = max(sizes, key=lambda t: (t in unfinished and len(unfinished) == 1, sizes[t], -first[t]))
                return [z for z, i in owner.items() if top(i) != keep]

    def chosen(self, gains: np.ndarray) -> int:
        """One of the gains by chance, the better the likelier."""
        odds = np.cumsum(np.exp(-(gains - gains.min()) / self.settings.temperature))
        return min(int(np.searchsorted(odds, self.draw() * odds[-1], side="right")), len(gains) - 1)

    def step(self) -> bool:
        """A zone at a border, with what would be cut off without it, stays or goes to a region beside it, by chance and gain."""
        if not self.border:
            return False
        z = self.border[int(self.draw() * len(self.border))]
        home = self.assign[z]
        if self.size[home] <= 1:
            return False
        rest = self.cut_off(z)
        if rest and (not self.settings.branch_moves or len(rest) + 1 >= self.size[home]):
            return False
        moving = [z, *rest]
        beside: list[int] = []
        for w in self.near[z]:
            if self.assign[w] != home and self.assign[w] not in beside:
                beside.append(self.assign[w])
        edges = self.edges_by_region(moving)
        mass = self.masses[z] if len(moving) == 1 else self.masses[moving].sum(axis=0)
        after = np.vstack([self.sums[home] - mass, self.sums[beside] + mass])
        cost, floor = self.price.cost(after), self.price.floors(after[:, PEOPLE])
        gains = np.zeros(len(beside) + 1)
        change = cost[0] - self.costs[home] + floor[0] - self.floors[home]
        links = np.array([edges.get(home, 0) - edges.get(r, 0) for r in beside])
        gains[1:] = change + cost[1:] - self.costs[beside] + floor[1:] - self.floors[beside] + self.price.cut(links)
        pick = self.chosen(gains)
        if not pick:
            return False
        self.move(moving, home, beside[pick - 1], int(links[pick - 1]))
        for r, row, c, f in ((home, after[0], cost[0], floor[0]), (beside[pick - 1], after[pick], cost[pick], floor[pick])):
            self.sums[r], self.costs[r], self.floors[r] = row, c, f
        self.keep_best()
        return True

    def edges_by_region(self, zones: Sequence[int]) -> dict[int, int]:
        """Edges from a set of zones to the regions around and to the rest of their own."""
        inside, out = set(zones), {}
        for z in zones:
            for w in self.near[z]:
                if w not in inside:
                    out[self.assign[w]] = out.get(self.assign[w], 0) + 1
        return out

    def move(self, zones: Sequence[int], home: int, to: int, cut: int) -> None:
        """Assignment, sizes, cut and border; sums are the caller's."""
        for z in zones:
            self.assign[z] = to
        self.size[home] -= len(zones)
        self.size[to] += len(zones)
        self.cut += cut
        self._changed.update(zones)
        for z in zones:
            self.touch(z)
            for w in self.near[z]:
                self.touch(w)

    def move_all(self, zones: np.ndarray, first: int, second: int) -> None:
        """Zones of two regions go to the other one; sums, sizes and cut are the caller's."""
        self.home[zones] = first + second - self.home[zones]
        self._changed.update(zones.tolist())
        near = np.unique(np.concatenate([zones, self.around(zones)[1]]))
        at, to = self.around(near)
        beside = np.isin(near, at[self.home[at] != self.home[to]])
        was = np.fromiter((z in self.place for z in near.tolist()), bool, len(near))
        for z in near[beside != was].tolist():
            self.touch(z)

    # Recombining

    def spanning_tree(self, zones: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Of a random spanning tree of some zones: places in preorder, their parents, subtree sizes, and all links as places in preorder."""
        zones = np.asarray(zones, np.int64)
        self.spot[zones] = np.arange(len(zones), dtype=np.int32)
        x, y = self.around(zones)
        inside = (x < y) & (self.spot[y] >= 0)
        x, y = (self.spot[ends[inside]].astype(np.int64) for ends in (x, y))
        self.spot[zones] = -1
        mixed = self.rng.permutation(len(x))
        x, y = x[mixed], y[mixed]
        tree = spanning_forest(x, y, len(zones))
        if len(tree) < len(zones) - 1:
            return None
        order, up, size = preorder(x[tree], y[tree], len(zones))
        places = np.empty(len(zones), np.int64)
        places[order] = np.arange(len(zones))
        return order, up, size, places[x], places[y]

    @staticmethod
    def ancestors(parent: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lowest common ancestors of pairs of places in preorder: the least parent of the places behind the first, up to the second. Least ones of
        runs of 1, 2, 4, ... places answer the pairs of that distance."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        out, wide = low.copy(), np.frexp(high - low)[1]
        least = parent
        for bits in range(1, int(wide.max(initial=0)) + 1):
            at = np.flatnonzero(wide == bits)
            out[at] = np.minimum(least[low[at] + 1], least[high[at] + 1 - (1 << (bits - 1))])
            least = np.minimum(least[: -(1 << (bits - 1))], least[1 << (bits - 1) :])
        return out

    def cut_gains(self, a: int, b: int, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """What the score would change by: 0 for regions a and b as they are, then for each place of a random spanning tree but its
        root, cut off with all below it. With it the tree's order and subtree sizes, and by how much the cut would change; subtrees are runs of that order."""
        tree = self.spanning_tree(zones)
        if tree is None:
            return None
        order, up, size, x, y = tree
        mass = self.masses[zones][order]
        running = np.vstack([np.zeros(mass.shape[1]), np.cumsum(mass, axis=0)])
        first = np.arange(1, len(order))
        part = running[first + size[1:]] - running[first]
        rest = running[-1] - part
        # Links that a cut parts: those at its places, less twice those within.
        ends = np.bincount(x, minlength=len(order)) + np.bincount(y, minlength=len(order))
        ends -= 2 * np.bincount(self.ancestors(up, size, x, y), minlength=len(order))
        counted = np.r_[0, np.cumsum(ends)]
        parted = counted[first + size[1:]] - counted[first]
        regions = self.home[zones[order]]
        now = int((regions[x] != regions[y]).sum())
        gain = self.price.cost(part) + self.price.cost(rest) - self.costs[a] - self.costs[b] + self.price.cut(parted - now)
        gain += self.price.floors(part[:, PEOPLE]) + self.price.floors(rest[:, PEOPLE]) - self.floors[a] - self.floors[b]
        return np.r_[0.0, gain], order, size, np.r_[0, parted - now]

    def recombine(self) -> bool:
        """Two regions side by side become one, a random spanning tree is cut where it is best, by chance and gain."""
        if not self.border:
            return False
        z = self.border[int(self.draw() * len(self.border))]
        a = self.assign[z]
        beside = sorted({self.assign[w] for w in self.near[z]} - {a})
        b = beside[int(self.draw() * len(beside))]
        zones = np.flatnonzero((self.home == a) | (self.home == b))
        found = self.cut_gains(a, b, zones)
        if found is None:
            return False
        gains, order, size, cuts = found
        pick = self.chosen(gains)
        if not pick:
            return False
        inside = np.zeros(len(zones), bool)
        inside[order[pick : pick + int(size[pick])]] = True
        part = zones[inside]
        # The part keeps the number of the region that has more of its people.
        people, was_a = self.masses[part, PEOPLE], self.home[part] == a
        first, second = (a, b) if people[was_a].sum() >= people[~was_a].sum() else (b, a)
        after = np.where(inside, first, second).astype(np.int32)
        self.move_all(zones[after != self.home[zones]], first, second)
        self.size[first], self.size[second] = len(part), len(zones) - len(part)
        self.cut += int(cuts[pick])
        whole = self.sums[a] + self.sums[b]
        self.sums[first] = self.masses[part].sum(axis=0)
        self.sums[second] = whole - self.sums[first]
        pair = self.sums[[a, b]]
        self.costs[[a, b]], self.floors[[a, b]] = self.price.cost(pair), self.price.floors(pair[:, PEOPLE])
        self.keep_best()
        return True

    def run(self, grow_only: bool = False, recombine: bool = True) -> np.ndarray:
        if len(self.home) and self.home[0] < 0:
            self.build()
        if not grow_only:
            for i in range(1, self.settings.steps + 1):
                if recombine and i % self.settings.recombine_every == 0:
                    self.recombine()
                else:
                    self.step()
        return self.best_assign


ZONE_COLUMNS = ("people", "area", "x", "y")


def search(zones: DataFrame, edges: DataFrame, runs: DataFrame, settings: Settings, mode: str) -> DataFrame:
    """zones (zone, people, and if wanted area, x, y, and a value and n_ column for each term), edges (a, b), runs (run, n, seed) ->
    run, n, seed, zone, region, score of the best map.

    Each run is one group. Zones of a study area are thousands to a million; each run gets them, in one array of rows.
    """
    if mode not in ("build", "optimise", "recombine"):
        raise ValueError(f"mode {mode}")
    near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("near"))
    names = [c for c in ZONE_COLUMNS if c in zones.columns]
    terms = [(t.name, f"n_{t.name}") for t in settings.terms]
    columns = [F.col(c).cast("double").alias(c) for c in (*names, *(c for pair in terms for c in pair))]
    every = zones.join(near, zones["zone"] == near["a"], "left").select("zone", *columns, F.coalesce("near", F.array().cast("array<long>")).alias("near"))
    dealt = every.crossJoin(F.broadcast(runs.select("run", "n", "seed")))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("zone")
        codes, near = table["zone"].to_numpy(), table["near"].combine_chunks()
        to = near.flatten().to_numpy()
        place = np.searchsorted(codes, to)
        if not np.array_equal(codes[np.minimum(place, len(codes) - 1)], to):
            raise ValueError("an edge leads to a zone that isn't there")
        numbers = list(range(len(codes)))
        flat, ends = [numbers[i] for i in place.tolist()], np.r_[0, np.cumsum(near.value_lengths().to_numpy())].tolist()
        found = Zones(
            table["people"].to_numpy(), [flat[i:j] for i, j in zip(ends, ends[1:])],
            *(table[c].to_numpy() if c in names else None for c in ("area", "x", "y")),
            values=[(table[v].to_numpy(), table[n].to_numpy()) for v, n in terms],
        )
        del flat, to, place
        table = table.select(["run", "n", "seed", "zone"])
        run = Regions(found, table["n"][0].as_py(), table["seed"][0].as_py(), settings)
        del found
        region = run.run(grow_only=mode == "build", recombine=mode == "recombine")
        return table.append_column("region", pa.array(region, pa.int32())).append_column("score", pa.array(np.full(len(codes), run.best)))

    return dealt.groupBy("run").applyInArrow(one, "run int, n int, seed int, zone long, region int, score double")
