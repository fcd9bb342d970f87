"""Votes of one region as cast and counted, for searches: the counts of `election` on one array of party votes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from .election import TACTICAL_MOST, VIABILITY_SCALE


@dataclass(frozen=True)
class Election:
    """The rules by which a search prices seats: kind fptp or stv, turnout level, and what parties' voters do when one doesn't stand.

    `thresholds` are votes under stv and shares under fptp; without them all parties stand. `tactical` holds for fptp only.
    """

    kind: str = "fptp"
    seats: int = 1
    level: float = 1.0
    transfers: tuple[tuple[float, ...], ...] = ()
    exhaustion: tuple[float, ...] = ()
    thresholds: tuple[float, ...] | None = None
    tactical: bool = False
    seat_bonus: float = 3.0

    def __post_init__(self):
        if self.kind not in ("fptp", "stv") or self.seats < 1:
            raise ValueError(f"{self.kind} with {self.seats} seats")

    @property
    def changes_votes(self) -> bool:
        """Whether what is cast differs from the voters who live there."""
        return self.thresholds is not None or (self.tactical and self.kind == "fptp")

    @cached_property
    def _moves(self) -> np.ndarray:
        return np.array(self.transfers, float)

    @cached_property
    def _stay(self) -> np.ndarray:
        return 1 - np.array(self.exhaustion, float)

    def standing(self, votes: np.ndarray) -> np.ndarray:
        """Votes once those of parties that don't stand have moved; the largest stands if none would."""
        bar = np.array(self.thresholds) * (votes.sum() if self.kind == "fptp" else 1.0)
        stands = (votes > 0) & (votes >= bar)
        if not stands.any():
            if not votes.max(initial=0.0) > 0:
                return np.zeros_like(votes)
            stands[int(votes.argmax())] = True
        leaving = np.where(stands, 0.0, votes * self._stay)
        pull = self._moves * stands
        whole = pull.sum(axis=1)
        share = np.divide(leaving, whole, out=np.zeros_like(leaving), where=whole > 0)
        return np.where(stands, votes, 0.0) + share @ pull

    def tactically(self, votes: np.ndarray) -> np.ndarray:
        """Votes once those of parties that can't win have left, where the seat is in doubt, for those that can."""
        total = votes.sum()
        if total <= 0:
            return votes
        viable = np.where(votes > 0, np.exp(-(votes.max() - votes) / total / VIABILITY_SCALE), 0.0)
        shares = viable / viable.sum()
        moving = votes * TACTICAL_MOST * max(0.0, 1 - float(shares @ shares)) * (1 - viable)
        others = (votes > 0) & ~np.eye(len(votes), dtype=bool)
        pull = self._moves * viable * others
        weight = np.where(pull.sum(axis=1, keepdims=True) > 0, pull, viable * others)
        whole = weight.sum(axis=1)
        share = np.divide(moving, whole, out=np.zeros_like(moving), where=whole > 0)
        return votes - moving + share @ weight

    def cast(self, votes: np.ndarray) -> np.ndarray:
        if self.thresholds is not None:
            votes = self.standing(votes)
        return self.tactically(votes) if self.tactical and self.kind == "fptp" else votes

    @staticmethod
    def margins(cast: np.ndarray, party: int) -> np.ndarray:
        """A party's votes less the best other's, as a share of all, by row; 0 without votes."""
        total = cast.sum(axis=1)
        rivals = np.delete(cast, party, axis=1).max(axis=1, initial=0.0)
        return np.divide(cast[:, party] - rivals, total, out=np.zeros(len(cast)), where=total > 0)

    def count(self, votes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Quota, piles at the end and seats of a transferable count; ties to the earlier party both ways."""
        piles, seats, left = votes.astype(float).copy(), np.zeros(len(votes), int), self.seats
        quota, here = piles.sum() / (self.seats + 1), votes > 0
        while quota > 0 and left and here.any():
            top = int(np.where(here, piles, -np.inf).argmax())
            if piles[top] >= quota:
                piles[top] -= quota
                seats[top], left, here[top] = seats[top] + 1, left - 1, piles[top] > 0
            elif here.sum() == 1:
                seats[top], left, piles[top] = seats[top] + left, 0, 0.0
            else:
                low = int(np.where(here, piles, np.inf).argmin())
                pot, here[low], piles[low] = piles[low] * self._stay[low], False, 0.0
                pull = self._moves[low] * here
                if pull.sum() > 0:
                    piles += pot * pull / pull.sum()
        return quota, piles, seats

    def value(self, votes: np.ndarray, party: int) -> float:
        """Seats, each worth the bonus, and what is left of the party's votes in quotas: the way to the next seat."""
        quota, piles, seats = self.count(votes)
        return self.seat_bonus * seats[party] + piles[party] / quota if quota > 0 else 0.0
