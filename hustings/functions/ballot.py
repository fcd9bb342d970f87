"""The ballot that a user edits: parties that stand, are left out, or stand as one."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    """Parties that stand as one, whether they stand, and whether each stood before they merged."""

    members: tuple[str, ...]
    stands: bool = True
    before: tuple[tuple[str, bool], ...] = ()

    @property
    def merged(self) -> bool:
        return len(self.members) > 1


@dataclass(frozen=True)
class Ballot:
    """Entries in order: mergers first, the newest on top, then single parties in the parties' order. Changes give a new ballot."""

    parties: tuple[str, ...]
    entries: tuple[Entry, ...]

    @classmethod
    def of(cls, parties: Sequence[str]) -> Ballot:
        return cls(tuple(parties), tuple(Entry((p,)) for p in parties))

    def _ordered(self, entries: Iterable[Entry]) -> Ballot:
        entries = tuple(entries)
        single = {e.members[0]: e for e in entries if not e.merged}
        return replace(self, entries=(*(e for e in entries if e.merged), *(single[p] for p in self.parties if p in single)))

    def _chosen(self, names: Iterable[str]) -> list[Entry]:
        names = set(names)
        if unknown := names - set(self.parties):
            raise ValueError(f"no party {sorted(unknown)[0]}")
        return [e for e in self.entries if names & set(e.members)]

    def standing(self, names: Iterable[str], stands: bool) -> Ballot:
        """Includes or leaves out the entries that these parties are in."""
        chosen = self._chosen(names)
        return replace(self, entries=tuple(replace(e, stands=stands) if e in chosen else e for e in self.entries))

    def merge(self, names: Iterable[str]) -> Ballot:
        """The entries that these parties are in as one; it stands if one of them did."""
        chosen = self._chosen(names)
        if len(chosen) < 2:
            return self
        before = {p: dict(e.before).get(p, e.stands) for e in chosen for p in e.members}
        members = tuple(sorted(before, key=self.parties.index))
        merged = Entry(members, any(e.stands for e in chosen), tuple((p, before[p]) for p in members))
        return self._ordered([merged, *(e for e in self.entries if e not in chosen)])

    def unmerge(self, name: str) -> Ballot:
        """The parties of a merger as they were before."""
        entry = self.entry(name)
        apart = [Entry((p,), dict(entry.before).get(p, True)) for p in entry.members]
        return self._ordered([*apart, *(e for e in self.entries if e is not entry)]) if entry.merged else self

    def entry(self, party: str) -> Entry:
        return self._chosen([party])[0]

    def host(self, party: str, votes: Mapping[str, float]) -> str | None:
        """The party under which a party's votes are counted: the member with most votes; none if its entry doesn't stand."""
        entry = self.entry(party)
        return max(entry.members, key=lambda p: (votes.get(p, 0.0), -self.parties.index(p))) if entry.stands else None

    def hosts(self, votes: Mapping[str, float]) -> dict[str, str | None]:
        """For `ballot_map`: each party's host."""
        return {p: self.host(p, votes) for p in self.parties}

    def tracked(self, party: str, votes: Mapping[str, float]) -> str | None:
        """The host that a party followed leads to: its own, or that of the next one, in a ring, that stands for itself."""
        at = self.parties.index(party)
        for i, candidate in enumerate((*self.parties[at:], *self.parties[:at])):
            host = self.host(candidate, votes)
            if host is not None and (i == 0 or host == candidate):
                return host
        return None

    def steerable(self, votes: Mapping[str, float]) -> tuple[str, ...]:
        """Parties that a search can be steered by: hosts of what stands."""
        return tuple(p for p in self.parties if self.host(p, votes) == p)

    def label(self, party: str, short: Mapping[str, str], special: Mapping[frozenset[str], str]) -> str:
        """A merger's name: special by the set of its members, else their short names joined in the parties' order."""
        members = self.entry(party).members
        return special.get(frozenset(members)) or "-".join(short.get(p, p) for p in members)


@dataclass(frozen=True)
class PartyTerm:
    """How a search sees a party; defaults where a spread wasn't measured. The threshold is a margin: 0 just wins."""

    party: str
    index: int
    spread: float = 0.05
    between: float = 0.05
    threshold: float = 0.0
    steepness: float = 50.0


def party_terms(parties: Sequence[str], spreads: Mapping[str, tuple[float | None, float | None]]) -> list[PartyTerm]:
    return [PartyTerm(p, i, *(v or 0.05 for v in spreads.get(p, (None, None)))) for i, p in enumerate(parties)]


def known_party(raw: Column, standard: Column) -> Column:
    """The standard label of a raw one; a label without one is a failure, null and blank ones stay null."""
    fault = F.raise_error(F.concat(F.lit("unknown party "), raw)).cast("string")
    return F.when(F.btrim(F.coalesce(raw, F.lit(""))) == "", F.lit(None).cast("string")).otherwise(F.coalesce(standard, fault))
