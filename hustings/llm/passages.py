"""Substring dedup: passages of MIN_WORDS words or more that several documents share, exactly or nearly.

1. Seeds. Of each text's k-word windows, the least hash in every row of SPAN windows is a seed (winnowing): an
   exact run of k + SPAN - 1 shared words shares a seed. Texts with the same words are one node.
2. Anchors. Nodes with a seed in common are joined as a star: each place of the seed is matched with one in its
   first node, that with most places, so a seed with n places gives at most n - 1 matches.
3. Chains. The matches of two nodes, in order in both, are chained: a match adds GAIN, a gap costs GAP_COST a
   word, and the best predecessor, the greatest score + cost * (x + y) among those with less x and y, is a prefix
   maximum in a Fenwick tree over y. Chains are parted at gaps over MAX_GAP.
4. Alignment. The words under a chain are aligned: equal shifts word by word, other gaps by edit distance,
   ends through edits until the score drops (X-drop). Of the alignment, maximal segments that score 1 for a word alike and
   -MISMATCH else are the passages; those long and alike enough are kept.
5. Exact runs. Ranges of a text whose seeds all stand in other texts, whichever these are, give the hash of every run of
   MIN_WORDS words; a run that two nodes have is a passage in each of its places. So a passage isn't lost when parts of it
   belong to other heads; no exact run of MIN_WORDS words is missed.

A row says where in a document such a passage stands, and where else. Both sides of a match are given, and
all copies of a text; spans of a document that overlap are merged.

Cases: null, empty and short texts have no passages. A text that repeats itself is no match: both sides lie in
different texts, or in copies. Copies of MIN_WORDS words or more are a passage from end to end. A null id
is carried through. Rows with one id are documents each. Very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, key_filter, may_have, sized
from .shingles import GOLDEN, as_long, long_windows, mix, windows, words_of

K, SPAN = 5, 4
MIN_WORDS, MIN_ALIKE = 50, 0.8
GAIN, GAP_COST, MAX_GAP, MISMATCH = 20.0, 0.1, 64, 3
#: Words that a chain spans at least, from the start of its first seed to the end of its last.
#: Of a passage at MIN_ALIKE few seeds are left: between two, a fifth of MIN_WORDS words and a seed is asked for.
LEAST_CHAIN = round(MIN_WORDS * (1 - MIN_ALIKE)) + K
#: Beyond its ends an alignment goes on until its score is DROP below its best; at an edit, up to SKIP words are left out on a side.
DROP, SKIP, LOOK = 12, 2, 4

#: Seeds of very many places are told from one in SAMPLE texts; a part of one has HOT places at least, and a SHARE-th of what a task has.
HOT, SAMPLE, SHARE = 5000, 64, 4

SKIPS = [(1, 1)] + [s for n in range(1, SKIP + 1) for s in ((n, 0), (0, n))]


def seeds(hashes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Places of the least hash in every row of `span` hashes, ascending."""
    if len(hashes) <= span:
        return np.array([hashes.argmin()]) if len(hashes) else np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return np.unique(rows.argmin(axis=1) + np.arange(len(rows)))


class Fenwick:
    """Prefix maxima of (score, who) over places 0 to n - 1."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def top(self, before: int) -> tuple[float, int]:
        """The greatest value at places under `before`."""
        found = (float("-inf"), -1)
        while before > 0:
            found = max(found, self.best[before])
            before -= before & -before
        return found


def chains(x: np.ndarray, y: np.ndarray, gain: float = GAIN, cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[np.ndarray]:
    """Chains of the matches (x, y), as places in them: ascending in both, parted at long gaps, best first."""
    order = np.lexsort((y, x))
    if len(x) > 1 and np.all(np.diff(x[order]) > 0) and np.all(np.diff(y[order]) > 0):
        found = [order]
    else:
        ranks = np.unique(y, return_inverse=True)[1]
        tree, score, back = Fenwick(int(ranks.max()) + 1), np.zeros(len(x)), np.full(len(x), -1)
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and x[order[j]] == x[order[i]]:
                at = order[j]
                value, who = tree.top(int(ranks[at]))
                value -= cost * float(x[at] + y[at])
                score[at], back[at] = (gain + value, who) if value > 0 else (gain, -1)
                j += 1
            for at in order[i:j]:
                tree.put(int(ranks[at]), (float(score[at]) + cost * float(x[at] + y[at]), int(at)))
            i = j
        used, found = np.zeros(len(x), bool), []
        for end in sorted(range(len(x)), key=lambda a: (-score[a], a)):
            chain, at = [], end
            while at >= 0 and not used[at]:
                used[at] = True
                chain.append(at)
                at = back[at]
            if chain:
                found.append(np.array(chain[::-1]))
    out = []
    for chain in found:
        far = np.maximum(np.diff(x[chain]), np.diff(y[chain])) > max_gap
        out += np.split(chain, np.flatnonzero(far) + 1)
    return out


def _edit(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, bool]]:
    """Columns (step in a, step in b, alike) of a shortest edit of a into b."""
    n, m = len(a), len(b)
    d = [list(range(m + 1))]
    for i in range(1, n + 1):
        row, up = [i], d[-1]
        for j in range(1, m + 1):
            row.append(min(up[j] + 1, row[j - 1] + 1, up[j - 1] + (a[i - 1] != b[j - 1])))
        d.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            out.append((1, 1, bool(a[i - 1] == b[j - 1])))
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            out.append((1, 0, False))
            i -= 1
        else:
            out.append((0, 1, False))
            j -= 1
    return out[::-1]


def _segments(alike: np.ndarray, mismatch: int = MISMATCH) -> list[tuple[int, int]]:
    """Maximal-scoring segments of columns that score 1 or -mismatch (Ruzzo and Tompa)."""
    edges = np.flatnonzero(np.diff(alike.astype(np.int8))) + 1
    starts = np.r_[0, edges]
    ends = np.r_[edges, len(alike)]
    total, stack = 0, []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if not alike[a]:
            total -= mismatch * (b - a)
            continue
        left, total = total, total + b - a
        now = [a, b, left, total]
        while True:
            j = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][2] < now[2]), -1)
            if j < 0 or stack[j][3] >= now[3]:
                stack.append(now)
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(s[0], s[1]) for s in stack]


def _extended(a: list[int], b: list[int]) -> list[tuple[int, int, bool]]:
    """Columns as of _edit from the starts of a and b on, through edits, to the best score (X-drop); at each edit the skip
    behind which most words agree is taken."""
    out: list[tuple[int, int, bool]] = []
    i = j = score = best = keep = 0
    while i < len(a) and j < len(b) and score > best - DROP:
        if a[i] == b[j]:
            out.append((1, 1, True))
            i, j, score = i + 1, j + 1, score + 1
            if score > best:
                best, keep = score, len(out)
            continue
        most, p, q = -1, 1, 1
        for u, v in SKIPS:
            same = sum(map(int.__eq__, a[i + u : i + u + LOOK], b[j + v : j + v + LOOK]))
            if same > most:
                most, p, q = same, u, v
        for _ in range(max(p, q)):
            out.append((min(p, 1), min(q, 1), False))
        i, j, score = i + p, j + q, score - MISMATCH * max(p, q)
    return out[:keep]


def aligned(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], k: int = K, min_words: int = MIN_WORDS, min_alike: float = MIN_ALIKE) -> list[tuple[int, int, int, int, float]]:
    """Passages (start and end in a, start and end in b, share alike) under a chain of k-word matches at x, y."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def along(i: int, j: int, n: int) -> None:
        parts.append((np.arange(i, i + n), np.arange(j, j + n), a[i : i + n] == b[j : j + n]))

    def columns(i: int, j: int, steps: list[tuple[int, int, bool]]) -> None:
        if steps:
            step = np.array(steps, int)
            parts.append((i + np.cumsum(step[:, 0]) - step[:, 0], j + np.cumsum(step[:, 1]) - step[:, 1], step[:, 2].astype(bool)))

    lead = _extended(a[: x[0]][::-1].tolist(), b[: y[0]][::-1].tolist())[::-1]
    columns(x[0] - sum(c[0] for c in lead), y[0] - sum(c[1] for c in lead), lead)
    i, j = x[0], y[0]
    for to_i, to_j in zip([*x[1:], x[-1] + k], [*y[1:], y[-1] + k], strict=True):
        if to_i - i == to_j - j:
            along(i, j, to_i - i)
        else:
            columns(i, j, _edit(a[i:to_i], b[j:to_j]))
        i, j = to_i, to_j
    columns(i, j, _extended(a[i:].tolist(), b[j:].tolist()))
    in_a, in_b, alike = (np.concatenate(p) for p in zip(*parts, strict=True))
    out = []
    for start, end in _segments(alike):
        s, e, t, f = int(in_a[start]), int(in_a[end - 1]) + 1, int(in_b[start]), int(in_b[end - 1]) + 1
        share = float(alike[start:end].mean())
        if min(e - s, f - t) >= min_words and share >= min_alike:
            out.append((s, e, t, f, share))
    return out


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, node, at) in order -> (node, other, x, y): each place of a seed with its place in the first node.

    Of several places in the first node, the r-th is matched with a node's r-th (the last with all that follow), so that
    periodic texts keep their order. Held over batches are the first node's places, no more than one text's.
    """
    seed = head = last = None  # of the run at hand: its seed, first node, and the node seen last with its count
    places, count = np.zeros(0, np.int32), 0

    for batch in batches:
        s, v, p = (column.to_numpy() for column in batch.columns)
        cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
        # A run that goes on from the batch before, then the runs that begin here, all at once.
        begin = (int(cuts[0]) if len(cuts) else len(s)) if len(s) and s[0] == seed else 0
        out = []
        if begin:
            own, at = v[:begin], p[:begin]
            places = np.concatenate([places, at[own == head]])
            out.append((own, np.full(begin, head), at, places[np.minimum(_ranks(own, last, count), len(places) - 1)]))
        if begin < len(s):
            runs = np.r_[begin, cuts[cuts > begin]]
            run = np.repeat(np.arange(len(runs)), np.diff(np.r_[runs, len(s)]))
            own, at = v[begin:], p[begin:]
            first = v[runs][run]
            firsts = np.bincount(run, weights=own == first, minlength=len(runs)).astype(np.int64)
            rank = np.minimum(_ranks(own, None, 0, run), firsts[run] - 1)
            out.append((own, first, at, p[runs[run] + rank]))
            seed, head = s[-1], v[runs[-1]]
            places, last, count = p[runs[-1] : runs[-1] + firsts[-1]], None, 0
        if len(s):
            tail = int(np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (s[1:] != s[:-1])])[-1])
            count = len(s) - tail + (count if tail == 0 and begin == len(s) and last == v[-1] else 0)
            last = v[-1]
        for own, first, at, y in out:
            apart = own != first
            if apart.any():
                yield pa.record_batch([pa.array(c[apart]) for c in (own, first, at, y)], names=["node", "other", "x", "y"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_matches, and for the first node's own places: those beyond the next node's count, each with that node's last place,
    and every place that another node has too, as a row (node, node, at, at). Held are two texts' places of one seed."""
    names = ["node", "other", "x", "y"]
    waiting: list[pa.RecordBatch] = []
    held: list[np.ndarray] | None = None
    done = None  # the seed whose first two nodes have been dealt with, while its run goes on

    def fed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting.append(batch)
            yield batch

    def dealt(s: np.ndarray, v: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows of whole runs (or of their first two nodes)."""
        new_run = np.r_[True, s[1:] != s[:-1]]
        starts = np.flatnonzero(new_run | np.r_[True, v[1:] != v[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(s)]))
        is_head = new_run[starts]
        again = np.r_[~is_head[1:], False] & is_head  # heads with a node behind them
        rank = np.arange(len(s)) - starts[group]
        size = np.diff(np.r_[starts, len(s)])
        own = np.flatnonzero(again[group])
        if len(own):
            yield pa.record_batch([pa.array(c) for c in (v[own], v[own], p[own], p[own])], names=names)
            more = own[rank[own] >= size[group[own] + 1]]
            if len(more):
                behind = group[more] + 1
                yield pa.record_batch([pa.array(c) for c in (v[starts[behind]], v[more], p[starts[behind] + size[behind] - 1], p[more])], names=names)

    def heads() -> Iterator[pa.RecordBatch]:
        nonlocal held, done
        while waiting:
            s, v, p = (column.to_numpy() for column in waiting.pop(0).columns)
            if done is not None:
                rest = s != done
                s, v, p = s[rest], v[rest], p[rest]
            if not len(s):
                continue
            if held is not None:
                s, v, p = (np.concatenate(c) for c in zip(held, (s, v, p), strict=True))
            done = None
            tail = int(np.flatnonzero(np.r_[True, s[1:] != s[:-1]])[-1])
            if np.count_nonzero(v[tail + 1 :] != v[tail:-1]) >= 2:
                done, tail = s[-1], len(s)
            if tail:
                yield from dealt(s[:tail], v[:tail], p[:tail])
            held = [s[tail:], v[tail:], p[tail:]] if tail < len(s) else None

    for out in _matches(fed()):
        yield out
        yield from heads()
    yield from heads()
    if held is not None:
        yield from dealt(*held)


def _ranks(nodes: np.ndarray, last: int | None, count: int, run: np.ndarray | None = None) -> np.ndarray:
    """How many rows of the same node (and run) stand before each; `count` of `last` have gone before."""
    new = nodes[1:] != nodes[:-1]
    if run is not None:
        new |= run[1:] != run[:-1]
    starts = np.flatnonzero(np.r_[True, new])
    rank = np.arange(len(nodes)) - np.repeat(starts, np.diff(np.r_[starts, len(nodes)]))
    if last is not None and nodes[0] == last:
        rank[: starts[1] if len(starts) > 1 else len(nodes)] += count
    return rank


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of the rows that agree in the first `keys` columns; the rows must be sorted by them."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        n = batch.num_rows
        if not n:
            continue
        differs = np.zeros(n, bool)
        for c in columns[:keys]:
            differs[1:] |= c[1:] != c[:-1]
        differs[0] = bool(held) and any(c[0] != h[-1] for c, h in zip(columns[:keys], held[-1], strict=False))
        cuts = np.flatnonzero(differs)
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, n], strict=True):
            if a in cuts and held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            if b > a:
                held.append([c[a:b] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, other, x, y) in order -> chains that may be long enough, with their matches; as (node, node, starts, ends) the
    ranges whose seeds all stand in other nodes too, whichever these are, if they may hold MIN_WORDS words."""
    names = ["node", "other", "xs", "ys"]
    made: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
        made.clear()
        return pa.record_batch(columns, names=names)

    for nodes, others, all_x, all_y in _by_key(batches, 1):
        node = int(nodes[0])
        places = np.unique(all_x)
        cuts = np.flatnonzero(np.diff(places) > SPAN) + 1
        first, last = places[np.r_[0, cuts]], places[np.r_[cuts, len(places)] - 1]
        wide = last - first + K + 2 * (SPAN - 1) >= MIN_WORDS
        if wide.any():
            made.append((node, node, np.maximum(first[wide] - SPAN + 1, 0).tolist(), (last[wide] + K + SPAN - 1).tolist()))
        cuts = np.flatnonzero(others[1:] != others[:-1]) + 1
        for start, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(others)].tolist(), strict=True):
            x, y = all_x[start:end], all_y[start:end]
            if end - start < 2 or others[start] == node or max(int(x[-1] - x[0]), int(y.max() - y.min())) + K < LEAST_CHAIN:
                continue
            for chain in chains(x, y):
                xs, ys = x[chain], y[chain]
                if min(int(xs[-1] - xs[0]), int(ys[-1] - ys[0])) + K >= LEAST_CHAIN:
                    made.append((node, int(others[start]), xs.tolist(), ys.tolist()))
        if len(made) >= 2000:
            yield flushed()
    if made:
        yield flushed()


def _held_by_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, node, at) in order, a run being MIN_WORDS words -> each place of a run that two nodes or more have, and where
    another has it: its first node, and for this the next one. Held are one text's places of one run."""
    names = ["node", "start", "end", "other", "other_start", "alike"]
    held: list[np.ndarray] | None = None
    seed = head = head_at = None  # the run that goes on, once it has had two nodes

    def rows(v: np.ndarray, p: np.ndarray, other: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        columns = (v, p, p + np.int32(MIN_WORDS), other, at, np.ones(len(v)))
        return pa.record_batch([pa.array(c) for c in columns], names=names)

    def dealt(s: np.ndarray, v: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        ends = np.r_[starts[1:], len(s)]
        run = np.repeat(np.arange(len(starts)), ends - starts)
        own = v == v[starts][run]
        second = starts + np.bincount(run, weights=own).astype(np.int64)
        keep = np.flatnonzero((second < ends)[run])
        if len(keep):
            to = np.where(own[keep], second[run[keep]], starts[run[keep]])
            yield rows(v[keep], p[keep], v[to], p[to])

    for batch in batches:
        s, v, p = (column.to_numpy() for column in batch.columns)
        if seed is not None:
            n = int(np.searchsorted(s, seed, "right")) if len(s) and s[0] == seed else 0
            if n:
                yield rows(v[:n], p[:n], np.full(n, head), np.full(n, head_at, np.int32))
            s, v, p = s[n:], v[n:], p[n:]
        if not len(s):
            continue
        seed = None
        if held is not None:
            s, v, p = (np.concatenate(c) for c in zip(held, (s, v, p), strict=True))
            held = None
        tail = int(np.flatnonzero(np.r_[True, s[1:] != s[:-1]])[-1])
        if v[-1] != v[tail]:
            seed, head, head_at, tail = s[-1], v[tail], p[tail], len(s)
        else:
            held = [s[tail:], v[tail:], p[tail:]]
        if tail:
            yield from dealt(s[:tail], v[:tail], p[:tail])
    if held is not None:
        yield from dealt(*held)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact spans in order of node, other, shift and start -> those that overlap at one shift as one."""
    now: list | None = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        node, start, end, other, at = columns[:5]
        if not len(node):
            continue
        new = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1]) | (start[1:] - at[1:] != start[:-1] - at[:-1]) | (start[1:] > end[:-1])]
        firsts = np.flatnonzero(new)
        lasts = np.r_[firsts[1:], len(node)] - 1
        out = [node[firsts], start[firsts], end[lasts], other[firsts], at[firsts]]
        if now and now[0] == out[0][0] and now[3] == out[3][0] and now[1] - now[4] == out[1][0] - out[4][0] and out[1][0] <= now[2]:
            out[1][0], out[4][0] = now[1], now[4]
        elif now:
            out = [np.r_[np.array([n], c.dtype), c] for n, c in zip(now, out, strict=True)]
        now = [c[-1] for c in out]
        if len(out[0]) > 1:
            yield pa.record_batch([pa.array(c[:-1]) for c in out] + [pa.array(np.ones(len(out[0]) - 1))], names=batch.schema.names)
    if now:
        kinds = (np.int64, np.int32, np.int32, np.int64, np.int32)
        yield pa.record_batch([pa.array(np.array([n], k)) for n, k in zip(now, kinds, strict=True)] + [pa.array(np.ones(1))], names=["node", "start", "end", "other", "other_start", "alike"])


class Hot:
    """Seeds that so many places share that they would fill a good part of a task, and a holder of each, told from one in SAMPLE of all texts. How work is
    dealt depends on them, not what is found: the places of such a seed are dealt into parts by node, each a seed of its own, and its
    holder goes to every part, as its first node. A part is as large as a SHARE-th of what a task has, and HOT places at least, so there
    are a few seeds and parts for each task, whatever the number of texts."""

    def __init__(self, sample: DataFrame, tasks: int):
        """sample: (seed, node, at, less)."""
        sample = cut(sample)
        fair = max(HOT, SAMPLE * sample.count() // (SHARE * tasks))
        many = sample.groupBy("seed").agg(F.count("*").alias("n"), F.min(F.struct("less", "node")).alias("head")).filter(SAMPLE * F.col("n") > fair)
        parts = F.least(F.lit(tasks), F.ceil(SAMPLE * F.col("n") / max(1, fair))).cast("int")
        found = cut(many.select("seed", "head.node", F.greatest(F.lit(2), parts).alias("parts")))
        rows = sorted(map(tuple, found.collect()))
        self.seeds, self.nodes, self.parts = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.sample, self.found = sample, found

    @staticmethod
    def part_of(seeds: np.ndarray, parts: np.ndarray) -> np.ndarray:
        return as_long(mix(seeds.astype(np.int64).view(np.uint64) + (parts.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)))

    def dealt(self) -> Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]:
        """A function of a node's seeds: what they are dealt as, and which rows stay (a holder's own come in heads())."""
        seeds, nodes, parts = self.seeds, self.nodes, self.parts

        def deal(own: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
            if not len(seeds):
                return own, np.ones(len(own), bool)
            at = np.minimum(np.searchsorted(seeds, own), len(seeds) - 1)
            hot = seeds[at] == own
            part = mix(np.array([node], np.int64).view(np.uint64))[0] % parts[at[hot]].view(np.uint64)
            out = own.copy()
            out[hot] = Hot.part_of(own[hot], part)
            return out, ~hot | (nodes[at] != node)

        return deal

    def heads(self) -> DataFrame:
        """The holders' places in every part: (seed, node, at, less), before all others of the part."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                times = batch.column(3).to_numpy().astype(np.int64)
                seed, node, at = (c.to_numpy().repeat(times) for c in batch.columns[:3])
                part = np.arange(len(seed)) - np.repeat(np.cumsum(times) - times, times)
                columns = [pa.array(Hot.part_of(seed, part)), pa.array(node), pa.array(at, pa.int32()), pa.array(np.full(len(at), -(1 << 31)), pa.int32())]
                yield pa.record_batch(columns, names=["seed", "node", "at", "less"])

        places = self.sample.join(self.found, ["seed", "node"]).select("seed", "node", "at", "parts").distinct()
        return places.mapInArrow(spread, "seed long, node long, at int, less int")


def shared(docs: DataFrame, salt: int = 0) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start_word, end_word (exclusive), n_words, other_id, other_start, alike."""
    tasks = sized(docs)
    row_hash = F.xxhash64("doc_id", "text")

    def keyed(words: np.ndarray) -> tuple[int, int]:
        low, high = np.frombuffer(xxhash.xxh3_128_digest(words.tobytes(), seed=salt), np.int64)
        return int(low), int(high)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(words), *keyed(words)) for words in words_of(batch.column(1))]
            columns = [batch.column(0).cast(pa.int64()), batch.column(2)] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.record_batch(columns, names=["doc_id", "row_hash", "size", "node", "check"])

    schema = "doc_id long, row_hash long, size long, node long, check long"
    rows = cut(docs.select("doc_id", "text", row_hash.alias("row_hash")).mapInArrow(counted, schema).filter(F.col("size") >= MIN_WORDS))
    known = cut(
        rows.groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("copies"), F.max("size").alias("size"),
            F.min("row_hash").alias("row_hash"), (F.min("check") != F.max("check")).alias("clash"),
        )
    )
    if not known.filter("clash").isEmpty():
        return shared(docs, salt + 1)

    def seeded(deal: Callable) -> Callable:
        """The seeds of each text that the task meets first: (node, seeds, places, less), less being minus how often the text has the seed."""

        def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                nodes, found, places, less = [], [], [], []
                for words in words_of(batch.column(0)):
                    if len(words) < MIN_WORDS or (node := keyed(words)[0]) in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(node)
                    grams = windows(words, K)
                    at = seeds(grams)
                    _, which, times = np.unique(grams[at], return_inverse=True, return_counts=True)
                    own, stays = deal(as_long(grams[at]), node)
                    nodes.append(node)
                    found.append(own[stays])
                    places.append(at.astype(np.int32)[stays])
                    less.append(-times[which].astype(np.int32)[stays])
                columns = [pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(less, pa.list_(pa.int32()))]
                yield pa.record_batch(columns, names=["node", "seeds", "places", "less"])

        return found_in

    def shown(texts: DataFrame, deal: Callable) -> DataFrame:
        made = texts.select("text").mapInArrow(seeded(deal), "node long, seeds array<long>, places array<int>, less array<int>")
        return made.select("node", F.inline(F.arrays_zip("seeds", "places", "less"))).toDF("node", "seed", "at", "less").select("seed", "node", "at", "less")

    in_sample = F.pmod(row_hash, F.lit(SAMPLE)) == 0
    hot = Hot(shown(docs.filter(in_sample), lambda own, node: (own, np.ones(len(own), bool))), tasks)
    matches = (
        shown(docs, hot.dealt())
        .unionByName(hot.heads())
        .repartition(tasks, "seed")
        .sortWithinPartitions("seed", "less", "node", "at")
        .select("seed", "node", "at")
        .mapInArrow(_linked, "node long, other long, x int, y int")
    )
    # A text that several tasks have met gives each of its matches several times: distinct.
    found = cut(
        matches.distinct()
        .repartition(tasks, "node")
        .sortWithinPartitions("node", "other", "x", "y")
        .mapInArrow(_chained, "node long, other long, xs array<int>, ys array<int>"),
        release=True,
    )

    # The words of these nodes are made anew: texts aren't shuffled, and a bitmap keeps out those of other rows.
    wanted = cut(found.select("node").unionByName(found.select(F.col("other").alias("node"))).distinct().join(known, "node").select("node", "row_hash"))
    hits = may_have(docs.select("doc_id", "text"), row_hash, key_filter(wanted, "row_hash")).filter("_hit").select(F.col("_row.text").alias("text"))

    def as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own, data = [], []
            for words in words_of(batch.column(0)):
                node = keyed(words)[0]
                if node not in seen:
                    if len(seen) < 200_000:
                        seen.add(node)
                    own.append(node)
                    data.append(words.astype(np.uint32).tobytes())
            yield pa.record_batch([pa.array(own, pa.int64()), pa.array(data, pa.binary())], names=["node", "words"])

    words = cut(hits.mapInArrow(as_words, "node long, words binary").join(wanted, "node", "left_semi").dropDuplicates(["node"]), release=True)
    margin = MIN_WORDS

    def sliced(df: DataFrame, who: str, places: str, name: str) -> DataFrame:
        """With the words of `who` from a little before the chain to a little behind it, and where they begin."""
        start = F.greatest(F.lit(0), F.element_at(places, 1) - margin)
        length = F.element_at(places, -1) + K + margin - start
        joined = df.join(words.withColumnRenamed("node", who), who)
        return joined.withColumns({f"{name}_start": start, name: F.substring("words", 4 * start + 1, 4 * length)}).drop("words")

    def runs(deal: Callable) -> Callable:
        def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for node, starts, ends, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = np.frombuffer(data, np.uint32)
                    for start, end in zip(starts, ends, strict=True):
                        hashes = long_windows(own[start:end], MIN_WORDS)
                        if len(hashes):
                            dealt, stays = deal(as_long(hashes), node)
                            at = np.arange(start, start + len(hashes), dtype=np.int32)[stays]
                            columns = [pa.array(dealt[stays]), pa.array(np.full(len(at), node, np.int64)), pa.array(at), pa.array(np.zeros(len(at), np.int32))]
                            yield pa.record_batch(columns, names=["seed", "node", "at", "less"])

        return found_in

    span_schema = "node long, start int, end int, other long, other_start int, alike double"
    own, some = found.filter("node = other").select("node", "xs", "ys"), F.pmod("node", F.lit(SAMPLE)) == 0
    run_schema = "seed long, node long, at int, less int"
    hot_runs = Hot(own.filter(some).join(words.filter(some), "node").mapInArrow(runs(lambda own, node: (own, np.ones(len(own), bool))), run_schema), tasks)
    exact = (
        own.join(words, "node")
        .mapInArrow(runs(hot_runs.dealt()), run_schema)
        .unionByName(hot_runs.heads())
        .withColumnRenamed("seed", "run")
        .repartition(tasks, "run")
        .sortWithinPartitions("run", "less", "node", "at")
        .select("run", "node", "at")
        .mapInArrow(_held_by_two, span_schema)
        .repartition(tasks, "node")
        .sortWithinPartitions("node", "other", F.col("start") - F.col("other_start"), "start")
        .mapInArrow(_joined, span_schema)
    )

    both = sliced(sliced(found.filter("node != other"), "node", "xs", "a"), "other", "ys", "b").select("node", "other", "xs", "ys", "a_start", "a", "b_start", "b")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                node, other, xs, ys, a0, a, b0, b = row
                for s, e, t, f, share in aligned(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), [v - a0 for v in xs], [v - b0 for v in ys]):
                    out.append((node, s + a0, e + a0, other, t + b0, share))
                    out.append((other, t + b0, f + b0, node, s + a0, share))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
                yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["node", "start", "end", "other", "other_start", "alike"])

    spans = both.mapInArrow(passages, span_schema).unionByName(exact)
    # The spans of a node that overlap are one; it names the widest of its matches.
    spans = spans.groupBy("node", "start", "end").agg(F.max(F.struct("alike", "other", "other_start")).alias("best"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "start", "end", "other", "other_start", "alike"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
        now: list | None = None
        for batch in batches:
            out = []
            for node, start, end, other, other_start, alike in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[0] == node and start < now[2]:
                    if end - start > now[6]:
                        now[3:] = other, other_start, alike, end - start
                    now[2] = max(now[2], end)
                    continue
                if now:
                    out.append(now)
                now = [node, start, end, other, other_start, alike, end - start]
            if out:
                yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)
        if now:
            yield pa.record_batch([pa.array([now[i]], k) for i, k in enumerate(kinds)], names=names)

    flat = spans.select("node", "start", "end", "best.other", "best.other_start", "best.alike").repartition(tasks, "node").sortWithinPartitions("node", "start", "end")
    kept = flat.mapInArrow(merged, "node long, start int, end int, other long, other_start int, alike double")
    # Copies: the text from end to end, beside another that has it; of other texts, each copy has each passage.
    whole = known.filter("copies > 1").select("node", F.lit(0).alias("start"), F.col("size").cast("int").alias("end"), F.col("node").alias("other"), F.lit(0).alias("other_start"), F.lit(1.0).alias("alike"))
    single = kept.join(whole.select("node"), "node", "left_anti")
    named = whole.unionByName(single).join(known.select(F.col("node").alias("other"), "first_id", "last_id"), "other")
    other_id = F.when((F.col("node") == F.col("other")) & F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("last_id")).otherwise(F.col("first_id"))
    return rows.select("doc_id", "node").join(named, "node").select(
        "doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"),
        other_id.alias("other_id"), "other_start", F.round("alike", 4).alias("alike"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents of the corpus share."""
    return shared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
