"""Word and shingle hashes of many texts at once, shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GOLDEN = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed at once; a longer text is cut at white space.
SLICE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    """A value for each byte, the same for A-Z and a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


LETTERS = _letters()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, n of them at least; made once a process."""
    if len(_POWERS[0]) < n:
        n = max(n, SLICE)
        for i, base in enumerate((GOLDEN, pow(GOLDEN, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def _hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one behind the other, and how many words begin before each bound.

    A word's hash is a difference of running sums of letter * base^place, moved to place 0.
    """
    up, down = _powers(len(data))
    inside = ~IS_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    terms = LETTERS[data]
    terms *= up[: len(data)]
    sums = np.cumsum(terms)
    word = sums[last] - (sums[first] - terms[first])
    return mix(word * down[first] + (last - first).astype(np.uint64)), np.searchsorted(first, bounds)


def _long(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, slice by slice."""
    out, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):
            spaces = np.flatnonzero(IS_SPACE[data[end : end + SLICE]])
            if len(spaces):
                end += int(spaces[0])
                break
            end = min(end + SLICE, len(data))
        out.append(_hashes(data[at:end], np.array([0]))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """64-bit hashes of the words ([^\\x20\\x09-\\x0D]+, A-Z as a-z) of texts: for texts i to j, all words, and where each
    text's begin (j - i + 1 places). Null texts have none. Slices are as large as SLICE, or one longer text."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, ends, raw = column.buffers()
    places = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(places, places[i] + SLICE, "right")) - 1)
        part = data[places[i] : places[j]]
        if len(part) > 2 * SLICE:
            words = _long(part)
            yield i, j, words, np.array([0, len(words)])
        elif len(part):
            yield i, j, *_hashes(part, places[i : j + 1] - places[i])
        else:
            yield i, j, np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64)
        i = j


def words_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for i, j, words, at in word_hashes(texts):
        for k in range(j - i):
            yield words[at[k] : at[k + 1]]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows in order; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    factor = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * factor[i]
    return mix(out)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As word_hashes, but the k-word shingles of each text, sorted and each once."""
    for i, j, words, at in word_hashes(texts):
        n = np.diff(at)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        begin = np.r_[0, np.cumsum(count)]
        place = np.arange(begin[-1]) + np.repeat(at[:-1] - begin[:-1], count)
        grams = windows(words, k) if len(words) >= k else np.zeros(0, np.uint64)
        short = np.flatnonzero((n > 0) & (n < k))
        # A short text's place may lie behind the last window; its value is put in below.
        values = grams[np.minimum(place, max(0, len(grams) - 1))] if len(grams) else np.zeros(len(place), np.uint64)
        for t in short:
            values[begin[t]] = windows(words[at[t] : at[t + 1]], k)[0]
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            values[a:b].sort()
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        new[begin[:-1][count > 0]] = True
        sums = np.r_[0, np.cumsum(new)]
        yield i, j, values[new], sums[begin]


def long_windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows in order, in time that doesn't depend on k: differences of sums of word * B^place; none if shorter."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(words.astype(np.uint64) + np.uint64(GOLDEN)) * up[:n])]
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
