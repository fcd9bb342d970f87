import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hustings.llm import jaccard as J
from hustings.llm import shingles as S


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)]


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 160))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            at = rng.randrange(len(words))
            rng.choice((lambda: words.insert(at, rng.choice(vocabulary)), lambda: words.pop(at) if len(words) > 1 else None, lambda: words.__setitem__(at, rng.choice(vocabulary))))()
        rows.append((i * 3 % 1009, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("hot", [None, 20])
def test_against_brute_force(spark, monkeypatch, hot):
    """With blocks of a few nodes; then also with all signatures dealt as those that very many nodes show, and no cells joined."""
    monkeypatch.setattr(J, "BLOCK_BYTES", 600)
    if hot:
        monkeypatch.setattr(J, "MOST_BLOCKS", 0)
        monkeypatch.setattr(J, "HOT", -(1 << 40))
    rows = corpus(1, 300) + [(5000, None), (5001, ""), (5002, "Alone"), (5003, "alone"), (5004, "ALONE ")]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 4, 85))


def test_shared_and_null_ids(spark):
    """The classes don't depend on ids: with none, and with one for all rows."""
    rows = corpus(2, 120)
    want = brute([(i, t) for i, (_, t) in enumerate(rows)], 5, 80)
    classes = sorted(sum(1 for w in want if w[2] == c) for c in {w[2] for w in want})
    for one in (None, 7):
        got = J.join(spark.createDataFrame([(one, t) for _, t in rows], "doc_id long, text string"), 5, 80).collect()
        assert len(got) == len(rows) and {r["component_id"] for r in got} == {one}
        keys = [r["class_key"] for r in got]
        assert sorted(keys.count(k) for k in set(keys)) == classes


def sets_of(texts, k):
    out = []
    for i, j, values, at in S.shingle_sets(pa.array(texts, pa.string()), k):
        out += [values[at[t] : at[t + 1]] for t in range(j - i)]
    return out


@pytest.mark.parametrize("size", [1 << 21, 64, 5])
def test_shingles(monkeypatch, size):
    """Sets and their order don't depend on how texts are sliced; unlike sets get unlike hashes."""
    monkeypatch.setattr(S, "SLICE", size)
    rng = random.Random(3)
    texts = [None, "", "  \n", "a", "A b", "a b c d e a b c d", " x\x0by\x0cz\x85q é"] + ["".join(rng.choice("aAbB \t\nzé") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    known = {}
    for k in (1, 4):
        for text, own in zip(texts, sets_of(texts, k), strict=True):
            want = shingles(text, k)
            assert len(own) == len(want)
            assert known.setdefault(want, own.tolist()) == own.tolist()
    assert len({tuple(v) for v in known.values()}) == len(known)


def test_bands_cover_all_links():
    """Linked sizes have a class in common, in which both differ in fewer shingles than there are groups."""
    for percent in (80, 85):
        bands = J.Bands(percent)
        for a in range(1, 500):
            for b in range(a, a * 100 // percent + 1):
                n, c = np.array([a, b]), np.full(2, bands.own(np.array([a]))[0])
                assert c[0] in (bands.own(n[1:])[0], bands.below(n[1:])[0])
                least = a + b - 2 * bands.needed(a, b)
                assert (bands.spoilt(n, c) >= least).all() and (least == 0 or bands.groups[c[0]] > bands.spoilt(n, c).max())


def test_linked_sets_show_a_group_alike():
    bands, rng = J.Bands(80), np.random.default_rng(5)
    for n in (6, 9, 14, 40, 150, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = rng.integers(0, len(a) // 5 + 1)
            b = np.unique(np.r_[a[drop:], rng.integers(0, 1 << 63, rng.integers(0, 3)).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or drop == 0 and len(a) == len(b):
                continue
            at, values, sizes = np.array([0, len(a), len(a) + len(b)]), np.r_[a, b], np.array([len(a), len(b)])
            own, points = J.signatures(values, at, bands.own(sizes), bands)
            low, _ = J.signatures(values, at, bands.below(sizes), bands)
            shown = [set(x.tolist() if x is not None else []) | set(y.tolist() if y is not None else []) for x, y in zip(own, low, strict=True)]
            assert shown[0] & shown[1]


def test_tree_cuts_no_link():
    rng, bands = np.random.default_rng(3), J.Bands(85)
    points = rng.poisson(3, (300, 40)).astype(np.uint16)
    points[1::2] = np.maximum(points[::2].astype(int) + rng.integers(-1, 2, (150, 40)), 0)
    sizes = points.sum(axis=1, dtype=np.int64)
    tree = J.CountTree(sizes, points)
    for i in range(300):
        bound = np.minimum(points, points[i]).sum(axis=1, dtype=np.int64)
        assert set(tree.search(int(sizes[i]), points[i], bands)) == set(np.flatnonzero(bound >= bands.needed(sizes[i], sizes)))


def test_odd_rows_and_stage(spark, odd_docs):
    rows = J.join(odd_docs, 5, 80).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5, 6)} == {4}
    kept = J.stage(spark, odd_docs, "")
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert kept.columns == odd_docs.columns and ids == sorted(map(str, [1, 2, 3, 4, None, 7, 8, 9]))
    assert J.join(odd_docs.limit(0), 4, 85).count() == 0
    assert J.stage(spark, odd_docs.limit(0), "").count() == 0
