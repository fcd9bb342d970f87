import random

import numpy as np
import pyarrow as pa
from hustings.llm import passages as P

from tests.conftest import SMALL


def test_chains_are_best():
    rng = random.Random(1)
    for _ in range(200):
        points = list({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 30))})
        x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
        found = P.chains(x, y, max_gap=10**6)
        assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in found) and sorted(np.concatenate(found)) == list(range(len(points)))
        order, best = np.lexsort((y, x)), [0.0] * len(points)
        if np.all(np.diff(x[order]) > 0) and np.all(np.diff(y[order]) > 0):
            continue
        for i in order:
            best[i] = 20 + max([0.0] + [best[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) for j in range(len(points)) if x[j] < x[i] and y[j] < y[i]])
        c = found[0]
        assert abs(20 * len(c) - 0.1 * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) - max(best)) < 1e-6


def test_matches_over_batches():
    rng = random.Random(4)
    make = lambda rows: pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "c"])
    for _ in range(500):
        rows = sorted({(rng.randint(0, 3), rng.randint(0, 4), rng.randint(0, 8)) for _ in range(rng.randint(0, 40))})
        want = []
        for s in {r[0] for r in rows}:
            run = [r for r in rows if r[0] == s]
            places = [r[2] for r in run if r[1] == run[0][1]]
            for n in {r[1] for r in run} - {run[0][1]}:
                want += [(n, run[0][1], r[2], places[min(k, len(places) - 1)]) for k, r in enumerate(r for r in run if r[1] == n)]
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 6)))
        batches = [make(rows[a:b]) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        assert sorted(r for b in P._matches(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)) == sorted(want)


def test_finds_what_documents_share(spark):
    texts = {r["doc_id"]: r["text"].encode().lower().split() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    seen = {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(d)
    want = {d for ds in seen.values() if len(ds) > 1 for d in ds}
    rows = P.op2_substring_dedup(spark, SMALL).collect()
    assert want <= {r["doc_id"] for r in rows}
    for r in rows:
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["other_id"]]
        assert r["doc_id"] != r["other_id"] and len(a) == r["n_words"] >= 50
        assert len(set(a) & set(b)) >= 0.7 * len(set(a))


def test_fuzzy_passages_and_clean_documents(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = [word() for _ in range(90)]
    edited = list(passage)
    edited[30] = word()
    del edited[60]
    edited.insert(75, word())
    rows = [(i, " ".join(word() for _ in range(300))) for i in range(20)]
    rows += [(100, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)])), (101, " ".join([word() for _ in range(10)] + edited + [word() for _ in range(70)]))]
    rows += [(200, rows[3][1]), (201, None), (202, "")]
    got = {r["doc_id"]: r for r in P.shared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {3, 200, 100, 101}
    assert (got[3]["other_id"], got[200]["other_id"], got[3]["n_words"]) == (200, 3, 300)
    assert abs(got[100]["start_word"] - 40) <= 1 and abs(got[100]["end_word"] - 130) <= 1 and got[101]["alike"] > 0.9


def test_odd_rows(spark, odd_docs):
    assert {r["doc_id"] for r in P.shared(odd_docs).collect()} == {4, 5, 6}
    assert P.shared(odd_docs.limit(0)).count() == 0


def covered(spark, texts):
    """Rows of `texts` (lists of words), and the words of each that stand in them."""
    rows = P.shared(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    found = {i: set() for i in range(len(texts))}
    for r in rows:
        found[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    return rows, found


def all_shared(texts, n=50):
    """Places of words in runs of n words that two texts have."""
    seen = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - n + 1):
            seen.setdefault(tuple(t[at : at + n]), []).append((i, at))
    want = {i: set() for i in range(len(texts))}
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, at in places:
                want[i] |= set(range(at, at + n))
    return want


def test_runs_whose_parts_other_texts_hold(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    line, texts = words(45), []
    texts += [words(20) + line + line + words(20) for _ in range(3)] + [words(30) + line + words(30) for _ in range(10)]
    for _ in range(30):  # two texts share 55 words that begin with the line; others hold each half of 60
        tail, one, two = words(10), words(30), words(30)
        texts += [words(20) + line + tail + words(20), words(31) + line + tail + words(9)]
        texts += [words(9) + one + two + words(9), words(15) + one + two + words(4), words(20) + one + one + words(20), words(20) + two + two + words(20)]
    want = all_shared(texts)
    assert sum(map(bool, want.values())) == 123
    _, found = covered(spark, texts)
    assert all(want[i] <= found[i] for i in want)
    assert all(found[i] == set() for i in want if not want[i])


def test_every_place_of_a_passage(spark):
    rng = random.Random(13)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    passage, other = words(60), words(50)
    texts = [passage + words(100) + passage, words(40) + passage + words(40), words(10) + other + words(80) + other + words(80) + other, other + words(70) + other, words(30) + other]
    edited = words(80)
    near = [*edited[:40], *words(1), *edited[41:]]
    texts += [edited + words(90) + edited, words(30) + near + words(10)]
    want = all_shared(texts)
    want[5] |= set(range(3, 77)) | set(range(173, 247))
    _, found = covered(spark, texts)
    assert all(want[i] <= found[i] for i in want)
    assert len(found[0]) == 120


def test_linked_over_batches():
    rng = random.Random(5)
    make = lambda rows: pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "c"])
    rows_of = lambda batches: sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for _ in range(500):
        rows = sorted({(rng.randint(0, 3), rng.randint(0, 4), rng.randint(0, 8)) for _ in range(rng.randint(0, 40))})
        want, windows = rows_of(P._matches(iter([make(rows)]))), []
        for s in {r[0] for r in rows}:
            places = {}
            for _, n, p in (r for r in rows if r[0] == s):
                places.setdefault(n, []).append(p)
            if len(places) > 1:
                (head, own), (second, theirs) = list(places.items())[:2]
                want += [(head, head, p, p) for p in own] + [(second, head, theirs[-1], p) for p in own[len(theirs) :]]
                windows += [(n, p, p + 50, *((second, theirs[0]) if n == head else (head, own[0])), 1.0) for n, ps in places.items() for p in ps]
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 6)))
        batches = [make(rows[a:b]) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        assert rows_of(P._linked(iter(batches))) == sorted(want)
        assert rows_of(P._held_by_two(iter(batches))) == sorted(windows)


def test_recall_by_edit_rate(spark):
    rng = random.Random(14)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    texts, cases = [], []
    for every, size in ((20, 60), (10, 60), (10, 100), (8, 60), (8, 100), (None, 60)):
        for _ in range(20):
            passage = words(size)
            edited = list(passage)
            for at in [6, size - 7] if every is None else range(every // 2, size, every):
                edited[at] = words(1)[0]
            if every == 20:
                del edited[25]
            cases.append((len(texts), size, every))
            texts += [words(40) + passage + words(40), words(25) + edited + words(60)]
    texts += [words(200) for _ in range(20)]
    rows, found = covered(spark, texts)
    assert all(len(found[at] & set(range(40, 40 + size))) >= size - 8 and found[at + 1] for at, size, _ in cases)
    assert all(r["alike"] >= P.MIN_ALIKE and r["doc_id"] < 2 * len(cases) for r in rows)


def test_seeds_of_very_many_places(spark, monkeypatch):
    """Dealt in parts, a seed's holders still meet its first node: nothing that documents share exactly is lost."""
    monkeypatch.setattr(P, "HOT", 1)
    monkeypatch.setattr(P, "SAMPLE", 2)
    monkeypatch.setattr(P, "SHARE", 100_000)
    test_finds_what_documents_share(spark)


def test_null_and_shared_ids(spark):
    """Texts are told apart whatever their ids."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(30)) for _ in range(6)]
    for one in (None, 3):
        rows = P.shared(spark.createDataFrame([(one, t) for t in texts], "doc_id long, text string")).collect()
        assert len(rows) == 6 and all((r["start_word"], r["end_word"], r["doc_id"]) == (30, 100, one) for r in rows)
