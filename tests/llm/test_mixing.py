import itertools
import random

from hustings.llm import mixing as M
from pyspark.sql import functions as F

from tests.conftest import SMALL


def test_targets():
    assert M.targets_of([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 250 * 2 / 3]
    assert M.targets_of([], []) == [] and M.targets_of([0, 10], [1, 1]) == [0, 15]
    found = M.targets_of([10, 1000, 500, 3], [3, 1, 2, 3])
    assert all(t <= 2 * s for t, s in zip(found, [10, 1000, 500, 3], strict=True)) and abs(sum(found) - 1.5 * 1513) < 1e-6


def test_flow_is_cheapest():
    rng = random.Random(5)
    for _ in range(60):
        patterns = [(m, rng.randint(0, 3)) for m in ((0,), (1,), (0, 1))]
        quotas = [rng.randint(0, 5), rng.randint(0, 5)]
        got = M.min_cost_flow(patterns, quotas)
        best = None
        choices = [[(a, b) for a in range(2 * w + 1) for b in range(2 * w + 1 - a) if (a == 0 or 0 in m) and (b == 0 or 1 in m)] for m, w in patterns]
        for pick in itertools.product(*choices):
            into = [sum(x[s] for x in pick) for s in (0, 1)]
            if all(i <= q for i, q in zip(into, quotas, strict=True)):
                cost = sum(min(sum(x), w) + 3 * max(0, sum(x) - w) for x, (_, w) in zip(pick, patterns, strict=True))
                best = min(best or (0, 0), (-sum(into), cost)) if best is not None else (-sum(into), cost)
        flat = sum(map(sum, got))
        assert (-flat, sum(a + 3 * b for a, b in got)) == best


def test_whole_corpus(spark):
    first = M.op9_mixing(spark, SMALL)
    rows = first.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.op9_mixing(spark, SMALL).collect()))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"], 0])
        s[0], s[1], s[4] = s[0] + r["taken"], s[1] + r["size"], max(s[4], r["size"])
    for taken, size, target, stated, largest in by.values():
        assert size == stated and target <= 2 * size + 1e-6 and abs(taken - target) <= largest


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b", None], 10) for i in range(300)], "doc_id long, sources array<string>, size long")
    got = M.mixed(docs, weights=(1, 1, 1)).agg(F.sum("taken"), F.max("copies")).first()
    assert abs(got[0] - 1.5 * 5000) <= 2600 and got[1] <= 2


def test_odd_rows(spark, odd_docs):
    sized = M.measured(odd_docs)
    assert M.mixed(sized).count() == odd_docs.count()
    assert M.stage(spark, odd_docs, "").columns == odd_docs.columns
    assert M.mixed(M.measured(odd_docs.limit(0))).count() == 0


def test_ties(spark, monkeypatch):
    """Rows that are alike: as many are taken as come nearest the target, whether ids are equal, null or a part of them."""
    monkeypatch.setattr(M, "MOST_IN_BIN", 3)
    rows = [(1, ["a"], 20)] * 600 + [(None, ["b"], 7)] * 300 + [(i, ["b"], 7) for i in range(300)] + [(5, ["c"], 0)] * 4 + [(6, None, 11)]
    found = M.mixed(M.cut(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")), weights=(1, 3, 1))
    got = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n"), F.max("copies").alias("copies")).collect()
    assert sum(r["n"] for r in got) == len(rows)
    assert [r["taken"] for r in got if r["source"] is None] == [0]
    for r in got:
        assert r["source"] is None or abs(r["taken"] - r["target"]) <= {"a": 20, "b": 7, "c": 0}[r["source"]] and r["copies"] <= 2


def test_draw_against_brute_force(spark, monkeypatch):
    """Whole rows in the order of the hash, until they come nearest the goal."""
    monkeypatch.setattr(M, "MOST_IN_BIN", 2)
    rng = random.Random(8)
    docs = M.cut(spark.createDataFrame([(i % 150, [rng.choice("xyz")], rng.randint(0, 40)) for i in range(400)], "doc_id long, sources array<string>, size long"))
    rows = M.mixed(docs).withColumn("draw", F.xxhash64("doc_id", "size", F.lit(M.SEED))).collect()
    for source in "xyz":
        mine = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["draw"] % (1 << 64), r["size"]))
        goal, had = round(mine[0]["target"]), 0
        whole = sum(r["size"] for r in mine)
        for level in range(2):
            wanted, had, ended = min(max(goal - level * whole, 0), whole), 0, False
            want = 0
            for r in mine:
                ended = ended or (r["size"] > 0 and 2 * (wanted - had) < r["size"])
                want += 0 if ended else r["size"]
                had += r["size"]
            assert want == sum(r["size"] for r in mine if r["copies"] > level)


def test_stage_draws_whole_rows(spark):
    """Repeated rows keep their columns; what is taken is near the targets."""
    rows = [(1, "one two three four", "s", 5)] * 50 + [(i, "five six", "t", i) for i in range(100)] + [(2, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = M.stage(spark, docs, "")
    words = got.groupBy("source").agg(F.sum(M.word_count(F.col("text"))).alias("n")).collect()
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)
    targets = dict(zip("st", M.targets_of([200, 200], [3, 1]), strict=True))
    assert all(abs(r["n"] - targets[r["source"]]) <= 4 for r in words if r["source"])
