"""Mixing sources to target weights as a min-cost flow.

Documents are summed by membership pattern (the sorted set of sources a document belongs to). The
network runs from each pattern, through one arc for each repetition level (its cost grows with the
level, so it is convex, and first copies go before second ones), to the pattern's sources, and from
each source to its quota. Successive shortest paths find the cheapest flow that fills the quotas.
What flows from a pattern at its level r is the number of words taken from the r-th copies; whole
documents are then drawn, in the order of a seeded hash, until they come nearest that number.

The network has an arc for each pattern, level and source: it is small beside the documents and is read to
the driver, which refuses more than MAX_PATTERNS patterns. Sources that share no document with others are
filled without a network. Drawing never sorts a whole source: sizes are summed into 2^BIN_BITS bins of the hash range, the bin in which
the draw ends into as many again, until a bin has MOST_IN_BIN rows at most, and only that is put in order.

Cases: a null text has no words, and its document is never taken; a null source is a source of its own,
last in order; a document of no source is never taken. Repeated rows are documents each. Rows that are alike share a hash; where a draw ends among
them, as many are taken as come nearest the goal, and which of them doesn't show. A source
without words has the target 0. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, cut

MAX_PATTERNS, MAX_BROADCAST = 1_000_000, 100_000
BIN_BITS, MOST_IN_BIN = 12, 50_000
SEED = 7


def targets_of(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """`share` of all sizes by weight; none above `most` times its size, the excess dealt anew by weight."""
    total, target, rest = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while rest:
        by = sum(weights[i] for i in rest)
        over = [i for i in rest if total * weights[i] > most * sizes[i] * by]
        if not over:
            for i in rest:
                target[i] = total * weights[i] / by
            break
        for i in over:
            target[i] = most * sizes[i]
        total -= sum(target[i] for i in over)
        rest = [i for i in rest if i not in set(over)]
    return target


def min_cost_flow(
    patterns: Sequence[tuple[tuple[int, ...], int]], quotas: Sequence[int], levels: int = 2
) -> list[list[int]]:
    """Words to take from each pattern at each level (the first copies, the second ...).

    patterns: (sources, words). Level r costs 2r + 1 a word. Shortest augmenting paths with potentials.
    """
    n_p, n_s = len(patterns), len(quotas)
    shared = {s for members, _ in patterns if len(members) > 1 for s in members}
    if len(shared) < n_s:
        # Sources of their own: copies in turn until the quota is reached.
        at = {s: i for i, s in enumerate(sorted(shared))}
        inner = [p for p, (members, _) in enumerate(patterns) if members and members[0] in shared]
        flows = [[max(0, min(words, (quotas[m[0]] if m else 0) - r * words)) for r in range(levels)] for m, words in patterns]
        found = min_cost_flow([(tuple(at[s] for s in patterns[p][0]), patterns[p][1]) for p in inner], [quotas[s] for s in sorted(shared)], levels) if inner else []
        for p, flow in zip(inner, found, strict=True):
            flows[p] = flow
        return flows
    source, sink = 0, 1 + n_p + n_s
    graph: list[list[list]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> list:
        forth, back = [b, room, cost, None], [a, 0, -cost, None]
        forth[3], back[3] = back, forth
        graph[a].append(forth)
        graph[b].append(back)
        return forth

    level_arcs = []
    for p, (members, words) in enumerate(patterns):
        level_arcs.append([arc(source, 1 + p, words, 2 * r + 1) for r in range(levels)])
        for s in members:
            arc(1 + p, 1 + n_p + s, levels * words, 0)
    for s, quota in enumerate(quotas):
        arc(1 + n_p + s, sink, quota, 0)
    potential = [0] * (sink + 1)
    while True:
        far: list[float] = [float("inf")] * (sink + 1)
        came: list[list | None] = [None] * (sink + 1)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, at = heapq.heappop(heap)
            if d > far[at]:
                continue
            for e in graph[at]:
                if e[1] > 0 and (new := d + e[2] + potential[at] - potential[e[0]]) < far[e[0]]:
                    far[e[0]], came[e[0]] = new, e
                    heapq.heappush(heap, (new, e[0]))
        if came[sink] is None:
            return [[words - e[1] for e in arcs] for (_, words), arcs in zip(patterns, level_arcs, strict=True)]
        for v, d in enumerate(far):
            if d < float("inf"):
                potential[v] += d
        amount, at = None, sink
        while at != source:
            amount = came[at][1] if amount is None else min(amount, came[at][1])
            at = came[at][3][0]
        at = sink
        while at != source:
            came[at][1] -= amount
            came[at][3][1] += amount
            at = came[at][3][0]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE[1:-1]}]+")), F.lit(0)).cast("long")


def _pattern(sources: Column) -> Column:
    """The set of a document's sources in order; empty for none at all."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.struct(s.isNull().alias("none"), s.alias("s")))))


def drawn(facts: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5) -> tuple[DataFrame, bool]:
    """facts (pattern, draw, size) -> a row for each pattern: pattern, source, source_size, target, and `levels`, which says
    of each copy how far the draw goes; and whether it is small enough to broadcast.

    A level holds its goal, `stop` (the draw and size of the last rows that are taken; null if all or none are), `all`, and of
    the `times` rows that are alike at `stop` the number that is taken, `take`. `facts` is read several times and should be a checkpoint.
    """
    spark = facts.sparkSession
    sums = facts.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({(x["none"], x["s"] or "") for row in sums for x in row["pattern"]})
    place = {name: i for i, name in enumerate(names)}
    rows = sorted((tuple(sorted(place[x["none"], x["s"] or ""] for x in r["pattern"])), r["words"], r["pattern"]) for r in sums)
    sizes = [0] * len(names)
    for members, words, _ in rows:
        for m in members:
            sizes[m] += words
    target = targets_of(sizes, [weights[i % len(weights)] for i in range(len(names))], share)
    flow = min_cost_flow([(members, words) for members, words, _ in rows], [round(t) for t in target])
    plan = spark.createDataFrame(
        [
            ([(x["none"], x["s"]) for x in p], None if names[m[0]][0] else names[m[0]][1], int(sizes[m[0]]), float(target[m[0]]), level, int(f), int(words))
            for (m, words, p), flows in zip(rows, flow, strict=True)
            if m
            for level, f in enumerate(flows)
        ],
        "pattern array<struct<none:boolean,s:string>>, source string, source_size long, target double, level int, goal long, words long",
    )
    small = len(rows) <= MAX_BROADCAST
    hint = F.broadcast if small else lambda df: df
    # Narrow down the part of the hash range in which each level's draw ends: its upper bits, and what lies before it.
    open_levels = plan.filter("goal > 0 and goal < words").select("pattern", "level", "goal", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    now, bits = cut(open_levels), 0
    inside = facts.filter("size > 0")
    while bits + BIN_BITS <= 60:
        parts = now.select(F.col("pattern").alias("of"), "prefix").distinct()
        inner = inside if not bits else inside.join(hint(parts), (F.col("of") == F.col("pattern")) & (F.shiftrightunsigned("draw", 64 - bits) == F.col("prefix")))
        bits += BIN_BITS
        bins = inner.groupBy("pattern", F.shiftrightunsigned("draw", 64 - bits).alias("bin")).agg(F.sum("size").alias("in_bin"), F.count("*").alias("n"))
        upto = F.col("before") + F.sum("in_bin").over(W.partitionBy("pattern", "level").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        at_level = (F.shiftrightunsigned("bin", BIN_BITS) == F.col("prefix")) if bits > BIN_BITS else F.lit(True)
        ends = (
            bins.join(hint(now.select(F.col("pattern").alias("of"), "level", "goal", "prefix", "before")), F.col("of") == F.col("pattern"))
            .filter(at_level)
            .withColumn("upto", upto)
            .filter("upto > goal and upto - in_bin <= goal")
            .select("pattern", "level", "goal", F.col("bin").alias("prefix"), (F.col("upto") - F.col("in_bin")).alias("before"), "n")
        )
        now = cut(ends)
        if (now.agg(F.max("n")).first()[0] or 0) <= MOST_IN_BIN:
            break
    inner = inside.join(hint(now.withColumnRenamed("pattern", "of")), (F.col("of") == F.col("pattern")) & (F.shiftrightunsigned("draw", 64 - bits) == F.col("prefix")))
    alike = inner.groupBy("pattern", "level", "goal", "before", "draw", "size").agg(F.count("*").alias("times"))
    before = W.partitionBy("pattern", "level").orderBy("draw", "size").rowsBetween(W.unboundedPreceding, -1)
    had = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("times")).over(before), F.lit(0))
    # Of rows alike, take as many as come nearest the goal: the last one if at least half of it is still wanted.
    take = F.least("times", F.floor((2 * (F.col("goal") - F.col("had")) + F.col("size")) / (2 * F.col("size"))))
    order = F.struct("draw", "size", "times", "take")
    stops = alike.withColumn("had", had).filter("had <= goal").withColumn("take", take.cast("long")).filter("take > 0").groupBy("pattern", "level").agg(F.max(order).alias("last"))
    # Without a row to take in its part of the range, a draw ends before that part.
    low = F.shiftleft("prefix", 64 - bits)
    bounds = now.join(stops, ["pattern", "level"], "left").select("pattern", "level", F.coalesce(F.col("last.draw"), low).alias("draw"), F.coalesce(F.col("last.size"), F.lit(0)).alias("upto_size"), F.coalesce(F.col("last.times"), F.lit(0)).alias("times"), F.coalesce(F.col("last.take"), F.lit(0)).alias("take"))
    levels = (
        plan.join(bounds, ["pattern", "level"], "left")
        .withColumn("all", (F.col("goal") > 0) & (F.col("goal") >= F.col("words")))
        .groupBy("pattern", "source", "source_size", "target")
        .agg(F.sort_array(F.collect_list(F.struct("level", "goal", "all", "draw", "upto_size", "times", "take"))).alias("levels"))
    )
    return cut(levels), small


def _unsigned(x: Column) -> Column:
    """A column that orders hashes as unsigned numbers, as their upper bits do."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def _taken(x: Column) -> Column:
    """Whether a level takes the row at hand whichever of its like it is."""
    mine, last = F.struct(_unsigned(F.col("draw")), F.col("size")), F.struct(_unsigned(x["draw"]), x["upto_size"])
    whole = (mine < last) | ((mine == last) & (x["take"] >= x["times"]))
    return x["all"] | (x["draw"].isNotNull() & F.coalesce(whole, F.lit(False)))


def _split(x: Column) -> Column:
    """Whether a level takes some of the rows alike to the one at hand, and not all."""
    return F.coalesce((F.col("draw") == x["draw"]) & (F.col("size") == x["upto_size"]) & (x["take"] < x["times"]) & (x["take"] > 0), F.lit(False))


def copied(rows: DataFrame, plan: DataFrame, small: bool, alike: Sequence[str]) -> DataFrame:
    """rows with pattern, draw and size -> with source, source_size, target, and `copies`, how often each is taken. No shuffle but of
    the rows at which a draw ends among others alike: these, equal in the columns `alike` (and taken for equal in all), are counted."""
    with_plan = rows.join(F.broadcast(plan) if small else plan, "pattern", "left")
    whole = F.when(F.col("levels").isNull(), 0).otherwise(F.size(F.filter("levels", _taken)))
    marked = with_plan.withColumn("_split", (F.col("size") > 0) & F.coalesce(F.exists("levels", _split), F.lit(False)))
    plain = marked.filter("not _split").withColumn("copies", F.when(F.col("size") > 0, whole).otherwise(0))
    others = [c for c in marked.columns if c not in alike]
    counted = marked.filter("_split").groupBy(*alike).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
    # The i-th of them is taken as often as there are levels that take more than i.
    some = F.size(F.filter("levels", lambda x: _taken(x) | (_split(x) & (x["take"] > F.col("_i")))))
    numbered = counted.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).withColumn("copies", some)
    keep = [*rows.columns, "source", "source_size", "target", "copies"]
    return plain.select(keep).unionByName(numbered.select(keep))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, seed: int = SEED) -> DataFrame:
    """docs (doc_id, sources array<string>, size long) -> doc_id, source, size, copies, taken, source_size, target.

    `docs` is read several times and should be a checkpoint. `source` is the first of a document's sources
    in code-point order, null last; source_size and target are that source's. A document's size counts
    whole towards each of its sources' sizes.
    """
    known = docs.select("doc_id", "size", _pattern(F.col("sources")).alias("pattern"), F.xxhash64("doc_id", "size", F.lit(seed)).alias("draw"))
    plan, small = drawn(known, weights, share)
    found = copied(known, plan, small, ["doc_id", "size", "pattern", "draw"])
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def measured(docs: DataFrame) -> DataFrame:
    """Ids, sources and sizes of documents, checkpointed: texts are read once."""
    return cut(docs.select("doc_id", F.array("source").alias("sources"), word_count(F.col("text")).alias("size")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: 150 % of their words, sources weighing 3, 1, 2 and again."""
    docs = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken (not at all, once or twice).

    The draw is a function of the row, so texts are marked where they are. Columns that can't be hashed (maps) are left out
    of it; rows alike in all others count as repeated."""
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    row = docs.select(F.struct("*").alias("_row"), F.array("source").alias("_sources"), word_count(F.col("text")).alias("size"), F.xxhash64(*hashed, F.lit(SEED)).alias("draw"))
    facts = cut(row.select(_pattern(F.col("_sources")).alias("pattern"), "draw", "size"))
    plan, small = drawn(facts)
    marked = copied(row.select("_row", "draw", "size", _pattern(F.col("_sources")).alias("pattern")), plan, small, ["draw", "size", "pattern"])
    return marked.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
