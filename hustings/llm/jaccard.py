"""N-gram Jaccard join with count vectors: exact links between texts, and the classes they make.

A document is the set of its shingle hashes. Equal sets are one node. Two nodes link when
100 * |A & B| >= percent * |A | B|.

1. Cells. Sizes fall into bands; in a band, all shingles are hashed into G groups. Linked sets whose sizes sum to n differ in
   D = n * (100 - percent) / (100 + percent) shingles at most, and each spoils one group, so of G groups G - D are alike in
   their whole content. Groups are put in an order that depends on their content alone, the fullest first; of
   two sets that have G - D groups alike, the first D + 1 of each have one in common (the prefix principle). So a set shows
   its first D + 1 groups, and nodes that show the same (band, group, content) are a cell. Common shingles do little harm:
   a cell needs a whole group alike, of three shingles or more in sets of ordinary size.
2. Count-vector R-tree, first round. Each node's counts by group (FINER point groups to a group) are its point. Each node goes
   to the cell in which it meets most others. There the points are packed into an R-tree by size; for a point and a box, the sum over
   coordinates of the lesser of the point's count and the box's upper corner is no less than any overlap below it, and
   subtrees that can't reach the needed overlap are cut. Of the nodes that stand before it in the order of those they meet, and that the
   tree finds for it, each node gets two partners: the first, and the one with the largest bound. These pairs are verified on whole
   sets; what links is one component, whose nodes need not be compared again.
3. Second round. Cells that still hold several components are joined by the tree: all pairs of different
   components that the bound can't rule out are verified. Cells that share nodes are joined as one, if that takes MOST_BLOCKS at most.
4. Components of the verified links, by large-star and small-star rounds.

Every link comes from the tree, and none is lost: both bounds are proven. A cell is never gathered whole: it is joined in blocks
of BLOCK_BYTES of points; in the first round each block has the cell's first node, so a large group of near copies costs a star.
Signatures that many nodes show are split by node over tasks (HOT). Copies cost nothing after step 0.

Cases: null and empty texts have no shingles and no links. Texts with fewer words than a shingle are one
shingle, the whole sequence. Repeated rows, and rows with one id, are documents each, of one node if alike; a null id
is carried through, and rows are told apart by the hash of id and text. Other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, key_filter, may_have, sized
from .components import components
from .shingles import GOLDEN, as_long, mix, shingle_sets

#: Points that a block holds, in bytes, and boxes or points in a box.
BLOCK_BYTES, FANOUT = 1 << 21, 16
MOST_BLOCKS = 8
#: Point groups in a group: the finer, the less two texts' different shingles fall together, which the bound counts as overlap.
FINER = 4
#: Signatures fall into BUCKETS; one with HOT rows more than four times the mean is split by node.
BUCKETS, HOT = 1 << 16, 5000
#: Group counts above this are one in the order of groups.
FULL = 15


class Bands:
    """Bands of set sizes, and for each the number of groups."""

    def __init__(self, percent: int, widen: int = 2, spare: float = 0.35, largest: int = 1 << 30):
        self.percent = percent
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, 100 * (lows[-1] - 1) // percent + 1, lows[-1] * widen))
        self.lows = np.array(lows)
        # The larger of two linked sets of a band's class is found from its smaller one; spare groups keep small ones out.
        most = (self.lows[1:] - 1) * (100 - percent) // percent
        self.groups = np.where(most > 0, most + 1 + np.ceil(spare * (most + 1)).astype(np.int64) + 6, 0)

    def own(self, n: np.ndarray) -> np.ndarray:
        """The band of a size."""
        return np.searchsorted(self.lows, n, side="right") - 1

    def below(self, n: np.ndarray) -> np.ndarray:
        """The band under that of a size, if a set of it can link with one of this size; else -1."""
        b = self.own(n)
        return np.where((b > 0) & (n * self.percent <= 100 * (self.lows[b] - 1)), b - 1, -1)

    def spoilt(self, n: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The most shingles by which a set of size n can differ from one that it links with in the class of band c."""
        in_own = n * (100 - self.percent) // self.percent
        return np.where(self.own(n) == c, in_own, (n + self.lows[c + 1] - 1) * (100 - self.percent) // (100 + self.percent))

    def needed(self, a, b):
        """The least overlap of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def signatures(values: np.ndarray, at: np.ndarray, c: np.ndarray, bands: Bands) -> tuple[list, list]:
    """For sets values[at[i]:at[i + 1]] in the classes c: their signatures, and their points (half a byte for each point group, or one or
    two where a count needs them). A class of -1, or one in which linked sets are equal, gives neither.

    A signature is a group's fullness, hash, and class in the last five bits.
    """
    sigs: list = [None] * len(c)
    points: list = [None] * len(c)
    n = np.diff(at)
    spoilt = np.where(c >= 0, bands.spoilt(n, c), 0)
    has = np.flatnonzero((c >= 0) & (n > 0) & (spoilt > 0))
    if not len(has):
        return sigs, points
    picked = np.repeat(has, n[has])
    inner = np.arange(len(picked)) - np.repeat(np.cumsum(n[has]) - n[has], n[has])
    shingles = values[at[:-1][picked] + inner]
    kind, groups = c[has], bands.groups[c[has]]
    own = np.repeat(np.arange(len(has)), n[has])
    base = np.r_[0, np.cumsum(groups)]
    scattered = mix(shingles + (kind.astype(np.uint64) + np.uint64(1))[own] * np.uint64(GOLDEN)) >> np.uint64(32)
    cell = FINER * base[own] + ((scattered.astype(np.int64) * (FINER * groups)[own]) >> 32)
    fine = np.bincount(cell, minlength=FINER * base[-1])
    counts = fine.reshape(-1, FINER).sum(axis=1)
    body = mix(shingles ^ np.uint64(0xA5A5A5A5))
    group = cell // FINER
    low = np.bincount(group, (body & np.uint64(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(np.uint64)
    high = np.bincount(group, (body >> np.uint64(32)).astype(np.float64), base[-1]).astype(np.uint64)
    place = np.arange(base[-1]) - np.repeat(base[:-1], groups)
    kinds = np.repeat(kind, groups).astype(np.uint64)
    content = mix(mix(low) + high * np.uint64(GOLDEN) + counts.astype(np.uint64))
    content = mix(content + mix(place.astype(np.uint64) + ((kinds + np.uint64(1)) << np.uint64(40))))
    order = (FULL - np.minimum(counts, FULL)).astype(np.uint64) << np.uint64(60) | (content >> np.uint64(9)) << np.uint64(5) | kinds
    halves = (fine[0::2] | fine[1::2] << 4).astype(np.uint8)
    for i, t in enumerate(has.tolist()):
        a, b = base[i], base[i + 1]
        mine = order[a:b]
        mine.sort()
        sigs[t] = as_long(mine[: spoilt[t] + 1])
        point = fine[FINER * a : FINER * b]
        most = point.max()
        points[t] = (halves[FINER * a // 2 : FINER * b // 2] if most < 16 else point.astype(np.uint8 if most < 256 else np.uint16)).tobytes()
    return sigs, points


def node_keys(values: np.ndarray, at: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set a key, and a second hash that tells sets with one key apart; 0 without shingles."""
    n, some = np.diff(at), np.flatnonzero(np.diff(at) > 0)
    key, check = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(some):
        key[some] = mix(np.add.reduceat(mix(values + np.uint64(seed)), at[:-1][some]) + n[some].astype(np.uint64))
        check[some] = np.add.reduceat(mix(values ^ np.uint64(0x5555555555555555)), at[:-1][some])
    return as_long(key), as_long(check)


class CountTree:
    """An R-tree of count vectors, packed by size; each box is its upper corner and its least size."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        tops, least = points[self.order], sizes[self.order]
        self.levels = [(tops, least)]
        while len(tops) > FANOUT:
            starts = np.arange(0, len(tops), FANOUT)
            tops, least = np.maximum.reduceat(tops, starts, axis=0), np.minimum.reduceat(least, starts)
            self.levels.append((tops, least))

    def search(self, size: int, point: np.ndarray, bands: Bands) -> np.ndarray:
        """Points whose overlap with this one may be as large as a link needs."""
        return self.bounded(size, point, bands)[0]

    def bounded(self, size: int, point: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
        """Points that search() finds, and by how much the bound of each is over what a link needs."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, least = self.levels[depth]
            over = np.minimum(tops[at], point).sum(axis=1, dtype=np.int64) - bands.needed(size, least[at])
            at, over = at[over >= 0], over[over >= 0]
            if depth:
                below = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = below[below < len(self.levels[depth - 1][0])]
        return self.order[at], over


def _points(data: list[bytes], groups: int) -> np.ndarray:
    """Points of FINER * groups counts as rows of one matrix."""
    n = FINER * groups
    if all(2 * len(d) == n for d in data):
        halves = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), n // 2)
        return np.stack([halves & 15, halves >> 4], axis=2).reshape(len(data), n)
    return np.stack([_points([d], groups)[0].astype(np.uint16) if 2 * len(d) == n else np.frombuffer(d, np.uint8 if len(d) == n else np.uint16).astype(np.uint16) for d in data])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that agree in the first `keys` columns, as lists; the rows must be sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _pairs(found: Iterator[tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []
    for x, y in found:
        a += x
        b += y
        if len(a) >= 10_000:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def scanned(docs: DataFrame, k: int, bands: Bands, seed: int) -> DataFrame:
    """A row for each of docs' rows; signatures and points where a task meets a node first. One pass over the texts."""
    names = ["doc_id", "row_hash", "n_shingles", "node", "check", "own", "low", "sigs", "point", "low_point"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, marks = batch.column(0).cast(pa.int64()), batch.column(2)
            for i, j, values, at in shingle_sets(batch.column(1), k):
                n = np.diff(at)
                nodes, checks = node_keys(values, at, seed)
                fresh = np.zeros(len(n), bool)
                for t, node in enumerate(nodes.tolist()):
                    if n[t] and node not in seen:
                        fresh[t] = True
                        if len(seen) < 200_000:
                            seen.add(node)
                own, low = np.where(fresh, bands.own(n), -1), np.where(fresh, bands.below(n), -1)
                sigs, points = signatures(values, at, own, bands)
                more, low_points = signatures(values, at, low, bands)
                both = [x if y is None else y if x is None else np.concatenate([x, y]) for x, y in zip(sigs, more, strict=True)]
                length = [0 if x is None else len(x) for x in both]
                every = [x for x in both if x is not None]
                flat = np.concatenate(every) if every else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(flat, pa.int64()))
                columns = [ids[i:j], marks[i:j], *(pa.array(x, pa.int64()) for x in (n, nodes, checks)), *(pa.array(x, pa.int32()) for x in (own, low))]
                yield pa.record_batch([*columns, lists, pa.array(points, pa.binary()), pa.array(low_points, pa.binary())], names=names)

    schema = "doc_id long, row_hash long, n_shingles long, node long, check long, own int, low int, sigs array<long>, point binary, low_point binary"
    return docs.select("doc_id", "text", _row_hash().alias("row_hash")).mapInArrow(scan, schema)


def celled(shown: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """shown (sig, node) -> (cell, class, node, times): the nodes that meet in signatures, signatures with the same nodes as one.

    A signature's nodes are seen by one task, in order, and spill; signatures with very many are summed on the map side
    and joined back, which splits them.
    """
    bucket = F.pmod(F.xxhash64("sig"), F.lit(buckets))
    counts = cut(shown.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")))
    mean = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r["bucket"] for r in counts.filter(F.col("n") > HOT + 4 * mean / buckets).select("bucket").collect()]
    marks = (F.min("node"), F.max("node"), F.bit_xor(F.xxhash64("node")))
    names = ("lo", "hi", "all")
    kind = F.col("sig").bitwiseAND(F.lit(31)).cast("int").alias("class")
    cell = F.xxhash64("all", "lo", "hi", kind).alias("cell")
    rest = shown.filter(~bucket.isin(hot)) if hot else shown
    met = rest.select("sig", "node", *[m.over(W.partitionBy("sig")).alias(n) for m, n in zip(marks, names, strict=True)])
    met = met.filter("lo < hi").select(cell, kind, "node")
    if hot:
        large = shown.filter(bucket.isin(hot))
        sums = large.groupBy("sig").agg(*[m.alias(n) for m, n in zip(marks, names, strict=True)]).filter("lo < hi")
        met = met.unionByName(large.join(sums, "sig").select(cell, kind, "node"))
    return met.groupBy("cell", "class", "node").agg(F.count("*").alias("times"))


def _dealt(members: str, bands: Bands) -> Column:
    """How many blocks a cell of so many nodes has."""
    room = [max(2, BLOCK_BYTES // max(1, FINER * int(g))) for g in bands.groups]
    return F.ceil(F.col(members) / F.element_at(F.array(*[F.lit(r) for r in room]), F.col("class") + 1)).cast("int")


def join(docs: DataFrame, k: int = 4, percent: int = 85, seed: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, class_key, row_hash: a row for each row of docs.

    class_key tells classes apart even where ids are null; it is null without shingles. row_hash is that of
    doc_id and text.
    """
    bands, tasks = Bands(percent), sized(docs)
    facts = cut(scanned(docs, k, bands, seed))
    known = facts.filter("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min("row_hash").alias("row_hash"), (F.min("check") != F.max("check")).alias("clash"), F.max("n_shingles").alias("size")
    )
    known = cut(known)
    if not known.filter("clash").isEmpty():
        return join(docs, k, percent, seed + 1)
    cells = cut(celled(facts.filter("size(sigs) > 0").select(F.explode("sigs").alias("sig"), "node")), release=True)
    drawn = facts.filter("point is not null or low_point is not null").select("node", "own", "point", "low_point", F.col("n_shingles").alias("size"))
    point = F.when(F.col("class") == F.col("own"), F.col("point")).otherwise(F.col("low_point")).alias("point")

    # First round: each node in the cell in which it meets most others, beside the cell's first node.
    members = cells.groupBy("cell").agg(F.count("*").alias("members"))
    at_home = cells.join(members, "cell").groupBy("node").agg(
        F.sum(F.col("times") * (F.col("members") - 1)).alias("met"), F.max(F.struct("members", "cell", "class")).alias("home")
    ).select("node", "met", "home.cell", "home.class")
    at_home = cut(at_home)
    firsts = at_home.groupBy("cell").agg(F.count("*").alias("chosen"), F.max(F.struct("met", "node")).alias("first")).filter("chosen > 1")
    blocks = F.col("blocks")
    own_block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    homes = (
        at_home.join(firsts, "cell")
        .withColumn("blocks", _dealt("chosen", bands))
        .withColumn("block", F.explode(F.when(F.col("node") == F.col("first.node"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own_block))))
        .join(drawn, "node")
        .select("cell", "block", "class", "met", "node", "size", point)
    )

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[list[int], list[int]]]:
            for run in _runs(batches, 2):
                rows = list({r[4]: r for r in run}.values())
                if len(rows) < 2:
                    continue
                nodes, sizes = [r[4] for r in rows], np.array([r[5] for r in rows])
                points = _points([r[6] for r in rows], int(bands.groups[rows[0][2]]))
                tree = CountTree(sizes, points)
                a, b = [], []
                for i in range(1, len(rows)):
                    near, over = tree.bounded(int(sizes[i]), points[i], bands)
                    over, near = over[near < i], near[near < i]
                    if len(near):
                        for x in {int(near.min()), int(near[np.lexsort((near, -over))[0]])}:
                            a.append(nodes[i])
                            b.append(nodes[x])
                yield a, b

        yield from _pairs(found())

    stars = (
        homes.repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block", F.desc("met"), "node").mapInArrow(led, "a long, b long").distinct()
    )
    linked = cut(_verified(cut(stars, release=True), docs, known, k, percent, seed, tasks), release=True)
    label = cut(components(linked).select("node", F.col("component").alias("label")))

    # Second round: pairs of different components in one cell that the tree can't rule out.
    labelled = cells.join(label, "node", "left").select("cell", "class", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("least"), F.count("*").alias("members")).filter("lo <> hi")
    still = cut(labelled.join(mixed.select("cell", "least", "members"), "cell"))
    # Cells that share nodes are joined as one, so that a pair is met once and a node is sent once, if this takes few blocks.
    links = cut(still.select("node", "least", "class", "label").distinct())
    crowd = components(links.select(F.col("node").alias("a"), F.col("least").alias("b"))).select("node", F.col("component").alias("crowd"))
    crowded = cut(links.join(crowd, "node").select("crowd", "class", "node", "label").distinct())
    sizes = crowded.groupBy("crowd", "class").agg(F.count("*").alias("members")).withColumn("many", _dealt("members", bands) > MOST_BLOCKS)
    dealt = crowded.join(sizes.filter("not many"), ["crowd", "class"]).select(F.col("crowd").alias("cell"), "class", "node", "label", "members")
    if not sizes.filter("many").isEmpty():
        in_many = crowded.join(sizes.filter("many"), ["crowd", "class"]).select("node", "class")
        dealt = dealt.unionByName(still.join(in_many, ["node", "class"]).select("cell", "class", "node", "label", "members"))
    dealt = (
        dealt.withColumn("blocks", _dealt("members", bands))
        .withColumn("own_block", own_block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .join(drawn, "node")
        .select("cell", "class", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"), "own_block", "label", "node", "size", point)
    )

    def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[list[int], list[int]]]:
            for run in _runs(batches, 4):
                _, kind, i, j = run[0][:4]
                rows = list({r[6]: r for r in run}.values())
                groups = int(bands.groups[kind])
                left = [r for r in rows if r[4] == i]
                right = left if i == j else [r for r in rows if r[4] == j]
                if not left or not right:
                    continue
                tops = _points([r[8] for r in left], groups)
                points = tops if i == j else _points([r[8] for r in right], groups)
                tree = CountTree(np.array([r[7] for r in left]), tops)
                a, b = [], []
                for row, its in zip(right, points, strict=True):
                    for x in tree.search(row[7], its, bands):
                        other = left[x]
                        if other[5] != row[5] and (i != j or other[6] < row[6]):
                            a.append(min(other[6], row[6]))
                            b.append(max(other[6], row[6]))
                yield a, b

        yield from _pairs(found())

    keys = ["cell", "class", "i", "j"]
    pairs = cut(dealt.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(surviving, "a long, b long").distinct(), release=True)
    more = cut(_verified(pairs, docs, known, k, percent, seed, tasks), release=True)
    between = (
        more.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        .join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    higher = components(between).select(F.col("node").alias("label"), F.col("component").alias("top"))
    classes = (
        known.join(label, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .join(higher, "label", "left")
        .select("node", "first_id", F.coalesce("top", "label").alias("top"))
    )
    least = classes.groupBy("top").agg(F.min("first_id").alias("component_id"))
    by_node = classes.join(least, "top").select("node", "component_id", F.col("top").alias("class_key"))
    rows = facts.select("doc_id", "n_shingles", "node", "row_hash")
    in_class = rows.filter("n_shingles > 0").join(by_node, "node", "left").select("doc_id", "n_shingles", "component_id", "class_key", "row_hash")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_key"), "row_hash")
    return in_class.unionByName(alone)


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, k: int, percent: int, seed: int, tasks: int, per_task: int = 256) -> DataFrame:
    """pairs (a, b) of nodes -> those that link. Each b's set is held while the sets of its a's pass by; a b
    with many a's is dealt over several tasks, each of which gets its set. Sets are made anew from the texts of these nodes:
    texts aren't shuffled, and a bitmap of bounded size keeps out those of other rows."""
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts"))
    others = pairs.join(degree, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.lit(1).alias("turn"))
    held = degree.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("turn"))
    asked = cut(held.unionByName(others).join(known.select("node", "row_hash"), "node"))
    wanted = key_filter(asked.select("row_hash").distinct(), "row_hash")
    hits = may_have(docs.select("doc_id", "text"), _row_hash(), wanted)

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Repeated rows are bounded by tasks; a set that comes twice gives the same links.
            marks = batch.column(0).to_numpy()
            fresh = np.zeros(len(marks), bool)
            fresh[np.unique(marks, return_index=True)[1]] = True
            kept = batch.filter(pa.array(fresh, pa.bool_()))
            for i, j, values, at in shingle_sets(kept.column(1), k):
                raw = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                nodes = pa.array(node_keys(values, at, seed)[0], pa.int64())
                yield pa.record_batch([kept.column(0)[i:j], nodes, pa.array(raw, pa.binary())], names=["row_hash", "node", "shingles"])

    sets = hits.filter("_hit").select("_key", F.col("_row.text").alias("text")).mapInArrow(as_sets, "row_hash long, node long, shingles binary")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, turn, y, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                theirs = np.frombuffer(data.as_buffer(), np.uint64)
                if turn == 0:
                    owner, mine = x, theirs
                    continue
                if x != owner:
                    raise ValueError("a set is missing")
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                overlap = int(np.count_nonzero(mine[at] == theirs))
                if 100 * overlap >= percent * (len(mine) + len(theirs) - overlap):
                    a.append(y)
                    b.append(x)
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    both = asked.join(sets, ["row_hash", "node"]).select("b", "salt", "turn", F.col("node").alias("a"), "shingles")
    return both.repartition(tasks, "b", "salt").sortWithinPartitions("b", "salt", "turn").mapInArrow(compared, "a long, b long")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at four words and 85 %."""
    found = join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays (five words, 80 %): that with the least id, null last, then the least
    hash; a repeated row stays once. Documents without words are in no class and stay.

    Only rows that go, or stand there repeatedly, are looked up by key; a bitmap lets the others pass where they are."""
    found = join(docs, k=5, percent=80).filter("class_key is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    rows = found.groupBy("class_key", "row_hash").agg(F.min(order).alias("own"), F.count("*").alias("times"))
    best = rows.groupBy("class_key").agg(F.min("own").alias("best"))
    marks = cut(
        rows.join(best, "class_key")
        .select(F.col("row_hash").alias("_key"), (F.col("own") == F.col("best")).alias("_stays"), "times")
        .filter("not _stays or times > 1")
        .select("_key", "_stays")
    )
    seen = may_have(docs, _row_hash(), key_filter(marks, "_key"))
    looked_up = seen.filter("_hit").join(marks, "_key", "left")
    clear = seen.filter("not _hit").select("_row").unionByName(looked_up.filter("_stays is null").select("_row"))
    once = looked_up.filter("_stays").dropDuplicates(["_key"]).select("_row")
    return clear.unionByName(once).select("_row.*")
