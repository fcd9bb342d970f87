"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Each document becomes token ids and a closing id. Ids beyond the last full sequence of a document are its
tail; full sequences stand alone, tails are packed. Documents are dealt into groups by a seeded hash of
their id and checksums; a group's tails are placed by falling length, each into the first sequence with enough room.
The tree holds, above the capacities of the sequences, the larger of each pair, so the first fit is found
from the root in log n steps. A group has about `group_docs` documents whatever the corpus: what
a task holds is one group's lengths and checksums, never its texts.

Cases: a null or empty text is the closing id alone. Very long texts give many full sequences. Repeated
rows are packed each; those that would fill a group by themselves are dealt out by their place. The order in which rows arrive doesn't matter: ties go by
doc_id and checksum. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

LENGTH = 1024
GROUP_DOCS = 4096
SEED = 11
VOCABULARY = "byte_bpe_50k"
#: Word ids are remembered for this many words of at most MAX_WORD bytes in each Python worker.
CACHE_WORDS, MAX_WORD = 600_000, 64


class Tournament:
    """Capacities of bins in a row, and the first with enough room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes `size` from the first bin that has it; there must be one."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        found = at - self.leaves
        best[at] -= size
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return found

    def room(self, found: int) -> int:
        return self.best[self.leaves + found]


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each size; sizes must fall."""
    tree, out = Tournament(len(sizes), capacity), []
    for size in sizes:
        found = tree.place(size)
        out.append((found, capacity - tree.room(found) - size))
    return out


class Encoder:
    """Token ids of texts as little-endian bytes, four for each id: those of `tokenizers` with the JSON file.

    Words are encoded from the same vocabulary's ranks, which is faster, and remembered: a space that
    stands before a non-space always begins a token, so a text may be cut there. Texts with white space
    that could straddle such a cut are encoded whole; those with the text of a special token by
    `tokenizers`, which reads it as that token.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def reference(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        ids = array("I", self.encode(word))
        if sys.byteorder == "big":
            ids.byteswap()
        made = ids.tobytes()
        if len(word) <= MAX_WORD:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = made
        return made

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.reference(text)
        parts = text.split(" ")
        if "" in parts or any(p[-1].isspace() for p in parts):
            return self.whole(text)
        words = [parts[0], *[" " + p for p in parts[1:]]]
        get = self.known.get
        return b"".join([get(w) or self._learn(w) for w in words])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) -> doc_id, doc_tokens, checksums of its pieces of `length` ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path(vocabulary + ".json"), tokenizer_path(vocabulary + ".tiktoken"))
        for batch in batches:
            totals, sums = [], []
            for text in batch.column(1):
                ids = encoder.ids(text.as_py() or "") + b"\0\0\0\0"
                totals.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[i : i + 4 * length]) for i in range(0, len(ids), 4 * length)])
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(totals, pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
                names=["doc_id", "doc_tokens", "sums"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, doc_tokens long, sums array<long>")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece of each document."""
    found = cut(encoded(docs, vocabulary, length).withColumn("row_key", F.xxhash64("doc_id", "doc_tokens", "sums", F.lit(seed))))
    groups = max(1, -(-found.count() // group_docs))
    names = [f.strip().split(" ")[0] for f in PIECES.split(",")]

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        base = key[0].as_py() << 32
        docs = sorted(zip(*(table[c].to_pylist() for c in ("doc_id", "doc_tokens", "sums")), strict=True), key=lambda d: (d[0] is None, d[0] or 0, d[1], d[2]))
        out, tails, sequence = [], [], 0
        for doc, total, sums in docs:
            for k, crc in enumerate(sums):
                size = min(length, total - k * length)
                if size == length:
                    out.append((doc, k * length, length, crc, total, base + sequence, 0))
                    sequence += 1
                else:
                    tails.append((doc, k * length, size, crc, total))
        tails.sort(key=lambda t: -t[2])
        for t, (found, offset) in zip(tails, first_fit_decreasing([t[2] for t in tails], length), strict=True):
            out.append((*t, base + sequence + found, offset))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    # Rows that are alike in all and fill a group by themselves are dealt over all groups by their place.
    many = found.groupBy("row_key").agg(F.count("*").alias("times")).filter(F.col("times") > group_docs).select("row_key", F.lit(True).alias("spread"))
    place = F.when(F.col("spread"), F.xxhash64("row_key", "place")).otherwise(F.col("row_key"))
    dealt = found.withColumn("place", F.monotonically_increasing_id()).join(many, "row_key", "left")
    return dealt.select("doc_id", "doc_tokens", "sums", F.pmod(place, F.lit(groups)).alias("pack_group")).groupBy("pack_group").applyInArrow(pack, PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 ids."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that came this far."""
    return packed(docs)
