import random
import zlib

import numpy as np
from hustings.llm import packing as P

from tests.conftest import SMALL


def encoder():
    return P.Encoder(P.tokenizer_path("byte_bpe_50k.json"), P.tokenizer_path("byte_bpe_50k.tiktoken"))


def test_ids_are_those_of_tokenizers():
    rng, e = random.Random(3), encoder()
    bits = [" ", "\n", "a", "B", "1", "!", "'s", "é", "  ", "\t", "\u3000", "<|endoftext|>", "x y", ".", "\r\n", "\x0b", "\xa0", "word", "日本", "\U0001f600"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert e.ids(text) == e.reference(text), text


def test_first_fit_decreasing():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 1023) for _ in range(500)), reverse=True)
    rooms, want = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(rooms) if r >= s), None)
        if at is None:
            rooms.append(1024)
            at = len(rooms) - 1
        want.append((at, 1024 - rooms[at]))
        rooms[at] -= s
    assert P.first_fit_decreasing(sizes, 1024) == want


def check(rows, texts):
    e = encoder()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, text in texts.items():
        ids, at = e.reference(text or "") + b"\0\0\0\0", 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return sum(r["length"] for r in rows) / 1024 / len(by_sequence)


def test_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check(P.op7_packing(spark, SMALL).collect(), texts) > 0.98


def test_odd_rows(spark, odd_docs):
    unique = odd_docs.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    check(P.packed(unique, group_docs=3).collect(), {r["doc_id"]: r["text"] for r in unique.collect()})
    total = P.packed(odd_docs).groupBy().sum("length").first()[0]
    e = encoder()
    assert total == sum(len(e.reference(r["text"] or "")) // 4 + 1 for r in odd_docs.collect())
    assert P.packed(odd_docs.limit(0)).count() == 0
    assert np.dtype("<u4").itemsize == 4


def test_rows_alike_fill_no_group(spark):
    """Rows without an id and with one text are dealt over the groups; each is packed."""
    docs = spark.createDataFrame([(None, "the same text of some words")] * 90 + [(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    rows = P.packed(docs, length=16, group_docs=10).collect()
    alike = [r for r in rows if r["doc_id"] is None]
    assert sum(r["length"] for r in alike) == 90 * alike[0]["doc_tokens"] and len({r["sequence_id"] >> 32 for r in alike}) > 5
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 16
