import hashlib
import random
import zlib

import numpy as np
import pytest
from hustings.llm import tiff as T

from tests.conftest import SMALL


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16), (48, 32)])
@pytest.mark.parametrize("order", "<>")
def test_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4 if k % 2 else 256, shape, dtype=np.uint8) for k, shape in enumerate([(1, 1, 1), (70, 64, 1), (33, 50, 3), (300, 64, 1)])]
    rows = list(T.read(T.write(pages, compression, predictor, tile=tile, order=order, rows_per_strip=20)))
    assert [r[6] for r in rows] == [p.tobytes() for p in pages] and rows[-1][-1] is None


def test_codecs():
    rng = random.Random(1)
    for n in (0, 1, 2, 127, 128, 129, 5000, 40000):
        for letters in (b"a", b"ab", bytes(range(256))):
            data = bytes(rng.choices(letters, k=n))
            assert T.lzw_decode(T.lzw_encode(data), n) == data and T.unpack_bits(T.pack_bits(data), n) == data


def plain_lzw(data):
    """The codes of the format, bit by bit."""
    bits = "".join(f"{b:08b}" for b in data)
    table, width, at, out, last = None, 9, 0, b"", b""
    while True:
        code = int(bits[at : at + width], 2)
        at += width
        if code == 257:
            return out
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out, last = out + entry, entry
        width = min(12, max(9, (len(table) + 1).bit_length()))


def test_lzw_against_the_plain_decoder():
    rng = random.Random(6)
    for n in (0, 1, 3, 300, 9000, 60000):
        for letters in (b"a", b"abc ", bytes(range(256))):
            data = bytes(rng.choices(letters, k=n))
            assert plain_lzw(T.lzw_encode(data)) == data


def test_every_codec_sees_long_and_short_texts():
    """The codec is dealt by checksum, whatever the size."""
    rng = random.Random(7)
    for size in (64, 640, 200_000):
        kinds = {next(T.read(T.store(bytes(rng.choices(b"abc de", k=size - size % 64)))))[4] for _ in range(12 if size > 1000 else 40)}
        assert kinds == {T.DEFLATE, T.PACKBITS, T.LZW}


def test_faults():
    good = T.write([np.zeros((8, 8), np.uint8)])
    assert list(T.read(b""))[0][-1] and list(T.read(b"II*\0"))[0][-1] and list(T.read(b"not a picture"))[0][-1]
    for cut in range(8, len(good)):
        list(T.read(good[:cut]))
    ring = bytearray(good)
    ring[-4:] = ring[4:8]
    assert list(T.read(bytes(ring)))[-1][-1] == "directories form a ring"
    assert list(T.read(good, max_page_bytes=10))[0][-1]


def test_pages_and_features(spark, odd_docs):
    files = spark.createDataFrame([(1, bytearray(T.write([np.zeros((2, 3), np.uint8)] * 3))), (2, None), (3, bytearray(b"x"))], "doc_id long, media binary")
    assert sorted((r["doc_id"], r["page"], r["error"] is None) for r in T.pages(files).collect()) == [(1, 0, True), (1, 1, True), (1, 2, True), (3, 0, False)]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for source, rows in ((texts, T.op10_tiff(spark, SMALL).collect()), ({r["doc_id"]: r["text"] for r in odd_docs.collect()}, T.round_trip(odd_docs).collect())):
        for r in rows:
            raw = (source[r["doc_id"]] or "").encode()
            padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
            assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])


def test_empty_tables(spark, odd_docs):
    assert T.round_trip(odd_docs.limit(0)).count() == 0 and T.pages(spark.createDataFrame([], "doc_id long, media binary")).count() == 0
