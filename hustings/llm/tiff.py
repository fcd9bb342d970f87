"""Media columns: TIFF files in a binary column, read page by page.

The reader follows the chain of image directories, in either byte order, decodes strips and tiles
(none, PackBits, LZW or deflate), undoes the horizontal predictor and yields one row for each page. The
writer makes such files, so that any payload of bytes can be stored as 8-bit samples without loss.

Cases: null bytes give no row. A file that isn't TIFF, or is cut off, gives one row with page 0, no
pixels and the fault in `error`; pages before the fault are kept. A chain of directories that comes back
to a directory it has passed ends there with an error. A page larger than `max_page_bytes` decoded is
refused with an error, so a short file can't fill the memory.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tags, compressions and field types of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = (
    256, 257, 258, 259, 262, 273, 277, 278, 279,
)
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_TYPES = {1: "B", 3: "H", 4: "I"}

PAGE_SCHEMA = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"
MAX_PAGE_BYTES = 1 << 28


class TiffError(ValueError):
    """What is wrong with a file."""


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    """Run-length coding: runs of 3 to 128 bytes alike as (1 - n, byte), what lies between as (n - 1, bytes)."""
    out: list[bytes] = []

    def literal(start: int, end: int) -> None:
        for i in range(start, end, 128):
            out.append(bytes((min(128, end - i) - 1,)) + data[i : min(i + 128, end)])

    done = 0
    for run in _RUN.finditer(data):
        literal(done, run.start())
        out.append(bytes((257 - len(run[0]),)) + run[1])
        done = run.end()
    literal(done, len(data))
    return b"".join(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        if i >= len(data):
            raise TiffError("PackBits data end early")
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            if i + 1 >= len(data):
                raise TiffError("PackBits data end early")
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


#: A table holds codes up to 4093; the code after that clears it. Width of the i-th code after a clearing one, widened one code early.
CLEAR, END, FIRST = 256, 257, 258
AFTER_CLEAR = 4094 - FIRST + 1
WIDTHS = np.array([min(12, (FIRST + i).bit_length()) for i in range(8192)])


def _bits_packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of up to 12 bits one behind the other, high bit first: each touches three bytes at most."""
    ends = np.cumsum(widths)
    begin = ends - widths
    spread = codes.astype(np.int64) << (24 - widths - (begin & 7))
    size = int(ends[-1] + 7) >> 3
    out = np.zeros(size + 3)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount((begin >> 3) + k, (spread >> shift) & 255, size + 3)
    return out[:size].astype(np.uint8).tobytes()


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits; the table is kept by (code of the prefix, next byte)."""
    codes, table, fresh = [CLEAR], {}, FIRST
    known, emit = table.get, codes.append
    prefix = -1
    for value in data:
        if prefix < 0:
            prefix = value
            continue
        key = prefix << 8 | value
        found = known(key)
        if found is not None:
            prefix = found
            continue
        emit(prefix)
        table[key] = fresh
        fresh += 1
        if fresh == 4094:
            emit(CLEAR)
            table.clear()
            fresh = FIRST
        prefix = value
    if prefix >= 0:
        emit(prefix)
    emit(END)
    # Behind the first code, every AFTER_CLEAR-th one clears.
    return _bits_packed(np.array(codes), np.r_[9, WIDTHS[np.arange(len(codes) - 1) % AFTER_CLEAR]])


def _codes_after(data: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes from a bit on as far as one table goes, if none of them clears it, and the bits behind each."""
    ends = bit + np.cumsum(WIDTHS[: 4096 - FIRST + 2])
    ends = ends[ends <= 8 * (len(data) - 3)]
    widths = WIDTHS[: len(ends)]
    begin = ends - widths
    at = begin >> 3
    three = data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2]
    return (three >> (24 - widths - (begin & 7))) & ((1 << widths) - 1), ends


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes are cut out of the bits a table at a time: their widths follow from their number since the last clearing code."""
    padded = np.frombuffer(bytes(data) + b"\0\0\0", np.uint8)
    if size and (len(data) < 2 or int(data[0]) << 1 | data[1] >> 7 != CLEAR):
        raise TiffError("LZW data do not start with a clear code")
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    done, bit = 0, 9
    while done < size:
        codes, ends = _codes_after(padded, bit)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stops[0]) if len(stops) else len(codes)
        table, last = list(singles), b""
        for code in codes[:n].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            if last:
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
            done += len(entry)
        if not len(stops) or codes[n] == END:
            break
        bit = int(ends[n])
    if done < size:
        raise TiffError("LZW data end early")
    return b"".join(out)[:size]


def _inflate(data: bytes, size: int) -> bytes:
    try:
        out = zlib.decompressobj().decompress(data, size)
    except zlib.error as error:
        raise TiffError(f"deflate: {error}") from None
    if len(out) < size:
        raise TiffError("deflate data end early")
    return out


def _plain(data: bytes, size: int) -> bytes:
    if len(data) < size:
        raise TiffError("data end early")
    return data[:size]


DECODERS = {NONE: _plain, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}


def write(
    pages: list[np.ndarray],
    compression: int = DEFLATE,
    predictor: int = 1,
    rows_per_strip: int = 256,
    tile: tuple[int, int] | None = None,
    order: str = "<",
) -> bytes:
    """A file with a page for each array (height, width) or (height, width, samples) of bytes."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        cube = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = cube.shape
        step_y, step_x = (tile[1], tile[0]) if tile else (rows_per_strip, width)
        offsets, sizes = [], []
        for y in range(0, height, step_y):
            for x in range(0, width, step_x):
                part = cube[y : y + step_y, x : x + step_x]
                if tile:
                    part = np.pad(part, ((0, step_y - part.shape[0]), (0, step_x - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                data = ENCODERS[compression](part.tobytes())
                offsets.append(len(out))
                sizes.append(len(data))
                out += data + b"\0" * (len(data) % 2)
        fields = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        if tile:
            fields += [(TILE_WIDTH, 4, [step_x]), (TILE_HEIGHT, 4, [step_y]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"{order}{len(values)}{FIELD_TYPES[kind]}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    try:
        (count,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in FIELD_TYPES:
                continue
            form = f"{order}{n}{FIELD_TYPES[kind]}"
            if n > len(data):
                raise TiffError("directory entry out of range")
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(form, data, place)
        (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
    except struct.error:
        raise TiffError("directory out of range") from None
    return tags, after


def _pixels(data: bytes, tags: dict[int, tuple[int, ...]], max_page_bytes: int) -> np.ndarray:
    try:
        width, height = tags[WIDTH][0], tags[HEIGHT][0]
        tiled = TILE_OFFSETS in tags
        offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
        step_y, step_x = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (tags.get(ROWS_PER_STRIP, (height,))[0], width)
    except (KeyError, IndexError):
        raise TiffError("a tag is missing") from None
    samples, compression, predictor = (tags.get(t, (1,))[0] for t in (SAMPLES, COMPRESSION, PREDICTOR))
    if any(b != 8 for b in tags.get(BITS, (1,))) or tags.get(PLANAR, (1,))[0] != 1:
        raise TiffError("only 8-bit samples side by side are read")
    if compression not in DECODERS or predictor not in (1, 2):
        raise TiffError(f"compression {compression}, predictor {predictor}")
    if not (step_x and step_y) or width * height * samples > max_page_bytes:
        raise TiffError("page too large or without size")
    across, down = -(-width // step_x), -(-height // step_y)
    if len(offsets) != across * down or len(sizes) != len(offsets):
        raise TiffError("wrong number of strips or tiles")
    page = np.zeros((height, width, samples), np.uint8)
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = k // across * step_y, k % across * step_x
        rows = step_y if tiled else min(step_y, height - y)
        if offset + size > len(data):
            raise TiffError("strip out of range")
        flat = DECODERS[compression](data[offset : offset + size], rows * step_x * samples)
        part = np.frombuffer(flat, np.uint8).reshape(rows, step_x, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        page[y : y + rows, x : x + step_x] = part[: height - y, : width - x]
    return page


def read(data: bytes, max_page_bytes: int = MAX_PAGE_BYTES) -> Iterator[tuple]:
    """Rows of PAGE_SCHEMA, one for each page of a file."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    number, seen = 0, set()
    try:
        if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise TiffError("not a TIFF file")
        (at,) = struct.unpack_from(order + "I", data, 4)
        while at:
            if at in seen:
                raise TiffError("directories form a ring")
            seen.add(at)
            tags, at = _directory(data, order, at)
            page = _pixels(data, tags, max_page_bytes)
            head = (number, page.shape[1], page.shape[0], page.shape[2])
            yield (*head, tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], page.tobytes(), None)
            number += 1
    except TiffError as error:
        yield (number, None, None, None, None, None, None, str(error))


def pages(files: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """files (key, binary column) -> key and PAGE_SCHEMA, a row for each page. Narrow: no shuffle."""
    fields = [f.strip().split(" ") for f in PAGE_SCHEMA.split(",")]
    kinds = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, media in zip(batch.column(0), batch.column(1), strict=True):
                if not media.is_valid:
                    continue
                for row in read(media.as_py()):
                    arrays = [pa.array([k.as_py()], batch.column(0).type)]
                    arrays += [pa.array([v], kinds[kind]) for v, (_, kind) in zip(row, fields, strict=True)]
                    yield pa.record_batch(arrays, names=[key, *(name for name, _ in fields)])

    key_type = files.schema[key].dataType.simpleString()
    return files.select(key, column).mapInArrow(rows, f"`{key}` {key_type}, {PAGE_SCHEMA}")


#: Side by side 64 samples; PAGE_ROWS rows a page, so that a long text has several pages.
LINE, PAGE_ROWS = 64, 4096


def store(payload: bytes) -> bytes:
    """A payload (a multiple of 64 bytes) as TIFF: its checksum deals it PackBits, LZW or deflate, with or without the
    predictor, in strips or tiles, at every size."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    parts = [grid[i : i + PAGE_ROWS] for i in range(0, len(grid), PAGE_ROWS)]
    mark = zlib.crc32(payload)
    return write(parts, (DEFLATE, PACKBITS, LZW)[mark % 3], 1 + (mark >> 8) % 2, tile=(32, 16) if (mark >> 16) % 8 == 0 else None)


def round_trip(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> sizes, digests and features of each text stored as TIFF and read back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def facts(text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        payload = raw + b"\0" * (-len(raw) % LINE if raw else LINE)
        media = store(payload)
        found = list(read(media))
        if fault := found[-1][-1]:
            raise TiffError(fault)
        back = b"".join(row[6] for row in found)
        samples = np.frombuffer(back, np.uint8)
        feature = (
            f"pages={len(found)};width={found[0][1]};height={sum(r[2] for r in found)};compression={found[0][4]};"
            f"predictor={found[0][5]};sum={int(samples.sum(dtype=np.int64))};max={int(samples.max())}"
        )
        sha = hashlib.sha256
        return len(raw), len(back), sha(back).hexdigest(), zlib.crc32(back[-LINE:]), len(media), sha(media).hexdigest(), feature

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [facts(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0).cast(pa.int64())]
            columns += [pa.array([m[i] for m in made], kinds[i + 1]) for i in range(len(names) - 1)]
            yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the corpus as TIFF and back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
