"""Media columns: baseline JPEG parsed, Huffman-decoded and reduced to DC-only luminance thumbnails in numpy.

``decode`` reads any baseline (SOF0, 8-bit, Huffman) image: markers, quantisation and Huffman tables, frame, scans,
restart intervals. Entropy-coded segments are independent of one another, so all segments of all images with the same
scan layout are decoded in step: each step looks up one code of every segment still open.

``store`` keeps bytes losslessly as a grey image's quantised coefficients, the unit of the format: 64 bytes are one
block, in zig-zag order, byte b as b - 128 below 128 and b - 127 above, so that no coefficient is 0. Every block is
a restart interval of its own. A comment segment holds the number of bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ship

# Fixed values of the format: marker codes.
SOI, EOI, SOS, DQT, DHT, SOF0, DRI, COM, RST0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC0, 0xDD, 0xFE, 0xD0

BLOCK = 64
#: Blocks in a row of a stored image, and the most that the format allows in a row or column.
ROW, MOST = 1024, 8191
#: Blocks that are coded at once.
BATCH_BLOCKS = 1 << 13


@dataclass(frozen=True)
class Huffman:
    """A code: symbols by length; the table over 16 bits in sight gives length << 8 | symbol, 0 for no code."""

    counts: tuple[int, ...]
    symbols: tuple[int, ...]

    @cache  # noqa: B019  a few codes
    def lookup(self) -> np.ndarray:
        table = np.zeros(1 << 16, np.int64)
        at = k = 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                step = 1 << (16 - length)
                table[at : at + step] = length << 8 | self.symbols[k]
                at += step
                k += 1
        return table

    def codes(self) -> dict[int, tuple[int, int]]:
        out, code, k = {}, 0, 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                out[self.symbols[k]] = code, length
                code += 1
                k += 1
            code <<= 1
        return out


#: The code of stored images. DC: sizes 0 to 11 with 4 bits. AC: sizes 1 to 8 without a run with 4 bits, all else with 9.
DC_CODE = Huffman((0, 0, 0, 12, *[0] * 12), tuple(range(12)))
_SHORT = tuple(range(1, 9))
_REST = tuple(x for x in [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))] if x not in _SHORT)
AC_CODE = Huffman((0, 0, 0, 8, 0, 0, 0, 0, len(_REST), *[0] * 7), _SHORT + _REST)


@dataclass
class Component:
    horizontal: int
    vertical: int
    table: int
    dc: Huffman | None = None
    ac: Huffman | None = None


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    interval: int = 0
    comment: bytes = b""
    scans: list[tuple[list[int], int, np.ndarray]] = field(default_factory=list)  # component ids, MCUs an interval, data


def parse(data: bytes) -> Image:
    """Walk the markers. Raises ValueError for what isn't a whole baseline image."""
    if data[:2] != bytes((0xFF, SOI)):
        raise ValueError("no start of image")
    image, codes, at = Image(), {}, 2
    raw = np.frombuffer(data, np.uint8)
    while True:
        if at + 4 > len(data) and data[at : at + 2] != bytes((0xFF, EOI)) or data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:  # fill bytes may precede a marker
            at += 1
            continue
        if marker == EOI:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("a segment is cut short")
        at += 2 + size
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                image.quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.int32)
                body = body[n:]
        elif marker == DHT:
            while body:
                counts = tuple(body[1:17])
                codes[body[0]] = Huffman(counts, tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == SOF0:
            bits, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("not 8 bits a sample")
            for k in range(n):
                name, factors, table = body[6 + 3 * k : 9 + 3 * k]
                image.components[name] = Component(factors >> 4, factors & 15, table)
        elif 0xC1 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise ValueError(f"frame type {marker:#x} isn't baseline")
        elif marker == DRI:
            image.interval = int.from_bytes(body, "big")
        elif marker == COM:
            image.comment = body
        elif marker == SOS:
            names = [body[1 + 2 * k] for k in range(body[0])]
            for k, name in enumerate(names):
                tables = body[2 + 2 * k]
                image.components[name].dc, image.components[name].ac = codes[tables >> 4], codes[16 | tables & 15]
            ends = np.flatnonzero((raw[at:-1] == 0xFF) & (raw[at + 1 :] != 0) & (raw[at + 1 :] >> 3 != RST0 >> 3))
            if not len(ends):
                raise ValueError("a scan has no end")
            image.scans.append((names, image.interval, raw[at : at + int(ends[0])]))
            at += int(ends[0])
    if not image.scans or not image.components:
        raise ValueError("no scan")
    return image


def segments(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes without stuffing and markers, and each restart segment's first byte."""
    lead = np.flatnonzero(scan[:-1] == 0xFF)
    follow = scan[lead + 1]
    marks = lead[(follow != 0) & (follow != 0xFF)]
    keep = np.ones(len(scan), bool)
    keep[lead[follow == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return scan[keep], np.concatenate([[0], kept_before[marks + 2]]).astype(np.int64)


#: By size: amplitudes below the half stand for negative values, less the offset.
_HALF = np.array([0, *(1 << s for s in range(16))], np.int64)
_OFFSET = np.array([(1 << s) - 1 for s in range(17)], np.int64)


def _windows(stream: np.ndarray) -> np.ndarray:
    """The 64 bits from each byte on; zeros follow the end."""
    padded_ = np.concatenate([stream, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded_, 8).copy().view(">u8").ravel().astype(np.uint64)


def _symbols(windows: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each bit: the run and size that a code stands for, the amplitude's value, the bit after both."""
    seen = windows[at >> 3] << (at & 7).view(np.uint64)
    entry = table[(seen >> np.uint64(48)).view(np.int64)]
    length = entry >> 8
    if not length.all():
        raise ValueError("a code is not in the table")
    symbol = entry & 255
    size = symbol & 15
    amplitude = (((seen << length.view(np.uint64)) >> np.uint64(1)) >> (63 - size).view(np.uint64)).view(np.int64)
    amplitude -= (amplitude < _HALF[size]) * _OFFSET[size]
    return symbol, amplitude, at + length + size


def huffman_decode(stream: np.ndarray, starts: np.ndarray, blocks: np.ndarray, layout: list[tuple[Huffman, Huffman, int]]) -> np.ndarray:
    """Coefficients (all blocks, 64) in zig-zag order, segment after segment.

    Segment s begins at byte ``starts[s]`` and has ``blocks[s]`` blocks; block b of a segment has the codes and the
    DC predictor of ``layout[b % len(layout)]``. Predictors begin at 0 in each segment.
    """
    spare = 256  # a block's codes can run no further past the end
    windows = _windows(np.concatenate([stream, np.zeros(spare, np.uint8)]))
    tables = [(dc.lookup(), ac.lookup()) for dc, ac, _ in layout]
    out = np.zeros((int(blocks.sum()), BLOCK), np.int16)
    first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(np.int64)
    bit = starts.astype(np.int64) * 8
    predictors = np.zeros((max(p for *_, p in layout) + 1, len(starts)), np.int64)
    for b in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > b)
        dc_table, ac_table = tables[b % len(layout)]
        predictor = predictors[layout[b % len(layout)][2]]
        _, difference, at = _symbols(windows, bit[live], dc_table)
        predictor[live] += difference
        found = np.zeros((BLOCK, len(live)), np.int16)
        found[0] = predictor[live]
        k = 1  # while all segments are at the same place of their block, a number
        open_ = None
        while True:
            symbol, got, after = _symbols(windows, at if open_ is None else at[open_], ac_table)
            run = symbol >> 4
            if open_ is None and not run.any() and symbol.all():
                found[k] = got
                at, k = after, k + 1
                if k == BLOCK:
                    break
                continue
            if open_ is None:
                open_, k = np.arange(len(live)), np.full(len(live), k)
            place = k[open_] + run
            here = ((symbol & 15) > 0) & (place < BLOCK)
            found[place[here], open_[here]] = got[here]
            at[open_], k[open_] = after, place + 1
            open_ = open_[(symbol != 0) & (place + 1 < BLOCK)]
            if not len(open_):
                break
        if (at > 8 * (len(stream) + 1)).any():
            raise ValueError("a scan is cut short")
        out[first_block[live] + b] = found.T
        bit[live] = at
    return out


def coefficients(image: Image) -> dict[int, np.ndarray]:
    """Each component's blocks (rows, columns, 64) of quantised coefficients, whole MCUs."""
    most_h = max(c.horizontal for c in image.components.values())
    most_v = max(c.vertical for c in image.components.values())
    out = {}
    for names, interval, scan in image.scans:
        parts = [image.components[n] for n in names]
        stream, starts = segments(scan)
        if len(names) == 1:  # not interleaved: one block an MCU, only blocks that hold samples
            c = parts[0]
            wide = -(-(-(-image.width * c.horizontal // most_h)) // 8)
            high = -(-(-(-image.height * c.vertical // most_v)) // 8)
            layout, grid = [(c.dc, c.ac, 0)], [(1, 1)]
        else:
            wide, high = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
            layout = [(c.dc, c.ac, p) for p, c in enumerate(parts) for _ in range(c.horizontal * c.vertical)]
            grid = [(c.vertical, c.horizontal) for c in parts]
        units = wide * high
        each = interval or units
        expected = -(-units // each)
        if len(starts) != expected:
            raise ValueError(f"{len(starts)} restart segments, not {expected}")
        counts = np.full(expected, each, np.int64)
        counts[-1] = units - each * (expected - 1)
        blocks = huffman_decode(stream, starts, counts * len(layout), layout).reshape(high, wide, len(layout), BLOCK)
        at = 0
        for name, (v, h) in zip(names, grid, strict=True):
            own = blocks[:, :, at : at + v * h].reshape(high, wide, v, h, BLOCK)
            out[name] = own.transpose(0, 2, 1, 3, 4).reshape(high * v, wide * h, BLOCK)
            at += v * h
    return out


def luminance_thumbnail(dc: np.ndarray, quant0: int) -> np.ndarray:
    """One sample a block, its mean: DC times its quantiser over 8, about 128."""
    return np.clip(np.rint(dc.astype(np.float64) * quant0 / 8 + 128), 0, 255).astype(np.uint8)


def thumbnail_hashes(thumbnail: np.ndarray) -> tuple[str, str]:
    """A 64-bit average hash over 8 x 8 fields, and the XXH64 of the thumbnail itself, as hex."""
    sums = np.zeros((thumbnail.shape[0] + 1, thumbnail.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumbnail.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    edges = [np.arange(9) * n // 8 for n in thumbnail.shape]
    (top, left), (bottom, right) = (e[:-1] for e in edges), (np.maximum(e[1:], e[:-1] + 1) for e in edges)
    fields = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
    fields = fields / ((bottom - top)[:, None] * (right - left))
    bits = np.packbits((fields > fields.mean()).ravel()).tobytes().hex()
    return bits, xxhash.xxh64_hexdigest(np.ascontiguousarray(thumbnail).tobytes())


def feature(width: int, height: int, thumbnail: np.ndarray) -> str:
    return f"{width}x{height}:{':'.join(thumbnail_hashes(thumbnail))}"


def decode(data: bytes) -> tuple[Image, dict[int, np.ndarray], np.ndarray]:
    """The parsed image, its components' coefficients and the thumbnail of its first component."""
    image = parse(data)
    blocks = coefficients(image)
    first = next(iter(image.components))
    quant = image.quant[image.components[first].table]
    return image, blocks, luminance_thumbnail(blocks[first][:, :, 0], int(quant[0]))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(blocks: int, n_bytes: int) -> tuple[bytes, int]:
    """All that comes before the scan's data, and the blocks of the whole grid."""
    wide = min(blocks, ROW if blocks <= ROW * MOST else MOST)
    high = -(-blocks // wide)
    tables = b"".join(bytes([slot, *code.counts, *code.symbols]) for slot, code in ((0x00, DC_CODE), (0x10, AC_CODE)))
    head = b"".join(
        [
            bytes((0xFF, SOI)),
            _segment(COM, struct.pack(">QQ", n_bytes, blocks)),
            _segment(DQT, bytes([0, *[1] * 64])),
            _segment(SOF0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0)),
            _segment(DHT, tables),
            _segment(DRI, struct.pack(">H", 1)),
            _segment(SOS, bytes((1, 1, 0, 0, 63, 0))),
        ]
    )
    return head, wide * high


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte value: code and amplitude bits together, and their number; in the first place of a block, and in others."""
    bits, lengths = np.zeros((2, 256), np.int64), np.zeros((2, 256), np.int64)
    for place, code in enumerate((DC_CODE.codes(), AC_CODE.codes())):
        for b in range(256):
            v = b - 128 if b < 128 else b - 127
            size = abs(v).bit_length()
            prefix, n = code[size]
            bits[place, b] = prefix << size | (v if v > 0 else v + (1 << size) - 1)
            lengths[place, b] = n + size
    return bits, lengths


CODE_BITS, CODE_LENGTHS = _code_tables()


def scan_of(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of (n, 64) payload bytes, byte-aligned block by block, and each block's first byte."""
    columns = np.ascontiguousarray(payload.T)
    lengths = np.concatenate([CODE_LENGTHS[0][columns[:1]], CODE_LENGTHS[1][columns[1:]]])
    ends = np.cumsum(lengths, axis=0, dtype=np.int64)
    total = ends[-1]
    size = (total + 7) >> 3
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(first[-1]) + 4, np.uint8)
    places = ends - lengths + first[:-1] * 8
    for k in range(BLOCK):  # blocks are apart from one another, so no two writes of a step meet
        at = places[k]
        word = CODE_BITS[int(k > 0)][columns[k]] << (24 - (at & 7) - lengths[k])
        at = at >> 3
        out[at] |= (word >> 16).astype(np.uint8)
        out[at + 1] |= (word >> 8).astype(np.uint8)
        out[at + 2] |= word.astype(np.uint8)
    out[first[1:] - 1] |= ((1 << (size * 8 - total)) - 1).astype(np.uint8)  # ones up to the byte
    return out[: int(first[-1])], first


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def _marked(payload: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes with the restart marker of each block's ``number`` after it, and where each block begins."""
    raw, first = scan_of(payload)
    stuffing = np.concatenate([[0], np.cumsum(raw == 0xFF)]) if (raw == 0xFF).any() else np.zeros(len(raw) + 1, np.int64)
    sizes = np.diff(first)
    block = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(raw) + 2 * len(sizes) + int(stuffing[-1]), np.uint8)
    out[np.arange(len(raw)) + 2 * block + stuffing[:-1]] = raw
    ends = first[1:] + stuffing[first[1:]] + 2 * np.arange(len(sizes))
    out[ends] = 0xFF
    out[ends + 1] = RST0 + number % 8
    return out, np.concatenate([[0], ends + 2])


def store_many(texts: list[bytes]) -> list[bytes]:
    """Each text, padded, as a JPEG file. The blocks of all texts are coded in step."""
    payloads = [padded(t) for t in texts]
    counts = np.array([len(p) // BLOCK for p in payloads])
    number = np.concatenate([np.arange(n) for n in counts])
    every = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    parts, begins, offset = [], [], 0
    for k in range(0, len(every), BATCH_BLOCKS):
        part, at = _marked(every[k : k + BATCH_BLOCKS], number[k : k + BATCH_BLOCKS])
        parts.append(part)
        begins.append(at[:-1] + offset)
        offset += len(part)
    data = np.concatenate(parts).tobytes()
    begin = np.concatenate([*begins, [offset]])
    code, n = AC_CODE.codes()[0]
    dc, m = DC_CODE.codes()[0]
    empty = (dc << n | code) << (16 - m - n) | (1 << (16 - m - n)) - 1
    out, at = [], 0
    for text, blocks in zip(texts, counts.tolist(), strict=True):
        head, grid = _header(blocks, len(text))
        body = data[begin[at] : begin[at + blocks]]
        at += blocks
        body += b"".join(struct.pack(">HBB", empty, 0xFF, RST0 + k % 8) for k in range(blocks, grid))
        out.append(head + body[:-2] + bytes((0xFF, EOI)))
    return out


def store(text: bytes) -> bytes:
    return store_many([text])[0]


def payload_of(coefs: np.ndarray) -> bytes:
    """Stored coefficients back as bytes."""
    return np.where(coefs < 0, coefs + 128, coefs + 127).astype(np.uint8).tobytes()


@dataclass
class Read:
    n_bytes: int
    payload: bytes
    width: int
    height: int
    thumbnail: np.ndarray


def read_many(files: list[bytes]) -> list[Read]:
    """Stored images back as payloads and thumbnails: all their segments are decoded in step."""
    if not files:
        return []
    images = [parse(f) for f in files]
    streams, starts, grids = [], [], []
    offset = 0
    for image in images:
        (part,) = image.components.values()
        ((_, interval, scan),) = image.scans
        if (part.dc, part.ac, interval) != (DC_CODE, AC_CODE, 1):
            raise ValueError("not a stored payload")
        stream, first = segments(scan)
        streams.append(stream)
        starts.append(first + offset)
        grids.append(len(first))
        offset += len(stream)
        if len(first) * 64 != image.width * image.height:
            raise ValueError("a scan lacks blocks")
    stream, first = np.concatenate(streams), np.concatenate(starts)
    coefs = np.empty((len(first), BLOCK), np.int16)
    layout = [(DC_CODE, AC_CODE, 0)]
    for k in range(0, len(first), BATCH_BLOCKS):
        some = first[k : k + BATCH_BLOCKS]
        stop = int(first[k + BATCH_BLOCKS]) if k + BATCH_BLOCKS < len(first) else len(stream)
        coefs[k : k + BATCH_BLOCKS] = huffman_decode(stream[some[0] : stop], some - some[0], np.ones(len(some), np.int64), layout)
    out, at = [], 0
    for image, grid in zip(images, grids, strict=True):
        n_bytes, blocks = struct.unpack(">QQ", image.comment)
        own = coefs[at : at + grid]
        at += grid
        thumbnail = luminance_thumbnail(own[:, 0].reshape(image.height // 8, image.width // 8), int(image.quant[0][0]))
        out.append(Read(n_bytes, payload_of(own[:blocks]), image.width, image.height, thumbnail))
    return out


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(store_many([t.as_py() or b"" for t in part.column(1)]), pa.binary())], ["id", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, media)``: each text's UTF-8 bytes as a JPEG file. A null text is stored like an empty one.

    Rows are stored one by one: repeated rows, repeated ids and null ids come out as they went in; an empty table gives
    an empty table. Other columns are not read. An image holds 4 GB, which is more than a text of Spark can have.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(_stored, f"id {kind}, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            files = [x.as_py() for x in part.column(1)]
            known = iter(read_many([f for f in files if f is not None]))
            pairs = [None if f is None else (f, next(known)) for f in files]
            told = lambda kind, get: pa.array([None if x is None else get(*x) for x in pairs], kind)  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    told(pa.int64(), lambda f, r: r.n_bytes),
                    told(pa.int64(), lambda f, r: len(r.payload)),
                    told(pa.string(), lambda f, r: hashlib.sha256(r.payload).hexdigest()),
                    told(pa.int64(), lambda f, r: zlib.crc32(r.payload[-BLOCK:])),
                    told(pa.int64(), lambda f, r: len(f)),
                    told(pa.string(), lambda f, r: hashlib.sha256(f).hexdigest()),
                    told(pa.int32(), lambda f, r: r.width),
                    told(pa.int32(), lambda f, r: r.height),
                    told(pa.string(), lambda f, r: feature(r.width, r.height, r.thumbnail)),
                ],
                FEATURES,
            )


FEATURES = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature"]


def media_features(media: DataFrame) -> DataFrame:
    """From ``(id, media)`` of ``to_media``: the payload's and the file's sizes and digests, dimensions, thumbnail hashes.

    A null ``media`` gives nulls; one that is no stored payload, an empty one too, raises ValueError. Rows are read one by one,
    whatever repeats; an empty table gives an empty table. Other columns are not read.
    """
    kind = media.schema["id"].dataType.simpleString()
    kinds = [kind, "bigint", "bigint", "string", "bigint", "bigint", "string", "int", "int", "string"]
    return media.select("id", "media").mapInArrow(_features, ", ".join(f"{n} {k}" for n, k in zip(FEATURES, kinds, strict=True)))
