import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from millrace.llm import jpeg

SCHEMA = "doc_id bigint, text string, id string, media string"


def texts():
    rng = random.Random(2)
    return [b"", b"a", b"a" * 63, b"a" * 64, b"a" * 65, bytes(range(256)) * 3, b"\xff" * 700, b"\x80" * 130, rng.randbytes(70_000), "é ü 日本".encode() * 40, b"x" * (jpeg.ROW * 64 * 2 + 100)]


def test_round_trip_of_all_bytes():
    files = jpeg.store_many(texts())
    assert files == [jpeg.store(t) for t in texts()]
    for text, read, file in zip(texts(), jpeg.read_many(files), files, strict=True):
        assert read.payload == jpeg.padded(text) and read.n_bytes == len(text)
        assert len(read.payload) % 64 == 0 and read.payload
        image, blocks, thumbnail = jpeg.decode(file)
        assert (image.width, image.height) == (read.width, read.height) and (thumbnail == read.thumbnail).all()


def slow_decode(scan_bits, image, name, total):
    """A bit-by-bit decoder of one grey scan without restart markers."""
    part = image.components[name]
    at, predictor, out = 0, 0, []
    look = [{(length, code): symbol for symbol, (code, length) in c.codes().items()} for c in (part.dc, part.ac)]

    def symbol(codes):
        nonlocal at
        code = 0
        for length in range(1, 17):
            code = code << 1 | scan_bits[at]
            at += 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError

    def amplitude(size):
        nonlocal at
        bits = 0
        for _ in range(size):
            bits = bits << 1 | scan_bits[at]
            at += 1
        return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1

    for _ in range(total):
        block = [0] * 64
        predictor += amplitude(symbol(look[0]))
        block[0], k = predictor, 1
        while k < 64:
            s = symbol(look[1])
            if not s:
                break
            k += s >> 4
            if s & 15:
                block[k] = amplitude(s & 15)
            k += 1
        out.append(block)
    return out


def write_scan(blocks, order):
    """Encode blocks [(component, 64 values)] by the module's codes, with DC prediction; returns bytes."""
    dc, ac = jpeg.DC_CODE.codes(), jpeg.AC_CODE.codes()
    bits, predictors = "", {}

    def put(code, v, size):
        nonlocal bits
        bits += format(code[0], f"0{code[1]}b") + (format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else "")

    for name, block in blocks:
        diff = block[0] - predictors.get(name, 0)
        predictors[name] = block[0]
        put(dc[abs(diff).bit_length()], diff, abs(diff).bit_length())
        run = 0
        last = max([k for k in range(1, 64) if block[k]], default=0)
        for k in range(1, last + 1):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                put(ac[0xF0], 0, 0)
                run -= 16
            put(ac[run << 4 | abs(block[k]).bit_length()], block[k], abs(block[k]).bit_length())
            run = 0
        if last < 63:
            put(ac[0], 0, 0)
    bits += "1" * (-len(bits) % 8)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    return raw.replace(b"\xff", b"\xff\0")


def grey_file(width, height, scan, components=b"\x01\x11\x00"):
    n = len(components) // 3
    tables = b"".join(bytes([slot, *c.counts, *c.symbols]) for slot, c in ((0, jpeg.DC_CODE), (16, jpeg.AC_CODE)))
    names = b"".join(bytes([components[3 * k], 0]) for k in range(n))
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    return (
        b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(jpeg.DQT, bytes([0, 16, *[3] * 63]))
        + seg(jpeg.SOF0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + components)
        + seg(jpeg.DHT, tables) + seg(jpeg.SOS, bytes([n]) + names + bytes([0, 63, 0])) + scan + b"\xff\xd9"
    )


def test_decodes_runs_and_prediction_like_a_bit_by_bit_decoder():
    rng = random.Random(9)
    blocks = [[rng.randrange(-900, 900)] + [rng.choice([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, rng.randrange(-1000, 1000)]) for _ in range(63)] for _ in range(12)]
    blocks[3] = [5] + [0] * 63
    blocks[4] = [5] + [0] * 62 + [1]
    scan = write_scan([(1, b) for b in blocks], None)
    image, found, thumbnail = jpeg.decode(grey_file(30, 20, scan))  # 4 x 3 blocks
    assert found[1].reshape(-1, 64).tolist() == blocks
    plain = scan.replace(b"\xff\0", b"\xff")
    assert slow_decode([x >> (7 - k) & 1 for x in plain for k in range(8)], image, 1, 12) == blocks
    assert thumbnail.shape == (3, 4) and thumbnail[0, 0] == np.clip(round(blocks[0][0] * 16 / 8 + 128), 0, 255)


def test_interleaved_components():
    rng = random.Random(4)
    block = lambda: [rng.randrange(-50, 50) for _ in range(64)]
    order, luma, chroma = [], {}, []
    for my in range(1):
        for mx in range(2):
            for v in range(2):
                for h in range(2):
                    b = block()
                    luma[my * 2 + v, mx * 2 + h] = b
                    order.append((1, b))
            b = block()
            chroma.append(b)
            order.append((2, b))
    image, found, thumbnail = jpeg.decode(grey_file(32, 16, write_scan(order, None), b"\x01\x22\x00\x02\x11\x00"))
    assert all(found[1][y, x].tolist() == b for (y, x), b in luma.items())
    assert found[2].reshape(-1, 64).tolist() == chroma and thumbnail.shape == (2, 4)


@pytest.mark.parametrize("damage", [lambda f: f[:40], lambda f: b"GIF" + f[3:], lambda f: f[:-30], lambda f: f.replace(b"\xff\xc0", b"\xff\xc2"), lambda f: b""])
def test_damaged_files_raise(damage):
    with pytest.raises(ValueError):
        jpeg.read_many([damage(jpeg.store(b"some text" * 100))])


def naive_file(text):
    """A stored file written bit by bit: each block of 64 bytes a restart interval."""
    payload = text + b"\0" * (64 - len(text) % 64 if len(text) % 64 or not text else 0)
    blocks = [[b - 128 if b < 128 else b - 127 for b in payload[k : k + 64]] for k in range(0, len(payload), 64)]
    wide = min(len(blocks), jpeg.ROW)
    high = -(-len(blocks) // wide)
    scan = b"".join(write_scan([(1, b)], None) + bytes([0xFF, 0xD0 + k % 8]) for k, b in enumerate(blocks + [[0] * 64] * (wide * high - len(blocks))))
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    tables = b"".join(bytes([slot, *c.counts, *c.symbols]) for slot, c in ((0, jpeg.DC_CODE), (16, jpeg.AC_CODE)))
    head = b"\xff\xd8" + seg(jpeg.COM, len(text).to_bytes(8, "big") + len(blocks).to_bytes(8, "big")) + seg(jpeg.DQT, b"\0" + b"\1" * 64)
    head += seg(jpeg.SOF0, b"\x08" + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + b"\1\1\x11\0") + seg(jpeg.DHT, tables) + seg(jpeg.DRI, b"\0\1") + seg(jpeg.SOS, b"\1\1\0\0\x3f\0")
    return payload, head + scan[:-2] + b"\xff\xd9", [blocks[k : k + wide] for k in range(0, len(blocks), wide)], wide, high


def naive_row(text):
    """All columns from plain loops over bytes."""
    payload, file, rows, wide, high = naive_file(text)
    shade = lambda v: min(255, max(0, round(v / 8 + 128)))  # noqa: E731  Python rounds halves to even, too
    grid = [[shade(b[0]) for b in row] + [shade(0)] * (wide - len(row)) for row in rows]
    span = lambda n, k: range(k * n // 8, max((k + 1) * n // 8, k * n // 8 + 1))
    means = [sum(grid[y][x] for y in span(high, r) for x in span(wide, c)) / (len(span(high, r)) * len(span(wide, c))) for r in range(8) for c in range(8)]
    middle = float(np.mean(means))
    bits = "".join("1" if m > middle else "0" for m in means)
    look = xxhash.xxh64(b"".join(map(bytes, grid))).hexdigest()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(text), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(file), sha(file), 8 * wide, 8 * high, f"{8 * wide}x{8 * high}:{int(bits, 2):016x}:{look}"


def test_every_column_equals_a_naive_version(spark):
    texts = [t.decode("latin-1") for t in (b"", b"a", b"a" * 63, b"a" * 64, b"a" * 65, bytes(range(256)) * 5)] + ["é日本 " * 90, "x" * (jpeg.ROW * 64 + 70), "Line\n" * 900]
    rng = random.Random(6)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF)])) for _ in range(rng.randrange(1, 9000))) for _ in range(6)]
    got = jpeg.media_features(jpeg.to_media(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA))).collect()
    assert {r.id: tuple(r)[1:] for r in got} == {i: naive_row(t.encode()) for i, t in enumerate(texts)}


def test_long_payloads_get_wider_rows(monkeypatch):
    monkeypatch.setattr(jpeg, "ROW", 2)
    monkeypatch.setattr(jpeg, "MOST", 9)
    text = b"0123456789abcdef" * 4 * 40  # 40 blocks: over 2 x 9
    (read,) = jpeg.read_many([jpeg.store(text)])
    assert read.payload == text and (read.width, read.height) == (72, 40)


def test_null_media(spark):
    media = spark.createDataFrame([(1, None), (2, bytearray(jpeg.store(b"abc")))], "id bigint, media binary")
    got = {r.id: tuple(r)[1:] for r in jpeg.media_features(media).collect()}
    assert got[1] == (None,) * 9 and got[2] == naive_row(b"abc")


def test_tables(spark):
    rows = [(1, "a" * 100, "x", "y"), (1, "a" * 100, "x", "y"), (None, None, "x", "y"), (2, "", "x", "y"), (3, "long " * 30_000, "x", "y")]
    got = jpeg.media_features(jpeg.to_media(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((str(r.id), r.n_bytes, r.payload_bytes) for r in got) == [("1", 100, 128), ("1", 100, 128), ("2", 0, 64), ("3", 150_000, 150_016), ("None", 0, 64)]
    by = {(str(r.id), r.n_bytes): r for r in got}
    assert by["None", 0].media_sha256 == by["2", 0].media_sha256 and by["None", 0].feature == by["2", 0].feature
    assert jpeg.media_features(jpeg.to_media(spark.createDataFrame([], SCHEMA))).collect() == []
