"""Line-level deduplication with two Bloom filters, dealt by ranges of hashes.

A line key is known by its BLAKE2b digest of 128 bits. One pass over the texts writes a row for each document and key: the digest's
halves and the id. Within a run of such rows, a hash that comes again is known to be repeated, and one of its rows leads; so a
line that half the documents hold sends a row a run and no more.

The leading hashes are dealt by ranges. Each range has two Bloom filters, of hashes seen and of hashes seen again, sized by its share of the
lines, so a filter's size and its share of false hits are the same whatever the number of lines: there are more ranges. A range's
twice-seen filter then meets the rows of its range that are not known to be repeated, in the order filter, rows. What it lets through,
and what was known before, are the suspects. Only they are grouped, by the whole digest, to confirm repeats and to choose the first document.
The last pass drops lines from the documents that have some to lose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ship, written

MIN_KEY = 10
#: Bits of the filters for each line, and bits set for each key.
BITS_PER_LINE, PROBES = 12, 3
#: Lines of a range, on average, at the most; and ranges at the least.
RANGE_LINES, RANGES = 2_000_000, 64
#: Rows in which repeated hashes are looked for before anything is dealt.
RUN = 1 << 19


def line_keys(text: bytes) -> list[bytes | None]:
    """For each line its key, or None if the key is shorter than 10 code points."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # of bytes: A-Z only
        key = line.strip()  # of bytes: the ASCII white space only
        n = len(key)
        out.append(key if n >= 4 * MIN_KEY or n >= MIN_KEY and (key.isascii() or len(key.decode("utf-8", "replace")) >= MIN_KEY) else None)
    return out


def digests(keys: list[bytes]) -> np.ndarray:
    """(keys, 2) 64-bit halves."""
    raw = b"".join([hashlib.blake2b(k, digest_size=16).digest() for k in keys])
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(hashes, PROBES) bit positions, by double hashing. The high bits name the range, so the step is mixed from all of them."""
    h = hashes.view(np.uint64)[:, None]
    step = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) | np.uint64(1)
    return ((h + np.arange(PROBES, dtype=np.uint64) * step) & np.uint64(bits - 1)).astype(np.int64)


def ranges_for(lines: int) -> int:
    """A power of two."""
    return max(RANGES, 1 << (max(1, -(-lines // RANGE_LINES)) - 1).bit_length())


def filter_bits(lines: int, ranges: int) -> int:
    """A power of two of bits for a range's share of the lines; its hashes are spread evenly."""
    return max(1 << 13, 1 << (-(-max(1, lines) // ranges) * BITS_PER_LINE - 1).bit_length())


def _get(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1


def _put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def add(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray, repeated: np.ndarray, bits: int) -> None:
    """Note hashes, some of them known to be repeated; a hash may come several times."""
    own, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    again = counts > 1
    np.logical_or.at(again, np.searchsorted(own, hashes[repeated]), True)
    at = positions(own, bits)
    seen = _get(once, at).all(axis=1)
    _put(twice, at[again | seen].ravel())
    _put(once, at[~seen].ravel())


ROWS = "h bigint, g bigint, repeated boolean, leads boolean"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, h, g, repeated, leads)`` for each row and distinct key of it."""
    ids: list[pa.Array] = []
    found: list[np.ndarray] = []
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        both = np.concatenate(found)
        _, first, where, counts = np.unique(both[:, 0], return_index=True, return_inverse=True, return_counts=True)
        leads = np.zeros(len(both), bool)
        leads[first] = True
        columns = [pa.concat_arrays(ids), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(counts[where] > 1), pa.array(leads)]
        whole = pa.RecordBatch.from_arrays(columns, ["id", "h", "g", "repeated", "leads"])
        for k in range(0, len(both), 1 << 16):
            yield whole.slice(k, 1 << 16)

    for batch in batches:
        rows: list[int] = []
        keys: list[bytes] = []
        for i, text in enumerate(batch.column(1)):
            own = dict.fromkeys(k for k in line_keys(text.as_py() or b"") if k is not None)
            rows += [i] * len(own)
            keys += own
        if keys:
            ids.append(batch.column(0).take(pa.array(rows, pa.int64())))
            found.append(digests(keys))
            held += len(keys)
        if held >= RUN:
            yield from flushed()
            ids, found, held = [], [], 0
    if held:
        yield from flushed()


def _filters(bits: int):
    """A range's leading rows ``(range, h, repeated)`` to its twice-seen filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, name = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), None
        for batch in batches:
            if batch.num_rows:
                name = batch.column(0)[0]
                add(once, twice, batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), bits)
        if name is not None:
            packed = zstandard.ZstdCompressor(level=1).compress(twice.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.int32()), pa.array([packed], pa.binary())], ["range", "filter"])

    return run


def _sifted(bits: int):
    """Of a range's rows ``(filter, id, h, g)``, the filter first: those that may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = None
        for batch in batches:
            if twice is None and batch.num_rows:
                twice = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(0)[0].as_py(), max_output_size=bits // 8), np.uint8)
                batch = batch.slice(1)
            if batch.num_rows:
                hit = _get(twice, positions(batch.column(2).to_numpy(), bits)).all(axis=1)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit)) for c in batch.columns[1:]], ["id", "h", "g"])

    return run


def suspects(hashes: DataFrame) -> DataFrame:
    """``(id, h, g)`` of the rows ``(id, h, g, repeated, leads)`` that may share their hash with another id: all that do, and few others."""
    lines = hashes.count()
    ranges = ranges_for(lines)
    bits = filter_bits(lines, ranges)
    kind = hashes.schema["id"].dataType.simpleString()
    dealt = hashes.where("leads").withColumn("range", F.shiftrightunsigned("h", 65 - ranges.bit_length()).cast("int"))
    filters = dealt.select("range", "h", "repeated").repartitionById(ranges, F.col("range")).mapInArrow(_filters(bits), "range int, filter binary")
    rest = dealt.where("not repeated").select("range", F.lit(None).cast("binary").alias("filter"), "id", "h", "g")
    first = written(filters, "line-filters").select("range", "filter", F.lit(None).cast(kind).alias("id"), F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("g"))
    both = first.unionByName(rest).repartitionById(ranges, F.col("range")).sortWithinPartitions(F.col("filter").isNull())
    sifted = both.select("filter", "id", "h", "g").mapInArrow(_sifted(bits), f"id {kind}, h bigint, g bigint")
    return written(hashes.where("repeated").select("id", "h", "g").unionByName(sifted), "suspects")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, dropped, texts = [], [], []
        for text, hs, gs in zip(batch.column("text"), batch.column("hs"), batch.column("gs"), strict=True):
            raw = text.as_py()
            parts = (raw or b"").split(b"\n")
            stay = parts
            if hs.is_valid:
                gone = set(zip(hs.as_py(), gs.as_py(), strict=True))
                keys = line_keys(raw)
                own = list(dict.fromkeys(k for k in keys if k is not None))
                lost = {k for k, d in zip(own, digests(own).tolist(), strict=True) if tuple(d) in gone}
                stay = [x for x, k in zip(parts, keys, strict=True) if k not in lost]
            lines.append(len(parts))
            dropped.append(len(parts) - len(stay))
            texts.append(raw if len(parts) == len(stay) else b"\n".join(stay))
        rest = [c for c in batch.schema.names if c not in ("text", "hs", "gs")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t or b"").hexdigest() for t in texts], pa.string())],
            [*rest, "n_lines", "n_dropped", "kept", "kept_sha256"],
        )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``(id, n_lines, n_dropped, kept, kept_sha256)`` for each row of ``docs``; with ``carry`` a struct ``row`` of its other columns too.

    Keys (lines stripped of ASCII white space, A-Z lower-cased) of 10 code points or more that occur in two
    documents or more lose all their lines but those of the smallest id that holds them. A null or empty text
    is one empty line; a null text without a loss stays null in ``kept``. Rows with a null id neither lose lines
    nor make others lose them. Rows with the same id are one document: its lines stay in each of them or go
    from each. An empty table gives an empty table. Columns with other names are not read unless carried.
    """
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    own = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")] if carry and rest else [])
    )
    kind = docs.schema[id_col].dataType.simpleString()
    named = own.where(F.col("id").isNotNull()).select("id", F.col("text").cast("binary").alias("text"))
    some = suspects(written(named.mapInArrow(_hashed, f"id {kind}, {ROWS}"), "line-hashes"))
    repeats = some.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") != F.col("last"))
    repeats = written(repeats.select("h", "g", "first"), "repeats")
    # a document's losses meet in its own row only: bounded by its text
    losses = some.join(repeats, ["h", "g"]).where(F.col("id") != F.col("first")).groupBy("id").agg(F.collect_set(F.struct("h", "g")).alias("gone"))
    losses = losses.select("id", F.col("gone.h").alias("hs"), F.col("gone.g").alias("gs"))
    losses = losses.withColumnRenamed("id", "loser").hint("shuffle_hash")
    joined = own.withColumn("text", F.col("text").cast("binary")).join(losses, F.col("id") == F.col("loser"), "left").drop("loser")
    row = f"row {docs.select(*[F.col(f'`{c}`') for c in rest]).schema.simpleString()}, " if carry and rest else ""
    out = joined.select("id", *(["row"] if row else []), "text", "hs", "gs").mapInArrow(
        _kept, f"id {kind}, {row}n_lines bigint, n_dropped bigint, kept binary, kept_sha256 string"
    )
    return out.withColumn("kept", F.col("kept").cast("string"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the kept lines as texts; ``chars_col``, where there is one, is counted anew.

    All rows stay, those with null ids and null texts as they are, repeated ones each by itself; an empty table gives an empty
    table. Columns of any name are carried.
    """
    done = dedup(docs, id_col, text_col, carry=True)
    named = {id_col: F.col("id"), text_col: F.col("kept")}
    if chars_col in docs.columns:
        named[chars_col] = F.length("kept").cast(docs.schema[chars_col].dataType)
    return done.select(*[named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
