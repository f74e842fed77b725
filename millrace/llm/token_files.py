"""Token files: independent zstandard frames with a trailing seek table (the Zstandard Seekable Format, version 0.1.0).

A file is a stream of little-endian ids cut into frames of ``FRAME_BYTES``, then one frame that lists the
documents, then the seek table in a skippable frame: for each frame its compressed and decompressed size and the
low 32 bits of the XXH64 of its content. A reader loads the tail of the file, finds the frames that hold the
documents it was asked for, and decompresses and verifies only those.

Document table: magic, bytes of an id, number of documents; then for all documents the id, whether it is null, and
its number of ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.files import create, fresh_file, open_random
from millrace.llm import word_tokens
from millrace.session import ship, work_path, written

# Fixed values of the seekable format and of this file's document table.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
TABLE_MAGIC = b"MRTK"

FRAME_BYTES = 1 << 20
END_ID = 1
SUFFIX = ".ids.zst"


class TokenFileWriter:
    """Writes ids of ``width`` bytes; memory is bounded by a frame and the document table."""

    def __init__(self, out, width: int = 2, level: int = 3):
        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=level)
        self.pending = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self, raw: bytes) -> None:
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(raw) // self.width)
        self.pending += raw
        while len(self.pending) >= FRAME_BYTES:
            self._frame(bytes(self.pending[:FRAME_BYTES]))
            del self.pending[:FRAME_BYTES]

    def close(self) -> None:
        if self.pending:
            self._frame(bytes(self.pending))
        table = struct.pack("<4sIQ", TABLE_MAGIC, self.width, len(self.ids))
        table += np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array([x is None for x in self.ids], "u1").tobytes()
        self._frame(table + np.array(self.counts, "<u8").tobytes())
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class TokenFile:
    """Random access to a token file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        footer = self._at(size - 9, 9) if size >= 9 else b""
        n, flags, magic = struct.unpack("<IBI", footer) if footer else (0, 0, 0)
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG or size < 17 + 12 * n or not n:
            raise ValueError("no seek table with checksums")
        self.frames = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed_at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        self.unpack = zstandard.ZstdDecompressor()
        table = self.frame(n - 1)
        magic, self.width, docs = struct.unpack_from("<4sIQ", table)
        if magic != TABLE_MAGIC:
            raise ValueError("no document table")
        at = 16
        self.ids = np.frombuffer(table, "<i8", docs, at)
        self.null = np.frombuffer(table, "u1", docs, at + 8 * docs).astype(bool)
        self.counts = np.frombuffer(table, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        raw = self.unpack.decompress(self._at(int(self.packed_at[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """``(id, start, raw ids)`` in file order, for all documents or those with an id in ``wanted``."""
        chosen = np.arange(len(self.ids)) if wanted is None else np.flatnonzero(np.isin(self.ids, list(wanted)) & ~self.null)
        held_k, held = -1, b""
        for d in chosen.tolist():
            i, j = int(self.starts[d]) * self.width, int(self.starts[d + 1]) * self.width
            parts = []
            k = int(np.searchsorted(self.raw_at, i, side="right")) - 1
            while i < j:
                if k != held_k:
                    held_k, held = k, self.frame(k)
                base = int(self.raw_at[k])
                parts.append(held[i - base : j - base])
                i = min(j, int(self.raw_at[k + 1]))
                k += 1
            yield None if self.null[d] else int(self.ids[d]), int(self.starts[d]), b"".join(parts)


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = word_tokens.encoder(path).ids
        end = np.array([end_id], "<u2").tobytes()
        writer = name = out = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    name = fresh_file(folder, part, SUFFIX)
                    out = create(name)
                    writer = TokenFileWriter(out)
                writer.add(doc_id, encode(text.as_py() or "") + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.ids)]), pa.array([sum(writer.counts)])], ["part", "file", "docs", "ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode each text, append ``end_id`` and write token files in ascending order of the id; returns the manifest.

    Files are ordered by ``part``. Ids are whole numbers; null ids come first, rows of one id follow the order of a hash of
    their texts, by which a repeated id is spread over files too. Null and empty texts have the end id alone. An empty table gives no file. The manifest
    names the files of the attempts that counted; it is written once, so nothing encodes again.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    ordered = own.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    return written(ordered.mapInArrow(_write(folder, path or word_tokens.default_path(), end_id), "part int, file string, docs bigint, ids bigint"), "manifest")


def _read(wanted: frozenset[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_random(name) as source:
                    found: list[tuple] = []
                    size = 0
                    for doc_id, start, raw in TokenFile(source).documents(wanted):
                        found.append((doc_id, base + start, raw))
                        size += len(raw)
                        if size > 8 << 20:
                            yield _documents(found)
                            found, size = [], 0
                    if found:
                        yield _documents(found)

    return run


def _documents(found: list[tuple]) -> pa.RecordBatch:
    ids, starts, raw = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(raw, pa.binary())], ["id", "start", "ids"])


def read_token_files(spark: SparkSession, manifest: DataFrame, wanted: Iterable[int] | None = None) -> DataFrame:
    """``(id, start, ids)`` from the files: ``start`` counts the ids of all documents before, ``ids`` are 16-bit little-endian.

    With ``wanted`` only those documents' frames are decompressed; ids that no file has give no row, and null ids can't be asked for. An
    empty manifest gives an empty table; a file that is damaged or cut short raises ValueError. The driver holds a row for each file.
    """
    base, rows = 0, []
    for part in manifest.orderBy("part").collect():
        rows.append((part["file"], base))
        base += part["ids"]
    files = spark.createDataFrame(rows, "file string, base bigint")
    return files.repartition(max(1, len(rows))).mapInArrow(_read(None if wanted is None else frozenset(wanted)), "id bigint, start bigint, ids binary")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [word_tokens.ids32(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
            ["id", "start", "n_tokens", "crc"],
        )


def checksums(read: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, crc)``: the CRC-32 of a document's ids as little-endian 32-bit numbers. Row by row; an empty table gives an empty table."""
    return read.mapInArrow(_sums, "id bigint, start bigint, n_tokens bigint, crc bigint")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to token files in the shared folder and return the checksums of what the files hold."""
    spark = docs.sparkSession
    return checksums(read_token_files(spark, write_token_files(docs, work_path(spark, "token-files"), id_col, text_col)))
