"""Byte-level BPE by overlapping chunks, and its decoding.

A text is cut into chunks that overlap; chunks are pre-tokenised and their pieces encoded on their own, and those of long texts are
dealt out. A chunk's first pieces may be wrong, as it begins anywhere, and its last ones, as they do not see what follows.
Matching has no memory beyond the place it is at: where a boundary of the piece sequence so far is also a boundary of the next
chunk, the two agree from there on. The stitching of a document therefore takes each chunk's pieces from one such place to
the next. Where an overlap has none, as within a word longer than the overlap, the text is matched on from the last sure boundary until
it meets one of a later chunk.

Decoding puts the tokens' raw bytes together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ship

#: Code points of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 2_048, 256
#: Chunks of a text that one task encodes; those of longer texts are dealt out, so many of them at a time.
DEALT = 16
#: A boundary is sure if this many more code points are in sight: the longest fixed alternative has three.
SIGHT = 3
#: Encoded pieces kept by a worker.
CACHE = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteEncoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [b"%d" % i for i in range(size)]
        self.cache: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        """The ids of one match of the pattern: alone it is one match too."""
        found = self.cache.get(text)
        if found is None:
            found = self.encoding.encode_ordinary(text)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(text) <= 64:
                self.cache[text] = found
        return found

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the matches, ids of each, all ids."""
        parts = [m[0] for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        if len(text) != (int(ends[-1]) if len(parts) else 0):  # a pattern that passes over something
            ends = np.array([m.end() for m in self.pattern.finditer(text)], np.int64)
        got = list(map(self.cache.get, parts))
        if None in got:
            got = [self.piece(p) if g is None else g for p, g in zip(parts, got, strict=True)]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return ends, counts, np.fromiter(chain.from_iterable(got), self.kind, int(counts.sum()))

    def decode(self, raw: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(raw, self.kind).tolist()))

    def decimal(self, raw: bytes) -> bytes:
        return b" ".join(map(self.names.__getitem__, np.frombuffer(raw, self.kind).tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteEncoder:
    """One for each Python worker."""
    return ByteEncoder(path, pattern)


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """``(number, start, chunk with its overlap)``; the last chunk ends with the text."""
    for k, start in enumerate(range(0, max(1, len(text)), chunk)):
        yield k, start, text[start : start + chunk + overlap]


def stitch(chunks: list[tuple], tool: ByteEncoder) -> np.ndarray:
    """The ids of a text from its chunks in order, each ``(start, text, ends, counts, ids)`` as from ``pieces``."""
    length = chunks[-1][0] + len(chunks[-1][1])
    out: list[np.ndarray] = []

    def matched_on(k: int, to: int) -> tuple[list[int], int, int]:
        """Ids from ``to`` on, up to a boundary that a later chunk has too: that place and the chunk. Looks at twice as much text until there is one."""
        span = 8
        while True:
            near = chunks[k : k + span]
            whole = k + span >= len(chunks)
            base = near[0][0]
            rest = "".join([*(t[: b[0] - a] for (a, t, *_), b in zip(near, near[1:], strict=False)), near[-1][1]])
            marks: dict[int, int] = {}  # boundaries of later chunks: the last chunk that has them
            extra: list[int] = []
            later, done = 1, to
            for m in tool.pattern.finditer(rest, to - base):
                done = base + m.end()
                if not whole and m.end() + SIGHT > len(rest):
                    break
                extra += tool.piece(m[0])
                while later < len(near) and near[later][0] <= done:
                    marks |= dict.fromkeys((near[later][2] + near[later][0]).tolist(), later) | {near[later][0]: later}
                    later += 1
                if done in marks and (done + SIGHT <= near[marks[done]][0] + len(near[marks[done]][1]) or k + marks[done] == len(chunks) - 1):
                    return extra, done, k + marks[done]
            else:
                if whole:
                    return extra, length, len(chunks) - 1
            span *= 2

    at, k = 0, 0  # all before ``at`` is done; ``at`` is a boundary of chunk k
    while at < length:
        start, text, ends, counts, ids = chunks[k]
        ends = ends + start
        places = np.concatenate([[start], ends])
        ids_before = np.concatenate([[0], np.cumsum(counts)])
        here = int(np.searchsorted(places, at))
        if start + len(text) == length:
            out.append(ids[ids_before[here] :])
            break
        sure = places[here:][places[here:] + SIGHT <= start + len(text)]
        if not len(sure):
            sure = places[here : here + 1]
        following = chunks[k + 1]
        common = np.intersect1d(sure, np.concatenate([[following[0]], following[2] + following[0]]))
        if len(common):
            to = int(common[0])
            k += 1
        else:
            to = int(sure[-1])
        out.append(ids[ids_before[here] : ids_before[int(np.searchsorted(places, to))]])
        if not len(common):
            extra, to, k = matched_on(k, to)
            out.append(np.array(extra, tool.kind))
        at = to
    return np.concatenate(out) if out else np.empty(0, tool.kind)


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _here(path: str, pattern: str, chunk: int, overlap: int):
    """Texts of few chunks: their chunks are encoded and stitched by the task that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            ids = [stitch([(start, part, *tool.pieces(part)) for _, start, part in cut(t.as_py() or "", chunk, overlap)], tool) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(ids)], ["id", "ids"])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for k, start, text in cut(batch.column(2)[i].as_py(), chunk, overlap):
                    row = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([k], pa.int32()), pa.array([start], pa.int64()), pa.array([text])], ["row", "id", "k", "start", "text"])

    return run


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            done = [tool.pieces(t.as_py()) for t in batch.column("text")]
            ends, counts, ids = ([d[n] for d in done] for n in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(ends), _binary(counts), _binary(ids)], [*batch.schema.names, "ends", "counts", "ids"])

    return run


def _stitched(path: str, pattern: str):
    def run(table: pa.Table) -> pa.Table:
        tool = encoder(path, pattern)
        table = table.sort_by("k")
        chunks = [
            (start, text, np.frombuffer(ends, np.int64), np.frombuffer(counts, np.int64), np.frombuffer(ids, tool.kind))
            for start, text, ends, counts, ids in zip(*(table.column(c).to_pylist() for c in ("start", "text", "ends", "counts", "ids")), strict=True)
        ]
        return pa.table({"id": table.column("id").slice(0, 1), "ids": pa.chunked_array([_binary([stitch(chunks, tool)])])})

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, dealt: int = DEALT) -> DataFrame:
    """``(id, ids)`` for each row: the ids, without special tokens, as little-endian numbers of 16 bits (32 for larger vocabularies).

    Every text goes through chunks and stitching. The chunks of a text of more than ``dealt`` chunks are dealt out to tasks; those of
    others stay together, as their shuffle would cost more than their encoding. A null or empty text has no ids. Rows are encoded
    one by one, so repeated rows and ids, and null ids, come out as they went in; an empty table gives an empty table. Other
    columns are not read.
    """
    ship(docs.sparkSession)
    how = (path or default_path(), pattern or default_pattern())
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk * dealt + overlap
    short_ids = own.where(~long).mapInArrow(_here(*how, chunk, overlap), f"id {kind}, ids binary")
    row = f"row bigint, id {kind}, k int, start bigint, text string"
    chunks = own.where(long).select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(_cut(chunk, overlap), row)
    coded = chunks.repartition("row", "k").mapInArrow(_encoded(*how), f"{row}, ends binary, counts binary, ids binary")
    long_ids = coded.groupBy("row").applyInArrow(_stitched(*how), f"id {kind}, ids binary")  # a document's chunks only
    return short_ids.unionByName(long_ids)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            raw = [x.as_py() for x in batch.column(1)]
            told = lambda f: [None if x is None else f(x) for x in raw]  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(told(lambda x: len(x) // tool.kind.itemsize), pa.int64()),
                    pa.array(told(lambda x: hashlib.sha256(tool.decimal(x)).hexdigest()), pa.string()),
                    pa.array(told(lambda x: hashlib.sha256(tool.decode(x)).hexdigest()), pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def digests(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of encoded rows: of the decimal ids and of the decoded bytes.

    Null ``ids`` give nulls, empty ones the digests of nothing. Every row is told by itself, null and repeated ids too; an empty table
    gives an empty table. Other columns are not read.
    """
    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(
        _digests(path or default_path(), pattern or default_pattern()), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.as_py() if not x.is_valid else tool.decode(x.as_py()) for x in batch.column(1)], pa.binary())], ["id", "bytes"])

    return run


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(id, bytes)``: the raw bytes of the tokens, put together; null for null ``ids``, empty for empty ones.

    Rows are decoded one by one, whatever repeats; an empty table gives an empty table. Other columns are not read.
    """
    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(_decoded(path or default_path(), pattern or default_pattern()), f"id {kind}, bytes binary")
