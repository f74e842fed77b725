"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Lengths are whole numbers up to the sequence length, so a histogram of them, of a bounded size, is all that the
packing has to know (as in Krell et al. 2021). The driver packs the histogram: a bin is filled greedily with
the longest piece that fits, then its smallest piece is replaced with two unpacked ones if they fill the gap
that it leaves more tightly (Friesen and Langston 1991). The same bin is made as often as the counts allow, so the
work depends on the sequence length and not on the data. The pieces of a length are numbered on the cluster
and the k-th of them takes the k-th place that the plan has for its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import word_tokens
from millrace.session import ship, written

SEQUENCE = 2048
END_ID = 0
#: Pieces of one length are numbered in so many groups at least, and in groups of about this many rows.
GROUPS, GROUP_ROWS = 64, 1_000_000


def two_fit(counts: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two lengths, longest sum first, that are in stock and together at most ``room`` but more than ``least``."""
    stock = np.flatnonzero(counts[: room + 1])
    if not len(stock):
        return None
    partner = np.searchsorted(stock, room - stock, side="right") - 1  # the longest that fits beside each
    alone = (partner >= 0) & (stock[partner] == stock) & (counts[stock] < 2)
    partner = np.where(alone, partner - 1, partner)
    sums = np.where(partner >= 0, stock + stock[partner], -1)
    best = int(sums.argmax())
    if sums[best] <= least:
        return None
    return int(max(stock[best], stock[partner[best]])), int(min(stock[best], stock[partner[best]]))


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Bins ``(lengths, times)`` that use up ``counts[length]`` pieces of each length up to ``len(counts) - 1``."""
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out = []
    while (stock := np.flatnonzero(left)).size:
        first = int(stock[-1])
        lengths, gap = [first], size - first
        left[first] -= 1
        while gap:
            k = int(np.searchsorted(stock, gap, side="right"))
            while k and not left[stock[k - 1]]:
                k -= 1
            if not k:
                break
            length = int(stock[k - 1])
            lengths.append(length)
            left[length] -= 1
            gap -= length
        if gap and len(lengths) > 1:
            smallest = lengths[-1]  # they were taken longest first
            pair = two_fit(left, gap + smallest, smallest)
            if pair:
                lengths[-1:] = pair
                left[smallest] += 1
                left[list(pair)] -= 1 if pair[0] != pair[1] else 0
                if pair[0] == pair[1]:
                    left[pair[0]] -= 2
        used, times = np.unique(lengths, return_counts=True)
        more = int((left[used] // times).min())
        left[used] -= more * times
        out.append((lengths, more + 1))
    return out


def slots(bins: list[tuple[list[int], int]], size: int) -> dict[str, np.ndarray]:
    """Places by length: ``at[length]`` to ``at[length + 1]`` are its runs; a run's ``first`` place number, sequence and offset."""
    runs = []
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for length in lengths:
            runs.append((length, sequence, offset, times))
            offset += length
        sequence += times
    table = np.array(runs, np.int64).reshape(-1, 4)
    table = table[np.argsort(table[:, 0], kind="stable")]
    at = np.searchsorted(table[:, 0], np.arange(size + 2))
    total = np.concatenate([[0], np.cumsum(table[:, 3])])
    first = total[:-1] - total[at[table[:, 0]]] if len(table) else total[:-1]
    return {"at": at, "first": first, "sequence": table[:, 1], "offset": table[:, 2]}


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens.encoder(path).ids
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = word_tokens.ids32(encode(text.as_py() or ""), END_ID)
                for k in range(0, len(ids), size):
                    part = ids[k : k + size]
                    rows.append(i)
                    piece.append(k // size)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["id", "piece", "start", "length", "crc"],
            )

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Each document's ids with the end id, cut into pieces of at most ``size``: ``(id, piece, start, length, crc)``."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_pieces(path or word_tokens.default_path(), size), f"id {kind}, piece int, start bigint, length bigint, crc bigint")


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            # the last run of the length that begins at or before the rank
            big = int(max(t["first"].max(initial=0), rank.max(initial=0))) + 1
            of = np.repeat(np.arange(len(t["at"]) - 1), np.diff(t["at"]))
            at = np.searchsorted(of * big + t["first"], length * big + rank, side="right") - 1
            own = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(t["sequence"][at] + rank - t["first"][at]), pa.array(t["offset"][at])], [*own, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """``(id, piece, start, length, crc, sequence_id, offset)`` for each piece of each row of ``docs``.

    Null and empty texts are one piece of the end id alone. Repeated rows and ids are packed as often as they come,
    rows with a null id like any other. Pieces of one length are alike, so ties between them are broken by a
    hash of id, piece and place in the table of pieces. An empty table gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, path, size), "pieces")
    sizes = cut.groupBy("length").count().collect()  # at most ``size`` rows
    counts = np.zeros(size + 1, np.int64)
    for length, n in sizes:
        counts[length] = n
    shared = spark.sparkContext.broadcast(slots(plan(counts), size))  # a few places for each length
    groups = max(GROUPS, int(counts.sum()) // GROUP_ROWS)
    # by its place in the written table too, so that rows that are alike are spread
    own = F.xxhash64("id", "piece", "start", "crc", "_metadata.file_name", "_metadata.row_index")
    dealt = cut.withColumn("grp", F.pmod(own, F.lit(groups)).cast("int"))
    # the groups' first numbers: a window over groups of one length, never over its rows
    before = dealt.groupBy("length", "grp").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("grp")
    before = before.select(F.col("length").alias("l"), F.col("grp").alias("g"), (F.sum("n").over(order) - F.col("n")).alias("base"))
    before = written(before, "bases")
    inside = Window.partitionBy("length", "grp").orderBy("id", "piece", "crc")
    ranked = dealt.withColumn("k", F.row_number().over(inside) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("l")) & (F.col("grp") == F.col("g")))
    ranked = ranked.select("id", "piece", "start", "length", "crc", (F.col("k") + F.col("base")).cast("bigint").alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(_placed(shared), f"id {kind}, piece int, start bigint, length bigint, crc bigint, sequence_id bigint, offset bigint")
