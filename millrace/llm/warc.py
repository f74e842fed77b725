"""WARC archives with an index: offset, length, URL and digest of each record, written before anything reads the archives.

Tasks write one archive each, a gzip member per record, and hand over the index rows; the index, as a table, names
only the files of the attempts that counted. Readers share the selected index rows by the bytes that they name, sort them by file and offset, join neighbouring
byte ranges into one read up to a bound, and take the records out of what they have read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.files import create, fresh_file, open_random
from millrace.session import ship, work_path, written

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads shorter than this are always written whole.
MIN_REVISIT = 100
#: Ranges of one file no further apart than GAP are read at once, up to READ bytes.
GAP, READ = 64 << 10, 8 << 20
#: Reading tasks share files by stretches of SPLIT bytes and take about TASK_BYTES each, or less if there would be too few tasks for the cores.
SPLIT, TASK_BYTES, TASKS_A_CORE = 1 << 20, 64 << 20, 4
DATE = "1970-01-01T00:00:00Z"
SUFFIX = ".warc.gz"


def record_id(page_id: int | None, digest: str) -> str:
    """Named by page and payload, so an attempt that is run again writes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One uncompressed record. A revisit has the HTTP header only; its Content-Length there is the whole payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    if page_id is not None:
        head.append(("Millrace-Page-Id", str(page_id)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Millrace-Refers-To-Page", str(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return f"{VERSION}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, the HTTP message's fields and its body. Raises ValueError for what isn't one whole record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, body = rest[:n].partition(b"\r\n\r\n")
    inner = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return fields, inner, body


INDEX = "page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint, file string, offset bigint, length bigint"


def _write(folder: str):
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        at = 0
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if out is None:
                    name = fresh_file(folder, TaskContext.get().partitionId(), SUFFIX)
                    out = create(name)
                payload = html.as_py() or b""
                digest = hashlib.sha256(payload).hexdigest()
                revisit = first is not None and page_id != first
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = pack.compress(record(page_id, url, payload, digest, first, revisit)) + pack.flush()
                out.write(packed)
                rows.append((page_id, url, digest, len(payload), "revisit" if revisit else "response", first if revisit else None, name, at, len(packed)))
                at += len(packed)
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of ``pages``; returns the index, a written table.

    Of the rows with equal payloads of MIN_REVISIT bytes or more, that with the smallest id is a response (all of them, if
    several rows have that id) and the others revisit it; all else are responses. A null html is an empty payload, a
    null URL leaves its field out. Rows with a null id revisit like any other; if all rows of a payload have a null id,
    all are responses. Ids are whole numbers. An empty table gives an empty index and no file. Other columns are not read.
    """
    ship(pages.sparkSession)
    own = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("binary").alias("html"))
    some = own.where(F.length("html") >= MIN_REVISIT)
    firsts = some.groupBy(F.unhex(F.sha2("html", 256)).alias("payload")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    firsts = written(firsts.select("payload", "first"), "repeated-payloads")
    digest = F.when(F.length("html") >= MIN_REVISIT, F.unhex(F.sha2("html", 256)))
    ruled = own.join(firsts, digest == F.col("payload"), "left").select("page_id", "url", "html", "first")
    return written(ruled.mapInArrow(_write(folder), INDEX), "warc-index")


def _take(rows: list[tuple[int, int]], read: bytes, base: int) -> Iterator[bytes]:
    for offset, length in rows:
        yield zlib.decompress(read[offset - base : offset - base + length], 31)


def coalesced(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of sorted ``(file, offset, length)`` that one read serves."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > GAP or row[1] + row[2] - run[0][1] > READ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


RECORDS = "page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint, payload binary"


def _records(raws: Iterator[bytes], with_payload: bool) -> pa.RecordBatch:
    rows = []
    for raw in raws:
        fields, http, body = parse(raw)
        revisit = fields["warc-type"] == "revisit"
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if not revisit and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"a payload does not match its digest: {fields['warc-record-id']}")
        page, refers = (fields.get(k) for k in ("millrace-page-id", "millrace-refers-to-page"))
        rows.append(
            (int(page) if page else None, fields.get("warc-target-uri"), digest, int(http["content-length"]) if revisit else len(body), fields["warc-type"], int(refers) if refers else None, body if with_payload and not revisit else None)
        )
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source = None, None
        try:
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                for part in coalesced(rows):
                    if part[0][0] != held:
                        if source is not None:
                            source.close()
                        held, source = part[0][0], open_random(part[0][0])
                    base, end = part[0][1], part[-1][1] + part[-1][2]
                    source.seek(base)
                    yield _records(_take([(o, n) for _, o, n in part], source.read(end - base), base), with_payload)
        finally:
            if source is not None:
                source.close()

    return run


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name: page, URL (percent-encoded), digest, payload size, type, referred page, payload.

    Rows are dealt by file and stretch of SPLIT bytes, so by the bytes that are to be read and not by the size of index rows, and
    sorted, so that a task reads its files forwards. Payloads are verified; a revisit's is null, its digest and size are those of
    the whole payload. Rows named twice come twice, other columns are not read, an empty index gives an empty table.
    """
    own = index.select("file", "offset", "length", F.floor(F.col("offset") / SPLIT).alias("stretch"))
    sums = own.groupBy("file", "stretch").agg(F.sum("length").alias("bytes")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = min(sums["n"], max(TASKS_A_CORE * index.sparkSession.sparkContext.defaultParallelism, (sums["bytes"] or 0) // TASK_BYTES))
    ordered = own.repartition(max(1, tasks), "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return ordered.mapInArrow(_read(with_payload), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read all records back."""
    return read_archives(write_archives(pages, work_path(pages.sparkSession, "warc")), with_payload=False)
