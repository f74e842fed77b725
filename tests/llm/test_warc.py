import gzip
import hashlib
import io
import random

import pytest

from millrace.llm import warc
from millrace.session import work_path

SCHEMA = "page_id bigint, url string, html string, file string, offset bigint, first bigint"


def sample():
    rng = random.Random(4)
    bodies = ["x" * 99, "é" * 50, "b" * 100, "", None, "c" * 3000, "<html>" + "日本" * 50_000]
    rows = [(i, f"http://host/{i}?q=a b\r\nX: é", rng.choice(bodies)) for i in range(40, 0, -1)]
    return [*rows, (None, None, "b" * 100), (None, "u", "only null" * 20), (None, "u", "only null" * 20), (2, "again", rows[-2][2]), (50, None, "single" * 30)]


def brute(rows):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(same, default=None)
        revisit = len(payload) >= 100 and first is not None and i != first
        out.append((str(i), len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = sample()
    pages = spark.createDataFrame([(*r, "f", 7, 8) for r in rows], SCHEMA).repartition(3)
    index = warc.write_archives(pages, work_path(spark, "test"))
    got = warc.read_archives(index).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    by_digest = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    assert all((r.payload is None) == (r.record_type == "revisit") and r.payload in (None, by_digest[r.payload_digest]) for r in got)
    some = warc.read_archives(index.where("page_id in (3, 17)")).collect()
    assert sorted(r.page_id for r in some) == [3, 17]
    # the archives are plain gzip files of WARC records
    file = index.select("file").first().file.removeprefix("file://")
    text = gzip.open(file).read()
    assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC/1.1\r\n") == index.where(index.file.contains(file)).count()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranges_are_coalesced(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "READ", 100)
    rows = [("a", 0, 20), ("a", 20, 20), ("a", 45, 5), ("a", 61, 5), ("a", 70, 95), ("b", 0, 500), ("b", 500, 1)]
    assert [len(r) for r in warc.coalesced(rows)] == [3, 1, 1, 1, 1]


def test_damage_raises():
    good = warc.record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None, False)
    assert warc.parse(good)[2] == b"body"
    for bad in (good[:-1], b"x" + good, good.replace(b"\r\n\r\n", b"")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        warc._records(iter([good.replace(b"body", b"bodx")]), True)
    assert io.BytesIO(good).readline() == b"WARC/1.1\r\n"
