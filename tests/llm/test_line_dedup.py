import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup
from millrace.session import written

SCHEMA = "doc_id bigint, text string, id string, key string, n_chars bigint"


def key_of(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in key)


def brute(rows):
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(key_of(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda k: i is not None and len(k) >= 10 and len(holders[k]) > 1 and min(holders[k]) != i  # noqa: B023,E731
        stay = [x for x in lines if not gone(key_of(x))]
        out.append((str(i), len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 0) for i, t in rows], SCHEMA)


def sample():
    rng = random.Random(5)
    lines = [f"shared line number {i}" for i in range(12)] + ["short", "", "  ", "ééééééééé", "éééééééééé", "\tShared LINE number 1 ", "x" * 5000, "1234567890"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for i in range(40)]
    return [*rows, (None, "shared line number 3\nshared line number 3"), (50, None), (51, ""), (52, "\n"), (7, rows[7][1]), (53, "only here it is\nonly here it is"), (54, "x" * 200_000), (55, "x" * 200_000)]


@pytest.mark.parametrize(("run", "lines", "ranges"), [(line_dedup.RUN, line_dedup.RANGE_LINES, line_dedup.RANGES), (1, 3, 1), (10, 1000, 2)])
def test_equals_brute_force(spark, monkeypatch, run, lines, ranges):
    monkeypatch.setattr(line_dedup, "RANGE_LINES", lines)
    monkeypatch.setattr(line_dedup, "RANGES", ranges)
    rows = sample()
    docs = rows_of(spark, rows).repartition(5)
    assert sorted((str(r.id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup(docs).collect()) == brute(rows)


def test_more_lines_than_a_filter_holds_make_more_ranges(spark, monkeypatch):
    """Few lines are suspected without cause, however many there are."""
    monkeypatch.setattr(line_dedup, "RANGE_LINES", 500)
    monkeypatch.setattr(line_dedup, "RANGES", 2)
    rows = [(i, "\n".join(f"line {i} {k} of its own" for k in range(100))) for i in range(300)] + [(1000 + i, "a line that many hold\nand one more") for i in range(50)]
    docs = rows_of(spark, rows).repartition(4).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    hashes = written(docs.mapInArrow(line_dedup._hashed, f"id bigint, {line_dedup.ROWS}"), "hashes")
    assert line_dedup.ranges_for(hashes.count()) == 64 and line_dedup.filter_bits(30_000, 64) == 1 << 13
    found = line_dedup.suspects(hashes)
    assert found.where("id >= 1000").count() == 100
    assert found.where("id < 1000").count() < 0.05 * 30_000
    # what was repeated within a run was not sent on
    assert hashes.where("leads and repeated").count() <= 8


def test_filter_never_misses_a_repeat():
    rng = random.Random(1)
    bits = 1 << 13
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    seen = {}
    for _ in range(60):
        keys = [rng.randrange(300) for _ in range(10)]
        known = np.array([k % 50 == 0 for k in keys])
        line_dedup.add(once, twice, line_dedup.digests([b"%d" % k for k in keys])[:, 0].copy(), known, bits)
        for k, twofold in zip(keys, known.tolist(), strict=True):
            seen[k] = seen.get(k, 0) + 1 + twofold
    hit = lambda keys: line_dedup._get(twice, line_dedup.positions(line_dedup.digests([b"%d" % k for k in keys])[:, 0].copy(), bits)).all(axis=1)
    assert hit([k for k, n in seen.items() if n > 1]).all()
    assert hit(range(1000, 11_000)).mean() < 0.05


def test_columns_with_the_names_of_the_operators_own(spark):
    names = ["doc_id", "text", "id", "h", "g", "hs", "gs", "row", "gone", "loser", "kept", "range"]
    rows = [(i, f"a line of both\nand one of {i}", *names[2:]) for i in range(2)]
    out = line_dedup.without_repeats(spark.createDataFrame(rows, names))
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], (1, "and one of 1", *names[2:])]


def test_stage_keeps_columns_and_empty_table(spark):
    docs = rows_of(spark, [(1, "the first long line\nb"), (2, "The first long line\nc"), (3, None)])
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {r.doc_id: (r.text, r.id, r.key, r.n_chars) for r in out.collect()} == {1: ("the first long line\nb", "a", "b", 21), 2: ("c", "a", "b", 1), 3: (None, "a", "b", None)}
    assert line_dedup.dedup(rows_of(spark, [])).collect() == []
