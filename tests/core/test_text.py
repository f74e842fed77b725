import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.sources import kvtext
from millrace.sources.register import register_sources

ROOT = Path(__file__).resolve().parents[2]

ODD = ["\ttab\tboth ends\t", "two\n\nbreaks", "C:\\dir", "ends so\\", "\rfirst", "\r\n\r\n", "", "plain", "\\n", "\\\\t", "žluťoučký", "a\\\\\\\tb\x01"]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr.alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_words_follow_ascii_boundaries(spark):
    line = "don't 'tis dogs' über naïve x_y 日本語 abc1 --"
    assert column(spark, [line], text.word_tokens(F.col("v"))) == [["don't", "tis", "dogs", "ber", "naïve", "abc1"]]
    assert column(spark, [" A  b\tC ", ""], text.fields(F.col("v"))) == [["a", "b", "c"], []]
    spaces = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    assert column(spark, [f"x{c}y" for c in spaces], text.fields(F.col("v"))) == [["x", "y"]] * len(spaces)
    assert column(spark, [f"x{c}y" for c in "\u200b\x1c\u180e\ufeff"], text.fields(F.col("v"))) == [[f"x{c}y"] for c in "\u200b\x1c\u180e\ufeff"]


def test_lines(spark):
    got = column(spark, ["a\r\nb\n\n", "", "x", "\n", "a\rb\r\r\n"], text.lines(F.col("v")))
    assert got == [["a", "b", ""], [], ["x"], [""], ["a\rb\r"]]


def test_numbers(spark):
    assert column(spark, ["12", "-3", "+4", " 5", "x", "", "9" * 30, "1\n"], text.atoi(F.col("v"))) == [12, -3, 4, None, None, None, None, None]
    assert spark.range(1).select(text.thousands(F.lit(1234567))).first()[0] == "1,234,567"
    assert column(spark, ["ab"], text.record_size(F.col("v"), F.lit("cde"))) == [7]


def test_escapes_round_trip(spark):
    shown = column(spark, ODD, text.escape(F.col("v")))
    assert not any(c in s for s in shown for c in "\t\n\r")
    assert column(spark, shown, text.unescape_strict(F.col("v"))) == ODD
    assert [kvtext.unescape_text(s) for s in shown] == ODD and [kvtext.escape_text(s) for s in ODD] == shown
    assert column(spark, ["odd\\z", "last\\", "fine\\\\n"], text.is_escaped(F.col("v"))) == [False, False, True]
    with pytest.raises(PySparkException):
        column(spark, ["odd\\z"], text.unescape_strict(F.col("v")))
    for bad in ("odd\\z", "last\\"):
        with pytest.raises(ValueError):
            kvtext.unescape_text(bad)


def fnv(s):
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_hash_and_partitions(spark):
    keys = ["the", "quick", "brown", "fox", "", "\t", "ünïcödé", "日本", "a", "foobar", *map(str, range(1000))]
    got = column(spark, keys, text.fnv1a32(F.col("v")))
    assert got == [fnv(k) for k in keys] and got[8:10] == [3826002220, 3214735720]
    for n in (1, 2, 3, 7, 16):
        parts = column(spark, keys, text.partition_id(F.col("v"), n))
        assert parts == [fnv(k) % n for k in keys]
    assert set(column(spark, keys, text.partition_id(F.col("v"), 4))) == {0, 1, 2, 3}


def test_files(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    with pytest.raises(ValueError):
        kvtext.list_input_files(spark, str(folder))
    for name in "cab":
        (folder / f"{name}.txt").write_bytes(b"k\tv\r\n\n" + name.encode() + b"\tx\\ty\n")
    assert [f[-5:] for f in kvtext.list_input_files(spark, str(folder))] == ["a.txt", "b.txt", "c.txt"]
    lines = kvtext.read_lines(spark, f"{folder}/*.txt").collect()
    assert len(lines) == 9 and {r.path for r in lines} == {f"{folder}/{n}.txt" for n in "abc"} and {r.value for r in lines} >= {"k\tv", ""}
    want = sorted([("k", "v")] * 3 + [(n, "x\ty") for n in "abc"])
    assert sorted(map(tuple, kvtext.read_records(spark, f"{folder}/*.txt").collect())) == want
    register_sources(spark)
    for split in (1, 5, 1000):
        assert sorted(map(tuple, spark.read.format("kvtext").option("splitBytes", split).load(str(folder)).collect())) == want
    for bad in ("one column", "odd\\z\tvalue"):
        (folder / "z.txt").write_text(bad)
        with pytest.raises(PySparkException):
            kvtext.read_records(spark, f"{folder}/z.txt").collect()
        with pytest.raises(PySparkException):
            spark.read.format("kvtext").load(f"{folder}/z.txt").collect()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9])
def test_split_files(n):
    groups = kvtext.split_files(list("abcde"), n)
    assert sorted(sum(groups, [])) == list("abcde") and all(groups) and len(groups) == min(n, 5)


def test_write_and_verify(spark, tmp_path):
    records = spark.createDataFrame([(k, str(i)) for i, k in enumerate([*ODD, *ODD])], "key string, value string")
    kvtext.write_records(records, str(tmp_path / "out"), 3)
    back = kvtext.read_records(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, records.collect()))
    parts = kvtext.read_lines(spark, str(tmp_path / "out")).select(F.substring_index("value", "\t", 1).alias("key"), F.col("path").alias("part"))
    assert kvtext.misplaced_keys(parts).count() == 0
    register_sources(spark)
    back = lambda: sorted(map(tuple, spark.read.format("kvtext").load(str(tmp_path / "ds")).collect()))
    records.repartition(8).write.format("kvtext").mode("append").save(str(tmp_path / "ds"))
    assert back() == sorted(map(tuple, records.collect()))
    more = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "key string, value string").repartition(3)
    more.write.format("kvtext").mode("append").save(f"file://{tmp_path}/ds")
    assert back() == sorted([*map(tuple, records.collect()), ("x", "1"), ("y", "2"), ("z", "3")])
    more.write.format("kvtext").mode("overwrite").save(str(tmp_path / "ds"))
    assert back() == [("x", "1"), ("y", "2"), ("z", "3")]
    kvtext.write_records(more, str(tmp_path / "few"), 16)
    files = [f for f in kvtext.list_input_files(spark, str(tmp_path / "few")) if "/part-" in f]
    assert len(files) == 16 and kvtext.read_records(spark, str(tmp_path / "few")).count() == 3
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "key string, value int")
    e = spark.createDataFrame([("x", 1), ("y", 5), ("w", 4)], "key string, value int")
    assert sorted(tuple(r) for r in kvtext.compare(a, e).collect()) == [("w", None, 4, "missing"), ("y", 2, 5, "mismatch"), ("z", 3, None, "extra")]
    (tmp_path / "labels.txt").write_text("a.png 3\nb.png 7\n")
    assert [tuple(r) for r in kvtext.read_label_list(spark, str(tmp_path / "labels.txt")).collect()] == [("a.png", 3), ("b.png", 7)]


def test_long_lines_raise(spark, tmp_path):
    (tmp_path / "in.txt").write_text("short\n" + "x" * 99 + "\n")
    assert kvtext.read_lines(spark, str(tmp_path / "in.txt"), 100).count() == 2
    assert [len(r.value) for r in kvtext.read_lines(spark, str(tmp_path / "in.txt"), 100).collect()] == [5, 99]
    with pytest.raises(PySparkException):
        kvtext.read_lines(spark, str(tmp_path / "in.txt"), 99).collect()


def test_key_sets(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 2)], "key string, value int")
    e = spark.createDataFrame([("x", 1), ("w", 5), ("v", 4)], "key string, value int")
    assert {r.kind: r.n for r in kvtext.key_sets(a, e).collect()} == {"missing": 2, "extra": 1, "common": 1}


def test_sources_run_where_the_package_is_not_installed(tmp_path):
    """The processes that plan and run them find no millrace by themselves."""
    (tmp_path / "in.txt").write_text("k\tv\n")
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from millrace.session import local_session
from millrace.sources.register import register_sources
spark = local_session(1)
register_sources(spark)
assert [tuple(r) for r in spark.read.format("kvtext").load({str(tmp_path / "in.txt")!r}).collect()] == [("k", "v")]
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert not done.returncode, done.stderr[-2000:]


def test_corpus_is_a_function_of_its_seed(spark):
    make = lambda s: [r.value for r in kvtext.corpus(spark, ["a", "b", "c"], 50, 6, s).orderBy("id").collect()]
    assert make(7) == make(7) != make(8) and all(len(x.split()) == 6 for x in make(7))
