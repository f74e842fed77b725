"""Map, combine, shuffle, reduce as DataFrame plans.

A declarative job is columns: what a line gives, and how a key's values are put together; Spark adds up before the
shuffle by itself. A job of Python functions has the same shape: the mapper runs over Arrow batches, the combiner
over each partition's batches, the reducer over the values of one key.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.config import JobConfig
from millrace.functions.text import atoi, partition_id
from millrace.session import ship
from millrace.sources.kvtext import list_input_files, read_lines, write_records

KeyValue = tuple[str, str]
Mapper = Callable[[str, str], Iterable[KeyValue]]
Reducer = Callable[[str, Iterator[str]], Iterable[str]]
Combiner = Callable[[str, list[str]], list[str]]

#: A combiner's buffer: pairs held before they are combined.
COMBINE_ROWS = 100_000
RECORD = "key string, value string"


def sum_values(value: Column) -> Column:
    """The sum of the values that are whole numbers; others are left out."""
    return F.coalesce(F.sum(atoi(value)), F.lit(0))


def map_columns(lines: DataFrame, key: Column, value: Column | None = None) -> DataFrame:
    """``key`` is an array; each element is a record with ``value``, or with "1"."""
    return lines.select(F.explode(key).alias("key"), (F.lit("1") if value is None else value).alias("value"))


def reduce_columns(pairs: DataFrame, value: Column) -> DataFrame:
    """A4 for one output a key, by an aggregate of ``value``; partial sums come before the shuffle."""
    return pairs.groupBy("key").agg(value.cast("string").alias("value"))


def _pairs(found: list[KeyValue]) -> pa.RecordBatch:
    keys, values = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["key", "value"])


def map_python(lines: DataFrame, mapper: Mapper) -> DataFrame:
    """``mapper(path, line)`` gives any number of pairs."""
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pairs([p for path, line in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in mapper(path, line)])

    return lines.select("path", "value").mapInArrow(run, RECORD)


def combine_python(pairs: DataFrame, combiner: Combiner, rows: int = COMBINE_ROWS) -> DataFrame:
    """Combines within a partition, each time that ``rows`` pairs are held; must not change what a reducer gives."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        n = 0
        for batch in batches:
            for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(k, []).append(v)
            n += batch.num_rows
            if n >= rows:
                held = {k: combiner(k, v) for k, v in held.items()}
                n = sum(map(len, held.values()))
                if n >= rows // 2:  # mostly distinct keys: hand them on
                    yield _pairs([(k, v) for k, vs in held.items() for v in vs])
                    held, n = {}, 0
        yield _pairs([(k, v) for k, vs in held.items() for v in combiner(k, vs)])

    return pairs.select("key", "value").mapInArrow(run, RECORD)


def reduce_python(pairs: DataFrame, reducer: Reducer, partitions: int | None = None) -> DataFrame:
    """Sorted runs of a key go to ``reducer(key, values)`` as they come, never a whole group at once.

    Pairs are dealt by key and sorted by key and value within partitions, so a task sees each of its keys as one run.
    """
    return _reduce_marked(pairs, reducer, partitions).where("n is null").select("key", "value")


def _reduce_marked(pairs: DataFrame, reducer: Reducer, partitions: int | None) -> DataFrame:
    """``(key, value, n)``: what the reducer gives, without ``n``; and a row for each key with the number of its values."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def rows() -> Iterator[KeyValue]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def marked(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["key", "value", "n"])

        out: list[tuple] = []
        for key, run_ in groupby(rows(), key=lambda p: p[0]):
            seen = 0

            def values(run_=run_) -> Iterator[str]:
                nonlocal seen
                for _, v in run_:
                    seen += 1
                    yield v

            mine = values()
            for value in reducer(key, mine):
                out.append((key, value, None))
                if len(out) >= 10_000:
                    yield marked(out)
                    out = []
            for _ in mine:  # values that the reducer left
                pass
            out.append((key, None, seen))
        yield marked(out)

    dealt = pairs.select("key", "value")
    if partitions:
        dealt = dealt.withColumn("_p", partition_id(F.col("key"), partitions)).repartitionById(partitions, F.col("_p")).drop("_p")
    else:
        dealt = dealt.repartition("key")
    return dealt.sortWithinPartitions("key", "value").mapInArrow(run, f"{RECORD}, n bigint")


@dataclass
class JobResult:
    job_id: str
    output_dir: str
    output_files: list[str]
    elapsed_s: float
    counters: dict[str, int] = field(default_factory=dict)


@dataclass
class Job:
    """E5: a whole job from a folder of text to sorted record files.

    Give either columns (``map_key``: the line's column to an array of keys; ``aggregate``: the value column to an
    aggregate) or Python functions (``mapper``, ``reducer``, and a ``combiner`` if there is one).
    """

    config: JobConfig
    map_key: Callable[[Column], Column] | None = None
    aggregate: Callable[[Column], Column] = sum_values
    mapper: Mapper | None = None
    reducer: Reducer | None = None
    combiner: Combiner | None = None

    def plan(self, lines: DataFrame) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
        """The plan, and what gives A8's counters when it has run, each observed where its rows pass; A9: those of a retried task count once.

        Rows of a job of Python functions come out in their partitions and in order.
        """
        seen: dict[str, Observation] = {}

        def watched(df: DataFrame, at: str, **counts: Column) -> DataFrame:
            seen[at] = Observation(at)
            return df.observe(seen[at], *[c.alias(n) for n, c in ({"n": F.count(F.lit(1))} | counts).items()])

        def told() -> dict[str, int]:
            got = {at: o.get for at, o in seen.items()}
            out = {"map.input_records": got["lines"]["n"], "map.emitted": got["pairs"]["n"]}
            if "combined" in got:
                out |= {"combine.in": got["pairs"]["n"], "combine.out": got["combined"]["n"], "map.output_records": got["combined"]["n"]}
            if "marked" in got:
                return out | {"reduce.keys": got["marked"]["keys"], "reduce.values": got["marked"]["held"] or 0, "reduce.emitted": got["marked"]["n"] - got["marked"]["keys"]}
            # an aggregate gives one value a key, of all the pairs
            return out | {"reduce.keys": got["reduced"]["n"], "reduce.values": got["pairs"]["n"], "reduce.emitted": got["reduced"]["n"]}

        lines = watched(lines, "lines")
        if self.map_key is not None:
            pairs = watched(map_columns(lines, self.map_key(F.col("value"))), "pairs")
            return watched(reduce_columns(pairs, self.aggregate(F.col("value"))), "reduced"), told
        if self.mapper is None or self.reducer is None:
            raise ValueError("a job needs map_key, or a mapper and a reducer")
        pairs = watched(map_python(lines, self.mapper), "pairs")
        if self.combiner is not None:
            pairs = watched(combine_python(pairs, self.combiner), "combined")
        marked = watched(_reduce_marked(pairs, self.reducer, self.config.num_reducers), "marked", keys=F.count("n"), held=F.sum("n"))
        return marked.where("n is null").select("key", "value"), told

    def run(self, spark: SparkSession) -> JobResult:
        """The reducers of a job of Python functions write what they give; an aggregate's rows are dealt to the partitions of their keys first."""
        self.config.validate()
        began = time.time()
        job_id = self.config.resolve_job_id()
        list_input_files(spark, self.config.input_dir)
        out, told = self.plan(read_lines(spark, self.config.input_dir))
        folder = f"{self.config.root}/{job_id}/out"
        write_records(out, folder, self.config.num_reducers, dealt=self.map_key is None)
        files = [f for f in list_input_files(spark, folder) if "/part-" in f]
        return JobResult(job_id, folder, files, time.time() - began, told())


def progress(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(stage, tasks done, tasks) of the running stages."""
    tracker = spark.sparkContext.statusTracker()
    infos = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    return [(i.stageId, i.numCompletedTasks, i.numTasks) for i in infos if i]
