"""Figures over logs of tasks, batches and requests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import ship, written


def _nth_by_counts(df: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Values at given places, which may depend on ``n``, of each group's sorted values.

    Equal values are counted first; the distinct ones are dealt by ranges of group and value. The ranges' counts, a row for
    each group and range, say in which range a place is, and only those ranges are sorted: no task holds a whole group.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = written(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("n", F.sum("_sum").over(whole)).withColumn("_base", F.sum("_sum").over(upto) - F.col("_sum"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), p.cast("bigint").alias("place")) for k, p in places.items()]))
    targets = sums.select(*by, "_part", "n", "_base", "_sum", wanted.alias("t")).where("t.place >= _base and t.place < _base + _sum")
    targets = targets.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_p"), "n", "_base", "t.name", "t.place")
    inside = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    hit = targets.select(*[c for c in targets.columns if c not in ("n", "name", "place")]).distinct()
    some = ranged.join(hit, same).select(*by, "_part", "_v", "_n", "_base")
    some = some.withColumn("_end", F.col("_base") + F.sum("_n").over(inside)).drop("_base")
    found = some.join(targets, same).where("place >= _end - _n and place < _end")
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in places])


def upper_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """A10: the sorted values' place n / 2, rounded down; 0 for fewer than two values."""
    out = _nth_by_counts(df, by, value, {name: F.floor(F.col("n") / 2)})
    return out.withColumn(name, F.when(F.col("n") < 2, F.lit(0).cast(df.schema[value].dataType)).otherwise(F.col(name)))


def floor_percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """The sorted values' place p * (n - 1), rounded down."""
    return _nth_by_counts(df, by, value, {k: F.floor(F.lit(p) * (F.col("n") - 1)) for k, p in points.items()})


def latency(df: DataFrame, ms: str, samples: str) -> DataFrame:
    """The mean of a batch, and samples a second."""
    return df.agg(F.avg(ms).alias("mean_ms"), (1000.0 * F.sum(samples) / F.sum(ms)).alias("per_second"))


def node_profile(log: DataFrame, node: str = "node", op: str = "op", ms: str = "elapsed_ms") -> DataFrame:
    """Calls, total, microseconds a call and share, largest total first."""
    sums = log.groupBy(F.col(node).alias("node"), F.col(op).alias("op")).agg(F.count("*").alias("calls"), F.sum(ms).alias("total_ms"))
    share = F.col("total_ms") / F.sum("total_ms").over(Window.partitionBy())  # a row for each node only
    return sums.select("node", "op", "calls", "total_ms", (1000 * F.col("total_ms") / F.col("calls")).alias("us_per_call"), share.alias("share")).orderBy(F.desc("total_ms"), "node")


def batcher_stats(batches: DataFrame) -> DataFrame:
    """A15 of ``(size, elapsed_ms)``."""
    return batches.agg(
        F.sum("size").alias("requests"), F.count("*").alias("batches"), F.max("size").alias("max_batch"), F.sum("elapsed_ms").alias("total_ms"), (F.sum("size") / F.count("*")).alias("avg_batch")
    )


def server_stats(log: DataFrame, status: str = "status") -> DataFrame:
    """Requests, and those that were not answered with 200."""
    return log.agg(F.count("*").alias("requests"), F.count_if(F.col(status) != 200).alias("errors"))


def task_status(tasks: DataFrame) -> DataFrame:
    """A17 of ``(kind, state)``."""
    done = F.count_if(F.col("state") == "done")
    return tasks.groupBy("kind").agg(F.count("*").alias("total"), done.alias("done"), F.count_if(F.col("state") == "running").alias("running"))


def stragglers(tasks: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Of ``(kind, id, state, elapsed_ms)``, running tasks over the threshold times the median of those done, longest first.

    A kind with fewer than two tasks done has none.
    """
    medians = upper_median(tasks.where("state = 'done'"), ["kind"], "elapsed_ms").where("n >= 2").select("kind", "median")
    late = tasks.where("state = 'running'").join(medians, "kind").where(F.col("elapsed_ms") > threshold * F.col("median"))
    return late.select("kind", "id", "elapsed_ms", "median").orderBy(F.desc("elapsed_ms"), "id")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def lost_workers(heartbeats: DataFrame, timeout_s: float, now: Column | None = None) -> DataFrame:
    """of ``(worker, ts)``, workers whose last sign is older than the timeout, at ``now`` or the log's last sign."""
    last = heartbeats.groupBy("worker").agg(F.max("ts").alias("last"))
    at = heartbeats.agg(F.max("ts")).scalar() if now is None else now
    return last.withColumn("silent_s", (_micros(at) - _micros(F.col("last"))) / 1e6).where(F.col("silent_s") > timeout_s)


def silences(heartbeats: DataFrame, timeout_s: float) -> DataFrame:
    """F2 over a log: every gap between two signs of a worker that is longer than the timeout.

    Signs are dealt by ranges of worker and time, so one chatty worker is spread over tasks; the first sign in a
    range follows the worker's last one in the ranges before, of which there is a row each.
    """
    ranged = written(heartbeats.repartitionByRange("worker", "ts").withColumn("_part", F.spark_partition_id()), "ranged")
    lasts = ranged.groupBy("worker", "_part").agg(F.max("ts").alias("_last"))
    lasts = lasts.withColumn("_before", F.lag("_last").over(Window.partitionBy("worker").orderBy("_part")))
    lasts = lasts.where(F.col("_before").isNotNull()).select(F.col("worker").alias("_w"), F.col("_part").alias("_p"), "_before")
    joined = ranged.join(lasts, F.col("worker").eqNullSafe(F.col("_w")) & (F.col("_part") == F.col("_p")), "left")
    inside = F.lag("ts").over(Window.partitionBy("_part", "worker").orderBy("ts"))
    gap = (_micros(F.col("ts")) - _micros(F.coalesce(inside, F.col("_before")))) / 1e6
    return joined.withColumn("gap_s", gap).where(F.col("gap_s") > timeout_s).select("worker", "ts", "gap_s")


def numbered(df: DataFrame, order: str, name: str = "place", by: str | None = None) -> DataFrame:
    """Rows numbered from 0 in the order of a column, within each value of ``by`` if it is given, without one task that holds them all.

    Rows are dealt by ranges; the ranges' counts, a row for each range and value, give every range its first number. Equal
    places are taken in any order. A column ``name`` of ``df`` is replaced; other names may be any.
    """
    key = F.lit(0) if by is None else F.col(f"`{by}`")
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key"), F.col(f"`{order}`").alias("order"))
    ranged = written(own.repartitionByRange("key", "order").withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("key", "part").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")
    base = written(counts.select(F.col("key").alias("of"), F.col("part").alias("p"), first.alias("base")), "bases")
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("order"))
    joined = ranged.join(base, F.col("key").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")))
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != name], (F.col("base") + inside - 1).alias(name))


def fixed_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """B1: consecutive batches of ``size`` rows, the last one shorter."""
    return numbered(df, order).withColumn("batch", F.floor(F.col("place") / size))


def dynamic_batches(requests: DataFrame, max_batch: int, delay_us: int, by: str | None = None) -> DataFrame:
    """B2, B3 replayed from a log ``(request_id, arrived_us)``: ``(queue, request_id, batch, size)``.

    The worker waits for a first request, then until ``max_batch`` are queued or the delay is over; it takes what is there in
    the order of arrival. Running takes no time here. A batch depends on the one before it, so a queue is one sequence, which one
    task reads in order and hands on batch by batch; ``by`` names a column of independent queues (servers), which run side by side.
    """
    ship(requests.sparkSession)
    most = max(1, max_batch)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queues come one after the other, in order; what is held is one batch and what is handed on next."""
        queue, number, first, waiting = None, -1, 0, []
        done: list[tuple] = []

        def handed() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*done, strict=True) if done else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["queue", "request_id", "batch", "size"])

        for part in batches:
            for q, request, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                new = number < 0 or q != queue
                if new or len(waiting) >= most or t > first + delay_us:
                    done += [(queue, r, number, len(waiting)) for r in waiting]
                    queue, number, first, waiting = q, 0 if new else number + 1, t, []
                waiting.append(request)
            if len(done) >= 10_000:
                yield handed()
                done = []
        done += [(queue, r, number, len(waiting)) for r in waiting]
        yield handed()

    queue = F.col(by).cast("string") if by else F.lit("")
    own = requests.select(queue.alias("queue"), F.col("request_id").cast("bigint").alias("request_id"), F.col("arrived_us").cast("bigint").alias("arrived_us"))
    ordered = own.repartition("queue").sortWithinPartitions("queue", "arrived_us", "request_id")
    return ordered.mapInArrow(replay, "queue string, request_id bigint, batch bigint, size bigint")


def prefix_sample(samples: DataFrame, n: int = 2000, id_col: str = "sample_id") -> DataFrame:
    """The first samples by number, the same whatever the partitioning."""
    return samples.where(F.col(id_col) < n)


def merge_counters(reports: DataFrame) -> DataFrame:
    """A7, A9 of ``(name, value, accepted)``: sums by name of the reports that were accepted."""
    return reports.where("accepted").groupBy("name").agg(F.sum("value").alias("value"))


def kway_merge(sources: list[DataFrame]) -> DataFrame:
    """The bag union of ``(key, value)`` tables in the order of key, source, value."""
    parts = [s.select("key", "value", F.lit(k).alias("source")) for k, s in enumerate(sources)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("key", "source", "value")

