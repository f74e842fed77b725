"""Streams: scoring of requests as they come, and batching by count and delay (B2-B4, S16's stand-in)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.plans import graph as g
from millrace.plans.scoring import score
from millrace.session import ship
from millrace.sources.models import decode_body

REQUESTS = "request_id bigint, body binary"


def requests(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of request files ``(request_id, body)`` in Parquet."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def answer(batch: DataFrame, model: g.Model, features: int, strategy: str = "auto") -> DataFrame:
    """``(request_id, status, logits, prediction)``: 400 for bodies that can't be decoded; B3: the request's id goes along."""
    decoded = batch.select("request_id", decode_body(F.col("body"), features).alias("x"))
    scored = score(decoded.where(F.col("x").isNotNull()), model, "request_id", "x", strategy).withColumnRenamed("id", "request_id")
    good = scored.select("request_id", F.lit(200).alias("status"), "logits", "prediction")
    bad = decoded.where(F.col("x").isNull()).select("request_id", F.lit(400).alias("status"), F.lit(None).cast("array<double>").alias("logits"), F.lit(None).cast("int").alias("prediction"))
    return good.unionByName(bad)


def serve(stream: DataFrame, model: g.Model, features: int, sink: Callable[[DataFrame, int], None], checkpoint: str, delay_ms: int | None = None) -> StreamingQuery:
    """Each micro-batch is scored with the plan that scores tables and handed to ``sink(answers, batch)``.

    With ``delay_ms`` a trigger comes that often; without, the query takes what is there and ends (B4).
    """
    trigger = {"availableNow": True} if delay_ms is None else {"processingTime": f"{delay_ms} milliseconds"}
    out = stream.writeStream.foreachBatch(lambda batch, n: sink(answer(batch, model, features), n))
    return out.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def batched(stream: DataFrame, max_batch: int, delay_ms: int, queue: str = "queue") -> DataFrame:
    """B2 as a keyed state: ``(queue, batch, request_ids)`` once ``max_batch`` requests wait or the delay is over.

    ``stream`` has ``request_id`` and the column of independent queues. A queue's state is at most a batch.
    """
    ship(stream.sparkSession)

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, waiting = state.get if state.exists else (0, [])
        waiting, out = list(waiting), []
        if state.hasTimedOut:
            out, waiting = [waiting] if waiting else [], []
        else:
            for chunk in chunks:
                waiting += sorted(chunk["request_id"].tolist())
            while len(waiting) >= max_batch:
                out.append(waiting[:max_batch])
                waiting = waiting[max_batch:]
        state.update((number + len(out), waiting))
        if waiting:
            state.setTimeoutDuration(max(1, delay_ms))
        if out:
            yield pd.DataFrame({"queue": [key[0]] * len(out), "batch": range(number, number + len(out)), "request_ids": out})

    own = stream.select(F.col(queue).cast("string").alias("queue"), "request_id")
    return own.groupBy("queue").applyInPandasWithState(
        step, "queue string, batch bigint, request_ids array<bigint>", "number bigint, waiting array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def word_counts(stream: DataFrame) -> DataFrame:
    """A running word count of a stream of ``value`` lines: the plan of the table, kept up to date."""
    from millrace.functions.text import word_tokens

    return stream.select(F.explode(word_tokens(F.col("value"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
