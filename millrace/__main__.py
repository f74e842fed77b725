"""``python -m millrace``: run, eval, bench, inspect and serve models (E9), and count words (the example job)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from millrace.config import KERNELS, JobConfig, SessionConfig
from millrace.functions import arrays, text
from millrace.operators import stats
from millrace.operators.jobs import Job
from millrace.plans import graph as g
from millrace.plans import scoring
from millrace.session import local_session
from millrace.sources import models
from millrace.sources.kvtext import report
from millrace.sources.register import register_sources
from millrace.streaming import http

PROVIDER = "spark"


def settings(args: argparse.Namespace) -> SessionConfig:
    config = SessionConfig.from_file(args.config) if args.config else SessionConfig(model_path=args.model)
    config.model_path = args.model
    config.gemm_strategy = args.gemm or config.gemm_strategy
    config.intra_op_threads = args.threads or config.intra_op_threads
    config.inter_op_parallel |= args.parallel
    config.graph_optimization &= not args.no_optimize
    config.profiling |= args.profile
    config.max_batch_size = max(config.max_batch_size, args.batch)
    config.validate()
    return config


def prepared(config: SessionConfig) -> tuple[g.Model, g.OptimizationReport]:
    with open(config.model_path, "rb") as file:
        model = models.parse_model(file.read())
    g.check(model)
    on = config.graph_optimization
    return g.optimize(model, on, on, on)


def describe(model: g.Model) -> str:
    levels = model.graph.levels()
    lines = []
    for k in range(1 + max(levels.values(), default=-1)):
        own = [f"{n.name}({n.op})" for n in model.graph.nodes if levels[n.name] == k]
        lines.append(f"  level {k}{' [parallel]' if len(own) > 1 else ''}: {', '.join(own)}")
    return "\n".join(lines)


def show_profile(log) -> None:
    nodes = log.where("node is not null")
    stats.node_profile(nodes).show(truncate=False)
    whole, inside = log.where("node is null").agg(F.sum("elapsed_ms")).first()[0], nodes.agg(F.sum("elapsed_ms")).first()[0]
    print(f"Overhead: {whole - inside:.3f} of {whole:.3f} ms")


def evaluate(spark, model: g.Model, images, batch: int) -> dict[str, float]:
    samples = images.select("sample_id", arrays.normalise(arrays.pixel_array(F.col("pixels"))).alias("x"))
    right = scoring.accuracy(scoring.score(samples, model, strategy="vectorised", optimize=False), images.select(F.col("sample_id").alias("id"), "label")).first()
    log = scoring.profile(samples, model, batch)
    whole = log.where("node is null")
    points = stats.floor_percentiles(whole, [], "elapsed_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    rate = stats.latency(whole, "elapsed_ms", "samples").first()
    return right.asDict() | points.asDict() | rate.asDict() | {"log": log}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, data in (("run", "image"), ("eval", "dataset"), ("bench", "dataset"), ("inspect", None)):
        own = commands.add_parser(name)
        own.add_argument("model")
        if data:
            own.add_argument(data)
        own.add_argument("--config")
        own.add_argument("--batch", type=int, default=1)
        own.add_argument("--threads", type=int)
        own.add_argument("--gemm", choices=KERNELS)
        for flag in ("--parallel", "--no-optimize", "--profile"):
            own.add_argument(flag, action="store_true")
    commands.add_parser("serve").add_argument("config")
    job = commands.add_parser("wordcount")
    job.add_argument("input")
    job.add_argument("--work", default="work")
    job.add_argument("--reducers", type=int, default=2)
    job.add_argument("--workers", type=int, default=8)
    args = parser.parse_args(argv)
    try:
        return globals()[f"_{args.command}"](args)
    except (ValueError, OSError, TypeError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1


def _run(args) -> int:
    config = settings(args)
    model, _ = prepared(config)
    spark = local_session(1)
    image = models.read_raw_images(spark, args.image)
    samples = image.select(F.lit(0).cast("bigint").alias("sample_id"), arrays.normalise(arrays.pixel_array(F.col("pixels"))).alias("x"))
    row = scoring.score(samples, model, strategy="vectorised", optimize=False).first()
    print(f"Out: {row.logits}\nPredicted digit: {row.prediction}")
    log = scoring.profile(samples, model, 1)
    print(f"Inference latency: {log.where('node is null').first().elapsed_ms:.3f} ms")
    if config.profiling:
        show_profile(log)
    return 0


def _eval(args) -> int:
    config = settings(args)
    model, changes = prepared(config)
    spark = local_session(config.intra_op_threads if args.threads else "*")
    register_sources(spark)
    levels = list(model.graph.levels().values())
    parallel = sum(levels.count(k) > 1 for k in set(levels))
    print(f"Graph optimization: {changes}\nSchedule: {len(set(levels))} levels, {parallel} parallelizable\nProvider: {PROVIDER} | gemm: {config.gemm_strategy} | batch: {args.batch}")
    r = evaluate(spark, model, spark.read.format("imageset").load(args.dataset), args.batch)
    print(f"Samples: {r['samples']}\nCorrect: {r['correct']}\nAccuracy: {r['accuracy']:.4f}%\nLatency mean: {r['mean_ms']:.4f} ms per batch")
    print("\n".join(f"Latency {p}: {r[p]:.4f} ms" for p in ("p50", "p95", "p99")) + f"\nThroughput: {r['per_second']:.1f} inferences/sec")
    if config.profiling:
        show_profile(r["log"])
    return 0


def _bench(args) -> int:
    config = settings(args)
    spark = local_session(1)
    register_sources(spark)
    images = stats.prefix_sample(spark.read.format("imageset").load(args.dataset)).cache()
    for on in (False, True):
        config.graph_optimization = on
        model, changes = prepared(config)
        print(f"{'optimized' if on else 'unoptimized'}: {changes}")
        for batch in (1, 2, 4, 8, 16, 32, 64, 128):
            print(f"  batch {batch}: {evaluate(spark, model, images, batch)['per_second']:.1f} inferences/sec")
    return 0


def _inspect(args) -> int:
    config = settings(args)
    model, changes = prepared(config)
    print(f"Config:\n{config.to_text()}\nGraph optimization: {changes}\n\nExecution schedule:\n{describe(model)}")
    return 0


def _serve(args) -> int:
    config = SessionConfig.from_file(args.config)
    model, changes = prepared(config)
    print(f"Loaded model '{config.name}' from {config.model_path}\nGraph optimization: {changes}")
    batcher = http.Batcher(model, models.PIXELS, config.max_batch_size, config.max_queue_delay_microseconds)
    endpoint = http.server(batcher, config.http_address, config.http_port)
    print(f"Listening on http://{config.http_address}:{config.http_port}")
    try:
        endpoint.serve_forever()
    finally:
        batcher.stop()
    return 0


def _wordcount(args) -> int:
    config = JobConfig(input_dir=args.input, root=args.work, job_name="wordcount", num_reducers=args.reducers, workers=args.workers)
    spark = local_session(f"{config.workers},{config.max_attempts}", **{k.replace(".", "__"): v for k, v in config.spark_conf().items()})
    done = Job(config, map_key=text.word_tokens).run(spark)
    print(f"job {done.job_id} finished in {done.elapsed_s:.3f} s\noutput: {done.output_dir}")
    report(spark.createDataFrame(list(done.counters.items()), "name string, value bigint")).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
