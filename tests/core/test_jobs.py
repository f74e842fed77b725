from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.config import JobConfig, SessionConfig
from millrace.functions import text
from millrace.operators import jobs, stats

VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta".split()


def write_inputs(folder, files, lines):
    folder.mkdir()
    counts = Counter()
    for f in range(files):
        rows = []
        for k in range(lines):
            words = [VOCABULARY[(f * 7 + k * 3 + w) % 8] for w in range(6)]
            counts.update(words)
            rows.append(" ".join(words))
        (folder / f"in-{f}.txt").write_text("\n".join(rows) + "\n")
    return counts


def words(path, line):
    return [(w, "1") for w in line.split()]


def total(key, values):
    return [str(sum(map(int, values)))]


def result(spark, job_result):
    from millrace.sources.kvtext import read_records

    return {r.key: int(r.value) for r in read_records(spark, job_result.output_dir).collect()}


@pytest.mark.parametrize(("reducers", "combine"), [(1, True), (3, False), (5, True)])
def test_python_job_equals_counts(spark, tmp_path, reducers, combine):
    want = write_inputs(tmp_path / "in", 4, 40)
    config = JobConfig(input_dir=str(tmp_path / "in"), root=str(tmp_path / "work"), num_reducers=reducers)
    done = jobs.Job(config, mapper=words, reducer=total, combiner=(lambda k, v: total(k, v)) if combine else None).run(spark)
    assert result(spark, done) == want
    assert done.counters["map.input_records"] == 160 and done.counters["map.emitted"] == 960 and done.counters["reduce.emitted"] == 8
    assert done.counters["reduce.keys"] == 8
    if combine:
        assert done.counters["map.output_records"] < 960 == done.counters["combine.in"]
        assert done.counters["combine.out"] == done.counters["map.output_records"] == done.counters["reduce.values"]
    else:
        assert done.counters["reduce.values"] == 960 and "combine.in" not in done.counters
    assert len(done.output_files) == reducers
    keys = [[line.split("\t")[0] for line in open(f)] for f in done.output_files]
    assert all(k == sorted(k) for k in keys) and len(set(sum(keys, []))) == len(sum(keys, []))


def test_counters_of_reducers_that_skip_and_stop(spark, tmp_path):
    """Keys that give nothing and values that are not read count too."""
    want = write_inputs(tmp_path / "in", 2, 30)
    config = JobConfig(input_dir=str(tmp_path / "in"), root=str(tmp_path / "work"), num_reducers=6)
    first = lambda key, values: [next(values)] if key > "d" else []
    done = jobs.Job(config, mapper=words, reducer=first).run(spark)
    assert done.counters == {"map.input_records": 60, "map.emitted": 360, "reduce.keys": 8, "reduce.values": 360, "reduce.emitted": sum(w > "d" for w in want)}
    assert len(done.output_files) == 6


def test_python_job_shuffles_once(spark, tmp_path):
    write_inputs(tmp_path / "in", 2, 5)
    out, _ = jobs.Job(JobConfig(input_dir=str(tmp_path / "in"), num_reducers=3), mapper=words, reducer=total).plan(jobs.read_lines(spark, str(tmp_path / "in")))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_counters_equal_the_query(spark, sf, tmp_path):
    from millrace.plans import queries

    queries.document_lines(spark, sf).select("value").write.text(str(tmp_path / "in"))
    done = jobs.Job(JobConfig(input_dir=str(tmp_path / "in"), root=str(tmp_path / "work")), map_key=text.word_tokens).run(spark)
    assert done.counters == {r.name: r.value for r in queries.job_counters(spark, sf).collect()}


def test_declarative_job(spark, tmp_path):
    want = write_inputs(tmp_path / "in", 3, 30)
    config = JobConfig(input_dir=str(tmp_path / "in"), root=str(tmp_path / "work"))
    done = jobs.Job(config, map_key=text.word_tokens).run(spark)
    assert result(spark, done) == want
    assert done.counters == {"map.input_records": 90, "map.emitted": 540, "reduce.keys": 8, "reduce.values": 540, "reduce.emitted": 8}
    with pytest.raises(ValueError):
        jobs.Job(config).run(spark)


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_combiner_buffer_size_changes_nothing(spark, rows):
    pairs = spark.createDataFrame([(f"k{i % 17}", "1") for i in range(400)], "key string, value string").repartition(3)
    combined = jobs.combine_python(pairs, total, rows)
    got = {r.key: r.value for r in jobs.reduce_python(combined, total).collect()}
    assert got == {f"k{k}": str(len(range(k, 400, 17))) for k in range(17)}


def test_reducer_reads_lazily_and_emits_any_number(spark):
    pairs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "x")], "key string, value string")
    first_only = lambda key, values: [] if key == "c" else [next(values), "more"]
    got = sorted(map(tuple, jobs.reduce_python(pairs, first_only, 2).collect()))
    assert got == [("a", "1"), ("a", "more"), ("b", "3"), ("b", "more")]
    summed = pairs.groupBy().agg(jobs.sum_values(F.col("value")).alias("s")).first().s
    assert summed == 6


@pytest.mark.parametrize("change", [{"input_dir": ""}, {"mode": "x"}, {"num_mappers": 0}, {"num_reducers": 0}, {"spill_bytes": 1023}, {"max_attempts": 0}, {"backup_threshold": 0.9}, {"workers": 0}, {"worker_timeout_s": 0.5}])
def test_job_config_rejects(change):
    JobConfig(input_dir="in").validate()
    JobConfig(mode="worker").validate()
    for mode in ("local", "worker", "coordinator", "cluster"):
        if mode != "worker" or not change.keys() & {"input_dir", "num_mappers", "num_reducers"}:
            with pytest.raises(ValueError):
                JobConfig(**{"input_dir": "in", "mode": mode} | change).validate()


def test_input_that_is_no_folder_is_rejected(tmp_path):
    (tmp_path / "x").write_text("")
    with pytest.raises(ValueError):
        JobConfig(input_dir=str(tmp_path / "x")).validate()


def test_job_config_maps_to_spark():
    config = JobConfig(input_dir="in", workers=3)
    assert config.master() == "local[3,4]" and config.spark_conf()["spark.speculation.multiplier"] == "1.5"
    assert JobConfig(job_name="wc").resolve_job_id().startswith("wc-20")


def test_session_config():
    config = SessionConfig.parse('# c\nname: "x: y"\nmodel_path: m.bin # here\nmax_batch_size: 32\nprofiling: yes\n\n')
    assert (config.name, config.model_path, config.max_batch_size, config.profiling) == ("x: y", "m.bin", 32, True)
    assert SessionConfig.parse(config.to_text()) == SessionConfig.parse(config.to_text())
    for bad in ("name: x", "model_path: m\nno colon", "model_path: m\nwhat: 1", "model_path: m\nmax_batch_size: 0", "model_path: m\nmax_batch_size: 4097", "model_path: m\nprofiling: maybe",
                "model_path: m\nhttp_port: 65536", "model_path: m\ngemm_strategy: fast", "model_path: m\nexecution_provider: gpu", "model_path: m\nintra_op_threads: -1", "model_path: m\nintra_op_threads: 257"):
        with pytest.raises(ValueError):
            SessionConfig.parse(bad)


def test_medians_and_percentiles(spark):
    rows = [("a", float(v)) for v in [5, 1, 3, 3]] + [("b", 9.0), (None, 1.0), (None, 4.0), ("a", None)] + [("h", float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    assert {r.k: r.median for r in stats.upper_median(df, ["k"], "v").collect()} == {"a": 3.0, "b": 0.0, None: 4.0, "h": 1.0}
    got = {r.k: (r.p0, r.p50, r.p99) for r in stats.floor_percentiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (1.0, 3.0, 3.0), "b": (9.0,) * 3, None: (1.0,) * 3, "h": (0.0, 1.0, 2.0)}


def test_stragglers_and_lost_workers(spark):
    tasks = spark.createDataFrame([("map", 0, "done", 5.0), ("map", 1, "done", 5.0), ("map", 2, "running", 7.6), ("map", 3, "running", 7.4), ("reduce", 4, "done", 1.0), ("reduce", 5, "running", 99.0)], "kind string, id int, state string, elapsed_ms double")
    assert [r.id for r in stats.stragglers(tasks).collect()] == [2]
    beats = spark.createDataFrame([("w", 0), ("w", 10), ("v", 2), ("v", 3)], "worker string, s int").select("worker", F.timestamp_seconds("s").alias("ts"))
    assert [r.worker for r in stats.lost_workers(beats, 5).collect()] == ["v"]
    assert [(r.worker, r.gap_s) for r in stats.silences(beats, 5).collect()] == [("w", 10.0)]


def test_batches(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = sorted((r.k, r.batch) for r in stats.fixed_batches(df, "k", 32).collect())
    assert got == [(k, k // 32) for k in range(100)]
    odd = spark.createDataFrame([(f"k{i % 3}", i // 2, "p", "b") for i in range(60)], "key string, order int, part string, base string").repartition(5)
    for by, size in ((None, 60), ("key", 20)):
        got = stats.numbered(odd, "order", by=by)
        assert got.columns == [*odd.columns, "place"]
        groups = {}
        for r in got.collect():
            groups.setdefault(r.key if by else 0, []).append((r.place, r.order))
        assert all([p for p, _ in sorted(g)] == list(range(size)) and [o for _, o in sorted(g)] == sorted(o for _, o in g) for g in groups.values())
    log = spark.createDataFrame([(i, t) for i, t in enumerate([0, 10, 20, 30, 3000, 3000, 9000])], "request_id bigint, arrived_us bigint")
    runs = [r.batch for r in sorted(stats.dynamic_batches(log, 3, 2000).collect(), key=lambda r: r.request_id)]
    assert runs == [0, 0, 0, 1, 2, 2, 3]
    queues = spark.createDataFrame([(i, 10 * i, None if i % 3 == 2 else f"q{i % 3}") for i in range(30)], "request_id bigint, arrived_us bigint, server string")
    by_queue = stats.dynamic_batches(queues, 4, 1000, "server").collect()
    assert sorted((r.queue or "", r.batch, r.size) for r in by_queue) == sorted((q, k // 4, 4 if k < 8 else 2) for q in ("q0", "q1", "") for k in range(10))
    assert stats.dynamic_batches(queues.where("false"), 4, 1000).collect() == []
    at_once = [r.batch for r in sorted(stats.dynamic_batches(log, 8, 0).collect(), key=lambda r: r.request_id)]
    assert at_once == [0, 1, 2, 3, 4, 4, 5]


def test_merge_and_counters(spark):
    s = lambda rows: spark.createDataFrame(rows, "key string, value string")
    merged = stats.kway_merge([s([("apple", "1"), ("cherry", "1"), ("elder", "1")]), s([("banana", "1"), ("date", "1")]), s([("apple", "2"), ("fig", "1")]), s([])]).collect()
    assert [r.key for r in merged] == ["apple", "apple", "banana", "cherry", "date", "elder", "fig"]
    reports = spark.createDataFrame([("records", 10, True)] * 4 + [("records", 10, False)], "name string, value bigint, accepted boolean")
    assert [tuple(r) for r in stats.merge_counters(reports).collect()] == [("records", 40)]
