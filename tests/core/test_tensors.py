import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import arrays
from millrace.plans import fixtures, scoring
from millrace.plans import graph as g
from millrace.sources import models
from millrace.sources.register import register_sources
from millrace.streaming import scoring as streams

X6 = [[1, 0, -1, 0.5, 2, -0.25], [0, 3, 1.5, -2, 0.25, 1], [-1, -1, 0, 0, 1, 1]]


def samples(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "sample_id bigint, x array<float>")


def logits(df):
    return [r.logits for r in sorted(df.collect(), key=lambda r: r.id)]


@pytest.mark.parametrize("strategy", ["native", "relational", "vectorised", "auto"])
@pytest.mark.parametrize("optimize", [True, False])
def test_strategies_agree_with_the_fixtures(spark, strategy, optimize):
    got = logits(scoring.score(samples(spark, X6), fixtures.linear(6, 4), strategy=strategy, optimize=optimize))
    assert got == [pytest.approx(x, abs=1e-4) for x in ([0.185, 0.2525, 0.2875, 0.355], [0.2225, 0.335, 0.1875, 0.3], [0.29] * 4)]
    got = logits(scoring.score(samples(spark, [[0.5, -1, 2, 0.25], [1.5, 0, -0.75, 3]]), fixtures.branching(), strategy=strategy, optimize=optimize))
    assert got == [pytest.approx(x, abs=1e-4) for x in ([1.1245, 0.7025, 0.0305], [1.1525, 0.7385, 0.0745])]


def test_strategies_agree_on_random_layers(spark):
    rng = np.random.default_rng(5)
    model = fixtures.branching(19, 33, 7)
    rows = rng.uniform(-1, 1, (23, 19)).tolist()
    want = scoring.run_batch(model, np.array(rows, np.float32))
    for strategy in scoring.STRATEGIES:
        assert np.abs(np.array(logits(scoring.score(samples(spark, rows), model, strategy=strategy))) - want).max() < 1e-3
    one_by_one = np.concatenate([scoring.run_batch(model, np.array([r], np.float32)) for r in rows])
    assert np.abs(one_by_one - want).max() < 1e-4


def test_gemm_arrow_equals_sql_at_the_edge_of_its_rounding(spark, tmp_path):
    """Vectors whose first output is just below the half of a whole hundredth, or just at it: 32 bits can't tell them apart."""
    import duckdb

    import __spark_entry__

    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (400, 64)).astype(np.float32)
    w = np.array([((k * 3) % 13 - 6) / 8 for k in range(64)])
    for row in x:
        for k in (1, 3, 0):  # the last of them has the smallest step
            rest = 0.5 * float(row.astype(float) @ w) - 0.5 * float(row[k]) * w[k]
            goal = (np.floor(100 * (rest + 0.5 * float(row[k]) * w[k])) + 0.5) / 100
            row[k] = (goal - rest) / (0.5 * w[k])
    table = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    table.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {i: list(y) for i, y in con.execute(__spark_entry__.oracle_sql()["gemm_arrow"]).fetchall()}
    assert {r.sample_id: r.y for r in __spark_entry__.queries()["gemm_arrow"](spark, str(tmp_path)).collect()} == want


def test_weights_are_widened_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(-1, 1, (5, 7)), rng.uniform(-1, 1, (7, 11)).astype(np.float32)
    for size in (1, 21, 1 << 20):
        monkeypatch.setattr(g, "WIDENED", size)
        assert np.abs(g.gemm(a, b) - a @ b.astype(float)).max() < 1e-15


def test_operators(spark):
    assert g.gemm(np.array([[1.0, 2], [3, 4]]), np.array([[5.0, 6], [7, 8]]), np.array([1.0, 1])).tolist() == [[20, 23], [44, 51]]
    assert g.gemm(np.array([[1.0, 2]]), np.array([[1.0, 0], [0, 1], [1, 1]]), np.zeros(3), trans_b=1).tolist() == [[1, 2, 3]]
    assert g.relu(np.array([-1, 0, 2, -3.5, np.nan])).tolist() == [0, 0, 2, 0, 0]
    for bad in (lambda: g.gemm(np.ones((2, 3)), np.ones((4, 5))), lambda: g.gemm(np.ones(3), np.ones((3, 1))), lambda: g.gemm(np.ones((2, 3)), np.ones((3, 4)), np.ones(3))):
        with pytest.raises(ValueError):
            bad()
    assert arrays.flatten_shape([1, 2, 3]) == [1, 6] and arrays.flatten_shape([2, 3, 4], -1) == [6, 4]
    assert arrays.flatten_shape([2, 3], 0) == [1, 6] and arrays.flatten_shape([2, 3], 2) == [6, 1]
    with pytest.raises(ValueError):
        arrays.flatten_shape([2, 3], 3)
    df = spark.createDataFrame([([1.0, float("nan"), -2.0], [10.0, 20.0, 30.0], [1.0, 2.0])], "a array<double>, b array<double>, c array<double>")
    r = df.select(arrays.relu(F.col("a")).alias("r"), arrays.add(F.col("b"), F.col("b")).alias("s"), arrays.argmax(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("m"), arrays.all_finite(F.col("a")).alias("f")).first()
    assert (r.r, r.s, r.m, r.f) == ([1.0, 0.0, 0.0], [20.0, 40.0, 60.0], 1, False)
    for bad in (arrays.add(F.col("a"), F.col("c")), arrays.require_features(F.col("a"), 4)):
        with pytest.raises(PySparkException):
            df.select(bad).collect()
    t = spark.range(1).select(F.struct(F.array(F.lit(6)).alias("shape"), F.array(*[F.lit(float(i)) for i in range(6)]).alias("data")).alias("t"))
    two = t.select(arrays.reshape(F.col("t"), [2, 3]).alias("t"))
    assert two.select(arrays.at(F.col("t"), [1, 2])).first()[0] == 5.0
    for bad in (two.select(arrays.at(F.col("t"), [2, 0])), t.select(arrays.reshape(F.col("t"), [4]))):
        with pytest.raises(PySparkException):
            bad.collect()


def test_graph_orders_and_levels(spark):
    graph = fixtures.branching().graph
    levels = graph.levels()
    assert sorted(levels.values()) == [0, 1, 2, 3, 3, 4]
    assert all(levels[a] < levels[b] for a, b in graph.edges())
    shuffled = g.Graph(graph.nodes[::-1], graph.inputs, graph.outputs)
    place = {n.name: k for k, n in enumerate(shuffled.ordered())}
    assert all(place[a] < place[b] for a, b in graph.edges())
    with pytest.raises(ValueError, match="cycle"):
        g.Graph([g.Node("a", "Relu", ["y"], ["x"]), g.Node("b", "Relu", ["x"], ["y"])]).ordered()
    nodes = g.node_table(spark, graph)
    edges = g.edge_table(nodes)
    assert sorted(map(tuple, edges.collect())) == sorted(graph.edges())
    assert {r.node: r.level for r in g.level_table(spark, nodes, edges).collect()} == levels
    assert g.schedule(spark, fixtures.branching()).where("parallel").count() == 2


def test_rewrites():
    model, report = g.optimize(fixtures.branching())
    assert (report.before, report.after, report.fused) == (6, 5, 1) and "6 nodes became 5" in str(report)
    const = g.Model(g.Graph([g.Node("const_add", "Add", ["a", "b"], ["folded"]), g.Node("use", "Add", ["input", "folded"], ["out"]), g.Node("dead", "Relu", ["out"], ["d1"]), g.Node("dead2", "Relu", ["d1"], ["d2"])], ["input"], ["out"]), {"a": np.array([1.0, 2, 3], np.float32), "b": np.array([10.0, 20, 30], np.float32)})
    done, report = g.optimize(const)
    assert done.tensors["folded"][2] == 33 and (report.folded, report.eliminated, report.after) == (1, 2, 1)
    assert g.optimize(const, fold=False, fuse=False, eliminate=False)[1].after == 4
    assert {a.name for a, _ in g.fusion_candidates(fixtures.DIGITS)} == {"fc1", "fc2_left"}
    for bad in ([g.Node("x", "Conv", ["input"], ["o"])], [g.Node("x", "Relu", ["nothing"], ["o"])], [g.Node("x", "Relu", ["input"], ["o", "p"])]):
        with pytest.raises(ValueError):
            g.check(g.Model(g.Graph(bad, ["input"], ["o"])))
    with pytest.raises(ValueError):
        g.Graph([g.Node("a", "Relu", [], []), g.Node("a", "Relu", [], [])])
    with pytest.raises(TypeError):
        g.Node("a", "Gemm", [], [], {"transB": 1.0}).attr("transB", 0)
    for shape in ((), (0, 3), (9, 3)):
        with pytest.raises(ValueError):
            scoring.check_batch(shape, 8)


def test_model_files(spark, tmp_path):
    model = fixtures.branching()
    model.graph.nodes[1].attrs |= {"alpha": 0.5, "dims": [1, -2]}
    path = str(tmp_path / "m.bin")
    models.write_model(model, path)
    back = models.read_model(spark, path)
    assert back.graph == model.graph and all((back.tensors[k] == t).all() and back.tensors[k].shape == t.shape for k, t in model.tensors.items())
    data = models.model_bytes(model)
    for bad in (b"NOPE" + data[4:], data[:4] + struct.pack("<I", 2) + data[8:], data[:-3], data[:100], b""):
        with pytest.raises(ValueError):
            models.parse_model(bad)
    register_sources(spark)
    assert {r.name for r in spark.read.format("tensormodel").load(path).collect()} == set(model.tensors)
    assert spark.read.format("tensormodel").option("part", "nodes").load(path).count() == 6
    nodes, tensors = models.model_tables(spark, model)
    assert nodes.where("attrs['alpha'].f = 0.5").count() == 1 and tensors.count() == 6


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    pixels, labels = rng.integers(0, 256, (7, 784)), rng.integers(0, 10, 7)
    path = str(tmp_path / "set.bin")
    models.write_image_set(path, pixels, labels)
    register_sources(spark)
    got = sorted(spark.read.format("imageset").option("records", 3).load(path).select("sample_id", "label", arrays.pixel_array(F.col("pixels")).alias("p")).collect())
    assert [r.label for r in got] == labels.tolist() and [r.p for r in got] == pixels.tolist()
    (tmp_path / "raw").write_bytes(bytes(784))
    assert len(models.read_raw_images(spark, str(tmp_path / "raw")).first().pixels) == 784
    for name, data in (("short", bytes(783)), ("set2", struct.pack("<I", 9) + bytes(785 * 8)), ("set3", bytes(4))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(PySparkException):
            (models.read_raw_images(spark, str(tmp_path / name)) if name == "short" else spark.read.format("imageset").load(str(tmp_path / name))).collect()


def bodies():
    good = np.array([1.5, -2.25, 1e-40, 1e6], "<f4")
    return [good.tobytes(), bytes([0, 255, 51, 102]), b"123", np.array([1, 2, 3, np.nan], "<f4").tobytes(), np.array([1, 2, 3, 2e6], "<f4").tobytes(), b""]


def test_bodies_and_stream(spark, tmp_path):
    rows = [(i, bytearray(b)) for i, b in enumerate(bodies())]
    df = spark.createDataFrame(rows, streams.REQUESTS)
    got = {r.request_id: r.x for r in df.select("request_id", models.decode_body(F.col("body"), 4).alias("x")).collect()}
    assert got[0] == pytest.approx(np.array([1.5, -2.25, 1e-40, 1e6], "f4").astype(float), rel=1e-6) and got[1] == [0, 1, 0.2, 0.4]
    assert [got[i] for i in range(2, 6)] == [None] * 4
    model = fixtures.branching()
    want = sorted(map(str, streams.answer(df, model, 4).collect()))
    assert len(want) == 6
    for k in range(2):
        df.where(F.col("request_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    query = streams.serve(streams.requests(spark, str(tmp_path / "in")), model, 4, lambda b, n: out.extend(b.collect()), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sorted(map(str, out)) == want
    text = spark.range(1).select(scoring.logits_json(F.array(F.lit(1.5), F.lit(-2.0)), F.lit(0))).first()[0]
    assert text == '{"prediction":0,"logits":[1.500000,-2.000000]}'


def test_keyed_batches_serve_all(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i % 2)) for i in range(25)], "request_id bigint, queue string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id bigint, queue string").parquet(str(tmp_path / "in"))
    query = streams.batched(stream, 4, 50).writeStream.format("memory").queryName("batches").option("checkpointLocation", str(tmp_path / "cp")).start()
    import time

    began = time.time()
    while time.time() - began < 60 and sum(len(r.request_ids) for r in spark.table("batches").collect()) < 25:
        time.sleep(0.5)
    query.stop()
    rows = spark.table("batches").collect()
    assert sorted(i for r in rows for i in r.request_ids) == list(range(25)) and max(len(r.request_ids) for r in rows) <= 4


def test_word_count_stream_equals_table(spark, tmp_path):
    lines = spark.createDataFrame([("the quick brown fox",), ("the lazy dog",)], "value string")
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    query = streams.word_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.key: r.n for r in spark.table("counts").collect()} == {"the": 2, "quick": 1, "brown": 1, "fox": 1, "lazy": 1, "dog": 1}
