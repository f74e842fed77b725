"""Scoring a table of samples with a model: three strategies of one meaning (T8, E7, F15), and evaluation.

``native`` makes one projection a node, all within the JVM: for small weights, which become literals. ``relational``
makes matrix products joins and sums: for weights that are tables. ``vectorised`` broadcasts the weights and multiplies
Arrow batches with numpy: for large layers. ``auto`` takes native up to NATIVE_WEIGHTS numbers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import arrays
from millrace.plans import graph as g
from millrace.session import ship

#: Broadcast weights may have so many bytes; more raise.
MAX_WEIGHT_BYTES = 1 << 30


class Strategy(Protocol):
    def __call__(self, samples: DataFrame, model: g.Model, id_col: str, x_col: str) -> DataFrame: ...


def _input(model: g.Model) -> tuple[str, str]:
    if len(model.graph.inputs) != 1 or len(model.graph.outputs) != 1:
        raise ValueError("scoring takes models of one input and one output")
    return model.graph.inputs[0], model.graph.outputs[0]


def _weights(node: g.Node, model: g.Model) -> tuple[np.ndarray, np.ndarray | None]:
    """Weights as (outputs, inputs) and the bias, of a Gemm whose first input is the batch."""
    if node.attr("transA", 0) or any(i not in model.tensors for i in node.inputs[1:]):
        raise ValueError(f"{node.name}: only weights that are initializers, times the batch as it is, can be scored by rows")
    w = model.tensors[node.inputs[1]]
    w = w if node.attr("transB", 0) else w.T
    bias = model.tensors[node.inputs[2]].ravel() if len(node.inputs) > 2 else None
    if bias is not None and bias.size and bias.size != w.shape[0]:
        raise ValueError(f"{node.name}: a bias of {bias.size} for {w.shape[0]} outputs")
    return w, bias if bias is not None and bias.size else None


def _live(model: g.Model) -> list[g.Node]:
    """The nodes that the output needs, parents first."""
    needed, out = set(model.graph.outputs), []
    for n in reversed(model.graph.ordered()):
        if needed & set(n.outputs):
            out.append(n)
            needed |= set(n.inputs)
    return out[::-1]


def native(samples: DataFrame, model: g.Model, id_col: str, x_col: str) -> DataFrame:
    source, result = _input(model)
    columns: dict[str, Column] = {source: F.col("_t0")}
    df = samples.select(F.col(id_col).alias("id"), F.transform(x_col, lambda v: v.cast("double")).alias("_t0"))

    def of(tensor: str) -> Column:
        if tensor in columns:
            return columns[tensor]
        return F.array(*[F.lit(float(v)) for v in model.tensors[tensor].ravel()])

    for k, node in enumerate(_live(model), 1):
        if node.op == "Flatten":
            if node.attr("axis", 1) != 1:
                raise ValueError(f"{node.name}: only axis 1 keeps the batch's rows apart")
            made = of(node.inputs[0])  # a row is flat already
        elif node.op in ("Gemm", "GemmRelu"):
            w, bias = _weights(node, model)
            own = arrays.require_features(of(node.inputs[0]), w.shape[1])
            made = arrays.gemm(own, w.tolist(), None if bias is None else bias.tolist(), node.attr("alpha", 1.0), node.attr("beta", 1.0), node.op == "GemmRelu")
        elif node.op == "Relu":
            made = arrays.relu(of(node.inputs[0]))
        else:
            made = arrays.let(F.struct(of(node.inputs[0]).alias("a"), of(node.inputs[1]).alias("b")), lambda s: arrays.add(s["a"], s["b"]))
        df = df.withColumn(f"_t{k}", made)
        columns[node.outputs[0]] = F.col(f"_t{k}")
    return df.select("id", columns[result].alias("logits"))


def gemm_relational(a: DataFrame, b: DataFrame, trans_a: bool = False, trans_b: bool = False, alpha: float = 1.0, broadcast_b: bool = False) -> DataFrame:
    """``(i, j, v)`` matrices joined on the inner index, products summed by cell. ``broadcast_b`` is for a checked size."""
    left = a.select(F.col("j" if trans_a else "i").alias("row"), F.col("i" if trans_a else "j").alias("k"), F.col("v").cast("double").alias("x"))
    right = b.select(F.col("j" if trans_b else "i").alias("k"), F.col("i" if trans_b else "j").alias("col"), F.col("v").cast("double").alias("w"))
    joined = left.join(F.broadcast(right) if broadcast_b else right, "k")
    return joined.groupBy(F.col("row").alias("i"), F.col("col").alias("j")).agg((F.sum(F.col("x") * F.col("w")) * alpha).alias("v"))


def with_bias(product: DataFrame, bias: DataFrame, beta: float = 1.0, full: bool = False) -> DataFrame:
    """A bias ``(j, b)`` by column, or with ``full`` ``(i, j, b)`` by cell."""
    on = ["i", "j"] if full else ["j"]
    return product.join(bias, on, "left").select("i", "j", (F.col("v") + beta * F.coalesce("b", F.lit(0.0))).alias("v"))


def relational(samples: DataFrame, model: g.Model, id_col: str, x_col: str) -> DataFrame:
    spark = samples.sparkSession
    source, result = _input(model)
    cells = samples.select(F.col(id_col).alias("i"), F.posexplode(x_col).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))
    tables: dict[str, DataFrame] = {source: cells}
    for node in _live(model):
        if node.op == "Flatten":
            made = tables[node.inputs[0]]
        elif node.op in ("Gemm", "GemmRelu"):
            w, bias = _weights(node, model)
            weights = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(w)], "i int, j int, v double")
            small = w.size <= 1 << 16
            made = gemm_relational(tables[node.inputs[0]], weights, trans_b=True, alpha=node.attr("alpha", 1.0), broadcast_b=small)
            if bias is not None:
                made = with_bias(made, F.broadcast(spark.createDataFrame([(j, float(b)) for j, b in enumerate(bias)], "j int, b double")), node.attr("beta", 1.0))
            if node.op == "GemmRelu":
                made = made.withColumn("v", arrays.max0(F.col("v")))
        elif node.op == "Relu":
            made = tables[node.inputs[0]].withColumn("v", arrays.max0(F.col("v")))
        else:
            other = tables[node.inputs[1]].select("i", "j", F.col("v").alias("w"))
            made = tables[node.inputs[0]].join(other, ["i", "j"]).select("i", "j", (F.col("v") + F.col("w")).alias("v"))
        tables[node.outputs[0]] = made
    # a sample's outputs only
    logits = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("logits")
    return tables[result].groupBy(F.col("i").alias("id")).agg(logits)


def run_batch(model: g.Model, batch: np.ndarray, seen: Callable[[g.Node, float], None] | None = None, kind: type = np.float32) -> np.ndarray:
    """The model on a batch (rows, features), by whole-tensor operators in numbers of this kind; ``seen`` gets each node's milliseconds."""
    source, result = _input(model)
    held = {**model.tensors, source: batch.astype(kind, copy=False)}
    for node in _live(model):
        began = time.perf_counter()
        held[node.outputs[0]] = g.compute(node, [held[i] for i in node.inputs])
        if seen:
            seen(node, 1000 * (time.perf_counter() - began))
    return held[result]


def check_batch(shape: tuple[int, ...], most: int) -> None:
    """P10."""
    if not shape:
        raise ValueError("the batch has rank 0")
    if shape[0] > most:
        raise ValueError(f"{shape[0]} samples; a batch has at most {most}")
    if 0 in shape:
        raise ValueError("the batch is empty")


def _matrix(x: pa.Array) -> np.ndarray:
    lengths = np.diff(x.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError("samples have different numbers of features")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def profile(samples: DataFrame, model: g.Model, batch_size: int, x_col: str = "x") -> DataFrame:
    """``(part, batch, samples, node, op, elapsed_ms)``: a row for each node of each batch, and one of no node for the whole batch.

    The log that ``node_profile`` (A14), ``floor_percentiles`` (A11) and ``latency`` (A13) take. Batches are consecutive rows of an
    Arrow batch, the last one shorter (B1).
    """
    ship(samples.sparkSession)
    shared = samples.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _matrix(batch.column(0)), []
            for k in range(0, len(x), batch_size):
                own = x[k : k + batch_size]
                began = time.perf_counter()
                run_batch(shared.value, own, lambda n, ms, own=own, number=number: rows.append((part, number, len(own), n.name, n.op, ms)))
                rows.append((part, number, len(own), None, None, 1000 * (time.perf_counter() - began)))
                number += 1
            names = ["part", "batch", "samples", "node", "op", "elapsed_ms"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return samples.select(F.col(x_col).cast("array<float>")).mapInArrow(run, "part int, batch bigint, samples bigint, node string, op string, elapsed_ms double")


def vectorised(samples: DataFrame, model: g.Model, id_col: str, x_col: str) -> DataFrame:
    ship(samples.sparkSession)
    if (size := sum(t.nbytes for t in model.tensors.values())) > MAX_WEIGHT_BYTES:
        raise ValueError(f"{size} bytes of weights can't be broadcast")
    shared = samples.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = run_batch(shared.value, _matrix(batch.column(1)), kind=np.float64)
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel().astype(np.float64)))], ["id", "logits"])

    kind = samples.schema[id_col].dataType.simpleString()
    sent = "array<float>" if samples.schema[x_col].dataType.simpleString() == "array<float>" else "array<double>"
    return samples.select(F.col(id_col).alias("id"), F.col(x_col).cast(sent).alias("x")).mapInArrow(run, f"id {kind}, logits array<double>")


STRATEGIES: dict[str, Strategy] = {"native": native, "relational": relational, "vectorised": vectorised}


def score(samples: DataFrame, model: g.Model, id_col: str = "sample_id", x_col: str = "x", strategy: str = "auto", optimize: bool = True) -> DataFrame:
    """``(id, logits, prediction)``. ``optimize`` rewrites the graph first; the results agree either way.

    ``auto`` is ``vectorised`` at every size of a model. All strategies compute in 64 bits, whatever the model's numbers have.
    """
    g.check(model)
    if optimize:
        model, _ = g.optimize(model)
    if strategy == "auto":
        strategy = "vectorised"
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    out = STRATEGIES[strategy](samples, model, id_col, x_col)
    return out.select("id", "logits", arrays.argmax(F.col("logits")).alias("prediction"))


def accuracy(scored: DataFrame, labels: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Samples, correct ones and the percentage, of predictions joined to labels."""
    joined = scored.join(labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("_label")), "id")
    hit = F.when(F.col("prediction") == F.col("_label"), 1).otherwise(0)
    return joined.agg(F.count("*").alias("samples"), F.coalesce(F.sum(hit), F.lit(0)).alias("correct")).withColumn("accuracy", 100.0 * F.col("correct") / F.col("samples"))


def logits_json(logits: Column, prediction: Column) -> Column:
    """F-jsonfmt: the response text, six digits a logit."""
    shown = F.array_join(F.transform(logits, lambda v: F.format_string("%.6f", v)), ",")
    return F.concat(F.lit('{"prediction":'), prediction.cast("string"), F.lit(',"logits":['), shown, F.lit("]}"))
