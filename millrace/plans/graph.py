"""The tensor graph: nodes, edges, orders, levels, and the rewrites at load time (J1, O7, O8, U4, section 4).

Graphs are driver-sized metadata; what they describe runs as one projection over a table of samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.arrays import flatten_shape

OPERATORS = ("Flatten", "Gemm", "Relu", "Add", "GemmRelu")


@dataclass
class Node:
    """Attributes are whole numbers, floats or lists of whole numbers."""

    name: str
    op: str
    inputs: list[str]
    outputs: list[str]
    attrs: dict[str, int | float | list[int]] = field(default_factory=dict)

    def attr(self, key: str, default):
        """The attribute, or the default; an attribute of another kind than the default's raises."""
        value = self.attrs.get(key, default)
        if type(value) is not type(default):
            raise TypeError(f"{self.name}: attribute {key} is {type(value).__name__}, not {type(default).__name__}")
        return value


@dataclass
class Graph:
    nodes: list[Node]
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        names = [n.name for n in self.nodes]
        if len(set(names)) != len(names):
            raise ValueError("two nodes have one name")

    def edges(self) -> list[tuple[str, str]]:
        """One from a to b for each output of a that b takes, a and b apart."""
        return [(a.name, b.name) for a in self.nodes for out in a.outputs for b in self.nodes if a is not b and out in b.inputs]

    def parents(self) -> dict[str, set[str]]:
        found: dict[str, set[str]] = {n.name: set() for n in self.nodes}
        for a, b in self.edges():
            found[b].add(a)
        return found

    def levels(self) -> dict[str, int]:
        """0 for nodes without parents, else one more than the highest parent's. A cycle raises and names a node."""
        parents, level = self.parents(), {}
        while len(level) < len(parents):
            ready = [n for n, p in parents.items() if n not in level and p <= level.keys()]
            if not ready:
                raise ValueError(f"the graph has a cycle through {next(n for n in parents if n not in level)!r}")
            level |= {n: 1 + max((level[p] for p in parents[n]), default=-1) for n in ready}
        return level

    def ordered(self) -> list[Node]:
        """Parents before children."""
        level = self.levels()
        return sorted(self.nodes, key=lambda n: level[n.name])


@dataclass
class Model:
    graph: Graph
    tensors: dict[str, np.ndarray] = field(default_factory=dict)


@dataclass(frozen=True)
class OptimizationReport:
    before: int
    after: int
    fused: int
    folded: int
    eliminated: int

    def __str__(self) -> str:
        return f"{self.before} nodes became {self.after}: {self.folded} constants folded, {self.fused} activations fused, {self.eliminated} unused ones left out"


#: Weights that are widened to 64 bits at a time.
WIDENED = 1 << 20


def _product(a: np.ndarray, b: np.ndarray, kind: type) -> np.ndarray:
    if b.dtype == kind:
        return a.astype(kind, copy=False) @ b
    a, out = a.astype(kind, copy=False), np.empty((a.shape[0], b.shape[1]), kind)
    step = max(1, WIDENED // max(1, b.shape[0]))
    for k in range(0, b.shape[1], step):
        out[:, k : k + step] = a @ b[:, k : k + step].astype(kind)
    return out


def gemm(a: np.ndarray, b: np.ndarray, bias: np.ndarray | None = None, trans_a: int = 0, trans_b: int = 0, alpha: float = 1.0, beta: float = 1.0) -> np.ndarray:
    """Alpha * op(a) op(b) + beta * bias; the bias a value a column, a cell, or none. In 64 bits if a or b is, else in 32."""
    if a.ndim != 2 or b.ndim != 2:
        raise ValueError("gemm: a and b must be matrices")
    a, b = (a.T if trans_a else a), (b.T if trans_b else b)
    if a.shape[1] != b.shape[0]:
        raise ValueError(f"gemm: inner sizes {a.shape[1]} and {b.shape[0]} differ")
    kind = np.float64 if np.float64 in (a.dtype, b.dtype) else np.float32
    out = kind(alpha) * _product(a, b, kind)
    if bias is not None and bias.size:
        if bias.size not in (out.shape[1], out.size):
            raise ValueError("gemm: the bias fits neither a row nor the result")
        out += kind(beta) * (bias.reshape(1, -1) if bias.size == out.shape[1] else bias.reshape(out.shape))
    return out


def relu(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.float32(0))


def compute(node: Node, inputs: list[np.ndarray]) -> np.ndarray:
    """One node on whole tensors."""
    if node.op == "Flatten":
        return inputs[0].reshape(flatten_shape(list(inputs[0].shape), node.attr("axis", 1)))
    if node.op in ("Gemm", "GemmRelu"):
        trans = [node.attr(k, 0) for k in ("transA", "transB")]
        out = gemm(inputs[0], inputs[1], inputs[2] if len(inputs) > 2 else None, *trans, *(node.attr(k, 1.0) for k in ("alpha", "beta")))
        return relu(out) if node.op == "GemmRelu" else out
    if node.op == "Relu":
        return relu(inputs[0])
    if node.op == "Add":
        if inputs[0].shape != inputs[1].shape:
            raise ValueError("add: shapes differ")
        return inputs[0] + inputs[1]
    raise ValueError(f"{node.name}: operator {node.op} isn't supported")


def fold_constants(model: Model) -> tuple[Model, int]:
    """Nodes whose inputs are all initializers become initializers, until none is left."""
    tensors, nodes, folded = dict(model.tensors), list(model.graph.nodes), 0
    while node := next((n for n in nodes if n.op in OPERATORS and len(n.outputs) == 1 and n.inputs and all(i in tensors for i in n.inputs)), None):
        tensors[node.outputs[0]] = compute(node, [tensors[i] for i in node.inputs])
        nodes.remove(node)
        folded += 1
    return Model(replace(model.graph, nodes=nodes), tensors), folded


def fusion_candidates(graph: Graph) -> list[tuple[Node, Node]]:
    """(Gemm, Relu) pairs where nothing else sees what is between them."""
    parents, by_name = graph.parents(), {n.name: n for n in graph.nodes}
    edges = graph.edges()
    found = []
    for n in graph.nodes:
        if n.op == "Relu" and len(n.inputs) == 1 and len(parents[n.name]) == 1 and sum(b == n.name for _, b in edges) == 1:
            p = by_name[next(iter(parents[n.name]))]
            if p.op == "Gemm" and len(p.outputs) == 1 and sum(a == p.name for a, _ in edges) == 1 and p.outputs[0] not in graph.outputs:
                found.append((p, n))
    return found


def fuse_activations(model: Model) -> tuple[Model, int]:
    graph, fused = model.graph, 0
    while pairs := fusion_candidates(graph):
        producer, activation = pairs[0]
        nodes = [replace(n, op="GemmRelu", outputs=activation.outputs) if n is producer else n for n in graph.nodes if n is not activation]
        graph, fused = replace(graph, nodes=nodes), fused + 1
    return Model(graph, model.tensors), fused


def dead_nodes(graph: Graph) -> list[str]:
    """U4: nodes that go one after another, as no output of theirs is taken by a node left or is the graph's."""
    nodes, dead = list(graph.nodes), []
    while True:
        used = {i for n in nodes for i in n.inputs} | set(graph.outputs)
        gone = [n for n in nodes if not used & set(n.outputs)]
        if not gone:
            return dead
        dead += [n.name for n in gone]
        nodes = [n for n in nodes if n not in gone]


def optimize(model: Model, fold: bool = True, fuse: bool = True, eliminate: bool = True) -> tuple[Model, OptimizationReport]:
    """Fold, then fuse, then eliminate, each until nothing changes."""
    before, folded, fused, eliminated = len(model.graph.nodes), 0, 0, 0
    if fold:
        model, folded = fold_constants(model)
    if fuse:
        model, fused = fuse_activations(model)
    if eliminate:
        dead = dead_nodes(model.graph)
        eliminated = len(dead)
        model = Model(replace(model.graph, nodes=[n for n in model.graph.nodes if n.name not in dead]), model.tensors)
    return model, OptimizationReport(before, len(model.graph.nodes), fused, folded, eliminated)


def check(model: Model) -> None:
    """Operators known, one output each, all inputs there; no cycle."""
    there = set(model.tensors) | set(model.graph.inputs)
    for n in model.graph.ordered():
        if n.op not in OPERATORS:
            raise ValueError(f"{n.name}: operator {n.op} isn't supported")
        if len(n.outputs) != 1:
            raise ValueError(f"{n.name}: {len(n.outputs)} outputs")
        missing = [i for i in n.inputs if i not in there]
        if missing:
            raise ValueError(f"{n.name}: no tensor {missing[0]!r}")
        there |= set(n.outputs)
    for out in model.graph.outputs:
        if out not in there:
            raise ValueError(f"no tensor {out!r} for the graph's output")


def schedule(spark: SparkSession, model: Model) -> DataFrame:
    """``(level, node, op, parallel)``; nodes of a parallel level are independent columns of one projection."""
    levels = model.graph.levels()
    size = {k: list(levels.values()).count(k) for k in levels.values()}
    rows = [(levels[n.name], n.name, n.op, size[levels[n.name]] > 1) for n in model.graph.nodes]
    return spark.createDataFrame(rows, "level int, node string, op string, parallel boolean")


def node_table(spark: SparkSession, graph: Graph) -> DataFrame:
    return spark.createDataFrame([(n.name, n.op, n.inputs, n.outputs) for n in graph.nodes], "name string, op string, inputs array<string>, outputs array<string>")


def edge_table(nodes: DataFrame) -> DataFrame:
    """J1 as a join: ``(parent, child)``, one row for each output of the parent that the child takes."""
    made = nodes.select(F.col("name").alias("parent"), F.explode("outputs").alias("tensor"))
    taken = nodes.select(F.col("name").alias("child"), F.explode(F.array_distinct("inputs")).alias("tensor"))
    return made.join(taken, "tensor").where("parent <> child").select("parent", "child")


def level_table(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """O8 as a recursive query: ``(node, level)``. A cycle runs into Spark's recursion limit and raises."""
    nodes.createOrReplaceTempView("_millrace_nodes")
    edges.createOrReplaceTempView("_millrace_edges")
    return spark.sql("""
        WITH RECURSIVE reach(node, level) AS (
          SELECT name, 0 FROM _millrace_nodes WHERE name NOT IN (SELECT child FROM _millrace_edges)
          UNION ALL
          SELECT e.child, r.level + 1 FROM reach r JOIN _millrace_edges e ON e.parent = r.node)
        SELECT node, max(level) AS level FROM reach GROUP BY node""")


def dead_table(nodes: DataFrame, edges: DataFrame, outputs: list[str]) -> DataFrame:
    """U4 as a recursive query: ``(node)`` of the nodes that none of the outputs needs."""
    spark = nodes.sparkSession
    nodes.withColumn("kept", F.arrays_overlap("outputs", F.array(*[F.lit(o) for o in outputs]))).createOrReplaceTempView("_millrace_nodes")
    edges.createOrReplaceTempView("_millrace_edges")
    return spark.sql("""
        WITH RECURSIVE needed(node) AS (
          SELECT name FROM _millrace_nodes WHERE kept
          UNION ALL
          SELECT e.parent FROM needed n JOIN _millrace_edges e ON e.child = n.node)
        SELECT name AS node FROM _millrace_nodes WHERE name NOT IN (SELECT node FROM needed)""")


def fusion_table(nodes: DataFrame, edges: DataFrame, outputs: list[str]) -> DataFrame:
    """``(gemm, relu)``: products whose only taker is an activation that takes nothing else, and that are no output themselves."""
    own = nodes.select("name", "op", F.arrays_overlap("outputs", F.array(*[F.lit(o) for o in outputs])).alias("shown"))
    takers = edges.groupBy("parent").agg(F.count("*").alias("takers"))
    givers = edges.groupBy("child").agg(F.count("*").alias("givers"))
    gemm = own.where("op = 'Gemm' and not shown").select(F.col("name").alias("parent"))
    relu = own.where("op = 'Relu'").select(F.col("name").alias("child"))
    alone = edges.join(gemm, "parent").join(relu, "child").join(takers.where("takers = 1"), "parent").join(givers.where("givers = 1"), "child")
    return alone.select(F.col("parent").alias("gemm"), F.col("child").alias("relu"))
