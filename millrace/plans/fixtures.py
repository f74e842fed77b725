"""Small models with fixed weights: scored by the queries and the tests."""

from __future__ import annotations

import numpy as np

from millrace.plans.graph import Graph, Model, Node


def linear(features: int, classes: int) -> Model:
    """flatten -> fc. The rule of the weights, the bias of 0.25."""
    w = np.array([0.01 * ((i * 7) % 13) - 0.05 for i in range(classes * features)], np.float32).reshape(classes, features)
    nodes = [Node("flatten", "Flatten", ["input"], ["flat"], {"axis": 1}), Node("fc", "Gemm", ["flat", "w", "b"], ["output"], {"transB": 1})]
    return Model(Graph(nodes, ["input"], ["output"]), {"w": w, "b": np.full(classes, 0.25, np.float32)})


def branching(features: int = 4, hidden: int = 4, classes: int = 3) -> Model:
    """flatten -> fc1 -> relu1 -> {left, right} -> add. The smallest form's weights; others follow the same rules."""
    seq = lambda n, f, shape: np.array([f(i) for i in range(n)], np.float32).reshape(shape)
    cycle = lambda values, n: np.array([values[i % len(values)] for i in range(n)], np.float32)
    tensors = {
        "w1": seq(hidden * features, lambda i: 0.1 * (i % 7) - 0.2, (hidden, features)),
        "b1": cycle([0.1, -0.2, 0.3, 0.0], hidden),
        "wl": seq(classes * hidden, lambda i: 0.05 * i - 0.1, (classes, hidden)),
        "bl": cycle([0.0, 0.5, -0.5], classes),
        "wr": seq(classes * hidden, lambda i: -0.03 * i + 0.2, (classes, hidden)),
        "br": cycle([1.0, 0.0, 0.25], classes),
    }
    nodes = [
        Node("flatten", "Flatten", ["input"], ["flat"], {"axis": 1}),
        Node("fc1", "Gemm", ["flat", "w1", "b1"], ["h1"], {"transB": 1}),
        Node("relu1", "Relu", ["h1"], ["a1"]),
        Node("left", "Gemm", ["a1", "wl", "bl"], ["l"], {"transB": 1}),
        Node("right", "Gemm", ["a1", "wr", "br"], ["r"], {"transB": 1}),
        Node("add", "Add", ["l", "r"], ["output"]),
    ]
    return Model(Graph(nodes, ["input"], ["output"]), tensors)


# The nine-node topology of a trained digit classifier, by name, with two nodes that nothing takes; what each node takes and makes.
DIGITS = Graph(
    [
        Node("flatten", "Flatten", ["image"], ["t0"]),
        Node("fc1", "Gemm", ["t0"], ["t1"]),
        Node("relu1", "Relu", ["t1"], ["t2"]),
        Node("fc2_left", "Gemm", ["t2"], ["t3"]),
        Node("relu2", "Relu", ["t3"], ["t4"]),
        Node("fc2_left2", "Gemm", ["t4"], ["t5"]),
        Node("fc2_right", "Gemm", ["t2"], ["t6"]),
        Node("add", "Add", ["t5", "t6"], ["t7"]),
        Node("fc3", "Gemm", ["t7"], ["logits"]),
        Node("unused", "Relu", ["t7"], ["t9"]),
        Node("unused2", "Relu", ["t9"], ["t10"]),
    ],
    ["image"],
    ["logits"],
)
