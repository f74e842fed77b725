"""Array expressions of the tensor half (P7-P9, J5, T1-T7, O5). A row holds one sample as a flat array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once a row: a lambda would compute what it mentions for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(pixels: Column) -> Column:
    """Bytes as fractions of 255."""
    return F.transform(pixels, lambda p: p.cast("double") / 255)


def pixel_array(body: Column) -> Column:
    """The unsigned bytes of a binary column."""
    chars = F.split(F.decode(body, "ISO-8859-1"), "")
    return F.when(F.length(body) == 0, F.array().cast("array<int>")).otherwise(F.transform(chars, F.ascii))


def all_finite(x: Column, limit: float = 1e6) -> Column:
    """Every value within the limit; NaN compares above it and fails."""
    return F.forall(x, lambda v: (v >= -limit) & (v <= limit))


def has_features(x: Column, n: int) -> Column:
    """P9."""
    return F.size(x) == n


def require_features(x: Column, n: int) -> Column:
    said = F.concat(F.lit(f"expected {n} features, got "), F.size(x).cast("string"))
    return F.when(has_features(x, n), x).otherwise(F.raise_error(said))


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v)


def max0(v: Column) -> Column:
    """Also 0 for NaN."""
    return F.when((v > 0) & ~F.isnan(v), v).otherwise(F.lit(0.0))


def relu(x: Column) -> Column:
    """T3."""
    return F.transform(x, lambda v: max0(v.cast("double")))


def add(a: Column, b: Column) -> Column:
    """Arrays of different sizes raise."""
    said = F.lit("add: sizes differ")
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.cast("double") + y)).otherwise(F.raise_error(said).cast("array<double>"))


def gemm(x: Column, rows: list[list[float]], bias: list[float] | None = None, alpha: float = 1.0, beta: float = 1.0, fuse_relu: bool = False) -> Column:
    """Alpha * x . rows(transposed) + beta * bias, one output a row of weights."""
    weights = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in row]).alias("w"), F.lit(float(b)).alias("b")) for row, b in zip(rows, bias or [0.0] * len(rows), strict=True)])
    finish = max0 if fuse_relu else lambda v: v
    return let(x, lambda own: F.transform(weights, lambda r: finish(dot(own, r["w"]) * alpha + r["b"] * beta)))


def argmax(x: Column) -> Column:
    """The first place of the greatest value, from 0."""
    return let(x, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def flatten_shape(shape: list[int], axis: int = 1) -> list[int]:
    """The product of the sizes before the axis, and of the rest."""
    rank = len(shape)
    at = axis + rank if axis < 0 else axis
    if not 0 <= at <= rank:
        raise ValueError(f"flatten: axis {axis} is out of range for rank {rank}")
    outer = inner = 1
    for n in shape[:at]:
        outer *= n
    for n in shape[at:]:
        inner *= n
    return [outer or 1, inner]


def reshape(tensor: Column, shape: list[int]) -> Column:
    """A struct of shape and data with another shape of as many elements."""
    n = 1
    for k in shape:
        n *= k
    new = F.struct(F.array(*[F.lit(k).cast("bigint") for k in shape]).alias("shape"), tensor["data"].alias("data"))
    return F.when(F.size(tensor["data"]) == n, new).otherwise(F.raise_error(F.lit("reshape: element counts differ")))


def zeros(n: Column | int) -> Column:
    """T7."""
    return F.array_repeat(F.lit(0.0), n)


def at(tensor: Column, index: list[int]) -> Column:
    """The element at an index, row-major; out of range raises."""
    place = F.lit(0).cast("bigint")
    inside = F.size(tensor["shape"]) == len(index)
    for k, i in enumerate(index):
        place = place * F.get(tensor["shape"], k) + i
        inside &= (F.lit(i) >= 0) & (F.lit(i) < F.get(tensor["shape"], k))
    return F.when(inside, F.get(tensor["data"], place.cast("int"))).otherwise(F.raise_error(F.lit("index out of range")))
