"""Binary sources of the tensor half: model files (S10, S11), labelled image sets (S12), raw images (S13), request bodies."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.files import open_random, write_whole
from millrace.functions.arrays import all_finite, normalise, pixel_array
from millrace.plans.graph import Graph, Model, Node

# Fixed values of the model file: magic, version, attribute tags; and of an image record.
MAGIC, VERSION = b"OIEN", 1
TAG_INT, TAG_FLOAT, TAG_INTS = 0, 1, 2
PIXELS = 784
MAX_IMAGES = 10_000_000


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int, what: str) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) != n:
            raise ValueError(f"the model file ends within {what}")
        self.at += n
        return part

    def number(self, form: str, what: str):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form), what))[0]

    def text(self, what: str) -> str:
        return self.take(self.number("I", what), what).decode()

    def texts(self, what: str) -> list[str]:
        return [self.text(what) for _ in range(self.number("I", what))]


def parse_model(data: bytes) -> Model:
    """The model in a file's bytes; anything else raises ValueError."""
    c = _Cursor(data)
    if data[:4] != MAGIC:
        raise ValueError("not a model file")
    c.at = 4
    if (version := c.number("I", "the version")) != VERSION:
        raise ValueError(f"unsupported model version {version}")
    tensors, nodes = {}, []
    for _ in range(c.number("I", "initializers")):
        name = c.text("a name")
        dims = [c.number("Q", "a shape") for _ in range(c.number("I", "a shape"))]
        n = int(np.prod(dims, dtype=object)) if dims else 1
        tensors[name] = np.frombuffer(c.take(4 * n, "a tensor"), "<f4").reshape(dims)
    for _ in range(c.number("I", "nodes")):
        name, op, inputs, outputs = c.text("a name"), c.text("an operator"), c.texts("inputs"), c.texts("outputs")
        attrs: dict[str, int | float | list[int]] = {}
        for _ in range(c.number("I", "attributes")):
            key, tag = c.text("an attribute"), c.number("B", "an attribute tag")
            if tag == TAG_INT:
                attrs[key] = c.number("q", "an attribute")
            elif tag == TAG_FLOAT:
                attrs[key] = c.number("f", "an attribute")
            elif tag == TAG_INTS:
                attrs[key] = [c.number("q", "an attribute") for _ in range(c.number("I", "an attribute"))]
            else:
                raise ValueError(f"unknown attribute tag {tag}")
        nodes.append(Node(name, op, inputs, outputs, attrs))
    return Model(Graph(nodes, c.texts("graph inputs"), c.texts("graph outputs")), tensors)


def model_bytes(model: Model) -> bytes:
    """What ``parse_model`` reads."""
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    texts = lambda items: struct.pack("<I", len(items)) + b"".join(map(text, items))
    out = [MAGIC, struct.pack("<II", VERSION, len(model.tensors))]
    for name, tensor in model.tensors.items():
        out += [text(name), struct.pack(f"<I{tensor.ndim}Q", tensor.ndim, *tensor.shape), np.ascontiguousarray(tensor, "<f4").tobytes()]
    out.append(struct.pack("<I", len(model.graph.nodes)))
    for node in model.graph.nodes:
        out += [text(node.name), text(node.op), texts(node.inputs), texts(node.outputs), struct.pack("<I", len(node.attrs))]
        for key, value in node.attrs.items():
            if isinstance(value, list):
                out += [text(key), struct.pack(f"<BI{len(value)}q", TAG_INTS, len(value), *value)]
            else:
                out += [text(key), struct.pack("<Bf", TAG_FLOAT, value) if isinstance(value, float) else struct.pack("<Bq", TAG_INT, value)]
    return b"".join([*out, texts(model.graph.inputs), texts(model.graph.outputs)])


def read_model(spark: SparkSession, path: str) -> Model:
    """Through Spark's reader, so from any store; a model is a driver-sized object."""
    found = spark.read.format("binaryFile").load(path).select("content").head(2)
    if len(found) != 1:
        raise ValueError(f"{path} is not one model file")
    return parse_model(bytes(found[0].content))


def write_model(model: Model, path: str) -> None:
    write_whole(path, model_bytes(model))


NODES = "name string, op string, inputs array<string>, outputs array<string>, attrs map<string, struct<tag: tinyint, i: bigint, f: float, is: array<bigint>>>"
TENSORS = "name string, shape array<bigint>, data array<float>"


def model_tables(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame]:
    """The nodes and the initializers of a model."""

    def attr(v) -> tuple:
        return (TAG_INTS, None, None, v) if isinstance(v, list) else (TAG_FLOAT, None, v, None) if isinstance(v, float) else (TAG_INT, v, None, None)

    nodes = [(n.name, n.op, n.inputs, n.outputs, {k: attr(v) for k, v in n.attrs.items()}) for n in model.graph.nodes]
    tensors = [(k, list(t.shape), [float(x) for x in t.ravel()]) for k, t in model.tensors.items()]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(tensors, TENSORS)


class ModelFile(DataSource):
    """``spark.read.format("tensormodel").load(path)``: the initializers, or with option ``part=nodes`` the nodes."""

    @classmethod
    def name(cls) -> str:
        return "tensormodel"

    def schema(self) -> str:
        return "name string, op string, inputs array<string>, outputs array<string>" if self.options.get("part") == "nodes" else TENSORS

    def reader(self, schema) -> DataSourceReader:
        return _ModelReader(self.options["path"], self.options.get("part", "tensors"))


class _ModelReader(DataSourceReader):
    def __init__(self, path: str, part: str):
        self.path, self.part = path, part

    def read(self, partition) -> Iterator[tuple]:
        with open_random(self.path) as file:
            model = parse_model(file.read())
        if self.part == "nodes":
            yield from ((n.name, n.op, n.inputs, n.outputs) for n in model.graph.nodes)
        else:
            yield from ((k, list(t.shape), t.ravel().tolist()) for k, t in model.tensors.items())


class _Records(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ImageSet(DataSource):
    """``spark.read.format("imageset").load(path)``: ``(sample_id, pixels, label)``; option ``records`` a partition.

    A 32-bit count, then records of 784 pixels and a label; fixed widths, so any record can be read by its place.
    """

    @classmethod
    def name(cls) -> str:
        return "imageset"

    def schema(self) -> str:
        return "sample_id bigint, pixels binary, label smallint"

    def reader(self, schema) -> DataSourceReader:
        return _ImageReader(self.options["path"], int(self.options.get("records", 50_000)))


class _ImageReader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def partitions(self) -> list[InputPartition]:
        with open_random(self.path) as file:
            head, size = file.read(4), file.size()
        count = struct.unpack("<I", head)[0] if len(head) == 4 else 0
        if not 1 <= count <= MAX_IMAGES:
            raise ValueError(f"the image set has {count} records")
        if size < 4 + count * (PIXELS + 1):
            raise ValueError("the image set is cut short")
        return [_Records(k, min(k + self.records, count)) for k in range(0, count, self.records)]

    def read(self, part: _Records) -> Iterator[tuple]:
        with io.BufferedReader(open_random(self.path), 1 << 20) as file:
            file.seek(4 + part.first * (PIXELS + 1))
            for k in range(part.first, part.last):
                record = file.read(PIXELS + 1)
                if len(record) != PIXELS + 1:
                    raise ValueError("the image set is cut short")
                yield k, bytearray(record[:PIXELS]), record[PIXELS]


def write_image_set(path: str, pixels: np.ndarray, labels: np.ndarray) -> None:
    """A test set of (n, 784) bytes and labels."""
    write_whole(path, struct.pack("<I", len(pixels)) + np.concatenate([pixels.astype("u1"), labels.astype("u1")[:, None]], axis=1).tobytes())


def read_raw_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pixels)`` of files of exactly 784 bytes; another size raises."""
    said = F.concat(F.lit(f"expected {PIXELS} bytes, got "), F.col("length").cast("string"))
    body = F.when(F.col("length") == PIXELS, F.col("content")).otherwise(F.raise_error(said).cast("binary"))
    return spark.read.format("binaryFile").load(path).select("path", body.alias("pixels"))


def _float32(word: Column) -> Column:
    """The number whose 32 bits a long holds."""
    sign = F.when(F.shiftright(word, 31) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(word, 23).bitwiseAND(F.lit(255))
    part = word.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
    special = F.when(part == 0, sign * float("inf")).otherwise(F.lit(float("nan")))
    small = sign * part * 2.0**-149
    return F.when(exponent == 255, special).when(exponent == 0, small).otherwise(sign * (1 + part * 2.0**-23) * F.pow(F.lit(2.0), (exponent - 127).cast("double")))


def decode_body(body: Column, features: int) -> Column:
    """4F bytes as F little-endian floats, F bytes as fractions of 255; null for another size or a value out of range."""
    bytes_ = pixel_array(body)
    word = lambda b, k: sum((F.shiftleft(F.get(b, 4 * k + i).cast("bigint"), 8 * i) for i in range(1, 4)), F.get(b, 4 * k).cast("bigint"))
    floats = F.element_at(F.transform(F.array(bytes_), lambda b: F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda k: _float32(word(b, k)))), 1)
    decoded = F.when(F.length(body) == 4 * features, floats).when(F.length(body) == features, normalise(bytes_))
    return F.element_at(F.transform(F.array(decoded), lambda x: F.when(all_finite(x), x)), 1)
