"""Networks as JSON: {"path": [[i, j], ...], "tensors": [[tags, labels, shape, [[re, im], ...]], ...]}.

A single document is parsed on the driver (a network is metadata) with checks that name what is wrong.
Many documents are scanned as a DataFrame: tensor entries as rows, parsed by Catalyst's JSON functions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.operators.network import Network
from weftnet.operators.tensor import Tensor
from weftnet.plans.path import Path


class NetworkFileError(ValueError):
    """A document that isn't a network."""


class NetworkSyntaxError(NetworkFileError):
    """A text that isn't JSON."""


class NetworkStructureError(NetworkFileError):
    """JSON that has another structure."""


def _parts(text: str) -> tuple[list, Path | None]:
    try:
        doc = json.loads(text)
    except json.JSONDecodeError as e:
        raise NetworkSyntaxError(f"not JSON: {e}") from e
    if not isinstance(doc, dict):
        raise NetworkStructureError("the root must be an object")
    if not isinstance(doc.get("tensors"), list):
        raise NetworkStructureError("the root must have a list 'tensors'")
    path = doc.get("path")
    if path is not None and not (isinstance(path, list) and all(isinstance(p, list) and len(p) == 2 and all(isinstance(i, int) for i in p) for p in path)):
        raise NetworkStructureError("'path' must be a list of pairs of node ids")
    for k, t in enumerate(doc["tensors"]):
        if not (isinstance(t, list) and len(t) == 4 and all(isinstance(x, list) for x in t)):
            raise NetworkStructureError(f"tensor {k} must be a list of tags, labels, shape and values")
        for j, v in enumerate(t[3]):
            if not (isinstance(v, list) and len(v) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v)):
                raise NetworkStructureError(f"element {j} of tensor {k} is not a complex number (a pair)")
    return doc["tensors"], None if path is None else [tuple(p) for p in path]


def load_network(spark: SparkSession, text: str, column_major: bool = False, precision: str = "double") -> tuple[Network, Path | None]:
    """The network and, if there is one, the path of a document.

    `column_major` reads values whose first label runs fastest, by reversing labels and shape.
    """
    tensors, path = _parts(text)
    out = Network()
    for tags, labels, shape, values in tensors:
        if column_major:
            labels, shape = labels[::-1], shape[::-1]
        try:
            out.add(Tensor.from_data(spark, labels, shape, [complex(a, b) for a, b in values], precision), tags)
        except ValueError as e:
            raise NetworkStructureError(str(e)) from e
    return out, path


def dump_network(network: Network, path: Path | None = None, indent: int | None = None) -> str:
    """A document of the leaves (nodes that no contraction made), and the path."""
    made = {n.id for n in network.nodes[len(network.nodes) - sum(1 for _ in network.path) :]} if any(n.contracted for n in network.nodes) else set()
    tensors = [[n.tags, list(n.tensor.labels), list(n.tensor.dims), [[v.real, v.imag] for v in n.tensor.data()]] for n in network.nodes if n.id not in made]
    return json.dumps(({"path": [list(p) for p in path]} if path is not None else {}) | {"tensors": tensors}, indent=indent)


def scan_networks(documents: DataFrame, text: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """The tensors of many documents: keys, tensor, tags, labels, shape, values (array of [re, im]).

    A document without a list 'tensors' and an element that isn't a pair raise an error when they are read.
    """
    doc = F.from_json(F.col(text), "tensors array<array<string>>, path array<array<bigint>>")
    rows = documents.select(*keys, F.when(F.get_json_object(text, "$.tensors").isNull(), F.raise_error(F.lit("the root must be an object with a list 'tensors'"))).otherwise(doc).alias("parsed"))
    rows = rows.select(*keys, F.posexplode("parsed.tensors").alias("tensor", "t"))
    values = F.from_json(F.element_at("t", 4), "array<array<double>>")
    bad = F.exists(values, lambda v: v.isNull() | (F.size(v) != 2))
    return rows.select(
        *keys, "tensor", F.from_json(F.element_at("t", 1), "array<string>").alias("tags"), F.from_json(F.element_at("t", 2), "array<string>").alias("labels"),
        F.from_json(F.element_at("t", 3), "array<bigint>").alias("shape"), F.when(bad, F.raise_error(F.concat(F.lit("an element is not a complex number in tensor "), F.col("tensor").cast("string")))).otherwise(values).alias("values"),
    )


def entries(scanned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A row a value: keys, tensor, position (row-major), re, im."""
    rows = scanned.select(*keys, "tensor", F.posexplode("values").alias("position", "v"))
    return rows.select(*keys, "tensor", F.col("position").cast("long").alias("position"), F.element_at("v", 1).alias("re"), F.element_at("v", 2).alias("im"))


def to_documents(scanned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inverse of scan_networks: keys and a document's text."""
    part = lambda c: F.to_json(c)
    one = F.concat(F.lit("["), F.concat_ws(",", part("tags"), part("labels"), part("shape"), part("values")), F.lit("]"))
    rows = scanned.select(*keys, F.struct("tensor", one.alias("text")).alias("t")).groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return rows.select(*keys, F.concat(F.lit('{"tensors":['), F.array_join(F.transform("ts", lambda t: t["text"]), ","), F.lit("]}")).alias("value"))
