"""A network of labelled tensors: nodes, edges, tags, slicing and contraction.

Nodes and edges are metadata on the driver; the tensors stay lazy relations. A label belongs to an
edge when it has two values or more. A label on more than two nodes is refused, as pairwise
contraction would sum it too early.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.functions.labels import exclusive, union
from weftnet.functions.positions import unravel
from weftnet.operators.tensor import Tensor
from weftnet.plans.path import Leaf, Path, PathPlan, greedy_path, node_name


@dataclass
class Node:
    id: int
    name: str
    labels: list[str]  # with fixed values in brackets after slicing
    tags: list[str]
    tensor: Tensor
    contracted: bool = False


class Network:
    def __init__(self):
        self.nodes: list[Node] = []
        self.path: Path = []
        self._on: dict[str, list[int]] = {}  # label: nodes that have it and aren't contracted

    # Building.

    def add(self, tensor: Tensor, tags: Sequence[str] = ()) -> int:
        """Adds a tensor; returns the node's id."""
        for label, d in zip(tensor.labels, tensor.dims, strict=True):
            for n in (self.nodes[k] for k in self._on.get(label, [])):
                if d is not None and n.tensor.dim(label) not in (d, None):
                    raise ValueError(f"the label {label!r} has {n.tensor.dim(label)} values on node {n.id} and {d} on the new one")
        return self._append(Node(len(self.nodes), node_name(tensor.labels), list(tensor.labels), list(tags), tensor))

    def _append(self, node: Node) -> int:
        self.nodes.append(node)
        for x in node.tensor.labels:
            self._on.setdefault(x, []).append(node.id)
        return node.id

    def copy(self) -> Network:
        out = Network()
        out.nodes = [Node(n.id, n.name, list(n.labels), list(n.tags), n.tensor, n.contracted) for n in self.nodes]
        out.path, out._on = list(self.path), {x: list(ids) for x, ids in self._on.items()}
        return out

    def slice(self, labels: Sequence[str], value: int) -> None:
        """Fixes labels at the values whose row-major number (last label fastest) is `value`."""
        self.fix(dict(zip(labels, unravel(value, [self._dim(x) for x in labels]), strict=True)))

    def fix(self, values: dict[str, int]) -> None:
        for label, v in values.items():
            for n in self.nodes:
                if label in n.tensor.labels:
                    n.tensor = n.tensor.slice(label, v)
                    n.labels = [f"{label}({v})" if x == label else x for x in n.labels]
                    n.name = node_name(n.labels)
            self._on.pop(label, None)

    def _dim(self, label: str) -> int:
        dims = self.dims()
        if label not in dims:
            raise ValueError(f"no node has the label {label!r}")
        if dims[label] is None:
            raise ValueError(f"the number of values of {label!r} isn't known")
        return dims[label]  # type: ignore[return-value]

    # Metadata.

    @property
    def n_tensors(self) -> int:
        return len(self.nodes)

    @property
    def n_labels(self) -> int:
        """Labels that belong to edges."""
        return len(self.edges())

    def dims(self) -> dict[str, int | None]:
        out: dict[str, int | None] = {}
        for n in self.nodes:
            for x, d in zip(n.tensor.labels, n.tensor.dims, strict=True):
                out[x] = d if out.get(x) is None else out[x]
        return out

    def edges(self) -> dict[str, tuple[int | None, list[int]]]:
        """Label to number of values and node ids, of labels with two values or more on nodes not contracted yet."""
        dims = self.dims()
        return {x: (dims[x], list(ids)) for x, ids in self._on.items() if ids and (dims[x] is None or dims[x] >= 2)}

    def tags(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for n in self.nodes:
            for t in n.tags:
                out.setdefault(t, []).append(n.id)
        return out

    def leaves(self) -> list[Leaf]:
        return [Leaf(n.labels, list(n.tensor.labels), n.tags) for n in self.nodes]

    def node_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n.id, n.name, n.labels, list(n.tensor.labels), [d or 0 for d in n.tensor.dims], n.tags) for n in self.nodes]
        return spark.createDataFrame(rows, "id bigint, name string, labels array<string>, tensor_labels array<string>, dims array<bigint>, tags array<string>")

    def edge_table(self, spark: SparkSession) -> DataFrame:
        """label, dim and node_ids, from the node table."""
        ends = self.node_table(spark).select("id", F.explode(F.arrays_zip("tensor_labels", "dims")).alias("e")).select("id", "e.tensor_labels", "e.dims")
        return ends.filter("dims = 0 OR dims >= 2").groupBy(F.col("tensor_labels").alias("label")).agg(F.max("dims").alias("dim"), F.array_sort(F.collect_list("id")).alias("node_ids"))

    def tag_table(self, spark: SparkSession) -> DataFrame:
        return self.node_table(spark).select("id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.array_sort(F.collect_list("id")).alias("node_ids"))

    def describe(self) -> str:
        """Nodes, then edges, as text."""
        lines = ["Nodes"]
        lines += [f"  {n.id} {n.name} [{' '.join(n.tags)}]" for n in self.nodes]
        lines += ["Edges"] + [f"  {x} {d} {' '.join(map(str, ids))}" for x, (d, ids) in self.edges().items()]
        return "\n".join(lines)

    # Contraction.

    def check(self) -> None:
        if not self.nodes:
            raise ValueError("the network has no tensors")
        for label, (_, ids) in self.edges().items():
            if len(ids) > 2:
                raise ValueError(f"the label {label!r} is on {len(ids)} nodes")

    def plan(self, path: Path | None = None) -> PathPlan:
        """The given path, or the greedy one, expanded."""
        self.check()
        return PathPlan(self.leaves(), self.dims(), greedy_path(self.leaves(), self.dims()) if path is None else path)

    def contract(self, path: Path | None = None, outer: bool = True) -> Tensor:
        """Contracts along a path, or along the greedy one; the result is lazy.

        Without a path everything is combined; `outer=False` refuses networks whose parts aren't connected.
        """
        plan = self.plan(path)
        if not outer and any(not s.contracted for s in plan.steps if s.children):
            raise ValueError("the network isn't connected")
        made = [n.tensor for n in self.nodes]
        for a, b in plan.path:
            made.append(made[a].contract(made[b]))
        self.path = list(plan.path)
        return made[-1]

    def contract_nodes(self, a: int, b: int) -> int:
        """Contracts two nodes and adds the result as a node; returns its id."""
        x, y = self.nodes[a], self.nodes[b]
        if a == b or x.contracted or y.contracted:
            raise ValueError(f"can't contract nodes {a} and {b}")
        x.contracted = y.contracted = True
        for n in (x, y):
            for label in n.tensor.labels:
                self._on[label].remove(n.id)
        labels = exclusive(x.labels, y.labels)
        self.path.append((a, b))
        return self._append(Node(len(self.nodes), node_name(labels), labels, union(x.tags, y.tags), x.tensor.contract(y.tensor)))

    def contract_scalars(self) -> Tensor:
        """The product of all nodes that are scalars and not contracted yet."""
        left = [n.tensor for n in self.nodes if not n.contracted and not n.tensor.labels]
        if not left:
            raise ValueError("no scalars are left")
        out = left[0]
        for t in left[1:]:
            out = out.contract(t)
        return out


def n_slices(network: Network, labels: Sequence[str]) -> int:
    return prod(network._dim(x) for x in labels)
