"""Circuits: operations on wires, turned into a tensor network.

A wire's label is "id-depth"; a gate on it opens the next depth. Wires begin in state 0. A closed wire
ends in a state and takes no more operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.circuits.gates import Gate
from weftnet.circuits.states import State, basis, qudit
from weftnet.operators.network import Network
from weftnet.operators.tensor import Tensor, as_precision
from weftnet.plans.path import PathPlan, best_path, greedy_path


@dataclass
class Wire:
    id: int
    depth: int = 0
    closed: bool = False

    @property
    def label(self) -> str:
        return f"{self.id}-{self.depth}"


@dataclass
class Operation:
    part: Gate | State
    wires: tuple[int, ...]


class Circuit:
    def __init__(self, wires: int, dim: int = 2):
        self.dim, self.wires = dim, [Wire(k) for k in range(wires)]
        self.operations = [Operation(qudit(dim), (k,)) for k in range(wires)]
        self._labels: list[list[str]] = [[w.label] for w in self.wires]

    def copy(self) -> Circuit:
        out = Circuit(0, self.dim)
        out.wires = [Wire(w.id, w.depth, w.closed) for w in self.wires]
        out.operations, out._labels = list(self.operations), [list(x) for x in self._labels]
        return out

    def _check(self, ids: Sequence[int], count: int) -> None:
        if len(ids) != count:
            raise ValueError(f"{count} wires are needed, {len(ids)} were given")
        if len(set(ids)) != len(ids):
            raise ValueError(f"a wire is repeated in {list(ids)}")
        for k in ids:
            if not 0 <= k < len(self.wires):
                raise ValueError(f"there is no wire {k}")
            if self.wires[k].closed:
                raise ValueError(f"wire {k} is closed")

    def _check_dim(self, part: Gate | State) -> None:
        if part.dim != self.dim:
            raise ValueError(f"{part.name} acts on wires of {part.dim} values, but the circuit's wires have {self.dim}")

    def append_gate(self, gate: Gate, ids: Sequence[int]) -> None:
        self._check(ids, gate.wires)
        self._check_dim(gate)
        before = [self.wires[k].label for k in ids]
        for k in ids:
            self.wires[k].depth += 1
        self.operations.append(Operation(gate, tuple(ids)))
        self._labels.append([self.wires[k].label for k in ids] + before)

    def append_state(self, state: State, ids: Sequence[int]) -> None:
        """Ends wires in a state."""
        self._check(ids, state.wires)
        self._check_dim(state)
        for k in ids:
            self.wires[k].closed = True
        self.operations.append(Operation(state, tuple(ids)))
        self._labels.append([self.wires[k].label for k in ids])

    @property
    def open_labels(self) -> list[str]:
        return [w.label for w in self.wires if not w.closed]

    def network(self, spark: SparkSession, precision: str = "double") -> Network:
        out = Network()
        for op, labels in zip(self.operations, self._labels, strict=True):
            out.add(op.part.tensor(spark, labels, precision), [op.part.name])
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """A row an operation: seq, part, params, wires, labels."""
        rows = [(k, op.part.name, [float(p) for p in getattr(op.part, "params", ())], list(op.wires), labels) for k, (op, labels) in enumerate(zip(self.operations, self._labels, strict=True))]
        return spark.createDataFrame(rows, "seq int, part string, params array<double>, wires array<int>, labels array<string>")

    # Results.

    def amplitudes(self, spark: SparkSession, samples: int = 0, seed: int = 0, precision: str = "double") -> Tensor:
        """The tensor of the open wires, in the order of wires; gates, states and values have the precision."""
        network = self.network(spark, precision)
        if network.n_tensors == 1:
            return network.nodes[0].tensor
        leaves, dims = network.leaves(), network.dims()
        path = best_path(leaves, dims, samples, seed) if samples else greedy_path(leaves, dims)
        return as_precision(network.contract(path).transpose(self.open_labels), precision)

    def amplitude(self, spark: SparkSession, state: Sequence[int], **how) -> complex:
        """The amplitude of a basis state of all wires."""
        end = self.copy()
        for w, value in zip([w for w in self.wires if not w.closed], state, strict=True):
            end.append_state(basis(self.dim, value), [w.id])
        return end.amplitudes(spark, **how).scalar()

    def probabilities(self, spark: SparkSession, **how) -> DataFrame:
        """position (first wire most significant) and probability of every basis state."""
        t = self.amplitudes(spark, **how).densify()
        return t.df.select(t.position().alias("position"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("probability"))

    def with_expectation(self, operations: Iterable[Operation]) -> Circuit:
        """The closed circuit of the state, operators, and the state's adjoint."""
        out = self.copy()
        gates = [op for op in self.operations if isinstance(op.part, Gate)]
        for op in operations:
            out.append_gate(op.part, op.wires)
        for op in reversed(gates):
            out.append_gate(op.part.adjoint(), op.wires)
        for w in [w for w in out.wires if not w.closed]:
            out.append_state(qudit(self.dim), [w.id])
        return out

    def expectation(self, spark: SparkSession, operations: Iterable[Operation], **how) -> complex:
        """Expected value of the product of operators."""
        return self.with_expectation(operations).amplitudes(spark, **how).scalar()

    def expectation_of_sum(self, spark: SparkSession, terms: Sequence[tuple[complex, Sequence[Operation]]], **how) -> complex:
        """Expected value of a weighted sum of products of operators."""
        return sum((w * self.expectation(spark, ops, **how) for w, ops in terms), 0j)

    def plan(self, spark: SparkSession) -> PathPlan:
        return self.network(spark).plan()
