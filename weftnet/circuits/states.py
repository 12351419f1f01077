"""States: vectors over wires, as literal tensors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from weftnet.operators.tensor import Tensor


@dataclass(eq=False)
class State:
    name: str
    wires: int
    vector: np.ndarray = field(repr=False)

    def __post_init__(self):
        self.vector = np.asarray(self.vector, complex).reshape(-1)
        self.dim = round(len(self.vector) ** (1 / self.wires))
        if self.dim**self.wires != len(self.vector):
            raise ValueError(f"{len(self.vector)} values are no state of {self.wires} wires")

    def __eq__(self, other) -> bool:
        return isinstance(other, State) and np.array_equal(self.vector, other.vector)

    def tensor(self, spark: SparkSession, labels: Sequence[str] | None = None, precision: str = "double") -> Tensor:
        labels = [str(k) for k in range(self.wires)] if labels is None else list(labels)
        v = self.vector.reshape((self.dim,) * self.wires)
        return Tensor.from_entries(spark, labels, v.shape, ((i, v[i]) for i in zip(*np.nonzero(v), strict=True)), precision)


def _ground(n: int) -> np.ndarray:
    v = np.zeros(n, complex)
    v[0] = 1
    return v


def qudit(dim: int, vector: Sequence[complex] | None = None) -> State:
    """One wire of `dim` values, in the first one without a vector."""
    return State(f"Qudit({dim})", 1, _ground(dim) if vector is None else np.asarray(vector))


def qudits(dim: int, wires: int, vector: Sequence[complex] | None = None) -> State:
    return State(f"QuditRegister({dim})[{wires}]", wires, _ground(dim**wires) if vector is None else np.asarray(vector))


def qubit(vector: Sequence[complex] | None = None) -> State:
    return qudit(2, vector)


def qubits(wires: int, vector: Sequence[complex] | None = None) -> State:
    return qudits(2, wires, vector)


def basis(dim: int, value: int) -> State:
    """A wire that surely has a value."""
    v = np.zeros(dim, complex)
    v[value] = 1
    return State(f"|{value}>", 1, v)
