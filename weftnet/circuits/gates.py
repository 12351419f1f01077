"""Gates: a matrix by name and parameters, as a literal tensor.

A gate's tensor has its output labels first, then its input labels, one of each a wire. New gates are
added to the registry by name; adjoint and scale work on any gate.
"""

from __future__ import annotations

import cmath
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import product
from math import cos, cosh, exp, pi, sin, sqrt, tanh

import numpy as np
from pyspark.sql import SparkSession

from weftnet.operators.tensor import Tensor

Matrix = Callable[..., np.ndarray]
_ROOT = 1 / sqrt(2)


def _phase(x: float) -> complex:
    return cmath.exp(1j * x)


def _controlled(m: np.ndarray) -> np.ndarray:
    """The identity beside a matrix: it acts where the first wire is 1."""
    n = len(m)
    out = np.eye(2 * n, dtype=complex)
    out[n:, n:] = m
    return out


def _swapping(n: int, a: int, b: int, factor: complex = 1) -> np.ndarray:
    """The identity with two basis states exchanged."""
    out = np.eye(n, dtype=complex)
    out[[a, b]] = out[[b, a]]
    out[a, b] *= factor
    out[b, a] *= factor
    return out


def _turn(theta: float, phi: float, lam: float) -> np.ndarray:
    """The general one-qubit rotation by angles theta, phi and lambda."""
    c, s = cos(theta / 2), sin(theta / 2)
    return np.array([[c, -s * _phase(lam)], [s * _phase(phi), c * _phase(phi + lam)]])


def rx(t: float) -> np.ndarray:
    return np.array([[cos(t / 2), -1j * sin(t / 2)], [-1j * sin(t / 2), cos(t / 2)]])


def ry(t: float) -> np.ndarray:
    return np.array([[cos(t / 2), -sin(t / 2)], [sin(t / 2), cos(t / 2)]], dtype=complex)


def rz(t: float) -> np.ndarray:
    return np.diag([_phase(-t / 2), _phase(t / 2)])


def rot(phi: float, theta: float, omega: float) -> np.ndarray:
    """Three Euler angles: a turn about z by phi, about y by theta, about z by omega."""
    return rz(omega) @ ry(theta) @ rz(phi)


X = np.array([[0, 1], [1, 0]], dtype=complex)
Y = np.array([[0, -1j], [1j, 0]])
Z = np.diag([1, -1]).astype(complex)


def gaussian(cutoff: int, first: complex, b: Sequence[complex], a: np.ndarray) -> np.ndarray:
    """Fock matrix elements of a Gaussian gate by the recurrence over outputs and inputs.

    G[0] = first, and for a place k with k_i > 0 and p = k - e_i:
    sqrt(k_i) G[k] = b_i G[p] + sum_j a_ij sqrt(p_j) G[p - e_j].
    """
    axes = len(b)
    g = np.zeros((cutoff,) * axes, complex)
    for k in product(range(cutoff), repeat=axes):
        i = next((i for i in range(axes) if k[i]), None)
        if i is None:
            g[k] = first
            continue
        p = tuple(x - (j == i) for j, x in enumerate(k))
        total = b[i] * g[p]
        for j in range(axes):
            if p[j] and a[i][j]:
                total += a[i][j] * sqrt(p[j]) * g[tuple(x - (m == j) for m, x in enumerate(p))]
        g[k] = total / sqrt(k[i])
    half = cutoff ** (axes // 2)
    return g.reshape(half, half)


def displacement(cutoff: int, r: float, phi: float) -> np.ndarray:
    alpha = r * _phase(phi)
    return gaussian(cutoff, exp(-r * r / 2), (alpha, -alpha.conjugate()), np.array([[0, 1], [1, 0]], complex))


def squeezing(cutoff: int, r: float, theta: float) -> np.ndarray:
    t, s = tanh(r), 1 / cosh(r)
    return gaussian(cutoff, sqrt(s), (0, 0), np.array([[-_phase(theta) * t, s], [s, _phase(-theta) * t]]))


def two_mode_squeezing(cutoff: int, r: float, theta: float) -> np.ndarray:
    t, s = tanh(r), 1 / cosh(r)
    up, down = _phase(theta) * t, -_phase(-theta) * t
    return gaussian(cutoff, s, (0, 0, 0, 0), np.array([[0, up, s, 0], [up, 0, 0, s], [s, 0, 0, down], [0, s, down, 0]]))


def beamsplitter(cutoff: int, theta: float, phi: float) -> np.ndarray:
    c, s = cos(theta), sin(theta)
    back, forth = -_phase(-phi) * s, _phase(phi) * s
    return gaussian(cutoff, 1, (0, 0, 0, 0), np.array([[0, 0, c, back], [0, 0, forth, c], [c, forth, 0, 0], [back, c, 0, 0]], complex))


class GateKind:
    """What the registry knows of a gate: wires, parameter names, its matrix, and whether its dimension is free."""

    def __init__(self, title: str, wires: int, params: Sequence[str], matrix: Matrix, fock: bool = False):
        self.title, self.wires, self.params, self.fock = title, wires, tuple(params), fock
        self.matrix = lru_cache(maxsize=256)(matrix)


class Gate:
    def __init__(self, kind: GateKind, params: Sequence[float], dim: int = 2, adjoint: bool = False, scalar: complex = 1):
        if len(params) != len(kind.params):
            raise TypeError(f"{kind.title} takes {len(kind.params)} parameters, not {len(params)}")
        self.kind, self.params, self.is_adjoint, self.scalar = kind, tuple(params), adjoint, scalar
        self.name, self.wires = kind.title, kind.wires
        self.dim = dim

    @property
    def dim(self) -> int:
        return self._dim

    @dim.setter
    def dim(self, dim: int) -> None:
        if self.kind.fock and dim < 2:
            raise ValueError(f"the dimension of {self.name} must be 2 or more, not {dim}")
        if not self.kind.fock and dim != 2:
            raise ValueError(f"the dimension of {self.name} must be 2, not {dim}")
        self._dim = dim

    def matrix(self) -> np.ndarray:
        m = self.kind.matrix(self.dim, *self.params) if self.kind.fock else self.kind.matrix(*self.params)
        m = m.conj().T if self.is_adjoint else m
        return self.scalar * m

    def adjoint(self) -> Gate:
        return Gate(self.kind, self.params, self.dim, not self.is_adjoint, complex(self.scalar).conjugate())

    def scale(self, scalar: complex) -> Gate:
        return Gate(self.kind, self.params, self.dim, self.is_adjoint, self.scalar * scalar)

    def labels(self) -> list[str]:
        return [str(k) for k in range(2 * self.wires)]

    def tensor(self, spark: SparkSession, labels: Sequence[str] | None = None, precision: str = "double") -> Tensor:
        labels = self.labels() if labels is None else list(labels)
        if len(labels) != 2 * self.wires:
            raise ValueError(f"{self.name} has {2 * self.wires} labels, not {len(labels)}")
        m = self.matrix().reshape((self.dim,) * (2 * self.wires))
        return Tensor.from_entries(spark, labels, m.shape, ((i, m[i]) for i in zip(*np.nonzero(m), strict=True)), precision)

    def __eq__(self, other) -> bool:
        return isinstance(other, Gate) and self.name == other.name and self.params == other.params and np.array_equal(self.matrix(), other.matrix())

    __hash__ = None  # type: ignore[assignment]


class Registry:
    def __init__(self):
        self.kinds: dict[str, GateKind] = {}

    def register(self, names: Sequence[str], kind: GateKind) -> GateKind:
        taken = sorted(set(names) & set(self.kinds))
        if taken:
            raise KeyError(f"the gate names {taken} are taken")
        self.kinds |= dict.fromkeys(names, kind)
        return kind

    def unregister(self, kind: GateKind) -> None:
        self.kinds = {n: k for n, k in self.kinds.items() if k is not kind}

    def create(self, name: str, *params: float, adjoint: bool = False, scalar: complex = 1, dim: int = 2, **named: float) -> Gate:
        if name not in self.kinds:
            raise KeyError(f"there is no gate {name!r}")
        kind = self.kinds[name]
        if named:
            rest = kind.params[len(params) :]
            if set(named) != set(rest):
                raise TypeError(f"{name} takes the parameters {list(kind.params)}")
            params = (*params, *(named[p] for p in rest))
        gate = Gate(kind, params, dim)
        gate = gate.adjoint() if adjoint else gate
        return gate.scale(scalar) if scalar != 1 else gate


gates = Registry()

#: Names, wires, parameters and matrices of the gates.
_CATALOGUE = [
    (("Displacement", "displacement", "D", "d"), 1, ("r", "phi"), displacement, True),
    (("Squeezing", "squeezing"), 1, ("r", "theta"), squeezing, True),
    (("TwoModeSqueezing", "twomodesqueezing"), 2, ("r", "theta"), two_mode_squeezing, True),
    (("Beamsplitter", "beamsplitter", "BS", "bs"), 2, ("theta", "phi"), beamsplitter, True),
    (("Hadamard", "hadamard", "H", "h"), 1, (), lambda: np.array([[1, 1], [1, -1]], complex) * _ROOT, False),
    (("PauliX", "paulix", "X", "x", "NOT", "not"), 1, (), lambda: X, False),
    (("PauliY", "pauliy", "Y", "y"), 1, (), lambda: Y, False),
    (("PauliZ", "pauliz", "Z", "z"), 1, (), lambda: Z, False),
    (("S", "s"), 1, (), lambda: np.diag([1, 1j]), False),
    (("T", "t"), 1, (), lambda: np.diag([1, _phase(pi / 4)]), False),
    (("SX", "sx"), 1, (), lambda: np.array([[1 + 1j, 1 - 1j], [1 - 1j, 1 + 1j]]) / 2, False),
    (("PhaseShift", "phaseshift"), 1, ("phi",), lambda phi: np.diag([1, _phase(phi)]), False),
    (("CPhaseShift", "cphaseshift"), 2, ("phi",), lambda phi: np.diag([1, 1, 1, _phase(phi)]), False),
    (("CX", "cx", "CNOT", "cnot"), 2, (), lambda: _controlled(X), False),
    (("CY", "cy"), 2, (), lambda: _controlled(Y), False),
    (("CZ", "cz"), 2, (), lambda: _controlled(Z), False),
    (("SWAP", "swap"), 2, (), lambda: _swapping(4, 1, 2), False),
    (("ISWAP", "iswap"), 2, (), lambda: _swapping(4, 1, 2, 1j), False),
    (("CSWAP", "cswap"), 3, (), lambda: _swapping(8, 5, 6), False),
    (("Toffoli", "toffoli"), 3, (), lambda: _swapping(8, 6, 7), False),
    (("RX", "rx"), 1, ("theta",), rx, False),
    (("RY", "ry"), 1, ("theta",), ry, False),
    (("RZ", "rz"), 1, ("theta",), rz, False),
    (("Rot", "rot"), 1, ("phi", "theta", "omega"), rot, False),
    (("CRX", "crx"), 2, ("theta",), lambda t: _controlled(rx(t)), False),
    (("CRY", "cry"), 2, ("theta",), lambda t: _controlled(ry(t)), False),
    (("CRZ", "crz"), 2, ("theta",), lambda t: _controlled(rz(t)), False),
    (("CRot", "crot"), 2, ("phi", "theta", "omega"), lambda a, b, c: _controlled(rot(a, b, c)), False),
    (("U1", "u1"), 1, ("phi",), lambda phi: np.diag([1, _phase(phi)]), False),
    (("U2", "u2"), 1, ("phi", "lam"), lambda phi, lam: _turn(pi / 2, phi, lam), False),
    (("U3", "u3"), 1, ("theta", "phi", "lam"), _turn, False),
]
for _names, _wires, _params, _matrix, _fock in _CATALOGUE:
    gates.register(_names, GateKind(_names[0], _wires, _params, _matrix, _fock))
