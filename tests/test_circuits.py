"""Gates, states, circuits and programs against numpy state vectors."""

from __future__ import annotations

from math import cos, pi, sin, sqrt

import numpy as np
import pytest

from weftnet.circuits import gates as G
from weftnet.circuits.circuit import Circuit, Operation
from weftnet.circuits.gates import GateKind, Registry, gates
from weftnet.circuits.program import declarations, declared_text, manifest, number, parse, run
from weftnet.circuits.states import State, basis, qubit, qubits, qudit, qudits
from weftnet.operators.blocks import apply_matrix, contract_rows
from weftnet.operators.network import Network
from weftnet.operators.tensor import Tensor


def simulate(wires, steps, dim=2):
    """State vector after steps of (gate, wires), all wires beginning in 0."""
    v = np.zeros((dim,) * wires, complex)
    v[(0,) * wires] = 1
    for gate, on in steps:
        m = gate.matrix().reshape((dim,) * (2 * len(on)))
        v = np.moveaxis(np.tensordot(m, v, (range(len(on), 2 * len(on)), on)), range(len(on)), on)
    return v


def build(wires, steps, dim=2):
    out = Circuit(wires, dim)
    for gate, on in steps:
        out.append_gate(gate, on)
    return out


def ladder(cutoff):
    return np.diag(np.sqrt(np.arange(1, cutoff)), 1).astype(complex)


def expm(m):
    """exp of a matrix by its series after halving."""
    k = max(0, int(np.ceil(np.log2(max(np.abs(m).sum(1).max(), 1)))) + 4)
    x, term, out = m / 2**k, np.eye(len(m), dtype=complex), np.eye(len(m), dtype=complex)
    for n in range(1, 20):
        term = term @ x / n
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


@pytest.mark.parametrize("r", [0.15, 0.45])
def test_fock_gates_are_exponentials(r):
    """Matrix elements against exponentials of ladder operators in a much larger space."""
    big, small, phase = 40, 4, np.exp(0.7j)
    a = ladder(big)
    up = a.conj().T
    assert np.allclose(G.displacement(small, r, 0.7), expm(r * phase * up - r * phase.conjugate() * a)[:small, :small], atol=1e-8)
    z = r * phase
    assert np.allclose(G.squeezing(small, r, 0.7), expm((z.conjugate() * a @ a - z * up @ up) / 2)[:small, :small], atol=1e-8)
    big = 12
    a = np.kron(ladder(big), np.eye(big))
    b = np.kron(np.eye(big), ladder(big))
    pick = [i * big + j for i in range(3) for j in range(3)]
    two = expm(z * a.conj().T @ b.conj().T - z.conjugate() * a @ b)[np.ix_(pick, pick)]
    assert np.allclose(G.two_mode_squeezing(3, r, 0.7), two, atol=1e-4)
    mixed = expm(r * (phase * a @ b.conj().T - phase.conjugate() * a.conj().T @ b))[np.ix_(pick, pick)]
    assert np.allclose(G.beamsplitter(3, r, 0.7), mixed, atol=1e-8)


def test_gates_are_unitary():
    for name, kind in gates.kinds.items():
        if not kind.fock:
            m = gates.create(name, *[0.3 + 0.4 * k for k in range(len(kind.params))]).matrix()
            assert np.allclose(m @ m.conj().T, np.eye(len(m))), name
    assert len(gates.kinds) == 78 and len(set(gates.kinds.values())) == 31


def test_rotations_agree():
    t = 0.7
    assert np.allclose(G.rot(0, t, 0), G.ry(t)) and np.allclose(G.rot(t, 0, 0), G.rz(t))
    assert np.allclose(G.rot(pi / 2, t, -pi / 2), G.rx(t))
    assert np.allclose(gates.create("U3", t, 0, 0).matrix(), G.ry(t))
    assert np.allclose(gates.create("SX").matrix() @ gates.create("SX").matrix(), G.X)
    assert np.allclose(gates.create("T").matrix() @ gates.create("T").matrix(), gates.create("S").matrix())


def test_registry():
    m = gates.create("CRot", 0.2, 0.5, 0.9).matrix()
    assert np.allclose(gates.create("CRot", 0.2, 0.5, 0.9, adjoint=True, scalar=2 + 1j).matrix(), (2 + 1j) * m.conj().T)
    assert np.allclose(gates.create("Rot", phi=0.1, theta=0.2, omega=0.3).matrix(), G.rot(0.1, 0.2, 0.3))
    assert gates.create("H") == gates.create("hadamard") and gates.create("H") != gates.create("X")
    own = Registry()
    kind = own.register(["Still"], GateKind("Still", 1, [], lambda: np.eye(2)))
    with pytest.raises(KeyError):
        own.register(["Still"], kind)
    own.unregister(kind)
    with pytest.raises(KeyError):
        own.create("Still")
    for wrong in (lambda: gates.create("CRX"), lambda: gates.create("U2", lam=1)):
        with pytest.raises(TypeError):
            wrong()
    for wrong in (lambda: gates.create("CZ", dim=4), lambda: gates.create("BS", 1, 2, dim=1)):
        with pytest.raises(ValueError):
            wrong()


def test_adjoint_of_two_wires():
    g = gates.create("BS", 0.3, 0.4, dim=4)
    assert np.allclose(g.adjoint().matrix(), g.matrix().conj().T)


def test_states(spark):
    assert qudit(5).tensor(spark).data() == [1, 0, 0, 0, 0]
    assert qubits(3).tensor(spark, ["a", "b", "c"]).data() == [1] + [0] * 7
    assert qudits(3, 2).dim == 3 and qubit([0, 1]) == basis(2, 1) and qubit() != basis(2, 1)
    with pytest.raises(ValueError):
        State("x", 2, [1, 0, 0])


STEPS = [(gates.create("RY", 0.4), [0]), (gates.create("H"), [2]), (gates.create("CRX", 1.1), [0, 1]), (gates.create("T"), [1]), (gates.create("ISWAP"), [1, 2]), (gates.create("CZ"), [2, 0])]


def test_circuit(spark):
    c, v = build(3, STEPS), simulate(3, STEPS)
    assert c.open_labels == ["0-3", "1-3", "2-3"]
    assert np.allclose(c.amplitudes(spark).data(), v.ravel())
    assert np.allclose(c.amplitudes(spark, samples=5).data(), v.ravel())
    assert abs(c.amplitude(spark, [1, 0, 1]) - v[1, 0, 1]) < 1e-12
    assert np.allclose([r["probability"] for r in c.probabilities(spark).orderBy("position").collect()], np.abs(v.ravel()) ** 2)
    z0, x2 = Operation(gates.create("Z"), (0,)), Operation(gates.create("X"), (2,))
    after = simulate(3, [*STEPS, (z0.part, [0]), (x2.part, [2])])
    both = np.vdot(v, after)
    assert abs(c.expectation(spark, [z0, x2]) - both) < 1e-12
    alone = np.vdot(v, simulate(3, [*STEPS, (z0.part, [0])]))
    assert abs(c.expectation_of_sum(spark, [(0.5, [z0, x2]), (2j, [z0])]) - (0.5 * both + 2j * alone)) < 1e-12
    assert Circuit(1).amplitudes(spark).data() == [1, 0]


def test_circuit_refuses(spark):
    c = build(2, STEPS[:1])
    for gate, on in ((gates.create("Y"), [5]), (gates.create("SWAP"), [1, 1]), (gates.create("CY"), [1]), (gates.create("Squeezing", 1, 0, dim=3), [0])):
        with pytest.raises(ValueError):
            c.append_gate(gate, on)
    with pytest.raises(ValueError, match="values"):
        c.append_state(qudit(3), [0])
    c.append_state(qubit(), [0])
    with pytest.raises(ValueError, match="closed"):
        c.append_gate(gates.create("X"), [0])


def test_precision(spark):
    c = build(2, [(gates.create("RX", 0.3), [0]), (gates.create("CX"), [0, 1])])
    t = c.amplitudes(spark, precision="complex64")
    assert dict(t.df.dtypes)["re"] == "float" and np.allclose(t.data(), simulate(2, [(gates.create("RX", 0.3), [0]), (gates.create("CX"), [0, 1])]).ravel(), atol=1e-6)
    low = run(spark, "RY(0.3) | [0]; amplitude(state: [0]) | [0];", precision="float")[0]
    assert low == np.float32(cos(0.15)) and low != cos(0.15)
    assert dict(c.probabilities(spark, precision="float").dtypes)["probability"] == "float"
    with pytest.raises(TypeError):
        c.amplitudes(spark, precision="int8")


def test_programs(spark):
    """Output statements in their order, on qubits and on modes."""
    steps = [(gates.create("RX", 0.9), [0]), (gates.create("CRZ", 0.4), [0, 1]), (gates.create("U2", 0.2, 0.6), [1])]
    v = simulate(2, steps)
    out = run(spark, "use <anything>; RX(0.9) | [0]; CRZ(0.4) | [0, 1]; U2(phi: 0.2, lam: 0.6) | [1]; amplitude(state: [1, 0]) | [0, 1]; probabilities | [0, 1]; Amplitude(state: [0, 1]) | [0, 1];")
    assert np.allclose([out[0], out[2]], [v[1, 0], v[0, 1]]) and np.allclose(out[1], np.abs(v.ravel()) ** 2)
    steps = [(gates.create("Squeezing", 0.4, 0.1, dim=4), [1]), (gates.create("D", 0.3, 1.2, dim=4), [0]), (gates.create("BS", 0.5, 0.2, dim=4), [0, 1])]
    v = simulate(2, steps, 4)
    out = run(spark, "options: dimension: 4; end; Squeezing(0.4, 0.1) | [1]; D(0.3, 1.2) | [0]; BS(0.5, 0.2) | [0, 1]; amplitude(state: [3, 1]) | [0, 1]; amplitude(state: [0, 2]) | [0, 1];")
    assert np.allclose(out, [v[3, 1], v[0, 2]])


def test_own_gates_and_observables(spark):
    text = "gate Lean(a)[w]: RY(a / 2) | [w]; end; gate Row(a, b)[u, v]: Lean(b) | [u]; Lean(a: a) | [v]; CX | [v, u]; end; Row(b: 0.8, a: pi/3) | [1, 0];"
    v = simulate(2, [(gates.create("RY", 0.4), [1]), (gates.create("RY", pi / 6), [0]), (gates.create("CX"), [0, 1])])
    out = run(spark, text + " amplitude(state: [1, 1]) | [0, 1]; probabilities | [0, 1];")
    assert np.allclose(out[0], v[1, 1]) and np.allclose(out[1], np.abs(v.ravel()) ** 2)
    # terms are multiplied, and each factor scales its operators
    text = "obs Skew[p, q]: 0.5, Z[p]; -4, Z[q]; end; RY(0.6) | [0]; RY(1.4) | [1]; expval(observable: Skew) | [0, 1];"
    assert np.allclose(run(spark, text), [-2 * cos(0.6) * cos(1.4)])
    text = "obs Side[p]: 1, X[p]; end; obs Other[p]: sqrt(9), Y[p]; end; RY(0.6) | [0]; RZ(0.3) | [0]; expval(observable: Side) | [0]; expval(observable: Other) | [0];"
    assert np.allclose(run(spark, text), [sin(0.6) * cos(0.3), 3 * sin(0.6) * sin(0.3)])


@pytest.mark.parametrize(
    ("text", "match"),
    [
        ("T | [0]; amplitude | [0];", "which state"),
        ("T | [1]; amplitude(state: [1, 3]) | [0, 1];", "go from 0 to 1"),
        ("T | [0]; amplitude(state: [1, 1, 0]) | [0];", "3 values for 1 wires"),
        ("CZ | [0, 1]; probabilities | [1];", "all wires in their order"),
        ("CZ | [0, 1]; amplitude(state: [0, 1]) | [1, 0];", "all wires in their order"),
        ("gate Loop[w]: S | [w]; Loop | [w]; end; Loop | [0];", "contains itself: Loop"),
        ("gate One[w]: Two | [w]; end; gate Two[w]: Three | [w]; end; gate Three[w]: Two | [w]; end; One | [0];", "contains itself: One > Two > Three"),
        ("gate Outer[w]: Inner | [w]; end; Outer | [0];", "no gate 'Inner'"),
        ("gate Plain[w]: S | [w]; end; Plain(1, 2) | [0];", "takes 0 parameters"),
        ("gate Bend(angle)[w]: RZ(angle) | [w]; end; Bend(turn: 1) | [0];", "names \\['turn'\\]"),
        ("gate Couple[u, v]: CY | [u, v]; end; Couple | [0, 1, 2];", "takes 2 wires"),
        ("S | [0]; expval | [0];", "which observable"),
        ("S | [0]; expval(observable: Nowhere) | [0];", "no observable 'Nowhere'"),
        ("obs Empty[w]; S | [0]; expval(observable: Empty) | [0];", "no observable 'Empty'"),
        ("obs Free(k)[w]: k, Z[w]; end; S | [0]; expval(observable: Free) | [0];", "has parameters"),
        ("obs Wide[u, v]: 1, Z[u]; 1, Z[v]; end; S | [0]; expval(observable: Wide) | [0];", "has 2 wires, not 1"),
        ("obs Odd[w]: much, Z[w]; end; S | [0]; expval(observable: Odd) | [0];", "'much' of the term"),
        ("measure | [0];", "neither a gate nor an output"),
        ("options: dimension: 0; end;", "2 values at least"),
        ("options: dimension: two; end;", "no whole number"),
        ("options: dimension: 4; end; RX(1) | [0];", "in 'RX\\(1\\) \\| \\[0\\]': RX acts on wires of 2 values"),
        ("options: dimension: 3; end; obs Q[w]: 1, Z[w]; end; D(1, 0) | [0]; expval(observable: Q) | [0];", "acts on wires of 2 values"),
        ("S | [0]", "no end"),
        ("S [0];", "can't read"),
    ],
)
def test_program_errors(spark, text, match):
    with pytest.raises(ValueError, match=match):
        run(spark, text)


def test_program_parts(spark):
    assert number("-pi/2 + sin(0) + 2**3", {}) == pytest.approx(8 - pi / 2)
    with pytest.raises(ValueError):
        number("__import__('os')", {})
    assert parse("gate G: X | [a]; end;").gates["G"].wires == ["a"]
    with pytest.warns(UserWarning, match="colour"):
        assert run(spark, "options: colour: red; end;") == []


def test_declarations(spark):
    found = declarations()
    assert len(found) == 84 and [d.kind for d in found] == ["gate"] * 78 + ["out"] * 6
    by = {d.name: str(d) for d in found}
    assert by["CRot"] == "gate CRot(phi, theta, omega)[0, 1];" and by["T"] == "gate T[0];" and by["probabilities"] == "out probabilities;"
    own = Registry()
    own.register(["Nudge", "nudge"], GateKind("Nudge", 3, ["by"], lambda by: np.eye(8)))
    assert declared_text(own).splitlines()[:2] == ["gate Nudge(by)[0, 1, 2];", "gate nudge(by)[0, 1, 2];"]
    assert manifest(spark).filter("kind = 'gate'").count() == 78
    assert not parse(declared_text()).gates  # declarations define nothing new
    out = run(spark, declared_text() + " RY(0.2) | [0]; amplitude(state: [1]) | [0];")
    assert np.allclose(out, [sin(0.1)])


def test_gates_on_rows(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3, 8))
    df = spark.createDataFrame([(k, row.tolist(), [0.0] * 8) for k, row in enumerate(x)], "k int, a array<double>, b array<double>")
    gate = gates.create("CRot", 0.1, 0.2, 0.3)
    re, im = apply_matrix(df["a"], df["b"], [2, 2, 2], [2, 0], gate.matrix())
    got = {r["k"]: np.array(r["re"]) + 1j * np.array(r["im"]) for r in df.select("k", re.alias("re"), im.alias("im")).collect()}
    m = gate.matrix().reshape(2, 2, 2, 2)
    for k in range(3):
        want = np.einsum("cadb,bxd->axc", m, x[k].reshape(2, 2, 2))
        assert np.allclose(got[k], want.ravel())
    n = Network()
    n.add(gates.create("H").tensor(spark, ["o", "i"]))
    out = contract_rows(df, "a", ["i", "j", "l"], [2, 2, 2], n, ["k"]).collect()
    for row in out:
        want = np.einsum("ijl,oi->jlo", x[row["k"]].reshape(2, 2, 2), gates.create("H").matrix())
        assert np.allclose(np.array(row["re"]), want.ravel().real)
    wide = Network()
    for k in range(6):  # the intermediates would have 2**30 places: refused before any data is read
        wide.add(Tensor(spark.range(1).selectExpr("id AS x0", "raise_error('read') AS re", "0D AS im"), (f"w{k}",), (32,)))
    with pytest.raises(ValueError, match="too large"):
        contract_rows(df, "a", ["i", "j", "l"], [2, 2, 2], wide, ["k"])
    assert Tensor.scalar_of(spark, 1).scalar() == sqrt(1)
