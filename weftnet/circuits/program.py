"""Programs: a small text form of circuits, and their results.

    use <name>;  out name;               ignored
    options: dimension: 3; end;          values a wire
    gate Name(a, b)[x, y]: RX(a) | [x]; end;
    obs Name[x]: 1, Z[x]; end;
    RX(pi/2) | [0];  Name(a: 1, b: 2) | [0, 1];
    amplitude(state: [0, 1]) | [0, 1];  probabilities | [0, 1];  expval(observable: Name) | [0, 1];

Output statements give results in their order. The terms of an observable are multiplied, and each
term's factor scales each of its operators.
"""

from __future__ import annotations

import ast
import math
import operator
import re
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weftnet.circuits.circuit import Circuit, Operation
from weftnet.circuits.gates import Registry, gates

#: Names of output statements.
OUTPUTS = ["Amplitude", "amplitude", "Expval", "expval", "Probabilities", "probabilities"]
_FUNCTIONS = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "exp": math.exp, "sqrt": math.sqrt, "abs": abs}
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}


@dataclass
class Statement:
    name: str
    args: list[str] = field(default_factory=list)
    named: dict[str, str] = field(default_factory=dict)
    wires: list[str] = field(default_factory=list)
    text: str = ""


@dataclass
class Definition:
    name: str
    params: list[str]
    wires: list[str] | None
    body: list = field(default_factory=list)


@dataclass
class Program:
    options: dict[str, str] = field(default_factory=dict)
    gates: dict[str, Definition] = field(default_factory=dict)
    observables: dict[str, Definition] = field(default_factory=dict)
    statements: list[Statement] = field(default_factory=list)


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks outside brackets."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "([") - (c in ")]")
        if c == mark and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() or out else []


def number(text: str, values: dict[str, float]) -> float:
    """Value of an arithmetic expression with names and pi."""
    names = {"pi": math.pi, "PI": math.pi} | values

    def value(node) -> float:
        match node:
            case ast.Expression():
                return value(node.body)
            case ast.Constant(value=int() | float() as x):
                return x
            case ast.Name(id=n) if n in names:
                return names[n]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return value(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](value(a), value(b))
            case ast.Call(func=ast.Name(id=f), args=args) if f in _FUNCTIONS:
                return _FUNCTIONS[f](*map(value, args))
        raise ValueError(f"{text!r} is not a number")

    try:
        return value(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"{text!r} is not a number") from e


_HEAD = re.compile(r"^(?P<name>\w+)\s*(?:\((?P<params>.*?)\))?\s*(?:\[(?P<wires>[^\]]*)\])?\s*$", re.DOTALL)


def statement(text: str) -> Statement:
    """name(args) | [wires]"""
    head, bar, tail = text.partition("|")
    m = re.match(r"^\s*(\w+)\s*(?:\((.*)\))?\s*$", head, re.DOTALL)
    if not m or not bar or not re.fullmatch(r"\s*\[.*\]\s*", tail, re.DOTALL):
        raise ValueError(f"can't read the statement {text.strip()!r}")
    out = Statement(m[1], wires=split_top(tail.strip()[1:-1]))
    for part in split_top(m[2] or ""):
        key = re.match(r"^(\w+)\s*:\s*(.+)$", part, re.DOTALL)
        if key:
            out.named[key[1]] = key[2].strip()
        else:
            out.args.append(part)
    shown = ", ".join([*out.args, *(f"{k}: {v}" for k, v in out.named.items())])
    out.text = f"{out.name}{f'({shown})' if shown else ''} | [{', '.join(out.wires)}]"
    return out


def parse(text: str) -> Program:
    out = Program()
    text = re.sub(r"//[^\n]*", "", text)
    at = 0
    while (rest := text[at:]).strip():
        at += len(rest) - len(rest.lstrip())
        rest = text[at:]
        block = re.match(r"(options\s*:|gate\b([^:;]*)([:;])|obs\b([^:;]*)([:;]))", rest)
        if not block:
            stop = rest.find(";")
            if stop < 0:
                raise ValueError(f"a statement has no end: {rest.strip()!r}")
            if not re.match(r"(use|out)\b", rest):
                out.statements.append(statement(rest[:stop]))
            at += stop + 1
            continue
        body = ""
        if block[1][-1] == ":":
            end = re.search(r"\bend\s*;", rest[block.end() :])
            if not end:
                raise ValueError(f"a block has no end: {block[1]!r}")
            body = rest[block.end() : block.end() + end.start()]
            at += block.end() + end.end()
        else:
            at += block.end()
        lines = [x.strip() for x in body.split(";") if x.strip()]
        if block[1].startswith("options"):
            out.options |= {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            continue
        is_gate = block[1].startswith("gate")
        m = _HEAD.match((block[2] if is_gate else block[4]).strip())
        if not m:
            raise ValueError(f"can't read the definition {block[1]!r}")
        d = Definition(m["name"], split_top(m["params"] or ""), None if m["wires"] is None else split_top(m["wires"]))
        if is_gate and block[1][-1] == ";" and d.name in gates.kinds:
            continue  # a declaration of what is there already
        if is_gate:
            d.body = [statement(x) for x in lines]
            if d.wires is None:
                d.wires = list(dict.fromkeys(w for s in d.body for w in s.wires))
            out.gates[d.name] = d
        else:
            for x in lines:
                factor, _, terms = x.partition(",")
                d.body.append((factor.strip(), re.findall(r"(\w+)\s*\[\s*(\w+)\s*\]", terms), x))
            if d.wires is None:
                d.wires = list(dict.fromkeys(w for _, terms, _ in d.body for _, w in terms))
            out.observables[d.name] = d
    return out


@dataclass(frozen=True)
class Declaration:
    """What a program may use: a gate with its parameters and number of wires, or an output."""

    kind: str
    name: str
    params: tuple[str, ...] = ()
    wires: int | None = None

    def __str__(self) -> str:
        shown = f"({', '.join(self.params)})" if self.params else ""
        return f"{self.kind} {self.name}{shown}{'' if self.wires is None else str(list(range(self.wires)))};"


def declarations(registry: Registry = gates) -> list[Declaration]:
    """Declarations of all gates of a registry by name, then of the outputs."""
    found = [Declaration("gate", n, k.params, k.wires) for n, k in sorted(registry.kinds.items())]
    return found + [Declaration("out", n) for n in sorted(OUTPUTS)]


def declared_text(registry: Registry = gates) -> str:
    """The declarations as a program, one a line; `parse` reads it."""
    return "\n".join(map(str, declarations(registry)))


def manifest(spark: SparkSession, registry: Registry = gates) -> DataFrame:
    """The declarations as rows: kind, name, params, wires, text."""
    rows = [(d.kind, d.name, list(d.params), d.wires, str(d)) for d in declarations(registry)]
    return spark.createDataFrame(rows, "kind string, name string, params array<string>, wires int, text string")


def _expand(program: Program, s: Statement, values: dict[str, float], wires: dict[str, str], above: tuple[str, ...]) -> Iterator[Statement]:
    """Statements of registered gates, with numbers and whole wires."""
    bound = Statement(s.name, [repr(number(a, values)) for a in s.args], {k: repr(number(v, values)) for k, v in s.named.items()}, [wires.get(w, w) for w in s.wires], s.text)
    d = program.gates.get(s.name)
    if d is None:
        if s.name not in gates.kinds:
            raise ValueError(f"no gate {s.name!r} to use in {s.text!r}")
        yield bound
        return
    if s.name in above:
        raise ValueError(f"the gate {s.name!r} contains itself: {' > '.join([*above, s.name])}")
    if bound.named and not bound.args:
        if set(bound.named) != set(d.params):
            raise ValueError(f"{s.name!r} has parameters {d.params}, {s.text!r} names {sorted(bound.named)}")
        inner = {k: float(v) for k, v in bound.named.items()}
    else:
        if len(bound.args) != len(d.params) or bound.named:
            raise ValueError(f"{s.name!r} takes {len(d.params)} parameters, unlike {s.text!r}")
        inner = dict(zip(d.params, map(float, bound.args), strict=True))
    if len(bound.wires) != len(d.wires or []):
        raise ValueError(f"{s.name!r} takes {len(d.wires or [])} wires, unlike {s.text!r}")
    onto = dict(zip(d.wires or [], bound.wires, strict=True))
    for x in d.body:
        yield from _expand(program, x, inner, onto, (*above, s.name))


def _dimension(options: dict[str, str]) -> int:
    for k in options:
        if k != "dimension":
            warnings.warn(f"unknown option {k!r}, left out", stacklevel=3)
    text = options.get("dimension", "2")
    if not re.fullmatch(r"[+-]?\d+", text):
        raise ValueError(f"the dimension {text!r} is no whole number")
    if int(text) < 2:
        raise ValueError(f"wires have 2 values at least, not {text}")
    return int(text)


def _gate(x: Statement, dim: int, **how):
    """A registered gate; gates of any dimension take the circuit's."""
    return gates.create(x.name, *map(float, x.args), dim=dim if gates.kinds[x.name].fock else 2, **how, **{k: float(v) for k, v in x.named.items()})


def run(spark: SparkSession, program: Program | str, **how) -> list:
    """Results of the output statements: complex numbers, or lists of probabilities.

    `precision`, `samples` and `seed` go on to the contraction.
    """
    program = parse(program) if isinstance(program, str) else program
    dim = _dimension(program.options)
    circuit, out = _build(program, dim), []
    for s in program.statements:
        if s.name not in OUTPUTS:
            for x in _expand(program, s, {}, {}, ()):
                try:
                    circuit.append_gate(_gate(x, dim), [int(w) for w in x.wires])
                except ValueError as e:
                    raise ValueError(f"in {x.text!r}: {e}") from e
            continue
        every = [str(w.id) for w in circuit.wires]
        kind = s.name.lower()
        if kind == "amplitude":
            state = _state(s, dim)
            _on_every(s, every)
            out.append(circuit.amplitude(spark, state, **how))
        elif kind == "probabilities":
            _on_every(s, every)
            out.append([r["probability"] for r in circuit.probabilities(spark, **how).orderBy("position").collect()])
        else:
            out.append(circuit.expectation(spark, _observable(program, s, every, dim), **how))
    return out


def _on_every(s: Statement, every: Sequence[str]) -> None:
    if s.wires != list(every):
        raise ValueError(f"{s.text!r} needs all wires in their order, [{', '.join(every)}]")


def _build(program: Program, dim: int) -> Circuit:
    """A circuit with the wires that statements use."""
    used = [int(w) for s in program.statements for w in s.wires if w.isdigit()]
    for s in program.statements:
        if s.name not in OUTPUTS and s.name not in program.gates and s.name not in gates.kinds:
            raise ValueError(f"{s.text!r} is neither a gate nor an output")
        if s.name in program.gates or s.name in gates.kinds:
            list(_expand(program, s, {}, {}, ()))
    return Circuit(max(used, default=-1) + 1, dim)


def _state(s: Statement, dim: int) -> list[int]:
    text = s.named.get("state")
    if text is None:
        raise ValueError(f"{s.text!r} doesn't say which state")
    state = [int(x) for x in split_top(text.strip()[1:-1])]
    if len(state) != len(s.wires):
        raise ValueError(f"{s.text!r}: a state of {len(state)} values for {len(s.wires)} wires")
    if any(not 0 <= x < dim for x in state):
        raise ValueError(f"{s.text!r}: the values of a state go from 0 to {dim - 1}")
    return state


def _observable(program: Program, s: Statement, every: Sequence[str], dim: int) -> list[Operation]:
    name = s.named.get("observable")
    if name is None:
        raise ValueError(f"{s.text!r} doesn't say which observable")
    d = program.observables.get(name)
    if d is None or not d.body:
        raise ValueError(f"there is no observable {name!r} with terms")
    if d.params:
        raise ValueError(f"the observable {name!r} has parameters, which an output can't give")
    _on_every(s, every)
    if len(d.wires or []) != len(s.wires):
        raise ValueError(f"the observable {name!r} has {len(d.wires or [])} wires, not {len(s.wires)}")
    onto, out = dict(zip(d.wires or [], s.wires, strict=True)), []
    for factor, terms, text in d.body:
        try:
            scalar = number(factor, {})
        except ValueError as e:
            raise ValueError(f"the factor {factor!r} of the term {text!r} is no number") from e
        out += [Operation(_gate(Statement(g), dim, scalar=scalar), (int(onto[w]),)) for g, w in terms]
    return out
