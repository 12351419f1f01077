from __future__ import annotations

import time

import numpy as np
import pytest

from weftnet.operators import blocks
from weftnet.operators.network import Network
from weftnet.operators.tensor import Tensor
from weftnet.plans import lower
from weftnet.plans.lower import TaskGraph, contract_each_slice, contract_sliced
from weftnet.plans.path import Leaf, PathPlan, best_path, greedy_path, sample_costs, sampled_path
from weftnet.sources import network_json


def seq(spark, labels, dims, im=2.0):
    return Tensor.from_data(spark, labels, dims, [complex(k, im * k) for k in range(int(np.prod(dims)))])


def net(spark, *parts, im=2.0):
    out = Network()
    for labels, dims in parts:
        out.add(seq(spark, labels, dims, im))
    return out


def dense(t):
    return np.array(t.data()).reshape(t.dims)


def test_explicit_path(spark):
    n = net(spark, (["u", "v"], [3, 2]), (["w", "v", "x"], [2, 2, 4]), (["x", "y"], [4, 3]), (["w"], [2]))
    want = np.einsum("uv,wvx,xy,w->uy", *(dense(k.tensor) for k in n.nodes))
    t = n.contract([(2, 1), (3, 4), (0, 5)])
    assert t.labels == ("u", "y") and np.array_equal(dense(t), want)
    assert np.array_equal(dense(n.contract().transpose(["u", "y"])), want)


def test_slices(spark):
    n = net(spark, (["u", "v", "w"], [4, 2, 3]), (["w"], [3]))
    x, y = (dense(k.tensor) for k in n.nodes)
    n.slice(["w", "u"], 2 * 4 + 3)
    assert [k.name for k in n.nodes] == ["u(3)vw(2)", "w(2)"]
    assert np.array_equal(dense(n.nodes[0].tensor), x[3, :, 2]) and n.nodes[1].tensor.scalar() == y[2]
    assert set(n.edges()) == {"v"}
    with pytest.raises(ValueError, match="no node has the label"):
        n.slice(["q"], 0)


def test_metadata(spark):
    n = Network()
    assert [n.add(seq(spark, list(x), d), t) for x, d, t in (("uv", [4, 5], ["one"]), ("vwx", [5, 1, 2], ["two", "one"]), ("x", [2], []))] == [0, 1, 2]
    assert n.edges() == {"u": (4, [0]), "v": (5, [0, 1]), "x": (2, [1, 2])}
    assert n.tags() == {"one": [0, 1], "two": [1]}
    assert (n.n_tensors, n.n_labels) == (3, 3)
    assert {r["label"]: (r["dim"], r["node_ids"]) for r in n.edge_table(spark).collect()} == n.edges()
    assert n.contract_nodes(1, 2) == 3 and n.nodes[3].name == "vw" and n.nodes[3].tags == ["two", "one"]
    assert n.edges() == {"u": (4, [0]), "v": (5, [0, 3])} and n.copy().edges() == n.edges()
    with pytest.raises(ValueError, match="can't contract"):
        n.contract_nodes(1, 3)


def test_errors(spark):
    with pytest.raises(ValueError, match="no tensors"):
        Network().contract()
    n = net(spark, (["a"], [2]), (["a"], [2]))
    for path in ([(0, 2)], [(0, 0)], [(0, 1), (0, 2)]):
        with pytest.raises(ValueError):
            n.contract(path)
    with pytest.raises(ValueError, match="on 3 nodes"):
        net(spark, (["a"], [2]), (["a"], [2]), (["a"], [2])).contract()
    with pytest.raises(ValueError, match="values on node"):
        net(spark, (["a"], [2]), (["a"], [3]))
    with pytest.raises(ValueError, match="connected"):
        net(spark, (["a"], [2]), (["b"], [2])).contract(outer=False)


def leaf(*labels):
    return Leaf(list(labels), list(labels), [])


@pytest.mark.parametrize(("left", "right"), [("", ""), ("u", ""), ("uv", "vw"), ("uvw", "wvu"), ("u", "v")])
def test_step_flops(left, right):
    """The size of the result times two operations for every summed value."""
    dims = {"u": 3, "v": 4, "w": 7}
    free, shared = set(left) ^ set(right), set(left) & set(right)
    plan = PathPlan([leaf(*left), leaf(*right)], dims, [(1, 0)])
    assert plan.step_flops(2) == np.prod([dims[x] for x in free]) * 2 * np.prod([dims[x] for x in shared])
    assert plan.step_flops(0) == plan.step_flops(1) == 0
    assert plan.memory() == sum(np.prod([dims[x] for x in part]) for part in (left, right, free))


def test_plans(spark):
    leaves, dims = [leaf("u", "v"), leaf("v", "w"), leaf("w", "x", "y"), leaf("y")], {"u": 5, "v": 2, "w": 6, "x": 3, "y": 4}
    plan = PathPlan(leaves, dims, [(2, 3), (1, 4), (0, 5)])
    assert plan.flops() == 6 * 3 * 2 * 4 + 2 * 3 * 2 * 6 + 5 * 3 * 2 * 2
    assert plan.steps[4].name == "wx" and plan.steps[2].parent == 4 and plan.steps[6].contracted == ["v"] and plan.open_nodes() == [6]
    for seed in range(5):
        assert len(sampled_path(leaves, seed)) == 3 and sampled_path(leaves, seed) == sampled_path(leaves, seed)
    assert PathPlan(leaves, dims, best_path(leaves, dims, 20)).flops() <= PathPlan(leaves, dims, greedy_path(leaves, dims)).flops()
    assert sample_costs(spark, leaves, dims, 5).count() == 5
    loose = [leaf("a"), leaf("b"), leaf("a")]
    assert PathPlan(loose, {"a": 2, "b": 2}, sampled_path(loose, 1)).steps[-1].labels == ["b"]


def slow_greedy(leaves, dims):
    """The same choice by looking at all pairs at every step."""
    sets, path, new = {k: frozenset(x.labels) for k, x in enumerate(leaves)}, [], len(leaves)
    size = lambda labels: int(np.prod([dims[x] for x in labels], dtype=object))
    while len(sets) > 1:
        pairs = [(a, b) for a in sorted(sets) for b in sorted(sets) if a < b]
        near = [p for p in pairs if sets[p[0]] & sets[p[1]]]
        a, b = min(near or pairs, key=lambda p: (size(sets[p[0]] ^ sets[p[1]]), size(sets[p[0]] | sets[p[1]]), p))
        path.append((a, b))
        sets[new] = sets.pop(a) ^ sets.pop(b)
        new += 1
    return path


@pytest.mark.parametrize("seed", range(6))
def test_greedy_path_is_the_greedy_choice(seed):
    r = np.random.default_rng(seed)
    leaves = [[] for _ in range(14)]
    dims = {f"e{k}": int(r.integers(1, 5)) for k in range(18)}
    for x in dims:
        for k in r.choice(14, r.integers(1, 3), replace=False):
            leaves[k].append(x)
    leaves = [leaf(*x) for x in leaves]
    assert greedy_path(leaves, dims) == slow_greedy(leaves, dims)


def test_planners_on_a_large_grid():
    """1,024 nodes on a grid are planned in seconds."""
    n, on = 32, {}
    for i in range(n):
        for j in range(n):
            for x in ([f"r{i},{j}"] if j + 1 < n else []) + ([f"r{i},{j - 1}"] if j else []) + ([f"d{i},{j}"] if i + 1 < n else []) + ([f"d{i - 1},{j}"] if i else []):
                on.setdefault((i, j), []).append(x)
    leaves = [leaf(*x) for x in on.values()]
    dims = {x: 2 for labels in on.values() for x in labels}
    began = time.time()
    for path in (greedy_path(leaves, dims), sampled_path(leaves, 3)):
        assert len(path) == n * n - 1 and len({k for p in path for k in p}) == 2 * (n * n - 1)
    assert time.time() - began < 10


def test_task_graph(spark, tmp_path):
    n = net(spark, (["m"], [5]), (["m", "n"], [5, 2]), (["n", "z"], [2, 4]), im=0)
    graph, plan = TaskGraph(), n.plan([(0, 1), (3, 2)])
    assert [graph.add(n, plan), graph.add(n, plan)] == [0, 1]
    assert (graph.flops, graph.memory) == (2 * 2 * 5 + 2 * 4 * 2 * 2, 2 + 2 * 4)
    assert graph.hold() == 1
    want = np.einsum("m,mn,nz->z", *(dense(k.tensor) for k in n.nodes))
    assert np.array_equal(dense(graph.results[0]), want) and np.array_equal(dense(graph.reduce()), 2 * want)
    graph.release()
    other = TaskGraph()
    other.add(n, n.plan([(1, 2), (0, 3)]))
    other.include(graph)
    assert len(other.results) == 3 and np.array_equal(dense(other.reduce()), 3 * want)
    assert set(graph.edges) <= set(other.edges) and other.flops != graph.flops
    assert other.submit()[0].result()[0].asDict().keys() == {"x0", "re", "im"}
    assert other.dot().count("->") == len(other.edges)
    cut = TaskGraph(cut_steps=1)
    cut.add(n, plan)
    assert np.array_equal(dense(cut.results[0]), want)
    assert "Join" not in cut.results[0].df._jdf.queryExecution().optimizedPlan().toString()


def test_large_results_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lower, "MOST_ROWS", 3)
    assert len(lower.rows_of(spark.range(3))) == 3
    with pytest.raises(ValueError, match="another action"):
        lower.rows_of(spark.range(4))


def test_slice_sum_is_whole(spark):
    n = net(spark, (["a", "b"], [2, 3]), (["b", "c"], [3, 2]), (["c", "d"], [2, 2]))
    whole = n.contract().transpose(["a", "d"]).data()
    assert contract_sliced(n, ["b", "c"]).transpose(["a", "d"]).data() == whole
    assert contract_each_slice(n, ["b"], range(3), [(0, 1), (2, 3)]).reduce().transpose(["a", "d"]).data() == whole
    assert blocks.contract_slices(n, ["b", "c"]).transpose(["a", "d"]).data() == whole
    assert blocks.contract_slices(n, []).transpose(["a", "d"]).data() == whole


DOC = '{"path": [[2,0],[1,3]], "tensors": [[["grid","odd"],["v","u"],[3,2],[[0,1],[2,0],[-1,0],[0,0.5],[4,0],[0,0]]],[[],["w","u"],[2,2],[[1,0],[2,0],[3,0],[4,0]]],[["end"],["v"],[3],[[5,0],[0,-6],[7,0]]]]}'


def test_json(spark):
    n, path = network_json.load_network(spark, DOC)
    grid = np.array([1j, 2, -1, 0.5j, 4, 0])
    assert path == [(2, 0), (1, 3)] and n.nodes[0].tags == ["grid", "odd"]
    assert n.nodes[0].tensor.data() == grid.tolist()
    assert np.allclose(n.contract(path).data(), np.einsum("vu,wu,v->w", grid.reshape(3, 2), [[1, 2], [3, 4]], [5, -6j, 7]))
    again, path = network_json.load_network(spark, network_json.dump_network(n, path, indent=2))
    assert path == [(2, 0), (1, 3)]
    assert all(a.tensor.equals(b.tensor) and a.tags == b.tags for a, b in zip(n.nodes, again.nodes, strict=True))
    assert network_json.load_network(spark, network_json.dump_network(n))[1] is None
    other, _ = network_json.load_network(spark, DOC, column_major=True)
    assert other.nodes[0].tensor.labels == ("u", "v")
    assert np.array_equal(dense(other.nodes[0].tensor.transpose(["v", "u"])), grid.reshape((3, 2), order="F"))
    scanned = network_json.scan_networks(spark.createDataFrame([(7, DOC)], "doc int, value string"), keys=["doc"])
    assert network_json.entries(scanned).count() == 13


@pytest.mark.parametrize(
    ("text", "error", "match"),
    [
        ("{", network_json.NetworkSyntaxError, "not JSON"),
        ("[]", network_json.NetworkStructureError, "object"),
        ("{}", network_json.NetworkStructureError, "tensors"),
        ('{"tensors": [[[], ["i"], [1]]]}', network_json.NetworkStructureError, "tensor 0"),
        ('{"tensors": [[[], ["i"], [2], [[1,0],[1]]]]}', network_json.NetworkStructureError, "element 1 of tensor 0"),
        ('{"tensors": [[[], ["i"], [2], [[1,0]]]]}', network_json.NetworkStructureError, "values"),
        ('{"path": [[1]], "tensors": []}', network_json.NetworkStructureError, "path"),
    ],
)
def test_json_errors(spark, text, error, match):
    with pytest.raises(error, match=match):
        network_json.load_network(spark, text)


def test_scan_errors(spark):
    for text in ("[]", '{"tensors": [[[], ["i"], [2], [[1,0],[1]]]]}'):
        with pytest.raises(Exception, match="root must|not a complex"):
            network_json.scan_networks(spark.createDataFrame([(text,)], "value string")).collect()


def test_blocked_contraction(spark, monkeypatch):
    a, b = seq(spark, ["i", "j", "k"], [3, 4, 5]), seq(spark, ["k", "l", "j"], [5, 2, 4])
    want = a.contract(b)
    for block in (2, 3, 64):
        got = blocks.contract_blocked(a, b, block)
        assert got.labels == want.labels and np.allclose(got.data(), want.data())
    monkeypatch.setattr(blocks, "LEAF_ELEMENTS", 1)  # neither side is broadcast
    for spread in (1, 5):
        assert np.allclose(blocks.contract_blocked(a, b, 2, spread).data(), want.data())
    with pytest.raises(ValueError):
        blocks.contract_blocked(a, seq(spark, ["z"], [2]))
