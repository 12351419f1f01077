"""The registered queries of the tensor engine and the same results in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import weftnet
from weftnet.circuits.circuit import Circuit, Operation
from weftnet.circuits.gates import GateKind, Registry, gates
from weftnet.circuits.program import manifest, run
from weftnet.circuits.states import qubits
from weftnet.functions import labels as L
from weftnet.functions.positions import ravel_column, unravel_columns
from weftnet.operators import blocks, matrices
from weftnet.operators.network import Network
from weftnet.operators.tensor import Tensor, add_all
from weftnet.plans.lower import TaskGraph, contract_each_slice, contract_sliced
from weftnet.plans.path import Leaf, PathPlan, best_path, greedy_path, sample_costs
from weftnet.sources import network_json, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def sequential(spark: SparkSession, labels: list[str], dims: list[int], imaginary: float = 2.0) -> Tensor:
    """Values k + 2k i (or k alone) at row-major position k."""
    size = 1
    for d in dims:
        size *= d
    return Tensor.from_data(spark, labels, dims, [complex(k, imaginary * k) for k in range(size)])


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


LI = "li AS (SELECT l_orderkey AS o, l_suppkey % 8 AS s, l_partkey % 16 AS p, sum(l_quantity::BIGINT)::BIGINT AS re, count(*)::BIGINT AS im FROM lineitem GROUP BY ALL)"
SP = "sp AS (SELECT l_suppkey % 8 AS s, l_partkey % 16 AS p, sum(l_quantity::BIGINT)::BIGINT AS re, count(*)::BIGINT AS im FROM lineitem GROUP BY ALL)"
EV = "ev AS (SELECT user_id % 32 AS u, ascii(event_type)::BIGINT - 97 AS e, count(*)::BIGINT AS re, sum(round(value * 100)::BIGINT)::BIGINT AS im FROM events GROUP BY ALL)"
EMB = "emb AS (SELECT vec_id AS v, k.pos, round(embedding[k.pos + 1]::DOUBLE * 1000)::BIGINT AS x FROM embeddings, (SELECT unnest(range(64)) AS pos) k)"
CHAIN = """SELECT l_suppkey % 8 AS s, substr(o_orderpriority, 1, 1)::BIGINT - 1 AS pr, n_regionkey::BIGINT AS r, sum(l_quantity::BIGINT)::BIGINT AS re, count(*)::BIGINT AS im
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def chain(spark: SparkSession, sf_dir: str) -> Network:
    """Line items, orders, customers and nations: open labels s, pr and r."""
    out = Network()
    out.add(tables.line_items(spark, sf_dir, "o", "s", summed=False), ["facts", "lineitem"])
    out.add(tables.orders(spark, sf_dir, "o", "k", "pr"), ["facts", "orders"])
    out.add(tables.customers(spark, sf_dir), ["people"])
    out.add(tables.nations(spark, sf_dir), ["places"])
    return out


CHAIN_PATH = [(0, 1), (3, 2), (4, 5)]


# Tensors.


@query("t01_contract_mm", f"WITH {LI} SELECT s, substr(o_orderpriority, 1, 1)::BIGINT - 1 AS pr, sum(re)::BIGINT AS re, sum(im)::BIGINT AS im FROM li JOIN orders ON o = o_orderkey GROUP BY ALL")
def t01_contract_mm(spark, sf_dir):
    return tables.line_items(spark, sf_dir, "o", "s", summed=False).contract(tables.orders(spark, sf_dir, "o", "pr")).shown()


@query("t01_contract_mv", f"WITH {SP} SELECT s, sum(re * (p + 1) - im * 2 * p)::DOUBLE AS re, sum(re * 2 * p + im * (p + 1))::DOUBLE AS im FROM sp GROUP BY s")
def t01_contract_mv(spark, sf_dir):
    vector = Tensor.from_data(spark, ["p"], [16], [complex(p + 1, 2 * p) for p in range(16)])
    return tables.line_items(spark, sf_dir, "s", "p", summed=False).contract(vector).shown()


@query("t01_dot", f"WITH {EMB} SELECT a.v, sum(a.x * b.x)::BIGINT AS re, 0::BIGINT AS im FROM emb a JOIN emb b ON a.pos = b.pos WHERE b.v = 1 GROUP BY a.v")
def t01_dot(spark, sf_dir):
    states = tables.embeddings(spark, sf_dir)
    return states.contract(states.slice("v", 1)).shown()


@query("t01_outer", f"WITH {EV}, e AS (SELECT e, sum(re)::BIGINT AS re, sum(im)::BIGINT AS im FROM ev GROUP BY e), n AS (SELECT n_regionkey::BIGINT AS r, count(*) AS c FROM nation GROUP BY 1) SELECT r, e, (c * re)::BIGINT AS re, (c * im)::BIGINT AS im FROM n, e")
def t01_outer(spark, sf_dir):
    return tables.nations(spark, sf_dir).sum_out(["n"]).contract(tables.events(spark, sf_dir).sum_out(["u"])).shown()


@query("t01_multi_label", f"WITH {SP} SELECT sum(re * re - im * im)::BIGINT AS re, sum(2 * re * im)::BIGINT AS im FROM sp")
def t01_multi_label(spark, sf_dir):
    t = tables.line_items(spark, sf_dir, "s", "p")
    return t.contract(t.transpose(["p", "s"])).shown()


@query("t02a_blocked", f"WITH {EMB} SELECT v, c, sum(x * (pos * c % 7 - 3))::DOUBLE AS re, 0.0::DOUBLE AS im FROM emb, range(20) r(c) GROUP BY v, c HAVING sum(x * (pos * c % 7 - 3)) <> 0")
def t02a_blocked(spark, sf_dir):
    """Embeddings as a matrix times another matrix, in blocks."""
    states = tables.embeddings(spark, sf_dir).reshape([64], batch=["v"])
    m = spark.range(64 * 20).select(F.expr("id div 20").alias("x0"), (F.col("id") % 20).alias("x1"), (F.expr("id div 20") * (F.col("id") % 20) % 7 - 3).alias("re"), F.lit(0).cast("long").alias("im"))
    return blocks.contract_blocked(states, Tensor(m, ("?a", "c"), (64, 20)), block=32).shown()


@query("t03_add", f"WITH {SP} SELECT s, p, (2 * re)::BIGINT AS re, (2 * im)::BIGINT AS im FROM sp")
def t03_add(spark, sf_dir):
    return tables.line_items(spark, sf_dir, "s", "p").add(tables.line_items(spark, sf_dir, "p", "s")).shown()


@query("t04_slice", f"WITH {SP} SELECT p, re, im FROM sp WHERE s = 3")
def t04_slice(spark, sf_dir):
    return tables.line_items(spark, sf_dir, "s", "p").slice("s", 3).shown()


@query("t05_reshape", f"WITH {EMB} SELECT v, pos // 16 AS a, pos % 16 AS b, x AS re, 0::BIGINT AS im FROM emb")
def t05_reshape(spark, sf_dir):
    return tables.embeddings(spark, sf_dir).reshape([4, 16], batch=["v"]).shown(["v", "a", "b"])


@query("t06_transpose", f"WITH {SP} SELECT p * 8 + s AS position, re, im FROM sp")
def t06_transpose(spark, sf_dir):
    t = tables.line_items(spark, sf_dir, "s", "p").transpose(["p", "s"])
    return t.df.select(t.position().alias("position"), "re", "im")


@query("t07_transpose_order", f"WITH {SP} SELECT p, s, re, im FROM sp")
def t07_transpose_order(spark, sf_dir):
    return tables.line_items(spark, sf_dir, "s", "p").transpose([1, 0]).shown()


@query("t08_conj_norm", f"WITH {EV} SELECT sum(re * re + im * im)::BIGINT AS re, 0::BIGINT AS im FROM ev")
def t08_conj_norm(spark, sf_dir):
    t = tables.events(spark, sf_dir)
    return t.conj().contract(t).shown()


@query("t09_rename", f"WITH {SP} SELECT s AS supplier, p, re, im FROM sp")
def t09_rename(spark, sf_dir):
    return tables.line_items(spark, sf_dir, "s", "p").rename(0, "supplier").shown()


@query("t10_get_value", f"WITH {SP} SELECT re, im FROM sp WHERE s = 3 AND p = 5")
def t10_get_value(spark, sf_dir):
    return tables.line_items(spark, sf_dir, "s", "p").slice("s", 3).slice("p", 5).shown()


@query("t11_set_value", f"WITH {SP} SELECT s, p, CASE WHEN s = 0 AND p = 0 THEN 7 ELSE re END::BIGINT AS re, CASE WHEN s = 0 AND p = 0 THEN -2 ELSE im END::BIGINT AS im FROM sp")
def t11_set_value(spark, sf_dir):
    return tables.line_items(spark, sf_dir, "s", "p").set_value([0, 0], 7 - 2j).shown()


@query("t12_data", f"WITH {SP} SELECT k AS position, coalesce(re, 0)::BIGINT AS re, coalesce(im, 0)::BIGINT AS im FROM range(128) r(k) LEFT JOIN sp ON s * 16 + p = k")
def t12_data(spark, sf_dir):
    t = tables.line_items(spark, sf_dir, "s", "p").densify()
    return t.df.select(t.position().alias("position"), "re", "im")


@query("t13_scalar", f"WITH {SP} SELECT sum(re)::BIGINT AS re, sum(im)::BIGINT AS im FROM sp")
def t13_scalar(spark, sf_dir):
    return tables.line_items(spark, sf_dir, "s", "p").sum_out(["s", "p"]).shown()


@query("t14_random", "SELECT 4096::BIGINT AS n, 4096::BIGINT AS inside, 4096::BIGINT AS kinds")
def t14_random(spark, sf_dir):
    t = Tensor.random(spark, ["a", "b"], [64, 64], seed=7)
    inside = (F.abs(F.col("re")) <= 1) & (F.col("re") < 1) & (F.abs(F.col("im")) <= 1) & (F.col("im") < 1)
    return t.df.agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), F.count_distinct("re").alias("kinds"))


@query("t15_construct", "SELECT k // 12 AS a, k // 4 % 3 AS b, k % 4 AS c, k::DOUBLE AS re, 2.0::DOUBLE * k AS im FROM range(24) r(k) WHERE k > 0")
def t15_construct(spark, sf_dir):
    return sequential(spark, ["a", "b", "c"], [2, 3, 4]).shown()


@query("t16_equal", "SELECT 0::BIGINT AS differences")
def t16_equal(spark, sf_dir):
    return tables.line_items(spark, sf_dir, "s", "p").differences(tables.line_items(spark, sf_dir, "p", "s"))


@query("t17_describe", "SELECT 'Size=3' || chr(10) || 'Indices={i}' || chr(10) || 'Data={(0,0) (1,2) (2,4)}' AS text")
def t17_describe(spark, sf_dir):
    return spark.createDataFrame([(sequential(spark, ["i"], [3]).describe(),)], "text string")


@query("t18_densify", "SELECT n, r, count(n_nationkey)::BIGINT AS re, 0::BIGINT AS im FROM range(25) a(n) CROSS JOIN range(5) b(r) LEFT JOIN nation ON n_nationkey = n AND n_regionkey = r GROUP BY n, r")
def t18_densify(spark, sf_dir):
    return tables.nations(spark, sf_dir).densify().shown()


@query("t19_unravel", "SELECT k AS position, k // 20 AS a, k // 5 % 4 AS b, k % 5 AS c FROM range(60) r(k)")
def t19_unravel(spark, sf_dir):
    a, b, c = unravel_columns(F.col("id"), [3, 4, 5])
    return spark.range(60).select(F.col("id").alias("position"), a.alias("a"), b.alias("b"), c.alias("c"))


@query("t20_ravel", "SELECT s, p, (s * 16 + p)::BIGINT AS position FROM (SELECT DISTINCT l_suppkey % 8 AS s, l_partkey % 16 AS p FROM lineitem)")
def t20_ravel(spark, sf_dir):
    t = tables.line_items(spark, sf_dir, "s", "p")
    return t.df.select(F.col("x0").alias("s"), F.col("x1").alias("p"), ravel_column([F.col("x0"), F.col("x1")], [8, 16]).alias("position"))


@query("t21_shape_size", "SELECT * FROM (VALUES ('a', 24::BIGINT), ('b', 1::BIGINT), ('c', 7::BIGINT)) t(k, size)")
def t21_shape_size(spark, sf_dir):
    rows = spark.createDataFrame([("a", [2, 3, 4]), ("b", []), ("c", [7])], "k string, shape array<bigint>")
    return rows.select("k", L.shape_size(F.col("shape")).alias("size"))


# Networks.


@query("n02_slice_network", f"SELECT pr, r, re, im FROM ({CHAIN} WHERE l_suppkey % 8 = 3 GROUP BY ALL)")
def n02_slice_network(spark, sf_dir):
    network = chain(spark, sf_dir)
    network.slice(["s"], 3)
    return network.contract(CHAIN_PATH).shown()


@query("n03_path_chain3", f"{CHAIN} GROUP BY ALL")
def n03_path_chain3(spark, sf_dir):
    return chain(spark, sf_dir).contract(CHAIN_PATH).shown(["s", "pr", "r"])


@query("n04_implicit", f"{CHAIN} GROUP BY ALL")
def n04_implicit(spark, sf_dir):
    return chain(spark, sf_dir).contract().transpose(["s", "pr", "r"]).shown()


@query("n05_contract_nodes", "SELECT c_custkey AS k, n_regionkey::BIGINT AS r, 1::BIGINT AS re, 0::BIGINT AS im, 4::BIGINT AS id, 'kr' AS name, 'people places' AS tags FROM customer JOIN nation ON c_nationkey = n_nationkey")
def n05_contract_nodes(spark, sf_dir):
    """A step by hand: the new node's tensor, id, name and tags."""
    network = chain(spark, sf_dir)
    node = network.nodes[network.contract_nodes(2, 3)]
    return node.tensor.shown().select("k", "r", "re", "im", F.lit(node.id).cast("long").alias("id"), F.lit(node.name).alias("name"), F.lit(" ".join(node.tags)).alias("tags"))


@query("n06_edges_after_step", "SELECT * FROM (VALUES ('o', '0 1'), ('s', '0'), ('k', '1 4'), ('pr', '1'), ('r', '4')) t(label, nodes)")
def n06_edges_after_step(spark, sf_dir):
    network = chain(spark, sf_dir)
    network.contract_nodes(2, 3)
    return spark.createDataFrame([(x, " ".join(map(str, ids))) for x, (_, ids) in network.edges().items()], "label string, nodes string")


@query("n07_scalars", f"WITH {SP} SELECT (c * sum(re))::BIGINT AS re, (c * sum(im))::BIGINT AS im FROM sp, (SELECT count(*) AS c FROM nation) GROUP BY c")
def n07_scalars(spark, sf_dir):
    network = Network()
    network.add(tables.nations(spark, sf_dir).sum_out(["n", "r"]))
    network.add(tables.line_items(spark, sf_dir, "s", "p").sum_out(["s", "p"]))
    return network.contract_scalars().shown()


@query("n08_edges", "SELECT * FROM (VALUES ('o', 0::BIGINT, [0, 1]::BIGINT[]), ('s', 8, [0]), ('k', 0, [1, 2]), ('pr', 5, [1]), ('n', 25, [2, 3]), ('r', 5, [3])) t(label, dim, node_ids)")
def n08_edges(spark, sf_dir):
    return chain(spark, sf_dir).edge_table(spark)


@query("n08_tags", "SELECT * FROM (VALUES ('facts', [0, 1]::BIGINT[]), ('lineitem', [0]), ('orders', [1]), ('people', [2]), ('places', [3])) t(tag, node_ids)")
def n08_tags(spark, sf_dir):
    return chain(spark, sf_dir).tag_table(spark)


@query("n09_describe", "SELECT 'Nodes' || chr(10) || '  0 ij [A]' || chr(10) || '  1 j [B C]' || chr(10) || 'Edges' || chr(10) || '  i 2 0' || chr(10) || '  j 3 0 1' AS text")
def n09_describe(spark, sf_dir):
    network = Network()
    network.add(sequential(spark, ["i", "j"], [2, 3]), ["A"])
    network.add(sequential(spark, ["j"], [3]), ["B", "C"])
    return spark.createDataFrame([(network.describe(),)], "text string")


# Paths.

LEAVES = [Leaf(["p", "q"], ["p", "q"], ["warm"]), Leaf(["q", "r"], ["q", "r"], ["cold"]), Leaf(["r", "s", "t"], ["r", "s", "t"], ["warm", "odd"]), Leaf(["t", "u"], ["t", "u"], []), Leaf(["u"], ["u"], ["cold"])]
DIMS = {"p": 4, "q": 3, "r": 6, "s": 2, "t": 5, "u": 7}
STEPS_SQL = """SELECT * FROM (VALUES
  (0::BIGINT, 6::BIGINT, NULL::BIGINT, NULL::BIGINT, 'pq', 'pq', 'warm', '', 0.0::DOUBLE, 4.0 * 3), (1, 6, NULL, NULL, 'qr', 'qr', 'cold', '', 0.0, 3.0 * 6), (2, 7, NULL, NULL, 'rst', 'rst', 'warm odd', '', 0.0, 6.0 * 2 * 5),
  (3, 5, NULL, NULL, 'tu', 'tu', '', '', 0.0, 5.0 * 7), (4, 5, NULL, NULL, 'u', 'u', 'cold', '', 0.0, 7.0), (5, 7, 3, 4, 't', 't', 'cold', 'u', 5.0 * 2 * 7, 5.0),
  (6, 8, 0, 1, 'pr', 'pr', 'warm cold', 'q', 4.0 * 6 * 2 * 3, 4.0 * 6), (7, 8, 2, 5, 'rs', 'rs', 'warm odd cold', 't', 6.0 * 2 * 2 * 5, 6.0 * 2), (8, NULL, 6, 7, 'ps', 'ps', 'warm cold odd', 'r', 4.0 * 2 * 2 * 6, 4.0 * 2))
  t(id, parent, child_1, child_2, name, labels, tags, contracted, flops, memory)"""


def small_plan() -> PathPlan:
    return PathPlan(LEAVES, DIMS, [(3, 4), (0, 1), (2, 5), (6, 7)])


@query("p01_steps", f"SELECT id, parent, name, flops::DOUBLE AS flops, memory::DOUBLE AS memory FROM ({STEPS_SQL})")
def p01_steps(spark, sf_dir):
    return small_plan().table(spark).select("id", "parent", "name", "flops", "memory")


@query("p06_accessors", f"SELECT id, child_1, child_2, labels, tags, contracted FROM ({STEPS_SQL})")
def p06_accessors(spark, sf_dir):
    t = small_plan().table(spark)
    return t.select("id", "child_1", "child_2", F.array_join("labels", "").alias("labels"), F.array_join("tags", " ").alias("tags"), F.array_join("contracted", "").alias("contracted"))


@query("p03_flops", f"SELECT sum(flops)::DOUBLE AS flops FROM ({STEPS_SQL})")
def p03_flops(spark, sf_dir):
    return small_plan().table(spark).agg(F.sum("flops").alias("flops"))


@query("p05_memory", f"SELECT sum(memory)::DOUBLE AS memory FROM ({STEPS_SQL})")
def p05_memory(spark, sf_dir):
    return small_plan().table(spark).agg(F.sum("memory").alias("memory"))


@query("p08_best_path", "SELECT true AS not_worse, (5 * 2 * 7 + 6 * 2 * 2 * 5 + 3 * 2 * 2 * 6 + 4 * 2 * 2 * 3)::DOUBLE AS flops")
def p08_best_path(spark, sf_dir):
    """The cheapest of sampled paths, drawn on the executors, against the greedy one."""
    greedy = PathPlan(LEAVES, DIMS, greedy_path(LEAVES, DIMS)).flops()
    best = sample_costs(spark, LEAVES, DIMS, 64).agg(F.min("flops").alias("flops"))
    return best.select((F.col("flops") <= greedy).alias("not_worse"), F.lit(PathPlan(LEAVES, DIMS, best_path(LEAVES, DIMS)).flops()).alias("flops"))


# Task graphs.


@query("c01_shared", "SELECT 0::BIGINT AS first, 1::BIGINT AS second, (2 * 2 * 5 + 2 * 4 * 2 * 2)::DOUBLE AS flops, (2 + 2 * 4)::DOUBLE AS memory")
def c01_shared(spark, sf_dir):
    """Contracting the same network again makes only its last task anew."""
    network = Network()
    for labels, dims in ((["m"], [5]), (["m", "n"], [5, 2]), (["n", "z"], [2, 4])):
        network.add(sequential(spark, labels, dims, 0))
    graph, plan = TaskGraph(), network.plan([(0, 1), (3, 2)])
    shared = [graph.add(network, plan), graph.add(network, plan)]
    return spark.createDataFrame([(*shared, graph.flops, graph.memory)], "first bigint, second bigint, flops double, memory double")


def buckets_by_share(spark: SparkSession, sf_dir: str) -> Network:
    """Line items by part bucket p, against weights p + 1."""
    network = Network()
    network.add(tables.line_items(spark, sf_dir, "s", "p", summed=False))
    network.add(Tensor(spark.range(16).select(F.col("id").alias("x0"), (F.col("id") + 1).alias("re"), F.lit(0).cast("long").alias("im")), ("p",), (16,)))
    network.add(Tensor(spark.range(8).select(F.col("id").alias("x0"), (F.col("id") * 2 + 1).alias("re"), F.lit(0).cast("long").alias("im")), ("s",), (8,)))
    return network


WEIGHED = f"WITH {SP} SELECT sum(re * (p + 1) * (2 * s + 1))::BIGINT AS re, sum(im * (p + 1) * (2 * s + 1))::BIGINT AS im FROM sp"


@query("c03_release", f"SELECT 1::BIGINT AS held, 4::BIGINT AS released, re, im FROM ({WEIGHED})")
def c03_release(spark, sf_dir):
    """Holds what two contractions share, lets go of it, and still has the result."""
    network, graph = buckets_by_share(spark, sf_dir), TaskGraph()
    for _ in range(2):
        graph.add(network, network.plan([(0, 1), (3, 2)]))
    held = graph.hold()
    released = graph.release()
    return graph.results[1].shown().select(F.lit(held).cast("long").alias("held"), F.lit(released).cast("long").alias("released"), "re", "im")


@query("c04_futures", f"SELECT k, re, im FROM ({WEIGHED}), range(2) r(k)")
def c04_futures(spark, sf_dir):
    """Two contractions submitted side by side."""
    network, graph = buckets_by_share(spark, sf_dir), TaskGraph()
    for path in ([(0, 1), (3, 2)], [(0, 2), (3, 1)]):
        graph.add(network, network.plan(path))
    rows = [(k, r["re"], r["im"]) for k, f in enumerate(graph.submit()) for r in f.result()]
    return spark.createDataFrame(rows, "k bigint, re bigint, im bigint")


@query("c06_include", f"SELECT 2::BIGINT AS results, (2 * re)::BIGINT AS re, (2 * im)::BIGINT AS im FROM ({WEIGHED})")
def c06_include(spark, sf_dir):
    """A graph that takes over another one's tasks."""
    network, graph, other = buckets_by_share(spark, sf_dir), TaskGraph(), TaskGraph()
    graph.add(network, network.plan([(0, 1), (3, 2)]))
    other.add(network, network.plan([(0, 2), (3, 1)]))
    graph.include(other)
    return graph.reduce().shown().select(F.lit(len(graph.results)).cast("long").alias("results"), "re", "im")


@query("c02_reduce", f"WITH {SP} SELECT sum(re * (p + 1))::BIGINT * 2 AS re, sum(im * (p + 1))::BIGINT * 2 AS im FROM sp")
def c02_reduce(spark, sf_dir):
    weights = Tensor(spark.range(16).select(F.col("id").alias("x0"), (F.col("id") + 1).alias("re"), F.lit(0).cast("long").alias("im")), ("p",), (16,))
    network = Network()
    network.add(tables.line_items(spark, sf_dir, "p"))
    network.add(weights)
    graph = TaskGraph()
    graph.add(network)
    graph.add(network)
    return graph.reduce().shown()


@query("c08_sliced_reduce", f"SELECT pr, r, sum(re)::BIGINT AS re, sum(im)::BIGINT AS im FROM ({CHAIN} GROUP BY ALL) GROUP BY pr, r")
def c08_sliced_reduce(spark, sf_dir):
    return contract_sliced(chain(spark, sf_dir), ["s"], CHAIN_PATH).shown()


@query("c08_each_slice", f"WITH {SP} SELECT p, sum(re * (s + 1))::BIGINT AS re, sum(im * (s + 1))::BIGINT AS im FROM sp GROUP BY p")
def c08_each_slice(spark, sf_dir):
    weights = Tensor(spark.range(8).select(F.col("id").alias("x0"), (F.col("id") + 1).alias("re"), F.lit(0).cast("long").alias("im")), ("s",), (8,))
    network = Network()
    network.add(tables.line_items(spark, sf_dir, "s", "p", summed=False))
    network.add(weights)
    return contract_each_slice(network, ["s"], range(8)).reduce().shown()


@query("c08_blocks", "SELECT a, d, sum((6 * a + 2 * b + c) * (8 * b + 4 * c + d))::DOUBLE AS re, sum((6 * a + 2 * b + c) * 3 * (8 * b + 4 * c + d))::DOUBLE AS im FROM range(2) r(a), range(3) s(b), range(2) t(c), range(4) u(d) GROUP BY a, d")
def c08_blocks(spark, sf_dir):
    network = Network()
    network.add(Tensor.from_data(spark, ["a", "b", "c"], [2, 3, 2], range(12)))
    network.add(Tensor.from_data(spark, ["b", "c", "d"], [3, 2, 4], [complex(k, 3 * k) for k in range(24)]))
    return blocks.contract_slices(network, ["b"]).transpose(["a", "d"]).shown()


# Files.

DOCUMENT = '{"path": [[0,1],[3,2]], "tensors": [[["grid"],["a","b"],[2,3],[[1,0],[2,0.5],[3,0],[4,0],[5,-1],[6,0]]],[["line","real"],["b"],[3],[[7,0],[8,0],[9,0]]],[[],["a"],[2],[[0.25,0],[0,1]]]]}'


@query("i01_json_roundtrip", "SELECT * FROM (VALUES (0, 0::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE), (0, 1, 2, 0.5), (0, 2, 3, 0), (0, 3, 4, 0), (0, 4, 5, -1), (0, 5, 6, 0), (1, 0, 7, 0), (1, 1, 8, 0), (1, 2, 9, 0), (2, 0, 0.25, 0), (2, 1, 0, 1)) t(tensor, position, re, im)")
def i01_json_roundtrip(spark, sf_dir):
    documents = spark.createDataFrame([(1, DOCUMENT)], "doc int, value string")
    again = network_json.to_documents(network_json.scan_networks(documents, keys=["doc"]), ["doc"])
    return network_json.entries(network_json.scan_networks(again))


@query("i04_validation", "SELECT * FROM (VALUES (0::BIGINT, 'NetworkSyntaxError', ''), (1, 'NetworkStructureError', ''), (2, 'NetworkStructureError', ''), (3, 'NetworkStructureError', 'element 2 of tensor 1'), (4, 'NetworkStructureError', 'tensor 0'), (5, '', '')) t(k, error, place)")
def i04_validation(spark, sf_dir):
    """What is wrong with documents, and where."""
    texts = ["{", "[1]", '{"path": []}', '{"tensors": [[[], [], [], [[1, 0]]], [[], ["v"], [3], [[1, 0], [2, 0], [3, 0, 0]]]]}', '{"tensors": [[[], ["v"], [3]]]}', DOCUMENT]
    rows = []
    for k, text in enumerate(texts):
        try:
            network_json.load_network(spark, text)
            rows.append((k, "", ""))
        except network_json.NetworkFileError as e:
            place = re.search(r"(element \d+ of )?tensor \d+", str(e))
            rows.append((k, type(e).__name__, place[0] if place else ""))
    return spark.createDataFrame(rows, "k bigint, error string, place string")


@query("i05_column_major", "SELECT k % 2 AS a, k // 2 AS b, x::DOUBLE AS re, y::DOUBLE AS im FROM (VALUES (0::BIGINT, 1, 0), (1, 2, 0.5), (2, 3, 0), (3, 4, 0), (4, 5, -1), (5, 6, 0)) t(k, x, y)")
def i05_column_major(spark, sf_dir):
    """Values whose first label runs fastest."""
    network, _ = network_json.load_network(spark, DOCUMENT, column_major=True)
    return network.nodes[0].tensor.transpose(["a", "b"]).shown()


@query("i03_dump", "SELECT '{\"path\": [[0, 1]], \"tensors\": [[[\"A\"], [\"i\"], [2], [[0.0, 0.0], [1.0, 2.0]]], [[], [\"i\"], [2], [[1.0, 0.0], [0.0, 1.0]]]]}' AS value")
def i03_dump(spark, sf_dir):
    network = Network()
    network.add(sequential(spark, ["i"], [2]), ["A"])
    network.add(Tensor.from_data(spark, ["i"], [2], [1, 1j]))
    return spark.createDataFrame([(network_json.dump_network(network, [(0, 1)]),)], "value string")


# Circuits.


def bell() -> Circuit:
    out = Circuit(2)
    out.append_gate(gates.create("H"), [0])
    out.append_gate(gates.create("CNOT"), [0, 1])
    return out


PAIR = "gate Pair(t)[a, b]: RY(t) | [a]; CX | [a, b]; end; obs Both[a, b]: 2, Z[a]; 3, Z[b]; end; Pair(pi/3) | [0, 1];"


@query("x01_program", "SELECT * FROM (VALUES (0, round(sin(pi() / 6), 6), 0.0::DOUBLE), (1, round(cos(pi() / 6), 6), 0.0), (2, 6.0, 0.0)) t(k, re, im)")
def x01_program(spark, sf_dir):
    out = run(spark, f"{PAIR} amplitude(state: [1, 1]) | [0, 1]; amplitude(state: [0, 0]) | [0, 1]; expval(observable: Both) | [0, 1];")
    return rounded(spark.createDataFrame([(k, v.real, v.imag) for k, v in enumerate(out)], "k int, re double, im double"), "re", "im")


@query("x06_composite_gates", "SELECT k AS position, round(CASE WHEN k IN (0, 7) THEN CASE k WHEN 0 THEN cos(0.3) ELSE sin(0.3) END ELSE 0 END, 6) + 0.0 AS re FROM range(8) r(k)")
def x06_composite_gates(spark, sf_dir):
    """Gates of gates: wires and parameters bound by place and by name."""
    text = "gate Turn(angle)[w]: RY(2 * angle) | [w]; end; gate Fan(by)[x, y, z]: Turn(angle: by) | [x]; CX | [x, y]; CX | [y, z]; end; Fan(0.3) | [0, 1, 2];"
    amplitudes = [run(spark, f"{text} amplitude(state: [{k >> 2}, {k >> 1 & 1}, {k & 1}]) | [0, 1, 2];")[0].real for k in range(8)]
    return rounded(spark.createDataFrame(list(enumerate(amplitudes)), "position bigint, re double"), "re")


@query("x07_options", "SELECT * FROM (VALUES ('2', ''), ('5', ''), ('1', 'wires have 2 values at least, not 1'), ('2.5', 'the dimension ''2.5'' is no whole number'), ('3 gate', 'in ''X | [0]'': PauliX acts on wires of 2 values, but the circuit''s wires have 3')) t(option, error)")
def x07_options(spark, sf_dir):
    """The dimension option, and a gate that doesn't fit it."""
    rows = []
    for option in ("2", "5", "1", "2.5", "3 gate"):
        try:
            run(spark, f"options: dimension: {option.split()[0]}; end; {'X | [0];' if 'gate' in option else ''}")
            rows.append((option, ""))
        except ValueError as e:
            rows.append((option, str(e)))
    return spark.createDataFrame(rows, "option string, error string")


@query("x11_registry", "SELECT * FROM (VALUES ('made', 1.0::DOUBLE, -1.0::DOUBLE), ('again', 0.0, 0.0), ('gone', 0.0, 0.0)) t(step, first, last)")
def x11_registry(spark, sf_dir):
    """A gate that is added to a registry, refused a second time, and taken out."""
    registry, rows = Registry(), []
    kind = registry.register(["Sign"], GateKind("Sign", 1, [], lambda: np.diag([1, -1j])))
    m = registry.create("Sign", scalar=1j, adjoint=True).scale(-1j).matrix()
    rows.append(("made", float(m[0, 0].real), float((m[1, 1] * 1j).real)))
    for step, action in (("again", lambda: registry.register(["Sign"], kind)), ("gone", lambda: (registry.unregister(kind), registry.create("Sign")))):
        try:
            action()
        except KeyError:
            rows.append((step, 0.0, 0.0))
    return spark.createDataFrame(rows, "step string, first double, last double")


@query("x13_precision", "SELECT * FROM (VALUES ('complex64', 'float', round((0.1::FLOAT)::DOUBLE, 12)), ('complex128', 'double', 0.1::DOUBLE)) t(name, kind, value)")
def x13_precision(spark, sf_dir):
    """Values and circuit results of both precisions."""
    rows = []
    for name in ("complex64", "complex128"):
        t = bell().amplitudes(spark, precision=name)
        rows.append((name, dict(t.df.dtypes)["re"], round(Tensor.from_data(spark, ["a"], [1], [0.1], precision=name).value([0]).real, 12)))
    return spark.createDataFrame(rows, "name string, kind string, value double")


@query("x02_amplitudes_bell", "SELECT * FROM (VALUES (0::BIGINT, round(sqrt(0.5), 6), 0.0::DOUBLE), (1, 0.0, 0.0), (2, 0.0, 0.0), (3, round(sqrt(0.5), 6), 0.0)) t(position, re, im)")
def x02_amplitudes_bell(spark, sf_dir):
    t = bell().amplitudes(spark).densify()
    return rounded(t.df.select(t.position().alias("position"), "re", "im"), "re", "im")


@query("x03_probabilities", "SELECT * FROM (VALUES (0::BIGINT, 0.5::DOUBLE), (1, 0.0), (2, 0.0), (3, 0.5)) t(position, probability)")
def x03_probabilities(spark, sf_dir):
    return rounded(bell().probabilities(spark), "probability")


@query("x04_expval", "SELECT round(cos(0.4) * sqrt(0.5), 6) AS re, 0.0::DOUBLE AS im")
def x04_expval(spark, sf_dir):
    circuit = Circuit(2)
    circuit.append_gate(gates.create("RY", 0.4), [0])
    circuit.append_gate(gates.create("H"), [1])
    circuit.append_gate(gates.create("T"), [1])
    value = circuit.expectation(spark, [Operation(gates.create("Z"), (0,)), Operation(gates.create("X"), (1,))])
    return rounded(spark.createDataFrame([(value.real, value.imag)], "re double, im double"), "re", "im")


#: Names of the gates, their parameters and numbers of wires, and of the outputs.
MANIFEST_SQL = """SELECT 'gate' AS kind, unnest(names) AS name, params, wires FROM (VALUES
  (['Displacement', 'displacement', 'D', 'd'], 'r, phi', 1), (['Squeezing', 'squeezing'], 'r, theta', 1), (['TwoModeSqueezing', 'twomodesqueezing'], 'r, theta', 2), (['Beamsplitter', 'beamsplitter', 'BS', 'bs'], 'theta, phi', 2),
  (['Hadamard', 'hadamard', 'H', 'h', 'PauliX', 'paulix', 'X', 'x', 'NOT', 'not', 'PauliY', 'pauliy', 'Y', 'y', 'PauliZ', 'pauliz', 'Z', 'z', 'S', 's', 'T', 't', 'SX', 'sx'], '', 1),
  (['PhaseShift', 'phaseshift', 'U1', 'u1'], 'phi', 1), (['CPhaseShift', 'cphaseshift'], 'phi', 2), (['CX', 'cx', 'CNOT', 'cnot', 'CY', 'cy', 'CZ', 'cz', 'SWAP', 'swap', 'ISWAP', 'iswap'], '', 2), (['CSWAP', 'cswap', 'Toffoli', 'toffoli'], '', 3),
  (['RX', 'rx', 'RY', 'ry', 'RZ', 'rz'], 'theta', 1), (['CRX', 'crx', 'CRY', 'cry', 'CRZ', 'crz'], 'theta', 2), (['Rot', 'rot'], 'phi, theta, omega', 1), (['CRot', 'crot'], 'phi, theta, omega', 2), (['U2', 'u2'], 'phi, lam', 1), (['U3', 'u3'], 'theta, phi, lam', 1)) g(names, params, wires)
UNION ALL SELECT 'out', unnest(['Amplitude', 'amplitude', 'Expval', 'expval', 'Probabilities', 'probabilities']), '', NULL"""


@query("x05_manifest", f"SELECT kind, name, kind || ' ' || name || CASE WHEN params = '' THEN '' ELSE '(' || params || ')' END || CASE wires WHEN 1 THEN '[0]' WHEN 2 THEN '[0, 1]' WHEN 3 THEN '[0, 1, 2]' ELSE '' END || ';' AS text FROM ({MANIFEST_SQL})")
def x05_manifest(spark, sf_dir):
    return manifest(spark).select("kind", "name", "text")


@query("x09_circuit", "SELECT * FROM (VALUES (0, 'Qudit(2)', ['0-0']), (1, 'Qudit(2)', ['1-0']), (2, 'Hadamard', ['0-1', '0-0']), (3, 'CX', ['0-2', '1-1', '0-1', '1-0'])) t(seq, part, labels)")
def x09_circuit(spark, sf_dir):
    return bell().table(spark).select("seq", "part", "labels")


@query("x10_states", "SELECT 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, 1.0::DOUBLE AS re, 0.0::DOUBLE AS im")
def x10_states(spark, sf_dir):
    return qubits(3).tensor(spark, ["a", "b", "c"]).shown()


@query("x12_adjoint_scale", "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 0.0::DOUBLE, -3.0::DOUBLE), (1, 0, 0.0, -3.0)) t(o, i, re, im)")
def x12_adjoint_scale(spark, sf_dir):
    return gates.create("X", adjoint=True, scalar=-3j).tensor(spark, ["o", "i"]).shown()


# Gates on a batch of states: the embeddings as six-qubit states, the gate on the leading wires.

_C, _N = "cos(0.35)", "sin(0.35)"  # half of the angle 0.7
#: Non-zero entries (output, input, re, im) of the gates' matrices, in SQL.
GATE_SQL = {
    "Hadamard": [(0, 0, "sqrt(0.5)", "0"), (0, 1, "sqrt(0.5)", "0"), (1, 0, "sqrt(0.5)", "0"), (1, 1, "-sqrt(0.5)", "0")],
    "PauliX": [(0, 1, "1", "0"), (1, 0, "1", "0")],
    "PauliY": [(0, 1, "0", "-1"), (1, 0, "0", "1")],
    "PauliZ": [(0, 0, "1", "0"), (1, 1, "-1", "0")],
    "S": [(0, 0, "1", "0"), (1, 1, "0", "1")],
    "T": [(0, 0, "1", "0"), (1, 1, "sqrt(0.5)", "sqrt(0.5)")],
    "SX": [(0, 0, "0.5", "0.5"), (0, 1, "0.5", "-0.5"), (1, 0, "0.5", "-0.5"), (1, 1, "0.5", "0.5")],
    "PhaseShift": [(0, 0, "1", "0"), (1, 1, "cos(0.7)", "sin(0.7)")],
    "CPhaseShift": [(0, 0, "1", "0"), (1, 1, "1", "0"), (2, 2, "1", "0"), (3, 3, "cos(0.7)", "sin(0.7)")],
    "CX": [(0, 0, "1", "0"), (1, 1, "1", "0"), (2, 3, "1", "0"), (3, 2, "1", "0")],
    "CY": [(0, 0, "1", "0"), (1, 1, "1", "0"), (2, 3, "0", "-1"), (3, 2, "0", "1")],
    "CZ": [(0, 0, "1", "0"), (1, 1, "1", "0"), (2, 2, "1", "0"), (3, 3, "-1", "0")],
    "SWAP": [(0, 0, "1", "0"), (1, 2, "1", "0"), (2, 1, "1", "0"), (3, 3, "1", "0")],
    "ISWAP": [(0, 0, "1", "0"), (1, 2, "0", "1"), (2, 1, "0", "1"), (3, 3, "1", "0")],
    "CSWAP": [(k, {5: 6, 6: 5}.get(k, k), "1", "0") for k in range(8)],
    "Toffoli": [(k, {6: 7, 7: 6}.get(k, k), "1", "0") for k in range(8)],
    "RX": [(0, 0, _C, "0"), (0, 1, "0", f"-{_N}"), (1, 0, "0", f"-{_N}"), (1, 1, _C, "0")],
    "RY": [(0, 0, _C, "0"), (0, 1, f"-{_N}", "0"), (1, 0, _N, "0"), (1, 1, _C, "0")],
    "RZ": [(0, 0, _C, f"-{_N}"), (1, 1, _C, _N)],
    "U1": [(0, 0, "1", "0"), (1, 1, "cos(0.7)", "sin(0.7)")],
    "U2": [(0, 0, "sqrt(0.5)", "0"), (0, 1, "-sqrt(0.5)*cos(1.1)", "-sqrt(0.5)*sin(1.1)"), (1, 0, "sqrt(0.5)*cos(0.7)", "sqrt(0.5)*sin(0.7)"), (1, 1, "sqrt(0.5)*cos(1.8)", "sqrt(0.5)*sin(1.8)")],
    "U3": [(0, 0, _C, "0"), (0, 1, f"-{_N}*cos(0.3)", f"-{_N}*sin(0.3)"), (1, 0, f"{_N}*cos(1.1)", f"{_N}*sin(1.1)"), (1, 1, f"{_C}*cos(1.4)", f"{_C}*sin(1.4)")],
    "Rot": [(0, 0, "cos(0.55)*cos(0.5)", "-cos(0.55)*sin(0.5)"), (0, 1, "-sin(0.55)*cos(0.2)", "-sin(0.55)*sin(0.2)"), (1, 0, "sin(0.55)*cos(0.2)", "-sin(0.55)*sin(0.2)"), (1, 1, "cos(0.55)*cos(0.5)", "cos(0.55)*sin(0.5)")],
}
for _name, _of in (("CRX", "RX"), ("CRY", "RY"), ("CRZ", "RZ"), ("CRot", "Rot")):
    GATE_SQL[_name] = [(0, 0, "1", "0"), (1, 1, "1", "0"), *((o + 2, i + 2, a, b) for o, i, a, b in GATE_SQL[_of])]
#: Angles of the gates that take some.
ANGLES = {"PhaseShift": (0.7,), "CPhaseShift": (0.7,), "RX": (0.7,), "RY": (0.7,), "RZ": (0.7,), "CRX": (0.7,), "CRY": (0.7,), "CRZ": (0.7,), "U1": (0.7,), "U2": (0.7, 1.1), "U3": (0.7, 1.1, 0.3), "Rot": (0.7, 1.1, 0.3), "CRot": (0.7, 1.1, 0.3)}
ANGLES |= {"Displacement": (0.4, 0.3), "Squeezing": (0.4, 0.3), "TwoModeSqueezing": (0.4, 0.3), "Beamsplitter": (0.7, 0.3)}


def apply_to_embeddings(spark: SparkSession, sf_dir: str, matrix: np.ndarray, dims: list[int], wires: int) -> DataFrame:
    rows = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)).alias("a"), F.transform("embedding", lambda x: F.lit(0.0)).alias("b"))
    re_, im = blocks.apply_matrix(F.col("a"), F.col("b"), dims, list(range(wires)), matrix)
    out = rows.select("v", F.posexplode(F.arrays_zip(re_.alias("re"), im.alias("im"))).alias("position", "z"))
    return rounded(out.select("v", F.col("position").cast("long").alias("position"), "z.re", "z.im"), "re", "im")


def gate_batch(name: str) -> Query:
    def apply(spark: SparkSession, sf_dir: str) -> DataFrame:
        gate = gates.create(name, *ANGLES.get(name, ()))
        return apply_to_embeddings(spark, sf_dir, gate.matrix(), [2] * 6, gate.wires)

    return apply


def gate_sql(name: str, wires: int) -> str:
    stride = 64 >> wires
    entries = ", ".join(f"({o}, {i}, ({a})::DOUBLE, ({b})::DOUBLE)" for o, i, a, b in GATE_SQL[name])
    return f"WITH {EMB}, g(o, i, re, im) AS (VALUES {entries}) SELECT v, (g.o * {stride} + pos % {stride})::BIGINT AS position, round(sum(x * g.re), 6) + 0.0 AS re, round(sum(x * g.im), 6) + 0.0 AS im FROM emb JOIN g ON pos // {stride} = g.i GROUP BY 1, 2"


#: Levels of a mode in the queries of Fock gates: an embedding is a state of three such modes.
CUTOFF = 4
_LEVELS = f"l(k, f) AS (SELECT k, factorial(k::INTEGER)::DOUBLE FROM range({2 * CUTOFF}) r(k))"
_OF = f"range({CUTOFF}) a(m), range({CUTOFF}) b(n)"
_OF2 = f"range({CUTOFF}) a(m1), range({CUTOFF}) b(m2), range({CUTOFF}) c(n1), range({CUTOFF}) d(n2)"
#: Closed forms of Fock matrix elements: sums of products of ladder-operator factors, as (o, i, magnitude, phase).
FOCK_SQL = {
    "Displacement": (1, f"""SELECT m AS o, n AS i, sum(exp(-0.4 * 0.4 / 2) * sqrt(fm.f * fn.f) / (fk.f * fmk.f * fnk.f) * 0.4 ** (m + n - 2 * x.k) * (-1.0) ** (n - x.k)) AS v, 0.3 * (m - n) AS t
        FROM {_OF}, l x, l fm, l fn, l fk, l fmk, l fnk WHERE x.k <= least(m, n) AND fm.k = m AND fn.k = n AND fk.k = x.k AND fmk.k = m - x.k AND fnk.k = n - x.k GROUP BY m, n"""),
    "Squeezing": (1, f"""SELECT m AS o, n AS i, sum((tanh(0.4) / 2) ** q.k * (-tanh(0.4) / 2) ** p.k / (q.f * p.f) * sqrt(fm.f * fn.f) / r.f * (1 / cosh(0.4)) ** (r.k + 0.5)) AS v, 0.3 * (m - n) / 2.0 AS t
        FROM {_OF}, l q, l p, l r, l fm, l fn WHERE r.k = n - 2 * q.k AND m = r.k + 2 * p.k AND fm.k = m AND fn.k = n GROUP BY m, n"""),
    "TwoModeSqueezing": (2, f"""SELECT m1 * {CUTOFF} + m2 AS o, n1 * {CUTOFF} + n2 AS i, sum((-tanh(0.4)) ** q.k * tanh(0.4) ** p.k / (q.f * p.f) * sqrt(f1.f * f2.f * g1.f * g2.f) / (r1.f * r2.f) * (1 / cosh(0.4)) ** (r1.k + r2.k + 1)) AS v, 0.3 * (m1 - n1) AS t
        FROM {_OF2}, l q, l p, l r1, l r2, l f1, l f2, l g1, l g2 WHERE r1.k = n1 - q.k AND r2.k = n2 - q.k AND m1 = r1.k + p.k AND m2 = r2.k + p.k AND f1.k = m1 AND f2.k = m2 AND g1.k = n1 AND g2.k = n2 GROUP BY m1, m2, n1, n2"""),
    "Beamsplitter": (2, f"""SELECT m1 * {CUTOFF} + m2 AS o, n1 * {CUTOFF} + n2 AS i, sum(g1.f / (x.f * u.f) * g2.f / (y.f * w.f) * cos(0.7) ** (x.k + w.k) * sin(0.7) ** (u.k + y.k) * (-1.0) ** y.k * sqrt(f1.f * f2.f / (g1.f * g2.f))) AS v, 0.3 * (n1 - m1) AS t
        FROM {_OF2}, l x, l u, l y, l w, l f1, l f2, l g1, l g2 WHERE x.k + u.k = n1 AND y.k + w.k = n2 AND x.k + y.k = m1 AND m1 + m2 = n1 + n2 AND f1.k = m1 AND f2.k = m2 AND g1.k = n1 AND g2.k = n2 GROUP BY m1, m2, n1, n2"""),
}


def fock_batch(name: str) -> Query:
    def apply(spark: SparkSession, sf_dir: str) -> DataFrame:
        gate = gates.create(name, *ANGLES[name], dim=CUTOFF)
        return apply_to_embeddings(spark, sf_dir, gate.matrix(), [CUTOFF] * 3, gate.wires)

    return apply


def fock_sql(name: str) -> str:
    wires, entries = FOCK_SQL[name]
    stride = 64 // CUTOFF**wires
    return f"WITH {EMB}, {_LEVELS}, e AS ({entries}), g AS (SELECT o, i, v * cos(t) AS re, v * sin(t) AS im FROM e) SELECT v, (g.o * {stride} + pos % {stride})::BIGINT AS position, round(sum(x * g.re), 6) + 0.0 AS re, round(sum(x * g.im), 6) + 0.0 AS im FROM emb JOIN g ON pos // {stride} = g.i GROUP BY 1, 2"


for _kind in dict.fromkeys(gates.kinds.values()):
    _key = f"k_fock_{_kind.title.lower()}" if _kind.fock else f"k_gate_{_kind.title.lower()}"
    QUERIES[_key] = fock_batch(_kind.title) if _kind.fock else gate_batch(_kind.title)
    ORACLE_SQL[_key] = fock_sql(_kind.title) if _kind.fock else gate_sql(_kind.title, _kind.wires)


@query("k_gate_contract", gate_sql("Hadamard", 1))
def k_gate_contract(spark, sf_dir):
    """The same as k_gate_hadamard by a contraction of relations."""
    t = gates.create("H").tensor(spark, ["o", "q0"]).contract(tables.embeddings(spark, sf_dir)).transpose(["v", "o", "q1", "q2", "q3", "q4", "q5"])
    at = ravel_column([F.col(n) for n in t.names[1:]], [2] * 6)
    return rounded(t.df.select(F.col("x0").alias("v"), at.alias("position"), "re", "im"), "re", "im")


# Utilities.


@query("u_label_algebra", "SELECT * FROM (VALUES (['a','a','b'], ['c'], ['a','a','b','c','d'], ['c','d'], false, 'aabc'), ([]::VARCHAR[], []::VARCHAR[], ['x'], ['x'], false, '')) t(common, only_a, either, one, has_all, joined)")
def u_label_algebra(spark, sf_dir):
    rows = spark.createDataFrame([(["a", "a", "b", "c"], ["b", "a", "d"]), ([], ["x"])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    return rows.select(L.intersection_column(a, b).alias("common"), L.difference_column(a, b).alias("only_a"), L.union_column(a, b).alias("either"), L.exclusive_column(a, b).alias("one"), L.contains_all_column(a, b).alias("has_all"), L.joined_column(a).alias("joined"))


@query("u_index_names", "SELECT k AS id, substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', (k % 52 + 1)::BIGINT, 1) || CASE WHEN k >= 52 THEN (k // 52 - 1)::VARCHAR ELSE '' END AS name FROM range(200) r(k)")
def u_index_names(spark, sf_dir):
    return spark.range(200).select("id", L.label_name_column(F.col("id")).alias("name"))


@query("u_numbers", "SELECT k AS id, k > 0 AND k & (k - 1) = 0 AS power, CASE WHEN k > 0 THEN floor(log2(k))::INTEGER END AS log, CASE WHEN k <= 20 THEN factorial(k::INTEGER)::BIGINT END AS f FROM range(40) r(k)")
def u_numbers(spark, sf_dir):
    n = F.col("id")
    return spark.range(40).select("id", L.is_power_of_two(n).alias("power"), F.when(n > 0, L.floor_log2(n)).alias("log"), L.factorial(n.cast("int")).alias("f"))


@query("u_matrix_power", "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 37.0::DOUBLE, 0.0::DOUBLE), (0, 1, 54, 0), (1, 0, 81, 0), (1, 1, 118, 0)) t(i, j, re, im)")
def u_matrix_power(spark, sf_dir):
    return matrices.power(Tensor.from_data(spark, ["i", "j"], [2, 2], [1, 2, 3, 4]), 3).shown()


@query("u_matrix_sum", "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE), (0, 1, 4, 0), (1, 0, 6, 0), (1, 1, 7, 0)) t(i, j, re, im)")
def u_matrix_sum(spark, sf_dir):
    m = Tensor.from_data(spark, ["i", "j"], [2, 2], [1, 2, 3, 4])
    return matrices.minus(add_all([m, m]), matrices.eye(spark, 2)).shown()


@query("u_diagonal", "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, round(exp(1.0) * cos(2.0), 6), round(exp(1.0) * sin(2.0), 6)), (1, 1, round(exp(3.0), 6), 0.0)) t(i, j, re, im)")
def u_diagonal(spark, sf_dir):
    return rounded(matrices.diagonal_exp(matrices.diagonal(spark, [1 + 2j, 3])).shown(), "re", "im")


@query("u_split", "SELECT * FROM (VALUES ('a.b.c', ['a', 'b', 'c'], ['a', 'b.c'], 'a-b-c'), ('x', ['x'], ['x'], 'x')) t(text, parts, once, replaced)")
def u_split(spark, sf_dir):
    rows, t = spark.createDataFrame([("a.b.c",), ("x",)], "text string"), F.col("text")
    return rows.select(t, L.split_all_column(t, ".").alias("parts"), L.split_once_column(t, ".").alias("once"), F.replace(t, F.lit("."), F.lit("-")).alias("replaced"))


@query("u_split_marks", "SELECT * FROM (VALUES ('a = b , c , d', 'a/b/c,d'), ('x,y', 'x/y'), (' = ,', ''), ('p', 'p')) t(text, parts)")
def u_split_marks(spark, sf_dir):
    """White space goes, then each mark splits what is left once."""
    rows, t = spark.createDataFrame([("a = b , c , d",), ("x,y",), (" = ,",), ("p",)], "text string"), F.col("text")
    return rows.select(t, F.array_join(L.split_marks_column(t, ["=", ","]), "/").alias("parts"))


@query("u_listed", f"WITH {SP}, t AS (SELECT s, list(p ORDER BY p) AS ps FROM sp GROUP BY s) SELECT s, '{{' || array_to_string(ps, '  ') || '}}' AS listed, '{{' || s || ',' || len(ps) || '}}' AS paired FROM t")
def u_listed(spark, sf_dir):
    """Lists and pairs as text."""
    t = tables.line_items(spark, sf_dir, "s", "p").shown().groupBy("s").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return t.select("s", L.listed_column(F.col("ps")).alias("listed"), L.paired_column(F.col("s"), F.size("ps")).alias("paired"))


@query("u_guard", "SELECT r AS kind, CASE r WHEN 'inside' THEN 25::BIGINT ELSE NULL END AS n FROM (VALUES ('inside'), ('outside')) t(r)")
def u_guard(spark, sf_dir):
    """A relation whose coordinates are checked in the plan: rows within the dimension pass, others fail the query."""
    nation, out = tables.read(spark, sf_dir, "nation"), []
    for kind, size in (("inside", 25), ("outside", 24)):
        t = Tensor.from_relation(nation, {"n": F.col("n_nationkey")}, F.lit(1), dims={"n": size}, unique=True, check=True)
        try:
            out.append((kind, sum(r["x0"] >= 0 for r in t.df.collect())))
        except Exception as e:  # the executor's error
            assert "out of range" in str(e)
            out.append((kind, None))
    return spark.createDataFrame(out, "kind string, n bigint")


@query("u_memory", "SELECT true AS total, true AS available")
def u_memory(spark, sf_dir):
    total, available = L.memory_kb()
    return spark.createDataFrame([(total > 0 or total == -1, -1 <= available <= max(total, -1))], "total boolean, available boolean")


@query("u_version", "SELECT '0.2.0' AS version")
def u_version(spark, sf_dir):
    return spark.createDataFrame([(weftnet.__version__,)], "version string")
