"""Lowering of contraction plans to shared, lazy DataFrames.

A task is a step of a plan; its key is the identity of the sub-plan below it, so networks that share
tensors and a beginning of their paths share the DataFrames (and Spark the exchanges). What is used
more than once can be persisted and is released after the action.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from weftnet.operators.network import Network
from weftnet.operators.tensor import Tensor, add_all
from weftnet.plans.path import Path, PathPlan

#: Rows that the default action of `submit` brings to the driver at most.
MOST_ROWS = 1 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the cluster's checkpoint folder; only a local session may use a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftnet-"))
    return df.checkpoint()


def rows_of(df: DataFrame) -> list:
    """The rows of a small result; more than MOST_ROWS are refused."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; give another action")
    return rows


class TaskGraph:
    """`cut_steps`: a chain of so many steps is cut by a checkpoint, as plans grow with every step."""

    def __init__(self, cut_steps: int | None = None):
        self.tensors: dict[tuple, Tensor] = {}
        self.uses: Counter = Counter()
        self.results: list[Tensor] = []
        self.flops = self.memory = 0.0
        self.cut_steps = cut_steps
        self._depth: dict[tuple, int] = {}
        self._held: list[Tensor] = []
        self._reduced: Tensor | None = None
        self.edges: list[tuple[str, str]] = []

    def add(self, network: Network, plan: PathPlan | None = None) -> int:
        """Adds a network's contraction; returns how many of its tasks were there already.

        The last step is a task of its own for every network. A network of one tensor is its own result.
        """
        plan = plan or network.plan()
        keys: list[tuple] = [("leaf", id(n.tensor)) for n in network.nodes]
        for key, n in zip(keys, network.nodes, strict=True):
            self.tensors.setdefault(key, n.tensor)
        if not plan.path:
            self.results.append(network.nodes[0].tensor)
            return 0
        shared = 0
        for i, (a, b) in enumerate(plan.path):
            step = plan.steps[plan.n_leaves + i]
            key = ("step", keys[a], keys[b])
            if i == len(plan.path) - 1:
                key = (*key, len(self.results))
            keys.append(key)
            if key in self.tensors:
                shared += 1
                continue
            self.uses.update({keys[a]: 1, keys[b]: 1})
            self.edges += [(plan.steps[a].name, step.name), (plan.steps[b].name, step.name)]
            made = self.tensors[keys[a]].contract(self.tensors[keys[b]])
            depth = 1 + max(self._depth.get(keys[a], 0), self._depth.get(keys[b], 0))
            if self.cut_steps and depth >= self.cut_steps:
                made, depth = Tensor(checkpointed(made.df), made.labels, made.dims, made.summed), 0
            self.tensors[key], self._depth[key] = made, depth
            self.flops += plan.step_flops(step.id)
            self.memory += plan.step_memory(step.id)
        self.results.append(self.tensors[keys[-1]])
        return shared

    def include(self, other: TaskGraph) -> None:
        """Takes over another graph's tasks and results; what both have is shared. flops and memory stay this graph's own."""
        shared = self.tensors.keys() & other.tensors.keys()
        for key, t in other.tensors.items():
            self.tensors.setdefault(key, t)
            if key not in shared:
                self._depth[key] = other._depth.get(key, 0)
        for key, n in other.uses.items():
            self.uses[key] = max(self.uses[key], n)
        self.edges += [e for e in other.edges if e not in self.edges]
        self.results += other.results

    def reduce(self) -> Tensor:
        """The sum of all results, whenever it is asked for."""
        if not self.results:
            raise ValueError("there is nothing to add up")
        return add_all(self.results)

    def hold(self) -> int:
        """Persists the tensors that several tasks use; returns how many."""
        self._held = [self.tensors[k] for k, n in self.uses.items() if n > 1 and k[0] == "step"]
        for t in self._held:
            t.df.persist(StorageLevel.MEMORY_AND_DISK)
        return len(self._held)

    def release(self) -> int:
        """Lets go of what `hold` persisted; returns the number of tensors that a task consumes."""
        for t in self._held:
            t.df.unpersist()
        self._held = []
        return len(self.uses)

    def contract(self) -> list[DataFrame]:
        return [t.df for t in self.results]

    def submit(self, action=rows_of) -> list[Future]:
        """Starts an action on every result at once; independent jobs run side by side."""
        pool = ThreadPoolExecutor(max_workers=max(1, min(8, len(self.results))))
        out = [pool.submit(action, df) for df in self.contract()]
        pool.shutdown(wait=False)
        return out

    def dot(self) -> str:
        """The task graph in DOT."""
        lines = [f'  "{a}" -> "{b}";' for a, b in self.edges]
        return "digraph tasks {\n" + "\n".join(lines) + "\n}"


def contract_sliced(network: Network, labels: Sequence[str], path: Path | None = None) -> Tensor:
    """Contracts all slices along labels side by side and adds them up last.

    The sliced labels stay a grouping key through the whole tree, which spreads the work by slice
    without a plan for each one.
    """
    plan = network.plan(path)
    for x in labels:
        network._dim(x)
    made = [n.tensor for n in network.nodes]
    for a, b in plan.path:
        made.append(made[a].contract(made[b], keep=labels))
    return made[-1].sum_out([x for x in labels if x in made[-1].labels])


def contract_each_slice(network: Network, labels: Sequence[str], values: Sequence[int], path: Path | None = None) -> TaskGraph:
    """A task graph with a contraction for each slice, sharing what the slices have in common."""
    graph, fixed = TaskGraph(), {}
    for v in values:
        part = network.copy()
        part.slice(labels, v)
        for n, whole in zip(part.nodes, network.nodes, strict=True):  # equal slices of a tensor are one leaf
            n.tensor = fixed.setdefault((id(whole.tensor), tuple(n.labels)), n.tensor)
        graph.add(part, part.plan(path))
    return graph

