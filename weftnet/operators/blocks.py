"""The dense-block tier: many small contractions at once, in numpy on Arrow batches.

Worth it where every intermediate is small, as in a network of gates that is contracted for every row
of a table, or for every slice. Leaves are sent to the executors, so their size is checked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from weftnet.functions.positions import ravel_column, strides, unravel, unravel_columns
from weftnet.operators.network import Network, n_slices
from weftnet.operators.tensor import Tensor, _names, _summed
from weftnet.plans.path import Path, PathPlan

#: Elements of all leaves, and of the largest intermediate, that a block may have.
LEAF_ELEMENTS, STEP_ELEMENTS = 1 << 22, 1 << 24


def pair(a: np.ndarray, x: Sequence[str], b: np.ndarray, y: Sequence[str]) -> tuple[np.ndarray, list[str]]:
    """Contracts two arrays over the labels they share."""
    shared = [label for label in x if label in y]
    out = np.tensordot(a, b, axes=([x.index(s) for s in shared], [y.index(s) for s in shared]))
    return out, [label for label in x if label not in shared] + [label for label in y if label not in shared]


def fits(plan: PathPlan) -> bool:
    """Whether every tensor of a plan is small enough for a block."""
    sizes = [plan.step_memory(s.id) for s in plan.steps]
    return sum(sizes[: plan.n_leaves]) <= LEAF_ELEMENTS and max(sizes) <= STEP_ELEMENTS


def contract_slices(network: Network, labels: Sequence[str], path: Path | None = None) -> Tensor:
    """The contraction of a network of small dense tensors: a row a slice, each in numpy, summed by Spark."""
    plan = network.plan(path)
    if not fits(plan):
        raise ValueError("the network is too large for dense blocks")
    leaves = [(list(n.tensor.labels), np.array(n.tensor.data(), np.complex128).reshape(n.tensor.dims)) for n in network.nodes]
    dims = [network._dim(x) for x in labels]
    pairs, out_labels = list(plan.path), [x for x in plan.steps[-1].labels if x not in labels]
    out_dims = [network._dim(x) for x in out_labels]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for value in pdf["id"]:
                at = dict(zip(labels, unravel(int(value), dims), strict=True)) if labels else {}
                made = [([x for x in names if x not in at], a[tuple(at.get(x, slice(None)) for x in names)]) for names, a in leaves]
                for i, j in pairs:
                    a, x = pair(made[i][1], made[i][0], made[j][1], made[j][0])
                    made.append((x, a))
                x, a = made[-1]
                a = np.transpose(a, [x.index(label) for label in out_labels])
                where = np.nonzero(a)
                columns = {f"x{k}": w for k, w in enumerate(where)}
                values = a[where] if a.ndim else a.reshape(1)
                yield pd.DataFrame(columns | {"re": values.real, "im": values.imag})

    schema = ", ".join([*(f"{n} long" for n in _names(len(out_labels))), "re double", "im double"])
    spark = network.nodes[0].tensor.spark
    rows: DataFrame = spark.range(n_slices(network, labels) if labels else 1).mapInPandas(run, schema)
    return Tensor(_summed(rows, _names(len(out_labels))), tuple(out_labels), tuple(out_dims))


def contract_rows(batch: DataFrame, values: str, labels: Sequence[str], dims: Sequence[int], network: Network, keys: Sequence[str]) -> DataFrame:
    """For every row: the contraction of its array column `values` (row-major over labels) with a network.

    Returns the key columns, and re and im as arrays in row-major order over the result's labels.
    """
    keys, labels, dims = list(keys), list(labels), list(dims)
    row_elements = _row_elements(labels, dims, network)
    if sum(n.tensor.size for n in network.nodes) > LEAF_ELEMENTS or row_elements > STEP_ELEMENTS:
        raise ValueError("the network is too large for dense blocks")
    together = max(1, STEP_ELEMENTS // max(1, row_elements))
    leaves = [(list(n.tensor.labels), np.array(n.tensor.data(), np.complex128).reshape(n.tensor.dims)) for n in network.nodes]

    def run(batches):
        import pandas as pd

        for pdf in (pdf.iloc[at : at + together] for pdf in batches for at in range(0, len(pdf), together)):
            a, x = np.stack(pdf[values].to_numpy()).astype(np.complex128).reshape(len(pdf), *dims), ["\0row", *labels]
            for names, g in leaves:
                a, x = pair(a, x, g, names)
            flat = np.moveaxis(a, x.index("\0row"), 0).reshape(len(pdf), -1)
            out = pdf[keys].copy()
            out["re"], out["im"] = list(flat.real.copy()), list(flat.imag.copy())
            yield out

    kinds = dict(batch.dtypes)
    return batch.select(*keys, values).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", re array<double>, im array<double>")


def _row_elements(labels: Sequence[str], dims: Sequence[int], network: Network) -> int:
    """Elements of the largest intermediate when a row's tensor meets the nodes one by one, from metadata."""
    size = dict(zip(labels, dims, strict=True)) | {x: d or 1 for x, d in network.dims().items()}
    now, most = set(labels), 0
    for part in [set(), *(set(n.tensor.labels) for n in network.nodes)]:
        now = now ^ part
        most = max(most, int(np.prod([size[x] for x in now], dtype=object)))
    return most


def apply_matrix(re, im, dims: Sequence[int], wires: Sequence[int], matrix: np.ndarray):
    """A gate on some axes of a dense row: new re and im arrays as columns, from array columns in row-major order.

    Each place of the result is a sum over the non-zero entries of one matrix row, so this stays in the
    JVM and moves nothing; the matrix acts on the axes `wires`, the first most significant.
    """
    from pyspark.sql import functions as F

    step = strides(dims)
    size = [dims[w] for w in wires]
    shift = [int(sum(d * step[w] for d, w in zip(unravel(k, size), wires, strict=True))) for k in range(matrix.shape[1])]
    digit = lambda i, w: F.pmod(F.call_function("div", i, F.lit(step[w])), F.lit(dims[w]))

    def place(part):
        def one(i):
            row = ravel_column([digit(i, w) for w in wires], size)
            base = i
            for w in wires:
                base = base - digit(i, w) * step[w]
            cases = None
            for o in range(matrix.shape[0]):
                total = F.lit(0.0)
                for k in np.flatnonzero(matrix[o]).tolist():
                    x, at = matrix[o, k], (base + shift[k] + 1).cast("int")
                    a, b = F.element_at(re, at), F.element_at(im, at)
                    total = total + (a * float(x.real) - b * float(x.imag) if part == 0 else a * float(x.imag) + b * float(x.real))
                cases = F.when(row == o, total) if cases is None else cases.when(row == o, total)
            return cases

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(int(np.prod(dims)) - 1).cast("long")), one)

    return place(0), place(1)


def contract_blocked(a: Tensor, b: Tensor, block: int = 256, spread: int = 32) -> Tensor:
    """Contraction of dense tensors in square blocks: a join of blocks on the summed index, numpy products, a sum.

    Where both operands are dense, the join of relations makes a row a multiplication; this makes one for
    each value of a pair of blocks. A block holds block**2 values at most. If the right operand's size is
    known and at most LEAF_ELEMENTS, it is broadcast and the left one's blocks stay where they are.
    Otherwise blocks meet on the summed block and a share of the left one's row blocks (`spread` shares,
    to each of which the right operand's blocks are copied), so that few summed blocks still are many
    keys. Labels keep the order of Tensor.contract; an unknown dimension may only be that of a single
    free label.
    """
    from pyspark.sql import functions as F

    shared = [x for x in a.labels if x in b.labels]
    if not shared:
        raise ValueError("a blocked contraction needs a shared label")
    free = [[x for x in t.labels if x not in shared] for t in (a, b)]

    def line(t: Tensor, labels: Sequence[str]):
        """Position along labels as one column."""
        if len(labels) == 1:
            return t.column(labels[0])
        return ravel_column([t.column(x) for x in labels], [_known(t, x) for x in labels])

    def packed(t: Tensor, rows: Sequence[str], columns: Sequence[str], prefix: str):
        df = t.df.select(line(t, rows).alias("i"), line(t, columns).alias("j"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
        part = lambda c: F.call_function("div", F.col(c), F.lit(block)).alias(f"{prefix}{c}")
        value = F.struct((F.pmod("i", F.lit(block)) * block + F.pmod("j", F.lit(block))).cast("int").alias("at"), "re", "im")
        rows = df.groupBy(part("i"), part("j")).agg(F.collect_list(value).alias("v"))
        return rows.select(f"{prefix}i", f"{prefix}j", *[F.col(f"v.{c}").alias(f"{prefix}_{c}") for c in ("at", "re", "im")])

    left, right = packed(a, free[0], shared, "a"), packed(b, shared, free[1], "b")
    if all(d is not None for d in b.dims) and b.size <= LEAF_ELEMENTS:
        pairs = left.join(F.broadcast(right), F.col("aj") == F.col("bi"))
    else:
        right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        pairs = left.join(right, (F.col("aj") == F.col("bi")) & (F.pmod("ai", F.lit(spread)) == F.col("share")))
    pairs = pairs.select("ai", "bj", *[f"{side}_{c}" for side in "ab" for c in ("at", "re", "im")])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                m = []
                for at, re, im in ((row.a_at, row.a_re, row.a_im), (row.b_at, row.b_re, row.b_im)):
                    flat = np.bincount(at, re, block * block) + 1j * np.bincount(at, im, block * block)
                    m.append(flat.reshape(block, block))
                out = m[0] @ m[1]
                i, j = np.nonzero(out)
                yield pd.DataFrame({"i": i + row.ai * block, "j": j + row.bj * block, "re": out[i, j].real, "im": out[i, j].imag})

    found = pairs.mapInPandas(run, "i long, j long, re double, im double")
    found = found.groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).filter("re <> 0 OR im <> 0")
    labels, columns = [*free[0], *free[1]], []
    for c, t, part in (("i", a, free[0]), ("j", b, free[1])):
        columns += [F.col(c)] if len(part) == 1 else unravel_columns(F.col(c), [_known(t, x) for x in part])
    rows = found.select(*[c.alias(n) for n, c in zip(_names(len(labels)), columns, strict=True)], "re", "im")
    return Tensor(rows, tuple(labels), tuple([a.dim(x) for x in free[0]] + [b.dim(x) for x in free[1]]))


def _known(t: Tensor, label: str) -> int:
    d = t.dim(label)
    if d is None:
        raise ValueError(f"the number of values of {label!r} isn't known")
    return d
