"""Square-matrix helpers on tensors of two labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftnet.operators.tensor import Tensor


def order(m: Tensor) -> int:
    """Rows of a square matrix."""
    if m.rank != 2 or m.dims[0] != m.dims[1]:
        raise ValueError(f"not a square matrix: {list(m.dims)}")
    return m.dims[0]


def eye(spark: SparkSession, n: int, labels: Sequence[str] = ("i", "j")) -> Tensor:
    rows = spark.range(n).select(F.col("id").alias("x0"), F.col("id").alias("x1"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return Tensor(rows, tuple(labels), (n, n))


def multiply(a: Tensor, b: Tensor) -> Tensor:
    """Matrix product; the result has a's first and b's second label."""
    order(a), order(b)
    inner = "\0inner"
    return a.relabel(["\0row", inner]).contract(b.relabel([inner, "\0column"])).relabel([a.labels[0], b.labels[1] if b.labels[1] != a.labels[0] else a.labels[1]])


def power(a: Tensor, k: int) -> Tensor:
    """a multiplied k times, by repeated squaring."""
    out, base = eye(a.spark, order(a), a.labels), a
    while k:
        if k & 1:
            out = multiply(out, base)
        k >>= 1
        if k:
            base = multiply(base, base)
    return out


def minus(a: Tensor, b: Tensor) -> Tensor:
    return a.add(b.scale(-1))


def diagonal_exp(a: Tensor) -> Tensor:
    """exp of the diagonal, zeros elsewhere."""
    n = order(a)
    have = a.whole().df.where("x0 = x1").select("x0", "re", "im")
    d = a.spark.range(n).select(F.col("id").alias("x0")).join(have, "x0", "left")
    re, im = F.coalesce("re", F.lit(0.0)), F.coalesce("im", F.lit(0.0))
    return Tensor(d.select("x0", F.col("x0").alias("x1"), (F.exp(re) * F.cos(im)).alias("re"), (F.exp(re) * F.sin(im)).alias("im")), a.labels, (n, n))


def diagonal(spark: SparkSession, values: Sequence[complex], labels: Sequence[str] = ("i", "j")) -> Tensor:
    n = len(values)
    return Tensor.from_entries(spark, labels, [n, n], (((k, k), v) for k, v in enumerate(values)))
