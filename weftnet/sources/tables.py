"""Tensors from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.functions.positions import unravel_columns
from weftnet.operators.tensor import Tensor

#: Values of an order priority and of an embedding.
PRIORITY_CODES = 5
EMBEDDING = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priority(column: str = "o_orderpriority") -> Column:
    """The digit that an order priority starts with, from 0."""
    return F.substring(column, 1, 1).cast("int") - 1


def line_items(spark: SparkSession, sf_dir: str, *labels: str, summed: bool = True) -> Tensor:
    """Quantity (re) and rows (im) by order o, supplier bucket s and part bucket p."""
    of = {"o": F.col("l_orderkey"), "s": F.col("l_suppkey") % 8, "p": F.col("l_partkey") % 16}
    labels = labels or ("o", "s", "p")
    return Tensor.from_relation(read(spark, sf_dir, "lineitem"), {x: of[x] for x in labels}, F.col("l_quantity").cast("bigint"), F.lit(1).cast("bigint"), {"s": 8, "p": 16}, summed)


def orders(spark: SparkSession, sf_dir: str, *labels: str) -> Tensor:
    """Rows by order o, customer bucket c, customer k and priority pr."""
    of = {"o": F.col("o_orderkey"), "c": F.col("o_custkey") % 8, "k": F.col("o_custkey"), "pr": priority()}
    labels = labels or ("o", "c", "pr")
    return Tensor.from_relation(read(spark, sf_dir, "orders"), {x: of[x] for x in labels}, F.lit(1).cast("bigint"), dims={"c": 8, "pr": PRIORITY_CODES}, unique="o" in labels)


def customers(spark: SparkSession, sf_dir: str) -> Tensor:
    return Tensor.from_relation(read(spark, sf_dir, "customer"), {"k": F.col("c_custkey"), "n": F.col("c_nationkey")}, F.lit(1).cast("bigint"), dims={"n": 25}, unique=True)


def nations(spark: SparkSession, sf_dir: str) -> Tensor:
    """Incidence of nations n and regions r."""
    return Tensor.from_relation(read(spark, sf_dir, "nation"), {"n": F.col("n_nationkey"), "r": F.col("n_regionkey")}, F.lit(1).cast("bigint"), dims={"n": 25, "r": 5}, unique=True, check=True)


def event_code() -> Column:
    """First letter of the event type, from 0."""
    return F.ascii("event_type") - 97


def events(spark: SparkSession, sf_dir: str) -> Tensor:
    """Rows (re) and hundredths of value (im, rounded before the sum) by user bucket u and event code e."""
    return Tensor.from_relation(read(spark, sf_dir, "events"), {"u": F.col("user_id") % 32, "e": event_code()}, F.lit(1).cast("bigint"), F.round(F.col("value") * 100).cast("bigint"), {"u": 32, "e": 26})


def embeddings(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = ("q0", "q1", "q2", "q3", "q4", "q5"), exact: bool = True) -> Tensor:
    """Embeddings as states of six binary labels, with their id v: thousandths as whole numbers, or raw doubles."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x"))
    x = F.col("x").cast("double")
    value = F.round(x * 1000).cast("bigint") if exact else x
    zero = F.lit(0).cast("bigint") if exact else F.lit(0.0)
    bits = unravel_columns(F.col("at").cast("long"), [2] * 6)
    df = rows.select(F.col("vec_id").alias("x0"), *[b.alias(f"x{k + 1}") for k, b in enumerate(bits)], value.alias("re"), zero.alias("im"))
    return Tensor(df, ("v", *labels), (None, *[2] * 6))
