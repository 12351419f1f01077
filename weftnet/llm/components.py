"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.llm.common import fresh_path, scratch, staged, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id and component (smallest id it is connected with) of every id on an edge (a, b).

    Edges always point to a smaller id. A large-star step links the larger neighbours of an id to its
    smallest neighbour, a small-star step links the smaller ones and the id itself; both keep what is
    connected and end in stars, after a number of rounds that grows with the logarithm of the size.
    Minima are pre-aggregated, and tables that meet in a join are written first, so that Spark may
    split the neighbours of a hub. Repeated edges count once; edges with a null end or with equal ends
    don't count, and ids only on such edges have no row.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, name)
    with scratch(spark):
        written(_found(edges, name), path)
    return spark.read.schema("id long, component long").parquet(path)


def _found(edges: DataFrame, name: str) -> DataFrame:
    e = staged(edges.select("a", "b", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL AND u <> v").select("u", "v").distinct(), f"{name}_0")
    step = 0
    while not _stars(e):
        step += 1
        # large star: ids whose smallest neighbour is below them hand it to their larger neighbours
        both = e.select("u", "v").union(e.select("v", "u"))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u"), f"{name}_low{step}")
        up = e.select(F.col("v").alias("c"), F.col("u").alias("leaf"))
        large = up.join(low.withColumnRenamed("u", "c"), "c", "left").select(F.col("leaf").alias("u"), F.least("c", "m").alias("v"))
        large = staged(large.filter("u <> v").distinct(), f"{name}_large{step}")
        # small star: each id links itself and its smaller neighbours to the smallest of them
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}_least{step}")
        near = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(near.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), f"{name}_{step}")
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _stars(e: DataFrame) -> bool:
    """Whether every id has one smaller neighbour at most, and none that has one is a smaller neighbour itself."""
    roles = e.select(F.col("u").alias("id"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(e.select("v", F.lit(0), F.lit(1)))
    roles = roles.groupBy("id").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return roles.filter("ups > 1 OR (ups > 0 AND downs > 0)").isEmpty()
