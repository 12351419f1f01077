"""The running sum of a stream of tensor entries, as Structured Streaming state.

A stream of slices' entries (a column per label, re, im) adds up to one tensor: the same sum that a
reduction task makes of finished results. State is one row a coordinate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.operators.tensor import Tensor, _names


def running_sum(entries: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Entries (batch or stream) summed by coordinate; columns x0, x1, ..., re, im."""
    rows = entries.select(*[F.col(f"`{x}`").cast("long").alias(n) for n, x in zip(_names(len(labels)), labels, strict=True)], "re", "im")
    return rows.groupBy(*_names(len(labels))).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def start(entries: DataFrame, labels: Sequence[str], name: str):
    """Starts the running sum of a stream into the in-memory table `name`: for results that fit the driver."""
    return running_sum(entries, labels).writeStream.outputMode("complete").format("memory").queryName(name).start()


def start_updates(entries: DataFrame, labels: Sequence[str], path: str, checkpoint: str):
    """Starts the running sum of a stream into a table of updates: each trigger writes the coordinates it changed.

    Executors write them to a folder of the trigger's number, so a repeated trigger replaces its own rows.
    """

    def keep(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    return running_sum(entries, labels).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).start()


def latest(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    """The newest value of every coordinate in a table of updates."""
    names = _names(len(labels))
    rows = spark.read.parquet(path)
    return rows.groupBy(*names).agg(F.max_by(F.struct("re", "im"), "trigger").alias("v")).select(*names, "v.re", "v.im")


def current(df: DataFrame, labels: Sequence[str], dims: Sequence[int]) -> Tensor:
    """The tensor that a result table of `running_sum` holds now."""
    return Tensor(df, tuple(labels), tuple(dims))
