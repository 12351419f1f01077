"""A stated query set against all vectors, block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftnet.llm.common import ship

#: Bytes of a block of vectors or of queries (fewer rows where vectors are long).
BLOCK_BYTES = 32 << 20


def usable(vectors: DataFrame, *, zero: bool) -> DataFrame:
    """vec_id, embedding (doubles) and dim of the rows without null or non-finite components; `zero` keeps zero vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter((F.size("embedding") > 0) & ~F.exists("embedding", bad))
    if not zero:
        rows = rows.filter(F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("dim", F.size("embedding"))


def block_search(rows: DataFrame, is_query: Column, search, k: int, score_type: str, block_rows: int = 8192, query_rows: int = 32768, least_queries: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what `search(ids, vectors, query_ids, queries)` finds in each block.

    `search` yields query id, places in the block and scores. Vectors meet queries of their own length
    only. A block of vectors and a block of queries go to one task; both have bounded sizes, whatever
    the table's, and every query meets every block once. Rows alike in id and vector are one row with a
    number of copies before blocks are dealt, and the block's number comes from a hash of both, so no id
    or vector fills a block. Of rows that share a query's id, the smallest embedding is the query.
    """
    spark = rows.sparkSession
    ship(spark)
    known = rows.agg(F.count("*"), F.count_if(is_query), F.max("dim")).first()
    bound = max(1, BLOCK_BYTES // (8 * (known[2] or 1)))
    blocks = max(1, -(-known[0] // min(block_rows, bound)))
    few = max(1, -(-known[1] // least_queries))  # of a small table, queries are dealt to more blocks, to keep all cores busy
    query_blocks = max(1, -(-known[1] // min(query_rows, bound)), min(few, -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    number = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = rows.groupBy("vec_id", "embedding", "dim").agg(F.count("*").alias("copies"))
    data = data.withColumn("block", number(blocks, "vec_id", "embedding")).withColumn("query_block", every(query_blocks))
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.select("vec_id", "embedding", F.size("embedding").alias("dim"), number(query_blocks, "vec_id").alias("query_block")).withColumn("block", every(blocks))

    def run(left, right):
        import numpy as np
        import pandas as pd

        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            left, right = left.sort_values("vec_id", kind="stable"), right.sort_values("vec_id", kind="stable")
            ids, x, copies = left["vec_id"].to_numpy(np.int64), np.stack(left["embedding"].to_numpy()), np.minimum(left["copies"].to_numpy(np.int64), k)
            qids, q = right["vec_id"].to_numpy(np.int64), np.stack(right["embedding"].to_numpy())
            for qid, place, s in search(ids, x, qids, q):
                n = copies[place]
                vid = np.repeat(ids[place], n)[:k]
                out["query_id"].append(np.full(len(vid), qid, np.int64))
                out["vec_id"].append(vid)
                out["score"].append(np.repeat(s, n)[:k])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}).astype({"score": "float64" if score_type == "double" else "int64"})

    keys = ["block", "query_block", "dim"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(ids, scores, own, k):
    """Positions of the k best scores, ties to smaller ids, `own` left out."""
    import numpy as np

    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        edge = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= edge]
    return keep[np.lexsort((ids[keep], ~scores[keep] if scores.dtype == np.int64 else -scores[keep]))][:k]
