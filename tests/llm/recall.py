"""Prints op3's recall against brute force on a table: python -m tests.llm.recall /root/testdata/sf0.1"""

from __future__ import annotations

import sys

import numpy as np


def main(sf_dir: str) -> None:
    from pyspark.sql import SparkSession

    from weftnet.llm.queries import QUERIES, table

    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    found: dict[int, set[int]] = {}
    for r in QUERIES["op3_nearest_neighbours"](spark, sf_dir).select("query_id", "vec_id").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = [r for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect() if r["embedding"]]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    place = {i: k for k, i in enumerate(ids.tolist())}
    hits = []
    for q, mine in sorted(found.items()):
        s = x @ x[place[q]]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]].tolist()
        hits.append(len(mine & set(best)) / len(best))
    print(f"{sf_dir}: {len(rows)} vectors, {len(hits)} queries, recall {np.mean(hits):.4f}, worst query {min(hits):.2f}")


if __name__ == "__main__":
    main(sys.argv[1])
