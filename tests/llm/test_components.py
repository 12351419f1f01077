from __future__ import annotations

import random

import pytest

from weftnet.llm.components import components


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {
        "path": [(k, k + 1) for k in range(30)], "star": [(5, k) for k in range(40)] + [(100, 101)],
        "random": [(r.randrange(80), r.randrange(80)) for _ in range(45)], "none": [(7, 7)],
    }[kind]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    on_edge = {x for a, b in edges if a != b for x in (a, b)}
    edges = edges + edges[:3] + [(None, 4), (5, None), (None, None)]  # repeated edges count once, null ends not at all
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["id"]: x["component"] for x in got} == {x: find(x) for x in on_edge} and len(got) == len(on_edge)
