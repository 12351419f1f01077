from __future__ import annotations

import glob
import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import SCHEMA, WORD, frame, odd_rows, prose, words
from tests.llm.test_text_operators import brute_components, ids_of
from weftnet.llm import common, langid
from weftnet.llm.common import fresh_path
from weftnet.llm.queries import QUERIES


def test_stages(spark, tmp_path):
    docs = frame(spark).drop("row", "rest")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    ids = {name: sorted(x["doc_id"] or -1 for x in df.select("doc_id").collect()) for name, df in seen.items()}
    assert len(ids["language_id"]) == len(odd_rows()) - 3  # a null, an empty text and one without letters
    assert ids["near_duplicates"].count(1) == 1 and 2 not in ids["near_duplicates"]
    assert ids["repeated_passages"] == ids["near_duplicates"]
    assert seen["packed_sequences"].agg({"length": "sum"}).first()[0] > 0


def test_run_and_empty_table(spark, tmp_path):
    frame(spark, odd_rows()[:3]).drop("row", "rest").write.parquet(str(tmp_path / "one/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "one")).count() > 0
    frame(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def corpus():
    """Two languages, junk, exact and near copies, passages that repeat, a hot source and a null one."""
    r = random.Random(12)
    sounds = {"aa": "abcde", "bb": "mnopq"}
    say = lambda lang, n: " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randrange(3, 8))) for _ in range(n))
    shared = say("aa", 40)
    rows = []
    for k in range(160):
        lang = "aa" if k % 3 else "bb"
        text = say(lang, r.randrange(8, 160))
        if k % 9 == 1:
            text += " " + shared[k : k + 140] + " " + say(lang, 12)
        rows.append((k * 3, text, lang if k % 5 else None, [None, "big", "big", "big", "s", "t"][k % 6]))
    for k in range(20):
        near = rows[k][1].split()
        near[len(near) // 2] = "changed"
        rows.append((1000 + k, rows[k + 30][1], "aa", "t"))
        rows.append((2000 + k, " ".join(near), "aa", "u"))
    rows += [(3000, None, "aa", "t"), (3001, "", "aa", "t"), (3002, "12 ?!", "aa", "t"), rows[5], rows[5]]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


def slow_pipeline(spark, rows):
    """(doc_id, tokens): how many documents the packed corpus has of each, by brute force."""
    model = langid.train(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang"), F.lit(True))
    kept = []
    for row in rows:
        data = (row[1] or "").encode()
        if not any(c.isalpha() for c in row[1] or ""):
            continue
        size = model.window
        begins = [min(a, max(0, len(data) - size)) for a in range(0, max(1, len(data)), size)]
        lp = np.mean([model.log_probs(np.frombuffer(data[a : a + size].ljust(size, b"\0"), np.uint8)[None])[0] for a in begins], axis=0)
        if np.exp(lp).max() / np.exp(lp).sum() >= 0.3:
            kept.append(row)
    component, _ = brute_components(kept, 5, 80, 100)
    kept = sorted({row for row in kept if component[row[0]] == row[0]}, key=lambda row: row[0])
    seen, cut = set(), []
    for d, t, _, s, _ in kept:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        cut.append((d, bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore"), s))
    size = Counter()
    for _, t, s in cut:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, left, open_ = {s: 1 + k % 3 for k, s in enumerate(order)}, {}, float(sum(size.values())), set(order)
    while open_:  # what is above three times its size gets that, the rest is shared again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]} or open_
        for s in full:
            target[s] = min(share[s], 3.0 * size[s])
            left -= target[s]
        open_ -= full
    out = Counter()
    for s in order:
        copies, budget = divmod(round(target[s]), size[s])
        for d, t, _ in sorted((x for x in cut if x[2] == s), key=lambda x: int(hashlib.md5(str(x[0]).encode()).hexdigest()[:15], 16)):
            n = len(WORD.findall(t))
            take = min(n, budget)
            budget -= take
            ends = [m.end() for m in WORD.finditer(t)]
            texts = [t] * (copies + (take == n > 0)) + ([t[: ends[take - 1]]] if 0 < take < n else [])
            for x in texts:
                out[d, len(ids_of(x)) + 1] += 1
    return out


def test_rows_are_those_of_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter()
    for x in corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect():
        n, rest = divmod(x[2], x["doc_tokens"])
        assert rest == 0
        got[x["doc_id"], x["doc_tokens"]] = n
    want = slow_pipeline(spark, rows)
    assert got == want
    assert {d for d, _ in want} < {row[0] for row in rows} and len(want) > 100


def test_stages_leave_nothing_behind(spark, tmp_path):
    frame(spark, odd_rows()[:6]).drop("row", "rest").write.parquet(str(tmp_path / "documents.parquet"))
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(glob.glob(f"{folder}/*")) - before) == 1  # the last stage's rows


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_every_query_runs(spark, name):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    sf_dir = "/root/testdata/sf0.001"
    df = (QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if "doc_id" in df.columns and name not in ("op4_pack_sequences", "pipeline"):
        assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
