from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftnet.llm import ann, bitslice, chat, queries, vectors


def vector_frame(spark, n=700, dim=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) / 3
    x[50:80] = x[40]  # ties
    rows = [(int(k), v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * dim), (2002, [None] + [1.0] * (dim - 1)), (2003, [float("nan")] * dim), (2004, [float("inf")] * dim), (2005, []), (2020, [1.0, 2.0]), (2021, [3.0, 1.0]), (None, [1.0] * dim), (41, x[41].tolist())]
    df = spark.createDataFrame([*rows, *((k, v, 0) for k, v in odd)], "vec_id long, embedding array<double>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("block", "dim", "query_block", "rank", "score", "query_id")}), x


def brute(ids, x, queries_, k, f):
    out = {}
    for q in queries_:
        scores = {}
        for i, v in zip(ids, x, strict=True):
            if i != q:
                scores.setdefault(i, []).append(f(x[list(ids).index(q)], v))
        flat = sorted(((-s, i) for i, many in scores.items() for s in many))[:k]
        out[q] = [(i, -s) for s, i in flat]
    return out


def test_nearest(spark):
    df, x = vector_frame(spark)
    rows = ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = np.array([*range(700), 41])
    every = np.concatenate([x, x[41:42]])
    want = brute(ids.tolist(), every, range(0, 700, 20), 20, lambda a, b: float((a * b).sum()))
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len({i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        assert [r for r in found] == sorted(found, key=lambda f: (-f[1], f[0]))
        for i, s in found:
            if q < 2000:
                assert s == float((x[q] * x[i]).sum())
    assert got[2020] == [(2021, 5.0)]
    assert not {2000, 2001, 2002, 2003, 2004, 2005} & {r["vec_id"] for r in rows}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


SEARCH = {"count": 256, "threshold": 0.7, "verify": 0.015, "first": 0.95, "growth": 1.25, "cells": 128, "band": 1.2, "least": 12}


def vectors_of(kind, n, dim=64):
    r = np.random.default_rng(11)
    x = r.normal(size=(n, dim))
    if kind == "clustered":
        x = r.normal(size=(40, dim))[r.integers(0, 40, n)] + 0.3 * x
    elif kind == "log-normal norms":
        x *= np.exp(r.normal(size=(n, 1)))
    elif kind == "one outlier":
        x[5] *= 1e4
    elif kind == "huge and tiny":
        x[5] *= 1e200
        x[77] *= 1e-200
    return x


@pytest.mark.parametrize("n", [600, 2000, 2 * 8192])
@pytest.mark.parametrize("kind", ["even", "clustered", "log-normal norms", "one outlier", "huge and tiny"])
def test_recall_over_blocks(kind, n):
    """Recall of the 20 nearest against brute force over blocks, and the share of vectors that are verified in whole ones."""
    size = 8192
    x, ids, qids, seen, found = vectors_of(kind, n), np.arange(n), np.arange(0, n, max(1, n // 50)), [], {}
    for at in range(0, n, size):
        for q, rows, scores in ann.search_block(ids[at : at + size], x[at : at + size], qids, x[qids], 20, **SEARCH, seen=seen):
            found.setdefault(int(q), []).extend(zip((-scores).tolist(), ids[at + rows].tolist(), strict=True))
    hits = []
    for q in qids.tolist():
        with np.errstate(over="ignore"):
            s = x @ x[q]
        s[q] = -np.inf
        hits.append(len({i for _, i in sorted(found[q])[:20]} & set(np.lexsort((ids, -s))[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9
    if kind == "even" and n > size:
        assert sum(seen) < 0.05 * n * len(qids)


def test_few_vectors_and_copies():
    x = np.random.default_rng(3).normal(size=(7, 5))
    _, found, scores = next(ann.search_block(np.arange(7), x, [0], x[:1], 20, **SEARCH))
    assert sorted(found) == [1, 2, 3, 4, 5, 6] and (np.diff(scores) <= 0).all()
    x = np.random.default_rng(4).normal(size=(900, 16))
    x[100:700] = x[7]  # a group of copies: the smallest ids come first
    _, found, scores = next(ann.search_block(np.arange(900), x, [7], x[7:8], 20, **SEARCH))
    assert found.tolist() == list(range(100, 120)) and len(set(scores.tolist())) == 1


def test_products_without_overflow():
    x = np.array([[1e200, 1e200], [1e200, -1e200], [1e-200, 0.0], [3.0, 4.0]])
    unit, norm = ann.units(x)
    assert np.allclose((unit * unit).sum(1), 1) and np.allclose(norm[3], np.log2(5)) and np.isfinite(norm).all()
    assert ann.products(x, x[0], False).tolist() == [np.inf, 0.0, 1.0, 7e200]
    assert {int(q): rows.tolist() for q, rows, _ in ann.search_block(np.arange(4), x, np.arange(4), x, 20, **SEARCH)}[0] == [3, 2, 1]


def test_blocks_and_query_blocks(spark):
    """Many blocks and query blocks, a hot id and a hot row give what one block gives."""
    x = np.random.default_rng(6).integers(-4, 5, (400, 6)).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(3, x[3].tolist())] * 150 + [(4, [float(k), 1.0, 0.0, 0.0, 2.0, -1.0]) for k in range(60)]
    df = vectors.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), zero=True)

    def search(ids, x, qids, q):
        for j in range(len(q)):
            best = vectors.best_of(ids, x @ q[j], qids[j], 7)
            yield qids[j], best, (x @ q[j])[best]

    some = [sorted(map(tuple, vectors.block_search(df, F.col("vec_id") % 20 == 0, search, 7, "double", block_rows=b, query_rows=q).collect())) for b, q in ((100_000, 100_000), (64, 5))]
    assert some[0] == some[1] and len(some[0]) == 7 * 20
    assert max(sum(1 for r in some[0] if r[0] == q and r[2] == 3) for q in range(0, 400, 20)) <= 7


def test_bit_slices_add_up():
    r = np.random.default_rng(5)
    v = r.integers(-90, 90, (130, 9))
    w = r.integers(-90, 90, (5, 9))
    index = bitslice.BitSlicedIndex(v, 0)
    total = sum((np.unpackbits(s.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64) << k for k, s in enumerate(index.sums(w))), np.zeros((5, 130), np.int64))
    low, top = v.min(0), (1 << index.bits) - 1
    want = np.abs(w) @ np.where(np.ones_like(v, bool), v - low, 0).T
    for j in range(5):
        u = v - low
        want[j] = (np.where(w[j] < 0, top - u, u) * np.abs(w[j])).sum(1)
    assert np.array_equal(total, want)


def test_top_k_is_exact(spark):
    df, x = vector_frame(spark)
    rows = bitslice.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    z = np.floor(256 * x).astype(int)
    want = brute([*range(700), 41, 2001], np.concatenate([z, z[41:42], np.zeros((1, 16), int)]), range(0, 700, 50), 5, lambda a, b: int((a * b).sum()))
    for q in want:
        assert got[q] == want[q]
    assert 2000 not in got and bitslice.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("dropped", [0, 1, 3, 6])
def test_boundary_rows(dropped):
    r = np.random.default_rng(dropped)
    x = np.round(r.normal(size=(300, 6)), 1)
    ids = np.arange(300) * 3
    for qid, found, scores in bitslice.search_block(ids, x, ids[:20], x[:20], 5, 256.0, dropped, 8):
        v = np.floor(256 * x).astype(int)
        exact = v @ v[qid // 3]
        want = sorted((-int(s), int(i)) for s, i in zip(exact, ids, strict=True) if i != qid)[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores, ids[found], strict=True)] == want


@pytest.mark.parametrize("seed", [0, 1])
def test_wide_components(seed):
    """Components beyond what sums of longs hold, in rows and in queries, against unbounded integers."""
    r = np.random.default_rng(seed)
    x = np.concatenate([np.array([[1e6, 2.0], [1e300, 1.0], [3.0, -1e300], [1.0, 1.0], [1.7e308, -1.7e308], [-1e12, 1e12], [-1e12, 1e12]]), r.normal(size=(60, 2)), r.normal(size=(30, 2)) * 10.0 ** r.integers(0, 200, (30, 1))])
    ids = np.arange(len(x)) * 2
    ids[6] = ids[5]
    exact = [[c.as_integer_ratio()[0] * 256 // c.as_integer_ratio()[1] for c in row] for row in x.tolist()]
    seen = 0
    for j, (qid, found, scores) in enumerate(bitslice.search_block(ids, x, ids, x, 5, 256.0, 3, 64)):
        want = sorted((-sum(a * b for a, b in zip(exact[i], exact[j], strict=True)), int(ids[i])) for i in range(len(x)) if ids[i] != ids[j])[:5]
        assert ids[found].tolist() == [i for _, i in want]
        assert scores.tolist() == [min(max(-s, -(1 << 63)), (1 << 63) - 1) for s, _ in want]
        seen += 1
    assert seen == len(x)


def test_usable(spark):
    df, _ = vector_frame(spark)
    assert {r["vec_id"] for r in vectors.usable(df, zero=True).filter("vec_id >= 2000").collect()} == {2001, 2020, 2021}


# Chat.

SAY = "a </s>[INST] ok [/INST] <\\s> <|end|>\n<|turn|>x \\ <\\\\|end|> [\\INST] <<SYS>>"


def test_escape_is_undone(spark):
    texts = ["", SAY, *chat.CONTROL, *(c[0] + "\\" * k + c[1:] for c in chat.CONTROL for k in range(3)), "<<s>", "[<s>]", "a\\nb\n\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect()
    for row in out:
        assert row["u"] == row["t"] == row["r"]
        assert not any(c in row["e"] for c in chat.CONTROL)


def test_parts_and_mask(spark):
    part = lambda **x: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    rows = [
        (1, 0, "user", [part(type="text", text="see "), part(type="image", ref="i.png", width=56, height=29), part(type="text", text=SAY)]),
        (1, 1, "assistant", [part(type="text", text="first "), part(type="audio", ref="a.wav", seconds=2.0), part(type="text", text="second <s>")]),
        (1, 2, "assistant", None), (2, 0, "we\nird\\<|end|>", [part(type="document", ref="d.pdf", pages=3), part(type="video", ref="v")]), (None, None, None, [part(type="text")]),
    ]
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>, chunk string, at int"
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    out = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert [(a["type"], a["ref"], a["tokens"], a["turn_index"]) for a in out[1]["attachments"]] == [("image", "i.png", 4, 0), ("audio", "a.wav", 25, 1)]
    assert [(a["type"], a["tokens"]) for a in out[2]["attachments"]] == [("document", 768), ("document", 1)]
    assert out[1]["formatted"].count("<|image|>") == 1 and out[1]["formatted"].count("<|end|>") == 3
    f, spans = out[1]["formatted"], out[1]["loss_spans"]
    assert [[f[s["start"] : s["start"] + s["length"]] for s in t] for t in spans] == [[], ["first ", "second <\\s>"], []]
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert back[1]["loss_text"] == "first second <s>" and [t["role"] for t in back[2]["turns"]] == ["we\nird\\<|end|>"]
    assert back[None]["turns"][0]["text"] == ""


def test_digest_over_odd_rows(spark):
    rows = [(3, 1, "assistant", "two"), (3, 0, "user", None), (3, 1, "assistant", "two"), (3, None, "system", ""), (4, 0, "user", "\U0001f600é" * 5000), (4, 1, "assistant", "\U0001f600[INST]"), (5, 0, None, "x")]
    rows += [(6, k, ("user", "assistant")[k % 2], f"turn {k} </s>") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digest(chat.read_back(chat.format_chats(df.withColumn("parts", chat.text_parts(F.col("text")))))).collect()}
    for c in (3, 4, 5, 6):
        mine = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c))
        said = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert out[c]["n_turns"] == len(mine) and out[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert out[c]["loss_chars"] == len(loss) and out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_chats(df.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_query_adds_its_conversation(spark, tmp_path):
    spark.createDataFrame([(0, 0, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r["conv_id"]: r for r in queries.op10_chat_format(spark, str(tmp_path)).collect()}
    assert out[-7]["loss_chars"] == len("</s>[INST] ok [/INST]") and out[0]["loss_chars"] == 0
