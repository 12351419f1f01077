from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, frame, odd_rows, prose, words
from weftnet.llm import common, jaccard, langid, lm, mixing, packing, suffix, toxicity
from weftnet.llm.common import id_crc, word_hashes
from weftnet.llm.queries import tokenizer_files


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def test_word_hashes_follow_rows():
    texts = ["Ab cd", "", " x\ty ", "ab CD é", "nobreak" * 300000]
    data = [t.encode() for t in texts]
    h, n = word_hashes(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    assert n.tolist() == [2, 0, 2, 3, 1]
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 6


# Near duplicates.


def brute_components(rows, width, num, den):
    sets = {}
    for d, t, *_ in rows:
        if d is not None:
            sets.setdefault(d, shingles(t, width))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_near_duplicates(spark, width, num):
    r = random.Random(width)
    rows = []
    for g in range(12):
        text = prose(r, r.choice([4, 30, 120, 300]), 5000).split()
        for _ in range(r.choice([1, 3, 12])):
            copy = list(text)
            for _ in range(r.randrange(0, 1 + len(copy) // 25)):
                copy[r.randrange(len(copy))] = f"new{r.randrange(99999)}"
            rows.append((len(rows), " ".join(copy), None, None, 0))
    rows += [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, " \n", None, None, 0)]
    want, sizes = brute_components(rows, width, num, 100)
    got = jaccard.near_duplicates(frame(spark, rows), width=width, num=num, den=100, block=8).collect()
    assert len(got) == len(rows)
    assert {x["doc_id"]: x["component_id"] for x in got} == want
    assert {x["doc_id"]: x["n_shingles"] for x in got} == sizes
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("how", [{}, {"block": 4, "block_shingles": 300}, {"bucket_bytes": 60}])
def test_near_duplicates_chains(spark, how):
    """Chains whose ends aren't similar, next to texts that share only a part: blocks, parts of hot buckets and all three steps."""
    r = random.Random(7)
    rows, text = [], prose(r, 120, 5000).split()
    for k in range(40):  # each differs from the one before in a word
        text = list(text)
        text[(7 * k) % 120] = f"w{k}"
        rows.append((500 - 3 * k, " ".join(text), None, None, 0))
    half = prose(r, 60, 5000)
    rows += [(1000 + k, half + " " + prose(random.Random(k), 60, 5000), None, None, 0) for k in range(25)]
    rows += [(2000 + k, rows[k % 5][1], None, None, 0) for k in range(20)]
    want, _ = brute_components(rows, 5, 80, 100)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(frame(spark, rows), **how).collect()}
    assert got == want and len(set(want.values())) > 20 and sum(1 for c in want.values() if c == min(want)) >= 40


def test_copies_have_no_keys_of_their_own(spark, monkeypatch):
    """Twelve copies of each text, in other tasks, make as many keys as one; no table of keys is left when pairs are verified."""
    texts = [prose(random.Random(k), 200, 5000) for k in range(20)]
    rows = [(100 * copy + k, text, None, None, 0) for copy in range(12) for k, text in enumerate(texts)]
    real, seen, open_tables = jaccard.groups_of, [], []

    def groups_of(packed, hot_bytes):
        seen.append((packed.agg(F.sum(F.length("docs"))).first()[0], [f.removeprefix("file://") for f in packed.inputFiles()]))
        return real(packed, hot_bytes)

    def verified(*a, f=jaccard.verified):
        open_tables.extend(path for path in seen[-1][1] if os.path.exists(path))
        return f(*a)

    monkeypatch.setattr(jaccard, "groups_of", groups_of)
    monkeypatch.setattr(jaccard, "verified", verified)
    for n in (len(texts), len(rows)):
        got = jaccard.near_duplicates(frame(spark, rows[:n]).repartition(12, "doc_id")).collect()
        assert {x["doc_id"]: x["component_id"] for x in got} == {d: d % 100 for d, *_ in rows[:n]}
    assert seen[0][0] == seen[1][0] > 0 and seen[1][1] and not open_tables


def test_ids_of_several_texts_lose_no_link(spark):
    """A copy of document 3 shares its id with another text, which is like document 20."""
    base, other = prose(random.Random(1), 120, 5000), prose(random.Random(2), 120, 5000).split()
    near = " ".join(["changed", *other[1:]])
    rows = [(3, base, None, None, 0), (12, base, None, None, 0), (12, " ".join(other), None, None, 0), (20, near, None, None, 0)]
    got = [(x["doc_id"], x["component_id"]) for x in jaccard.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == [(3, 3), (12, 3), (12, 12), (20, 12)]


def test_shuffle_files_go_with_a_staged_table(spark):
    blocks = lambda: {b for b in re.findall(r"shuffle_\d+_", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().toString())}
    before = blocks()
    out = common.staged(spark.range(5000).groupBy((F.col("id") % 999).alias("k")).count(), "some")
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before and out.count() == 999


def test_split_buckets_lose_no_pair(spark):
    """Whether a bucket is split or not, the same documents share a group."""
    half = prose(random.Random(3), 100, 5000)
    rows = [(k, f"{half} w{k} " + prose(random.Random(k), 4, 5000), None, None, 0) for k in range(60)]
    docs = frame(spark, rows).repartition(5).select("doc_id", "text")
    every = jaccard.describe(docs, 5, jaccard.Bands(80, 100), 64).filter("bucket IS NOT NULL").select("bucket", "keys", "docs")

    def shared(hot_bytes):
        of = defaultdict(set)
        for x in jaccard.groups_of(every, hot_bytes).collect():
            of[x["grp"]].add(x["doc"])
            assert x["pivot"] <= x["doc"]
        return {(a, b) for g in of.values() for a in g for b in g if a < b}

    whole = shared(1 << 40)
    assert len(whole) > 500 and shared(16) == whole and shared(200) == whole


def test_cluster_ships_texts_a_few_times(spark):
    """Rows of block pairs in a group of 20,000 with one component: those outside it meet all, the others only them."""
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("grp"), F.col("id").alias("doc_id"), F.lit(10).alias("n_shingles"), F.when(F.col("id") < 50, F.col("id")).otherwise(F.lit(99)).alias("comp"))
    got = jaccard.in_block_pairs(rows, "grp", 1024, 1 << 40, 8)
    assert n <= got.count() <= n + 50 * 30
    assert jaccard.in_block_pairs(rows.filter("comp = 99"), "grp", 1024, 1 << 40, 8).count() == 0


def test_near_duplicates_odd_rows(spark):
    got = jaccard.near_duplicates(frame(spark), width=3, num=90, den=100).collect()
    assert len(got) == len(odd_rows())
    by = defaultdict(set)
    for x in got:
        by[x["doc_id"]].add(x["component_id"])
    assert by[1] == by[2] == by[3] == {1} and by[9] == {8} and by[4] == {4} and by[5] == {5} and by[None] == {None}
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    kept = [x["doc_id"] for x in jaccard.keep_first(frame(spark), width=3, num=90, den=100).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 3 not in kept and 9 not in kept and {4, 5, 6, 8} <= set(kept)


def test_sketch_distance_bounds_difference():
    r = np.random.default_rng(1)
    bands = jaccard.Bands(90, 100)
    for n in (1, 5, 40, 700):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * 0.97))], r.integers(0, 1 << 63, len(a) // 40, dtype=np.uint64)]))
        assert not jaccard.is_similar(a, b, 90, 100) or set(bands.keys(a).tolist()) & set(bands.keys(b).tolist())


# Suffix arrays.


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(2)
    for text in (r.integers(97, 100, 400, dtype=np.uint8), np.frombuffer(b"abab" * 60, np.uint8), np.zeros(50, np.uint8), np.zeros(0, np.uint8)):
        data = text.tobytes()
        want = sorted(range(len(data)), key=lambda i: data[i:])
        sa = suffix.suffix_array(text)
        assert sa.tolist() == want
        if len(data):
            lcp = suffix.common_prefixes(text, sa, 40, stretch=16)
            for k in range(1, len(sa)):
                x, y = data[sa[k - 1] :], data[sa[k] :]
                n = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
                assert lcp[k] == min(n, 40)


def brute_removal(rows, length):
    seen, out = set(), []
    order = sorted({((1 << 63) - 1 if d is None else d, t or "") for d, t, *_ in rows}, key=lambda x: (x[0], x[1]))
    for d, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("hot", "hot_bytes", "many"), [(32, 64 << 20, 64), (2, 64 << 20, 64), (3, 500, 2), (2, 100, 5)])
def test_repeats(spark, monkeypatch, hot, hot_bytes, many):
    """Whole hashes, hashes in several shards, and split buckets."""
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "HOT_BYTES", hot_bytes)
    monkeypatch.setattr(suffix, "MANY", many)
    rows = [x for x in odd_rows() if not (x[0] == 12 and x[1] != "a b")]
    shared = prose(random.Random(9), 60)
    rows += [(100 + k, prose(random.Random(k), 20) + shared + prose(random.Random(k + 50), 20 + k), None, None, 0) for k in range(12)]
    rows += [(200 + k, prose(random.Random(k), 9) + shared[k : 90 + 3 * k] + prose(random.Random(k + 70), 9), None, None, 0) for k in range(30)]
    got = suffix.digest(suffix.remove_repeats(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    none = (1 << 63) - 1
    found = {(none if x["doc_id"] is None else x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got}
    want = brute_removal(rows, 100)
    assert {x for x in found if x[0] != none} == {x for x in want if x[0] != none}
    # null ids come last, in an order of their own: what they keep of all others is known
    of_none = [(d, t) for d, t, *_ in rows if d is None]
    ways = [brute_removal([(d, t) for d, t, *_ in rows if d is not None] + [(none - len(order) + k, t) for k, (_, t) in enumerate(order)], 100)[-len(order) :] for order in permutations(of_none)]
    assert sorted(x[1:] for x in found if x[0] == none) in [sorted(x[1:] for x in way) for way in ways]
    assert sum(x[2] for x in want) > 3000
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def test_registered_table_reaches_the_merge(spark, monkeypatch):
    """On the documents of a registered table some hashes go to several shards, whose lists are merged."""
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables here")
    monkeypatch.setattr(suffix, "HOT", 2)
    rows = []
    kept = suffix.staged

    def spy(df, name):
        out = kept(df, name)
        if name == "judged":
            rows.append(out.filter(f"kind = {suffix.WINDOW}").count())
        return out

    monkeypatch.setattr(suffix, "staged", spy)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = suffix.digest(suffix.remove_repeats(docs)).collect()
    assert rows[0] > 0
    want = {x[0]: x for x in brute_removal([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 100)}
    assert {x["doc_id"]: (x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == want


def test_neighbour_grams_lose_no_window():
    """Of two different runs with a common window, both are judged."""
    r = np.random.default_rng(5)
    for _ in range(60):
        common = r.integers(97, 101, int(r.integers(100, 160)), dtype=np.uint8)
        texts = [np.concatenate([r.integers(97, 123, int(r.integers(0, 90)), dtype=np.uint8), common, r.integers(97, 123, int(r.integers(0, 90)), dtype=np.uint8)]) for _ in range(2)]
        raw, offsets = np.concatenate(texts), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
        start, n, h, bytes_hash, twice, around = suffix.runs(raw, offsets, 100)
        order = np.argsort(h, kind="stable")
        judged = np.zeros(len(h), bool)
        judged[order] = suffix.to_judge(h[order], twice[order], around[order])
        windows = [{raw[i : i + 100].tobytes() for i in range(a, a + k)} for a, k in zip(start.tolist(), n.tolist(), strict=True)]
        for i in range(len(h)):
            if any(j != i and windows[i] & windows[j] for j in range(len(h))):
                assert judged[i]


def test_cut_repeats_keeps_columns(spark):
    df = frame(spark)
    out = suffix.cut_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    rows = {(x["doc_id"], x["lang"], x["source"]): x for x in out.collect()}
    assert rows[6, "de", "c"]["row"] == "clash" and rows[6, "de", "c"]["n_chars"] == len(rows[6, "de", "c"]["text"])


# Mixing.


def test_mix(spark):
    out = mixing.mix_sources(frame(spark)).collect()
    rows = odd_rows()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    taken, target = Counter(), {}
    for x in out:
        assert x["source_size"] == sizes[x["source"]] and 0 <= x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert target[s] <= 3 * sizes[s] + 1e-6
        assert abs(taken[s] - target[s]) <= 3, s
    again = mixing.mix_sources(frame(spark).repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_take_mix(spark):
    decided = mixing.mix_sources(frame(spark)).collect()
    df = frame(spark)
    out = mixing.take_mix(df)
    assert out.columns == df.columns
    taken = Counter()
    for x in out.collect():
        taken[x["source"]] += len(words(x["text"]))
    want = Counter()
    for x in decided:
        want[x["source"]] += x["taken"]
    assert +taken == +want


def test_mix_without_broadcast(spark, monkeypatch):
    want = sorted(map(str, mixing.mix_sources(frame(spark)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_sources(frame(spark)).collect())) == want


# Packing.


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(tokenizer_files()["json_file"])
    return ids_of.t.encode(text or "", add_special_tokens=False).ids


def test_token_ids_are_the_same():
    t = packing.load_tokens(**tokenizer_files())
    r = random.Random(3)
    texts = [x[1] or "" for x in odd_rows()] + ["<|endoftext|> a<|endoftext|>b", " " * 5000 + "x", "\n\n \t x's it'LL 12 ½ ǅ ١٢", "  \u0085x​", "x" * 3000]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1FAFF), 10, 9, 32])) for _ in range(400)) for _ in range(40)]
    for text in texts:
        assert t.ids(text).tolist() == ids_of(text)


def test_token_ids_of_a_whole_table(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    t = packing.load_tokens(**tokenizer_files())
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    assert len(rows) >= 200 and all(t.ids(x["text"] or "").tolist() == ids_of(x["text"]) for x in rows)


@pytest.mark.parametrize("pool_bytes", [4 << 20, 2000])
def test_pack(spark, pool_bytes):
    pieces = packing.digest(packing.pack_documents(frame(spark), **tokenizer_files(), pool_bytes=pool_bytes)).collect()
    rows = odd_rows()
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        docs[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"], p["ids_crc32"]))
    sizes = []
    for parts in seqs.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        sizes.append(at)
    assert sum(1024 - n for n in sizes if n & (n - 1)) <= 0.01 * sum(sizes) + 1024 * 4  # little padding, whatever the tasks
    want = defaultdict(list)
    for d, t, *_ in rows:
        ids = np.array([*ids_of(t), 0], "<u4")
        want[d, len(ids)].append(ids)
    assert set(docs) == set(want)
    for key, many in want.items():  # every id of every document lies in one piece, repeated rows included
        parts, n = sorted(docs[key]), key[1]
        assert sum(k for _, k, _ in parts) == n * len(many)
        cover = np.zeros(n, int)
        for start, k, crc in parts:
            cover[start : start + k] += 1
            assert any(zlib.crc32(ids[start : start + k].tobytes()) == crc for ids in many)
        assert (cover == len(many)).all()
    assert packing.pack_documents(frame(spark, []), **tokenizer_files()).count() == 0


def test_assignment():
    """To the cheapest sequence with room; nothing that fits is cut but in the last pool, which leaves no padding."""
    last = packing.Packer(1024, 1.0, 1 / 1024, 0.01).pack(np.array([700, 600, 400, 300, 48]), True)
    where = {d: s for d, _, _, s, _ in last}
    assert len(set(where.values())) == 2 and where[0] != where[1] and where[2] == where[1] and where[3] == where[0]
    r = np.random.default_rng(1)
    packer, sizes, docs = packing.Packer(1024, 1.0, 1 / 1024, 0.01), Counter(), 0
    for pool in range(6):
        lengths = r.integers(1, 1500, 400)
        pieces = packer.pack(lengths, pool == 5)
        cut = Counter(d for d, *_ in pieces)
        if pool < 5:
            assert all(cut[d] == -(-n // 1024) for d, n in enumerate(lengths.tolist()))
        docs += int(lengths.sum())
        for _, _, n, s, _ in pieces:
            sizes[s] += n
    assert sum(sizes.values()) == docs and max(sizes.values()) <= 1024 and len(sizes) <= 1.02 * docs / 1024 + 12
    assert list(packing.pools(iter([]), 5)) == []


# Language ID.


def language_rows(n=240):
    sounds = {"aa": "abcde", "bb": "mnopq", "cc": "uvxyz"}
    r = random.Random(8)
    return [(k, " ".join("".join(r.choice(sounds[lang]) for _ in range(4)) for _ in range(r.randrange(3, 200))), lang, "s", 0) for k, lang in ((k, r.choice(list(sounds))) for k in range(n))]


def test_language_id(spark):
    rows = [*language_rows(), (900, None, "aa", None, 0), (901, "12 ?!", "aa", None, 0), (902, "ab" * 40000, None, None, 0), (None, "abcd", "aa", None, 0)]
    out = langid.identify_languages(frame(spark, rows), id_crc() % 3 == 1).collect()
    assert len(out) == len(rows)
    by = {x["doc_id"]: x for x in out}
    test = [x for x in rows[:240] if by[x[0]]["held_out"]]
    assert len(test) > 40 and sum(by[d]["lang_pred"] == lang for d, _, lang, *_ in test) / len(test) > 0.95
    assert all(by[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in range(240))
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und" and by[902]["lang_pred"] == "aa"
    assert all(0 <= x["score"] <= 1 for x in out)
    kept = langid.keep_identified(frame(spark, rows))
    assert {x["doc_id"] for x in kept.collect()} == {x[0] for x in rows} - {900, 901}
    assert kept.filter("doc_id = 902").first()["lang"] == "aa"


def test_network_is_its_definition():
    """Folded tables against a direct convolution, and gradients against differences."""
    r = np.random.default_rng(3)
    net = langid.ByteCNN(["a", "b", "c"], window=20, widths=(2, 3), filters=4, dim=3)
    for k in net.p:
        net.p[k] = r.normal(0, 0.4, net.p[k].shape)
    x, y = r.integers(0, 9, (5, 20)).astype(np.uint8), r.integers(0, 3, 5)

    def direct(p):
        out = []
        for row in x:
            h = []
            for w in net.widths:
                z = np.array([np.concatenate([p["emb"][row[i + k]] for k in range(w)]) @ p[f"w{w}"] for i in range(20 - w + 1)])
                h += (z.max(0) + p[f"b{w}"]).tolist()
            z = np.maximum(h, 0) @ p["out"] + p["bias"]
            out.append(z - np.log(np.exp(z).sum()))
        return np.array(out)

    assert np.allclose(net.log_probs(x), direct(net.p), atol=1e-4)
    grads, loss = net.gradients(x, y)
    assert loss == pytest.approx(-direct(net.p)[np.arange(5), y].mean())
    for k, g in grads.items():
        for at in [tuple(r.integers(0, s) for s in g.shape) for _ in range(6)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            near = []
            for step in (1e-5, -1e-5):
                p = {name: v.copy() for name, v in net.p.items()}
                p[k][at] += step
                near.append(-direct(p)[np.arange(5), y].mean())
            assert g[at] == pytest.approx((near[0] - near[1]) / 2e-5, abs=1e-4)


def test_every_language_is_learned(spark):
    """More languages than an even share has texts for, a rare one among them; repeated rows."""
    r = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(24):
        letters = alphabet[k : k + 2] if k < 25 else "az"
        rows += [(1000 * k + i, " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(60)), f"l{k}", None, 0) for i in range(3 if k == 7 else 25)]
    rows += [rows[0]] * 30
    share = langid.shares({f"l{k}": 3 if k == 7 else 25 for k in range(24)}, 240, 100)
    assert sum(share.values()) == pytest.approx(240) and share["l7"] == 3 and min(share.values()) == 3
    model = langid.train(frame(spark, rows), F.lit(True), most_texts=240)
    assert len(model.labels) == 24
    out = {x["doc_id"]: x["lang_pred"] for x in langid.identify(frame(spark, rows), model, ["doc_id"]).select("row.doc_id", "lang_pred").collect()}
    assert sum(out[d] == lang for d, _, lang, *_ in rows) / len(rows) > 0.8


def test_language_id_without_labels(spark):
    assert {x["lang_pred"] for x in langid.identify_languages(frame(spark, [(1, "abc", None, None, 0)]), F.lit(False)).collect()} == {"und"}
    assert langid.identify_languages(frame(spark, []), F.lit(False)).count() == 0


# Toxicity.


def test_segments_are_the_maximal_ones():
    r = random.Random(4)
    for _ in range(200):
        x = [r.choice([-0.5, -0.5, -0.5, r.random() * 2]) for _ in range(r.randrange(1, 14))]
        at = [i for i, v in enumerate(x) if v > 0]
        got = sorted(toxicity.segments(at, [x[i] for i in at], 0.5))

        def split(a, b, x=x):
            best = max(((sum(x[i:j]), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0), key=lambda v: (round(v[0], 9), -(v[2] + v[1])))
            if best[0] <= 1e-12:
                return []
            i, j = -best[1], best[2]
            return [*split(a, i), (i, j - 1, best[0]), *split(j, b)]

        want = sorted(split(0, len(x)))
        assert [round(s, 6) for *_, s in got] == [round(s, 6) for *_, s in want]


def toxic_rows(n=400):
    r = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        w = prose(r, r.randrange(5, 120), 300).split()
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["villain", "dolt", "grubbyness", "grubbyhood"]))
        rows.append((k, " ".join(w), None, None, 0))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (902, "calm " * 50000 + "villain dolt grubbyzzz", None, None, 0), (None, "villain dolt", None, None, 0)]
    marks = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.train(frame(spark, rows), marks, id_crc() % 5 != 0)
    out = {x["doc_id"]: x for x in toxicity.score_documents(frame(spark, rows), model).collect()}
    assert len(out) == len(rows)
    held = [(d, t) for d, t in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((out[d]["score"] >= 0.5) == bool(t) for d, t in held) / len(held) > 0.97
    assert out[900]["score"] == out[901]["score"] < 0.5 and out[902]["passages"] and out[902]["score"] >= 0.5
    assert out[902]["passages"][0]["start"] == 50000


def test_extreme_values_are_calibrated():
    r = np.random.default_rng(4)
    n = r.integers(20, 2000, 6000).astype(float)
    s = np.maximum(0, (np.log(0.03 * n) + r.gumbel(size=len(n))) / 0.8)
    k, lam = toxicity.extreme_value(n, s)
    assert k == pytest.approx(0.03, rel=0.15) and lam == pytest.approx(0.8, rel=0.05)
    assert toxicity.extreme_value(np.array([50.0]), np.array([0.0]))[0] < 0.02


def test_clean_texts_have_few_passages(spark):
    """Of clean texts about `alpha` have a passage at all, whatever their words."""
    rows, labels = toxic_rows(900)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), marks, id_crc() % 5 != 0, least=0.3, z=0.5)
    r = random.Random(77)
    share = sum(bool(model.passages(prose(r, r.randrange(5, 400), 300).encode())[0]) for _ in range(600)) / 600
    assert share < 3 * model.alpha


def test_toxicity_odd_tables(spark):
    rows, labels = toxic_rows(200)
    marks = spark.createDataFrame([*labels, (0, 0), (7, 1), (7, 0), (10_000, 1)], "doc_id long, toxic int")  # an id labelled twice, one without a document
    model = toxicity.train(frame(spark, rows + rows[:3]), marks, F.lit(True))
    out = toxicity.score_documents(frame(spark, rows + rows[:3]), model).collect()
    assert len(out) == 203 and all(len({x["score"] for x in out if x["doc_id"] == d}) == 1 for d in range(3))
    assert toxicity.score_documents(frame(spark, []), model).count() == 0
    assert toxicity.train(frame(spark, []), marks, F.lit(True)).odds == {}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(frame(spark), none, id_crc() % 5 != 0)
    assert {x["score"] for x in toxicity.score_documents(frame(spark), model).collect()} == {0.0}


# Language model.

BEGIN = ("begin",)


class SlowModel:
    """Modified Kneser-Ney from dictionaries."""

    def __init__(self, texts, order):
        self.order, self.c = order, {order: Counter()}
        for t in texts:
            w = [BEGIN] * (order - 1) + [*words(t), None]
            self.c[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.tokens = Counter(w for t in texts for w in [*words(t), None])
        self.v = len(self.tokens)
        self.d = {k: lm.discounts([Counter(c.values())[i] for i in (1, 2, 3, 4)]) for k, c in self.c.items()}
        self.follow = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in self.c}
        for k, c in self.c.items():
            for g, n in c.items():
                self.follow[k][g[:-1]][0] += n
                self.follow[k][g[:-1]][min(n, 3)] += 1

    def cut(self, k, n):
        return self.d[k][min(n, 3) - 1] if n else 0

    def p(self, g):
        k, n = len(g), self.c[len(g)][g]
        if k == 1:
            spare = sum(self.cut(1, x) for x in self.c[1].values())
            return (n - self.cut(1, n) + spare / (self.v + 1)) / sum(self.c[1].values())
        if g[:-1] not in self.follow[k]:
            return self.p(g[1:])
        total, *f = self.follow[k][g[:-1]]
        return (n - self.cut(k, n) + sum(a * b for a, b in zip(self.d[k], f, strict=True)) * self.p(g[1:])) / total

    def row(self, t):
        w = [*words(t), None]
        padded = [BEGIN] * (self.order - 1) + w
        n = sum(self.tokens.values())
        base = sum(math.log10((self.tokens[x] + 1) / (n + self.v + 1)) for x in w)
        return len(w), sum(x in self.tokens for x in w), base, sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(w)))


@pytest.mark.parametrize(("order", "wide"), [(2, 16), (3, 16), (3, 0), (4, 1)])
def test_language_model(spark, monkeypatch, order, wide):
    monkeypatch.setattr(lm, "WIDE", wide)
    rows = odd_rows() + [(200 + k, prose(random.Random(k), 40, 60), None, None, 0) for k in range(40)] + [(300 + k, "a b " * 200, None, None, 0) for k in range(3)]
    learn = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    model = lm.train(frame(spark, rows), id_crc() % 7 != 2, order=order)
    out = lm.score(frame(spark, rows), model).collect()
    slow = SlowModel([t for d, t, *_ in rows if learn(d)], order)
    assert (model.tokens, model.kinds) == (sum(slow.tokens.values()), slow.v) and model.grams == {k: len(c) for k, c in slow.c.items()}
    for h in [(BEGIN,) * (order - 1), ("a", "b", "a", "b")[: order - 1], ("never",) * (order - 1)]:
        assert sum(slow.p((*h, w)) for w in slow.tokens) + slow.p((*h, "\0never")) == pytest.approx(1)
    key = lambda x: tuple(-1 if v is None else round(v, 4) for v in x)
    got = sorted(key((x["doc_id"], x["n_tokens"], x["n_known"], x["base_score"], x["score"])) for x in out)
    want = sorted(key((d, *slow.row(t))) for d, t, *_ in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=2e-4)


def test_language_model_keeps_few_files_open(spark, monkeypatch, tmp_path):
    """Many shards, few maps; a store that can't be mapped gives the same."""
    monkeypatch.setattr(lm, "OPEN", 3)
    rows = [(k, prose(random.Random(k), 60, 500), None, None, 0) for k in range(30)]
    model = lm.train(frame(spark, rows), F.lit(True), shard_bytes=200)
    assert model.shards > 30
    raw = "\n".join(t for _, t, *_ in rows).encode()
    columns, known, count, n = lm.numbered(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    mapped = model.probabilities(columns, known)
    assert len(model.shelf._open) <= 3 and (count > 0).all() and 0 < mapped.min() <= mapped.max() < 1
    far = lm.Model(lm.Shelf(model.shelf.uri), model.shards, model.order)
    far.__dict__.update({k: v for k, v in model.__dict__.items() if k != "shelf"})
    far.shelf.local = None  # read through pyarrow
    assert np.array_equal(far.probabilities(columns, known), mapped) and len(far.shelf._open) <= lm.FETCHED


def test_sorted_hash_arrays():
    r = np.random.default_rng(8)
    h = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    h = np.unique(np.concatenate([h, h[:50] + np.uint64(1 << 20)]))  # neighbours in the last bits that are stored
    arrays, order = lm.hash_index(h, "x")
    place = lm.find(arrays, "x", h)
    assert np.array_equal(order[place], np.arange(len(h)))
    assert (lm.find(arrays, "x", h ^ np.uint64(1 << 40)) == -1).all() and (lm.find(lm.hash_index(h[:0], "x")[0], "x", h) == -1).all()
    n = np.concatenate([r.integers(1, 4, 900), [255, 256, 254, 1 << 40]])
    at = np.concatenate([r.permutation(len(n)), [-1]])
    assert lm.counts_at(lm.coded_counts(n, "x"), "x", at).tolist() == [*n[at[:-1]].tolist(), 0]
    sums = np.concatenate([np.repeat(r.integers(1, 140, (300, 1)), 4, 1) * [1, 1, 0, 0], r.integers(1, 9, (800, 4)), [[1 << 40, 1, 2, 3]]])
    at = np.concatenate([r.permutation(len(sums)), [-1]])
    assert np.array_equal(lm.sums_at(lm.coded_sums(sums, "x"), "x", at), np.concatenate([sums[at[:-1]], np.zeros((1, 4), int)]))


@pytest.mark.parametrize("large", [5, 1 << 30, lm.UNKNOWN])
def test_columns(large):
    r = np.random.default_rng(2)
    columns = [r.choice([0, 1, 3, large], 400) for _ in range(3)]
    counts = r.integers(1, 300, 400)
    grams, n = lm.distinct(columns, counts)
    want = Counter()
    for *g, c in zip(*(c.tolist() for c in columns), counts.tolist(), strict=True):
        want[tuple(g)] += c
    assert list(zip(*(c.tolist() for c in grams), n.tolist(), strict=True)) == [(*g, want[g]) for g in sorted(want)]
    same, back = lm.distinct(columns, inverse=True)
    assert all(np.array_equal(a[back], b) for a, b in zip(same, columns, strict=True))
    ones, k = lm.distinct(columns)
    assert k.sum() == 400 and all(np.array_equal(a, b) for a, b in zip(ones, grams, strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(lm.unpack(lm.pack([*grams, n]), len(n)), [*grams, n], strict=True))


def test_language_model_without_text(spark):
    model = lm.train(frame(spark, []), F.lit(True))
    assert {x["score"] for x in lm.score(frame(spark), model).collect()} == {0.0}


def test_schema_is_that_of_documents(spark):
    assert spark.createDataFrame([], SCHEMA).columns == ["doc_id", "text", "lang", "source", "n_chars"]
