"""Near duplicates by a parity-sketch join on sets of word shingles.

A set's parity sketch has one bit for every hash value of a shingle, the exclusive or of all shingles
that fall on it, so the Hamming distance of two sketches is at most the size of the sets' symmetric
difference. Sets with a Jaccard similarity of at least j differ in at most (1-j)/(1+j) * (|A|+|B|)
shingles, and their sizes differ by the factor j at most. Sizes are dealt to geometric bands; a set
takes part in its own band and the next, so two sets that may be similar meet in one. A band of sets
up to `hi` shingles cuts its sketches into d + 1 segments, d being the largest difference there: by
the pigeonhole principle two similar sets agree in a whole segment. With z more segments they agree in
z + 1, and the fullest of these is never among the z emptiest of either set, so each set leaves its z
emptiest segments out: segments with few shingles are what unlike sets share. Segments are hashed to keys.

Texts are hashed for their sets' sizes, digests and short sketches; equal sets are one set. Of each set one
text (and, where a membership filter of a fixed size errs, a copy) is hashed once more for its keys, which are
packed as blocks of sorted numbers per bucket and removed as soon as their groups are known. Then

1. the sets of a key are compared with the smallest id among them, by the Hamming distance of their
   short sketches, which drops only pairs that can't be similar, and what is left exactly;
2. where sets of a key still are in different components, sketches are compared in pairs of blocks;
   pairs that are connected, or that the largest component has within itself, are left out;
3. components that sketches join are compared exactly, in pairs of blocks as before.

So every pair of similar sets is connected through verified links, no list of all pairs is made, and a
text goes to as many tasks as it has partners left in step 1 (its component's first text, as a rule). A
bucket of very many bytes is split: each part hands on one document a key, and these meet once more.

Defined cases: a text without words has an empty set and no link; one with fewer words than a shingle
has its whole sequence as the one shingle; a null id takes no part and has a null component; a
repeated row gives the same result again; rows that share an id are judged by their own texts; an
empty table gives no row; extra columns are ignored. Equal 64-bit hashes count as equal shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.llm.common import documents, fresh_path, input_bytes, map_gathered, maybe_among, mix64, scratch, ship, staged, text_bytes, word_hashes, written
from weftnet.llm.components import components

#: Bits of a sketch segment (few are set: a segment is kept as the hash of their places); words of the short
#: sketch that is compared before sets are; segments beyond d + 1 for each d.
SEGMENT, SHORT_WORDS, SPARE = 1 << 24, 16, 0.5
#: Bytes of text that are hashed at once.
TEXT_BYTES = 2 << 20
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    h, counts = word_hashes(raw, offsets)
    ends = np.cumsum(counts)
    mixed = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        mixed += mix64(h[k : k + len(mixed)] + np.uint64(_STEP[k]))[: len(mixed)] * np.uint64(_STEP[(k + 3) % 8] | 1)
    mixed = mix64(mixed)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(mixed[end - n : end - width + 1]))
        elif n:
            one = np.array([0x51ED270B * n], np.uint64)
            for x in h[end - n : end]:
                one = mix64(one * np.uint64(31) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands for a similarity of num/den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        tops, top = [], 1
        while top < 1 << 62:
            tops.append(top)
            top = max(top + 1, top * den // num)
        self.tops = np.array(tops, np.int64)  # largest size of each band

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.tops, n))

    def segments(self, band: int) -> int:
        """d + 1 for two sets of sizes up to the top of the band."""
        return int(2 * int(self.tops[band]) * (self.den - self.num) // (self.den + self.num)) + 1

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Keys of a set's fullest segments, in its own band and the next."""
        own, out = self.of(len(s)), []
        for band in (own, own + 1):
            need = self.segments(band)
            m = need + int(np.ceil(SPARE * (need - 1)))
            place = mix64(s + np.uint64(band + 1)) % np.uint64(m * SEGMENT)
            segment = (place // np.uint64(SEGMENT)).astype(np.int64)
            order = np.argsort(place)
            odd = np.ones(len(s), bool)  # places that an odd number of shingles fall on
            p = place[order]
            twin = np.flatnonzero(p[1:] == p[:-1])
            for t in twin.tolist():
                if odd[t]:
                    odd[t] = odd[t + 1] = False
            bits, where = p[odd], segment[order][odd]
            content = np.zeros(m, np.uint64)
            np.bitwise_xor.at(content, where, mix64(bits + np.uint64(_STEP[1])))
            count = np.bincount(where, minlength=m)
            content = mix64(content + np.arange(m, dtype=np.uint64) * np.uint64(_STEP[2]) + np.uint64(band * _STEP[4] & (1 << 64) - 1))
            out.append(content[np.lexsort((content, count))[m - need :]])
        return np.concatenate(out)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    a = np.add.reduce(mix64(s), dtype=np.uint64) if len(s) else np.uint64(0)
    b = np.bitwise_xor.reduce(mix64(s + np.uint64(77))) if len(s) else np.uint64(0)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def short_sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch of SHORT_WORDS * 64 bits."""
    bits = SHORT_WORDS * 64
    place = (mix64(s + np.uint64(5)) >> np.uint64(20)) % np.uint64(bits)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").view(np.uint64)


def planes(x: np.ndarray, width: int = 8) -> bytes:
    """Numbers as planes of their `width` low bytes, which compress well where high bytes repeat."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def unplanes(b: bytes, width: int = 8) -> np.ndarray:
    low = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((low.shape[1], 8), np.uint8)
    out[:, :width] = low.T
    return out.view("<i8")[:, 0]


SETS = "doc_id long, n_shingles long, s1 long, s2 long, sketch array<long>, row_key long"


def described(docs: DataFrame, width: int) -> DataFrame:
    """The set of each row (doc_id, text, row_key): size, 128-bit digest, short sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*text_bytes(batch.column(1)), width)
        digests = [set_digest(s) for s in sets]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "s1": pa.array([d[0] for d in digests], pa.int64()), "s2": pa.array([d[1] for d in digests], pa.int64()),
            "sketch": pa.array([short_sketch(s).view(np.int64).tolist() for s in sets], pa.list_(pa.int64())), "row_key": batch.column(2),
        })

    return map_gathered(docs.select("doc_id", "text", "row_key"), run, SETS, TEXT_BYTES)


#: Bytes that are kept of a key: those of a bucket (about a million) rarely agree in them by chance, and such pairs are compared like all others.
KEY_BYTES = 5
KEYS = "bucket long, keys binary, docs binary"


def describe(docs: DataFrame, width: int, bands: Bands, buckets: int) -> DataFrame:
    """Packed keys of a bucket with their documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sets = batch.column(0).to_pylist(), shingle_sets(*text_bytes(batch.column(1)), width)
        digests = [set_digest(s) for s in sets]
        first: dict = {}
        for doc, s, d in sorted(((i, s, d) for i, s, d in zip(ids, sets, digests, strict=True) if i is not None and len(s)), key=lambda x: x[0]):
            first.setdefault((len(s), *d), (doc, s))  # of equal sets in a batch the smallest id goes on
        keys = [bands.keys(s) for _, s in first.values()]
        owner = np.repeat(np.array([doc for doc, _ in first.values()], np.int64), [len(k) for k in keys])
        keys = np.concatenate([np.zeros(0, np.uint64), *keys])
        bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
        keys &= np.uint64((1 << 8 * KEY_BYTES) - 1)
        order = np.lexsort((keys, bucket))
        keys, owner, bucket = keys[order], owner[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        bounds = [(i, j) for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True) if j > i]
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array([int(bucket[i]) for i, _ in bounds], pa.int64()), "keys": pa.array([planes(keys[i:j], KEY_BYTES) for i, j in bounds], pa.binary()), "docs": pa.array([planes(owner[i:j]) for i, j in bounds], pa.binary()),
        })

    return map_gathered(docs.select("doc_id", "text"), run, KEYS, TEXT_BYTES)


def grouped(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their documents in order, and where each key begins."""
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    return keys, owner, np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


GROUPS = "grp long, doc long, pivot long"


def as_groups(grp: np.ndarray, doc: np.ndarray, pivot: np.ndarray):
    import pandas as pd

    return pd.DataFrame({"grp": grp.view(np.int64), "doc": doc, "pivot": pivot})


def groups_of(packed: DataFrame, hot_bytes: int) -> DataFrame:
    """Documents with a common key: grp, doc and pivot (the smallest of them), a row a member; equal groups of a bucket are one."""

    def unpacked(pdf):
        return grouped(np.concatenate([unplanes(b, KEY_BYTES) for b in pdf["keys"]]), np.concatenate([unplanes(b) for b in pdf["docs"]]))

    def meet(pdf):
        _, owner, first = unpacked(pdf)
        size = np.diff(np.append(first, len(owner)))
        member = np.repeat(size > 1, size)
        first, size = first[size > 1], size[size > 1]
        if not len(first):
            return as_groups(*[np.zeros(0, np.int64)] * 3)
        owner, begin = owner[member], np.cumsum(size) - size
        one = owner.view(np.uint64)
        name = mix64(np.add.reduceat(mix64(one), begin) + mix64(np.bitwise_xor.reduceat(mix64(one + np.uint64(9)), begin)))
        _, kept = np.unique(name, return_index=True)
        n = size[kept]
        at = np.repeat(begin[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return as_groups(np.repeat(name[kept], n), owner[at], np.repeat(owner[begin[kept]], n))

    def part(pdf):
        """A part of a large bucket: the members of its keys, and marked as `grp` null the first one of each key."""
        import pandas as pd

        keys, owner, first = unpacked(pdf)
        keys = keys | int(pdf["bucket"].iloc[0]) << 8 * KEY_BYTES  # the parts of all buckets meet
        size = np.diff(np.append(first, len(owner)))
        grp, pivot = np.repeat(keys[first], size), np.repeat(owner[first], size)
        some = np.repeat(size > 1, size)
        out = as_groups(grp[some], owner[some], pivot[some]).assign(key=None)
        firsts = pd.DataFrame({"grp": None, "doc": owner[first], "pivot": owner[first], "key": keys[first].view(np.int64)})
        return pd.concat([out, firsts]).astype({"grp": "Int64", "key": "Int64"})

    sizes = packed.groupBy("bucket").agg(F.sum(F.length("keys") * 8 / KEY_BYTES).alias("bytes"))
    hot = staged(sizes.filter(F.col("bytes") > hot_bytes).select("bucket", F.ceil(F.col("bytes") / hot_bytes).alias("parts")), "hot_buckets")
    if hot.isEmpty():
        return packed.groupBy("bucket").applyInPandas(meet, GROUPS)
    cool = packed.join(hot, "bucket", "left_anti").groupBy("bucket").applyInPandas(meet, GROUPS)
    split = packed.join(hot, "bucket").withColumn("part", F.pmod(F.xxhash64("docs", "keys"), "parts"))
    split = staged(split.groupBy("bucket", "part").applyInPandas(part, f"{GROUPS}, key long"), "hot_parts")
    firsts = split.filter("key IS NOT NULL").select("key", "doc").distinct()
    several = firsts.groupBy("key").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    return cool.unionByName(split.filter("key IS NULL").drop("key")).unionByName(firsts.join(several, "key").select(F.col("key").alias("grp"), "doc", "pivot"))


def is_similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(a) + len(b) - shared)


def link(ids: np.ndarray, side: np.ndarray, n: np.ndarray, sketch: np.ndarray, known: np.ndarray, num: int, den: int, similar) -> list[tuple[int, int]]:
    """Links that connect what is similar within a block (all on side 0) or between two (sides 0 and 1).

    Sizes and sketches drop only pairs that can't be similar; `similar(i, j)` decides on the others. Rows
    that agree in `known` are connected from the beginning.
    """
    _, first, back = np.unique(known, return_index=True, return_inverse=True)
    root = first[back]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    across, links = bool((side != side[0]).any()) if len(side) else False, []
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        fits = (np.minimum(n[rest], n[i]) * den >= np.maximum(n[rest], n[i]) * num) & (root[rest] != find(i))
        rest = rest[fits & (side[rest] != side[i])] if across else rest[fits]
        if not len(rest):
            continue
        far = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(1, dtype=np.int64)
        for j in rest[far * (den + num) <= (n[rest] + n[i]) * (den - num)].tolist():
            x, y = find(i), find(j)
            if x != y and similar(i, j):
                root[max(x, y)] = min(x, y)
                links.append((int(ids[i]), int(ids[j])))
    return links


def sets_of(texts: list[str], width: int) -> list[np.ndarray]:
    """Shingle hashes of texts, a few at a time: hashing needs many times their size."""
    data, sets, at = [t.encode() for t in texts], [], 0
    while at < len(data):
        end, size = at + 1, len(data[at])
        while end < len(data) and size + len(data[end]) <= TEXT_BYTES:
            size += len(data[end])
            end += 1
        part = data[at:end]
        sets += shingle_sets(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in part])]).astype(np.int64), width)
        at = end
    return sets


def as_links(links: list[tuple[int, int]]):
    import pandas as pd

    return pd.DataFrame({"a": [x for x, _ in links], "b": [y for _, y in links]}, dtype="int64").drop_duplicates()


def in_block_pairs(rows: DataFrame, group: str, block: int, shingles: int, few: int) -> DataFrame:
    """Adds p, q (a pair of blocks of the group), side and slot to rows of group, doc_id, n_shingles and comp.

    The largest component's members aren't paired with each other: of the others (`small` blocks) each
    block meets all, of its own `large` blocks each meets the small ones. Blocks have about `block`
    members or `shingles` shingles, whichever is less; groups of one block share slots.
    """
    parts = rows.groupBy(group, "comp").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("sum"))
    sizes = parts.groupBy(group).agg(F.max_by("comp", "members").alias("largest"), F.max_by("sum", "members").alias("largest_sum"), F.max("members").alias("most"), F.sum("members").alias("all"), F.sum("sum").alias("all_sum"))
    blocks = lambda members, total: F.greatest(F.ceil(members / block), F.ceil(total / shingles)).cast("int")
    small, large = blocks(F.col("all") - F.col("most"), F.col("all_sum") - F.col("largest_sum")), blocks(F.col("most"), F.col("largest_sum"))
    sizes = sizes.filter(F.col("all") > F.col("most")).withColumns({"one": blocks(F.col("all"), F.col("all_sum")) == 1, "small": small, "large": large})
    rows = rows.join(sizes.select(group, "largest", "one", "small", "large"), group)
    spot, inside = F.xxhash64("doc_id"), F.col("comp") == F.col("largest")
    rows = rows.withColumn("part", F.when(F.col("one"), 0).when(inside, F.col("small") + F.pmod(spot, F.col("large"))).otherwise(F.pmod(spot, F.col("small"))).cast("int"))
    others = F.when(F.col("one"), 1).when(inside, F.col("small")).otherwise(F.col("small") + F.col("large"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (others - 1).cast("int"))))
    rows = rows.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other"), "side": (F.col("part") > F.col("other")).cast("int")})
    slot = F.when(F.col("one"), F.pmod(F.xxhash64(group), F.lit(few))).otherwise(F.xxhash64(group, "p", "q"))
    return rows.withColumn("slot", slot).drop("part", "other", "largest", "one", "small", "large")


def verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int, shingles: int, few: int) -> DataFrame:
    """The pairs (a, b; n_b shingles) whose sets are similar. A document a goes to a task for every `shingles` shingles of its partners."""
    parts = pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / shingles).alias("parts"))
    pairs = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    rows = pairs.select("a", "part", F.col("b").alias("doc_id"), F.lit(False).alias("first")).unionByName(pairs.select("a", "part", F.col("a").alias("doc_id"), F.lit(True).alias("first")).distinct())
    rows = staged(rows, "pairs")
    # documents in no pair stay where they are; the join is merged at every size, as a broadcast that
    # ends at some size would make the shuffle jump there
    near = maybe_among(docs, "doc_id", rows.select(F.col("doc_id").alias("id")), "maybe").filter("maybe").select("doc_id", "text")
    texts = near.join(rows.hint("merge"), "doc_id").withColumn("slot", F.pmod(F.xxhash64("a", "part"), F.lit(few)))

    def run(pdf):
        links = []
        for _, g in pdf.groupby(["a", "part"], sort=True):
            g = g.drop_duplicates(["doc_id", "first", "text"])
            mine = sets_of(g["text"][g["first"]].tolist(), width)
            rest = g[~g["first"]]
            a = int(g["a"].iloc[0])
            links += [(a, int(b)) for b, s in zip(rest["doc_id"], sets_of(rest["text"].tolist(), width), strict=True) if any(is_similar(x, s, num, den) for x in mine)]
        return as_links(links)

    return texts.select("slot", "a", "part", "doc_id", "first", "text").groupBy("slot").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, block: int = 1024, block_shingles: int = 1 << 18, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; links are sets with similarity num/den or more.

    The rows are written; what was staged on the way is removed.
    """
    spark = docs.sparkSession
    ship(spark)
    path = fresh_path(spark, "near_duplicates")
    with scratch(spark):
        written(_components_of(documents(docs), width, num, den, block, block_shingles, bucket_bytes), path)
    return spark.read.schema("doc_id long, n_shingles long, component_id long").parquet(path)


def _groups(docs: DataFrame, sets: DataFrame, width: int, bands: Bands, buckets: int, bucket_bytes: int) -> DataFrame:
    """Groups of documents with a common key (grp, doc, pivot), one of each set; sets: doc_id, row_key and first, the set's smallest id."""
    spark = docs.sparkSession
    path = fresh_path(spark, "groups")
    with scratch(spark):
        own = staged(sets.filter("doc_id = first").select("doc_id", F.col("row_key").alias("id")).distinct(), "own")
        # rows that stand for no set have no keys; those that both filters take for others go afterwards, and never
        # are a pivot, as the first row of their set has the same keys
        rows = docs
        for seed in (3, 4):
            rows = maybe_among(rows, "row_key", own, "maybe", seed).filter("maybe").drop("maybe")
        packed = staged(describe(rows, width, bands, buckets), "keys")
        copies = staged(sets.filter("doc_id <> first").select(F.col("doc_id").alias("doc")).distinct().join(own.select(F.col("doc_id").alias("doc")), "doc", "left_anti"), "copies")
        written(groups_of(packed, 8 * bucket_bytes).join(copies, "doc", "left_anti").select("grp", "doc", "pivot").distinct(), path)
    return spark.read.schema(GROUPS).parquet(path)


def _components_of(docs: DataFrame, width: int, num: int, den: int, block: int, block_shingles: int, bucket_bytes: int) -> DataFrame:
    buckets = max(64, input_bytes(docs) // bucket_bytes)
    few = 4 * buckets
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    known = staged(described(docs, width), "sets")
    first = staged(known.filter("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("first")).filter("first is not null"), "first")
    have = known.filter("n_shingles > 0 and doc_id is not null")
    groups = _groups(docs, have.join(first, ["n_shingles", "s1", "s2"]), width, Bands(num, den), buckets, bucket_bytes)
    # sketches of documents that share a key with others; the rest has no part in what follows
    near = maybe_among(have.select("doc_id", "n_shingles", "sketch"), "doc_id", groups.select(F.col("doc").alias("id")), "maybe")
    sketches = staged(near.filter("maybe").drop("maybe"), "sketches")

    # 1. with the smallest id of a key
    side = lambda c: sketches.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")).hint("merge")
    pairs = groups.filter("doc <> pivot").select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    far = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    pairs = pairs.filter((F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (far * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)))
    links = staged(verified(staged(pairs.groupBy("a", "b").agg(F.max("n_b").alias("n_b")), "likely"), docs, width, num, den, block_shingles, few), "links1")
    part = components(links, "part").select(F.col("id").alias("doc"), F.col("component").alias("comp"))

    # 2. sketches of what a key still has in several components
    members = groups.select("grp", "doc").distinct().join(part, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    several = members.groupBy("grp").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("n > 2 AND low <> high").select("grp")
    members = staged(members.join(several, "grp").withColumnRenamed("doc", "doc_id").join(sketches.hint("merge"), "doc_id"), "open_groups")

    def prune(pdf):
        found = []
        for _, g in pdf.groupby(["grp", "p", "q"], sort=True):
            g = g.sort_values("doc_id", kind="stable")
            sketch = np.stack(g["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
            found += link(g["doc_id"].to_numpy(np.int64), g["side"].to_numpy(), g["n_shingles"].to_numpy(np.int64), sketch, g["comp"].to_numpy(np.int64), num, den, lambda i, j: True)
        return as_links(found)

    likely = in_block_pairs(members, "grp", block, 1 << 62, few).select("slot", "grp", "p", "q", "side", "doc_id", "n_shingles", "comp", "sketch").groupBy("slot").applyInPandas(prune, "a long, b long")
    likely = staged(likely.distinct(), "likely2")
    if not likely.isEmpty():
        # 3. texts of components that sketches join
        of = members.groupBy("doc_id").agg(F.min("comp").alias("comp"), F.max("n_shingles").alias("n_shingles"))
        end = lambda c: of.select(F.col("doc_id").alias(c), F.col("comp").alias(f"comp_{c}"))
        joined = components(likely.join(end("a"), "a").join(end("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), "clusters")
        rows = staged(of.join(joined.select(F.col("id").alias("comp"), F.col("component").alias("cluster")), "comp"), "cluster_members")
        near = maybe_among(docs, "doc_id", rows.select(F.col("doc_id").alias("id")), "maybe").filter("maybe").select("doc_id", "text")
        texts = near.join(in_block_pairs(rows, "cluster", block, 4 * block_shingles, few).drop("n_shingles").hint("merge"), "doc_id")

        def verify(pdf):
            found = []
            for _, g in pdf.groupby(["cluster", "p", "q"], sort=True):
                g = g.drop_duplicates(["doc_id", "text"]).sort_values("doc_id", kind="stable")
                sets = sets_of(g["text"].tolist(), width)
                n, sketch = np.array([len(s) for s in sets], np.int64), np.stack([short_sketch(s) for s in sets])
                found += link(g["doc_id"].to_numpy(np.int64), g["side"].to_numpy(), n, sketch, g["comp"].to_numpy(np.int64), num, den, lambda i, j, sets=sets: is_similar(sets[i], sets[j], num, den))
            return as_links(found)

        more = texts.select("slot", "cluster", "p", "q", "side", "doc_id", "comp", "text").groupBy("slot").applyInPandas(verify, "a long, b long")
        part = components(links.unionByName(more), "links").select(F.col("id").alias("doc"), F.col("component").alias("comp"))
    named = known.select("doc_id", "n_shingles", "s1", "s2").join(first, ["n_shingles", "s1", "s2"], "left").join(part.withColumnRenamed("doc", "first"), "first", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "first", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` but for those whose component has a smaller id; of equal rows one stays."""
    found = near_duplicates(docs, **how)
    gone = staged(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"))
    rows = maybe_among(rows, "key", gone, "maybe")
    clear = rows.filter(~F.col("maybe"))
    rest = rows.filter("maybe").join(gone.withColumnRenamed("id", "key").hint("merge"), "key", "left_anti")
    out = clear.select("row").union(rest.select("row")).select("row.*")
    twice = staged(found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "twice")
    if twice.isEmpty():
        return out
    return out.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(out.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
