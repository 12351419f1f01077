"""Removal of repeated byte strings with per-shard suffix arrays.

A byte goes if it is covered by a string of `length` bytes that also starts earlier: in a smaller
document, or earlier in the same one. The strings are judged on the input, never across documents.

1. Every window of `length` bytes belongs to the smallest hash among its 32-byte grams, so equal
   windows belong to the same hash. Consecutive windows of one hash are a run. In a batch, and then in
   each bucket of hashes, runs with equal bytes are one: all but the first are removed at once.
2. What is left to judge are runs of a hash that may share a window although their bytes differ (edges
   of shared passages): a shared window has its gram's 32 bytes before or after it in common as well, so
   runs without an equal neighbour gram are out. Runs that hold their hash twice (periodic text) are in,
   with all of their hash. The bytes of these runs are dealt to shards by hash.
3. A shard sorts its suffixes by Larsson-Sadakane refinement (only groups that aren't sorted yet, by
   the ranks of what follows, with doubling depth) and finds common prefixes by Kasai's walk, many
   stretches of the text in step. Neighbours with a common prefix of `length` bytes are one string,
   whose earliest start stays.
4. A hash with more than HOT runs to judge is dealt to several shards; their sorted lists of strings are
   merged by binary search, in buckets of the strings' digests.

A bucket of step 1 that holds more than HOT_BYTES is split by the runs' bytes: equal runs meet in a part;
a hash with many runs in a part goes on to step 3 at once, the others meet again in their bucket, which
then is small. Texts that surely have nothing to judge or to cut aren't shuffled.

Defined cases: a null or empty text has no bytes and no spans; a null id counts as the largest; rows
that share an id are ordered by a hash of their text, and rows alike in both are one document that is
returned once a row; an empty table gives no row; extra columns are ignored. Equality of runs is that
of 112 bits of hashes, equality in a shard that of the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import _BYTE_MIX, _INVERSE, input_bytes, map_arrow, map_gathered, maybe_among, mix64, powers, ship, staged, text_bytes
from weftnet.llm.jaccard import planes, unplanes

GRAM, STRETCH = 32, (1 << 18) - 256
#: Runs of a hash that one shard judges; packed bytes of a bucket of step 1; runs of a hash that are many in a part of a split bucket.
HOT, HOT_BYTES, MANY = 32, 64 << 20, 64
_B = 0x9E3779B97F4A7C15
PACKED = "kind int, slot int, hash binary, bytes_hash binary, doc binary, text_hash binary, start binary, size binary, around binary"
CUT, RUN, ASK, WINDOW = 1, 0, 2, 3
_MOST = (1 << 63) - 1
_MARK = (1 << 32) - 1  # around a run that says: this hash has many


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all strings of GRAM bytes."""
    h, have = _BYTE_MIX[raw], 1
    while have < GRAM:
        h = h[:-have] * np.uint64(pow(_B, have, 1 << 64)) + h[have:]
        have *= 2
    return mix64(h)


def runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """start, number of windows, hash, hash of the bytes, whether the hash occurs twice, and what is around it, of all runs.

    The latter are 16 bits each of the hashes of the grams just before and after, 0 where they aren't in the run.
    """
    width = length - GRAM + 1
    flags = np.zeros(len(raw) + 1, np.int8)
    has = np.diff(offsets) >= length
    np.add.at(flags, offsets[:-1][has], 1)
    np.add.at(flags, offsets[1:][has] - length + 1, -1)
    valid = np.cumsum(flags[:-1]) > 0
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(raw) - length + 1), STRETCH):
        end = min(at + STRETCH, len(raw) - length + 1)
        ok = valid[at:end]
        if not ok.any():
            continue
        part = raw[at : end + length - 1]
        h = gram_hashes(part)
        low = sliding_min(h, width)
        change = np.ones(len(low) + 1, bool)
        change[1:-1] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
        begin = np.flatnonzero(ok & change[:-1])
        stop = np.flatnonzero(ok & change[1:]) + 1
        n = stop - begin
        mine = low[begin]
        view = np.lib.stride_tricks.sliding_window_view(h, width)
        left, right = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
        for i in range(0, len(begin), 8192):
            j = slice(i, i + 8192)
            left[j] = begin[j] + (view[begin[j]] == mine[j, None]).argmax(1)
            right[j] = stop[j] - 1 + width - 1 - (view[stop[j] - 1][:, ::-1] == mine[j, None]).argmax(1)
        before, after = left - GRAM, left + GRAM
        bits = lambda at, inside, h=h: np.where(inside, np.maximum(h[np.clip(at, 0, len(h) - 1)] >> np.uint64(48), np.uint64(1)), np.uint64(0))
        around = bits(before, before >= begin) << np.uint64(16) | bits(after, after + GRAM <= stop + length - 1)
        summed = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_MIX[part] * powers(len(part)), out=summed[1:])
        whole = (summed[stop + length - 1] - summed[begin]) * powers(len(part), _INVERSE)[begin]
        out.append((begin + at, n, mine, mix64(whole + n.astype(np.uint64)), left < right, around.astype(np.int64)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, bool, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def packed(kind: int, slot: np.ndarray, doc, text_hash, start, size, hashes=None, bytes_hash=None, around=None) -> dict | None:
    """Columns of PACKED, a row a slot."""
    if not len(slot):
        return None
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    cut = np.flatnonzero(np.diff(slot)) + 1
    bounds = list(zip([0, *cut.tolist()], [*cut.tolist(), len(slot)], strict=True))

    def column(x, pack):
        if x is None:
            return pa.array([b""] * len(bounds), pa.binary())
        x = x[order]
        return pa.array([pack(x[i:j]) for i, j in bounds], pa.binary())

    raw = lambda x: np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return {
        "kind": pa.array([kind] * len(bounds), pa.int32()), "slot": pa.array([int(slot[i]) for i, _ in bounds], pa.int32()), "hash": column(hashes, raw),
        "bytes_hash": column(bytes_hash, lambda x: x.astype("<u8").tobytes()), "doc": column(doc, planes), "text_hash": column(text_hash, lambda x: x.astype("<i4").tobytes()), "start": column(start, planes), "size": column(size, planes), "around": column(around, lambda x: x.astype("<u4").tobytes()),
    }


def unpacked(pdf) -> tuple[np.ndarray, ...]:
    """hash, hash of the bytes, document, hash of its text, start, size and what is around, of all rows of packed blocks."""
    def six(b: bytes) -> np.ndarray:
        x = np.zeros((len(b) // 6, 8), np.uint8)
        x[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
        return x.reshape(-1).view("<u8")

    join = lambda name, f: np.concatenate([f(b) for b in pdf[name]])
    return join("hash", six), join("bytes_hash", lambda b: np.frombuffer(b, "<u8")), join("doc", unplanes), join("text_hash", lambda b: np.frombuffer(b, "<i4")), join("start", unplanes), join("size", unplanes), join("around", lambda b: np.frombuffer(b, "<u4")).astype(np.int64)


def doc_slot(doc: np.ndarray, slots: int) -> np.ndarray:
    """As slot_of, in numpy."""
    x = doc.astype(np.int64).view(np.uint64)
    x = x ^ (x << np.uint64(13))
    x = x ^ (x >> np.uint64(7))
    x = x ^ (x << np.uint64(17))
    return np.mod(x.view(np.int64), slots)


def slot_of(doc, slots: int):
    """A document's slot as a Spark column: shifts and exclusive or, then the remainder."""
    x = doc.bitwiseXOR(F.shiftleft(doc, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    x = x.bitwiseXOR(F.shiftleft(x, 17))
    return F.pmod(x, F.lit(slots)).cast("int")


def later(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by `keys` (most important first), and which rows in it equal their predecessor in all but the last three.

    The last three are a place (document, hash of its text, start); of rows for one place, as repeated
    rows of a table give them, one stays.
    """
    order = np.lexsort(keys[::-1])

    def repeats(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(order), bool)
        out[1:] = True
        for k in some:
            x = k[order]
            out[1:] &= x[1:] == x[:-1]
        return out

    order = order[~repeats(keys)]
    return order, repeats(keys[:-3])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by Larsson-Sadakane refinement.

    A suffix's rank is the place of the last one of its group. Each round sorts the groups that hold
    more than one suffix by the rank of what follows, and doubles the depth.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        part = wide[k : k + n] + np.uint64(1)
        part[max(0, n - k) :] = 0
        key = (key << np.uint64(9)) | part
    sa = np.argsort(key)

    def ends_of(sorted_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row is the last of its group, and the place of the last one."""
        last = np.append(sorted_key[1:] != sorted_key[:-1], True)
        ends = np.flatnonzero(last)
        return last, np.repeat(ends, np.diff(ends, prepend=-1))

    last, place = ends_of(key[sa])
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = place, -1
    open_ = np.flatnonzero(~(last & np.append(True, last[:-1])))
    h = 7
    while len(open_):
        some = sa[open_]
        key = (rank[some] << np.int64(32)) | (rank[np.minimum(some + h, n)] + 1)
        order = np.argsort(key)
        some = some[order]
        sa[open_] = some
        last, place = ends_of(key[order])
        rank[some] = open_[place]
        open_ = open_[~(last & np.append(True, last[:-1]))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, stretch: int = 128) -> np.ndarray:
    """Length of the common prefix, up to `most`, of each suffix in `sa` and the one before it.

    Kasai's walk: going one byte on in the text loses one byte of the common prefix at most. Stretches
    of the text walk in step, each from its own beginning, and compare eight bytes at a time.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    wide, words = np.concatenate([text, np.zeros(8, np.uint8)]), np.zeros(n, np.uint64)
    for k in range(8):
        words |= wide[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    starts = np.arange(0, n, stretch)
    h = np.zeros(len(starts), np.int64)
    found = np.zeros(n, np.int64)
    for step in range(min(stretch, n)):
        i = starts + step
        inside = i < n
        i = np.where(inside, i, 0)
        j = before[i]
        bound = np.where(inside & (j >= 0), np.minimum(most, n - np.maximum(i, j)), 0)
        h = np.minimum(np.maximum(h - 1, 0), bound)
        go = np.flatnonzero(h < bound)
        while len(go):
            x = words[i[go] + h[go]] ^ words[j[go] + h[go]]
            same = (np.bitwise_count((x & -x) - np.uint64(1)) >> 3).astype(np.int64)  # equal bytes from the lowest on
            h[go] = np.minimum(h[go] + same, bound[go])
            go = go[(same == 8) & (h[go] < bound[go])]
        found[i[inside]] = h[inside]
    return found[sa]


def shard_strings(text: np.ndarray, begin: np.ndarray, windows: np.ndarray, order_key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Judges the windows of a shard's stretches of text.

    `begin` and `windows` say where each stretch starts and how many windows it has; order_key orders
    a stretch's first window among all (document and start), later windows follow it one by one.
    Returns the positions of all windows, their stretch, and whether an equal one starts earlier.
    """
    sa = suffix_array(text)
    group = np.cumsum(common_prefixes(text, sa, length) < length)
    stretch = np.repeat(np.arange(len(begin)), windows)
    ahead = np.arange(len(stretch)) - np.repeat(np.cumsum(windows) - windows, windows)
    position = begin[stretch] + ahead
    of = np.empty(len(text), np.int64)
    of[sa] = group
    name, key = of[position], order_key[stretch] + ahead
    best = np.full(int(group.max(initial=0)) + 1, _MOST, np.int64)
    np.minimum.at(best, name, key)
    return position, stretch, key > best[name]


def window_digests(text: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of windows."""
    out = []
    for base, inverse in ((_B | 1, _INVERSE), (0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64))):
        summed = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTE_MIX[text] * powers(len(text), base), out=summed[1:])
        out.append(mix64((summed[position + length] - summed[position]) * powers(len(text), inverse)[position]))
    return out[0], out[1]


def joined(start: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Consecutive windows of one key as one (start, end); rows come in order."""
    if not len(start):
        return (start, start, *keys)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] != start[:-1] + 1
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return (start[first], start[last] + size, *[k[first] for k in keys])


def to_judge(h: np.ndarray, twice: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Which of a bucket's different runs, in order of hashes, may share a window with another run, or with themselves."""
    if not len(h):
        return np.zeros(0, bool)
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    many = np.diff(np.append(at, len(h)))
    name = np.repeat(np.arange(len(at)), many)
    out = twice | (np.logical_or.reduceat(twice, at) & (many > 1))[name]
    for side in (around >> 16, around & 0xFFFF):
        order = np.lexsort((side, name))
        x, y = name[order], side[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (y[1:] > 0)
        out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def as_rows(parts: list[dict | None]):
    import pandas as pd

    found = [pa.RecordBatch.from_pydict(p).to_pandas() for p in parts if p]
    return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in PACKED.split(", ")})


def settled(pdf, length: int, slots: int) -> tuple[dict | None, tuple[np.ndarray, ...]]:
    """Cuts of all but the first of equal runs, and the first ones, in order of hashes."""
    h, bytes_hash, d, t, start, n, around = unpacked(pdf)
    order, same = later([h, bytes_hash, np.abs(n), d, t, start])
    again, first = order[same], order[~same]
    cut = packed(CUT, doc_slot(d[again], slots), d[again], t[again], start[again], start[again] + np.abs(n[again]) + length - 1)
    return cut, tuple(x[first] for x in (h, bytes_hash, d, t, start, n, around))


def nth_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of each row's hash and its place there; hashes come in order."""
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    many = np.diff(np.append(at, len(h)))
    return np.repeat(many, many), np.arange(len(h)) - np.repeat(at, many)


def judged_first(docs: DataFrame, length: int, slots: int) -> DataFrame:
    """Steps 1 and 2: packed rows of what is cut already (CUT) and of runs to judge (ASK)."""

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, offsets = text_bytes(batch.column(2))
        doc, text_hash = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        start, n, h, bytes_hash, twice, around = runs(raw, offsets, length)
        row = np.searchsorted(offsets, start, side="right") - 1
        start, d, t = start - offsets[row], doc[row], text_hash[row]
        order, same = later([h, bytes_hash, n, d, t, start])
        again, first = order[same], order[~same]
        slot = ((h[first] & np.uint64((1 << 48) - 1)) % np.uint64(slots)).astype(np.int64)
        parts = [
            packed(CUT, doc_slot(d[again], slots), d[again], t[again], start[again], start[again] + n[again] + length - 1),
            packed(RUN, slot, d[first], t[first], start[first], np.where(twice[first], -n[first], n[first]), h[first], bytes_hash[first], around[first]),
        ]
        found = [pa.RecordBatch.from_pydict(p) for p in parts if p]
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None

    def ask(h, d, t, start, n, lot) -> dict | None:
        return packed(ASK, doc_slot(d, slots), d, t, start, np.abs(n), h, lot.astype(np.uint64))

    def meet(pdf):
        cut, (h, _, d, t, start, n, around) = settled(pdf, length, slots)
        some = to_judge(h, n < 0, around)
        h, d, t, start, n, around = (x[some] for x in (h, d, t, start, n, around))
        many, nth = nth_of(h)
        split = many > HOT
        if len(h):
            at = np.flatnonzero(nth == 0)
            split |= np.repeat(np.logical_or.reduceat(around == _MARK, at), many[at])
        # of a hash with very many runs, each lot of HOT goes to a shard of its own, marked by the lot's number
        return as_rows([cut, ask(h, d, t, start, n, np.where(split, nth // HOT + 1, 0))])

    def part(key, pdf):
        cut, (h, b, d, t, start, n, around) = settled(pdf, length, slots)
        many, nth = nth_of(h)
        hot = many >= MANY
        on = ~hot | (nth == 0)
        lots = (int(key[1]) + 1) * 4096 + nth // HOT
        mark = np.where(hot, _MARK, around)
        slot = np.full(len(h), int(key[0]), np.int64)
        return as_rows([cut, ask(*(x[hot] for x in (h, d, t, start, n, lots))), packed(RUN, slot[on], d[on], t[on], start[on], np.where(hot, -np.abs(n), n)[on], h[on], b[on], mark[on])])

    def deal(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pandas()
                h, b, d, t, start, n, around = unpacked(row)
                parts = packed(RUN, (mix64(h + b) % np.uint64(row["parts"].iloc[0])).astype(np.int64), d, t, start, n, h, b, around)
                yield pa.RecordBatch.from_pydict(parts | {"part": parts["slot"], "slot": pa.array([int(row["slot"].iloc[0])] * len(parts["slot"]), pa.int32())}).select([*row.columns.drop("parts"), "part"])

    emitted = staged(map_gathered(docs.select("doc", "text_hash", "text"), emit, PACKED, 2 << 20), "runs")
    met = emitted.filter(F.col("kind") == RUN)
    sizes = met.groupBy("slot").agg(F.sum(F.length("bytes_hash") * 4).alias("bytes"))
    hot = staged(sizes.filter(F.col("bytes") > HOT_BYTES).select("slot", F.ceil(F.col("bytes") / HOT_BYTES).alias("parts")), "hot_slots")
    done = [emitted.filter(F.col("kind") == CUT)]
    if not hot.isEmpty():
        dealt = map_arrow(met.join(hot, "slot").select(*met.columns, "parts"), deal, f"{PACKED}, part int")
        split = staged(dealt.groupBy("slot", "part").applyInPandas(part, PACKED), "hot_parts")
        done.append(split.filter(F.col("kind") != RUN))
        met = met.join(hot, "slot", "left_anti").select(*met.columns).unionByName(split.filter(F.col("kind") == RUN))
    done.append(staged(met.groupBy("slot").applyInPandas(meet, PACKED), "met"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def documents_of(rows: DataFrame) -> DataFrame:
    """Ids of the documents in packed rows, repeated ones included."""

    def run(batches):
        for batch in batches:
            docs = [np.unique(unplanes(b.as_py())) for b in batch.column(0)]
            if docs:
                yield pa.RecordBatch.from_pydict({"id": pa.array(np.unique(np.concatenate(docs)), pa.int64())})

    return map_arrow(rows.select("doc"), run, "id long")


def find_repeats(docs: DataFrame, length: int, slots: int) -> DataFrame:
    """Packed (document, start, end) of what repeats, by document slot (kind CUT)."""
    found = judged_first(docs, length, slots)

    def fetch(key, left, right):
        import pandas as pd

        if not len(right):
            return pd.DataFrame({c: [] for c in ("shard", "lot", "hash", "doc", "text_hash", "start", "size", "text")})
        h, lot, d, t, start, n, _ = unpacked(right)
        have = {(a, b): x for a, b, x in zip(left["doc"], left["text_hash"], left["text"], strict=True)}
        order = np.lexsort((t, d))
        pieces: dict[int, bytes] = {}
        now, data = None, b""
        for i in order.tolist():
            if now != (d[i], t[i]):
                now = (int(d[i]), int(t[i]))
                data = have[now].encode()
            pieces[i] = data[start[i] : start[i] + n[i] + length - 1]
        shard = (mix64(h + lot * np.uint64(0x9E3779B9)) % np.uint64(slots)).astype(np.int64)
        rows = []
        order = np.lexsort((lot, shard))
        cut = np.flatnonzero((np.diff(shard[order]) != 0) | ((lot[order][1:] > 0) != (lot[order][:-1] > 0))) + 1
        for g in np.split(order, cut):
            if len(g):
                rows.append((int(shard[g[0]]), int(lot[g[0]] > 0), (h[g] ^ (lot[g] << np.uint64(48))).tobytes(), planes(d[g]), t[g].astype("<i4").tobytes(), planes(start[g]), planes(n[g]), b"".join(pieces[i] for i in g.tolist())))
        return pd.DataFrame(rows, columns=["shard", "lot", "hash", "doc", "text_hash", "start", "size", "text"])

    asked = found.filter(F.col("kind") == ASK)
    by_slot = maybe_among(docs.select("doc", "text_hash", "text"), "doc", documents_of(asked), "maybe").filter("maybe").select("doc", "text_hash", "text", slot_of(F.col("doc"), slots).alias("slot"))
    stretches = by_slot.groupBy("slot").cogroup(asked.groupBy("slot")).applyInPandas(fetch, "shard int, lot int, hash binary, doc binary, text_hash binary, start binary, size binary, text binary")

    def judge(key, pdf):
        hot = bool(key[1])
        h = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["hash"]])
        d, start, n = (np.concatenate([unplanes(b) for b in pdf[c]]) for c in ("doc", "start", "size"))
        t = np.concatenate([np.frombuffer(b, "<i4") for b in pdf["text_hash"]])
        text = np.frombuffer(b"".join(pdf["text"]), np.uint8)
        at = np.cumsum(n + length - 1) - (n + length - 1)
        order = np.lexsort((start, t, d, h))
        parts, i = [], 0
        while i < len(order):  # whole hashes, until a piece of text has about STRETCH bytes
            j = i + 1
            size = int(n[order[i]]) + length - 1
            while j < len(order) and (size < STRETCH or h[order[j]] == h[order[j - 1]]):
                size += int(n[order[j]]) + length - 1
                j += 1
            some = order[i:j]
            i = j
            piece = np.concatenate([text[a : a + k + length - 1] for a, k in zip(at[some].tolist(), n[some].tolist(), strict=True)])
            begin = np.cumsum(n[some] + length - 1) - (n[some] + length - 1)
            docs_in = np.lexsort((t[some], d[some]))
            change = np.ones(len(some), bool)
            change[1:] = (d[some][docs_in][1:] != d[some][docs_in][:-1]) | (t[some][docs_in][1:] != t[some][docs_in][:-1])
            rank = np.empty(len(some), np.int64)
            rank[docs_in] = np.cumsum(change)
            position, stretch, gone = shard_strings(piece, begin, n[some], (rank << np.int64(32)) + start[some], length)
            w = start[some][stretch] + position - begin[stretch]
            dd, tt = d[some][stretch], t[some][stretch]
            a, b, x, y, _ = joined(w[gone], length, dd[gone], tt[gone], stretch[gone])
            parts.append(packed(CUT, doc_slot(x, slots), x, y, a, b))
            if hot:
                keep = np.flatnonzero(~gone)
                one, two = window_digests(piece, position[keep], length)
                parts.append(packed(WINDOW, (one % np.uint64(slots)).astype(np.int64), dd[keep], tt[keep], w[keep], np.full(len(keep), 1), two, one))
        return as_rows(parts)

    judged = staged(stretches.groupBy("shard", "lot").applyInPandas(judge, PACKED), "judged")

    def merge(key, pdf):
        lists = []
        for k in range(len(pdf)):
            two, one, d, t, w, *_ = unpacked(pdf.iloc[k : k + 1])
            order = np.lexsort((two, one))
            lists.append(tuple(x[order] for x in (one, two, d, t, w)))
        one, two, d, t, w = (np.concatenate(c) for c in zip(*lists, strict=True))
        order = np.lexsort((w, t, d, two, one))
        new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
        top = order[new]  # earliest start of every string
        names = np.rec.fromarrays([one[top], two[top]])
        parts = []
        for o, p, x, y, z in lists:  # each shard's list finds its strings by binary search
            k = np.searchsorted(names, np.rec.fromarrays([o, p], dtype=names.dtype))
            e = top[k]
            gone = (x != d[e]) | (y != t[e]) | (z != w[e])
            order = np.lexsort((z[gone], y[gone], x[gone]))
            a, b, u, v = joined(z[gone][order], length, x[gone][order], y[gone][order])
            parts.append(packed(CUT, doc_slot(u, slots), u, v, a, b))
        return as_rows(parts)

    merged = judged.filter(F.col("kind") == WINDOW).groupBy("slot").applyInPandas(merge, PACKED)
    cuts = found.filter(F.col("kind") == CUT).unionByName(judged.filter(F.col("kind") == CUT)).unionByName(staged(merged, "merged"))
    return cuts.select("slot", "doc", "text_hash", "start", "size")


def remove_repeats(docs: DataFrame, *, length: int = 100, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the maximal removed runs, and kept (the bytes that stay) of every row.

    With `keep`, kept_text has what stays as text, without bytes of a character that was cut, and `rest`
    these columns of the row as JSON.
    """
    ship(docs.sparkSession)
    rest = F.to_json(F.struct(*[F.col(c) for c in keep]), {"ignoreNullFields": "false"}) if keep else F.lit("{}")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_MOST)).alias("doc"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("text_hash"), text.alias("text"), rest.alias("rest"))
    slots = int(max(64, input_bytes(docs) // (4 << 20))) | 1
    cuts = find_repeats(docs, length, slots)

    def cut(key, left, right):
        import pandas as pd

        spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if len(right):
            d, start, end = (np.concatenate([unplanes(b) for b in right[c]]) for c in ("doc", "start", "size"))
            t = np.concatenate([np.frombuffer(b, "<i4") for b in right["text_hash"]])
            order = np.lexsort((end, start, t, d))
            d, t, start, end = d[order], t[order], start[order], end[order]
            edge = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(d)], strict=True):
                reach = np.maximum.accumulate(end[i:j])
                new = np.append(True, start[i:j][1:] > reach[:-1])
                spans[int(d[i]), int(t[i])] = start[i:j][new], reach[np.append(np.flatnonzero(new)[1:] - 1, j - i - 1)]
        rows = []
        for no_id, d, t, text, rest in zip(left["no_id"], left["doc"], left["text_hash"], left["text"], left["rest"], strict=True):
            data = text.encode()
            a, b = spans.get((int(d), int(t)), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            if len(a):
                kept = b"".join(data[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
            else:
                kept = data
            rows.append((None if no_id else int(d), len(data), a.tolist(), b.tolist(), kept, kept.decode(errors="ignore") if keep is not None else None, rest))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "starts", "ends", "kept", "kept_text", "rest"])
        return out.astype({"doc_id": "Int64"})

    marked = maybe_among(docs, "doc", documents_of(cuts), "maybe")
    none = F.array().cast("array<long>")
    whole = marked.filter(~F.col("maybe")).select(
        F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), none.alias("starts"), none.alias("ends"),
        F.col("text").cast("binary").alias("kept"), (F.col("text") if keep is not None else F.lit(None).cast("string")).alias("kept_text"), "rest",
    )
    by_slot = marked.filter("maybe").drop("maybe").withColumn("slot", slot_of(F.col("doc"), slots))
    return whole.unionByName(by_slot.groupBy("slot").cogroup(cuts.groupBy("slot")).applyInPandas(cut, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary, kept_text string, rest string"))


def digest(removed: DataFrame) -> DataFrame:
    """The columns of op7."""
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame, **how) -> DataFrame:
    """`docs` with what repeats taken from text (bytes of a character that was cut go as well); n_chars follows where it is there."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs, keep=others, **how)
    schema = T.StructType([docs.schema[c] for c in others])
    cut = cut.select("doc_id", F.col("kept_text").alias("text"), F.from_json("rest", schema).alias("row"), (F.size("starts") > 0).alias("changed"))
    value = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text")).otherwise(F.col("row")["n_chars"] if "n_chars" in others else F.lit(0))}
    return cut.select(*[value.get(c, F.col("row")[c] if c in others else None).alias(c) for c in docs.columns])

