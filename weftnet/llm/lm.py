"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, read from memory-mapped sorted hash arrays.

Tokens are counted first, in shards of their hash; a token's number is its place by count within its
shard, interleaved over shards, so frequent tokens have small numbers everywhere and no list of tokens
is ever gathered. Batches then send their distinct n-grams, as packed columns of numbers, to shards of
their context. A shard merges them, writes their counts and what its contexts are followed by, and sends
each distinct suffix on to the next lower order, whose counts are thus numbers of different left
neighbours. Contexts of frequent tokens only (`WIDE` numbers a shard) are dealt by the whole n-gram, so
no context fills a shard; their sums meet once more, one row a shard.

With counts c of the highest order and left neighbours below, P(w|h) = (max(c(hw) - D(c), 0) + G(h) P(w|h')) / c(h),
where h' drops the first token and G(h) = D1 N1 + D2 N2 + D3 N3+ counts what follows h once, twice, more often.
The lowest order gives what its discounts take to all V + 1 tokens alike (an unknown one included). An
unseen context gives P(w|h'). Discounts come from counts of counts of each order. Probabilities over
all tokens and the unknown one sum to 1. Texts begin with order - 1 begin marks.

A file holds a shard's n-grams and contexts: hashes sorted, their leading bits given by an index of
buckets of about 64, the next 40 bits stored, and a byte a value (larger values apart). Workers map the
files of `spark.checkpoint.dir` where it is a path (file:), at most OPEN of them at a time, the least
recently used closed first. From another store a worker reads a shard's whole file, of bounded size,
and keeps FETCHED of them at most.

Defined cases: a null or empty text is the end token alone; without training text every token has
probability 1/(V + 1) = 1; a null id is trained on and returned as null; repeated rows count again; extra
columns are ignored. Equal 64-bit hashes count as equal tokens; an n-gram is taken for another one of
its shard with a probability of about 64 / 2**40.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftnet.llm.common import documents, fresh_path, input_bytes, map_gathered, mix64, ship, text_bytes, word_hashes

END_HASH = np.uint64(0xE5D0F7A1C3B29487)
BEGIN, UNKNOWN = 0, 1 << 62  # numbers; tokens have numbers from 1
#: Files that a worker maps at once; shards that it keeps of a store it can't map; numbers a shard that may form wide contexts.
OPEN, FETCHED, WIDE = 64, 4, 16
#: Bytes of text whose n-grams are formed at once.
TEXT_BYTES = 8 << 20
ROWS = "kind int, shard int, n long, data binary"
SUMS = f"{ROWS}, stats array<long>"
GRAMS, CONTEXTS, STATS = 0, 1, 2


class Shelf:
    """Files of named arrays in a folder of the shared store."""

    def __init__(self, uri: str):
        self.uri, self.local = uri, uri.removeprefix("file://").removeprefix("file:") if uri.startswith(("file:", "/")) else None
        self._open: OrderedDict[str, dict | None] = OrderedDict()

    def __getstate__(self):
        return {"uri": self.uri, "local": self.local, "_open": OrderedDict()}

    def put(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Writes once and for all: a repeated task replaces the file by an equal one."""
        head, at, parts = {}, 0, []
        for key, x in arrays.items():
            x = np.ascontiguousarray(x)
            head[key] = (x.dtype.str, x.shape, at)
            parts.append(x.tobytes() + b"\0" * (-x.nbytes % 8))
            at += len(parts[-1])
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        data = [len(text).to_bytes(8, "little"), text, *parts]
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            part = f"{self.local}/.{name}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.writelines(data)
            os.replace(part, f"{self.local}/{name}")
        else:
            store, path = self._store()
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}") as f:
                for d in data:
                    f.write(d)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def _raw(self, name: str):
        if self.local is not None:
            try:
                return np.memmap(f"{self.local}/{name}", np.uint8, "r")
            except FileNotFoundError:
                return None
        store, path = self._store()
        if not store.get_file_info(f"{path}/{name}").is_file:
            return None
        with store.open_input_file(f"{path}/{name}") as f:
            return np.frombuffer(f.read(), np.uint8)

    def get(self, name: str) -> dict | None:
        """Arrays of a file; None where there is no such file."""
        if name in self._open:
            self._open.move_to_end(name)
            return self._open[name]
        raw, out = self._raw(name), None
        if raw is not None:
            size = int.from_bytes(raw[:8].tobytes(), "little")
            out = {}
            for key, (kind, shape, at) in json.loads(raw[8 : 8 + size].tobytes()).items():
                n = int(np.prod(shape)) * np.dtype(kind).itemsize
                out[key] = raw[8 + size + at : 8 + size + at + n].view(kind).reshape(shape)
        self._open[name] = out
        while len(self._open) > (OPEN if self.local is not None else FETCHED):
            self._open.popitem(last=False)
        return out


# Sorted hash arrays.


def narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in 32 bits where they fit."""
    return x.astype("<u4" if not x.size or x.max() < 1 << 32 else "<u8")


def hash_index(h: np.ndarray, prefix: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Arrays of sorted hashes: where buckets of leading bits begin, and the 40 bits after them. Also their order."""
    order = np.argsort(h)
    h = h[order]
    bits = max(0, (len(h) // 64).bit_length() - 1)
    rest = (h << np.uint64(bits)) >> np.uint64(24)
    starts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(h)])
    return {f"{prefix}starts": narrow(starts), f"{prefix}high": (rest >> np.uint64(8)).astype("<u4"), f"{prefix}low": (rest & np.uint64(255)).astype(np.uint8)}, order


def find(arrays: dict, prefix: str, h: np.ndarray) -> np.ndarray:
    """Places of hashes in an index, -1 where they aren't."""
    starts, high, low = (arrays[prefix + c] for c in ("starts", "high", "low"))
    if not len(high):
        return np.full(len(h), -1, np.int64)
    bits = (len(starts) - 1).bit_length() - 1
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    rest = (h << np.uint64(bits)) >> np.uint64(24)
    mine, tail = (rest >> np.uint64(8)).astype(np.uint32), (rest & np.uint64(255)).astype(np.uint8)
    at, end = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
    size = end - at
    last = len(high) - 1
    for _ in range(int(size.max(initial=0)).bit_length()):
        half = size >> 1
        mid = at + half
        right = (size > 0) & (high[np.minimum(mid, last)] < mine)
        at = np.where(right, mid + 1, at)
        size = np.where(right, size - half - 1, half)
    out = np.full(len(h), -1, np.int64)
    for ahead in (2, 1, 0):  # entries that share 32 bits differ in the other 8
        place = np.minimum(at + ahead, last)
        hit = (at + ahead < end) & (high[place] == mine) & (low[place] == tail)
        out[hit] = place[hit]
    return out


def coded_counts(n: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    """Counts as bytes, those from 255 on apart."""
    big = np.flatnonzero(n >= 255)
    return {f"{prefix}code": np.minimum(n, 255).astype(np.uint8), f"{prefix}big_at": narrow(big), f"{prefix}big": narrow(n[big])}


def counts_at(arrays: dict, prefix: str, place: np.ndarray) -> np.ndarray:
    """Counts of places (0 for -1)."""
    out = np.where(place >= 0, arrays[prefix + "code"][np.maximum(place, 0)], 0).astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = arrays[prefix + "big"][np.searchsorted(arrays[prefix + "big_at"], place[big])]
    return out


def coded_sums(sums: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    """Rows (count, followed by once, twice, more often) as bytes.

    1 to 127 stand for so many different followers, once each; 128 to 254 for the most frequent other rows.
    """
    simple = (sums[:, 0] == sums[:, 1]) & (sums[:, 0] < 128) & ~sums[:, 2:].any(1)
    code = np.where(simple, sums[:, 0], 255).astype(np.uint8)
    other = np.flatnonzero(~simple)
    key = np.zeros(len(other), np.uint64)
    for j in range(4):
        key = mix64(key + sums[other, j].astype(np.uint64))
    _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    top = np.lexsort((first, -n))[:127]
    name = np.full(len(first), 255, np.uint8)
    name[top] = 128 + np.arange(len(top))
    code[other] = name[back]
    big = np.flatnonzero(code == 255)
    return {f"{prefix}code": code, f"{prefix}rows": sums[other[first[top]]], f"{prefix}big_at": narrow(big), f"{prefix}big": narrow(sums[big])}


def sums_at(arrays: dict, prefix: str, place: np.ndarray) -> np.ndarray:
    """Rows of places (zeros for -1)."""
    code = np.where(place >= 0, arrays[prefix + "code"][np.maximum(place, 0)], 0).astype(np.int64)
    out = np.zeros((len(place), 4), np.int64)
    simple = code < 128
    out[simple, 0] = out[simple, 1] = code[simple]
    other = np.flatnonzero(~simple & (code < 255))
    out[other] = arrays[prefix + "rows"][code[other] - 128]
    big = np.flatnonzero(code == 255)
    out[big] = arrays[prefix + "big"][np.searchsorted(arrays[prefix + "big_at"], place[big])]
    return out


# Tokens, n-grams and their columns.


def token_stream(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and an end after them, and the number of tokens of each row."""
    words, counts = word_hashes(raw, offsets)
    ends = np.cumsum(counts)
    return np.insert(words, ends, END_HASH), counts + 1


def top_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash by its upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def gram_hash(columns: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(columns[0]), salt, np.uint64)
    for c in columns:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    return h


def gram_shard(columns: list[np.ndarray], shards: int) -> np.ndarray:
    """Shard of n-grams: that of their context, or of themselves where the context is wide."""
    if len(columns) == 1:
        return (columns[0] - 1) % shards
    h = gram_hash(columns[:-1], 11)
    wide = is_wide(columns[:-1], shards)
    h[wide] = gram_hash([c[wide] for c in columns], 12)
    return top_shard(h, shards)


def is_wide(context: list[np.ndarray], shards: int) -> np.ndarray:
    return np.maximum.reduce(context) <= WIDE * shards


def distinct(columns: list[np.ndarray], counts: np.ndarray | None = None, inverse: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and the sums of their counts (1 each without) or, with `inverse`, where each row is."""
    key, spans, whole = columns[0].astype(np.uint64), [], True
    span = int(key.max(initial=0)) + 1
    for c in columns[1:]:
        m = int(c.max(initial=0)) + 1
        if span * m >= 1 << 64:
            u, key = np.unique(key, return_inverse=True)
            key, span, whole = key.astype(np.uint64), len(u), False
        if span * m >= 1 << 64:  # this column has large gaps
            u, c = np.unique(c, return_inverse=True)
            m, whole = len(u), False
        key = key * np.uint64(m) + c.astype(np.uint64)
        span *= m
        spans.append(m)
    if whole and counts is None and not inverse:
        u, n = np.unique(key, return_counts=True)
    elif whole and inverse:
        u, n = np.unique(key, return_inverse=True)
    else:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(key) else np.zeros(0, np.int64)
        if inverse:
            n = np.empty(len(key), np.int64)
            n[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        else:
            n = np.diff(np.append(first, len(key))) if counts is None else np.add.reduceat(counts[order], first) if len(key) else counts[:0]
        if not whole:
            return [c[order[first]] for c in columns], n
        u = sorted_key[first]
    out = []
    for m in reversed(spans):
        out.append((u % np.uint64(m)).astype(np.int64))
        u = u // np.uint64(m)
    return [u.astype(np.int64), *reversed(out)], n


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of non-negative integers as compressed planes of their bytes, the first one (ascending) as differences."""
    out = [bytes([len(columns)])]
    for k, c in enumerate(columns):
        c = np.diff(c, prepend=0) if k == 0 else c
        width = (int(c.max(initial=0)).bit_length() + 7) // 8
        out += [bytes([width]), np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 1
    for k in range(raw[0]):
        width, planes = raw[at], np.zeros((n, 8), np.uint8)
        at += 1
        planes[:, :width] = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T
        at += width * n
        c = planes.reshape(-1).view("<i8")
        out.append(np.cumsum(c) if k == 0 else c)
    return out


def dealt(kind: int, shard: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """Rows of ROWS, one a shard; columns keep their order within it."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cut = np.flatnonzero(np.diff(shard)) + 1
    columns = [c[order] for c in columns]
    return [(kind, int(shard[i]), j - i, pack([c[i:j] for c in columns])) for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(shard)], strict=True) if j > i]


def as_batch(rows: list[tuple]) -> pa.RecordBatch | None:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "shard", "n", "data"]) if rows else None


def as_frame(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame([(*r, None) if len(r) == 4 else r for r in rows], columns=["kind", "shard", "n", "data", "stats"]).astype({"kind": "int32", "shard": "int32", "n": "int64"})


def gathered(pdf) -> list[np.ndarray]:
    parts = [unpack(d, n) for d, n in zip(pdf["data"], pdf["n"], strict=True)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


# The model.


class Model:
    """What a worker needs to score: the shelf, the number of shards, and sums over all of them."""

    def __init__(self, shelf: Shelf, shards: int, order: int):
        self.shelf, self.shards, self.order = shelf, shards, order
        self.tokens = self.kinds = self.types = 0
        self.discounts: dict[int, tuple[float, float, float]] = dict.fromkeys(range(1, order + 1), (0.5, 0.5, 0.5))
        self.grams: dict[int, int] = {}  # distinct n-grams of each order
        self.spare = 0.0

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (UNKNOWN if never counted) and counts of distinct token hashes."""
        out, count = np.full(len(h), UNKNOWN, np.int64), np.zeros(len(h), np.int64)
        for s, rows, t in self._by_shard(top_shard(h, self.shards), "token"):
            place = find(t, "", mix64(h[rows] + np.uint64(1)))
            hit = place >= 0
            out[rows[hit]] = t["number"][place[hit]].astype(np.int64) * self.shards + s + 1
            count[rows] = counts_at(t, "count_", place)
        return out, count

    def _by_shard(self, shard: np.ndarray, name: str):
        """Shards that have a file, the rows of each, and its arrays."""
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            t = self.shelf.get(f"{name}-{s}")
            if t is not None:
                yield s, order[bounds[s] : bounds[s + 1]], t

    def counts(self, columns: list[np.ndarray]) -> np.ndarray:
        """Adjusted counts of distinct n-grams."""
        out = np.zeros(len(columns[0]), np.int64)
        known = columns[-1] < UNKNOWN
        rows = np.flatnonzero(known)
        some = [c[rows] for c in columns]
        for s, at, t in self._by_shard(gram_shard(some, self.shards), f"grams{len(columns)}"):
            if len(columns) == 1:
                place = (some[0][at] - 1) // self.shards
                out[rows[at]] = np.where(place < len(t["left"]), t["left"][np.minimum(place, len(t["left"]) - 1)], 0)
            else:
                out[rows[at]] = counts_at(t, "gram_", find(t, "gram_", gram_hash([c[at] for c in some], 13)))
        return out

    def contexts(self, columns: list[np.ndarray]) -> np.ndarray:
        """Sums of distinct contexts: count, and how many tokens follow once, twice, more often."""
        out = np.zeros((len(columns[0]), 4), np.int64)
        wide = is_wide(columns, self.shards)
        for rows, name in ((np.flatnonzero(~wide), f"grams{len(columns) + 1}"), (np.flatnonzero(wide), f"wide{len(columns) + 1}")):
            some = [c[rows] for c in columns]
            if len(rows):
                for _, at, t in self._by_shard(top_shard(gram_hash(some, 11), self.shards), name):
                    out[rows[at]] = sums_at(t, "context_", find(t, "context_", gram_hash([c[at] for c in some], 14)))
        return out

    def probabilities(self, columns: list[np.ndarray], known: np.ndarray) -> np.ndarray:
        """P(last | others) of distinct n-grams, whose columns are places in `known`, the numbers."""
        if not self.types:
            return np.full(len(columns[0]), 1 / (self.kinds + 1))
        a = self.counts([known[c] for c in columns])
        left = np.maximum(a - discount(self.discounts[len(columns)], a), 0)
        if len(columns) == 1:
            return (left + self.spare / (self.kinds + 1)) / self.types
        suffixes, back = distinct(columns[1:], inverse=True)
        low = self.probabilities(suffixes, known)[back]
        contexts, back = distinct(columns[:-1], inverse=True)
        total, *n = self.contexts([known[c] for c in contexts]).T
        gap = sum(d * k for d, k in zip(self.discounts[len(columns)], n, strict=True))
        return np.where(total[back] > 0, (left + gap[back] * low) / np.maximum(total[back], 1), low)


def discount(d: tuple, c: np.ndarray) -> np.ndarray:
    return np.select([c <= 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of keys counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return (min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0))


def numbered(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """n-gram columns as places in `known`, the numbers of these places in order, token counts, and the number of tokens of each row."""
    h, n = token_stream(raw, offsets)
    keys, back = np.unique(h, return_inverse=True)
    number, count = model.numbers(keys)
    order = np.argsort(number, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    token = place[back]
    since = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)  # tokens before it in its text
    columns = [token]
    for k in range(1, model.order):
        c = np.zeros_like(token)
        c[k:] = token[:-k] if k < len(token) else 0
        c[since < k] = 0
        columns.insert(0, c)
    return columns, np.append(BEGIN, number[order]), count[back], n


def merge_grams(shelf: Shelf, shards: int, level: int, s: int, pdf) -> list[tuple]:
    """Writes a shard's n-grams of an order and what its contexts are followed by; returns rows for the next order.

    These are the distinct suffixes, counted by left neighbours, the sums of wide contexts, and counts of counts.
    """
    *columns, counts = gathered(pdf)
    grams, n = distinct(columns, counts)
    of_counts = [(n == k).sum() for k in (1, 2, 3, 4)]
    stats = (STATS, level, 0, b"", [int(x) for x in (*of_counts, (n > 2).sum(), len(n), n.sum())])
    if level == 1:
        place = (grams[0] - 1) // shards
        left = np.zeros(int(place.max()) + 1, np.int64)
        left[place] = n
        shelf.put(f"grams1-{s}", {"left": narrow(left)})
        return [stats]
    arrays, at = hash_index(gram_hash(grams, 13), "gram_")
    arrays |= coded_counts(n[at], "gram_")
    new = np.zeros(len(n), bool)
    new[:1] = True
    for c in grams[:-1]:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    sums = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2)], 1)
    contexts = [c[first] for c in grams[:-1]]
    wide = is_wide(contexts, shards)
    own = [c[~wide] for c in contexts]
    index, at = hash_index(gram_hash(own, 14), "context_")
    shelf.put(f"grams{level}-{s}", arrays | index | coded_sums(sums[~wide][at], "context_"))
    spread = [c[wide] for c in contexts]
    rows = dealt(CONTEXTS, top_shard(gram_hash(spread, 11), shards), [*spread, *sums[wide].T])
    suffixes, left = distinct(grams[1:])
    return [*rows, *dealt(GRAMS, gram_shard(suffixes, shards), [*suffixes, left]), stats]


def merge_contexts(shelf: Shelf, level: int, s: int, pdf) -> None:
    """Adds up a shard's wide contexts of an order."""
    *columns, a, b, c, d = gathered(pdf)
    contexts, back = distinct(columns, inverse=True)
    sums = np.zeros((len(contexts[0]), 4), np.int64)
    for j, x in enumerate((a, b, c, d)):
        np.add.at(sums[:, j], back, x)
    index, at = hash_index(gram_hash(contexts, 14), "context_")
    shelf.put(f"wide{level}-{s}", index | coded_sums(sums[at], "context_"))


def train(docs: DataFrame, may_learn: Column, *, order: int = 3, shard_bytes: int = 16 << 20) -> Model:
    """Counts the rows of doc_id and text that `may_learn` marks; `shard_bytes` of input make a shard."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    ship(spark)
    shelf = Shelf(fresh_path(spark, "lm"))
    rows = documents(docs.filter(may_learn))
    shards = int(max(12, input_bytes(docs) // shard_bytes))
    model = Model(shelf, shards, order)

    def count_tokens(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, counts = np.unique(token_stream(*text_bytes(batch.column(1)))[0], return_counts=True)
        halves = [(keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        return as_batch(dealt(GRAMS, top_shard(keys, shards), [*halves, counts]))

    def shelve_tokens(pdf):
        import pandas as pd

        s = int(pdf["shard"].iloc[0])
        high, low, counts = gathered(pdf)
        (high, low), counts = distinct([high, low], counts)
        h = high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
        number = np.empty(len(h), np.int64)
        number[np.lexsort((h, -counts))] = np.arange(len(h))
        arrays, at = hash_index(mix64(h + np.uint64(1)), "")
        shelf.put(f"token-{s}", arrays | {"number": narrow(number[at])} | coded_counts(counts[at], "count_"))
        return pd.DataFrame({"kinds": [len(h)], "tokens": [int(counts.sum())]})

    packed = map_gathered(rows, count_tokens, ROWS, TEXT_BYTES)
    totals = packed.groupBy("shard").applyInPandas(shelve_tokens, "kinds long, tokens long").agg(F.sum("kinds"), F.sum("tokens")).first()
    model.kinds, model.tokens = (int(x or 0) for x in totals)
    if not model.kinds:
        return model

    def count_grams(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        columns, known, _, _ = numbered(model, *text_bytes(batch.column(1)))
        grams, n = distinct(columns)
        grams = [known[c] for c in grams]
        return as_batch(dealt(GRAMS, gram_shard(grams, shards), [*grams, n]))

    def merge(level: int):
        def run(key, pdf):
            kind, s = (int(k) for k in key)
            if kind == STATS:  # sums of a higher order go on
                return as_frame([(STATS, s, 0, b"", [int(x) for x in np.sum(np.stack(pdf["stats"].to_numpy()), 0)])])
            if kind == CONTEXTS:
                merge_contexts(shelf, level + 1, s, pdf)
                return as_frame([])
            return as_frame(merge_grams(shelf, shards, level, s, pdf))

        return run

    found = map_gathered(rows, count_grams, ROWS, TEXT_BYTES)
    for level in range(order, 0, -1):
        found = found.groupBy("kind", "shard").applyInPandas(merge(level), SUMS)
    sums = found.groupBy("shard").agg(*[F.sum(F.element_at("stats", k)).alias(f"s{k}") for k in range(1, 8)]).collect()  # a row an order
    for level, *n in sums:
        model.discounts[level], model.grams[level] = discounts(n[:4]), n[5]
        if level == 1:
            model.types = n[6]
            model.spare = float(np.dot(model.discounts[1], (n[0], n[1], n[4])))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-one unigrams) and score (the model), both log10."""

    def run(batch: pa.RecordBatch) -> dict:
        columns, known, count, n = numbered(model, *text_bytes(batch.column(1)))
        first = np.cumsum(n) - n
        add = lambda x: np.add.reduceat(x, first)
        base = np.log10((count + 1) / (model.tokens + model.kinds + 1))
        grams, back = distinct(columns, inverse=True)
        log = np.log10(model.probabilities(grams, known))[back]
        return {"doc_id": batch.column(0), "n_tokens": pa.array(n), "n_known": pa.array(add((count > 0).astype(np.int64))), "base_score": pa.array(add(base)), "score": pa.array(add(log))}

    return map_gathered(documents(docs), run, "doc_id long, n_tokens long, n_known long, base_score double, score double", TEXT_BYTES)
