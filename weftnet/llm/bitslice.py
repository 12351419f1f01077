"""Exact top-k inner products of quantised vectors from a bit-sliced index.

A block's attributes are shifted to start at 0, and the bits of an attribute over all rows form its
slices, bitmaps of one bit a row. The index keeps the slices above `dropped` low bits. A query's sum
is made of slices alone: for each bit of its absolute weights, the slices of the attributes whose
weight has the bit are added by carry-save steps (exclusive or, and, or on whole bitmaps); negative
weights add the complement. Sums of many queries are added at once, one row of bitmaps a query.

The k-th largest sum is found from the most significant slice downward. What the dropped bits can add
is bounded by (2**dropped - 1) * sum of absolute weights, so rows more than that below the k-th sum
can't be among the best; the rows above that edge are resolved exactly from their whole components.

Sums of rows and queries with very large components may need more than 62 bits. Such rows have an index
of their own, `WideIndex`: slices of the magnitudes of positive and of negative components, at any
weight, with bitmaps of unbounded length. It adds, subtracts and selects in the same way; queries with
such components use it for all rows.

Defined cases: vectors that are null or hold a null or non-finite component take no part; ties go to
smaller ids; rows that share the query's id are its own; repeated rows are candidates each; vectors
meet queries of their length only; 256 * x never overflows; a score beyond 64 bits takes part with its
exact value and is shown as the nearest long; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from weftnet.llm.vectors import best_of, block_search, usable

_LONG = (-(1 << 63), (1 << 63) - 1)


def to_bitmap(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), bool)
    padded[..., :n] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def add_slices(total: list, addend: list, carry=None) -> list:
    """Sum of two bit-sliced numbers, least significant slice first; None stands for a slice of zeros."""
    out = []
    for i in range(max(len(total), len(addend))):
        a, b = (x[i] if i < len(x) else None for x in (total, addend))
        have = [x for x in (a, b, carry) if x is not None]
        if len(have) < 2:
            out.append(have[0] if have else None)
            carry = None
        elif len(have) == 2:
            out.append(have[0] ^ have[1])
            carry = have[0] & have[1]
        else:
            half = a ^ b
            out.append(half ^ carry)
            carry = (a & b) | (half & carry)
    if carry is not None:
        out.append(carry)
    return out


def sum_all(numbers: list[list]) -> list:
    """Sum of bit-sliced numbers, in a tree, so that short numbers meet short ones."""
    while len(numbers) > 1:
        numbers = [add_slices(numbers[i], numbers[i + 1]) if i + 1 < len(numbers) else numbers[i] for i in range(0, len(numbers), 2)]
    return numbers[0] if numbers else []


class BitSlicedIndex:
    """Slices of a block's attributes, without the `dropped` low bits."""

    def __init__(self, v: np.ndarray, dropped: int):
        self.v, self.dropped = v, dropped
        low = v.min(0)
        u = ((v - low) >> dropped).T
        self.bits = int(u.max()).bit_length()
        self.slices = np.stack([to_bitmap((u >> b) & 1 == 1) for b in range(self.bits)], 1) if self.bits else np.zeros((v.shape[1], 0, -(-len(v) // 64)), np.uint64)
        self.valid = to_bitmap(np.ones(len(v), bool))

    def sums(self, weights: np.ndarray) -> list:
        """Slices (query, word) of the coarse sums of |weight| * (attribute or its complement)."""
        size, negative = np.abs(weights), weights < 0
        flip = np.where(negative, ~np.uint64(0), np.uint64(0))
        total: list = []
        for b in range(int(size.max()).bit_length() if size.size else 0):
            on = (size >> b) & 1 == 1
            used = np.flatnonzero(on.any(0))
            if not len(used):
                continue
            mask = np.where(on, ~np.uint64(0), np.uint64(0))
            part = sum_all([[(self.slices[j, s][None] ^ flip[:, j, None]) & mask[:, j, None] for s in range(self.bits)] for j in used])
            total = add_slices(total, [None] * b + part)
        zero = np.zeros((len(weights), len(self.valid)), np.uint64)
        return [zero if s is None else s for s in total]

    def near_top(self, weights: np.ndarray, k: int) -> np.ndarray:
        """Bitmaps of the rows that may be among the k best, for each query."""
        sums = self.sums(weights)
        edge, most = kth_largest(sums, self.valid, k)
        slack = (((1 << self.dropped) - 1) * np.abs(weights).sum(1)) >> self.dropped
        if not slack.any():
            return most
        edge = np.maximum(0, edge - slack - 1)
        above, equal = np.zeros_like(most), np.repeat(self.valid[None], len(weights), 0)
        for i in reversed(range(len(sums))):  # sums >= edge
            bit = ((edge >> i) & 1 == 1)[:, None]
            above = np.where(bit, above, above | (equal & sums[i]))
            equal = np.where(bit, equal & sums[i], equal & ~sums[i])
        return above | equal


def kth_largest(sums: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th largest of bit-sliced sums (row, word), from the most significant slice downward, and bitmaps of all that reach it.

    Where there are fewer than k numbers, all are marked and the edge is 0.
    """
    rows = len(sums[0]) if sums else 0
    alive = np.repeat(valid[None], rows, 0)
    above, sure, edge = np.zeros_like(alive), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in reversed(range(len(sums))):
        ones = alive & sums[i]
        n = np.bitwise_count(ones).sum(1, dtype=np.int64)
        up = sure + n >= k
        edge += np.where(up, 1 << i, 0)
        above |= np.where(up[:, None], np.uint64(0), ones)
        alive = np.where(up[:, None], ones, alive ^ ones)
        sure += np.where(up, 0, n)
    return edge, above | alive


class WideIndex:
    """Slices of magnitudes at any weight; a bitmap is an integer with a bit a row."""

    def __init__(self, v: list[list[int]]):
        self.v, self.valid = v, (1 << len(v)) - 1
        self.slices = []
        for j in range(len(v[0]) if v else 0):
            signs: tuple[dict[int, int], dict[int, int]] = ({}, {})
            for row, values in enumerate(v):
                x, at, to = abs(values[j]), 0, signs[values[j] < 0]
                while x:
                    at = (x & -x).bit_length() - 1
                    to[at] = to.get(at, 0) | 1 << row
                    x &= x - 1
            self.slices.append(signs)

    @staticmethod
    def _added(columns: dict[int, list[int]]) -> dict[int, int]:
        """Carry-save sum of bitmaps by weight."""
        out: dict[int, int] = {}
        while columns:
            at = min(columns)
            here = columns.pop(at)
            while len(here) > 1:
                a, b, c = here.pop(), here.pop(), here.pop() if here else 0
                here.append(a ^ b ^ c)
                if carry := (a & b) | ((a ^ b) & c):
                    columns.setdefault(at + 1, []).append(carry)
            if here[0]:
                out[at] = here[0]
        return out

    def top(self, weights: list[int], k: int) -> list[int]:
        """Rows that are among the k best, ties included."""
        parts: tuple[dict, dict] = ({}, {})  # what adds and what is taken away
        for w, signs in zip(weights, self.slices, strict=True):
            x = abs(w)
            while x:
                up = (x & -x).bit_length() - 1
                x &= x - 1
                for sign in (0, 1):
                    for at, bits in signs[sign].items():
                        parts[sign ^ (w < 0)].setdefault(at + up, []).append(bits)
        plus, minus = self._added(parts[0]), self._added(parts[1])
        width = max([*plus, *minus], default=0) + 2
        total, carry = [], self.valid  # plus + complement of minus + 1
        for at in range(width):
            a, b = plus.get(at, 0), self.valid ^ minus.get(at, 0)
            total.append(a ^ b ^ carry)
            carry = (a & b) | ((a ^ b) & carry)
        total[-1] ^= self.valid  # the sign, so that larger numbers come first
        alive, above = self.valid, 0
        for s in reversed(total):
            ones = alive & s
            if above.bit_count() + ones.bit_count() >= k:
                alive = ones
            else:
                above, alive = above | ones, alive ^ ones
        found = above | alive
        return [i for i in range(len(self.v)) if found >> i & 1]


def quantised(x: np.ndarray, scale: float, rows) -> list[list[int]]:
    """floor(scale * x) of some rows as unbounded integers."""
    up = int(scale) if scale == int(scale) else None

    def one(c: float) -> int:
        if up is None:
            return int(np.floor(scale * c))
        n, d = c.as_integer_ratio()
        return n * up // d

    return [[one(c) for c in x[i].tolist()] for i in rows]


def search_block(ids, x, qids, q, k: int, scale: float, dropped: int, together: int):
    """Yields each query's best of a block: query id, rows, exact scores."""
    with np.errstate(over="ignore"):
        fx, fq = np.floor(scale * x), np.floor(scale * q)
    bound = float(1 << (62 - int(np.ceil(np.log2(x.shape[1])))) // 2)  # sums of products of components up to here fit a long
    wide, wide_q = np.abs(fx).max(1) > bound, np.abs(fq).max(1) > bound
    plain = np.flatnonzero(~wide)
    v, w = fx[plain].astype(np.int64), fq[~wide_q].astype(np.int64)
    found: dict[int, list] = {j: [] for j in range(len(q))}  # query: (rows, scores)
    if len(v) and len(w):
        index, js = BitSlicedIndex(v, dropped), np.flatnonzero(~wide_q)
        for at in range(0, len(w), together):
            some = w[at : at + together]
            own = [int((ids[plain] == qids[j]).sum()) for j in js[at : at + together]]
            maps = index.near_top(some, k + max(own))
            for i, j in enumerate(js[at : at + together].tolist()):
                rows = np.flatnonzero(np.unpackbits(maps[i].view(np.uint8), bitorder="little")[: len(plain)])
                scores = v[rows] @ some[i]
                best = best_of(ids[plain[rows]], scores, qids[j], k)
                found[j].append((plain[rows[best]], scores[best]))
    for rows, js in ((np.flatnonzero(wide), range(len(q))), (plain, np.flatnonzero(wide_q).tolist())):
        if not len(rows) or not len(js):
            continue
        index_w = WideIndex(quantised(x, scale, rows))
        for j in js:
            weights = quantised(q, scale, [j])[0]
            near = [i for i in index_w.top(weights, k + int((ids[rows] == qids[j]).sum())) if ids[rows[i]] != qids[j]]
            exact = [sum(a * b for a, b in zip(weights, index_w.v[i], strict=True)) for i in near]
            found[j].append((rows[near], np.array(exact, object)))
    for j in range(len(q)):
        rows, scores = found[j][0] if found[j] else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(found[j]) > 1 or scores.dtype == object:
            every = sorted(((-int(s), int(ids[r]), int(r)) for some, many in found[j] for r, s in zip(some, many, strict=True)))[:k]
            rows = np.array([r for *_, r in every], np.int64)
            scores = np.array([min(max(-s, _LONG[0]), _LONG[1]) for s, *_ in every], np.int64)
        yield qids[j], rows, scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, scale: float = 256.0, dropped: int = 3, together: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k largest inner products of floor(scale * component), exactly."""

    def search(ids, x, qids, q):
        return search_block(ids, x, qids, q, k, scale, dropped, together)

    return block_search(usable(vectors, zero=True), is_query, search, k, "long")
