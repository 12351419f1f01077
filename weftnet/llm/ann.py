"""Approximate nearest neighbours by collision counting over query-centred windows.

Every vector of a block is projected on fixed orthonormal directions; each direction keeps its
projections in a sorted array, cut into `cells` base buckets. A query looks at windows around its own
projections: a vector that lies in a direction's window collides there. Virtual rehashing changes a
window's width without new hashes: it merges neighbouring base buckets. A window is the difference of
two prefixes of the sorted array, kept as bitmaps, and collisions of a whole block are counted by
carry-save additions of bitmaps, many queries at once. Windows widen until `verify` of the vectors (of a
block `least` times k at least) reach the collision threshold, and narrow where far too many do; the vectors with the most
collisions are verified by their inner product in double precision on the original vectors.

Largest inner products become smallest distances by one more component. As this says little where
norms differ much, a block is cut into bands whose norms differ by the factor `band` at most. Bands
are searched from the longest norms downward; a band is left out for queries whose k-th best product
is larger than any product in it can be (Cauchy-Schwarz), which is exact. Short bands are verified whole.

Blocks are bounded and together hold every vector, so every vector is indexed; directions depend on
nothing but the dimension. Equal vectors of a block are one entry of its index.

Defined cases: vectors that are null, zero or hold a null or non-finite component take no part; norms
and products are formed without overflow, and a product beyond the doubles is infinite; ties go to
smaller ids; rows that share the query's id are its own; repeated rows are candidates each; vectors
meet queries of their length only; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from weftnet.llm.bitslice import add_slices, kth_largest, to_bitmap
from weftnet.llm.vectors import best_of, block_search, usable

#: Bands of fewer entries are verified whole: an index of them would cost more.
SHORT = 256


def directions(dim: int, count: int, seed: int = 20) -> np.ndarray:
    """`count` directions, orthonormal in groups of `dim`."""
    r = np.random.default_rng(seed + dim)
    groups = [np.linalg.qr(r.normal(size=(dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(groups)[:count]


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and log2 of the norms, without overflow or underflow."""
    most = np.abs(x).max(1)
    scaled = np.ldexp(x, -np.frexp(most)[1][:, None])
    norm = np.sqrt((scaled * scaled).sum(1))
    return scaled / norm[:, None], np.log2(norm) + np.frexp(most)[1]


def products(x: np.ndarray, q: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products in double precision; scaled by powers of two where a partial sum might overflow."""
    if safe:
        return (x * q).sum(1)
    a, b = np.frexp(np.abs(x).max(1))[1], int(np.frexp(np.abs(q).max())[1])
    with np.errstate(over="ignore"):
        return np.ldexp((np.ldexp(x, -a[:, None]) * np.ldexp(q, -b)).sum(1), a + b)


class Counter:
    """Bit-sliced sum of bitmaps by carry-save steps: three pending slices of a weight become one and a carry."""

    def __init__(self):
        self.pending: list[list[np.ndarray]] = []

    def add(self, slice_: np.ndarray, level: int = 0) -> None:
        if level == len(self.pending):
            self.pending.append([])
        p = self.pending[level]
        p.append(slice_)
        if len(p) == 3:
            a, b, c = p
            half = a ^ b
            self.pending[level] = [half ^ c]
            half &= c
            a = a & b
            a |= half
            self.add(a, level + 1)

    def total(self) -> list[np.ndarray]:
        out: list = []
        for level, p in enumerate(self.pending):
            for s in p:
                out = add_slices(out, [None] * level + [s])
        return out


class Band:
    """Sorted projections of vectors of similar norms, as prefix bitmaps."""

    def __init__(self, unit: np.ndarray, log_norm: np.ndarray, count: int, cells: int):
        n, dim = unit.shape
        self.n, self.dim, self.top, self.cells = n, dim, float(log_norm.max()), min(cells, n)
        ratio = np.exp2(log_norm - self.top)
        self.a = directions(dim + 1, count)
        p = (np.concatenate([unit * ratio[:, None], np.sqrt(np.maximum(0, 1 - ratio * ratio))[:, None]], 1) @ self.a.T).T.astype(np.float32)
        order = np.argsort(p, axis=1)
        line = np.take_along_axis(p, order, 1)
        cut = (np.arange(self.cells + 1) * n) // self.cells
        self.edges = line[:, np.minimum(cut, n - 1)]
        rank = np.empty((count, n), np.int32)
        np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[None], 1)
        self.prefix = np.stack([to_bitmap(rank[j][None] < cut[:, None]) for j in range(count)])
        self.valid = self.prefix[0, -1]

    def candidates(self, unit_q: np.ndarray, need: int, enough: int, first: float, growth: float) -> np.ndarray:
        """Bitmaps of the vectors to verify, a row a query."""
        count = len(self.a)
        pq = (unit_q @ self.a[:, : self.dim].T).astype(np.float32)
        width = np.full(len(pq), first * np.sqrt(2 / (self.dim + 1)))
        few, many = np.zeros(len(pq)), np.full(len(pq), np.inf)
        out = np.zeros((len(pq), len(self.valid)), np.uint64)
        left = np.arange(len(pq))
        while len(left):
            w = width[left, None].astype(np.float32)
            counter, whole = Counter(), np.ones(len(left), bool)
            for j in range(count):
                low = np.maximum(np.searchsorted(self.edges[j], pq[left, j] - w[:, 0], side="right") - 1, 0)
                high = np.searchsorted(self.edges[j, :-1], pq[left, j] + w[:, 0], side="right")
                whole &= (low == 0) & (high == self.cells)
                counter.add(self.prefix[j, high] ^ self.prefix[j, low])
            sums = counter.total()
            edge, above = kth_largest(sums, self.valid, enough)
            n = np.bitwise_count(above).sum(1, dtype=np.int64)
            too_few = (edge < need) & ~whole
            too_many = (edge >= need) & (n > 4 * enough) & (width[left] > 1e-6)
            few[left[too_few]], many[left[too_many]] = width[left[too_few]], width[left[too_many]]
            done = ~(too_few | too_many) | (too_few & (many[left] < 1.02 * width[left])) | (too_many & (width[left] < 1.02 * few[left]))
            out[left[done]] = above[done]
            left = left[~done]
            width[left] = np.where(np.isinf(many[left]), width[left] * growth, np.where(few[left] == 0, many[left] / 2, np.sqrt(np.maximum(few[left], 1e-12) * np.minimum(many[left], 1e300))))
        return out


def search_block(ids, x, qids, q, k: int, count: int, threshold: float, verify: float, first: float, growth: float, cells: int, band: float, least: int, together: int = 128, seen: list | None = None):
    """Yields each query's best of a block: query id, rows, scores. `seen` collects the numbers of verified rows."""
    order = np.argsort(ids, kind="stable")
    _, firsts, entry = np.unique(np.ascontiguousarray(x[order] + 0.0).view(f"V{8 * x.shape[1]}")[:, 0], return_index=True, return_inverse=True)
    members = order[np.argsort(entry, kind="stable")]  # rows of each entry, by id
    sizes = np.bincount(entry)
    begin = np.cumsum(sizes) - sizes
    v = x[order[firsts]]
    unit, norm = units(v)
    unit_q, norm_q = units(q)
    safe = bool(norm.max() + norm_q.max() < 1000 and norm.min() + norm_q.min() > -900)
    by_norm, bands, at = np.argsort(-norm, kind="stable"), [], 0
    while at < len(v):
        end = at + int(np.searchsorted(-norm[by_norm[at:]], -(norm[by_norm[at]] - np.log2(band)), side="right"))
        rows = by_norm[at:end]
        bands.append((rows, float(norm[rows[0]]), Band(unit[rows], norm[rows], count, cells) if len(rows) >= SHORT else None))
        at = end
    need = int(np.ceil(threshold * count))
    for some in range(0, len(q), together):
        js = np.arange(some, min(some + together, len(q)))
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {int(j): (np.zeros(0, np.int64), np.zeros(0)) for j in js}
        for rows, top, index in bands:
            go = [j for j in js.tolist() if len(best[j][1]) < k or not best[j][1][-1] > 0 or np.log2(best[j][1][-1]) <= top + norm_q[j] + 1e-6]
            if not go:
                continue
            maps = index.candidates(unit_q[go], need, max(2 * k, int(np.ceil(max(verify, least * k / len(v)) * len(rows)))), first, growth) if index else None
            for i, j in enumerate(go):
                found = rows if maps is None else rows[np.flatnonzero(np.unpackbits(maps[i].view(np.uint8), bitorder="little")[: len(rows)])]
                if seen is not None:
                    seen.append(len(found))
                scores = products(v[found], q[j], safe)
                if len(v) < len(x):
                    n = np.minimum(sizes[found], k + 1)
                    place = np.repeat(begin[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found, scores = members[place], np.repeat(scores, n)
                else:
                    found = order[firsts[found]]
                found, scores = np.concatenate([best[j][0], found]), np.concatenate([best[j][1], scores])
                top_rows = best_of(ids[found], scores, qids[j], k)
                best[j] = found[top_rows], scores[top_rows]
        for j in js.tolist():
            yield qids[j], *best[j]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, count: int = 256, threshold: float = 0.7, verify: float = 0.015, first: float = 0.95, growth: float = 1.25, cells: int = 128, band: float = 1.2, least: int = 12) -> DataFrame:
    """query_id, rank, vec_id and score (inner product) of each query's k nearest found."""

    def search(ids, x, qids, q):
        return search_block(ids, x, qids, q, k, count, threshold, verify, first, growth, cells, band, least)

    return block_search(usable(vectors, zero=False), is_query, search, k, "double")
