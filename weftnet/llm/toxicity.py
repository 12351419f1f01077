"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are runs of letters, digits and non-ASCII bytes, lower-cased. A token's score is the log-odds
of toxic against other documents under an informative Dirichlet prior (`prior` times the sample's own counts),
for the token itself or, where that isn't known, for its longest known beginning of 4 to 6 bytes;
only log-odds that exceed `least` and `z` standard deviations count, and every token costs `drift`.
A linear scan finds all maximal scoring segments; a segment of score S in n tokens has the expected
number K n exp(-lambda S) of equals by chance (extreme-value statistics). K and lambda are the most
likely ones for the best segments of labelled texts that aren't toxic and gave no log-odds. Segments
below `alpha` are passages: of clean texts about that share has one. A logistic curve over the best
segment's log expectation and the sum of all that are below 0 gives the document's score.

Learning: from a bounded sample of labelled rows (`most_toxic` and `most_other` rows about, chosen by a
hash of the id against rates from exact counts). Two thirds of it, each text once, give the log-odds
(of every unit that passes), the rest K, lambda and the curve. Sample and model are bounded by that.

Defined cases: a null or empty text has no passage and the score of such texts; a null label is no
label; a document labelled twice counts as toxic if one label says so; without toxic or without other
labelled rows every score is the share of toxic rows (0 if there are none); repeated rows give equal
results; a null id is never a training row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftnet.llm.common import documents, map_batches, staged

STEMS = (6, 5, 4)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SCHEMA = "doc_id long, score double, passages array<struct<start:int,end:int,bits:double,p_value:double>>"


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def units(word: bytes) -> list[bytes]:
    """The token and its beginnings, from the most special."""
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) > k)]


def segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) in linear time.

    `at` and `score` are the tokens with positive scores; every token between them costs `drift`.
    Each kept segment points to the nearest earlier one that began at a lower running sum, so the
    search for such a segment skips what can't be it.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, pointer
    total, last = 0.0, -1
    for i, s in zip(at, score, strict=True):
        total -= drift * (i - last - 1)
        first, before = i, total
        total += s
        last = i
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((first, i, before, total, j))
                break
            first, before = kept[j][0], kept[j][2]
            del kept[j:]
            j = len(kept) - 1
    return [(a, b, r - x) for a, b, x, r, _ in kept]


class Model:
    def __init__(self, odds: dict[bytes, float], rate: float, drift: float = 0.5, lam: float = 1.0, k: float = 0.1, alpha: float = 0.05):
        self.odds, self.rate, self.drift, self.lam, self.k, self.alpha = odds, rate, drift, lam, k, alpha
        self.curve: np.ndarray | None = None
        self.memo: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def word(self, w: bytes) -> float:
        s = next((self.odds[u] for u in units(w) if u in self.odds), 0.0)
        if len(self.memo) >= 500_000:
            self.memo.clear()
        self.memo[w] = s
        return s

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens and all maximal segments (first token, last token, score)."""
        words = tokens(text)
        get, word = self.memo.get, self.word
        scores = [word(w) if (s := get(w)) is None else s for w in words]
        at = [i for i, s in enumerate(scores) if s > 0]
        return len(words), segments(at, [scores[i] for i in at], self.drift)

    def passages(self, text: bytes) -> tuple[list[tuple[int, int, float, float]], float, float]:
        """Significant segments (first token, token after the last, bits, p), the log expectation of the best one, and how far all together are below 0."""
        return self.judged(*self.scan(text))

    def judged(self, n: int, segs: list[tuple[int, int, float]]) -> tuple[list[tuple[int, int, float, float]], float, float]:
        """As passages, of segments found before."""
        base = math.log(self.k * max(1, n))
        found, best, total = [], math.inf if segs else base, 0.0
        for a, b, s in segs:
            e = base - self.lam * s
            best, total = min(best, e), total + max(0.0, -e)
            p = -math.expm1(-math.exp(min(e, 50.0)))
            if p <= self.alpha:
                found.append((a, b + 1, self.lam * s / math.log(2), p))
        return found, best, total

    def features(self, best: float, total: float) -> tuple[float, float, float]:
        return 1.0, -max(-30.0, min(12.0, best)) / 10, math.log1p(total)

    def score(self, best: float, total: float) -> float:
        if self.curve is None:
            return self.rate
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, float(np.dot(self.curve, self.features(best, total)))))))


def extreme_value(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """K and lambda that make the best scores of texts of n tokens most likely; 0 stands for no segment.

    The best score is below s with probability exp(-K n exp(-lambda s)). For a lambda the most likely K is
    known, and the likelihood's slope in lambda changes its sign once.
    """
    n, has = np.maximum(n, 1).astype(float), best > 0
    m, s = int(has.sum()), best[has]
    if m < 2 or s.max() - s.min() < 1e-9:
        return (m + 0.5) / (n.sum() + 1.0), 1.0

    def slope(lam: float) -> tuple[float, float]:
        e = n[has] * np.exp(-lam * s)
        k = m / (e.sum() + n[~has].sum())
        return m / lam - s.sum() + k * (e * s).sum(), k

    low, high = 1e-4, 64.0
    for _ in range(80):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid)[0] > 0 else (low, mid)
    return slope(low)[1], low


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    c = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-2 * c
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(len(c))
        step = np.linalg.solve(h, g)
        c = c - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return c


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, *, most_toxic: int = 20_000, most_other: int = 40_000, z: float = 2.0, prior: float = 0.02, least: float = 1.5, drift: float = 0.5, alpha: float = 0.05) -> Model:
    """Learns from labelled rows whose id `may_learn` marks."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    n1, n0 = count.get(1, 0), count.get(0, 0)
    model = Model({}, n1 / max(1, n0 + n1), drift, alpha=alpha)
    if not n1 or not n0:
        return model
    share = {1: min(1.0, most_toxic / n1), 0: min(1.0, most_other / n0)}
    spot = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30))
    chosen = marked.filter(spot < F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30))))
    sample = documents(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text", (F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(3)) == 0).alias("for_curve"))
    sample = staged(sample, "toxic_sample")

    def count_units(batch: pa.RecordBatch) -> dict:
        toxic, other = Counter(), Counter()
        for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            into = toxic if t else other
            into.update({u for w in set(tokens(text.encode())) for u in units(w)})
        names = list(toxic.keys() | other.keys())
        return {"unit": pa.array(names, pa.binary()), "pos": pa.array([toxic[u] for u in names], pa.int64()), "neg": pa.array([other[u] for u in names], pa.int64())}

    learn = sample.filter(~F.col("for_curve")).select("toxic", "text").dropDuplicates()
    table = staged(map_batches(learn, count_units, "unit binary, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic_units")
    total = table.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    if not total["pos"] or not total["neg"]:
        return model
    p, n = float(total["pos"]), float(total["neg"])
    a = F.lit(prior) * (F.col("pos") + F.col("neg"))
    logit = lambda y, size: F.log((y + a) / (size + prior * (p + n) - y - a))
    scored = table.filter("pos >= 3").select("unit", (logit(F.col("pos"), p) - logit(F.col("neg"), n)).alias("odds"), F.sqrt(1 / (F.col("pos") + a) + 1 / (F.col("neg") + a)).alias("sd"))
    top = scored.filter((F.col("odds") > z * F.col("sd")) & (F.col("odds") > least)).select("unit", "odds").collect()
    model.odds = {bytes(r["unit"]): min(8.0, r["odds"]) - drift for r in top}

    def measure(batch: pa.RecordBatch) -> dict:
        found = [model.scan(text.encode()) for text in batch.column(1).to_pylist()]
        return {"toxic": batch.column(0), "n": pa.array([n for n, _ in found], pa.int64()), "scores": pa.array([[s for *_, s in segs] for _, segs in found], pa.list_(pa.float64()))}

    seen = map_batches(sample.filter("for_curve").select("toxic", "text"), measure, "toxic int, n long, scores array<double>").toPandas()
    y, n, scores = (seen["toxic"] > 0).to_numpy(float), seen["n"].to_numpy(float), [np.asarray(x, float) for x in seen["scores"]]
    best = np.array([x.max(initial=0.0) for x in scores])
    order = np.lexsort((best, n, y))  # sums in one order, however rows came
    y, n, best, scores = y[order], n[order], best[order], [scores[i] for i in order]
    if (y == 0).any():
        model.k, model.lam = extreme_value(n[y == 0], best[y == 0])
    if 0 < y.sum() < len(y):
        x = np.array([model.features(*model.judged(int(k), [(0, 0, s) for s in some.tolist()])[1:]) for k, some in zip(n, scores, strict=True)])
        model.curve = fit_curve(x, y, np.where(y > 0, 1 / share[1], 1 / share[0]))
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and passages (tokens from start to before end) of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        score, spans = [], []
        for text in batch.column(1).to_pylist():
            found, *rest = model.passages(text.encode())
            score.append(model.score(*rest))
            spans.append([{"start": a, "end": b, "bits": s, "p_value": p} for a, b, s, p in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64()), ("p_value", pa.float64())]))
        return {"doc_id": batch.column(0), "score": pa.array(score, pa.float64()), "passages": pa.array(spans, kind)}

    return map_batches(documents(docs), run, SCHEMA, 8 << 20)
