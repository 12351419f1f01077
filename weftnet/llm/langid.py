"""Language identification by a byte convolutional network trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length (the last one ends with the text; only a
text shorter than a window is padded). Bytes are embedded, filters of several widths run over each
window, each filter keeps its largest response, and a softmax layer gives the languages. A text's
score is the softmax of the mean log-probability of all its windows, so whole texts count.

At inference the embedding is folded into the filters: each filter position becomes a table from
byte to responses, and a batch of windows costs one table look-up per position and width.

The model is fitted on a bounded sample of the rows allowed for training: about `most_texts` texts in
all, `per_language` of a language at most, every language its share and at least one text, chosen by a
hash of the id against rates from exact counts; `windows_each` windows a text. A tenth of it is kept to
tell when to stop. So the sample's size is fixed but for very many languages; each is learned.

Defined cases: a text that is null or without a letter is `und` with score 0; without training rows
every text is `und`; a null id is kept; repeated rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import map_batches, text_bytes

UND = "und"


class ByteCNN:
    def __init__(self, labels: list[str], window: int = 256, widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, dim: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, self.window, self.widths, self.filters, self.dim = labels, window, widths, filters, dim
        self.p = {"emb": r.normal(0, 0.5, (256, dim)).astype(np.float32)}
        for w in widths:
            self.p[f"w{w}"] = r.normal(0, 1 / np.sqrt(w * dim), (w * dim, filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)
        self.p["out"] = r.normal(0, 0.1, (filters * len(widths), len(labels))).astype(np.float32)
        self.p["bias"] = np.zeros(len(labels), np.float32)
        self.tables: dict | None = None

    def _patches(self, x: np.ndarray, w: int) -> np.ndarray:
        e = self.p["emb"][x]
        return np.concatenate([e[:, k : x.shape[1] - w + 1 + k] for k in range(w)], axis=2)

    def gradients(self, xb: np.ndarray, yb: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean cross-entropy, and its value; that of a maximum goes to the position that gave it."""
        pooled, where, cols = [], [], []
        for w in self.widths:
            c = self._patches(xb, w)
            z = c @ self.p[f"w{w}"]
            a = z.argmax(axis=1)
            where.append(a)
            cols.append(c)
            pooled.append(np.take_along_axis(z, a[:, None], 1)[:, 0] + self.p[f"b{w}"])
        h = np.concatenate(pooled, 1)
        act = np.maximum(h, 0)
        logits = act @ self.p["out"] + self.p["bias"]
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(1, keepdims=True)
        loss = float(-np.log(np.maximum(q[np.arange(len(yb)), yb], 1e-30)).mean())
        q[np.arange(len(yb)), yb] -= 1
        q /= len(yb)
        g = {"out": act.T @ q, "bias": q.sum(0), "emb": np.zeros_like(self.p["emb"])}
        back = (q @ self.p["out"].T) * (h > 0)
        for n, w in enumerate(self.widths):
            gw = back[:, n * self.filters : (n + 1) * self.filters]
            at_max = np.take_along_axis(cols[n], where[n][:, :, None], 1)  # row, filter, inputs
            g[f"w{w}"] = np.einsum("nf,nfk->kf", gw, at_max)
            g[f"b{w}"] = gw.sum(0)
            down = gw[:, :, None] * self.p[f"w{w}"].T[None]
            for k in range(w):
                read = np.take_along_axis(xb, where[n] + k, 1)
                np.add.at(g["emb"], read.ravel(), down[:, :, k * self.dim : (k + 1) * self.dim].reshape(-1, self.dim))
        return g, loss

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 11, check: tuple[np.ndarray, np.ndarray] | None = None) -> ByteCNN:
        """Adam on the cross-entropy, until the loss on `check` falls by less than a twentieth (from the second epoch on)."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, before = 0, np.inf
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                g, _ = self.gradients(x[i], y[i])
                step += 1
                lr = rate * (1 - epoch / (epochs + 1))
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v2[k] += 0.001 * (g[k] ** 2 - v2[k])
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            self.tables = None
            if check is not None and len(check[0]):
                loss = float(-self.log_probs(check[0])[np.arange(len(check[1])), check[1]].mean())
                if epoch and loss > 0.95 * before:
                    break
                before = min(before, loss)
        self.tables = None
        return self

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows (rows of bytes)."""
        if self.tables is None:
            emb = self.p["emb"]
            self.tables = {(w, k): np.ascontiguousarray(emb @ self.p[f"w{w}"][k * self.dim : (k + 1) * self.dim]) for w in self.widths for k in range(w)}
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), 128):
            xb, pooled = x[at : at + 128], []
            for w in self.widths:
                n = xb.shape[1] - w + 1
                z = self.tables[w, 0][xb[:, :n]]
                for k in range(1, w):
                    z += self.tables[w, k][xb[:, k : k + n]]
                pooled.append(z.max(1) + self.p[f"b{w}"])
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["out"] + self.p["bias"]
            logits -= logits.max(1, keepdims=True)
            out[at : at + 128] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out


def windows(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each row (at least one) and the row of each window."""
    lengths = np.diff(offsets)
    per = np.maximum(1, -(-lengths // size))
    row = np.repeat(np.arange(len(lengths)), per)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.minimum(k * size, np.maximum(0, lengths[row] - size))
    x = np.zeros((len(row), size), np.uint8)
    whole = lengths[row] >= size
    if whole.any():
        x[whole] = np.lib.stride_tricks.sliding_window_view(raw, size)[offsets[:-1][row[whole]] + begin[whole]]
    for i in np.flatnonzero(~whole):
        part = raw[offsets[row[i]] : offsets[row[i] + 1]]
        x[i, : len(part)] = part
    return x, row


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def shares(counts: dict[str, int], most: int, each: int) -> dict[str, float]:
    """Texts to take of each language: equal shares of `most`, up to `each` and to what there is; what is left goes to the others."""
    out, left = {}, float(most)
    for k, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, each, max(1.0, left / (len(counts) - k)))
        left -= out[name]
    return out


def train(docs: DataFrame, may_learn: Column, *, most_texts: int = 6000, per_language: int = 1500, windows_each: int = 4, window: int = 256) -> ByteCNN | None:
    """Fits the network on a bounded sample of rows of doc_id, text and lang that `may_learn` marks."""
    rows = docs.filter(may_learn & F.col("lang").isNotNull() & has_letter(F.col("text")))
    spot = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 32))
    found = rows.groupBy("lang").agg(F.count("*").alias("count"), F.min(spot).alias("low")).collect()  # a row a language
    if not found:
        return None
    labels = sorted(r["lang"] for r in found)
    share = shares({r["lang"]: r["count"] for r in found}, most_texts, per_language)
    limits = [(r["lang"], max(r["low"] + 1, min(1 << 32, int((1 << 32) * share[r["lang"]] / r["count"])))) for r in found]
    rates = docs.sparkSession.createDataFrame(limits, "lang string, below long")
    span = F.greatest(F.length("text") - window, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(windows_each - 1)), lambda i: F.substr("text", (F.floor(span * F.pmod(F.xxhash64(i, F.col("doc_id")), F.lit(1024)) / 1023) + 1).cast("int"), F.when(i == windows_each - 1, F.lit(48)).otherwise(F.lit(window))))
    sample = rows.join(F.broadcast(rates), "lang").filter(spot < F.col("below")).select("lang", F.explode(F.array_distinct(pieces)).alias("piece")).toPandas()
    number = {name: i for i, name in enumerate(labels)}
    order = np.argsort((sample["lang"] + "\0" + sample["piece"]).to_numpy(dtype=object), kind="stable")
    x = np.zeros((len(sample), window), np.uint8)
    for i, piece in enumerate(sample["piece"].to_numpy()[order]):
        b = piece.encode()[:window]
        x[i, : len(b)] = np.frombuffer(b, np.uint8)
    y = sample["lang"].map(number).to_numpy()[order]
    apart = np.random.default_rng(5).random(len(x)) < (0.1 if len(x) >= 1000 else 0)
    epochs = int(np.clip(60_000 // max(1, len(x)), 3, 40))
    return ByteCNN(labels, window).fit(x[~apart], y[~apart], epochs=epochs, check=(x[apart], y[apart]))


def identify(docs: DataFrame, model: ByteCNN | None, keep: list[str]) -> DataFrame:
    """lang_pred and score of every row's text, beside the columns `keep` as the struct `row`."""
    row = F.struct(*[F.col(c) for c in keep]).alias("row")
    rows = docs.select(row, has_letter(F.col("text")).alias("has"), *([] if "text" in keep else ["text"]))  # no text travels twice
    at = keep.index("text") if "text" in keep else None
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batch: pa.RecordBatch) -> dict:
        text = batch.column(2) if at is None else batch.column(0).flatten()[at]
        raw, offsets = text_bytes(pc.if_else(batch.column(1), text, ""))
        n = batch.num_rows
        best, score = np.full(n, -1), np.zeros(n)
        empty = np.diff(offsets) == 0
        if model is not None and not empty.all():
            total = np.zeros((n, len(model.labels)))
            keep = np.flatnonzero(~empty)
            x, row = windows(raw, np.concatenate([offsets[:1], offsets[1:][~empty]]), model.window)
            lp = model.log_probs(x)
            first = np.searchsorted(row, np.arange(len(keep)))
            total[keep] = np.add.reduceat(lp, first, axis=0) / np.diff(np.append(first, len(row)))[:, None]
            q = np.exp(total - total.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            best[keep], score[keep] = q.argmax(1)[keep], q.max(1)[keep]
        names = np.array([*(model.labels if model else []), UND], dtype=object)
        return {"row": batch.column(0), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score)}

    return map_batches(rows, predict, schema, 2 << 20)


def identify_languages(docs: DataFrame, held_out: Column, **sample) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all: doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs, ~held_out, **sample)
    found = identify(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3, **sample) -> DataFrame:
    """The rows whose language is found with a score of `least` or more; a null lang becomes the found one."""
    model = train(docs.select("doc_id", "text", "lang"), F.lit(True), **sample)
    found = identify(docs, model, docs.columns).filter((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return found.select(*[(F.coalesce(F.col("row.lang"), F.col("lang_pred")) if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])
