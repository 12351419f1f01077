"""Cost-balanced packing of documents into token sequences.

A document is its token ids and a closing id. Its whole multiples of the capacity fill sequences of
their own; what remains is assigned, longest first, to the lowest-cost sequence that still has room
for it, the cost of a piece of n tokens being linear * n + quadratic * n**2 (attention within a
piece). There are as many sequences as the tokens of a pool (`pool_bytes` of text) need; a piece that
has room nowhere opens another one, so what fits in a sequence isn't cut. Sequences with more than
`spare` of their capacity free stay open for the next pool of the task. Only the last pool cuts: the
roomiest sequence takes what it can, and the rest is assigned again, in sequences of full capacity and,
for what is left over, of powers of two, which need no padding.

Tokenizing and packing happen in one pass over the batches of a partition, without a shuffle; memory
is bounded by two pools. A sequence id is the partition's number and a counter, so a rerun of a task
gives the same ids. Token ids come from the vocabulary's rank file, whose merges and special token
give the same ids as its JSON form (held to it by tests) in a sixth of the time; a text that its
pattern can't split is given to the JSON form.

Defined cases: a null or empty text is the closing id alone; a null id stays null; a repeated row is
a document of its own; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.llm.common import documents, map_arrow, split_batch

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_loaded: dict = {}


class Tokens:
    """Ids of a byte-level vocabulary; `rank_file` is the fast form, `json_file` the fallback."""

    def __init__(self, rank_file: str, json_file: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.json_file = json_file

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        except BaseException as e:  # the pattern gives up on some very long runs, with a panic of its library
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
            from tokenizers import Tokenizer

            if "json" not in _loaded:
                _loaded["json"] = Tokenizer.from_file(self.json_file)
            return np.asarray(_loaded["json"].encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def load_tokens(rank_file: str, json_file: str, pattern: str, special: tuple = (("<|endoftext|>", 50256),)) -> Tokens:
    key = (rank_file, json_file)
    if key not in _loaded:
        _loaded[key] = Tokens(rank_file, json_file, pattern, dict(special))
    return _loaded[key]


Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


class Packer:
    """Assigns documents to sequences, pool by pool; sequences with room are carried on."""

    def __init__(self, capacity: int, linear: float, quadratic: float, spare: float):
        self.capacity, self.linear, self.quadratic, self.spare = capacity, linear, quadratic, spare
        self.made = 0
        self.number, self.room, self.used, self.cost = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float))

    def _open(self, sizes: list[int]) -> None:
        n = len(sizes)
        self.number = np.concatenate([self.number, self.made + np.arange(n)])
        self.room = np.concatenate([self.room, np.array(sizes, np.int64)])
        self.used, self.cost = np.concatenate([self.used, np.zeros(n, np.int64)]), np.concatenate([self.cost, np.zeros(n)])
        self.made += n

    def pack(self, lengths: np.ndarray, last: bool) -> list[Piece]:
        """Pieces of documents of so many tokens."""
        c, pieces, rest = self.capacity, [], []
        for d, n in enumerate(lengths.tolist()):
            full = n // c
            pieces += [(d, k * c, c, self.made + k, 0) for k in range(full)]
            self.made += full
            if n % c:
                rest.append((n % c, d, full * c))
        over = sum(r[0] for r in rest) - int(self.room.sum())
        if last and over > 0:
            tail = over % c
            self._open([c] * (over // c) + [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1])
        elif over > 0:
            self._open([c] * -(-over // c))
        rest.sort(key=lambda r: (-r[0], r[1]))
        for n, d, start in rest:
            while n:
                fits = self.room >= n
                if fits.any():
                    k = int(np.argmin(np.where(fits, self.cost, np.inf)))
                elif last:
                    k = int(np.argmax(self.room))
                else:
                    k = len(self.room)
                    self._open([c])
                take = min(n, int(self.room[k]))
                pieces.append((d, start, take, int(self.number[k]), int(self.used[k])))
                self.room[k] -= take
                self.used[k] += take
                self.cost[k] += self.linear * take + self.quadratic * take * take
                n, start = n - take, start + take
        keep = self.room > self.spare * c
        self.number, self.room, self.used, self.cost = (x[keep] for x in (self.number, self.room, self.used, self.cost))
        return pieces


def pools(batches, limit: int):
    """(ids, texts, whether it is the last) of about `limit` bytes of text."""
    keys, texts, size, ready = [], [], 0, None
    for batch in batches:
        for part in split_batch(batch, limit):
            if texts and size + part.nbytes > limit:
                if ready:
                    yield *ready, False
                ready, keys, texts, size = (keys, texts), [], [], 0
            keys += part.column(0).to_pylist()
            texts += part.column(1).to_pylist()
            size += part.nbytes
    if ready:
        yield *ready, not texts
    if texts:
        yield keys, texts, True


def pack_documents(docs: DataFrame, *, rank_file: str, json_file: str, pattern: str, capacity: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1.0 / 1024, spare: float = 0.01, pool_bytes: int = 4 << 20) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def run(batches):
        tokens = load_tokens(rank_file, json_file, pattern)
        base, packer = TaskContext.get().partitionId() << 36, Packer(capacity, linear, quadratic, spare)
        for keys, texts, last in pools(batches, pool_bytes):
            ids = [np.append(tokens.ids(t), np.uint32(end_id)) for t in texts]
            lengths = np.array([len(x) for x in ids], np.int64)
            pieces = packer.pack(lengths, last)
            for at in range(0, len(pieces), 4096):
                some = pieces[at : at + 4096]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([keys[d] for d, *_ in some], pa.int64()), "start": pa.array([p[1] for p in some], pa.int64()), "length": pa.array([p[2] for p in some], pa.int64()),
                    "ids": pa.array([ids[d][s : s + k].astype("<u4").tobytes() for d, s, k, _, _ in some], pa.binary()), "doc_tokens": pa.array([int(lengths[p[0]]) for p in some], pa.int64()),
                    "sequence_id": pa.array([base + p[3] for p in some], pa.int64()), "offset": pa.array([p[4] for p in some], pa.int64()),
                })

    return map_arrow(documents(docs), run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The columns of op4."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
