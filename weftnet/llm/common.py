"""Helpers shared by the training-data operators: staging in the shared folder and packed Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a word: everything but blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`); a folder of our own only where it is unset (local tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: executors would write to folders of their own")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="weftnet-")
        atexit.register(_remove, spark, _own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_scratch: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of the innermost `scratch`, or when the driver ends."""
    path = f"{shared_dir(spark)}/weftnet-{uuid.uuid4().hex}/{name}"
    if _scratch:
        _scratch[-1].append(path)
    else:
        atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes what a path of `fresh_path` holds."""
    _remove(spark, path.rpartition("/")[0])


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are removed at its end: results must be written before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            discard(spark, path)


#: Bytes of a row group of a staged table.
ROW_GROUP_BYTES = 4 << 20


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives lost executors.

    Row groups are small: a task holds one while it writes, and as many rows of one while it reads, and packed rows are large.
    """
    path = fresh_path(df.sparkSession, name)
    written(df, path, ROW_GROUP_BYTES)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Makes Spark remove the shuffle files of a statement at its end; else they stay until the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, row_group_bytes: int | None = None) -> None:
    """Writes `df`; its shuffle files go when it is written."""
    conf, out = df.sparkSession.conf, df.write.option("parquet.block.size", row_group_bytes) if row_group_bytes else df.write
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        out.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) only, so that no extra column can clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_crc(column: str = "doc_id"):
    """crc32 of the id written as text (null: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def input_bytes(df: DataFrame) -> int:
    """Bytes of a DataFrame with a column text: the size of its files, or of the texts where Spark doesn't know it."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n >= 1 << 50:
        n = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, n)


#: Words of 64 bits in a membership filter: its table is never larger than this.
FILTER_WORDS = 1 << 18


def maybe_among(df: DataFrame, key: str, ids: DataFrame, flag: str, seed: int = 3) -> DataFrame:
    """Adds `flag`: false only where `key` surely isn't among the column `id` of `ids` (null counts as false).

    A bitmap of hashed ids, of a fixed size, is broadcast as a table of its words. Rows that surely have
    no partner then need no shuffle to a join; the others still meet the exact join. With very many ids
    the bitmap fills and sets fewer rows apart, but nothing else changes. Filters of other seeds err on other rows.
    """
    spot = lambda c: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(64 * FILTER_WORDS))
    bit = lambda c: F.pmod(spot(c), F.lit(64)).cast("int")
    one = F.lit(1).cast("long")
    words = ids.select(F.call_function("div", spot(F.col("id")), F.lit(64)).alias("filter_word"), F.call_function("shiftleft", one, bit(F.col("id"))).alias("filter_bits"))
    words = words.groupBy("filter_word").agg(F.bit_or("filter_bits").alias("filter_bits"))
    out = df.join(F.broadcast(words), F.call_function("div", spot(F.col(key)), F.lit(64)) == F.col("filter_word"), "left")
    hit = F.col("filter_bits").bitwiseAND(F.call_function("shiftleft", one, bit(F.col(key)))) != 0
    return out.withColumn(flag, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("filter_word", "filter_bits")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, so that their Python can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="weftnet-code-"), "weftnet_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


#: Rows and bytes of an Arrow batch: texts are long, and a batch is held by the executor and by its Python worker.
ARROW_ROWS, ARROW_BYTES = 250, 1 << 20


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """`df.mapInArrow` with this package at hand on the executors.

    The session's batches become smaller, if they are larger than ARROW_ROWS and ARROW_BYTES: Spark reads these
    settings when a plan runs, which is after this function, so they can't be set back here.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn, schema, limit: int = 16 << 20) -> DataFrame:
    """`df.mapInArrow` in which `fn(batch)` sees record batches of about `limit` bytes of text at most and returns dicts of columns (or None)."""

    def run(batches):
        for batch in batches:
            for part in split_batch(batch, limit):
                out = fn(part)
                for cols in out if isinstance(out, list) else [out]:
                    if cols is not None:
                        yield cols if isinstance(cols, pa.RecordBatch) else pa.RecordBatch.from_pydict(cols)
        give_back()

    return map_arrow(df, run, schema)


def map_gathered(df: DataFrame, fn, schema, limit: int) -> DataFrame:
    """As map_batches, but consecutive small batches of a task are put together up to `limit` bytes."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in split_batch(batch, limit):
                if held and size + part.nbytes > limit:
                    out = fn(joined(held))
                    held, size = [], 0
                    if out is not None:
                        yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
                held.append(part)
                size += part.nbytes
        out = fn(joined(held)) if held else None
        if out is not None:
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
        del held, out
        give_back()

    return map_arrow(df, run, schema)


def give_back() -> None:
    """Returns what this Python worker has freed to the system: workers are used again, and else keep the most a task ever needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def split_batch(batch: pa.RecordBatch, limit: int):
    """Slices of a batch of about `limit` bytes each, whole rows."""
    if batch.num_rows == 0:
        return
    if batch.nbytes <= limit:
        yield batch
        return
    step = max(1, int(batch.num_rows * limit / batch.nbytes))
    at = 0
    while at < batch.num_rows:
        yield batch.slice(at, step)
        at += step


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls and the offsets of its rows, without a copy where Arrow allows it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of every row, in order, and the number of words of each row.

    Words are runs of bytes other than blank and 9 to 13, never across rows; A-Z count as a-z.
    Two multipliers and the length go into a hash, so equal hashes of different words are left to chance.
    """
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    space = _IS_SPACE[raw]
    low = _LOWER[raw]
    begins = ~space
    first = begins.copy()
    first[1:] &= space[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(raw)]
    first[cuts] = begins[cuts]
    last = begins.copy()
    last[:-1] &= space[1:]
    ends_at = cuts[cuts > 0] - 1
    last[ends_at] = begins[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # in pieces of about _CHUNK bytes, whole words, which keeps arrays (and tables of powers) small
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _CHUNK, side="right")))
        s, e, part = starts[i:j] - at, ends[i:j] - at, low[at : int(ends[j - 1])]
        size = len(part)
        summed = np.zeros(size + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(size), out=summed[1:])
        one = (summed[e] - summed[s]) * powers(size, _INVERSE)[s]
        np.cumsum(_BYTE_MIX[part] * powers(size, _SECOND), out=summed[1:])
        two = (summed[e] - summed[s]) * powers(size, _SECOND_INVERSE)[s]
        out[i:j] = mix64(one ^ (mix64(two) + (e - s).astype(np.uint64)))
        i = j
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return out, counts


#: Bytes whose words are hashed at once.
_CHUNK = 1 << 17
_SECOND = 0xD1342543DE82EF95
_SECOND_INVERSE = pow(_SECOND, -1, 1 << 64)
_BYTE_MIX = mix64(np.arange(1, 257, dtype=np.uint64))
