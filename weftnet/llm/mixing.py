"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every document has a size (words) and a 60-bit hash of its id. A source's target is its weight's
share of all sizes, at most `most` times the source, the excess reshared by weight. A target is met
by whole copies of the source and one partial copy: the documents whose hash lies below a threshold.
The threshold is found by nested histograms: sizes summed by source and top hash bits give the bucket
in which the budget ends; only that bucket is summed again by its next bits, down to a single hash
value. The document there gives the words that are left of the budget. Nothing is sorted by hash;
what is summed per source and level has at most 2**bits rows.

Defined cases: null and empty texts have size 0 and are taken 0 times a word; a null source is a
source of its own, last in code-point order; rows that share a hash (repeated rows, equal ids) share
what is left of the budget in proportion to their size, rounded down; a null id hashes as the empty
text; an empty table gives no row. Extra columns are ignored. Reruns agree, as nothing is random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftnet.llm.common import WORD, staged

#: The hash has 15 hexadecimal digits; each level of the histograms takes three of them.
DIGITS, LEVEL_DIGITS = 15, 3
#: More sources than this aren't broadcast; the thresholds then meet the documents in a salted join.
BROADCAST_SOURCES = 100_000
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """The document's 60-bit place on its source's line: the first digits of md5 of its id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Adds target to one row per source (source, source_size).

    With caps c = most * size and weights w, the shares that remain after resharing are
    min(c, level * w) where level is the largest of (all - caps before) / (weights from here on)
    along the sources in order of c / w.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    at = (F.row_number().over(named) - 1) % len(weights)
    t = totals.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1).alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    steep = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    t = t.select(
        "*", F.sum(F.col("source_size").cast("double")).over(every).alias("all"),
        F.coalesce(F.sum("cap").over(steep.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("w").over(steep.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    t = t.select("source", "source_size", "w", "cap", F.max((F.col("all") - F.col("before")) / F.col("rest")).over(every).alias("level"))
    return t.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _beside(docs: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """Joins the per-source table to documents, whose hot sources stay spread out."""
    if small:
        return docs.join(F.broadcast(table), docs["source"].eqNullSafe(table["key"])).drop("key")
    salted = table.withColumn("salt_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("salt_d", (F.col("place") % SALTS).cast("int"))
    return docs.join(salted, docs["source"].eqNullSafe(salted["key"]) & (docs["salt_d"] == salted["salt_t"])).drop("key", "salt_d", "salt_t")


def thresholds(base: DataFrame, weights: tuple[int, ...], most: float) -> tuple[DataFrame, bool]:
    """One row a source (key) with target, whole copies and where its partial copy ends; whether it may be broadcast.

    `base` has source, size and place of every document.
    """
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = source_targets(totals, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.round("target").cast("long")).otherwise(F.lit(0).cast("long"))
    copies = F.when(F.col("source_size") > 0, F.floor(ratio / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    table = staged(table.select("source", "source_size", "target", copies.alias("copies"), (ratio - copies * F.col("source_size")).alias("budget")), "targets")
    small = table.count() <= BROADCAST_SOURCES
    # cut: where the part of the place that is known so far ends the budget; left: what is left of it there.
    cuts = table.select(F.col("source").alias("key"), F.lit(0).cast("long").alias("cut"), F.col("budget").alias("left"))
    for level in range(1, DIGITS // LEVEL_DIGITS + 1):
        unit = 16 ** (DIGITS - level * LEVEL_DIGITS)
        upper = unit * 16**LEVEL_DIGITS
        inside = _beside(base.filter("size > 0"), cuts, small).filter(F.col("place") - F.col("place") % upper == F.col("cut"))
        sums = inside.groupBy("source", "left", (F.col("place") - F.col("place") % unit).alias("bucket")).agg(F.sum("size").alias("words"))
        line = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("before", F.sum("words").over(line) - F.col("words"))
        ends = sums.filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
        cuts = staged(ends.select(F.col("source").alias("key"), F.col("bucket").alias("cut"), (F.col("left") - F.col("before")).alias("left"), F.col("words").alias("here")), f"cuts{level}")
        if level * LEVEL_DIGITS < DIGITS:
            cuts = cuts.drop("here")
    t, c = table.alias("t"), cuts.alias("c")
    joined = t.join(c, F.col("t.source").eqNullSafe(F.col("c.key")), "left")
    return joined.select(F.col("t.source").alias("key"), "source_size", "target", "copies", "cut", "left", "here"), small


def _decided(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """Adds the table's columns, tail_words and taken to rows of source, size and place."""
    tail = F.when(F.col("place") < F.col("cut"), F.col("size")).when(F.col("place") == F.col("cut"), F.floor(F.col("size") * F.col("left") / F.col("here"))).otherwise(F.lit(0)).cast("long")
    out = _beside(rows, table, small).withColumn("tail_words", F.coalesce(tail, F.lit(0).cast("long")))
    return out.withColumn("taken", F.col("size") * F.col("copies") + F.col("tail_words"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole), tail_words (of one more, partial copy) and taken."""
    base = staged(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), place(F.col(doc_id)).alias("place")), "sizes")
    table, small = thresholds(base.select("source", "size", "place"), weights, most)
    return _decided(base, table, small).select("doc_id", "source", "size", "source_size", "target", "copies", "tail_words", "taken")


def take_mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """The mixed corpus, with the columns of `docs`: a row for every copy; of a partial copy the first words and n_chars of that."""
    measured = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("source"), n_words(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place"))
    table, small = thresholds(staged(measured.select("source", "size", "place"), "sizes"), weights, most)
    rows = _decided(measured, table, small)
    whole = F.col("copies").cast("int") + (F.col("tail_words") == F.col("size")).cast("int") * (F.col("size") > 0).cast("int")
    part = (F.col("tail_words") > 0) & (F.col("tail_words") < F.col("size"))
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.col("tail_words").cast("int")), "")
    kinds = F.concat(F.array_repeat(F.lit(False), whole), F.array_repeat(F.lit(True), part.cast("int")))
    rows = rows.select("*", F.explode(kinds).alias("partial"))
    text = F.when(F.col("partial"), head).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("partial"), F.length(text)).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(0))}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
