from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("".join(r.choice("abcdeéßfghij") for _ in range(2 + k % 7)) + str(k) for k in (r.randrange(vocabulary) for _ in range(n)))


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, shared ids, ties."""
    r = random.Random(5)
    long = prose(r, 9000)
    base = prose(r, 150)
    near = base.replace(base.split()[70], "changed")
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, "de", None), (3, near, None, "b"), (4, None, "en", "b"), (5, "", None, None), (6, long, "de", "c"),
        (7, "tail " + long[5000:25000], "de", "c"), (None, base, "en", "a"), (None, "no id", None, None), (8, "x", "en", "b"), (9, "x", "en", "b"), (10, "?! 123 ...", "en", "b"),
        (11, "Der " * 400, "de", "c"), (12, "a b", "en", "d"), (12, "other text with the same id", "en", "d"), (13, "日本語 テキスト \x00 \U0001f600 " * 30, "ja", "日"), (14, base + " " + prose(r, 60), "en", "a"),
    ]
    return [(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in rows]


def frame(spark, rows=None):
    """The rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    extra = {c: F.lit("clash") for c in ("row", "size", "place", "key", "slot", "kind", "words", "score", "component", "component_id", "n_shingles", "toxic", "first", "rest", "held_out", "doc", "hash", "cut", "copies", "id", "part")}
    return df.withColumns(extra)
