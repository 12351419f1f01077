"""Ordered algebra on label lists, as plain functions and as Spark columns, and small text utilities.

Unlike SQL's array functions these keep order and duplicates of the first list.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of generated labels, in order.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def label_name(number: int) -> str:
    """a..z, A..Z, then a0..Z0, a1..."""
    turn, letter = divmod(number, len(ALPHABET))
    return ALPHABET[letter] + (str(turn - 1) if turn else "")


def contains(items: Sequence, item) -> bool:
    return item in items


def contains_all(items: Sequence, wanted: Sequence) -> bool:
    return set(wanted) <= set(items)


def intersection(a: Sequence, b: Sequence) -> list:
    return [x for x in a if x in b]


def difference(a: Sequence, b: Sequence) -> list:
    return [x for x in a if x not in b]


def union(a: Sequence, b: Sequence) -> list:
    return [*a, *difference(b, a)]


def exclusive(a: Sequence, b: Sequence) -> list:
    return difference(union(a, b), intersection(a, b))


def split_once(text: str, mark: str) -> list[str]:
    """The parts around the first mark, or the whole text."""
    return text.split(mark, 1) if mark in text else [text]


def split_all(text: str, mark: str) -> list[str]:
    return text.split(mark)


def split_marks(text: str, marks: Sequence[str]) -> list[str]:
    """Splits at each mark once, in order, after white space is taken out; without empty parts."""
    parts = ["".join(text.split())]
    for mark in marks:
        parts += split_once(parts.pop(), mark)
    return [p for p in parts if p]


def replace_all(text: str, old: str, new: str) -> str:
    if not old:
        raise ValueError("an empty pattern can't be replaced")
    return text.replace(old, new)


# The same on columns.


def label_name_column(number: Column) -> Column:
    n = number.cast("long")
    size = len(ALPHABET)
    letter = F.substring(F.lit(ALPHABET), (F.pmod(n, F.lit(size)) + 1).cast("int"), F.lit(1))
    turn = (n - F.pmod(n, F.lit(size))) / size
    return F.concat(letter, F.when(turn >= 1, (turn - 1).cast("long").cast("string")).otherwise(F.lit("")))


def intersection_column(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: F.array_contains(b, x))


def difference_column(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def union_column(a: Column, b: Column) -> Column:
    return F.concat(a, difference_column(b, a))


def exclusive_column(a: Column, b: Column) -> Column:
    return F.concat(difference_column(a, b), difference_column(b, a))


def contains_all_column(a: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, a)) == 0


def joined_column(a: Column) -> Column:
    return F.array_join(a, "")


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def floor_log2(n: Column) -> Column:
    """Exact for positive integers: the number of binary digits less one."""
    return F.length(F.bin(n)) - 1


def shape_size(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def factorial(n: Column) -> Column:
    """Null above 20, where 64 bits end."""
    return F.factorial(n)


def split_all_column(text: Column, mark: str) -> Column:
    return F.split(text, re.escape(mark))


def split_once_column(text: Column, mark: str) -> Column:
    return F.split(text, re.escape(mark), 2)


def split_marks_column(text: Column, marks: Sequence[str]) -> Column:
    """As split_marks."""
    parts = F.array(F.regexp_replace(text, r"\s", ""))
    for mark in marks:
        size = F.size(parts)
        parts = F.concat(F.slice(parts, F.lit(1), size - 1), split_once_column(F.element_at(parts, -1), mark))
    return F.filter(parts, lambda p: p != "")


def listed_column(items: Column) -> Column:
    """An array as text: {a  b  c}."""
    return F.concat(F.lit("{"), F.array_join(items.cast("array<string>"), "  "), F.lit("}"))


def paired_column(a: Column, b: Column) -> Column:
    """Two values as text: {a,b}."""
    return F.concat(F.lit("{"), a.cast("string"), F.lit(","), b.cast("string"), F.lit("}"))


def memory_kb() -> tuple[int, int]:
    """Total and available memory of this machine in kB (-1 where the system doesn't say)."""
    try:
        with open("/proc/meminfo") as f:
            found = {name: int(rest.split()[0]) for name, _, rest in (line.partition(":") for line in f) if rest.split()}
    except OSError:
        return -1, -1
    return found.get("MemTotal", -1), found.get("MemAvailable", -1)
