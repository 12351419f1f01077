from __future__ import annotations

import pytest

from weftnet.functions import labels as L
from weftnet.functions.positions import ravel, strides, unravel


def test_label_names():
    assert [L.label_name(k) for k in (0, 25, 26, 51, 52, 103, 104)] == ["a", "z", "A", "Z", "a0", "Z0", "a1"]


def test_algebra_keeps_order_and_repeats():
    a, b = ["a", "a", "b", "c"], ["b", "a", "d"]
    assert L.intersection(a, b) == ["a", "a", "b"]
    assert L.difference(a, b) == ["c"]
    assert L.union(a, b) == ["a", "a", "b", "c", "d"]
    assert L.exclusive(a, b) == ["c", "d"]
    assert L.contains(a, "c") and L.contains_all(a, ["a", "c"]) and not L.contains_all(a, ["d"])


def test_splitting():
    assert L.split_once("a.b.c", ".") == ["a", "b.c"] and L.split_once("a", ".") == ["a"]
    assert L.split_marks(" a : b ; c ", [":", ";"]) == ["a", "b", "c"]
    assert L.split_marks(":b", [":"]) == ["b"]
    assert L.replace_all("aXbX", "X", "-") == "a-b-"
    with pytest.raises(ValueError):
        L.replace_all("a", "", "b")


def test_positions():
    assert strides([2, 3, 4]) == [12, 4, 1]
    for k in range(24):
        assert ravel(unravel(k, [2, 3, 4]), [2, 3, 4]) == k
    for bad in (-1, 24):
        with pytest.raises(ValueError):
            unravel(bad, [2, 3, 4])
    with pytest.raises(ValueError):
        ravel([0, 3, 0], [2, 3, 4])
    with pytest.raises(ValueError):
        ravel([0], [2, 3])
