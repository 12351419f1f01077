"""Row-major positions and multi-indices, as columns and as plain functions."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def strides(shape: Sequence[int]) -> list[int]:
    """Step of each axis in a row-major array: the last axis runs fastest."""
    return [prod(shape[k + 1 :]) for k in range(len(shape))]


def unravel(position: int, shape: Sequence[int]) -> list[int]:
    if not 0 <= position < prod(shape):
        raise ValueError(f"position {position} is outside the shape {list(shape)}")
    return [position // s % d for s, d in zip(strides(shape), shape, strict=True)]


def ravel(index: Sequence[int], shape: Sequence[int]) -> int:
    if len(index) != len(shape):
        raise ValueError(f"{len(index)} indices for a shape of rank {len(shape)}")
    for i, d in zip(index, shape, strict=True):
        if not 0 <= i < d:
            raise ValueError(f"index {list(index)} is outside the shape {list(shape)}")
    return sum(i * s for i, s in zip(index, strides(shape), strict=True))


def unravel_columns(position: Column, shape: Sequence[int]) -> list[Column]:
    """Index columns of a position, in whole-number arithmetic."""
    out = []
    for s, d in zip(strides(shape), shape, strict=True):
        whole = F.call_function("div", position, F.lit(s).cast("long")) if s > 1 else position
        out.append(F.pmod(whole, F.lit(d).cast("long")))
    return out


def ravel_column(index: Sequence[Column], shape: Sequence[int]) -> Column:
    """Position column of index columns."""
    out = F.lit(0).cast("long")
    for c, s in zip(index, strides(shape), strict=True):
        out = out + c * F.lit(s).cast("long")
    return out


def checked(position: Column, size: int) -> Column:
    """The position, or an error outside the range."""
    return F.when((position >= 0) & (position < size), position).otherwise(F.raise_error(F.concat(F.lit("position out of range: "), position.cast("string"))))
