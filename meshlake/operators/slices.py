"""Positional slices of a table keyed by offset, and writes into slices.

A slice becomes a range of the offset (which Parquet statistics prune by) and conditions on its coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Code, require
from ..functions.layout import coordinates, offset, strides


def checked(dims: Sequence[int], start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None) -> list[int]:
    """The strides (1 where not given), or EINVALCOORDS, EEDGE, ESTRIDE or EINVAL."""
    step = list(stride) if stride is not None else [1] * len(dims)
    require(len(start) == len(count) == len(step) == len(dims), Code.EINVAL, "slice rank")
    for n, s, c, t in zip(dims, start, count, step):
        require(t >= 1, Code.ESTRIDE, str(t))
        require(0 <= s < n or (c == 0 and s <= n), Code.EINVALCOORDS, str(s))
        require(c >= 0 and (c == 0 or s + (c - 1) * t < n), Code.EEDGE, f"{s} + {c}")
    return step


def condition(goff: Column, dims: Sequence[int], start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None = None) -> Column:
    step = checked(dims, start, count, stride)
    if 0 in count:
        return F.lit(False)
    low = sum(s * w for s, w in zip(start, strides(dims)))
    high = sum((s + (c - 1) * t) * w for s, c, t, w in zip(start, count, step, strides(dims)))
    tests = [goff >= low, goff <= high]
    for x, n, s, c, t in zip(coordinates(goff, dims), dims, start, count, step):
        if (s, c, t) != (0, n, 1):
            tests.append(x.between(s, s + (c - 1) * t))
            if t > 1:
                tests.append((x - s) % t == 0)
    return reduce(lambda a, b: a & b, tests)


def hyperslab(df: DataFrame, dims: Sequence[int], start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None = None, goff: str = "goff") -> DataFrame:
    return df.where(condition(F.col(goff), dims, start, count, stride))


def point(df: DataFrame, dims: Sequence[int], index: Sequence[int], goff: str = "goff") -> DataFrame:
    return hyperslab(df, dims, index, [1] * len(dims), None, goff)


def slab_offsets(local: Column, dims: Sequence[int], start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None = None) -> Column:
    """Global offset of the `local`-th element of a slab, row-major."""
    step = checked(dims, start, count, stride)
    inner = coordinates(local, count)
    return offset([x * t + s for x, s, t in zip(inner, start, step)], dims)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("goff",)) -> DataFrame:
    """`old` with the rows of `new` in place of those with equal keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
