"""Offsets, coordinates, balanced splits, boxes and regions. Offsets and coordinates start at 0; the last dimension varies fastest."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce
from math import gcd, prod

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Code, GridError, require
from ..types import grid_type

BLOCKSIZE = 1 << 20


def strides(dims: Sequence[int]) -> list[int]:
    return [prod(dims[i + 1 :]) for i in range(len(dims))]


def coordinates(at: Column, dims: Sequence[int]) -> list[Column]:
    """Coordinate columns of an offset column."""
    return [F.floor(at / F.lit(s)).cast("bigint") % F.lit(n) if i else F.floor(at / F.lit(s)).cast("bigint") for i, (n, s) in enumerate(zip(dims, strides(dims)))]


def offset(coords: Sequence[Column], dims: Sequence[int]) -> Column:
    """Offset column of coordinate columns."""
    return reduce(lambda a, b: a + b, (c.cast("bigint") * F.lit(s) for c, s in zip(coords, strides(dims))), F.lit(0).cast("bigint"))


def one_dim(size: int, parts: int, rank: int) -> tuple[int, int]:
    """(start, count) of part `rank` of a balanced split; the last parts take what is left over."""
    if size < 0 or parts < 1 or rank < 0:
        raise GridError(Code.EINVAL, "split")
    base, over = divmod(size, parts)
    place = rank % parts
    plain = parts - over  # so many parts have `base`
    return base * place + max(0, place - plain), base + (place >= plain)


def piece_of(at: Column, size: int, parts: int) -> tuple[Column, Column, Column]:
    """(piece, place in it, its length) of an index column under the balanced split of `size` in `parts`: `one_dim` from the other side."""
    base, over = divmod(size, parts)
    plain = parts - over
    late = at >= F.lit(base * plain)
    past = at - F.lit(base * plain)
    if not base:
        return F.lit(plain) + past, F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    piece = F.when(late, F.lit(plain) + F.floor(past / F.lit(base + 1))).otherwise(F.floor(at / F.lit(base)))
    return piece.cast("bigint"), F.when(late, past % F.lit(base + 1)).otherwise(at % F.lit(base)), F.when(late, F.lit(base + 1)).otherwise(F.lit(base)).cast("bigint")


def cut_counts(parts: int, dims: Sequence[int], at: int) -> list[int] | None:
    """Pieces by dimension of a tiling in `parts` boxes: single rows before dimension `at`, equal cuts of it, whole extents behind it; None if there is none."""
    if parts == 1:
        return [1] * len(dims)
    pieces, rest = divmod(parts, prod(dims[:at]))
    return None if rest or not 2 <= pieces <= dims[at] else [*dims[:at], pieces, *[1] * (len(dims) - at - 1)]


def box_split(type_name: str | int, dims: Sequence[int], num_io: int, blocksize: int = BLOCKSIZE) -> list[list[tuple[int, int]]]:
    """Boxes (start, count by dimension) that tile the array, one for each active I/O rank; at most `num_io`.

    As many ranks are wanted as get about `blocksize` bytes each. A number of ranks is tried at one dimension: the innermost
    one whose slabs, dealt to so many ranks, are larger than what a rank should hold (the last dimension if none is), or the
    one before it where that is too short for so many ranks. The largest number that tiles the array is taken.
    """
    require(bool(dims) and num_io > 0 and min(dims) > 0, Code.EINVAL, "box split")
    itemsize = grid_type(type_name).bytes
    slab = [itemsize * prod(dims[i:]) for i in range(len(dims))]
    per_block = max(1, (blocksize - 256) // itemsize)
    wanted = min(num_io, max(1, int(np.float32(prod(dims)) / np.float32(per_block) + np.float32(0.5))))
    full = max(blocksize, slab[0] // wanted) + 256
    for ranks in range(wanted, 0, -1):
        at = max((i for i, size in enumerate(slab) if size // ranks > full), default=len(dims) - 1)
        short = dims[at] < ranks
        if short and at and dims[at - 1] > ranks:
            at, short = at - 1, False
        while at and dims[at] == 1:
            at -= 1
        pieces = None if short and ranks % dims[at] else cut_counts(ranks, dims, at)
        if pieces:
            cuts = [[one_dim(n, p, i) for i in range(p)] for n, p in zip(dims, pieces)]
            return [list(box) for box in itertools.product(*cuts)]
    raise GridError(Code.EINVAL, "no tiling")


def io_ranks(num_compute: int, num_io: int, stride: int = 1, base: int = 0) -> list[int]:
    """Compute ranks that do I/O."""
    require(num_compute > 0 and 0 < num_io and 0 <= base < num_compute and num_io * stride <= num_compute, Code.EINVAL, "I/O ranks")
    return [(base + i * stride) % num_compute for i in range(num_io)]


def gcd_block(offsets: Sequence[int]) -> int:
    """Largest block length in which sorted offsets come: the common divisor of run lengths, gaps and the first offset; 1 if there is none."""
    x = np.asarray(offsets, np.int64)
    if len(x) < 2:
        return 1
    cut = np.nonzero(np.diff(x) != 1)[0] + 1
    lengths = np.diff(np.concatenate([[0], cut, [len(x)]]))
    gaps = np.diff(x)[cut - 1] - 1
    return max(1, reduce(gcd, [*lengths.tolist(), *gaps.tolist(), int(x[0])], 0))


def regions(offsets: Sequence[int], dims: Sequence[int]) -> list[tuple[int, list[int], list[int]]]:
    """(local offset, start, count) of boxes that cover sorted offsets in order, each as large as it can be, inner dimensions first."""
    x = np.asarray(offsets, np.int64)
    skip, step = int((x < 0).sum()), strides(dims)
    out, at = [], skip
    while at < len(x):
        start = [int(x[at] // s % n) for s, n in zip(step, dims)]
        count, size = [1] * len(dims), 1
        for d in reversed(range(len(dims))):
            room = min(dims[d] - start[d], (len(x) - at) // size)
            slabs = x[at : at + room * size].reshape(room, size)
            fits = (slabs == slabs[0] + np.arange(room)[:, None] * step[d]).all(axis=1)
            count[d] = room if fits.all() else int(fits.argmin())
            size *= count[d]
            if count[d] < dims[d]:
                break
        out.append((at, start, count))
        at += size
    return out
