"""Offsets, splits, boxes and regions against known values and properties."""

from math import prod

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshlake.errors import Code, GridError, strerror
from meshlake.functions.layout import box_split, gcd_block, io_ranks, one_dim, piece_of, regions
from meshlake.functions.quantize import quantized
from meshlake.operators.rearrange import assign_boxes


@pytest.mark.parametrize(
    ("args", "active", "first"),
    [
        (("int", [20], 2, 260), 2, [(0, 10)]),
        (("int", [5, 4], 2, 1 << 20), 1, [(0, 5), (0, 4)]),
        (("int", [5, 4], 2, 260), 1, [(0, 5), (0, 4)]),
        (("int", [16], 4, 1 << 20), 1, [(0, 16)]),
        (("int", [512, 512, 32], 4, 1 << 20), 3, [(0, 170), (0, 512), (0, 32)]),
        (("double", [31, 777602], 24, 1 << 20), 23, [(0, 1), (0, 777602)]),
        (("double", [2, 3, 1000000], 4, 1 << 20), 2, [(0, 1), (0, 3), (0, 1000000)]),
    ],
)
def test_box_split_known(args, active, first):
    boxes = box_split(*args)
    assert len(boxes) == active
    assert boxes[0] == first


@given(st.lists(st.integers(1, 12), min_size=1, max_size=3), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_box_split_tiles(dims, num_io):
    boxes = box_split("double", dims, num_io, 264)
    seen = np.zeros(dims, int)
    for box in boxes:
        seen[tuple(slice(s, s + c) for s, c in box)] += 1
    assert (seen == 1).all()
    assert len(boxes) <= num_io


@given(st.integers(0, 200), st.integers(1, 17))
def test_one_dim_tiles(size, parts):
    pieces = [one_dim(size, parts, r) for r in range(parts)]
    at = 0
    for start, count in pieces:
        assert start == at
        at += count
    assert at == size
    assert max(c for _, c in pieces) - min(c for _, c in pieces) <= 1
    assert [c for _, c in pieces] == sorted(c for _, c in pieces)


def test_regions():
    assert regions([1, 5], [8]) == [(0, [1], [1]), (1, [5], [1])]
    assert regions([0], [4]) == [(0, [0], [1])]
    assert regions(list(range(8)), [4, 4]) == [(0, [0, 0], [2, 4])]
    assert regions([-1, 0, 1, 4, 5], [2, 4]) == [(1, [0, 0], [1, 2]), (3, [1, 0], [1, 2])]


@given(st.lists(st.integers(1, 5), min_size=1, max_size=3).flatmap(lambda d: st.tuples(st.just(d), st.sets(st.integers(0, prod(d) - 1), min_size=1))))
@settings(max_examples=150, deadline=None)
def test_regions_cover_in_order(case):
    dims, offsets = case
    got = []
    for at, start, count in regions(sorted(offsets), dims):
        assert at == len(got)
        cells = np.arange(prod(dims)).reshape(dims)[tuple(slice(s, s + c) for s, c in zip(start, count))]
        got += cells.ravel().tolist()
    assert got == sorted(offsets)


def test_gcd_block():
    assert gcd_block([0]) == 1
    assert gcd_block([0, 1, 2, 3]) == 4
    assert gcd_block([0, 1, 4, 5, 8, 9]) == 2


def test_io_ranks():
    assert io_ranks(16, 5, 3, 1) == [1, 4, 7, 10, 13]
    assert io_ranks(4, 2, 2, 1) == [1, 3]
    with pytest.raises(GridError):
        io_ranks(4, 5)


def test_codes():
    assert Code.EBADID == -33
    assert Code.EBADREARR == -502
    assert strerror(Code.EINVAL) == "Invalid argument"
    assert "Unknown" in strerror(-9999)


def bits_kept(x, keep, how, place):
    """The mantissa with `keep` bits, by its bits: rounded half to even, or cleared and set in turn."""
    bits, form = (23, np.uint32) if x.dtype == np.float32 else (52, np.uint64)
    raw, drop = x.view(form), form(bits - keep)
    mask = ~((form(1) << drop) - form(1)) if drop else ~form(0)
    if how == "groom":
        out = np.where((place % 2 == 1) & (x != 0), raw | ~mask, raw & mask)
    else:
        out = (raw + (form(1) << drop - form(1)) - form(1) + ((raw >> drop) & form(1))) & mask if drop else raw
    return np.where(np.isfinite(x), out.astype(form).view(x.dtype), x)


@pytest.mark.parametrize("double", [True, False])
def test_quantized_is_rounding_of_bits(spark, double):
    from math import ceil, log2

    kind = np.float64 if double else np.float32
    rng = np.random.default_rng(2)
    x = np.concatenate([[1.0, 1 / 3, -7.77, 0.0, np.inf, -np.inf, 12345.678, 2.0, 4.0, 0.5, 1.5, 2.5, 1023.9999, -1024.0], rng.normal(0, 1, 300) * 10.0 ** rng.integers(-12, 12, 300)]).astype(kind)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(len(x), None)], f"goff bigint, v {'double' if double else 'float'}")
    keeps = {"bitround": 9, "bitgroom": ceil(3 * log2(10)) + 1}
    out = df.repartition(5).select("goff", quantized("v", "bitround", 9, double).alias("r"), quantized("v", "bitgroom", 3, double).alias("g")).orderBy("goff").collect()
    place = np.arange(len(x))
    assert out[-1].r is None and out[-1].g is None
    assert (np.array([r.r for r in out[:-1]], kind) == bits_kept(x, keeps["bitround"], "round", place)).all()
    assert (np.array([r.g for r in out[:-1]], kind) == bits_kept(x, keeps["bitgroom"], "groom", place)).all()



@given(st.integers(1, 60), st.integers(1, 9))
@settings(max_examples=5, deadline=None)
def test_piece_of_is_one_dim_from_the_other_side(spark, size, parts):
    from pyspark.sql import functions as F

    rows = spark.range(size).select("id", *[c.alias(n) for c, n in zip(piece_of(F.col("id"), size, parts), ("piece", "at", "length"))]).collect()
    want = [(p, i, n) for p in range(parts) for s, n in [one_dim(size, parts, p)] for i in range(n)]
    assert [(r.piece, r.at, r.length) for r in rows] == want


def test_boxes_by_arithmetic_and_by_bounds(spark):
    dims = [4, 5, 6]
    odd = [[(0, 1), (0, 5), (0, 6)], [(1, 3), (0, 2), (0, 6)], [(1, 3), (2, 3), (0, 6)]]
    for boxes in (box_split("double", dims, 4, 264), odd, odd[:2]):
        want = {}
        cells = np.arange(prod(dims)).reshape(dims)
        for io, box in reversed(list(enumerate(boxes))):
            inner = cells[tuple(slice(s, s + c) for s, c in box)].ravel().tolist()
            want |= {g: (io, k) for k, g in enumerate(inner)}
        df = spark.range(prod(dims)).select("id").withColumnRenamed("id", "goff").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
        got = {r.goff: (r.io, r.ioff) for r in assign_boxes(df, dims, boxes).collect()}
        assert got.pop(None) == (None, None)
        assert got == {g: want.get(g, (None, None)) for g in range(prod(dims))}


def test_piece_of_more_parts_than_indices(spark):
    from pyspark.sql import functions as F

    for size, parts in ((1, 2), (3, 9)):
        rows = spark.range(size).select(*[c.alias(n) for c, n in zip(piece_of(F.col("id"), size, parts), ("piece", "at", "length"))]).collect()
        assert sorted(map(tuple, rows)) == [(p, 0, 1) for p in range(parts) if one_dim(size, parts, p)[1]]
