"""Rearrangement: which I/O rank gets which element, and diagnostics of the traffic.

Boxes of the balanced split form a grid, so an element's box is arithmetic over its coordinates, without a join.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce
from math import prod

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Code, require
from ..functions.layout import box_split, coordinates, one_dim, piece_of, regions
from ..session import BOX, GridSession
from .decomposition import Decomposition, dealt, tasks

Box = list[tuple[int, int]]


def _grid(boxes: Sequence[Box], dims: Sequence[int]) -> list[int] | None:
    """Pieces by dimension if `boxes` are the row-major product of balanced splits of `dims`, else None."""
    pieces = [len({b[d] for b in boxes}) for d in range(len(dims))]
    if prod(pieces) != len(boxes):
        return None
    cuts = [[one_dim(n, p, i) for i in range(p)] for n, p in zip(dims, pieces)]
    return pieces if all(tuple(map(tuple, b)) == c for b, c in zip(boxes, itertools.product(*cuts))) else None


def assign_boxes(df: DataFrame, dims: Sequence[int], boxes: Sequence[Box], goff: str = "goff") -> DataFrame:
    """`df` with io (the first box that holds the element; null for a hole) and ioff (row-major place in that box).

    Boxes that are a grid of balanced splits, as `box_split` makes them, are found by arithmetic, however many they are.
    Others are joined by their bounds; they are one row for each I/O rank.
    """
    require(bool(boxes), Code.EINVAL, "no boxes")
    coords = coordinates(F.col(goff), dims)
    pieces = _grid(boxes, dims)
    if pieces is not None:
        io, place = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        for c, n, p in zip(coords, dims, pieces):
            piece, at, length = piece_of(c, n, p)
            io, place = io * F.lit(p) + piece, place * length + at
        inside = F.col(goff).between(0, prod(dims) - 1)
        return df.withColumns({"io": F.when(inside, io).cast("int"), "ioff": F.when(inside, place)})
    rows = [(rank, [s for s, _ in b], [n for _, n in b]) for rank, b in enumerate(boxes)]
    table = df.sparkSession.createDataFrame(rows, "__io int, __s array<bigint>, __n array<bigint>")
    inside = reduce(lambda a, b: a & b, ((c >= F.col("__s")[i]) & (c < F.col("__s")[i] + F.col("__n")[i]) for i, c in enumerate(coords)))
    local = reduce(lambda at, x: at * F.col("__n")[x[0]] + (x[1] - F.col("__s")[x[0]]), enumerate(coords), F.lit(0).cast("bigint"))
    met = df.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(table), inside, "left").withColumn("__at", local)
    first = F.min(F.struct("__io", "__at"))
    found = met.groupBy("__row").agg(*[F.first(c).alias(c) for c in df.columns], first.alias("__hit"))
    return found.select(*df.columns, F.col("__hit.__io").alias("io"), F.col("__hit.__at").alias("ioff"))


def assign_subsets(df: DataFrame, num_compute: int, num_io: int, task: str = "task") -> DataFrame:
    """`df` with io: ranks in groups of equal size, the last I/O rank taking the rest."""
    ratio = max(1, num_compute // num_io)
    return df.withColumn("io", F.least(F.lit(num_io - 1), F.floor(F.col(task) / ratio)).cast("int"))


def assigned(session: GridSession, decomposition: Decomposition) -> DataFrame:
    """The map with io, by the decomposition's rearranger; offsets outside all boxes raise EINVAL."""
    if decomposition.rearranger == BOX:
        decomposition.check()
        boxes = box_split(decomposition.type, decomposition.dims, session.num_io, session.blocksize)
        return assign_boxes(decomposition.map, decomposition.dims, boxes)
    return assign_subsets(decomposition.map.where("goff IS NOT NULL"), session.num_compute, session.num_io)


def to_io(df: DataFrame, num_io: int, rows: int) -> DataFrame:
    """Rows of (io, goff, ...), `rows` of them at most, moved to one partition for each I/O rank, in order of offset.

    Where that is more than a task should hold, ranks' partitions are cut at offsets.
    """
    n = tasks(rows, len(df.columns))
    moved = df.repartitionByRange(max(n, num_io), "io", "goff") if n > 1 else df.repartition(num_io, "io")
    return moved.sortWithinPartitions("io", "goff")


def comm_matrix(assigned: DataFrame) -> DataFrame:
    """(task, io, n): elements that go from each compute rank to each I/O rank."""
    return assigned.where("io IS NOT NULL").groupBy("task", "io").agg(F.count("*").alias("n"))


def io_buffer_sizes(boxes: Sequence[Box]) -> list[int]:
    return [prod(n for _, n in b) for b in boxes]


def max_io_buffer(assigned: DataFrame) -> DataFrame:
    """(maxiobuflen): the most elements that one I/O rank holds."""
    return assigned.where("io IS NOT NULL").groupBy("io").agg(F.count("*").alias("llen")).agg(F.max("llen").alias("maxiobuflen"))


def deduplicated(assigned: DataFrame) -> DataFrame:
    """Each offset once for each I/O rank, for reading."""
    return assigned.where("goff IS NOT NULL").select("io", "goff").distinct()


def hole_grid(df: DataFrame, size: int, num_io: int | None = None, goff: str = "goff") -> DataFrame:
    """(goff) of all offsets below `size` that `df` lacks; with `num_io` also io: near-equal ranges of the array, larger ones last."""
    spark = df.sparkSession
    n = tasks(size, 2)
    holes = dealt(spark.range(size).select(F.col("id").alias("goff")), n, "goff").join(dealt(df.select(F.col(goff).alias("goff")), n, "goff"), "goff", "left_anti")
    if num_io is None:
        return holes
    return holes.withColumn("io", piece_of(F.col("goff"), size, num_io)[0].cast("int"))


def runs_1d(df: DataFrame, by: Sequence[str] = (), goff: str = "goff") -> DataFrame:
    """(by, start, count): runs of consecutive offsets. Without `by`, ranges of offsets are windowed apart and then joined at their ends.

    A run's key is its offset less its place among distinct offsets. Places within a range of 2**20 offsets come from a
    window over that range alone; runs that touch a range's end are merged by a second, much smaller, window.
    """
    rows = df.where(F.col(goff).isNotNull()).select(*by, F.col(goff).alias("goff")).distinct()
    rows = rows.withColumn("__range", F.shiftright("goff", 20))
    w = Window.partitionBy(*by, "__range").orderBy("goff")
    part = rows.withColumn("__key", F.col("goff") - F.row_number().over(w)).groupBy(*by, "__range", "__key").agg(F.min("goff").alias("start"), F.count("*").alias("count"))
    first, last = F.col("start") == F.shiftleft(F.col("__range"), 20), F.col("start") + F.col("count") == F.shiftleft(F.col("__range") + 1, 20)
    at_edge = part.where(first | last).withColumn("first", first).withColumn("last", last)
    w2 = Window.partitionBy(*by).orderBy("start")
    before = F.lag(F.struct("start", "count", "last")).over(w2)
    new = ~F.coalesce(F.col("first") & before["last"] & (before["start"] + before["count"] == F.col("start")), F.lit(False))
    merged = at_edge.withColumn("__new", new.cast("bigint")).withColumn("__run", F.sum("__new").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*by, "__run").agg(F.min("start").alias("start"), F.sum("count").alias("count")).drop("__run")
    return part.where(~(first | last)).select(*by, "start", "count").unionByName(merged.select(*by, "start", "count"))


def block_length(df: DataFrame, size: int, goff: str = "goff") -> DataFrame:
    """(block): the largest length of blocks in which offsets below `size` come, the common divisor of run lengths, gaps and the first offset.

    Distinct lengths are fewer than the square root of 2 * size, so their list is small.
    """
    own, holes = runs_1d(df, goff=goff), runs_1d(hole_grid(df, size, goff=goff))
    ends = own.agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("count")).alias("last"))
    gaps = holes.join(F.broadcast(ends), (F.col("start") > F.col("first")) & (F.col("start") < F.col("last"))).select("count")
    lengths = own.select("count").unionByName(gaps).unionByName(ends.select(F.col("first").alias("count"))).where("count > 0").agg(F.collect_set("count").alias("x"))
    step = lambda a, b: F.struct(b.alias("a"), (a % b).alias("b"))

    def gcd(a, b):
        """Euclid's steps; numbers below 2**63 need fewer than 92."""
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), lambda p, _: F.when(p["b"] == 0, p).otherwise(step(p["a"], F.greatest(p["b"], F.lit(1).cast("bigint")))))
        return pair["a"]

    return lengths.select(F.greatest(F.aggregate("x", F.lit(0).cast("bigint"), gcd), F.lit(1).cast("bigint")).alias("block"))


def nd_regions(df: DataFrame, dims: Sequence[int]) -> DataFrame:
    """(io, region, loffset, start, count): boxes that cover each I/O rank's offsets (io, goff) in order."""
    shape = list(dims)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = regions(pdf["goff"].sort_values().to_numpy(), shape)
        rows = [(int(pdf["io"].iloc[0]), i, at, start, count) for i, (at, start, count) in enumerate(found)]
        return pd.DataFrame(rows, columns=["io", "region", "loffset", "start", "count"])

    kinds = "io int, region int, loffset bigint, start array<bigint>, count array<bigint>"
    return df.where("goff IS NOT NULL").select("io", "goff").distinct().groupBy("io").applyInPandas(run, kinds)
