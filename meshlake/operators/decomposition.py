"""Decompositions: which rank's k-th local element is which offset of the global array.

The map is a lazy DataFrame (task, k, goff); goff is null for a hole. It is never collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Code, GridError, require
from ..functions.layout import one_dim
from ..session import BOX, SUBSET, GridSession
from ..types import grid_type

#: Cells (rows times columns) that one task is dealt where rows are sorted or joined; some 50 MB.
TASK_CELLS = 1 << 21


def tasks(rows: int, columns: int) -> int:
    """How many tasks share so many rows, so that what one holds doesn't grow with the array."""
    return max(1, -(-rows * columns // TASK_CELLS))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """`df` in `n` partitions by `keys`; as it is where one task could hold all."""
    return df.repartition(n, *keys) if n > 1 else df


@dataclass
class Decomposition:
    map: DataFrame
    dims: tuple[int, ...]
    type: str = "double"
    rearranger: str = BOX
    readonly: bool = False
    #: (least offset, greatest, how many, whether any repeats) where a constructor knows them; else worked out once, when asked for.
    known: tuple[int | None, int | None, int, bool] | None = None

    def __post_init__(self):
        grid_type(self.type)
        require(bool(self.dims) and min(self.dims) > 0, Code.EINVAL, "dimensions")
        require(self.rearranger in (BOX, SUBSET), Code.EBADREARR, self.rearranger)
        require(not self.readonly or self.rearranger == SUBSET, Code.EINVAL, "read-only maps need the subset rearranger")

    # Constructors

    @classmethod
    def of(cls, df: DataFrame, dims: Sequence[int], base: int = 0, **rest) -> Decomposition:
        """From (task, k, goff) with offsets from `base` (0 or 1); below it, or null, is a hole."""
        require(base in (0, 1), Code.EINVAL, "base")
        goff = F.when(F.col("goff") >= base, F.col("goff").cast("bigint") - base)
        return cls(df.select(F.col("task").cast("int").alias("task"), F.col("k").cast("bigint").alias("k"), goff.alias("goff")), tuple(dims), **rest)

    @classmethod
    def from_lists(cls, spark: SparkSession, maps: Sequence[Sequence[int]], dims: Sequence[int], base: int = 0, **rest) -> Decomposition:
        """From one list of offsets for each rank."""
        rows = [(t, list(m)) for t, m in enumerate(maps)]
        df = spark.createDataFrame(rows, "task int, m array<bigint>").select("task", F.posexplode("m").alias("k", "goff"))
        return cls.of(df, dims, base, **rest)

    @classmethod
    def block(cls, session: GridSession, dims: Sequence[int], **rest) -> Decomposition:
        """Contiguous blocks of equal length, the last one shorter."""
        total, n = prod(dims), session.num_compute
        each = -(-total // n)
        df = session.spark.range(total).select(F.floor(F.col("id") / each).cast("int").alias("task"), (F.col("id") % each).alias("k"), F.col("id").alias("goff"))
        return cls(df, tuple(dims), known=(0, total - 1, total, False), **rest)

    @classmethod
    def round_robin(cls, session: GridSession, dims: Sequence[int], **rest) -> Decomposition:
        n = session.num_compute
        df = session.spark.range(prod(dims)).select((F.col("id") % n).cast("int").alias("task"), F.floor(F.col("id") / n).cast("bigint").alias("k"), F.col("id").alias("goff"))
        return cls(df, tuple(dims), known=(0, prod(dims) - 1, prod(dims), False), **rest)

    @classmethod
    def boxes(cls, spark: SparkSession, boxes: Sequence[tuple[Sequence[int], Sequence[int]]], dims: Sequence[int], **rest) -> Decomposition:
        """From (start, count) for each rank; always rearranged by subsets."""
        for start, count in boxes:
            require(len(start) == len(count) == len(dims), Code.EINVAL, "box rank")
            require(all(s >= 0 and c >= 0 and s + c <= n for s, c, n in zip(start, count, dims)), Code.EINVAL, "box bounds")
        rows = [(t, list(s), list(c)) for t, (s, c) in enumerate(boxes)]
        df = spark.createDataFrame(rows, "task int, s array<bigint>, c array<bigint>")
        k = F.col("k")
        cells = F.when(F.aggregate("c", F.lit(1).cast("bigint"), lambda a, x: a * x) > 0, F.sequence(F.lit(0).cast("bigint"), F.aggregate("c", F.lit(1).cast("bigint"), lambda a, x: a * x) - 1))
        df = df.withColumn("k", F.explode(cells))
        goff, local, step = F.lit(0).cast("bigint"), k, 1
        for i in reversed(range(len(dims))):
            goff = goff + (F.col("s")[i] + local % F.col("c")[i]) * step
            local, step = F.floor(local / F.col("c")[i]).cast("bigint"), step * dims[i]
        return cls(df.select("task", "k", goff.alias("goff")), tuple(dims), rearranger=SUBSET, **rest)

    @classmethod
    def grid(cls, spark: SparkSession, dims: Sequence[int], parts: Sequence[int], order: Sequence[int] | None = None, **rest) -> Decomposition:
        """Ranks in a grid of `parts` along each dimension, counted with dimension `order[0]` fastest (the last one if not given)."""
        order = list(order) if order is not None else list(reversed(range(len(dims))))
        require(len(parts) == len(dims) and sorted(order) == list(range(len(dims))) and min(parts) > 0, Code.EINVAL, "grid")
        boxes = []
        for t in range(prod(parts)):
            place, left = [0] * len(dims), t
            for d in order:
                left, place[d] = divmod(left, parts[d])
            pairs = [one_dim(n, p, i) for n, p, i in zip(dims, parts, place)]
            boxes.append(([s for s, _ in pairs], [c for _, c in pairs]))
        return cls.boxes(spark, boxes, dims, **rest)

    # Facts about a map: all are single aggregates or windows by rank

    def facts(self) -> tuple[int | None, int | None, int, bool]:
        """(least offset, greatest, how many, whether any repeats), from one pass over the map."""
        if self.known is None:
            there = self.map.where("goff IS NOT NULL")
            n = min(tasks(self.size, 2), int(there.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a sparse array has fewer elements
            each = dealt(there, n, "goff").groupBy("goff").agg(F.count("*").alias("n"))
            least, greatest, n, most = each.agg(F.min("goff"), F.max("goff"), F.sum("n"), F.max("n")).first()
            self.known = (least, greatest, n or 0, (most or 0) > 1)
        return self.known

    @property
    def size(self) -> int:
        return prod(self.dims)

    def local_sizes(self) -> DataFrame:
        return self.map.groupBy("task").agg(F.count("*").alias("maplen"))

    def local_size(self, task: int) -> int:
        return self.map.where(F.col("task") == task).count()

    def sort_needed(self) -> DataFrame:
        """(task, needs_sort): whether a rank's offsets come out of order."""
        w = Window.partitionBy("task").orderBy("k")
        stepped = self.map.withColumn("before", F.lag("goff").over(w))
        return stepped.groupBy("task").agg(F.coalesce(F.max(F.col("goff") < F.col("before")), F.lit(False)).alias("needs_sort"))

    def remapped(self) -> DataFrame:
        """The map with `remap`: each element's place in its rank's offset order, holes first."""
        w = Window.partitionBy("task").orderBy(F.asc_nulls_first("goff"), "k")
        return self.map.withColumn("remap", F.row_number().over(w) - 1)

    def duplicates(self) -> DataFrame:
        return self.map.where("goff IS NOT NULL").groupBy("goff").agg(F.count("*").alias("n")).where("n > 1")

    def has_duplicates(self) -> bool:
        return self.facts()[3]

    def summary(self) -> DataFrame:
        """One row: least and greatest offset, how many, whether that many can't be distinct, whether the array has holes."""
        return self.map.agg(F.min("goff").alias("least"), F.max("goff").alias("greatest"), F.count("goff").alias("n")).select(
            "*", (F.coalesce(F.col("greatest") - F.col("least") + 1, F.lit(0)) < F.col("n")).alias("readonly"), (F.col("n") < self.size).alias("needs_fill")
        )

    def needs_fill(self) -> bool:
        return self.facts()[2] < self.size

    def check(self, writing: bool = False) -> None:
        """Raise unless offsets are in bounds and, for writing, distinct."""
        low, high, _, repeats = self.facts()
        require(low is None or (low >= 0 and high < self.size), Code.EINVAL, "an offset is outside the array")
        if writing:
            require(not self.readonly, Code.EINVAL, "the decomposition is read-only")
            require(not repeats, Code.EINVAL, "two elements have one destination")

    def halo(self, reach: int = 1) -> Decomposition:
        """Each element with its neighbours up to `reach` offsets away; a read-only map, with holes beyond the array's ends."""
        near = F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1)])).alias("d")
        wide = self.map.select("task", "k", "goff", near).withColumn("g", F.col("goff") + F.col("d"))
        df = wide.select("task", (F.col("k") * (2 * reach + 1) + F.col("d") + reach).alias("k"), F.when(F.col("g").between(0, self.size - 1), F.col("g")).alias("goff"))
        return Decomposition(df, self.dims, self.type, SUBSET, readonly=True)

    def cached(self) -> Decomposition:
        self.map = self.map.cache()
        return self

    def free(self) -> None:
        self.map.unpersist()


def sorted_copy(df: DataFrame, remap: DataFrame, inverse: bool = False) -> DataFrame:
    """`df` (task, k, ...) with its elements moved to their places in offset order, or back."""
    here, there = ("remap", "k") if inverse else ("k", "remap")
    by = remap.select(F.col("task").alias("__t"), F.col(here).alias("__here"), F.col(there).alias("__there"))
    joined = df.join(by, (df["task"] == F.col("__t")) & (df["k"] == F.col("__here")))
    return joined.select("task", F.col("__there").cast("bigint").alias("k"), *[c for c in df.columns if c not in ("task", "k")])


def maplen_checked(df: DataFrame, decomposition: Decomposition) -> None:
    """Raise EINVAL where a rank has fewer values than its map has elements."""
    have = df.groupBy("task").agg(F.count("*").alias("have"))
    short = decomposition.local_sizes().join(have, "task", "left").where("coalesce(have, 0) < maplen")
    if not short.isEmpty():
        raise GridError(Code.EINVAL, "fewer values than map elements")
