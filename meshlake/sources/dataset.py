"""Array datasets: a catalog, and for each variable a Parquet table (rec, goff, value) partitioned by record.

Values are dense by record: what a partial write leaves out is filled. Writes of one decomposition are queued and go out
together at sync or close, with one exchange for all variables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import GLOBAL, Catalog
from ..errors import Code, GridError, require
from ..functions.quantize import quantized
from ..operators import rearrange, slices
from ..operators.decomposition import Decomposition, maplen_checked
from ..session import FORMATS, GridSession
from ..types import converted, fill_literal, grid_type
from . import files


class Dataset:
    def __init__(self, session: GridSession, path: str, catalog: Catalog, writable: bool):
        self.session, self.path, self.catalog, self.writable = session, path.rstrip("/"), catalog, writable
        self.queue: dict[tuple[int, int], list[tuple[Decomposition, DataFrame, list[tuple]]]] = {}
        self.pool, self.pending = ThreadPoolExecutor(1), []
        self.open_ = True

    # Files

    @classmethod
    def create(cls, session: GridSession, path: str, format: str = "netcdf4p", clobber: bool = True) -> Dataset:
        require(format in FORMATS, Code.EBADIOTYPE, format)
        if files.exists(session.spark, path):
            require(clobber, Code.EEXIST, path)
            files.delete(session.spark, path)
        out = cls(session, path, Catalog(format), True)
        out._save()
        return out

    @classmethod
    def open(cls, session: GridSession, path: str, format: str | None = None, writable: bool = False, strict: bool = False) -> Dataset:
        """With `strict`, a dataset of another format than asked for is ENOTNC; otherwise its own is taken."""
        require(format is None or format in FORMATS, Code.EBADIOTYPE, str(format))
        spark = session.spark
        require(files.exists(spark, f"{path}/catalog.json"), Code.ENOTNC if files.exists(spark, path) else Code.ECANTREAD, path)
        catalog = Catalog.from_json(json.loads(files.read_text(spark, f"{path}/catalog.json")))
        require(not strict or format in (None, catalog.format), Code.ENOTNC, path)
        catalog.defining = False
        return cls(session, path, catalog, writable)

    @staticmethod
    def remove(session: GridSession, path: str) -> None:
        require(files.exists(session.spark, path), Code.ECANTREAD, path)
        files.delete(session.spark, path)

    def _live(self) -> None:
        require(self.open_, Code.EBADID)

    def _save(self) -> None:
        files.write_text(self.session.spark, f"{self.path}/catalog.json", json.dumps(self.catalog.to_json(), default=str))

    def close(self) -> None:
        self._live()
        while self.pending:
            self.pending.pop().result()
        if self.writable:
            self.sync()
        self.pool.shutdown()
        self.open_ = False

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *_) -> None:
        if self.open_:
            self.close()

    def __getattr__(self, name: str):
        """Definitions and inquiries are the catalog's; changing ones need a writable dataset."""
        f = getattr(self.__dict__["catalog"], name)
        if not callable(f):
            return f

        def call(*args, **kwargs):
            self._live()
            if name.split("_")[0] in ("def", "put", "rename", "del", "redef", "enddef", "set") or (name == "storage" and kwargs):
                require(self.writable, Code.EPERM)
            return f(*args, **kwargs)

        return call

    # Tables

    def _folder(self, varid: int | str) -> str:
        v = self.catalog.var(varid)
        return f"{self.path}/vars/{v.storage.get('folder', v.name)}"

    def table(self, varid: int | str, rec: int | None = None) -> DataFrame:
        """(rec, goff, value) of a variable; an unwritten one has no rows."""
        self._live()
        v, spark = self.catalog.var(varid), self.session.spark
        kind = grid_type(v.type).spark.simpleString()
        if not v.written:
            return spark.createDataFrame([], f"goff bigint, value {kind}, rec int")
        df = spark.read.schema(f"goff bigint, value {kind}, rec int").parquet(self._folder(varid))
        return df if rec is None else df.where(F.col("rec") == rec)

    def _store(self, varid: int | str, df: DataFrame, rows: int | None = None) -> None:
        """Replace the records that `df` (rec, goff, value) holds; each file is in order of offset. `rows`: how many they are at most; None: they are dealt and in order already."""
        v = self.catalog.var(varid)
        mode, digits = v.storage.get("quantize", ("none", 0))
        if mode != "none":
            df = df.withColumn("value", quantized("value", mode, digits, v.type == "double"))
        if rows is not None:
            df = df.repartitionByRange(max(1, self.session.num_io, rearrange.tasks(rows, 3)), "rec", "goff").sortWithinPartitions("rec", "goff")
        out = df.select("goff", F.col("value").cast(grid_type(v.type).spark).alias("value"), "rec").write.mode("overwrite").partitionBy("rec")
        out.option("partitionOverwriteMode", "dynamic").option("compression", self.catalog.codec(varid)).parquet(self._folder(varid))
        v.written = True

    def _fill_grid(self, varid: int | str, recs: Sequence[int], size: int, fill=None) -> DataFrame:
        """(rec, goff, value) of whole records of fill."""
        kind = grid_type(self.catalog.var(varid).type)
        rec = F.element_at(F.array(*map(F.lit, recs)), (F.floor(F.col("id") / size) + 1).cast("int")) if recs else F.lit(0)
        return self.session.spark.range(size * len(recs)).select(rec.cast("int").alias("rec"), (F.col("id") % size).alias("goff"), fill_literal(kind, fill).alias("value"))

    # Records

    def num_records(self, varid: int | str | None = None) -> int:
        some = [self.catalog.var(varid)] if varid is not None else self.catalog.variables
        last = [self.table(v.name).agg(F.max("rec")).first()[0] for v in some if v.written and self.catalog.is_record(v.name)]
        return max((x + 1 for x in last if x is not None), default=0)

    def set_frame(self, varid: int | str, rec: int) -> None:
        require(rec >= 0, Code.EINVAL, "frame")
        self.catalog.var(varid).record = rec

    def advance_frame(self, varid: int | str) -> int:
        v = self.catalog.var(varid)
        v.record += 1
        return v.record

    def _record(self, varid: int | str, rec: int | None = None) -> int:
        if not self.catalog.is_record(varid):
            return 0
        return max(0, self.catalog.var(varid).record if rec is None else rec)

    # Distributed arrays

    def write_darray(self, varid: int | str, decomposition: Decomposition, df: DataFrame, fill=None, rec: int | None = None) -> None:
        """Queue `df` (task, k, value) for a variable's record; it is stored at sync or close, and replaces the record."""
        self._queue([(varid, "value", fill, rec)], decomposition, df)

    def write_darray_multi(self, varids: Sequence[int | str], decomposition: Decomposition, df: DataFrame, fills: Sequence | None = None, recs: Sequence[int] | None = None, flush: bool = False) -> None:
        """Write `df` (task, k, and one column for each variable, by name)."""
        require(len({len(self.catalog.var(v).dims) for v in varids}) == 1, Code.EVARDIMMISMATCH)
        self._queue([(v, self.catalog.var(v).name, fills[i] if fills else None, recs[i] if recs else None) for i, v in enumerate(varids)], decomposition, df)
        if flush:
            self.sync()

    def _queue(self, columns: Sequence[tuple], decomposition: Decomposition, df: DataFrame) -> None:
        self._live()
        require(self.writable, Code.EPERM)
        require(not decomposition.readonly, Code.EINVAL, "the decomposition is read-only")
        made = []
        for varid, column, fill, rec in columns:
            v = self.catalog.var(varid)
            require(decomposition.size == prod(self.catalog.shape(varid)), Code.EINVAL, "the decomposition has another size than the variable")
            use, own = self.catalog.var_fill(varid)
            require(fill is None or not use or fill == own, Code.EINVAL, "another fill value than the variable's")
            made.append((v.name, column, own if fill is None else fill, self._record(varid, rec), use))
        maplen_checked(df, decomposition)
        key = (id(decomposition), int(self.catalog.is_record(columns[0][0])))
        self.queue.setdefault(key, []).append((decomposition, df, made))

    def sync(self) -> None:
        """Store what is queued. The frames of one decomposition meet its map and move together, each frame joined once, whatever variables it holds."""
        self._live()
        require(self.writable, Code.EPERM)
        queue, self.queue = self.queue, {}
        for group in queue.values():
            decomposition = group[0][0]
            decomposition.check(writing=True)
            rows, holes = decomposition.facts()[2], decomposition.needs_fill()
            n = rearrange.tasks(rows, 4 + sum(len(made) for *_, made in group))
            moved = rearrange.dealt(rearrange.assigned(self.session, decomposition).where("goff IS NOT NULL").select("task", "k", "goff", "io"), n, "task", "k")
            for i, (_, df, made) in enumerate(group):
                values = df.select("task", "k", *[F.col(column).alias(f"v{i}_{j}") for j, (_, column, *_) in enumerate(made)])
                moved = moved.join(rearrange.dealt(values, n, "task", "k"), ["task", "k"])
            if not holes or not all(m[-1] for *_, made in group for m in made):  # what is filled is dealt with its fill
                moved = rearrange.to_io(moved, self.session.num_io, rows)
            again = len(group) > 1 or len(group[0][2]) > 1 or holes
            moved = moved.persist() if again else moved
            for i, (_, _, made) in enumerate(group):
                for j, (name, _, fill, rec, use) in enumerate(made):
                    value, filled = moved.select("goff", F.col(f"v{i}_{j}").alias("value")), holes and use
                    if filled:
                        t = grid_type(self.catalog.var(name).type)
                        value = value.unionByName(rearrange.hole_grid(value, decomposition.size).select("goff", fill_literal(t, fill).alias("value")))
                    self._store(name, value.withColumn("rec", F.lit(rec)), decomposition.size if filled else None)
            if again:
                moved.unpersist()
        self.catalog.defining = False
        self._save()

    def write_frames(self, varid: int | str, decomposition: Decomposition, df: DataFrame) -> None:
        """Write many records at once: `df` (rec, task, k, value) of one map. What a record lacks is filled; records that `df` holds are replaced."""
        self._live()
        require(self.writable, Code.EPERM)
        require(self.catalog.is_record(varid), Code.EINVAL, "not a record variable")
        require(decomposition.size == prod(self.catalog.shape(varid)), Code.EINVAL, "the decomposition has another size than the variable")
        decomposition.check(writing=True)
        recs = sorted(r[0] for r in df.select("rec").distinct().collect())  # one number a record
        require(not recs or recs[0] >= 0, Code.EINVAL, "frame")
        moved = df.select(F.col("rec").cast("int").alias("rec"), "task", "k", "value").join(decomposition.map.where("goff IS NOT NULL"), ["task", "k"]).select("rec", "goff", "value")
        use, fill = self.catalog.var_fill(varid)
        if use:
            moved = moved.persist()
            value = F.col("value").cast(grid_type(self.catalog.var(varid).type).spark).alias("value")
            moved_all = moved.select("rec", "goff", value).unionByName(self._fill_grid(varid, recs, decomposition.size, fill).join(moved.select("rec", "goff"), ["rec", "goff"], "left_anti"))
            self._store(varid, moved_all, len(recs) * decomposition.size)
            moved.unpersist()
        else:
            self._store(varid, moved, len(recs) * decomposition.facts()[2])
        self.catalog.defining = False
        self._save()

    def read_frames(self, varid: int | str, decomposition: Decomposition) -> DataFrame:
        """(rec, task, k, value) of all records by a map without holes, in one join."""
        self._live()
        require(decomposition.size == prod(self.catalog.shape(varid)), Code.EINVAL, "the decomposition has another size than the variable")
        return self.table(varid).join(decomposition.map, "goff").select("rec", "task", "k", "value")

    def sync_later(self) -> Future:
        """Store what is queued in the background, so that the caller goes on computing; close waits for it."""
        self._live()
        self.pending.append(self.pool.submit(self.sync))
        return self.pending[-1]

    def read_darray(self, varid: int | str, decomposition: Decomposition, rec: int | None = None) -> DataFrame:
        """(task, k, value) of a record by a map; holes of the map give null."""
        self._live()
        require(decomposition.size == prod(self.catalog.shape(varid)), Code.EINVAL, "the decomposition has another size than the variable")
        data = self.table(varid, self._record(varid, rec)).select("goff", "value")
        return decomposition.map.join(data, "goff", "left").select("task", "k", "value")

    # Slices. A record variable's first index is its record.

    def _split(self, varid: int | str, start, count, stride):
        shape = self.catalog.shape(varid)
        if not self.catalog.is_record(varid):
            return (list(start), list(count), stride) if self.catalog.var(varid).dims else ([0], [1], None), None, shape
        require(len(start) == len(count) == len(self.catalog.var(varid).dims), Code.EINVAL, "slice rank")
        step = list(stride) if stride is not None else [1] * len(start)
        require(step[0] >= 1, Code.ESTRIDE)
        inner = (list(start[1:]), list(count[1:]), step[1:]) if len(start) > 1 else ([0], [1], None)
        return inner, (start[0], count[0], step[0]), shape

    def get_vars(self, varid: int | str, start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None = None, as_type: str | None = None) -> DataFrame:
        """(rec, goff, value) of a strided hyperslab, values converted to `as_type`."""
        self._live()
        inner, outer, shape = self._split(varid, start, count, stride)
        df = self.table(varid)
        if outer is not None:
            s, c, t = outer
            require(c == 0 or s + (c - 1) * t < self.num_records(varid), Code.EINVALCOORDS if s >= self.num_records(varid) else Code.EEDGE)
            df = df.where(F.col("rec").between(s, s + (c - 1) * t) & ((F.col("rec") - s) % t == 0))
        out = slices.hyperslab(df, shape, *inner)
        if as_type is not None:
            out = out.withColumn("value", converted(F.col("value"), grid_type(as_type), grid_type(self.catalog.var(varid).type)))
        return out.select("rec", "goff", "value")

    def get_vara(self, varid, start, count, as_type=None) -> DataFrame:
        return self.get_vars(varid, start, count, None, as_type)

    def get_var1(self, varid, index, as_type=None) -> DataFrame:
        return self.get_vars(varid, index, [1] * len(index), None, as_type)

    def get_var(self, varid, as_type=None) -> DataFrame:
        shape = list(self.catalog.shape(varid)) if self.catalog.var(varid).dims and not (self.catalog.is_record(varid) and len(self.catalog.var(varid).dims) == 1) else []
        if self.catalog.is_record(varid):
            shape = [self.num_records(varid), *shape]
        return self.get_vars(varid, [0] * len(shape), shape, None, as_type)

    def put_vars(self, varid, start, count, stride, df: DataFrame, from_type: str | None = None) -> None:
        """Merge `df` (k: row-major place in the slab, value) into a strided hyperslab; the rest of a record stays."""
        self._live()
        require(self.writable, Code.EPERM)
        self.sync()
        v = self.catalog.var(varid)
        inner, outer, shape = self._split(varid, start, count, stride)
        slices.checked(shape, inner[0], inner[1], inner[2])
        each = prod(inner[1])
        s, _, t = outer if outer is not None else (0, 1, 1)
        value = converted(F.col("value"), grid_type(v.type), grid_type(from_type) if from_type else None) if from_type else F.col("value")
        place = F.col("k").cast("bigint")
        new = df.select((F.floor(place / each) * t + s).cast("int").alias("rec"), slices.slab_offsets(place % each, shape, *inner).alias("goff"), value.cast(grid_type(v.type).spark).alias("value"))
        recs = [r[0] for r in new.select("rec").distinct().collect()]  # as many as the slab has records
        old = self.table(varid).where(F.col("rec").isin(recs)).select("rec", "goff", "value")
        use, fill = self.catalog.var_fill(varid)
        if use:
            there = {r[0] for r in old.select("rec").distinct().collect()}
            fresh = [r for r in recs if r not in there]
            old = old.unionByName(self._fill_grid(varid, fresh, prod(shape), fill)) if fresh else old
        merged = slices.upserted(old, new, ("rec", "goff"))
        stage = f"{self.path}/stage-{uuid.uuid4().hex}"  # a table can't be replaced by what is read from it
        merged.write.parquet(stage)
        merged = self.session.spark.read.parquet(stage)
        self._store(varid, merged, merged.count())
        files.delete(self.session.spark, stage)
        self._save()

    def put_vara(self, varid, start, count, df, from_type=None) -> None:
        self.put_vars(varid, start, count, None, df, from_type)

    def put_var1(self, varid, index, value, from_type=None) -> None:
        df = self.session.spark.createDataFrame([(0,)], "k bigint").withColumn("value", F.lit(value))
        self.put_vars(varid, index, [1] * len(index), None, df, from_type)

    def put_var(self, varid, df: DataFrame, from_type=None) -> None:
        shape = list(self.catalog.shape(varid)) if self.catalog.var(varid).dims else []
        if self.catalog.is_record(varid):
            last = df.agg(F.max("k")).first()[0]
            shape = [-(-(last + 1) // prod(shape)) if last is not None else 0, *(shape if len(self.catalog.var(varid).dims) > 1 else [])]
        self.put_vars(varid, [0] * len(shape), shape, None, df, from_type)

    def _same_type(self, varid, decomposition: Decomposition) -> None:
        require(self.catalog.var(varid).type == grid_type(decomposition.type).name, Code.EBADTYPE, "slices by decomposition don't convert")

    def get_vard(self, varid, decomposition: Decomposition, rec: int = 0) -> DataFrame:
        self._same_type(varid, decomposition)
        return self.read_darray(varid, decomposition, rec)

    def put_vard(self, varid, decomposition: Decomposition, rec: int, df: DataFrame) -> None:
        self._same_type(varid, decomposition)
        self.write_darray(varid, decomposition, df, rec=rec)
        self.sync()


__all__ = ["GLOBAL", "Dataset", "GridError"]
