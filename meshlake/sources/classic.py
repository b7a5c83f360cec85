"""Classic array files (CDF-1, CDF-2, CDF-5) as a Spark data source: (rec, goff, value) of one variable, read in ranges.

    spark.dataSource.register(ClassicSource)
    spark.read.format("classic").option("variable", "t").load(path)
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import Code, GridError, require

# The format's type numbers.
_FORMS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_SPARK = {1: "tinyint", 2: "string", 3: "smallint", 4: "int", 5: "float", 6: "double", 7: "smallint", 8: "int", 9: "bigint", 10: "bigint", 11: "decimal(20,0)"}
RANGE = 1 << 20


def open_path(path: str) -> BinaryIO:
    if path.startswith(("/", "file:")):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


@dataclass
class ClassicVar:
    name: str
    dims: list[int]
    type: int
    begin: int
    atts: dict


@dataclass
class Header:
    dims: list[tuple[str, int]]
    atts: dict
    variables: list[ClassicVar]
    records: int

    def var(self, name: str) -> ClassicVar:
        found = next((v for v in self.variables if v.name == name), None)
        require(found is not None, Code.ENOTVAR, name)
        return found

    def is_record(self, v: ClassicVar) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def shape(self, v: ClassicVar) -> list[int]:
        return [self.dims[d][1] for d in v.dims[int(self.is_record(v)) :]]

    def record_bytes(self) -> int:
        sizes = [prod(self.shape(v)) * np.dtype(_FORMS[v.type]).itemsize for v in self.variables if self.is_record(v)]
        return sizes[0] if len(sizes) == 1 else sum(-(-s // 4) * 4 for s in sizes)  # a single record variable is not padded


def read_header(file: BinaryIO) -> Header:
    def raw(n: int) -> bytes:
        data = file.read(n)
        require(len(data) == n, Code.ETRUNC)
        return data

    magic = raw(4)
    require(magic[:3] == b"CDF" and magic[3] in (1, 2, 5), Code.ENOTNC)
    wide = magic[3] == 5

    def count() -> int:
        return struct.unpack(">Q" if wide else ">I", raw(8 if wide else 4))[0]

    def word() -> int:
        return struct.unpack(">I", raw(4))[0]

    def name() -> str:
        n = count()
        return raw(-(-n // 4) * 4)[:n].decode()

    def entries(tag: int) -> int:
        kind, n = word(), count()
        require(kind == tag or (kind == 0 and n == 0), Code.ENOTNC, "list tag")
        return n

    def attributes() -> dict:
        out = {}
        for _ in range(entries(12)):
            key, kind, n = name(), word(), count()
            form = np.dtype(_FORMS[kind])
            data = raw(-(-n * form.itemsize // 4) * 4)[: n * form.itemsize]
            out[key] = data.decode("utf-8", "replace") if kind == 2 else np.frombuffer(data, form).tolist()
        return out

    records = count()
    dims = [(name(), count()) for _ in range(entries(10))]
    atts = attributes()
    variables = []
    for _ in range(entries(11)):
        label, ids = name(), [count() for _ in range(count())]
        own, kind, _ = attributes(), word(), count()
        variables.append(ClassicVar(label, ids, kind, struct.unpack(">I" if magic[3] == 1 else ">Q", raw(4 if magic[3] == 1 else 8))[0], own))
    out = Header(dims, atts, variables, records)
    if records == (2**64 - 1 if wide else 2**32 - 1):  # written as a stream: count what is there
        first = min((v.begin for v in variables if out.is_record(v)), default=0)
        out.records = (file.seek(0, 2) - first) // max(1, out.record_bytes())
    return out


@dataclass
class Range(InputPartition):
    rec: int
    first: int
    count: int
    at: int


class ClassicReader(DataSourceReader):
    def __init__(self, path: str, variable: str):
        self.path = path
        with open_path(path) as f:
            self.header = read_header(f)
        self.variable = self.header.var(variable)

    def partitions(self) -> list[Range]:
        v, size = self.variable, np.dtype(_FORMS[self.variable.type]).itemsize
        n, record = prod(self.header.shape(v)), self.header.is_record(v)
        out = []
        for rec in range(self.header.records if record else 1):
            at = v.begin + (rec * self.header.record_bytes() if record else 0)
            out += [Range(rec, i, min(RANGE, n - i), at + i * size) for i in range(0, n, RANGE)]
        return out or [Range(0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        form = np.dtype(_FORMS[self.variable.type])
        with open_path(self.path) as f:
            f.seek(part.at)
            data = f.read(part.count * form.itemsize)
        if len(data) < part.count * form.itemsize:
            raise GridError(Code.ETRUNC)
        x = np.frombuffer(data, form)
        if self.variable.type == 2:
            value = pa.array([c.decode("latin-1") for c in x.tolist()], pa.string())
        elif self.variable.type == 11:
            from decimal import Decimal

            value = pa.array([Decimal(int(c)) for c in x], pa.decimal128(20, 0))
        else:
            to = {7: "i2", 8: "i4", 9: "i8"}.get(self.variable.type, form.newbyteorder("=").str)
            value = pa.array(x.astype(to))
        yield pa.record_batch([pa.array(np.full(part.count, part.rec, np.int32)), pa.array(np.arange(part.first, part.first + part.count, dtype=np.int64)), value], names=["rec", "goff", "value"])


class ClassicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "classic"

    def schema(self) -> str:
        with open_path(self.options["path"]) as f:
            header = read_header(f)
        return f"rec int, goff bigint, value {_SPARK[header.var(self.options['variable']).type]}"

    def reader(self, schema) -> ClassicReader:
        return ClassicReader(self.options["path"], self.options["variable"])
