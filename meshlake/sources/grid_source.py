"""Datasets as a Spark data source, by variable.

    spark.dataSource.register(GridSource)
    spark.read.format("grid").option("variable", "t").load(path)
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalog import Catalog
from ..errors import Code, require
from ..types import grid_type


def _store(path: str):
    from pyarrow import fs

    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _catalog(path: str) -> Catalog:
    store, inner = _store(path)
    with store.open_input_stream(f"{inner}/catalog.json") as f:
        return Catalog.from_json(json.loads(f.read().decode()))


@dataclass
class Piece(InputPartition):
    file: str
    rec: int


class GridReader(DataSourceReader):
    def __init__(self, path: str, variable: str):
        self.path = path
        v = _catalog(path).var(variable)
        self.folder, self.written, self.kind = v.storage.get("folder", v.name), v.written, v.type

    def partitions(self) -> list[Piece]:
        from pyarrow import fs

        if not self.written:
            return [Piece("", 0)]
        store, inner = _store(self.path)
        found = store.get_file_info(fs.FileSelector(f"{inner}/vars/{self.folder}", recursive=True))
        return [Piece(f.path, int(f.path.rsplit("rec=", 1)[1].split("/")[0])) for f in found if f.path.endswith(".parquet")] or [Piece("", 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.file:
            return
        store, _ = _store(self.path)
        for b in ds.dataset(piece.file, filesystem=store, format="parquet").to_batches(columns=["goff", "value"]):
            yield pa.record_batch([pa.array([piece.rec] * len(b), pa.int32()), b.column("goff"), b.column("value")], names=["rec", "goff", "value"])


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        v = _catalog(self.options["path"]).var(self.options["variable"])
        require(bool(v), Code.ENOTVAR)
        return f"rec int, goff bigint, value {grid_type(v.type).spark.simpleString()}"

    def reader(self, schema) -> GridReader:
        return GridReader(self.options["path"], self.options["variable"])
