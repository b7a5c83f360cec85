"""Feature tables: rows are features, and each field is a 1-D variable over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Code, require
from ..operators.decomposition import Decomposition
from ..operators.slices import upserted
from ..types import converted, grid_type


class Features:
    """Fields of a table whose `fid` numbers its rows from 0."""

    def __init__(self, df: DataFrame, fid: str):
        require(fid in df.columns, Code.EBADDIM, fid)
        self.df, self.fid = df, fid

    @classmethod
    def load(cls, spark: SparkSession, path: str, fid: str, format: str = "parquet", **options) -> Features:
        return cls(spark.read.format(format).options(**options).load(path), fid)

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c != self.fid]

    def field_id(self, name: str) -> int:
        require(name in self.fields, Code.ENOTVAR, name)
        return self.fields.index(name)

    def _name(self, field: int | str) -> str:
        name = self.fields[field] if isinstance(field, int) and 0 <= field < len(self.fields) else field
        require(name in self.fields, Code.ENOTVAR, str(field))
        return name

    def field(self, field: int | str, as_type: str | None = None) -> DataFrame:
        """(goff, value) of one field."""
        value = F.col(self._name(field))
        return self.df.select(F.col(self.fid).cast("bigint").alias("goff"), (converted(value, grid_type(as_type)) if as_type else value).alias("value"))

    def read_darray(self, field: int | str, decomposition: Decomposition) -> DataFrame:
        return decomposition.map.join(self.field(field), "goff", "left").select("task", "k", "value")

    def def_field(self, name: str, type_name: str) -> Features:
        require(name not in self.df.columns, Code.ENAMEINUSE, name)
        return Features(self.df.withColumn(name, F.lit(None).cast(grid_type(type_name).spark)), self.fid)

    def write_field(self, field: int | str, values: DataFrame) -> Features:
        """A field with the values of (goff, value) in place of its own."""
        name = self._name(field)
        new = upserted(self.field(name), values.select(F.col("goff").cast("bigint").alias("goff"), F.col("value").cast(self.df.schema[name].dataType).alias("value")))
        new = new.select(F.col("goff").alias("__goff"), F.col("value").alias("__value"))
        joined = self.df.join(new, F.col(self.fid) == F.col("__goff"), "left")
        return Features(joined.select(*[F.col("__value").alias(c) if c == name else F.col(c) for c in self.df.columns]), self.fid)
