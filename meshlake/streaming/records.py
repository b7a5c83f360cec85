"""Records as a stream: each micro-batch is one record of a variable.

A record is replaced whole, and its number follows from the batch's, so a batch that is replayed after a failure writes
the same record again instead of another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.decomposition import Decomposition
from ..sources.dataset import Dataset
from ..types import grid_type


def append_records(stream: DataFrame, dataset: Dataset, varid: int | str, decomposition: Decomposition, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch of `stream` (task, k, value) as the next record, after those there are now."""
    first = dataset.num_records(varid)

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        dataset.write_darray(varid, decomposition, batch.select("task", "k", "value"), rec=first + number)
        dataset.sync()
        dataset.set_frame(varid, first + number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_records(dataset: Dataset, varid: int | str) -> DataFrame:
    """A stream of (goff, value, rec) of a variable's records as they are added."""
    v = dataset.catalog.var(varid)
    kind = grid_type(v.type).spark.simpleString()
    return dataset.session.spark.readStream.schema(f"goff bigint, value {kind}, rec int").parquet(dataset._folder(varid))


def frames(df: DataFrame, at: str, origin: str) -> DataFrame:
    """`df` with rec: whole days from `origin` to the timestamp `at`."""
    return df.withColumn("rec", F.datediff(F.col(at), F.lit(origin).cast("timestamp")))
