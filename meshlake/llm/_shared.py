"""Helpers of this subpackage: table reading and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of local sessions that have set none.
_local: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`. Where it is unset, a session in one process (tests) gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='meshlake-')}")
        atexit.register(_remove_local, _local[0])
    return _local[0]


def _remove_local(root: str) -> None:
    import shutil

    shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: Folders of the tables that `kept` has made, in order.
_made: list[str] = []


def temporary(path: str) -> str:
    """`path`, which is deleted like the tables that `kept` makes."""
    if not _made:
        atexit.register(_delete_all)
    _made.append(path)
    return path


def kept(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again: it cuts lineage, and later readers don't compute it anew.

    Spark's commit protocol makes the write safe against lost executors and repeated tasks. The table stays until `released`
    or the end of the program deletes it.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    temporary(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _delete_all() -> None:
    spark = SparkSession.getActiveSession()
    while spark is not None and spark.sparkContext._jsc is not None and _made:
        path = _made.pop()
        with contextlib.suppress(Exception):  # the cluster may be gone by now
            _delete(spark, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a `temporary` path before the end."""
    _made.remove(path)
    _delete(spark, path)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete, at its end, the tables that were kept inside; results that need them must have been written by then."""
    first = len(_made)
    yield
    while len(_made) > first:
        _delete(spark, _made.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
