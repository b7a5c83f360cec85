"""Decomposition files: a text form and a pair of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Code, require
from ..operators.decomposition import Decomposition
from . import files

# The formats' version and names.
TEXT_VERSION = 2001
C_ORDER, FORTRAN_ORDER = "C", "Fortran"
HEADER = "version string, max_maplen int, title string, history string, source string, array_order string, dims int, task int, map_element int, global_size array<int>, maplen array<int>"


def write_text_map(decomposition: Decomposition, path: str) -> None:
    """A folder of text parts, in order: header, sizes, then for each rank a line `rank maplen` and a line of 1-based offsets, 0 for holes."""
    spark = decomposition.map.sparkSession
    lists = decomposition.map.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("k", (F.coalesce("goff", F.lit(-1)) + 1).alias("g")))).alias("m"))
    rows = lists.select("task", F.concat_ws(" ", "task", F.size("m")).alias("a"), F.concat(F.array_join(F.transform("m", lambda x: x["g"].cast("string")), " "), F.lit(" ")).alias("b"))
    ranks = decomposition.map.agg(F.max("task") + 1).first()[0] or 0
    head = f"version {TEXT_VERSION} npes {ranks} ndims {len(decomposition.dims)} \n" + "".join(f"{n} " for n in decomposition.dims)
    text = rows.select("task", F.concat_ws("\n", "a", "b").alias("value")).unionByName(spark.createDataFrame([(-1, head)], "task int, value string"))
    text.orderBy("task").select("value").write.mode("overwrite").text(path)


def read_text_map(spark: SparkSession, path: str, num_compute: int | None = None, **rest) -> Decomposition:
    """Ranks of the file may be fewer than `num_compute`, not more. Each rank's offsets are one line."""
    lines = spark.read.text(path, wholetext=False).where("value <> ''").select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), F.trim("value").alias("v"))
    first = lines.where(F.col("v").startswith("version ")).select("f", "i", F.split("v", " ").alias("w")).first()
    require(first is not None, Code.EINVAL, "no header")
    ranks, ndims = int(first["w"][3]), int(first["w"][5])
    require(num_compute is None or ranks <= num_compute, Code.EINVAL, "the file has more ranks")
    from pyspark.sql import Window

    parts = lines.withColumn("before", F.lag("v").over(Window.partitionBy("f").orderBy("i")))
    sizes = parts.where((F.col("f") == first["f"]) & F.col("before").startswith("version ")).first()
    dims = tuple(int(x) for x in sizes["v"].split())
    require(len(dims) == ndims, Code.EINVAL, "sizes")
    maps = parts.where(F.col("before").rlike(r"^\d+ \d+$") & (F.col("i") != sizes["i"])).select(F.split("before", " ").alias("h"), F.split("v", r"\s+").alias("m"))
    maps = maps.where(F.size("m") == F.col("h")[1].cast("int")).select(F.col("h")[0].cast("int").alias("task"), F.posexplode("m").alias("k", "goff"))
    return Decomposition.of(maps, dims, base=1, **rest)


def write_tables(decomposition: Decomposition, path: str, title: str = "", history: str = "", source: str = "meshlake", order: str = C_ORDER) -> None:
    """`path`/header (one row) and `path`/map (task, map_element, map: 0-based, -1 for holes)."""
    require(order in (C_ORDER, FORTRAN_ORDER), Code.EINVAL, order)
    spark = decomposition.map.sparkSession
    decomposition.map.select("task", F.col("k").cast("int").alias("map_element"), F.coalesce("goff", F.lit(-1)).alias("map")).write.mode("overwrite").parquet(f"{path}/map")
    sizes = {r["task"]: r["maplen"] for r in decomposition.local_sizes().collect()}  # one number a rank
    ranks = max(sizes, default=-1) + 1
    lens = [sizes.get(t, 0) for t in range(ranks)]
    row = ("1.0", max(lens, default=0), title, history, source, order, len(decomposition.dims), ranks, max(lens, default=0), list(decomposition.dims), lens)
    spark.createDataFrame([row], HEADER).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def read_header(spark: SparkSession, path: str) -> dict:
    require(files.exists(spark, f"{path}/header"), Code.ECANTREAD, path)
    return spark.read.schema(HEADER).parquet(f"{path}/header").first().asDict()


def read_tables(spark: SparkSession, path: str, num_compute: int | None = None, **rest) -> Decomposition:
    """The number of ranks must be `num_compute`, where that is given."""
    head = read_header(spark, path)
    require(num_compute is None or head["task"] == num_compute, Code.EINVAL, "another number of ranks")
    df = spark.read.parquet(f"{path}/map").select("task", F.col("map_element").alias("k"), F.col("map").alias("goff"))
    return Decomposition.of(df, head["global_size"], base=0, **rest)


def summary(df: DataFrame) -> DataFrame:
    """(task, maplen, map) of a map's ranks."""
    return df.groupBy("task").agg(F.count("*").alias("maplen"), F.transform(F.sort_array(F.collect_list(F.struct("k", "goff"))), lambda x: x["goff"]).alias("map"))
