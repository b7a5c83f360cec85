"""Decomposition files, classic files, feature tables, the data source and record streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.catalog import UNLIMITED
from meshlake.errors import Code, GridError
from meshlake.operators.decomposition import Decomposition
from meshlake.session import GridSession
from meshlake.sources import decomp_files
from meshlake.sources.classic import ClassicSource, open_path, read_header
from meshlake.sources.dataset import Dataset
from meshlake.sources.features import Features
from meshlake.sources.grid_source import GridSource
from meshlake.streaming.records import append_records, read_records

MAPS = [[0, 3, -1], [1, 2], [5]]


def listed(d):
    return sorted((r.task, r.k, r.goff) for r in d.map.collect() if r.goff is not None), d.map.count(), d.dims


def test_text_map(spark, tmp_path):
    d = Decomposition.from_lists(spark, MAPS, [2, 3])
    decomp_files.write_text_map(d, f"file://{tmp_path}/map")
    assert listed(decomp_files.read_text_map(spark, f"file://{tmp_path}/map", 4)) == listed(d)
    with pytest.raises(GridError):
        decomp_files.read_text_map(spark, f"file://{tmp_path}/map", 2)


def test_text_map_of_one_file(spark, tmp_path):
    (tmp_path / "map.txt").write_text("version 2001 npes 2 ndims 2 \n2 3 \n0 3\n1 4 0 \n1 2\n2 3 \n\n")
    d = decomp_files.read_text_map(spark, f"file://{tmp_path}/map.txt")
    assert listed(d)[0] == [(0, 0, 0), (0, 1, 3), (1, 0, 1), (1, 1, 2)]


def test_table_map(spark, tmp_path):
    d = Decomposition.from_lists(spark, MAPS, [2, 3])
    decomp_files.write_tables(d, f"file://{tmp_path}/map", title="t")
    assert listed(decomp_files.read_tables(spark, f"file://{tmp_path}/map", 3)) == listed(d)
    head = decomp_files.read_header(spark, f"file://{tmp_path}/map")
    assert (head["maplen"], head["max_maplen"], head["array_order"]) == ([3, 2, 1], 3, "C")
    with pytest.raises(GridError) as e:
        decomp_files.read_tables(spark, f"file://{tmp_path}/map", 4)
    assert e.value.code == Code.EINVAL


def classic(version: int, records: int) -> bytes:
    """A file with fixed variable `v` (short, 2 x 3) and record variables `r` (double, 2) and `s` (short, 1)."""
    number = (lambda n: struct.pack(">Q", n)) if version == 5 else (lambda n: struct.pack(">I", n))
    at = (lambda n: struct.pack(">I", n)) if version == 1 else (lambda n: struct.pack(">Q", n))
    name = lambda s: number(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    tag = lambda t, n: struct.pack(">I", t) + number(n)
    dims = tag(10, 3) + name("t") + number(0) + name("y") + number(2) + name("x") + number(3)
    atts = tag(12, 1) + name("title") + struct.pack(">I", 2) + number(2) + b"hi\0\0"

    def variable(label, ids, kind, size, begin):
        return name(label) + number(len(ids)) + b"".join(map(number, ids)) + tag(0, 0) + struct.pack(">I", kind) + number(size) + at(begin)

    def head(a, b, c):
        return b"CDF" + bytes([version]) + number(records) + dims + atts + tag(11, 3) + variable("v", [1, 2], 3, 12, a) + variable("r", [0, 1], 6, 16, b) + variable("s", [0], 3, 4, c)

    n = len(head(0, 0, 0))
    out = head(n, n + 12, n + 28) + np.arange(6, dtype=">i2").tobytes()
    for rec in range(records):
        out += np.array([rec, rec + 0.5], ">f8").tobytes() + np.array([rec * 10, 0], ">i2").tobytes()
    return out


@pytest.mark.parametrize("version", [1, 2, 5])
def test_classic(spark, tmp_path, version):
    path = tmp_path / "a.nc"
    path.write_bytes(classic(version, 3))
    spark.dataSource.register(ClassicSource)
    load = lambda v: {(r.rec, r.goff): r.value for r in spark.read.format("classic").option("variable", v).load(str(path)).collect()}
    assert load("v") == {(0, i): i for i in range(6)}
    assert load("r") == {(k, i): k + 0.5 * i for k in range(3) for i in range(2)}
    assert load("s") == {(k, 0): 10 * k for k in range(3)}
    with open_path(str(path)) as f:
        assert read_header(f).atts == {"title": "hi"}
    path.write_bytes(b"not it")
    with pytest.raises(GridError), open_path(str(path)) as f:
        read_header(f)


def test_features(spark):
    f = Features(spark.createDataFrame([(0, "a", 1.5), (1, "b", 2.5)], "fid int, name string, area double"), "fid")
    assert f.fields == ["name", "area"]
    assert f.field_id("area") == 1
    with pytest.raises(GridError):
        f.field("nope")
    g = f.def_field("n", "int").write_field("n", spark.createDataFrame([(1, 7)], "goff int, value int"))
    assert [tuple(r) for r in g.df.orderBy("fid").collect()] == [(0, "a", 1.5, None), (1, "b", 2.5, 7)]
    assert {r.goff: r.value for r in f.field("area", "int").collect()} == {0: 1, 1: 2}


def test_stream_and_source(spark, tmp_path):
    session = GridSession(spark, 2, 1)
    ds = Dataset.create(session, f"file://{tmp_path}/grid")
    ds.def_var("v", "double", [ds.def_dim("t", UNLIMITED), ds.def_dim("x", 4)])
    ds.enddef()
    d = Decomposition.block(session, (4,))
    source, checkpoint = f"file://{tmp_path}/in", f"file://{tmp_path}/cp"
    schema = "task int, k bigint, value double"

    def batch(n):
        d.map.select("task", "k", (F.col("goff") + 10.0 * n).alias("value")).coalesce(1).write.mode("append").parquet(source)

    batch(0)
    batch(1)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    append_records(stream(), ds, "v", d, checkpoint).awaitTermination()
    assert ds.num_records("v") == 2
    spark.dataSource.register(GridSource)
    got = spark.read.format("grid").option("variable", "v").load(f"{tmp_path}/grid")
    assert sorted(tuple(r) for r in got.collect()) == [(n, i, i + 10.0 * n) for n in range(2) for i in range(4)]
    q = read_records(ds, "v").groupBy("rec").count().writeStream.format("memory").queryName("recs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM recs").collect()) == [(0, 4), (1, 4)]
