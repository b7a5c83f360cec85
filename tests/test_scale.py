"""What one task is dealt stays the same however large the array is. Tasks are made small here, so that small arrays need many."""

import pytest
from pyspark.sql import functions as F

from meshlake.catalog import UNLIMITED
from meshlake.functions.layout import box_split
from meshlake.operators import decomposition, rearrange
from meshlake.operators.decomposition import Decomposition
from meshlake.plans import catalogue
from meshlake.session import BOX, SUBSET, GridSession, scratch_path
from meshlake.sources.dataset import Dataset


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(decomposition, "TASK_CELLS", 400, raising=False)


def by_file(df):
    return [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]


def test_record_stream_deals_no_record_to_one_task(spark, tmp_path, monkeypatch, small):
    spark.range(998).select(F.col("id").alias("event_id"), (F.col("id") * 0.5).alias("value")).where("event_id != 300").unionByName(
        spark.createDataFrame([(998, 499.0)], "event_id bigint, value double")
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalogue, "scratch_path", lambda _, tag: f"file://{tmp_path}/{tag}")
    got = catalogue.record_stream(spark, str(tmp_path))
    each = 250
    want = [(i // each, i % each, i * 0.5 if i < 999 and i != 300 else catalogue.TYPES["double"].fill) for i in range(4 * each)]
    assert sorted(map(tuple, got.collect())) == want
    assert max(by_file(spark.read.parquet(f"file://{tmp_path}/source"))) <= 100
    assert max(by_file(got)) <= 160


def test_fill_holes_deals_no_rank_to_one_task(spark, tmp_path, monkeypatch, small):
    spark.range(1000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(3000).select((F.col("id") % 1000).alias("l_orderkey"), F.lit(2.0).alias("l_quantity")).where("l_orderkey % 7 != 3")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(catalogue, "scratch_path", lambda _, tag: f"file://{tmp_path}/{tag}")
    got = catalogue.fill_holes(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(i, catalogue.FILL if i % 7 == 3 else 6) for i in range(1000)]
    assert max(by_file(got)) <= 266


@pytest.mark.parametrize("rearranger", [BOX, SUBSET])
@pytest.mark.parametrize("use", [True, False])
def test_frames_in_many_tasks(spark, small, rearranger, use):
    """Two records of two variables by a map with holes: each file is of few rows, in order of offset by rank."""
    session = GridSession(spark, 4, 2, blocksize=257)
    ds = Dataset.create(session, scratch_path(spark, "grid"))
    t, x = ds.def_dim("t", UNLIMITED), ds.def_dim("x", 900)
    for name in "ab":
        ds.def_var(name, "double", [t, x])
        ds.def_var_fill(name, use, -1.0)
    ds.enddef()
    keys = spark.range(900).where("id % 5 != 1").select((F.col("id") % 4).alias("task"), F.floor(F.col("id") / 4).alias("k"), F.col("id").alias("goff"))
    d = Decomposition.of(keys, (900,), rearranger=rearranger)
    for rec in range(2):
        ds.write_darray_multi(["a", "b"], d, d.map.select("task", "k", (F.col("goff") + rec * 0.5).alias("a"), (-F.col("goff") - rec * 0.5).alias("b")), recs=[rec, rec])
    ds.sync()
    for name, sign in (("a", 1), ("b", -1)):
        rows = ds.table(name).select("rec", "goff", "value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
        want = [(rec, g, sign * (g + rec * 0.5) if g % 5 != 1 else -1.0) for rec in range(2) for g in range(900) if use or g % 5 != 1]
        assert sorted((r.rec, r.goff, r.value) for r in rows) == want
        for f in {r.f for r in rows}:
            own = [r.goff for r in rows if r.f == f]
            assert sum(a > b for a, b in zip(own, own[1:])) <= (rearranger == SUBSET) and len(own) <= 266


def test_to_io_cuts_ranks_of_large_arrays(spark, small):
    session = GridSession(spark, 4, 2, blocksize=257)
    d = Decomposition.round_robin(session, (800,))
    moved = rearrange.to_io(rearrange.assigned(session, d).select("goff", "io"), 2, 800).withColumn("part", F.spark_partition_id())
    parts = moved.groupBy("part").agg(F.count("*").alias("n"), F.min("goff").alias("low"), F.max("goff").alias("high")).orderBy("low").collect()
    assert len(box_split("double", (800,), 2, 257)) == 2
    assert max(r.n for r in parts) <= 400 and all(a.high < b.low for a, b in zip(parts, parts[1:]))
