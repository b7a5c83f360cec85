"""Round trips, fills, records, slices and refusals of array datasets."""

import pytest
from pyspark.sql import functions as F

from meshlake.catalog import GLOBAL, MAX_NAME, UNLIMITED
from meshlake.errors import Code, GridError, Handler
from meshlake.operators import rearrange
from meshlake.operators.decomposition import Decomposition
from meshlake.session import BOX, SUBSET, GridSession, RearrangerOptions
from meshlake.sources.dataset import Dataset
from meshlake.types import TYPES


@pytest.fixture
def session(spark):
    return GridSession(spark, 4, 2, blocksize=264)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/grid"


def code(f, *args, **kwargs):
    with pytest.raises(GridError) as e:
        f(*args, **kwargs)
    return e.value.code


def local(spark, lists, kind="double"):
    return spark.createDataFrame([(t, k, v) for t, row in enumerate(lists) for k, v in enumerate(row)], f"task int, k bigint, value {kind}")


def pairs(df):
    return dict(df.select("goff", "value").collect())


def test_uneven_fill_and_holes(spark, session, path):
    """Odd elements only are written, 7 for each of 4 ranks; the others hold the fill value; reading everything sees both."""
    maps = [[r * 7 + i if i % 2 else -1 for i in range(7)] for r in range(4)]
    for rearranger in (BOX, SUBSET):
        ds = Dataset.create(session, path)
        ds.def_var("v", "int", [ds.def_dim("x", 28)])
        ds.enddef()
        d = Decomposition.from_lists(spark, maps, [28], type="int", rearranger=rearranger)
        ds.write_darray("v", d, local(spark, [[100 + r * 7 + i for i in range(7)] for r in range(4)], "int"))
        ds.close()
        ds = Dataset.open(session, path)
        got = pairs(ds.get_var("v"))
        assert got == {r * 7 + i: 100 + r * 7 + i if i % 2 else TYPES["int"].fill for r in range(4) for i in range(7)}
        back = ds.read_darray("v", d).collect()
        assert all((r.value is None) == (r.k % 2 == 0) for r in back)


def test_explicit_fill_and_multi(spark, session, path):
    ds = Dataset.create(session, path)
    x = ds.def_dim("x", 8)
    ds.def_var("a", "double", [x])
    ds.def_var("b", "double", [x])
    ds.def_var_fill("b", True, -1.0)
    ds.enddef()
    d = Decomposition.from_lists(spark, [[0, 2], [4, 6]], [8])
    df = spark.createDataFrame([(0, 0, 1.0, 5.0), (0, 1, 2.0, 6.0), (1, 0, 3.0, 7.0), (1, 1, 4.0, 8.0)], "task int, k bigint, a double, b double")
    ds.write_darray_multi(["a", "b"], d, df, flush=True)
    assert pairs(ds.get_var("a"))[1] == TYPES["double"].fill
    assert pairs(ds.get_var("b")) == {0: 5.0, 1: -1.0, 2: 6.0, 3: -1.0, 4: 7.0, 5: -1.0, 6: 8.0, 7: -1.0}
    assert code(ds.write_darray, "b", d, df.select("task", "k", F.col("b").alias("value")), fill=0.0) == Code.EINVAL
    assert code(ds.def_var_fill, "a", True, 1.0) == Code.ELATEFILL


def test_types_round_trip(spark, session, path):
    ds = Dataset.create(session, path)
    x = ds.def_dim("x", 8)
    d = Decomposition.block(session, (8,))
    for name, t in TYPES.items():
        ds.def_var(f"v_{name}", name, [x])
    ds.enddef()
    for name, t in TYPES.items():
        values = d.map.select("task", "k", (F.col("goff") % 100).cast(t.spark).alias("value"))
        ds.write_darray(f"v_{name}", d, values)
    ds.close()
    ds = Dataset.open(session, path)
    for name, t in TYPES.items():
        df = ds.get_var(f"v_{name}")
        assert df.schema["value"].dataType == t.spark
        assert {int(r.goff): int(r.value) for r in df.collect()} == {i: i for i in range(8)}


def test_records(spark, session, path):
    ds = Dataset.create(session, path)
    t, y, x = ds.def_dim("t", UNLIMITED), ds.def_dim("y", 4), ds.def_dim("x", 4)
    ds.def_var("v", "double", [t, y, x])
    ds.enddef()
    d = Decomposition.block(session, (4, 4))
    for rec in range(2):
        ds.advance_frame("v")
        ds.write_darray("v", d, d.map.select("task", "k", (F.col("goff") + 100 * rec).cast("double").alias("value")))
    ds.close()
    ds = Dataset.open(session, path, writable=True)
    assert ds.num_records("v") == 2
    assert ds.read_darray("v", d).agg(F.sum("value")).first()[0] == sum(range(16))  # no frame set: the first
    ds.set_frame("v", 2)
    ds.write_darray("v", d, d.map.select("task", "k", F.lit(7.0).alias("value")))
    ds.sync()
    assert ds.num_records("v") == 3
    got = {(r.rec, r.goff): r.value for r in ds.get_vars("v", [0, 1, 0], [2, 2, 2], [2, 2, 3]).collect()}
    assert got == {(0, 4): 4.0, (0, 7): 7.0, (0, 12): 12.0, (0, 15): 15.0, (2, 4): 7.0, (2, 7): 7.0, (2, 12): 7.0, (2, 15): 7.0}
    assert code(ds.get_vara, "v", [3, 0, 0], [1, 1, 1]) == Code.EINVALCOORDS


def test_partial_write_replaces_but_slab_merges(spark, session, path):
    ds = Dataset.create(session, path)
    ds.def_var("v", "int", [ds.def_dim("x", 4)])
    ds.enddef()
    whole, part = Decomposition.block(session, (4,)), Decomposition.from_lists(spark, [[1]], [4])
    ds.write_darray("v", whole, whole.map.select("task", "k", F.lit(1).alias("value")))
    ds.sync()
    ds.put_vara("v", [2], [2], spark.createDataFrame([(0, 8), (1, 9)], "k int, value int"))
    assert pairs(ds.get_var("v")) == {0: 1, 1: 1, 2: 8, 3: 9}
    ds.write_darray("v", part, spark.createDataFrame([(0, 0, 5)], "task int, k bigint, value int"))
    ds.sync()
    assert pairs(ds.get_var("v")) == {i: 5 if i == 1 else TYPES["int"].fill for i in range(4)}


def test_scalar_and_conversion(spark, session, path):
    ds = Dataset.create(session, path)
    ds.def_var("s", "double", [])
    ds.def_var("v", "double", [ds.def_dim("x", 2)])
    ds.enddef()
    ds.put_var1("s", [], 2.75)
    assert pairs(ds.get_var("s", "int")) == {0: 2}
    ds.put_var("v", spark.createDataFrame([(0, -2.75), (1, 300.0)], "k int, value double"))
    assert pairs(ds.get_var("v", "short")) == {0: -2, 1: 300}
    with pytest.raises(Exception, match="ERANGE"):
        ds.get_var("v", "byte").collect()
    assert code(ds.get_var, "v", "string") == Code.ECHAR


def test_slice_refusals(spark, session, path):
    ds = Dataset.create(session, path)
    ds.def_var("v", "int", [ds.def_dim("y", 4), ds.def_dim("x", 4)])
    ds.enddef()
    assert code(ds.get_vara, "v", [4, 0], [1, 1]) == Code.EINVALCOORDS
    assert code(ds.get_vara, "v", [2, 0], [3, 1]) == Code.EEDGE
    assert code(ds.get_vars, "v", [0, 0], [1, 1], [0, 1]) == Code.ESTRIDE
    assert code(ds.get_vara, "v", [0], [1]) == Code.EINVAL
    assert code(ds.get_var, "w") == Code.ENOTVAR
    assert ds.get_vara("v", [0, 0], [0, 4]).count() == 0


def test_write_refusals(spark, session, path):
    ds = Dataset.create(session, path)
    ds.def_var("v", "double", [ds.def_dim("x", 8)])
    ds.enddef()
    d = Decomposition.block(session, (8,))
    full = d.map.select("task", "k", F.lit(1.0).alias("value"))
    assert code(ds.write_darray, "v", d, full.where("k = 0")) == Code.EINVAL
    assert code(ds.write_darray, "nope", d, full) == Code.ENOTVAR
    assert code(ds.write_darray, "v", Decomposition.block(session, (9,)), full) == Code.EINVAL
    assert code(ds.write_darray, "v", Decomposition.from_lists(spark, [[0, 0]], [8], rearranger=SUBSET, readonly=True), full) == Code.EINVAL
    twice = Decomposition.from_lists(spark, [[0, 0]], [8])
    ds.write_darray("v", twice, local(spark, [[1.0, 2.0]]))
    assert code(ds.sync) == Code.EINVAL
    assert code(ds.put_vard, "v", Decomposition.block(session, (8,), type="int"), 0, full) == Code.EBADTYPE
    ds.queue.clear()
    ds.close()
    assert code(ds.get_var, "v") == Code.EBADID
    readonly = Dataset.open(session, path)
    assert code(readonly.write_darray, "v", d, full) == Code.EPERM
    assert code(readonly.def_dim, "z", 3) == Code.EPERM


def test_files(spark, session, path):
    Dataset.create(session, path).close()
    assert code(Dataset.create, session, path, clobber=False) == Code.EEXIST
    assert code(Dataset.create, session, path, "pdf") == Code.EBADIOTYPE
    assert code(Dataset.open, session, path, "netcdf", strict=True) == Code.ENOTNC
    assert Dataset.open(session, path, "netcdf").format == "netcdf4p"
    Dataset.remove(session, path)
    assert code(Dataset.open, session, path) == Code.ECANTREAD


def test_catalog(spark, session, path):
    ds = Dataset.create(session, path, "netcdf")
    t = ds.def_dim("time", UNLIMITED)
    x = ds.def_dim("x", 3)
    assert code(ds.def_dim, "x", 4) == Code.ENAMEINUSE
    assert code(ds.def_dim, "y", -1) == Code.EDIMSIZE
    assert code(ds.def_dim, "t2", UNLIMITED) == Code.EUNLIMIT
    assert code(ds.def_dim, "n" * (MAX_NAME + 1), 1) == Code.EMAXNAME
    assert code(ds.def_var, "v", "int64", [x]) == Code.EBADTYPE
    assert code(ds.def_var, "v", "int", [x, t]) == Code.EINVAL
    assert code(ds.def_var, "v", "int", [9]) == Code.EBADDIM
    v = ds.def_var("v", "int", [t, x])
    ds.put_att(v, "a", "short", [1, 2])
    assert code(ds.put_att, v, "b", "byte", [300]) == Code.ERANGE
    assert code(ds.get_att, v, "a", "string") == Code.ECHAR
    assert ds.get_att("v", "a", "double") == [1.0, 2.0]
    ds.put_att(GLOBAL, "title", "char", "x")
    ds.rename_att(v, "a", "c")
    assert ds.att_names(v) == ["c"]
    assert code(ds.get_att, v, "a") == Code.ENOTATT
    ds.del_att(v, "c")
    ds.enddef()
    assert code(ds.enddef) == Code.ENOTINDEFINE
    assert code(ds.def_dim, "late", 2) == Code.ENOTINDEFINE
    ds.redef()
    assert code(ds.redef) == Code.EINDEFINE
    assert code(ds.storage, "v", deflate=1) == Code.ENOTNC4
    assert ds.inquire() == {"ndims": 2, "nvars": 1, "ngatts": 1, "unlimdimids": [0], "unlimdimid": 0, "format": "netcdf"}
    ds.close()
    again = Dataset.open(session, path)
    assert again.dims_table(spark).collect()[0].is_unlimited
    assert again.atts_table(spark).first()["values"] == ["x"]


def test_storage_options(spark, session, path):
    ds = Dataset.create(session, path)
    ds.def_var("v", "float", [ds.def_dim("x", 4)])
    assert code(ds.storage, "v", deflate=10) == Code.EINVAL
    assert code(ds.storage, "v", chunks=[5]) == Code.EBADCHUNK
    assert code(ds.storage, "v", endian="middle") == Code.EINVAL
    ds.storage("v", zstandard=3, chunks=[2], endian="little", quantize=("bitround", 4))
    assert ds.codec("v") == "zstd"
    ds.def_var("w", "int", [0])
    ds.def_filter("w", 1, [5])
    assert (ds.filter_ids("w"), ds.filter_info("w", 1), ds.codec("w"), ds.filter_available(99)) == ([1], [5], "gzip", False)
    ds.enddef()
    d = Decomposition.block(session, (4,))
    ds.write_darray("v", d, d.map.select("task", "k", (F.col("goff") + 1 / 3).cast("float").alias("value")))
    ds.sync()
    assert abs(pairs(ds.get_var("v"))[3] - 10 / 3) < 0.1
    assert code(ds.storage, "v", deflate=1) == Code.ELATEDEF


def test_decomposition_facts(spark, session):
    d = Decomposition.from_lists(spark, [[3, 1, 2], [0, 5, 4]], [3, 2])
    assert dict(d.sort_needed().collect()) == {0: True, 1: True}
    assert not d.has_duplicates()
    assert not d.needs_fill()
    assert d.local_size(1) == 3
    holes = Decomposition.from_lists(spark, [[1, 0, 3]], [6], base=1)
    assert [r.goff for r in holes.map.orderBy("k").collect()] == [0, None, 2]
    assert holes.needs_fill()
    with pytest.raises(GridError):
        Decomposition.from_lists(spark, [[0]], [2], readonly=True)
    with pytest.raises(GridError):
        Decomposition.boxes(spark, [([0], [3])], [2])
    with pytest.raises(GridError):
        Decomposition.from_lists(spark, [[7]], [2]).check()
    grid = Decomposition.grid(spark, [4, 5], [2, 1])
    assert sorted(r.goff for r in grid.map.collect()) == list(range(20))
    assert [r.maplen for r in Decomposition.grid(spark, [3, 3], [4, 1]).local_sizes().orderBy("task").collect()] == [3, 3, 3]


def test_subset_layout(spark):
    """Five ranks and two I/O ranks: ranks 0 and 1 go to the first, the others to the second."""
    maps = [[0, 4, 8, 12], [16, 1, 5, 9], [13, 17, 2, 6], [10, 14, 18, 3], [7, 11, 15, 19]]
    d = Decomposition.from_lists(spark, maps, [4, 5], rearranger=SUBSET)
    out = rearrange.assigned(GridSession(spark, 5, 2), d)
    first = sorted(r.goff for r in out.where("io = 0").collect())
    assert first == [0, 1, 4, 5, 8, 9, 12, 16]


def test_background_sync(spark, session, path):
    ds = Dataset.create(session, path)
    ds.def_var("v", "int", [ds.def_dim("x", 4)])
    ds.enddef()
    d = Decomposition.block(session, (4,))
    ds.write_darray("v", d, d.map.select("task", "k", F.lit(3).alias("value")))
    ds.sync_later()
    ds.close()
    assert set(pairs(Dataset.open(session, path).get_var("v")).values()) == {3}


def test_session(spark):
    s = GridSession(spark, 16, 5, stride=3, base=1, handler=Handler.RETURN)
    assert s.is_io(4)
    assert s.io_rank(5) == -1
    assert s.call(Decomposition, None, (), ) == Code.EINVAL
    with s.timed("x"):
        pass
    assert s.timer_table().first().calls == 1
    with pytest.raises(GridError):
        GridSession(spark, 4, 1, rearranger="none")
    with pytest.raises(GridError):
        RearrangerOptions("carrier pigeon")
    assert len(GridSession.with_components(spark, 1, [3, 2])) == 2


def test_slab_over_an_old_and_a_new_record_fills_the_new_one(spark):
    from meshlake.session import scratch_path

    ds = Dataset.create(GridSession(spark, 4, 2), scratch_path(spark, "grid"))
    ds.def_var("v", "int", [ds.def_dim("t", UNLIMITED), ds.def_dim("x", 4)])
    ds.def_var_fill("v", True, -9)
    ds.enddef()
    ds.put_vara("v", [0, 0], [1, 4], spark.range(4).select(F.col("id").alias("k"), F.col("id").cast("int").alias("value")))
    ds.put_vara("v", [0, 1], [3, 2], spark.range(6).select(F.col("id").alias("k"), (F.col("id") + 10).cast("int").alias("value")))
    got = {(r.rec, r.goff): r.value for r in ds.get_var("v").collect()}
    assert got == {
        (0, 0): 0, (0, 1): 10, (0, 2): 11, (0, 3): 3,
        (1, 0): -9, (1, 1): 12, (1, 2): 13, (1, 3): -9,
        (2, 0): -9, (2, 1): 14, (2, 2): 15, (2, 3): -9,
    }


def test_frames_at_once(spark):
    from meshlake.session import scratch_path

    session = GridSession(spark, 4, 2)
    ds = Dataset.create(session, scratch_path(spark, "grid"))
    ds.def_var("v", "int", [ds.def_dim("t", UNLIMITED), ds.def_dim("x", 6)])
    ds.def_var_fill("v", True, -1)
    ds.enddef()
    d = Decomposition.block(session, (6,))
    frames = d.map.where("goff <> 5").select(F.explode(F.array(F.lit(0), F.lit(3))).alias("rec"), "task", "k", F.col("goff").cast("int").alias("value"))
    ds.write_frames("v", d, frames)
    assert ds.num_records("v") == 4
    assert sorted((r.rec, r.goff, r.value) for r in ds.table("v").collect()) == [(r, g, g if g < 5 else -1) for r in (0, 3) for g in range(6)]
    assert ds.read_frames("v", d).count() == 12
    ds.write_frames("v", d, frames.where("rec = 3").withColumn("value", F.lit(7)))
    assert {(r.rec, r.value) for r in ds.table("v").where("goff = 0").collect()} == {(0, 0), (3, 7)}


def test_facts_are_worked_out_once(spark):
    session = GridSession(spark, 4, 2)
    assert Decomposition.block(session, (7, 3)).known == (0, 20, 21, False)
    d = Decomposition.from_lists(spark, [[0, 4], [4, -1]], [6])
    assert d.facts() == (0, 4, 3, True)
    assert d.has_duplicates() and d.needs_fill()


def test_files_are_in_order_of_offset_after_a_put(spark):
    from meshlake.session import scratch_path

    session = GridSession(spark, 4, 2)
    ds = Dataset.create(session, scratch_path(spark, "grid"))
    ds.def_var("v", "double", [ds.def_dim("x", 1000)])
    ds.enddef()
    ds.put_vara("v", [100], [300], spark.range(300).select(F.col("id").alias("k"), F.rand(1).alias("value")))
    rows = ds.table("v").select("goff", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
    for f in {r.f for r in rows}:
        own = [r.goff for r in rows if r.f == f]
        assert own == sorted(own)
