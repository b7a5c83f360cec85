"""Queries of the engine's own operators over the driver's tables, and their SQL counterparts.

`events` (event_id 0..N-1) is a dense array of N, or of (N / 100, 100), elements; the order keys that `lineitem` lacks are
holes of a 1-D array over `orders`; `embeddings` is a dense (vector, 64) array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import GLOBAL, UNLIMITED
from ..errors import _CODES, Code, GridError, strerror
from ..functions.layout import box_split, coordinates, offset
from ..functions.quantize import quantized
from ..operators import rearrange, slices
from ..operators.decomposition import Decomposition, sorted_copy
from ..session import SUBSET, GridSession, scratch_path
from ..sources import decomp_files
from ..sources.dataset import Dataset
from ..sources.features import Features
from ..types import TYPES, grid_type

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WIDTH = 100
FILL = TYPES["int"].fill


def query(sql: str | None = None, **names: str):
    """Register a query under its name; `sql` is its counterpart."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id").alias("goff"), "value")


def _shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return _events(spark, sf_dir).count() // WIDTH, WIDTH


def _session(spark: SparkSession, num_compute: int = 4, num_io: int = 2, **rest) -> GridSession:
    return GridSession(spark, num_compute, num_io, blocksize=1024, **rest)


def _local(decomposition: Decomposition, data: DataFrame, rows: int | None = None) -> DataFrame:
    """(task, k, ...) of global data (goff, ...); `rows`: how many they are, if not one for each element."""
    n = rearrange.tasks(decomposition.size if rows is None else rows, len(data.columns) + 2)
    return rearrange.dealt(decomposition.map, n, "goff").join(rearrange.dealt(data, n, "goff"), "goff").drop("goff")


def _filled(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """(id, value) of all offsets below `size`; those that no event has are filled."""
    n = rearrange.tasks(size, 2)
    ids, values = rearrange.dealt(spark.range(size), n, "id"), rearrange.dealt(_values(spark, sf_dir), n, "goff")
    return ids.join(values, F.col("id") == F.col("goff"), "left").select("id", F.coalesce("value", F.lit(TYPES["double"].fill)).alias("value"))


def _stored(spark: SparkSession, sf_dir: str, record: bool = False) -> Dataset:
    """A dataset that holds events.value as `t` over (rows, 100), written by a round-robin map."""
    session, shape = _session(spark), _shape(spark, sf_dir)
    ds = Dataset.create(session, scratch_path(spark, "grid"))
    dims = [ds.def_dim("time", UNLIMITED)] if record else []
    ds.def_var("t", "double", [*dims, ds.def_dim("y", shape[0]), ds.def_dim("x", shape[1])])
    ds.enddef()
    d = Decomposition.round_robin(session, shape)
    ds.write_darray("t", d, _local(d, _values(spark, sf_dir)), rec=0)
    ds.sync()
    return ds


N = "WITH n AS (SELECT count(*) AS n FROM events), g AS (SELECT n, unnest(range(n)) AS i FROM n)"


# Decompositions


@query(f"{N} SELECT CAST(i // ((n + 3) // 4) AS INTEGER) AS task, i % ((n + 3) // 4) AS k, i AS goff FROM g")
def decomp_block(spark, sf_dir):
    return Decomposition.block(_session(spark), (_events(spark, sf_dir).count(),)).map


@query(f"{N} SELECT CAST(i % 4 AS INTEGER) AS task, i // 4 AS k, i AS goff FROM g")
def decomp_roundrobin(spark, sf_dir):
    return Decomposition.round_robin(_session(spark), (_events(spark, sf_dir).count(),)).map


@query(
    f"""{N}, c AS (SELECT n // 100 AS h, i // 100 AS y, i % 100 AS x, i FROM g),
    p AS (SELECT *, h // 2 AS h0, CASE WHEN y < h // 2 THEN 0 ELSE 1 END AS py, x // 50 AS px FROM c)
    SELECT CAST(py * 2 + px AS INTEGER) AS task, (y - py * h0) * 50 + x % 50 AS k, i AS goff FROM p"""
)
def decomp_bc(spark, sf_dir):
    return Decomposition.grid(spark, _shape(spark, sf_dir), (2, 2)).map


def _unsorted(spark, sf_dir) -> Decomposition:
    df = _events(spark, sf_dir).select((F.col("event_id") % 4).alias("task"), F.floor(F.col("event_id") / 4).alias("k"), F.col("user_id").alias("goff"))
    return Decomposition.of(df, (1 << 40,), type="double", rearranger=SUBSET, readonly=True)


MAP = "WITH m AS (SELECT CAST(event_id % 4 AS INTEGER) AS task, event_id // 4 AS k, user_id AS goff FROM events)"


@query(f"{MAP}, s AS (SELECT task, goff < lag(goff) OVER (PARTITION BY task ORDER BY k) AS d FROM m) SELECT task, coalesce(bool_or(d), false) AS needs_sort FROM s GROUP BY task")
def decomp_sort_needed(spark, sf_dir):
    return _unsorted(spark, sf_dir).sort_needed()


@query(f"{MAP} SELECT task, k, goff, CAST(row_number() OVER (PARTITION BY task ORDER BY goff, k) - 1 AS INTEGER) AS remap FROM m")
def decomp_remap(spark, sf_dir):
    return _unsorted(spark, sf_dir).remapped()


@query(f"{MAP} SELECT task, row_number() OVER (PARTITION BY task ORDER BY goff, k) - 1 AS k, goff AS value FROM m")
def sorted_values(spark, sf_dir):
    d = _unsorted(spark, sf_dir)
    return sorted_copy(d.map.select("task", "k", F.col("goff").alias("value")), d.remapped())


@query("SELECT l_orderkey * 8 + l_linenumber AS goff, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def decomp_unique_check(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select(F.lit(0).alias("task"), F.lit(0).alias("k"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("goff"))
    return Decomposition.of(df, (1 << 40,)).duplicates()


def _lines(spark, sf_dir, *columns) -> DataFrame:
    """(goff, ...) of lineitem, with the lines of an order in one partition where they are many."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("goff"), *columns)
    return rearrange.dealt(rows, rearrange.tasks(rows.count(), 2), "goff")


def _order_map(spark, sf_dir) -> Decomposition:
    keys = _lines(spark, sf_dir).distinct()
    df = keys.select((F.col("goff") % 4).alias("task"), F.floor(F.col("goff") / 4).alias("k"), "goff")
    return Decomposition.of(df, (_table(spark, sf_dir, "orders").count(),), type="int")


@query(
    "WITH k AS (SELECT DISTINCT l_orderkey AS goff FROM lineitem) SELECT min(goff) AS least, max(goff) AS greatest, count(*) AS n, "
    "max(goff) - min(goff) + 1 < count(*) AS readonly, count(*) < (SELECT count(*) FROM orders) AS needs_fill FROM k"
)
def decomp_needs_fill(spark, sf_dir):
    return _order_map(spark, sf_dir).summary()


@query(f"{N} SELECT CAST(i % 4 AS INTEGER) AS task, count(*) AS maplen FROM g GROUP BY 1")
def local_sizes(spark, sf_dir):
    return Decomposition.round_robin(_session(spark), (_events(spark, sf_dir).count(),)).local_sizes()


# Rearrangement


@query(
    f"""WITH v AS (SELECT l_orderkey AS goff, CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS q FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS goff, coalesce(q, {FILL}) AS value FROM orders LEFT JOIN v ON goff = o_orderkey"""
)
def fill_holes(spark, sf_dir):
    d = _order_map(spark, sf_dir)
    ds = Dataset.create(_session(spark), scratch_path(spark, "grid"))
    ds.def_var("q", "int", [ds.def_dim("order", d.size)])
    ds.enddef()
    q = _lines(spark, sf_dir, F.col("l_quantity").cast("int").alias("q")).groupBy("goff").agg(F.sum("q").cast("int").alias("value"))
    ds.write_darray("q", d, d.map.join(q, "goff").drop("goff"))  # both are dealt by order
    ds.sync()
    return ds.get_var("q").select("goff", "value")


HOLES = "WITH h AS (SELECT o_orderkey AS goff, (SELECT count(*) FROM orders) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))"


@query(f"{HOLES} SELECT goff, CAST(CASE WHEN goff < (n // 4) * (4 - n % 4) THEN goff // (n // 4) ELSE (4 - n % 4) + (goff - (n // 4) * (4 - n % 4)) // (n // 4 + 1) END AS INTEGER) AS io FROM h")
def hole_grid(spark, sf_dir):
    d = _order_map(spark, sf_dir)
    return rearrange.hole_grid(d.map, d.size, 4)


@query(f"{HOLES}, r AS (SELECT goff, goff - row_number() OVER (ORDER BY goff) AS key FROM h) SELECT min(goff) AS start, count(*) AS count FROM r GROUP BY key")
def hole_regions(spark, sf_dir):
    d = _order_map(spark, sf_dir)
    return rearrange.runs_1d(rearrange.hole_grid(d.map, d.size))


@query("WITH d AS (SELECT DISTINCT l_orderkey AS goff FROM lineitem), r AS (SELECT goff, goff - row_number() OVER (ORDER BY goff) AS key FROM d) SELECT min(goff) AS start, count(*) AS count FROM r GROUP BY key")
def regions_1d(spark, sf_dir):
    return rearrange.runs_1d(_order_map(spark, sf_dir).map)


@query(
    """WITH n AS (SELECT count(*) AS n FROM events), r AS (SELECT n, (n + 2) // 3 AS each, unnest(range(3)) AS io FROM n), b AS (SELECT io, io * each AS a, least(n, (io + 1) * each) AS e FROM r),
    c AS (SELECT *, CASE WHEN a % 100 = 0 THEN a ELSE least(e, (a // 100 + 1) * 100) END AS m FROM b), d AS (SELECT *, greatest(m, e // 100 * 100) AS t FROM c),
    p AS (SELECT io, a, a AS f, m AS u FROM d UNION ALL SELECT io, a, m, t FROM d UNION ALL SELECT io, a, t, e FROM d)
    SELECT CAST(io AS INTEGER) AS io, CAST(row_number() OVER (PARTITION BY io ORDER BY f) - 1 AS INTEGER) AS region, f - a AS loffset, f // 100 AS first_row, f % 100 AS first_column,
    greatest(1, (u - f) // 100) AS n_rows, least(100, u - f) AS n_columns FROM p WHERE u > f"""
)
def regions_nd(spark, sf_dir):
    """Three ranks whose ranges begin and end inside rows: up to three boxes each."""
    shape = _shape(spark, sf_dir)
    session = _session(spark, num_compute=3, num_io=3)
    d = Decomposition.block(session, shape, rearranger=SUBSET)
    found = rearrange.nd_regions(rearrange.assigned(session, d), shape)
    start, count = F.col("start"), F.col("count")
    return found.select("io", "region", "loffset", start[0].alias("first_row"), start[1].alias("first_column"), count[0].alias("n_rows"), count[1].alias("n_columns"))


def _boxes(spark, sf_dir, num_io: int = 4):
    return box_split("double", (_events(spark, sf_dir).count(),), num_io, 1024)


SPLIT = "WITH n AS (SELECT count(*) AS n FROM events), b AS (SELECT n, n // 4 AS c, n % 4 AS over, unnest(range(4)) AS io FROM n), s AS (SELECT CAST(io AS INTEGER) AS io, c * io + greatest(0, io - (4 - over)) AS start, c + CASE WHEN io >= 4 - over THEN 1 ELSE 0 END AS count FROM b)"


@query(f"{SPLIT} SELECT io, start, count FROM s")
def box_split_1d(spark, sf_dir):
    rows = [(i, b[0][0], b[0][1]) for i, b in enumerate(_boxes(spark, sf_dir))]
    return spark.createDataFrame(rows, "io int, start bigint, count bigint")


@query(f"{SPLIT} SELECT event_id AS goff, io, event_id - start AS ioff FROM events JOIN s ON event_id BETWEEN start AND start + count - 1")
def box_assign(spark, sf_dir):
    df = _events(spark, sf_dir).select(F.col("event_id").alias("goff"))
    return rearrange.assign_boxes(df, (df.count(),), _boxes(spark, sf_dir))


@query(f"{N} SELECT CAST(i % 10 AS INTEGER) AS task, CAST(least(2, (i % 10) // 3) AS INTEGER) AS io, count(*) AS n FROM g GROUP BY 1, 2")
def subset_assign(spark, sf_dir):
    session = _session(spark, num_compute=10, num_io=3)
    d = Decomposition.round_robin(session, (_events(spark, sf_dir).count(),), rearranger=SUBSET)
    return rearrange.comm_matrix(rearrange.assigned(session, d))


@query(f"{SPLIT} SELECT CAST(event_id % 4 AS INTEGER) AS task, io, count(*) AS n FROM events JOIN s ON event_id BETWEEN start AND start + count - 1 GROUP BY 1, 2")
def comm_matrix(spark, sf_dir):
    session = _session(spark, num_io=4)
    return rearrange.comm_matrix(rearrange.assigned(session, Decomposition.round_robin(session, (_events(spark, sf_dir).count(),))))


@query(f"{SPLIT} SELECT max(count) AS maxiobuflen FROM s")
def max_iobuf(spark, sf_dir):
    session = _session(spark, num_io=4)
    return rearrange.max_io_buffer(rearrange.assigned(session, Decomposition.block(session, (_events(spark, sf_dir).count(),))))


@query("SELECT DISTINCT CAST(least(1, (l_orderkey % 4) // 2) AS INTEGER) AS io, l_partkey AS goff FROM lineitem")
def read_dedupe(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).alias("task"), F.lit(0).alias("k"), F.col("l_partkey").alias("goff"))
    return rearrange.deduplicated(rearrange.assign_subsets(Decomposition.of(df, (1 << 40,), rearranger=SUBSET, readonly=True).map, 4, 2))


@query("SELECT CAST(i AS INTEGER) AS io, CAST((1 + i * 3) % 16 AS INTEGER) AS comp_rank FROM range(5) t(i)")
def io_rank_placement(spark, sf_dir):
    s = GridSession(spark, 16, 5, stride=3, base=1)
    return spark.createDataFrame(list(enumerate(s.ranks)), "io int, comp_rank int")


@query("SELECT CAST(r AS INTEGER) AS io, CAST(CASE WHEN r < 15 THEN r ELSE 15 + 2 * (r - 15) END AS BIGINT) AS start, CAST(CASE WHEN r < 15 THEN 1 ELSE 2 END AS BIGINT) AS count FROM range(23) t(r)")
def box_split_uneven(spark, sf_dir):
    boxes = box_split("double", (31, 777602), 24)
    return spark.createDataFrame([(i, *b[0]) for i, b in enumerate(boxes)], "io int, start bigint, count bigint")


# Distributed arrays


@query("SELECT CAST(event_id // ((n + 3) // 4) AS INTEGER) AS task, event_id % ((n + 3) // 4) AS k, value FROM events, (SELECT count(*) AS n FROM events)")
def write_read_roundtrip(spark, sf_dir):
    ds = _stored(spark, sf_dir)
    return ds.read_darray("t", Decomposition.block(ds.session, _shape(spark, sf_dir)))


@query(
    """WITH d AS (SELECT unnest([-1, 0, 1]) AS d), n AS (SELECT count(*) AS n FROM events),
    h AS (SELECT CAST(e.event_id // ((n + 3) // 4) AS INTEGER) AS task, (e.event_id % ((n + 3) // 4)) * 3 + d + 1 AS k, e.event_id + d AS goff FROM events e, d, n)
    SELECT task, k, value FROM h LEFT JOIN events ON event_id = goff"""
)
def halo_read(spark, sf_dir):
    ds = _stored(spark, sf_dir)
    return ds.read_darray("t", Decomposition.block(ds.session, _shape(spark, sf_dir)).halo())


@query("SELECT event_id AS goff, value AS a, user_id AS b, length(event_type)::INTEGER AS c FROM events")
def multi_var_write(spark, sf_dir):
    session = _session(spark)
    ev = _events(spark, sf_dir).select(F.col("event_id").alias("goff"), F.col("value").alias("a"), F.col("user_id").alias("b"), F.length("event_type").alias("c"))
    d = Decomposition.block(session, (ev.count(),))
    ds = Dataset.create(session, scratch_path(spark, "grid"))
    dim = ds.def_dim("event", d.size)
    for name, kind in (("a", "double"), ("b", "int64"), ("c", "int")):
        ds.def_var(name, kind, [dim])
    ds.enddef()
    ds.write_darray_multi(["a", "b", "c"], d, _local(d, ev), flush=True)
    out = None
    for name in "abc":
        one = ds.get_var(name).select("goff", F.col("value").alias(name))
        out = one if out is None else out.join(one, "goff")
    return out


# Slices


@query("SELECT event_id AS goff, value FROM events")
def get_var(spark, sf_dir):
    return _stored(spark, sf_dir).get_var("t").select("goff", "value")


@query("SELECT event_id AS goff, value FROM events WHERE event_id = 307")
def get_var1(spark, sf_dir):
    return _stored(spark, sf_dir).get_var1("t", [3, 7]).select("goff", "value")


@query("SELECT event_id AS goff, value FROM events WHERE event_id // 100 BETWEEN 2 AND 5 AND event_id % 100 BETWEEN 10 AND 29")
def get_vara(spark, sf_dir):
    return _stored(spark, sf_dir).get_vara("t", [2, 10], [4, 20]).select("goff", "value")


@query("SELECT event_id AS goff, value FROM events WHERE event_id // 100 IN (1, 4, 7) AND event_id % 100 IN (5, 17, 29, 41)")
def get_vars(spark, sf_dir):
    return _stored(spark, sf_dir).get_vars("t", [1, 5], [3, 4], [3, 12]).select("goff", "value")


SLAB = "event_id // 100 BETWEEN 1 AND 3 AND event_id % 100 BETWEEN 40 AND 49"


@query(f"SELECT event_id AS goff, CASE WHEN {SLAB} THEN CAST((event_id // 100 - 1) * 10 + event_id % 100 - 40 AS DOUBLE) ELSE value END AS value FROM events")
def put_vara_upsert(spark, sf_dir):
    ds = _stored(spark, sf_dir)
    ds.put_vara("t", [1, 40], [3, 10], spark.range(30).select(F.col("id").alias("k"), F.col("id").cast("double").alias("value")))
    return ds.get_var("t").select("goff", "value")


@query(
    f"""WITH r AS (SELECT unnest([0, 1]) AS rec), c AS (SELECT CAST(rec AS INTEGER) AS rec, event_id AS goff, value FROM r, events)
    SELECT rec, goff, CASE WHEN goff // 100 BETWEEN 1 AND 3 AND goff % 100 BETWEEN 40 AND 49 THEN CAST(rec * 30 + (goff // 100 - 1) * 10 + goff % 100 - 40 AS DOUBLE)
    WHEN rec = 0 THEN value ELSE {TYPES["double"].fill!r} END AS value FROM c"""
)
def put_vara_new_record(spark, sf_dir):
    """A slab over a record that is there and one that isn't: the rest of the new one is filled."""
    ds = _stored(spark, sf_dir, record=True)
    ds.put_vara("t", [0, 1, 40], [2, 3, 10], spark.range(60).select(F.col("id").alias("k"), F.col("id").cast("double").alias("value")))
    return ds.get_var("t").select("rec", "goff", "value")


@query("SELECT event_id AS goff, CASE WHEN event_id // 100 IN (0, 2, 4) AND event_id % 100 IN (1, 51) THEN -1.0 ELSE value END AS value FROM events")
def put_vars_upsert(spark, sf_dir):
    ds = _stored(spark, sf_dir)
    ds.put_vars("t", [0, 1], [3, 2], [2, 50], spark.range(6).select(F.col("id").alias("k"), F.lit(-1.0).alias("value")))
    return ds.get_var("t").select("goff", "value")


@query("SELECT event_id AS goff, CASE WHEN event_id = 205 THEN 0.5 ELSE value END AS value FROM events")
def put_var1_upsert(spark, sf_dir):
    ds = _stored(spark, sf_dir)
    ds.put_var1("t", [2, 5], 0.5)
    return ds.get_var("t").select("goff", "value")


@query("SELECT event_id AS goff, value * 2 AS value FROM events")
def put_var_whole(spark, sf_dir):
    ds = _stored(spark, sf_dir)
    ds.put_var("t", _values(spark, sf_dir).select(F.col("goff").alias("k"), (F.col("value") * 2).alias("value")))
    return ds.get_var("t").select("goff", "value")


@query(
    f"""WITH b AS (SELECT min(CAST(ts AS DATE)) AS d0 FROM events), r AS (SELECT *, CAST(date_diff('day', d0, CAST(ts AS DATE)) AS INTEGER) AS rec FROM events, b),
    k AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY event_id) - 1 AS goff, value FROM r), m AS (SELECT max(goff) + 1 AS most FROM k),
    f AS (SELECT rec, goff, most FROM (SELECT DISTINCT rec FROM k), (SELECT most, unnest(range(most)) AS goff FROM m))
    SELECT f.rec, CAST(f.goff // ((most + 3) // 4) AS INTEGER) AS task, f.goff % ((most + 3) // 4) AS k, coalesce(value, {TYPES["double"].fill!r}) AS value FROM f LEFT JOIN k ON k.rec = f.rec AND k.goff = f.goff"""
)
def get_vard_frame(spark, sf_dir):
    """Every day is a record as long as the day of most events; shorter ones are filled. All are written and read by one decomposition."""
    from pyspark.sql import Window

    ev = _events(spark, sf_dir)
    first = ev.agg(F.to_date(F.min("ts"))).first()[0]
    rows = ev.select("event_id", "value", F.datediff("ts", F.lit(first)).alias("rec"))
    rows = rows.withColumn("goff", (F.row_number().over(Window.partitionBy("rec").orderBy("event_id")) - 1).cast("bigint"))
    most = rows.groupBy("rec").count().agg(F.max("count")).first()[0]
    session = _session(spark)
    ds = Dataset.create(session, scratch_path(spark, "grid"))
    ds.def_var("t", "double", [ds.def_dim("day", UNLIMITED), ds.def_dim("n", most)])
    ds.enddef()
    d = Decomposition.block(session, (most,))
    ds.write_frames("t", d, _local(d, rows.select("rec", "goff", "value"), ev.count()))
    return ds.read_frames("t", d)


@query("SELECT event_id AS goff, CAST(trunc(value) AS INTEGER) AS value FROM events")
def type_cast_int(spark, sf_dir):
    return _stored(spark, sf_dir).get_var("t", as_type="int").select("goff", "value")


@query("SELECT vec_id, CAST(j - 1 AS INTEGER) AS j, embedding[j] AS val FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS j FROM embeddings)")
def dense_2d_read(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "value"))
    session, dims = _session(spark), (_table(spark, sf_dir, "embeddings").count(), 64)
    ds = Dataset.create(session, scratch_path(spark, "grid"))
    ds.def_var("v", "float", [ds.def_dim("vector", dims[0]), ds.def_dim("place", dims[1])])
    ds.enddef()
    d = Decomposition.block(session, dims, type="float")
    ds.write_darray("v", d, _local(d, rows.select(offset([F.col("vec_id"), F.col("j")], dims).alias("goff"), "value")))
    ds.sync()
    at = coordinates(F.col("goff"), dims)
    return ds.get_var("v").select(at[0].alias("vec_id"), at[1].cast("int").alias("j"), F.col("value").alias("val"))


@query("SELECT vec_id * 64 + j - 1 AS goff, embedding[j] AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS j FROM embeddings) WHERE vec_id % 5 = 0 AND (j - 1) % 8 = 0")
def dense_2d_strided(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "value"))
    dims = (_table(spark, sf_dir, "embeddings").count(), 64)
    data = rows.select(offset([F.col("vec_id"), F.col("j")], dims).alias("goff"), "value")
    return slices.hyperslab(data, dims, [0, 0], [-(-dims[0] // 5), 8], [5, 8])


@query("SELECT event_id AS goff, event_id // 500 AS d0, event_id // 100 % 5 AS d1, event_id % 100 AS d2 FROM events")
def linear_to_coords(spark, sf_dir):
    df = _events(spark, sf_dir).select(F.col("event_id").alias("goff"))
    return df.select("goff", *[c.alias(f"d{i}") for i, c in enumerate(coordinates(F.col("goff"), (df.count() // 500, 5, 100)))])


@query("SELECT event_id, (event_id % 7) * 12 + (event_id % 3) * 4 + event_id % 4 AS goff FROM events")
def coords_to_linear(spark, sf_dir):
    e = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", offset([e % 7, e % 3, e % 4], (7, 3, 4)).alias("goff"))


# Records


def _daily(spark, sf_dir) -> tuple[DataFrame, int]:
    ev = _events(spark, sf_dir)
    first = ev.agg(F.to_date(F.min("ts"))).first()[0]
    days = ev.groupBy(F.datediff("ts", F.lit(first)).alias("rec"), (F.col("event_id") % 8).alias("goff")).agg(F.count("*").alias("value"))
    return days, first


DAYS = "WITH b AS (SELECT min(CAST(ts AS DATE)) AS d0 FROM events), r AS (SELECT CAST(date_diff('day', d0, CAST(ts AS DATE)) AS INTEGER) AS rec, event_id % 8 AS goff FROM events, b), d AS (SELECT rec, goff, count(*) AS value FROM r GROUP BY 1, 2), f AS (SELECT rec, goff FROM (SELECT DISTINCT rec FROM d), (SELECT unnest(range(8)) AS goff))"


def _appended(spark, sf_dir) -> Dataset:
    """Every day is a record of eight counts; slots without events are filled."""
    session = _session(spark)
    days, _ = _daily(spark, sf_dir)
    ds = Dataset.create(session, scratch_path(spark, "grid"))
    ds.def_var("n", "int64", [ds.def_dim("day", UNLIMITED), ds.def_dim("slot", 8)])
    ds.def_var_fill("n", True, 0)
    ds.enddef()
    d = Decomposition.block(session, (8,), type="int64")
    ds.write_frames("n", d, _local(d, days))
    return ds


@query(f"{DAYS} SELECT f.rec, f.goff, coalesce(value, 0) AS value FROM f LEFT JOIN d ON f.rec = d.rec AND f.goff = d.goff")
def record_append(spark, sf_dir):
    return _appended(spark, sf_dir).get_var("n").select("rec", "goff", "value")


@query(f"{DAYS} SELECT max(rec) + 1 AS n_records FROM d")
def record_last(spark, sf_dir):
    return spark.createDataFrame([(_appended(spark, sf_dir).num_records("n"),)], "n_records int")


HALVES = "WITH n AS (SELECT (count(*) + {0} - 1) // {0} AS each FROM events), g AS (SELECT each, unnest(range({0} * each)) AS i FROM n)"


@query(f"{HALVES.format(4)} SELECT CAST(i // each AS INTEGER) AS rec, i % each AS goff, coalesce(value, {TYPES['double'].fill!r}) AS value FROM g LEFT JOIN events ON event_id = i")
def record_stream(spark, sf_dir):
    """All events, as a stream of four records."""
    from ..streaming.records import append_records

    each = -(-_events(spark, sf_dir).count() // 4)
    session, source = _session(spark), scratch_path(spark, "source")
    ds = Dataset.create(session, scratch_path(spark, "grid"))
    ds.def_var("t", "double", [ds.def_dim("time", UNLIMITED), ds.def_dim("x", each)])
    ds.enddef()
    d = Decomposition.block(session, (each,))
    rows = _filled(spark, sf_dir, 4 * each)
    per = -(-each // rearrange.tasks(each, 4))
    files = -(-each // per)  # of each record; none is without rows
    goff = F.col("id") % each
    for rec in range(4):
        local = _local(d, rows.where(F.floor(F.col("id") / each) == rec).select(goff.alias("goff"), "value", F.floor(goff / per).cast("int").alias("file")))
        local.repartitionById(files, "file").drop("file").write.mode("append").parquet(source)
    stream = spark.readStream.schema("task int, k bigint, value double").option("maxFilesPerTrigger", files).parquet(source)
    append_records(stream, ds, "t", d, scratch_path(spark, "stream")).awaitTermination()
    return ds.get_var("t").select("rec", "goff", "value")


@query(f"{HALVES.format(2)} SELECT CAST(i // each AS INTEGER) AS rec, i % each AS goff, coalesce(value, {TYPES['double'].fill!r}) AS value FROM g LEFT JOIN events ON event_id = i")
def frames_advance(spark, sf_dir):
    """One record in the frame that is set, the next one after reopening and advancing; the second is stored in the background."""
    each = -(-_events(spark, sf_dir).count() // 2)
    session = _session(spark)
    ds = Dataset.create(session, scratch_path(spark, "grid"))
    ds.def_var("t", "double", [ds.def_dim("time", UNLIMITED), ds.def_dim("x", each)])
    ds.enddef()
    d = Decomposition.block(session, (each,))
    rows = _filled(spark, sf_dir, 2 * each)
    half = lambda rec: _local(d, rows.where(F.floor(F.col("id") / each) == rec).select((F.col("id") % each).alias("goff"), "value"))
    ds.set_frame("t", 0)
    ds.write_darray("t", d, half(0))
    ds.close()
    again = Dataset.open(session, ds.path, writable=True)
    again.set_frame("t", again.num_records("t") - 1)
    again.advance_frame("t")
    again.write_darray("t", d, half(1))
    again.sync_later().result()
    return again.get_var("t").select("rec", "goff", "value")


# Stored forms


@query(f"{N} SELECT CAST(i % 4 AS INTEGER) AS task, count(*) AS maplen, string_agg(i, ',' ORDER BY i) AS map FROM g GROUP BY 1")
def decomp_table(spark, sf_dir):
    d = Decomposition.round_robin(_session(spark), (_events(spark, sf_dir).count(),))
    path = scratch_path(spark, "decomp")
    decomp_files.write_tables(d, path)
    return decomp_files.summary(decomp_files.read_tables(spark, path, 4).map).withColumn("map", F.array_join(F.col("map").cast("array<string>"), ","))


@query(f"{N} SELECT CAST(i % 4 AS INTEGER) AS task, i // 4 AS k, i AS goff FROM g")
def decomp_text(spark, sf_dir):
    d = Decomposition.round_robin(_session(spark), (_events(spark, sf_dir).count(),))
    path = scratch_path(spark, "decomp")
    decomp_files.write_text_map(d, path)
    return decomp_files.read_text_map(spark, path).map


@query("SELECT CAST(s_suppkey AS BIGINT) AS goff, s_acctbal AS value FROM supplier")
def features_field(spark, sf_dir):
    return Features.load(spark, f"{sf_dir}/supplier.parquet", "s_suppkey").field("s_acctbal")


@query("SELECT CAST(n_nationkey // 7 AS INTEGER) AS task, CAST(n_nationkey % 7 AS BIGINT) AS k, n_name AS value FROM nation")
def features_darray(spark, sf_dir):
    f = Features.load(spark, f"{sf_dir}/nation.parquet", "n_nationkey")
    return f.read_darray("n_name", Decomposition.block(_session(spark), (25,)))


@query("SELECT event_id AS goff, value FROM events")
def grid_source(spark, sf_dir):
    from ..sources.grid_source import GridSource

    spark.dataSource.register(GridSource)
    ds = _stored(spark, sf_dir)
    return spark.read.format("grid").option("variable", "t").load(ds.path).select("goff", "value")


@query(
    """WITH v AS (SELECT event_id AS goff, value AS v, abs(value) AS s FROM events), e AS (SELECT *, floor(log2(s)) AS near FROM v WHERE s > 0),
    p AS (SELECT *, near + CASE WHEN s >= pow(2.0, near + 1) THEN 1 WHEN s < pow(2.0, near) THEN -1 ELSE 0 END AS e FROM e),
    k AS (SELECT *, least(greatest(ceil(e - (floor(log10(s)) + 1 - 3) * log2(10)), 0), 52) AS keep FROM p),
    q AS (SELECT goff, v, round_even(v / pow(2.0, e - 10), 0) * pow(2.0, e - 10) AS bitround, round_even(v / pow(2.0, e - keep), 0) * pow(2.0, e - keep) AS granular,
      sign(v) * (floor(s / pow(2.0, e - 11)) * pow(2.0, e - 11) + CASE WHEN goff % 2 = 1 THEN pow(2.0, e - 11) - pow(2.0, e - 52) ELSE 0 END) AS bitgroom FROM k)
    SELECT v.goff, coalesce(bitround, v.v) AS bitround, coalesce(granular, v.v) AS granular, coalesce(bitgroom, v.v) AS bitgroom FROM v LEFT JOIN q ON q.goff = v.goff"""
)
def quantize(spark, sf_dir):
    return _values(spark, sf_dir).select("goff", quantized("value", "bitround", 10).alias("bitround"), quantized("value", "granular_bitround", 3).alias("granular"), quantized("value", "bitgroom", 3).alias("bitgroom"))


@query("SELECT event_id AS goff, true AS near FROM events")
def quantize_error(spark, sf_dir):
    """Whether each value rounded to three significant digits is within half a unit of the third."""
    v, q = F.col("value"), quantized("value", "granular_bitround", 3)
    unit = F.when(v != 0, F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - 2)).otherwise(0.0)
    return _values(spark, sf_dir).select("goff", (F.abs(v - q) <= unit / 2 + 1e-12).alias("near"))


def _catalogued(spark) -> Dataset:
    ds = Dataset.create(_session(spark), scratch_path(spark, "grid"))
    t, y, x = ds.def_dim("time", UNLIMITED), ds.def_dim("lat", 2), ds.def_dim("lon", 3)
    ds.def_var("height", "float", [t, y, x])
    ds.def_var("station", "int", [y])
    ds.put_att(GLOBAL, "title", "string", "example")
    ds.put_att("height", "scale", "double", [0.5, 2.0])
    ds.rename_var("station", "post")
    ds.storage("height", zstandard=3)
    ds.enddef()
    return ds


@query("SELECT CAST(column0 AS INTEGER) AS dimid, column1 AS name, CAST(column2 AS BIGINT) AS len, column3 AS is_unlimited FROM (VALUES (0, 'time', 0, true), (1, 'lat', 2, false), (2, 'lon', 3, false)) t(column0, column1, column2, column3)")
def catalog_dims(spark, sf_dir):
    return _catalogued(spark).catalog.dims_table(spark)


@query("SELECT CAST(a AS INTEGER) AS varid, b AS name, c AS type, d AS dimids FROM (VALUES (0, 'height', 'float', '0,1,2'), (1, 'post', 'int', '1')) t(a, b, c, d)")
def catalog_inq(spark, sf_dir):
    ds = _catalogued(spark)
    ds.close()
    again = Dataset.open(ds.session, ds.path)
    return again.catalog.vars_table(spark).select("varid", "name", "type", F.array_join(F.col("dimids").cast("array<string>"), ",").alias("dimids"))


@query("SELECT CAST(a AS INTEGER) AS varid, CAST(0 AS INTEGER) AS attnum, b AS name, c AS type, d AS values FROM (VALUES (-1, 'title', 'string', 'example'), (0, 'scale', 'double', '0.5,2.0')) t(a, b, c, d)")
def catalog_atts(spark, sf_dir):
    return _catalogued(spark).catalog.atts_table(spark).withColumn("values", F.array_join("values", ","))


@query("SELECT 3 AS ndims, 2 AS nvars, 1 AS ngatts, 0 AS unlimdimid, 'netcdf4p' AS format")
def dataset_inquire(spark, sf_dir):
    ds = _catalogued(spark)
    ds.close()
    found = Dataset.open(ds.session, ds.path).catalog.inquire()
    return spark.createDataFrame([(found["ndims"], found["nvars"], found["ngatts"], found["unlimdimid"], found["format"])], "ndims int, nvars int, ngatts int, unlimdimid int, format string")


@query("SELECT * FROM (VALUES ('chunks', '1,2,3'), ('codec', 'zstd'), ('endian', 'little'), ('filters', '32015'), ('refused', 'ENOTNC4')) t(key, value)")
def storage_options(spark, sf_dir):
    """What is kept of a variable's storage after reopening, and that classic formats have none."""
    ds = Dataset.create(_session(spark), scratch_path(spark, "grid"))
    ds.def_var("v", "float", [ds.def_dim(n, k) for n, k in (("z", 2), ("y", 4), ("x", 6))])
    ds.storage("v", chunks=[1, 2, 3], endian="little")
    ds.def_filter("v", 32015, [3])
    ds.enddef()
    ds.close()
    again = Dataset.open(ds.session, ds.path)
    kept = again.catalog.storage("v")
    classic = Dataset.create(_session(spark), scratch_path(spark, "grid"), format="netcdf")
    classic.def_var("v", "float", [classic.def_dim("x", 2)])
    try:
        classic.storage("v", endian="little")
        refused = ""
    except GridError as e:
        refused = Code(e.code).name
    rows = [("chunks", ",".join(map(str, kept["chunks"]))), ("codec", again.catalog.codec("v")), ("endian", kept["endian"]), ("filters", ",".join(map(str, again.catalog.filter_ids("v")))), ("refused", refused)]
    return spark.createDataFrame(rows, "key string, value string")


@query("SELECT CAST(s_suppkey AS BIGINT) AS goff, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS value FROM supplier")
def features_write(spark, sf_dir):
    f = Features.load(spark, f"{sf_dir}/supplier.parquet", "s_suppkey")
    new = f.df.where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("goff"), (F.col("s_acctbal") * 2).alias("value"))
    return f.write_field("s_acctbal", new).field("s_acctbal")


@query(f"{MAP} SELECT task, k, goff AS value FROM m")
def sorted_inverse(spark, sf_dir):
    """Values moved to offset order and back again."""
    d = _unsorted(spark, sf_dir)
    remap = d.remapped()
    there = sorted_copy(d.map.select("task", "k", F.col("goff").alias("value")), remap)
    return sorted_copy(there, remap, inverse=True)


def _values_sql(rows: list[tuple], columns: str) -> str:
    """The rows as a literal table."""
    text = lambda x: "chr(0)" if x == "\0" else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS INTEGER)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


_CODE_ROWS = [(k, int(v), t) for k, (v, t) in _CODES.items()]
_TYPE_ROWS = [(t.number, t.name, t.bytes, t.spark.simpleString(), str(t.fill), t.classic) for t in TYPES.values()]


@query(_values_sql(_CODE_ROWS, "name, code, text"))
def error_codes(spark, sf_dir):
    return spark.createDataFrame([(k, int(Code[k]), strerror(Code[k])) for k, _, _ in _CODE_ROWS], "name string, code int, text string")


@query(_values_sql(_TYPE_ROWS, "number, name, bytes, spark_type, fill, classic"))
def type_table(spark, sf_dir):
    found = [grid_type(n) for n, *_ in _TYPE_ROWS]
    return spark.createDataFrame([(t.number, t.name, t.bytes, t.spark.simpleString(), str(t.fill), t.classic) for t in found], "number int, name string, bytes int, spark_type string, fill string, classic boolean")


@query(
    """WITH k AS (SELECT DISTINCT l_orderkey AS goff FROM lineitem), r AS (SELECT goff, goff - row_number() OVER (ORDER BY goff) AS key FROM k),
    s AS (SELECT min(goff) AS start, count(*) AS n FROM r GROUP BY key), g AS (SELECT start - lag(start + n) OVER (ORDER BY start) AS gap FROM s),
    x AS (SELECT n AS v FROM s UNION SELECT gap FROM g WHERE gap IS NOT NULL UNION SELECT min(goff) FROM k)
    SELECT CAST(greatest(1, list_reduce(list(CAST(v AS BIGINT)), lambda a, b: gcd(a, b))) AS BIGINT) AS block FROM x"""
)
def gcd_blocks(spark, sf_dir):
    """The common block length of the order map."""
    d = _order_map(spark, sf_dir)
    return rearrange.block_length(d.map, d.size)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write by a round-robin map, store in box layout, read by blocks, and take ten rows of the array."""
    ds = _stored(spark, sf_dir)
    shape = _shape(spark, sf_dir)
    d = Decomposition.block(ds.session, shape)
    back = ds.read_darray("t", d).join(d.map, ["task", "k"])
    return slices.hyperslab(back, shape, [0, 0], [min(10, shape[0]), WIDTH]).select("task", "k", "goff", "value")
