"""Removal of repeated multi-line chunks, in DataFrame operations only.

Lines are hashed; a chunk ends where the rolling hash over a line and the one before it is less than its neighbours on both
sides. The choice looks at four lines only, so chunks of a passage come out alike wherever it stands. They have three lines
on average; no chunk of a text of two lines or more has fewer than two. Chunks whose digest occurs more than once are compared byte by byte, and all but the first
(least doc_id, then place) are removed.

Only digests and places are shuffled to find repeats, with map-side combining. Texts move once, to meet the list of their
repeats; that joined table is kept, compared and cut without another move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import kept

FACTOR = 31
MODULUS = 4294967291


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _later(array: Column, first) -> Column:
    """`array` moved back by one place, with `first` in front."""
    return F.concat(F.array(first), F.slice(array, 1, F.size(array) - 1))


def chunked(docs: DataFrame) -> DataFrame:
    """`docs` with __lines and __chunks: an array of (from, lines) for texts that aren't null. Line numbers start at 0."""
    out = docs.withColumn("__lines", F.split(F.col("text").cast("string"), "\n", -1))
    out = out.withColumn("__hash", F.transform("__lines", _line_hash))
    out = out.withColumn("__roll", F.zip_with(_later(F.col("__hash"), F.lit(None).cast("bigint")), "__hash", lambda p, h: F.pmod(p * FACTOR + h, F.lit(MODULUS)))).withColumn("__n", F.size("__lines"))

    after = F.concat(F.slice("__roll", 2, F.greatest(F.col("__n") - 1, F.lit(0))), F.array(F.lit(None).cast("bigint")))
    pairs = F.zip_with(_later(F.col("__roll"), F.lit(None).cast("bigint")), "__roll", lambda p, x: F.struct(p.alias("p"), x.alias("x")))
    least = F.zip_with(pairs, after, lambda s, y: F.coalesce(s["x"] < s["p"], F.lit(True)) & F.coalesce(s["x"] <= y, F.lit(False)))
    ends = F.transform(least, lambda e, i: F.when((i + 1 == F.col("__n")) | (e & (i >= 1) & (i + 1 <= F.col("__n") - 2)), i + 1))
    out = out.withColumn("__end", F.filter(ends, lambda e: e.isNotNull()))
    chunks = F.zip_with(_later(F.col("__end"), F.lit(0)), "__end", lambda a, b: F.struct(a.alias("from"), (b - a).alias("lines")))
    return out.withColumn("__chunks", chunks).drop("__hash", "__roll", "__end", "__n")


def _chunk_text(chunk: Column) -> Column:
    return F.array_join(F.slice("__lines", chunk["from"] + 1, chunk["lines"]), "\n")


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with __id, __tie and __uid: together they tell rows apart; the last two are 0 where doc_ids do so alone."""
    docs = docs.withColumn("__id", F.col("doc_id").cast("bigint"))
    if docs.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1 OR __id IS NULL").isEmpty():
        return docs.withColumns({"__tie": F.lit(0).cast("bigint"), "__uid": F.lit(0).cast("bigint")})
    return kept(docs.withColumns({"__tie": F.xxhash64(F.col("text").cast("string")), "__uid": F.monotonically_increasing_id()}), "rows")


def line_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with repeated multi-line chunks cut from text, and __n_lines, __n_removed (lines).

    A null text stays null with 0 lines; an empty one is one line and stays. Single-line texts are never cut. Rows that
    repeat a doc_id are documents of their own, in order of a hash of their texts; a null doc_id comes after all others. A
    text whose chunks are all removed becomes empty. Texts are split and hashed whole, however long; the time they take is in
    proportion to their lines. Columns whose names begin with __ are reserved. An empty table gives an empty result.
    """
    rows = _keyed(docs)
    key = ["__id", "__tie", "__uid"]
    digests = F.transform("__chunks", lambda c, i: F.struct(i.alias("k"), F.when(c["lines"] > 1, F.unhex(F.md5(_chunk_text(c).cast("binary")))).alias("digest")))
    parts = chunked(rows.select(*key, "text")).select(*key, F.explode(F.filter(digests, lambda x: x["digest"].isNotNull())).alias("x"))
    parts = kept(parts.select(*key, F.col("x.k").alias("__k"), F.col("x.digest").alias("__digest")), "chunks")
    place = F.struct(F.col("__id").isNull().alias("last"), *key, F.col("__k").alias("k"))
    many = parts.groupBy("__digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("__digest").alias("__of"), "first")
    many = kept(many, "many")  # then a digest with very many chunks is a skewed join, which is split, and not a group
    again = parts.join(many, F.col("__digest") == F.col("__of")).select(*key, F.struct(F.col("__k").alias("k"), F.col("__digest").alias("digest"), (place != F.col("first")).alias("later")).alias("hit"))

    def met(again: DataFrame) -> DataFrame:
        lists = again.groupBy(*key).agg(F.sort_array(F.collect_list("hit")).alias("__hits"))
        by = lists.select(*[F.col(c).alias(f"{c}_of") for c in key], "__hits")
        on = rows["__id"].eqNullSafe(F.col("__id_of")) & (rows["__uid"] == F.col("__uid_of"))
        return rows.join(by.hint("merge"), on, "left").drop(*[f"{c}_of" for c in key])

    joined = kept(met(again), "met")
    bodies = F.transform("__hits", lambda h: F.struct(h["digest"].alias("digest"), _chunk_text(F.element_at("__chunks", h["k"] + 1)).alias("body")))
    found = chunked(joined.where("__hits IS NOT NULL").select("text", "__hits")).select(F.explode(bodies).alias("x")).select("x.digest", "x.body")
    differ = kept(found.groupBy("digest", "body").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("bad")), "differ")
    if not differ.isEmpty():  # equal digests of other bytes: those chunks stay
        joined = kept(met(again.join(differ, F.col("hit.digest") == F.col("bad"), "left_anti")), "met")
    gone = F.transform(F.filter("__hits", lambda h: h["later"]), lambda h: h["k"])
    steps = F.zip_with(_later(gone, F.lit(-1)), gone, lambda a, b: F.concat(F.repeat(F.lit("0"), b - a - 1), F.lit("1")))
    flags = F.array_join(steps, "").cast("binary")  # a byte a chunk, which is looked up in constant time
    cut = chunked(joined).withColumn("__flags", F.when(F.size(gone) > 0, flags))
    flagged = F.transform("__chunks", lambda c, i: F.struct(c.alias("c"), (F.substring("__flags", i + 1, F.lit(1)) == F.lit(b"1")).alias("gone")))
    cut = cut.withColumn("__flagged", F.when(F.col("__flags").isNotNull(), flagged))
    left = F.array_join(F.transform(F.filter("__flagged", lambda x: ~x["gone"]), lambda x: _chunk_text(x["c"])), "\n")
    removed = F.aggregate(F.filter("__flagged", lambda x: x["gone"]), F.lit(0), lambda n, x: n + x["c"]["lines"])
    text = F.when(F.col("__flagged").isNotNull(), left).otherwise(F.col("text").cast("string"))
    # a generator: filters on what it makes aren't pushed below, where they would work out all of it once more for each line
    made = F.struct(text.alias("text"), F.greatest(F.size("__lines"), F.lit(0)).alias("__n_lines"), F.coalesce(removed, F.lit(0)).alias("__n_removed"))
    out = cut.select(*[F.col(c) for c in docs.columns if c != "text"], F.inline(F.array(made)))
    return out.select(*docs.columns, "__n_lines", "__n_removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` after `line_dedup`, same columns; n_chars follows the text, and texts that lost all their lines go."""
    out = line_dedup(docs).where("__n_removed = 0 OR __n_removed < __n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


OP3_SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
hashed AS (SELECT *, len(lines) AS n, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM split),
rolled AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN i > 1 THEN (h[i - 1] * {FACTOR} + h[i]) % {MODULUS} END) AS g FROM hashed),
ends AS (SELECT *, list_filter(range(1, n + 1), lambda i: i = n OR (i >= 2 AND i <= n - 2 AND (i = 2 OR g[i] < g[i - 1]) AND g[i] <= g[i + 1])) AS e FROM rolled),
chunks AS (SELECT doc_id, lines, n, k, CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END AS a, e[k] AS b FROM (SELECT *, unnest(range(1, len(e) + 1)) AS k FROM ends)),
texts AS (SELECT doc_id, n, k, b - a + 1 AS size, array_to_string(lines[a:b], chr(10)) AS body FROM chunks),
ranked AS (SELECT *, size > 1 AND row_number() OVER (PARTITION BY size > 1, body ORDER BY doc_id, k) > 1 AS gone FROM texts)
SELECT doc_id, CAST(any_value(n) AS INTEGER) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN size END), 0) AS INTEGER) AS n_removed,
  coalesce(string_agg(CASE WHEN NOT gone THEN body END, chr(10) ORDER BY k), '') AS text
FROM ranked GROUP BY doc_id
"""
