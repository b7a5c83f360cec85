"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document of `size` words in a source whose target is `f` times its size should be taken `f` times on average. The whole
part of that is taken outright. The fractional parts meet in pairs: words move at random from one document to the other,
without bias, until one of the two is taken or left for good; the other goes on with what remains. The words of a source
are thus kept at every step, and at the end at most one document a source is left, which is rounded to the nearer side.

What is left last of a source can be a document so large that rounding it misses the target by far. So documents that hold
much of their source's target (`CLASSES`) are rounded first, in trees of their own, and smaller ones then share what remains
of the target, each taken as often as that asks for. Every document is still taken `f` times on average.

Pairs form in a reduction tree. Documents of a source are dealt by a hash of their doc_id into blocks of about `BLOCK`;
each block folds to one residual document, the residuals form the next level's blocks, and so on until each source has
one. A block pairs its larger documents first, so that what is left at its end is small. Blocks are bounded, so a hot
source is spread like any other, and only (doc_id, source, size) is shuffled, never texts.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import kept, partitions

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
#: Shares of a source's target: documents above the first are rounded before those above the second, and so on.
CLASSES = (0.08, 0.004)
SEED = 20_240_501
EPS = 1e-9
NAMES = ("at", "tie", "doc_id", "size", "p")


def _uniform(*cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11) / F.lit(float(1 << 53))


def ranked(sources: DataFrame) -> DataFrame:
    """`sources` with `rank`: 0-based place of `source` by code point, null last, without a single task for all of them."""
    n = partitions(sources.sparkSession)
    order = F.asc_nulls_last("source")
    dealt = sources.repartitionByRange(n, order).sortWithinPartitions(order)
    dealt = kept(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "sources")
    first, at = {}, 0
    for part, count in sorted((r[0], r[1]) for r in dealt.groupBy("part").count().collect()):  # at most n rows
        first[part] = at
        at += count
    if not first:
        return dealt.select("*", F.lit(0).cast("bigint").alias("rank")).drop("part", "place")
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("part"))
    return dealt.withColumn("rank", F.col("place") + offset).drop("part", "place")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, ...) with `target`: `share` of all sizes by weight, where none passes `most` times its size.

    What is above a source's bound is shared again by weight. The level (target a unit of weight) that results only
    rises; each round is one aggregate row.
    """
    weighed = kept(ranked(sources).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))), "weights")
    total, all_w = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    level, bound = (share * total / all_w if total else 0.0), most * F.col("source_size")
    while total:
        full = bound <= F.lit(level) * F.col("w")
        taken, free = weighed.agg(F.sum(F.when(full, bound)), F.sum(F.when(~full, F.col("w")))).first()
        new = (share * total - (taken or 0.0)) / free if free else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return weighed.withColumn("target", F.least(bound, F.lit(level) * F.col("w"))).drop("rank", "w")


def _fold(items: Column, level: int) -> Column:
    """Pivotal rounding of an array of (at, tie, doc_id, size, p) in order: (one: array of (doc_id, size) taken once more, left: the residual)."""
    item = "struct<at:double,tie:bigint,doc_id:bigint,size:bigint,p:double>"
    taken = "array<struct<doc_id:bigint,size:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        sa, pa, sx, px = a["size"].cast("double"), a["p"], x["size"].cast("double"), x["p"]
        up, down = F.least(sa * (1 - pa), sx * px), F.least(sa * pa, sx * (1 - px))
        rise = _uniform(F.lit(level), a["tie"], x["tie"], a["size"], x["size"]) * (up + down) < down
        settled = F.when(rise, sa * (1 - pa) <= sx * px).otherwise(sa * pa <= sx * (1 - px))
        rest = lambda y, p: F.struct(y["at"].alias("at"), y["tie"].alias("tie"), y["doc_id"].alias("doc_id"), y["size"].alias("size"), p.alias("p"))
        moved = F.when(settled, rest(x, F.when(rise, px - up / sx).otherwise(px + down / sx))).otherwise(rest(a, F.when(rise, pa + up / sa).otherwise(pa - down / sa)))
        one = lambda y: F.struct(y["doc_id"].alias("doc_id"), y["size"].alias("size"))
        more = F.when(settled & rise, F.array(one(a))).when(~settled & ~rise, F.array(one(x))).otherwise(F.array().cast(taken))
        first = a["size"].isNull()
        return F.struct(F.when(first, acc["one"]).otherwise(F.concat(acc["one"], more)).alias("one"), F.when(first, x).otherwise(moved).cast(item).alias("left"))

    start = F.struct(F.array().cast(taken).alias("one"), F.lit(None).cast(item).alias("left"))
    return F.aggregate(items, start, step)


def _rounded(units: DataFrame, blocks_by: DataFrame, block: int, seed: int) -> DataFrame:
    """(key, doc_id, size, more = 1): which of `units` (key, doc_id, size, p) with a fraction p are taken once more; `blocks_by`: (key, n) units of a source."""
    plan = kept(blocks_by.select(F.col("key").alias("of"), F.ceil(F.col("n") / block).alias("blocks")), "plan")  # its size is known then: units don't move to meet it
    item = F.struct((-F.col("size").cast("double")).alias("at"), F.xxhash64(F.lit(SEED), "doc_id", "size").alias("tie"), "doc_id", "size", "p")
    met = units.where(F.col("p") > EPS).join(plan, F.col("key") == F.col("of"))
    deal = met.select("key", "blocks", item.alias("item"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("blocks")).alias("block"))
    blocks, level, taken = (plan.agg(F.max("blocks")).first()[0] or 0), 0, None
    while True:
        folded = deal.groupBy("key", "blocks", "block").agg(_fold(F.sort_array(F.collect_list("item")), level).alias("f"))
        folded = kept(folded.select("key", "blocks", "f.one", "f.left"), "fold")
        one = folded.select("key", F.explode("one").alias("o")).select("key", "o.doc_id", "o.size")
        taken = one if taken is None else taken.unionByName(one)
        level += 1
        if blocks <= 1:
            break
        blocks = ceil(blocks / block)
        narrower = F.ceil(F.col("blocks") / block)
        deal = folded.where("left IS NOT NULL").select("key", narrower.alias("blocks"), F.col("left").alias("item"), F.pmod(F.xxhash64(F.lit(seed + level), "left.doc_id", "left.size"), narrower).alias("block"))
    last = folded.where("left IS NOT NULL").where("left.p >= 0.5").select("key", "left.doc_id", "left.size")
    return taken.unionByName(last).withColumn("more", F.lit(1))


def _copies(units: DataFrame, factor: DataFrame, block: int, seed: int) -> DataFrame:
    """`units` (key, doc_id, size, rows) with copies: each is taken `factor` (key, factor) times its rows, rounded."""
    aimed = units.join(factor.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).withColumn("e", F.col("factor") * F.col("rows"))
    aimed = aimed.withColumn("whole", F.floor(F.col("e") + EPS)).withColumn("p", F.col("e") - F.col("whole")).drop("of", "factor", "e")
    more = _rounded(aimed, units.groupBy("key").agg(F.count("*").alias("n")), block, seed).select(F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("s"), "more")
    out = aimed.join(more, (aimed["key"] == more["k"]) & aimed["doc_id"].eqNullSafe(more["d"]) & (aimed["size"] == more["s"]), "left")
    return out.select(*units.columns, (F.col("whole") + F.coalesce("more", F.lit(0))).alias("copies"))


def allotted(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """One row for each distinct (source, doc_id, size): with rows (how many), source_size, target, copies (of all its rows).

    Size: words of the text, 0 where it is null or blank; such rows are never taken. Whole texts are counted, however long. A
    null source is a source, the last one. Rows that repeat (source, doc_id, size) share their copies evenly. Other columns
    are ignored. An empty table gives an empty result. The result depends only on these columns, not on the order or
    partitions of the rows. A source's words come within half of the last of `CLASSES` of its target, but where its large documents
    leave more or less than the others can take.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")
    units = kept(rows.groupBy(key, "source", "doc_id", "size").agg(F.count("*").alias("rows")), "units")
    sources = units.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    aims = kept(targets(sources, weights, share, most).drop("source"), "aims")
    own = ("key", "source", "doc_id", "size", "rows")
    sized = units.where("size > 0").join(aims.select(F.col("key").alias("of"), "target"), F.col("key") == F.col("of"))
    place = sum((F.col("size") <= F.lit(c) * F.col("target")).cast("int") for c in CLASSES)
    state, out = aims.withColumns({"held": F.lit(0).cast("bigint"), "beside": F.lit(0).cast("bigint")}), units.where("size = 0").select(*own, F.lit(0).cast("bigint").alias("copies"))
    for k in range(len(CLASSES) + 1):
        room = F.col("source_size") - F.col("beside")
        asked = F.when(room > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("target") - F.col("held")) / room))).otherwise(0.0)
        done = kept(_copies(sized.where(place == k).select(*own), state.select("key", asked.alias("factor")), block, SEED + 1 + 100 * k), "rounded")
        out = out.unionByName(done)
        if k < len(CLASSES):
            gone = done.groupBy(F.col("key").alias("of")).agg(F.sum(F.col("copies") * F.col("size")).alias("more_held"), F.sum(F.col("rows") * F.col("size")).alias("more_beside"))
            grown = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("held", "beside")}
            state = kept(state.join(gone, F.col("key") == F.col("of"), "left").select("key", "target", "source_size", *[x.alias(c) for c, x in grown.items()]), "state")
    return out.join(aims.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).select("source", "doc_id", "size", "rows", "source_size", "target", "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it is taken, all columns and `copy` (1, 2, ...).

    A column `copy` of `docs` is replaced. Nulls, empty texts, repeated rows and empty tables are as in `allotted`.
    """
    found = kept(allotted(docs, **options).where("copies > 0"), "allotted")
    clash = {c: f"mix__{c}" for c in ("source", "doc_id", "size", "rows", "copies")}
    found = found.select(*[F.col(k).alias(v) for k, v in clash.items()])
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    on = docs["doc_id"].eqNullSafe(F.col("mix__doc_id")) & docs["source"].eqNullSafe(F.col("mix__source"))
    same = kept(found.where("mix__rows > 1").limit(1), "repeats")
    out = docs.join(found.hint("merge"), on & (size == F.col("mix__size")))  # as many as documents: the same plan at every size
    if same.isEmpty():
        times = F.col("mix__copies")
    else:
        from pyspark.sql import Window

        of = Window.partitionBy("mix__source", "mix__doc_id", "mix__size").orderBy(F.xxhash64("text"))
        out = out.withColumn("mix__place", F.row_number().over(of))
        times = F.floor(F.col("mix__copies") / F.col("mix__rows")) + (F.col("mix__place") <= F.col("mix__copies") % F.col("mix__rows")).cast("bigint")
    copies = F.when(times > 0, F.sequence(F.lit(1).cast("bigint"), times)).otherwise(F.array().cast("array<bigint>"))
    return out.select(*[docs[c] for c in docs.columns if c != "copy"], F.explode(copies).alias("copy"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    units = allotted(read_table(spark, sf_dir, "documents"))
    each = units.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    copies = F.floor(F.col("copies") / F.col("rows")) + (F.col("i") <= F.col("copies") % F.col("rows")).cast("bigint")
    return each.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))
