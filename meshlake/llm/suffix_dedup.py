"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a string of `LENGTH` bytes that also starts earlier (in a smaller doc_id, or earlier in the same
document). Matches never cross documents and are judged on the input.

Sparse suffixes. In every window of LENGTH bytes the least hash of its 32-byte strings marks an anchor. Equal windows have
the same anchor, so only suffixes at anchors (3 % of all) need comparing: windows that share an anchor form a run, and a
run's bytes, on both sides of its anchor, are its context. Where a task meets a context again (equal bytes) it is a repeat at
once, and doesn't travel. Of the others only hashes of anchors travel first, without bytes: an anchor that occurs once in
all can't match. The contexts of the rest (a quarter of all runs) are read from the texts and dealt over the cluster by anchor.

Index family. Each task takes its contexts in document order, a batch at a time. A batch gets a suffix array: its contexts
in byte order from the anchor on. It is merge-scanned against every existing level, which shows contexts that are there
already and anchors that stand in other contexts too; of the latter, windows of LENGTH bytes are compared in byte order. The
batch then becomes a level, and levels of about equal size merge, so there are only logarithmically many. All decisions are
by bytes; hashes only choose anchors and tasks.

An anchor that stands in very many contexts (a common line between other text) would make an uneven task. Such anchors are
as many as a small multiple of the tasks at most; their runs are cut further by the anchors of other hashes, which often lie
in the text around, and dealt by all of them.

Texts move once, keyed by document: to be read for contexts and to be cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import kept, partitions

LENGTH = 100
ANCHOR = 32
SPAN = LENGTH - ANCHOR + 1
#: Bytes of text taken at once, and runs a task holds before it combines them.
CHUNK = 1 << 18
HELD = 150_000
#: Bytes of text for each task's index.
GROUP_BYTES = 24 << 20
#: Most contexts that make a batch of the index.
BATCH = 1 << 14
#: Rows of a batch that is sent on.
ROWS = 20_000
#: An anchor is common if it has more than a task's mean share of contexts, divided by this.
COMMON = 4
#: Hashes by which runs of common anchors are cut further.
SALTS = (1, 2, 3)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64((1 << 24) - 1)
#: A context as a key: bytes from the anchor on, bytes before it in reverse, and how many they are.
KEY = 176


def anchors(buffer: bytes, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each window start, (anchor position, hash of the anchor's bytes by position); another salt chooses other anchors."""
    size = len(buffer)
    x = np.empty(size - 7, np.uint64)
    for o in range(8):
        v = np.frombuffer(buffer, "<u8", (size - o) // 8, o)
        x[o::8] = v[: len(x[o::8])]
    m = size - ANCHOR + 1
    h = x[:m] * _M[0]
    for i in range(1, ANCHOR // 8):
        h += x[8 * i : 8 * i + m] * _M[i]
    h += np.uint64(salt * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    h ^= h >> np.uint64(29)
    h *= _M[1]
    h ^= h >> np.uint64(32)
    low = (h & ~_LOW) | np.arange(m, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[: width - SPAN], low[SPAN - width :])
    return (low & _LOW).astype(np.int64), h


def runs(texts: list[bytes], salt: int = 0) -> tuple[np.ndarray, list[bytes]]:
    """Runs of the windows of `texts`, as rows (text, start, windows, place of the anchor from start, hash of the anchor), and their contexts."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    buffer = b"".join(texts)
    count = np.maximum(size - LENGTH + 1, 0)
    if not count.sum():
        return np.zeros((5, 0), np.int64), []
    at, h = anchors(buffer, salt)
    text = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + begin[text]
    own = at[start]
    cut = np.concatenate([[0], np.nonzero((own[1:] != own[:-1]) | (text[1:] != text[:-1]))[0] + 1])
    n, low = np.diff(np.append(cut, len(text))), start[cut]
    made = np.stack([text[cut], low - begin[text[cut]], n, own[cut] - low, h[own[cut]].view(np.int64)])
    return made, [buffer[i:j] for i, j in zip(low.tolist(), (low + n + (LENGTH - 1)).tolist())]


def pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(texts, numbers, first bytes) of at most about CHUNK bytes; long texts come in pieces that share LENGTH - 1 bytes."""
    part: list[bytes] = []
    number: list[int] = []
    first: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            piece = t[k : k + CHUNK + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            part.append(piece)
            number.append(i)
            first.append(k)
            size += len(piece)
            if size >= CHUNK:
                yield part, np.array(number), np.array(first)
                part, number, first, size = [], [], [], 0
    if part:
        yield part, np.array(number), np.array(first)


RUN = np.dtype([("anchor", "<i8"), ("doc", "<i8"), ("copy", "<i4"), ("start", "<i4"), ("n", "<u1"), ("at", "<u1")])
FOUND = "doc bigint, copy int, start int, n int"
RUNS = f"{FOUND}, at int, anchor bigint"
#: `to`: by what a context is dealt, its anchor at first.
CONTEXTS = f"{FOUND}, at int, to bigint, context binary"
NULLS = 1 << 30


def _batch(rows: np.ndarray, names: str, context: list[bytes | None] | None = None) -> pa.RecordBatch:
    """Rows (doc, copy, start, n, at, anchor; as many as `names` has) as columns."""
    own = [x.split() for x in names.split(", ")][: len(rows)]
    columns = [pa.array(rows[i].astype(np.int64 if kind == "bigint" else np.int32)) for i, (_, kind) in enumerate(own)]
    extra = [] if context is None else [pa.array(context, pa.binary())]
    return pa.record_batch([*columns, *extra], names=[n for n, _ in own] + ["context"] * len(extra))


class _Combiner:
    """Collects runs (doc, copy, start, n, at, anchor) with contexts; of equal contexts the earliest keeps its bytes, the others become None."""

    def __init__(self):
        self.rows: list[np.ndarray] = []
        self.contexts: list[bytes] = []

    def take(self, rows: np.ndarray, contexts: list[bytes]) -> bool:
        """Whether it is time to flush."""
        self.rows.append(rows)
        self.contexts += contexts
        return len(self.contexts) >= HELD

    def flush(self) -> tuple[np.ndarray, list[bytes | None]]:
        rows, contexts = np.concatenate([*self.rows, np.zeros((6, 0), np.int64)], axis=1), self.contexts
        self.rows, self.contexts = [], []
        order = np.lexsort((rows[2], rows[1], rows[0]))
        met: set[bytes] = set()
        out: list[bytes | None] = []
        for i in order.tolist():
            c = contexts[i]
            out.append(None if c in met else c)
            met.add(c)
        return rows[:, order], out


def _map_runs(tasks: int, repeats: bool):
    """(doc, copy, body) to the runs that a task has met before (`FOUND`), or to the others, packed by task of their anchor (part, runs).

    Both read the same rows in the same order, so every run is in one of the two.
    """

    def send(combiner: _Combiner) -> Iterator[pa.RecordBatch]:
        rows, contexts = combiner.flush()
        again = np.array([c is None for c in contexts], bool)
        if repeats:
            if again.any():
                yield _batch(rows[:4, again], FOUND)
            return
        rows = rows[:, ~again]
        packed = np.zeros(rows.shape[1], RUN)
        for name, row in zip(("doc", "copy", "start", "n", "at", "anchor"), rows):
            packed[name] = row
        part = (packed["anchor"].view(np.uint64) % np.uint64(tasks)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        packed, part = packed[order], part[order]
        cut = np.nonzero(np.diff(part, prepend=-1, append=-1))[0] if len(part) else np.zeros(1, np.int64)
        if len(part):
            blobs = [packed[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
            yield pa.record_batch([pa.array(part[cut[:-1]]), pa.array(blobs, pa.binary())], names=["part", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = _Combiner()
        for b in batches:
            doc, copy = np.asarray(b.column(0)), np.asarray(b.column(1)).astype(np.int64)
            for texts, number, first in pieces(b.column(2).to_pylist()):
                made, contexts = runs(texts)
                of = number[made[0]]
                if combiner.take(np.stack([doc[of], copy[of], made[1] + first[made[0]], *made[2:]]), contexts):
                    yield from send(combiner)
        yield from send(combiner)

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of packed runs, those whose anchor occurs more than once (`RUNS`)."""
    r = np.concatenate([np.frombuffer(x.as_buffer(), RUN) for x in table.column("runs")])
    r = r[np.argsort(r["anchor"], kind="stable")]
    same = np.zeros(len(r), bool)
    equal = r["anchor"][1:] == r["anchor"][:-1]
    same[1:] |= equal
    same[:-1] |= equal
    r = r[same]
    return pa.Table.from_batches([_batch(np.stack([r[c].astype(np.int64) for c in ("doc", "copy", "start", "n", "at", "anchor")]), RUNS)])


def _split_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`CONTEXTS` of common anchors to shorter runs, dealt by further anchors; what is equal to an earlier one of the task loses its context."""
    combiner = _Combiner()

    def send() -> Iterator[pa.RecordBatch]:
        rows, contexts = combiner.flush()
        again = np.array([c is None for c in contexts], bool)
        rows[5, again] = rows[0, again] * 31 + rows[2, again]  # a repeat has no bytes to meet others with
        for k in range(0, len(contexts), ROWS):
            yield _batch(rows[:, k : k + ROWS], CONTEXTS, contexts[k : k + ROWS])

    for b in batches:
        rows = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(6)])
        contexts = b.column(6).to_pylist()
        for salt in SALTS:
            made, contexts = runs(contexts, salt)
            old = rows[:, made[0]]
            mixed = (old[5].view(np.uint64) * _M[2] ^ made[4].view(np.uint64)).view(np.int64)
            rows = np.stack([old[0], old[1], old[2] + made[1], made[2], old[4] - made[1], mixed])
        if combiner.take(rows, contexts):
            yield from send()
    yield from send()


def keys(contexts: pa.BinaryArray, at: np.ndarray) -> np.ndarray:
    """Contexts with anchors at `at` as rows of `KEY` bytes, whose byte order is that of the suffixes that begin at the anchors."""
    n = len(contexts)
    edge = np.frombuffer(contexts.buffers()[1], np.int32, n + 1, 4 * contexts.offset).astype(np.int64)
    data = np.frombuffer(contexts.buffers()[2], np.uint8)
    begin, size = edge[:-1], np.diff(edge)
    right, left = size - at, at
    out = np.zeros((n, KEY), np.uint8)
    place = np.arange(LENGTH)
    ok = place < right[:, None]
    out[:, :LENGTH] = np.where(ok, data[np.where(ok, (begin + at)[:, None] + place, 0)], 0)
    place = np.arange(SPAN - 1)
    ok = place < left[:, None]
    out[:, LENGTH : LENGTH + SPAN - 1] = np.where(ok, data[np.where(ok, (begin + at - 1)[:, None] - place, 0)], 0)
    out[:, KEY - 2], out[:, KEY - 1] = right, left + 1
    return out


def _in_order(k: np.ndarray) -> np.ndarray:
    """The suffix array: a stable order by bytes. Sorted runs in it are merged, not sorted again."""
    return np.argsort(np.ascontiguousarray(k).view(f"S{k.shape[1]}").ravel(), kind="stable")


def _change(k: np.ndarray, width: int) -> np.ndarray:
    """Whether each row differs from the one before in its first `width` bytes (a multiple of 8)."""
    words = k.view(np.uint64)[:, : width // 8]
    return np.append(True, (words[1:] != words[:-1]).any(axis=1))[: len(k)]


def _longest(k: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The longest prefix that each row of `k` (of which `size` bytes count) shares with another of its group."""
    head = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    order = _in_order(np.concatenate([head, k], axis=1))
    a, b = order[:-1], order[1:]
    equal = k[a] == k[b]
    length = np.where(equal.all(axis=1), k.shape[1], equal.argmin(axis=1))
    length = np.where(group[a] == group[b], np.minimum(length, np.minimum(size[a], size[b])), 0)
    best = np.zeros(len(k), np.int64)
    np.maximum.at(best, a, length)
    np.maximum.at(best, b, length)
    return best


class SuffixFamily:
    """A logarithmic family of sparse suffix arrays: levels of distinct contexts in the byte order of their suffixes."""

    def __init__(self):
        self.levels: list[np.ndarray] = []
        self.merges = self.scans = 0

    def add(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take a batch of keys, in order of place and all later than what is there: (row, window) of the windows that are repeats."""
        order = _in_order(batch)
        array = batch[order]
        first = _change(array, KEY)
        known = ~first
        group = np.cumsum(_change(array, ANCHOR)) - 1
        distinct = np.bincount(group, first, minlength=group[-1] + 1)
        others: list[tuple[np.ndarray, np.ndarray]] = []
        for level in self.levels:
            self.scans += 1
            both = np.concatenate([level, array])
            merged = _in_order(both)
            scan, new = both[merged], merged >= len(level)
            whole, near = _change(scan, KEY), np.cumsum(_change(scan, ANCHOR)) - 1
            block = np.cumsum(whole) - 1
            old = np.zeros(block[-1] + 1, bool)
            old[block[~new]] = True
            known[merged[new] - len(level)] |= old[block[new]]
            of = np.full(near[-1] + 1, -1)
            of[near[new]] = group[merged[new] - len(level)]
            met = ~new & (of[near] >= 0)
            others.append((scan[met], of[near[met]]))
            distinct += np.bincount(of[near[met]], minlength=len(distinct))
        fresh = first & ~known
        contested = fresh & (distinct[group] > 1)
        row, window = order[known], None
        n = self._windows(batch)
        whole_rows = np.repeat(row, n[row])
        whole_windows = np.arange(len(whole_rows)) - np.repeat(np.cumsum(n[row]) - n[row], n[row])
        rows, windows = [whole_rows], [whole_windows]
        if contested.any():
            row, window = self._partly([x for x in others if len(x[0])], array[contested], group[contested], order[contested])
            rows.append(row)
            windows.append(window)
        if fresh.any():
            self._push(array[fresh])
        return np.concatenate(rows), np.concatenate(windows)

    @staticmethod
    def _windows(k: np.ndarray) -> np.ndarray:
        return k[:, KEY - 2].astype(np.int64) + k[:, KEY - 1] - LENGTH

    def _push(self, level: np.ndarray) -> None:
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            both = np.concatenate([self.levels[-2], self.levels[-1]])
            self.levels[-2:] = [both[_in_order(both)]]
            self.merges += 1

    def _partly(self, others: list, new: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, window) of the new contexts' windows that an older context or an earlier new one of the same anchor has."""
        order = np.argsort(place, kind="stable")
        new, group, place = new[order], group[order], place[order]
        k = np.concatenate([*(x for x, _ in others), new])
        g = np.concatenate([*(x for _, x in others), group])
        row = np.concatenate([np.full(len(k) - len(new), -1), place])
        right, left = k[:, KEY - 2].astype(np.int64), k[:, KEY - 1].astype(np.int64) - 1
        reach = _longest(k[:, :LENGTH], right, g) + _longest(k[:, LENGTH : LENGTH + SPAN - 1], left, g) >= LENGTH
        k, row, right, left = k[reach], row[reach], right[reach], left[reach]
        if not len(k):
            return row, row
        n = right + left - LENGTH + 1
        of = np.repeat(np.arange(len(k)), n)
        window = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        line = np.concatenate([k[:, LENGTH : LENGTH + SPAN - 1][:, ::-1], k[:, :LENGTH]], axis=1)  # bytes before the anchor end at SPAN - 1
        bytes_ = np.zeros((len(of), LENGTH + 4), np.uint8)
        for i in range(0, len(of), 1 << 16):
            part = slice(i, i + (1 << 16))
            low = (SPAN - 1 - left[of[part]] + window[part])[:, None] + np.arange(LENGTH)
            bytes_[part, :LENGTH] = line[of[part][:, None], low]
        array = _in_order(bytes_)
        again = array[~_change(bytes_[array], LENGTH + 4)]  # the first of equal windows is the earliest
        again = again[row[of[again]] >= 0]
        return row[of[again]], window[again]


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`CONTEXTS` in order of place to repeated windows, as runs (`FOUND`); a run without its context is a repeat already."""
    index = SuffixFamily()
    for b in batches:
        whole = np.asarray(b.column(6).is_null())
        rows = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(5)])
        if whole.any():
            yield _batch(rows[:4, whole], FOUND)
            b, rows = b.filter(pa.array(~whole)), rows[:, ~whole]
        for k in range(0, b.num_rows, BATCH):
            doc, copy, start, _, at = rows[:, k : k + BATCH]
            row, window = index.add(keys(b.column(6).slice(k, BATCH), at))
            if not len(row):
                continue
            place = np.sort(row << 8 | window)
            cut = np.concatenate([[0], np.nonzero(np.diff(place) != 1)[0] + 1])
            i, j = place[cut] >> 8, place[cut] & 255
            yield _batch(np.stack([doc[i], copy[i], start[i] + j, np.diff(np.append(cut, len(place)))]), FOUND)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, copy, body): null ids come last (as the greatest doc, with copies from `NULLS`); rows that repeat an id are numbered in order of their digests."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    if rows.groupBy("doc").agg(F.count("*").alias("n")).where(f"n > 1 OR doc = {(1 << 63) - 1}").isEmpty():
        return rows.select("doc", F.lit(0).alias("copy"), "body")
    null = F.col("doc_id").isNull()
    of = Window.partitionBy("doc").orderBy(null, F.sha2("body", 256))
    return kept(rows.select("doc", (F.row_number().over(of) + F.when(null, NULLS).otherwise(0)).alias("copy"), "body"), "keyed")


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(doc, copy, start, n): runs of windows in `rows` (doc, copy, body) whose bytes also start earlier."""
    spark = rows.sparkSession
    tasks = max(partitions(spark), ceil((rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0) / GROUP_BYTES))
    packed = rows.mapInArrow(_map_runs(tasks, False), "part bigint, runs binary")
    shared = kept(packed.groupBy("part").applyInArrow(_shared_anchors, RUNS), "shared")
    most = shared.count() / (COMMON * tasks)
    common = kept(shared.groupBy("anchor").count().where(F.col("count") > max(16, most)).select(F.col("anchor").alias("often")), "common")  # fewer than COMMON * tasks
    marked = shared.join(common, shared["anchor"] == common["often"], "left")
    run = F.struct("start", "n", "at", "anchor", F.col("often").isNotNull().alias("often"))
    wanted = marked.groupBy(F.col("doc").alias("d"), F.col("copy").alias("c")).agg(F.collect_list(run).alias("wanted"))
    met = rows.join(wanted, (rows["doc"] == wanted["d"]) & (rows["copy"] == wanted["c"]))  # moves texts as `suffix_dedup` does: Spark reuses the exchange
    each = met.select("doc", "copy", "body", F.explode("wanted").alias("w"))
    context = F.substring("body", F.col("w.start") + 1, F.col("w.n") + (LENGTH - 1))
    each = each.select("doc", "copy", "w.start", "w.n", "w.at", F.col("w.anchor").alias("to"), context.alias("context"), "w.often")
    found = each.where("NOT often").drop("often")
    if not common.isEmpty():
        found = found.unionByName(each.where("often").drop("often").mapInArrow(_split_runs, CONTEXTS))
    dealt = found.repartition(tasks, "to").sortWithinPartitions("doc", "copy", "start")
    return dealt.mapInArrow(_family, FOUND).unionByName(rows.mapInArrow(_map_runs(tasks, True), FOUND))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = []
        for body, hits in zip(b.column(1), b.column(2)):
            data = body.as_py()
            if not hits.is_valid:
                made.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data))
                continue
            flat = hits.values
            start = np.asarray(flat.field("start")).astype(np.int64)
            end = start + np.asarray(flat.field("n")) + (LENGTH - 1)
            mark = np.zeros(len(data) + 1, np.int64)
            np.add.at(mark, start, 1)
            np.add.at(mark, end, -1)
            gone = np.cumsum(mark[:-1]) > 0
            left = np.frombuffer(data, np.uint8)[~gone].tobytes()
            made.append((len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest(), left))
        cols = list(zip(*made)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.record_batch([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: what is left, as bytes) of each row.

    A null text is empty; texts under 100 bytes lose nothing. A null doc_id is later than all others. Rows that repeat a
    doc_id are documents of their own, in order of their texts' digests. Other columns are ignored. An empty table gives an
    empty result. Cuts are by bytes, so what is left need not be whole characters.
    """
    rows = keyed(docs)
    hits = repeated_runs(rows).groupBy(F.col("doc").alias("d"), F.col("copy").alias("c")).agg(F.collect_list(F.struct("start", "n")).alias("hits"))
    met = rows.join(hits, (rows["doc"] == hits["d"]) & (rows["copy"] == hits["c"]), "left")
    met = met.select(F.when(F.col("copy") < NULLS, F.col("doc")).alias("doc_id"), "body", "hits")
    return met.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    return suffix_dedup(read_table(spark, sf_dir, "documents")).drop("kept")
