"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are leaves of a binary trie. Node pairs are walked together from the root, level by level: a pair's differing
bits add up, and it is left as soon as they pass what its depth allows (`walk`). Leaf pairs of a few fingerprints are compared.

To let the budget bite near the root, the bits are turned so that one of three blocks comes first. Two fingerprints at most
`radius` bits apart differ in at most b bits of some block, if the blocks' b + 1 add up to radius + 1 (1, 1 and 0 bits for a
radius of 4). So each of three tries allows b errors in its first block and `radius` below it, and together they miss nothing.

Node pairs at a first cut are dealt over the cluster, each fingerprint to those of its node; a pair that holds more than
`cap` is cut eight levels deeper, and so on, so memory is bounded and no link is lost. Each task returns a spanning forest of
its links, never all pairs, and components join the forests. Only distinct fingerprints are joined.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import kept, partitions
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Most fingerprints of a node pair that one task takes at once; larger pairs are cut deeper.
CAP = 20_000
#: Fingerprints below a node of the first cut, on average, at most.
SUBTREE = 2048
#: Levels by which a large node pair is cut deeper.
DEEPER = 8
#: Node pairs with no more products than this are leaves, compared directly.
LEAF = 16
#: Node pairs that are walked at once.
FRONT = 1 << 17


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of `text` (UTF-8); 0 where there are no words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and splits at \x20 \x09-\x0d only
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words) - shingle + 1
    if n < 2:
        hashes = [xxhash.xxh64_intdigest(flat, seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[i:j], seed) for i, j in zip((end - size)[:n].tolist(), end[shingle - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[k : k + (1 << 16)], np.uint64).view(np.uint8))
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp: bigint, the signed form) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


class Forest:
    """Union-find over 0..n-1 that takes arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            further = self.parent[up]
            if (further == up).all():
                self.parent[x] = up
                return up
            up = further

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            if not apart.any():
                return
            a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            self.parent[a] = b  # of several writers one wins; the others stay apart and come again


class Walk:
    """Tries over `fp` (n x words, sorted within each trie) and the links that walking their node pairs finds.

    `allow` (kind of trie x depth): how many bits two nodes at a depth may differ in. A node pair is (a, b, c, d, err, kind):
    rows a to b against rows c to d, with `err` bits that differ above.
    """

    def __init__(self, fp: np.ndarray, allow: np.ndarray):
        self.fp, self.allow, self.bits, self.radius = fp, allow, 64 * fp.shape[1], int(allow[0, -1])
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.visited = self.pruned = 0

    def _leaves(self, f: np.ndarray) -> None:
        n = (f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2])
        of = np.repeat(np.arange(len(f)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        wide = (f[:, 3] - f[:, 2])[of]
        i, j = f[of, 0] + k // wide, f[of, 2] + k % wide
        i, j = i[i != j], j[i != j]
        near = np.bitwise_count(self.fp[i] ^ self.fp[j]).sum(axis=1, dtype=np.int64) <= self.radius
        if near.any():
            self.pairs.append((i[near], j[near]))

    def run(self, roots: np.ndarray, depth: int = 0) -> Walk:
        """Walk from `roots` (k x 6), which stand at `depth`."""
        stack = [(depth, roots)]
        while stack:
            depth, f = stack.pop()
            if len(f) > FRONT:
                stack += [(depth, f[FRONT:]), (depth, f[:FRONT])]
                continue
            self.visited += len(f)
            leaf = ((f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2]) <= LEAF) | (depth == self.bits)
            self._leaves(f[leaf])
            f = f[~leaf]
            if not len(f):
                continue
            a, b, c, d, err, kind = f.T
            low, high = int(f[:, [0, 2]].min()), int(f[:, [1, 3]].max())
            ones = np.zeros(high - low + 1, np.int64)
            np.cumsum((self.fp[low:high, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1), out=ones[1:])
            x, y = b - ones[b - low] + ones[a - low], d - ones[d - low] + ones[c - low]  # where the bit turns to one
            same = a == c
            below = [(a, x, c, y, err, kind), (x, b, y, d, err, kind), (a, x, y, d, err + 1, kind)]
            below = np.concatenate([np.stack(p, axis=1) for p in below] + [np.stack((x, b, c, y, err + 1, kind), axis=1)[~same]])
            n, m = below[:, 1] - below[:, 0], below[:, 3] - below[:, 2]
            below = below[(n > 0) & (m > 0) & ((below[:, 0] != below[:, 2]) | (n > 1))]
            ok = below[:, 4] <= self.allow[below[:, 5], depth + 1]
            self.pruned += int((~ok).sum())
            if ok.any():
                stack.append((depth + 1, below[ok]))
        return self

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """(i, root) of the rows that a link joins to an earlier row."""
        found = Forest(len(self.fp))
        for i, j in self.pairs:
            found.link(i, j)
        root = found.find(np.arange(len(self.fp)))
        moved = np.nonzero(root != np.arange(len(self.fp)))[0]
        return moved, root[moved]


def tries(radius: int) -> list[tuple[int, int, int]]:
    """(left turn, bits, errors allowed) of each trie's first block."""
    m = min(3, radius + 1)
    edge = [round(i * 64 / m) for i in range(m + 1)]
    return [(edge[i], edge[i + 1] - edge[i], (radius + 1) // m - 1 + (i < (radius + 1) % m)) for i in range(m)]


def allowed(radius: int) -> np.ndarray:
    """Errors allowed by trie and depth."""
    return np.array([[errors if depth <= bits else radius for depth in range(65)] for _, bits, errors in tries(radius)])


def first_cut(n: int, radius: int) -> int:
    """Depth of the first cut for `n` fingerprints, within the shortest first block."""
    return min(max(0, ceil(log2(max(1, n) / SUBTREE))), min(bits for _, bits, _ in tries(radius)) - 1)


def _turned(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def _top(turned: Column, depth: int) -> Column:
    return F.shiftrightunsigned(turned, 64 - depth) if depth else F.lit(0).cast("bigint")


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(min(bits, most) + 1) for c in itertools.combinations(range(bits), k)]


def _node_pair(own: Column, other: Column, **rest: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in rest.items()], F.least(own, other).alias("p"), F.greatest(own, other).alias("q"))


def _walk_cells(radius: int):
    """Rows sorted by (depth, trie, p, q) to the edges of each node pair's forest."""
    allow, turns = allowed(radius), [turn for turn, _, _ in tries(radius)]

    def edges(held: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        depth, trie, p, q, turned = held
        size = np.diff(start)
        cell = np.repeat(np.arange(len(size)), size)
        for level in np.unique(depth[start[:-1]]).tolist():
            rows = np.nonzero(depth == level)[0]
            fp = turned[rows].view(np.uint64)
            order = np.lexsort((fp, cell[rows]))
            rows, fp = rows[order], fp[order]
            begin = np.nonzero(np.diff(cell[rows], prepend=-1))[0]
            end = np.append(begin[1:], len(rows))
            own = p[rows[begin]] == q[rows[begin]]
            node = fp >> np.uint64(64 - level) if level else np.zeros_like(fp)
            first = np.append(0, np.cumsum(node == node[np.repeat(begin, end - begin)]))
            half = begin + first[end] - first[begin]  # rows of the cell's lesser node come first
            err = np.bitwise_count((p[rows[begin]] ^ q[rows[begin]]).view(np.uint64)).astype(np.int64)
            kind = trie[rows[begin]]
            roots = np.stack([begin, np.where(own, end, half), np.where(own, begin, half), end, err, kind], axis=1)
            roots = roots[(roots[:, 3] > roots[:, 2]) & (~own | (end - begin > 1))]
            if len(roots):
                i, j = Walk(fp[:, None], allow).run(roots, level).forest()
                for t, turn in enumerate(turns):
                    mine = trie[rows[i]] == t
                    a, b = fp[i[mine]], fp[j[mine]]
                    back = (np.uint64(64 - turn), np.uint64(turn))
                    yield tuple((x << back[0]) | (x >> back[1]) if turn else x for x in (a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, start in _cells(batches, 5, 4):
            for a, b in edges(held, start):
                if len(a):
                    yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def _cells(batches: Iterator[pa.RecordBatch], columns: int, keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole cells of sorted rows: (columns x rows, where each cell begins and the last ends)."""
    held = np.zeros((columns, 0), np.int64)
    for last, batch in itertools.chain(((False, b) for b in batches), [(True, None)]):
        if batch is not None:
            held = np.concatenate([held, np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(columns)])], axis=1)
        if not held.shape[1]:
            continue
        cut = np.nonzero((held[:keys, 1:] != held[:keys, :-1]).any(axis=0))[0] + 1
        start = np.array([0, *cut.tolist(), *([held.shape[1]] if last else [])])
        if len(start) > 1:
            yield np.ascontiguousarray(held[:, : start[-1]]), start
        held = held[:, start[-1] :]


def links(fps: DataFrame, n: int, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct `fps` (fp: bigint); `n`: how many they are."""
    depth, pairs = first_cut(n, radius), []
    for t, (turn, _, errors) in enumerate(tries(radius)):
        turned = _turned(F.col("fp"), turn)
        own = _top(turned, depth)
        pairs += [_node_pair(own, own.bitwiseXOR(F.lit(m)), trie=F.lit(t), turned=turned) for m in _masks(depth, errors)]
    rows = fps.select(F.explode(F.array(*pairs)).alias("x")).select("x.trie", "x.p", "x.q", "x.turned")
    done = None
    while True:
        rows = rows.withColumn("depth", F.lit(depth))
        big = kept(rows.groupBy("trie", "p", "q").count().where(F.col("count") > cap).drop("count"), "heavy")
        last = depth == 64 or big.isEmpty()
        light = rows if last else rows.join(big, ["trie", "p", "q"], "left_anti")
        light = light.select("depth", "trie", "p", "q", "turned")
        done = light if done is None else done.unionByName(light)
        if last:
            break
        deeper = min(DEEPER, 64 - depth)
        heavy = rows.join(big, ["trie", "p", "q"]).withColumn("err", F.bit_count(F.col("p").bitwiseXOR(F.col("q"))))
        errors = F.element_at(F.array(*[F.lit(int(x)) for x in allowed(radius)[:, depth + deeper]]), F.col("trie") + 1)
        masks = F.filter(F.array(*[F.lit(m) for m in _masks(deeper, radius)]), lambda m: F.bit_count(m) + F.col("err") <= errors)
        own = _top(F.col("turned"), depth + deeper)
        over = F.col("p").bitwiseXOR(F.col("q")).bitwiseXOR(_top(F.col("turned"), depth))
        inner = own.bitwiseAND(F.lit((1 << deeper) - 1))
        below = F.transform(masks, lambda m: _node_pair(own, F.shiftleft(over, deeper).bitwiseOR(inner.bitwiseXOR(m))))
        rows = kept(heavy.select("trie", "turned", F.explode(below).alias("x")).select("trie", "x.p", "x.q", "turned"), "deeper")
        depth += deeper
    group = ["depth", "trie", "p", "q"]
    dealt = done.repartition(partitions(fps.sparkSession), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(_walk_cells(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """(doc_id, fp, component_id) of each row of `docs`; component_id is the least doc_id reachable by links.

    Null and empty texts have fingerprint 0 and link like any other; rows that repeat a doc_id each get a row; a null
    doc_id links but never names a component (component_id is null if the component has no other); extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = kept(fingerprints(docs, shingle, seed), "fingerprints")
    fps = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    star = components(links(fps.select("fp"), fps.count(), radius, cap))
    rooted = fps.join(star, fps["fp"] == star["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Of wide fingerprints: 64-bit words, and bits up to which a pair is a candidate.
WORDS = 4
WIDE_RADIUS = 60
#: Tries of wide fingerprints, each below one key of two MinHash values: a pair of similarity 0.8 shares none with a probability of 0.36 ** 12.
BANDS = 12
_FACTOR, _SHIFT = np.random.default_rng(17).integers(0, 1 << 63, (2, 2 * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(shingle_hashes: np.ndarray) -> np.ndarray:
    """SimHash of `WORDS` words of a set of 64-bit shingle hashes; zeros for an empty set."""
    h = np.unique(shingle_hashes)
    out = np.zeros(WORDS, np.uint64)
    for w in range(WORDS if len(h) else 0):
        x = h + np.uint64((w * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(bits * 2 > len(h)).view(np.uint64)[0]
    return out


def _shingle_set(vocabulary, text: bytes | None) -> np.ndarray:
    """Sorted hashes of the five-word shingles of `text`; a shorter text is one shingle, whole."""
    from . import words as W

    w = np.array(vocabulary.hashes(text or b""), np.uint64)
    return np.unique(W.shingles(w, min(W.SHINGLE, len(w)))) if len(w) else w


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each of `BANDS` pairs of MinHash values of a shingle set; zeros for an empty set."""
    if not len(s):
        return np.zeros(BANDS, np.uint64)
    x = s * _FACTOR + _SHIFT
    x ^= x >> np.uint64(31)
    low = (x * np.uint64(0x94D049BB133111EB)).min(axis=1)
    return low[::2] * np.uint64(0x9E3779B97F4A7C15) + low[1::2]


def _node(s: np.ndarray) -> int:
    """The number, signed, by which a shingle set is known."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 5)).view(np.int64))


def _text_key():
    return F.xxhash64(F.col("text").cast("string"))


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, id, f0, ...: the words, m0, ...: the bands, signed) of each text: `key` is a hash of the text, `id` one of its shingle set."""
    from . import words as W

    names = [*(f"f{k}" for k in range(WORDS)), *(f"m{k}" for k in range(BANDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = W.Vocabulary()
        for batch in batches:
            out, node = np.zeros((batch.num_rows, WORDS + BANDS), np.uint64), np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(batch.column(2)):
                s = _shingle_set(vocabulary, t.as_py())
                out[i, :WORDS], out[i, WORDS:], node[i] = wide_fingerprint(s), band_keys(s), _node(s)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(node), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in out.T)], names=["doc_id", "key", "id", *names])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key().alias("key"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in ["doc_id", "key", "id", *names]))


def _walk_bands(radius: int):
    """Rows sorted by (band, top, c0, c1), then id and words, to the edges of each cell's forest."""
    allow = np.full((1, 64 * WORDS + 1), radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, start in _cells(batches, 5 + WORDS, 4):
            fp, cell = held[5:].view(np.uint64), np.repeat(np.arange(len(start) - 1), np.diff(start))
            order = np.lexsort((held[4], *fp[::-1], cell))  # ids too: a task that is repeated returns the same forest
            ends = np.stack([start[:-1], start[1:]] * 2 + [np.zeros(len(start) - 1, np.int64)] * 2, axis=1)
            i, j = Walk(np.ascontiguousarray(fp[:, order].T), allow).run(ends[np.diff(start) > 1]).forest()
            if len(i):
                ids = held[4][order]
                yield pa.record_batch([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    return run


def wide_links(fps: DataFrame, radius: int = WIDE_RADIUS, cap: int = CAP) -> DataFrame:
    """Edges (a, b) whose components are those of the pairs within `radius` bits that share a band, among `fps` (id, f0, ..., m0, ...)."""
    words = [f"f{k}" for k in range(WORDS)]
    keys = fps.select("id", *words, F.posexplode(F.array(*[f"m{k}" for k in range(BANDS)])).alias("band", "top"))
    big = keys.groupBy("band", "top").count().where(F.col("count") > cap).select("band", "top", F.ceil(F.col("count") / cap).cast("int").alias("parts"))
    big = kept(big, "heavy")
    if big.isEmpty():
        cells = keys.select("band", "top", F.lit(0).alias("c0"), F.lit(0).alias("c1"), "id", *words)
    else:
        cut = keys.join(big, ["band", "top"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        cut = cut.withColumn("c", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = cut.select("band", "top", F.least("c", "o").alias("c0"), F.greatest("c", "o").alias("c1"), "id", *words)
    group = ["band", "top", "c0", "c1"]
    dealt = cells.repartition(partitions(fps.sparkSession), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(_walk_bands(radius), "a bigint, b bigint")


#: Similarity of shingle sets from which texts are linked, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Most shingles of a part of a group that one task takes at once.
PART = 1 << 21


def similar_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) edges of a spanning forest of the links among `sets` (each sorted, without repeats) whose exact similarity is `SIMILAR` or more."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(number, kind="stable")]
    begin, at = np.cumsum(count) - count, np.concatenate([[0], np.cumsum(size)])
    left, edges = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        front = [first] if left[first] else []
        left[first] = False
        while front and left.any():
            i = front.pop()
            own = number[at[i] : at[i + 1]]
            n = count[own]
            place = np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(holders[place], minlength=len(sets))
            hit = np.nonzero(left & (both * SIMILAR[1] >= (size[i] + size - both) * SIMILAR[0]))[0]
            left[hit] = False
            front += hit.tolist()
            edges.append((np.full(len(hit), i), hit))
    return tuple(np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, c0, c1, id, shingles) sorted by the first four to the edges of each cell's exact forest."""

    def edges(rows: dict[int, bytes]) -> pa.RecordBatch:
        ids = np.array(list(rows), np.int64)
        i, j = similar_links([np.frombuffer(s, np.uint64) for s in rows.values()])
        return pa.record_batch([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    cell, rows = None, {}
    for batch in batches:
        *cells, ids, sets = (c.to_pylist() for c in batch.columns)
        for now, i, s in zip(zip(*cells), ids, sets):
            if now != cell:
                if len(rows) > 1:
                    yield edges(rows)
                cell, rows = now, {}
            rows[i] = s
    if len(rows) > 1:
        yield edges(rows)


def _shingled(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(root, id, n, shingles) of each of `members` (root, id, doc_id, key) from its text."""
    from . import words as W

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = W.Vocabulary()
        for batch in batches:
            sets = [_shingle_set(vocabulary, t.as_py()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["root", "id", "n", "shingles"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key().alias("key"), F.col("text").cast("string").cast("binary").alias("text"))
    found = texts.join(members.hint("merge"), ["doc_id", "key"])  # members grow with documents: the same plan at every size
    return found.select("root", "id", "text").mapInArrow(run, "root bigint, id bigint, n bigint, shingles binary")


def similar_groups(members: DataFrame, part: int = PART) -> DataFrame:
    """(node, root) of the components of all exact links within each group of `members` (root, id, n, shingles).

    A group of more than `part` shingles is cut in parts. Each part is taken with the group's root, so copies of it become
    one component at once; then what isn't in that component is compared with every part, so no link is left out.
    """
    spark = members.sparkSession
    group = ["root", "c0", "c1"]

    def links(cells: DataFrame) -> DataFrame:
        dealt = cells.select(*group, "id", "shingles").repartition(partitions(spark), *group)
        dealt = dealt.sortWithinPartitions(*group, "id")  # the forest follows this order, which a task that is repeated meets again
        return dealt.mapInArrow(_confirm, "a bigint, b bigint")

    many = members.groupBy("root").agg(F.ceil(F.sum("n") / part).cast("int").alias("parts")).where("parts > 1")
    many = kept(many, "parts")
    if many.isEmpty():
        return components(links(members.withColumns({"c0": F.lit(0), "c1": F.lit(0)})))
    cut = members.join(many, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("c0", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = cut.where("id != root").unionByName(cut.where("id = root").withColumn("c0", every))
    found = kept(links(cells.withColumn("c1", F.col("c0"))), "links")
    star = components(found)
    rest = members.join(many, "root").join(star.select(F.col("node").alias("id"), F.col("root").alias("own")), "id", "left").withColumn("own", F.coalesce("own", "id"))
    first = rest.where("id = root").select("root", F.col("own").alias("main"))
    rest = rest.join(first, "root").withColumn("out", F.col("own") != F.col("main"))
    outs = kept(rest.where("out").groupBy("root").agg(F.ceil(F.sum("n") / part).cast("int").alias("outs")), "outs")
    if outs.isEmpty():
        return star
    rest = rest.join(outs, "root").withColumn("c", F.pmod(F.xxhash64("id"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("parts"))).cast("int") + F.when(F.col("out"), F.col("parts")).otherwise(0))
    rest = rest.withColumn("o", F.explode(F.sequence(F.when(F.col("out"), 0).otherwise(F.col("parts")), F.col("parts") + F.col("outs") - 1)))
    more = links(rest.select("root", F.least("c", "o").alias("c0"), F.greatest("c", "o").alias("c1"), "id", "shingles"))
    return components(found.unionByName(more))


def _grouped(docs: DataFrame, radius: int, cap: int, part: int) -> DataFrame:
    """(doc_id, key, root) of each row of `docs` with a doc_id; rows of one root are alike."""
    bands = [f"m{k}" for k in range(BANDS)]
    words = [*(f"f{k}" for k in range(WORDS)), *bands]
    docs = docs.where("doc_id IS NOT NULL")
    rows = kept(wide_fingerprints(docs), "fingerprints")
    fps = kept(rows.groupBy("id", *words).agg(F.min(F.struct("doc_id", "key")).alias("row")), "distinct")
    star = components(wide_links(fps, radius, cap))
    named = kept(fps.withColumn("own", F.col("id")).join(star, F.col("id") == F.col("node"), "left").select("own", "row", F.coalesce("root", "id").alias("id")), "named")
    many = kept(named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("root")), "groups")  # a join of tables, which is split where it is skewed
    members = named.join(many, named["id"] == many["root"]).select("root", F.col("own").alias("id"), "row.*")
    star = similar_groups(kept(_shingled(members, docs), "shingles"), part)
    star = star.select(F.col("node").alias("id"), "root")
    return rows.select("doc_id", "key", "id").join(star, "id", "left").select("doc_id", "key", F.coalesce("root", "id").alias("root"))


def alike(docs: DataFrame, radius: int = WIDE_RADIUS, cap: int = CAP, part: int = PART) -> DataFrame:
    """(doc_id, component_id): groups of texts linked by five-word shingle sets of a similarity of 0.8 or more.

    Candidates are groups chained by pairs at most `radius` bits apart in a 256-bit SimHash. At similarity 0.8 about 39 bits
    differ, too many for a first cut by fingerprint bits that misses little, so a trie's top is a band of two MinHash values
    and the SimHash trie is walked below it. A pair of similarity 0.8 shares one of the 12 bands with a probability of
    1 - 5e-6, and is within the radius in about 1 - 1e-4 of cases (tests and the README have measured recall). Within each
    group the shingle sets themselves decide, and components are those of exact links alone. Texts without words are alike.
    Rows with a null doc_id are left out. Rows that repeat a doc_id are documents of their own if their texts differ. Whole
    texts are hashed, however long. Other columns are ignored. An empty table gives an empty result.
    """
    rows = kept(_grouped(docs, radius, cap, part), "grouped")
    named = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, "root").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """The rows of `docs` that name their group of similar texts: one document of each group stays, all columns kept.

    Rows with a null doc_id stay, as they can't be told apart. Of rows that repeat a doc_id and its text one stays; those
    with other texts are documents of their own.
    """
    each = _grouped(docs, radius, CAP, PART).groupBy("root", "doc_id", "key").agg(F.count("*").alias("n_rows"))
    keep = kept(each.groupBy("root").agg(F.min(F.struct("doc_id", "key", "n_rows")).alias("row")).select(F.col("row.doc_id").alias("kept_id"), F.col("row.key").alias("kept_key"), F.col("row.n_rows").alias("n_rows")), "kept")
    ids = keep.select("kept_id", "kept_key").hint("merge")  # as many as documents: the same plan at every size
    out = docs.join(ids, (docs["doc_id"] == keep["kept_id"]) & (F.xxhash64(docs["text"].cast("string")) == keep["kept_key"]), "left_semi")
    if not keep.where("n_rows > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.where("doc_id IS NULL"))


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def op6_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")
