"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item has a SimHash of its weighted word shingles (weight: how often it has a shingle). Windows of an item's
size over a text are hashed alike. A multi-index finds the items within `RADIUS` bits: the 64 bits are cut in 8 blocks, and
two fingerprints at most 23 bits apart differ in at most 2 bits of some block, so probing each block's values within 2
bits finds every one. Candidates are verified by exact weighted-shingle similarity.

A window that shares no shingle with an item has similarity 0, so windows are taken where the text has an item's shingle,
aligned with its places in the item. The benchmark is the query set: it is read in blocks of bounded size, each sent to
all executors, and texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ._shared import kept

RADIUS = 23
NEAR = 2
SIMILARITY = 0.8
#: Bytes of benchmark text that are sent to the executors at once.
BLOCK_BYTES = 16 << 20
_PROBES = np.array([x for x in range(256) if x.bit_count() <= NEAR], np.int64)


def simhash(h: np.ndarray) -> np.uint64:
    bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > len(h)).view(np.uint64)[0]


class Index:
    """Items by fingerprint blocks and by shingle."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int = W.SHINGLE):
        vocabulary = W.Vocabulary()
        rows = [(i, np.array(vocabulary.hashes(t), np.uint64)) for i, t in items]
        rows = [(i, w) for i, w in rows if len(w)]
        self.ids = [i for i, _ in rows]
        self.size = np.array([len(w) for _, w in rows], np.int64)
        self.span = np.minimum(self.size, shingle)
        hashes = [W.shingles(w, k) for (_, w), k in zip(rows, self.span.tolist())]
        self.bags = [W.bag(h) for h in hashes]
        self.prints = np.array([simhash(h) for h in hashes], np.uint64)
        self.blocks = [[np.nonzero(((self.prints >> np.uint64(8 * b)) & np.uint64(255)) == v)[0] for v in range(256)] for b in range(8)]
        self.lookup, self.places = {}, {}
        for k in sorted(set(self.span.tolist())):
            own = [j for j in range(len(rows)) if self.span[j] == k]
            all_h = np.concatenate([hashes[j] for j in own])
            item, place = np.repeat(own, [len(hashes[j]) for j in own]), np.concatenate([np.arange(len(hashes[j])) for j in own])
            order = np.argsort(all_h, kind="stable")
            self.lookup[k] = W.Lookup(all_h)
            self.places[k] = (item[order], place[order], np.searchsorted(all_h[order], self.lookup[k].values), np.searchsorted(all_h[order], self.lookup[k].values, side="right"))

    def near(self, print_: np.uint64) -> np.ndarray:
        """Items within RADIUS bits of a fingerprint, all of them."""
        found = []
        for b in range(8):
            v = int(print_ >> np.uint64(8 * b)) & 255
            found += [self.blocks[b][v ^ int(x)] for x in _PROBES]
        found = np.unique(np.concatenate(found))
        return found[np.bitwise_count(self.prints[found] ^ print_) <= RADIUS]

    def matches(self, texts: list[bytes | None], vocabulary: W.Vocabulary, similarity: float = SIMILARITY) -> list[tuple[int, int, float, int, int]]:
        """(number of the text, item, similarity, first word, words) of the best window for each text and item."""
        best: dict[tuple[int, int], tuple] = {}
        for first, w, starts in W.blocks(texts, vocabulary):
            for k, lookup in self.lookup.items():
                h = W.shingles(w, k)
                at, value = lookup.find(h)
                if not len(at):
                    continue
                text = np.searchsorted(starts, at, side="right") - 1
                whole = at + k <= starts[text + 1]
                at, value, text = at[whole], value[whole], text[whole]
                item, place, low, high = self.places[k]
                n = high[value] - low[value]
                source = np.repeat(np.arange(len(at)), n)
                entry = low[value][source] + np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
                size = self.size[item[entry]]
                begin = np.clip(at[source] - place[entry], starts[text[source]], None)
                begin = np.maximum(np.minimum(begin, starts[text[source] + 1] - size), starts[text[source]])
                for t, s, m in np.unique(np.stack([text[source], begin, size], axis=1), axis=0).tolist():
                    end = min(s + m, int(starts[t + 1]))
                    window = h[s : end - k + 1]
                    own = W.bag(window)
                    for j in self.near(simhash(window)).tolist():
                        if self.size[j] != m or self.span[j] != k:
                            continue
                        score = W.shared(own, self.bags[j]) / max(len(window), int(self.bags[j][1].sum()))
                        if score >= similarity and (old := best.get((first + t, j), (0,)))[0] < score:
                            best[first + t, j] = (score, s - int(starts[t]), end - s) if score > old[0] else old
        return [(t, self.ids[j], *v) for (t, j), v in sorted(best.items())]


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, bytes]]]:
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("i"), F.col("text").cast("string").cast("binary").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = ceil(total / most)
    for k in range(n):
        yield sorted(((r["i"], bytes(r["t"])) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()), key=lambda r: (r[0] is None, r))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each text for each item at `similarity` or more.

    Null, empty and blank texts and items match nothing. Items of fewer than five words are one shingle, whole. Rows that
    repeat a doc_id or an item_id are matched each; a null doc_id or item_id is returned as such. Other columns are
    ignored; an empty table on either side gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
    ddl = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    out = None
    for items in _blocks(benchmark, most):
        sent = docs.sparkSession.sparkContext.broadcast(items)  # at most about `most` bytes

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, vocabulary = Index(sent.value), W.Vocabulary()
            for b in batches:
                ids = b.column(0).to_pylist()
                found = [(ids[t], *rest) for t, *rest in index.matches([x.as_py() for x in b.column(1)], vocabulary, similarity)]
                if found:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*found), kinds)], names=names)

        one = rows.mapInArrow(run, ddl)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], ddl)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item; same columns. Rows with a null doc_id go if any such row holds one."""
    found = kept(contaminated(docs, benchmark).select(F.col("doc_id").alias("hit_id")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found["hit_id"]), "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
