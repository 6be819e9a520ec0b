"""Problem 7: evaluation texts leaking into training text, by SimHash of item-sized windows.

Each item's question and passage become windows: all of 12 consecutive words (a part of 8 to 11 words is one window of its
whole length), which decide word-for-word leaks, and windows of the greatest size of ``LADDER`` that the part has, a quarter
apart, which find edited ones: with five-word shingles and a similarity of 0.8, a window bears one edit inside from 50
words on and two from 100 on; shorter ones only edits near their ends. Every window of those sizes in every document gets
a 64-bit SimHash of its words. A multi-index of radius + 1 blocks of bits finds all fingerprints within the radius (by the
pigeonhole principle one block is equal); ``RADII`` fit the sizes: of windows edited within the similarity, 0.9 of those of
24 words and 0.98 of the longer ones are within 7 bits. Candidates are verified by the exact similarity of weighted
five-word shingles; rarer shingles weigh more, by their number of item parts over all items. A leak in the sense of the
test data is a verified window whose words are equal one by one.

Scale: the corpus is read once in a narrow pass without a shuffle, however skewed its sources are; only verified windows
leave a task. The index holds item windows of at most about 12 * WINDOWS words (its proven size bound); a larger set of
items is taken in blocks of items, each against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import shingles as S
from folioflow.plans.lineage import cut

U = np.uint64
SIZE, SHORTEST = 12, 8
SHINGLE = 5
THRESHOLD = 0.8
LADDER = (24, 50, 100)
#: Bits that may differ, for windows of up to SIZE words and for those of the ladder.
RADII = (3, 7)
WINDOWS = 250_000
SLICE = 1 << 16


def fingerprints(word: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size, the SimHash of the window that starts at each word (as far as a whole window fits)."""
    out = {s: np.empty(max(0, len(word) - s + 1), dtype=U) for s in sizes}
    for a in range(0, len(word), SLICE):
        part = word[a : a + SLICE + max(sizes) - 1]
        total = np.zeros((len(part) + 1, 64), dtype=np.uint8)
        np.cumsum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint8, out=total[1:])  # modulo 256: sizes are below
        for s in sizes:
            if len(part) >= s:
                hashed = np.packbits(total[s:] - total[:-s] > s // 2, axis=1).view(U).ravel()[: min(SLICE, len(out[s]) - a)]
                out[s][a : a + len(hashed)] = hashed
    return out


def window_sizes(n: int) -> list[tuple[int, int]]:
    """(size, step) of the windows of a part of n words."""
    if n < SHORTEST:
        return []
    return [(min(SIZE, n), 1), *[(s, s // 4) for s in LADDER if s <= n][-1:]]


def _windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, part, size and the word hashes of each window of each part."""
    for batch in rows:
        items, parts, texts = (batch.column(k).to_pylist() for k in range(3))
        out = []
        for item, part, text in zip(items, parts, texts):
            word, _ = S.words([text.lower().encode("utf-8", "replace")])
            for size, step in window_sizes(len(word)):
                starts = sorted({*range(0, len(word) - size + 1, step), len(word) - size})
                out += [(item, part, size, word[k : k + size].tobytes()) for k in starts]
        if out:
            types = (pa.int64(), pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["item_id", "part", "size", "words"])


def _shingled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each part."""
    for batch in rows:
        for text in batch.column(0).to_pylist():
            shingle, _ = S.shingles(*S.words([text.lower().encode("utf-8", "replace")]), SHINGLE)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle).view(np.int64))], names=["shingle"])


class Index:
    """Windows of one size: fingerprints in radius + 1 tables by a block of bits, words, shingles and their weights.

    ``known`` and ``df`` are shingles in order with their numbers of parts, out of ``parts``.
    """

    def __init__(self, size: int, rows: list, known: np.ndarray, df: np.ndarray, parts: int) -> None:
        self.radius = RADII[size > SIZE]
        self.bits = 64 // (self.radius + 1)
        self.item = np.array([r["item_id"] for r in rows], dtype=np.int64)
        self.part = np.array([r["part"] for r in rows], dtype=object)
        self.words = np.frombuffer(b"".join(r["words"] for r in rows), dtype=U).reshape(-1, size)
        flat = self.words.ravel()
        self.print = fingerprints(flat, [size])[size][::size]
        shingle, _ = S.shingles(flat, np.arange(0, len(flat) + 1, size), SHINGLE)
        self.shingles = shingle.reshape(len(rows), -1)
        self.weight = np.log1p(parts / df[np.searchsorted(known, self.shingles)])
        self.unseen = math.log1p(parts)
        self.tables = []
        for k in range(self.radius + 1):
            key = self._block(self.print, k)
            order = np.argsort(key, kind="stable")
            counts = np.bincount(key, minlength=1 << self.bits)
            self.tables.append((order, np.concatenate(([0], np.cumsum(counts)))))

    def _block(self, print_: np.ndarray, k: int) -> np.ndarray:
        return ((print_ >> U(self.bits * k)) & U((1 << self.bits) - 1)).astype(np.int64)

    def within(self, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (document window, item window) whose fingerprints differ in at most the radius, each once."""
        found: list[np.ndarray] = []
        width = max(256, (1 << 20) // (1 + (len(self.item) >> self.bits)))
        for begin in range(0, len(print_), width):
            some = print_[begin : begin + width]
            for k, (order, start) in enumerate(self.tables):
                key = self._block(some, k)
                first = start[key]
                n = start[key + 1] - first
                left = np.repeat(np.arange(len(some)), n)
                right = order[np.arange(len(left)) - np.repeat(np.cumsum(n) - n - first, n)]
                near = np.flatnonzero(np.bitwise_count(some[left] ^ self.print[right]) <= self.radius)
                found.append((begin + left[near]) * len(self.item) + right[near])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // len(self.item), both % len(self.item)

    def similarity(self, shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The weighted Jaccard similarity of rows of shingles and the index's windows ``at``."""
        mine, weight = self.shingles[at], self.weight[at]
        equal = shingles[:, :, None] == mine[:, None, :]
        common = (weight * equal.any(axis=1)).sum(axis=1)
        return common / (weight.sum(axis=1) + self.unseen * (~equal.any(axis=2)).sum(axis=1))


def _search(held):
    names = ["doc_id", "item_id", "part", "similarity", "exact", "n_windows"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[int, Index] = held.value
        for batch in rows:
            documents = batch.column(0).to_numpy(zero_copy_only=False)
            for start, lowered in S.batches(batch.column(1).to_pylist()):
                word, first = S.words(lowered)
                owner = np.repeat(np.arange(len(lowered)), np.diff(first))
                best: dict[tuple[int, int, str], list] = {}
                for size, print_ in fingerprints(word, list(indexes)).items():
                    if not len(print_):
                        continue
                    index = indexes[size]
                    at = np.flatnonzero(owner[: len(print_)] == owner[size - 1 :])
                    left, right = index.within(print_[at])
                    left = at[left]
                    width = (1 << 22) // size**2
                    for s in range(0, len(left), width):
                        i, j = left[s : s + width], right[s : s + width]
                        mine = word[i[:, None] + np.arange(size)]
                        own, _ = S.shingles(mine.ravel(), np.arange(0, mine.size + 1, size), SHINGLE)
                        value = index.similarity(own.reshape(len(i), -1), j)
                        exact = (mine == index.words[j]).all(axis=1)
                        for k in np.flatnonzero(value >= THRESHOLD):
                            key = (int(owner[i[k]]), int(index.item[j[k]]), index.part[j[k]])
                            row = best.setdefault(key, [0.0, False, set()])
                            row[0], row[1] = max(row[0], float(value[k])), row[1] or bool(exact[k])
                            row[2].add((size, int(i[k])))
                if best:
                    out = [(int(documents[start + d]), item, part, value, exact, len(seen)) for (d, item, part), (value, exact, seen) in best.items()]
                    types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    return run


def _of(size: int, rows: list) -> np.ndarray:
    """All shingles of windows of one size."""
    flat = np.frombuffer(b"".join(r["words"] for r in rows), dtype=U)
    return S.shingles(flat, np.arange(0, len(flat) + 1, size), SHINGLE)[0]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, part, similarity (of the best window), exact, n_windows: verified windows of items in documents.

    A row of documents counts for itself; null and empty texts and null parts have no windows; parts under 8 words are
    never cases; repeated rows of an item count once. Empty tables give an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    every = items.select("item_id", F.explode(F.create_map(F.lit("question"), F.col("question"), F.lit("passage"), F.col("passage"))).alias("part", "text"))
    every = every.where("text is not null and item_id is not null").distinct()
    windows = cut(every.mapInArrow(_windows, "item_id long, part string, size int, words binary"))
    known = cut(every.select("text").mapInArrow(_shingled, "shingle long").groupBy("shingle").agg(F.count("*").alias("df")))
    parts = every.count()
    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    schema = "doc_id long, item_id long, part string, similarity double, exact boolean, n_windows int"
    total = windows.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, math.ceil(total / (SIZE * WINDOWS)))
    found = []
    for block in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).collect()  # a bounded number of words
        by_size: dict[int, list] = {}
        for row in sorted(rows, key=lambda r: (r["item_id"], r["part"], r["words"])):
            by_size.setdefault(row["size"], []).append(row)
        if by_size:
            some = np.unique(np.concatenate([_of(size, rows) for size, rows in by_size.items()]))
            weights = known.join(F.broadcast(spark.createDataFrame(pa.table({"shingle": pa.array(some.view(np.int64))}))), "shingle").toArrow()
            shingle, df = weights.column("shingle").to_numpy().view(U), weights.column("df").to_numpy()
            order = np.argsort(shingle)
            held = spark.sparkContext.broadcast({size: Index(size, rows, shingle[order], df[order], parts) for size, rows in by_size.items()})
            found.append(texts.mapInArrow(_search(held), schema))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "item_id", "part").agg(F.max("similarity").alias("similarity"), F.max("exact").alias("exact"), F.sum("n_windows").cast("int").alias("n_windows"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p7_found: doc_id, item_id where the text holds 12 consecutive words of the item, or the whole of a part of 8 to 11."""
    return leaks(documents, items).where("exact").select("doc_id", "item_id").distinct()
