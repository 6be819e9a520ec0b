"""Problem 1: near-duplicate records with small edits, by an LSH forest.

Every distinct body gets ``TREES`` signatures, each a path in a prefix tree: the min-hashes of its levels, shortened to
``LEVEL_BITS`` and packed into one 64-bit key, so that the order of the keys is the sorted order of signatures and the
longest common prefix of two keys is read off their leading bits. In each tree rows are sorted by key, and neighbours in
that order are candidates as far as they share a prefix of the region's depth. The depth adapts in every region: where at
most ``SPARSE`` rows share two levels, these are enough (a pair at similarity 0.7 then shares one of the 12 prefixes with
probability 0.9997); a denser region goes down to three levels (0.993; at 0.75 it is 0.998). No pair that shares a
region's prefix is left out, however large the region is, and neighbours with the longest prefix are met first.

Candidates are kept if a 128-bit sketch of one-bit min-hashes allows the wanted similarity, then the exact similarity of
the word-shingle sets decides. Exact copies are one body (class) until the end, so a hot group of copies costs one signature.

Scale: one pass over the texts; then only fixed-size rows are shuffled (8-byte keys and sketches). Copies are grouped
with map-side aggregation. A pair of bodies is verified once; texts are fetched only for bodies that are in some pair.
``REGION`` is about memory only: a region of more rows is parted by its third level before its rows meet in a task, and one
that is still larger is dealt into blocks, of which every pair is a region of its own. Comparisons of sketches grow with
the square of such a region: that is the price of whole results there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import shingles as S
from folioflow.plans.lineage import cut, small

U = np.uint64
N_WORDS = 3
MIN_WORDS = 20
THRESHOLD = 0.7
TREES, SKETCH = 12, 128
#: Bits of each level's min-hash in a key: five levels, the first two are half of it.
LEVEL_BITS = (16, 16, 12, 10, 10)
#: Bits of a key below its first two and its first three levels.
TWO, THREE = sum(LEVEL_BITS[2:]), sum(LEVEL_BITS[3:])
#: Rows that may share two levels without going down to the third.
SPARSE = 64
#: A region of more rows is parted before they meet in a task.
REGION = 16_384
#: Pairs held before they are passed on: a family of alike bodies has nearly all pairs of its region.
PAIRS = 1_000_000
#: Most bits of 128 that may differ: four standard deviations above the mean at similarity 0.7 (19.2 and 4.04).
SKETCH_BITS = 36

_SEEDS = S.mix(np.arange(1, 2 * SKETCH + 1, dtype=U))
_XOR, _MULTIPLY = _SEEDS[:SKETCH], _SEEDS[SKETCH:] | U(1)


def body(text: Column) -> Column:
    """The text without its first line where that line is a header ``[.. | .. | ..]``; null stays null."""
    return F.regexp_replace(text, r"^\[[^\n]* \| [^\n]* \| [^\n]*\][ \t\r]*(?:\n|$)", "")


def _features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        texts = batch.column(2).to_pylist()
        for first, lowered in S.batches(texts):
            word, at = S.words(lowered)
            enough = np.flatnonzero(np.diff(at) >= MIN_WORDS)
            if not len(enough):
                continue
            cls = S.sequence_hash(word, at)[enough]
            shingle, begin = S.shingles(word, at, N_WORDS)
            if len(enough) < len(lowered):
                keep = np.repeat(np.diff(at) >= MIN_WORDS, np.diff(begin))
                counts = np.diff(begin)[enough]
                shingle, begin = shingle[keep], np.concatenate(([0], np.cumsum(counts)))
            mins = np.empty((SKETCH, len(enough)), dtype=U)
            for k in range(SKETCH):
                mins[k] = np.minimum.reduceat((shingle ^ _XOR[k]) * _MULTIPLY[k], begin[:-1])
            keys = np.empty((len(enough), TREES), dtype=U)
            for t in range(TREES):
                key = np.zeros(len(enough), dtype=U)
                for k, width in enumerate(LEVEL_BITS, len(LEVEL_BITS) * t):
                    key = key << U(width) | S.mix(mins[k] + U(t)) >> U(64 - width)
                keys[:, t] = key
            bits = (S.mix(mins) >> U(13)) & U(1)
            sketch = [(bits[64 * h : 64 * h + 64] << np.arange(64, dtype=U)[:, None]).sum(axis=0, dtype=U) for h in (0, 1)]
            pick = pa.array(enough + first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pick),
                    batch.column(1).take(pick),
                    pa.array(cls.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, TREES, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))),
                    *(pa.array(x.view(np.int64)) for x in sketch),
                ],
                names=["chunk_id", "doc_id", "cls", "keys", "s1", "s2"],
            )


def features(chunks: DataFrame) -> DataFrame:
    """chunk_id, doc_id, cls (hash of the body's words), tree keys and sketch of each chunk of at least 20 words.

    Null and short texts have no row. A chunk delivered again gives an equal row.
    """
    rows = chunks.where("text is not null and chunk_id is not null").select("chunk_id", "doc_id", body(F.col("text")).alias("body"))
    return rows.mapInArrow(_features, "chunk_id string, doc_id string, cls long, keys array<long>, s1 long, s2 long")


def _close(s1: np.ndarray, s2: np.ndarray, cls: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows ``at`` and ``at + step`` the classes whose sketches are close, smaller class first."""
    apart = np.bitwise_count(s1[at] ^ s1[at + step]) + np.bitwise_count(s2[at] ^ s2[at + step])
    close = at[apart <= SKETCH_BITS]
    a, b = cls[close], cls[close + step]
    return np.minimum(a, b), np.maximum(a, b)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in some column."""
    change = np.ones(len(columns[0]), dtype=bool)
    change[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return change


def _prefixes(region: np.ndarray, key: np.ndarray, few: int) -> np.ndarray:
    """A number for each row's prefix, of keys in order: two levels where the region is sparse, else three."""
    edges = np.append(np.flatnonzero(_starts(region, key >> TWO)), len(key))
    rows = np.diff(edges)
    sparse = np.repeat(rows, rows) <= few
    return np.cumsum(_starts(region, np.where(sparse, key >> TWO << TWO, key >> THREE << THREE), sparse))


def _near(prefix: np.ndarray, s1: np.ndarray, s2: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes of equal prefix whose sketches are close, of rows in order: next neighbours first, given out as found."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    at, step = np.arange(len(prefix)), 1
    while len(at):
        at = at[at + step < len(prefix)]
        at = at[prefix[at] == prefix[at + step]]
        found.append(_close(s1, s2, cls, at, step))
        held += len(found[-1][0])
        step += 1
        if held >= PAIRS:
            yield np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            found, held = [], 0
    if held:
        yield np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in found:
        real = a != b  # a body may meet itself where blocks are paired
        if real.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[real]), pa.array(b[real])], names=["cls_a", "cls_b"])


def _candidates(sparse: int):
    """Reads rows in the order of regions and keys; the last region of a batch waits for the next batch, so that at most one is held.

    A region has a number of its own where rows have one, else it is the first two levels of the key.
    """

    def done(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        region, key, s1, s2, cls = (np.concatenate(x) for x in zip(*parts))
        yield from _pairs(_near(_prefixes(region, key, sparse), s1.view(U), s2.view(U), cls))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []
        for batch in rows:
            key, s1, s2, cls = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "s1", "s2", "cls"))
            region = batch.column("region").to_numpy(zero_copy_only=False) if "region" in batch.schema.names else key >> TWO
            if not len(key):
                continue
            columns = [region, key, s1, s2, cls]
            if rest and region[-1] == rest[0][0][0]:
                rest.append(columns)
                continue
            end = int(np.argmax(region == region[-1]))
            if end or rest:
                yield from done([*rest, [x[:end] for x in columns]])
            rest = [[x[end:] for x in columns]]
        if rest:
            yield from done(rest)

    return run


def _large(rows: DataFrame, bits: int) -> DataFrame:
    """The regions (keys without their last ``bits``) of more than REGION rows, with their sizes (map-side aggregated)."""
    region = F.shiftright("key", bits).alias("region")
    return cut(rows.groupBy(region).agg(F.count("*").alias("size")).where(F.col("size") > REGION))


def _divided(rows: DataFrame) -> DataFrame:
    """region, key, s1, s2, cls of rows (key, s1, s2, cls) of regions too large for a task, each parted by the third level.

    The rows of one that is still too large become blocks of about REGION / 2, and every pair of blocks is a region, so
    that no pair of rows is missed and no task holds more.
    """
    large = _large(rows, THREE).withColumn("blocks", F.ceil(F.col("size") * 2 / REGION))
    marked = rows.withColumn("region", F.shiftright("key", THREE)).join(small(large), "region", "left")
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = marked.withColumn("mine", mine).withColumn("other", other)
    pair = F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other"))
    return met.select(F.when(F.col("blocks").isNull(), F.col("region")).otherwise(pair).alias("region"), "key", "s1", "s2", "cls")


def candidates(known: DataFrame) -> DataFrame:
    """Distinct pairs (cls_a < cls_b) of bodies of ``known`` (cls, keys, s1, s2) that are neighbours in some tree and close by sketch."""
    bodies = known.groupBy("cls").agg(*(F.first(x).alias(x) for x in ("keys", "s1", "s2")))
    schema = "cls_a long, cls_b long"
    hot = _large(known.select(F.explode("keys").alias("key")), TWO).select("region")  # copies included: no smaller than of bodies
    divided = not hot.isEmpty()
    bodies = cut(bodies) if divided else bodies
    trees = bodies.select("cls", "s1", "s2", F.explode("keys").alias("key"))
    region = F.shiftright("key", TWO)
    cold = trees.join(small(hot), region == hot["region"], "left_anti") if divided else trees
    found = cold.repartition(region).sortWithinPartitions("key").select("key", "s1", "s2", "cls").mapInArrow(_candidates(SPARSE), schema)
    if divided:
        parts = _divided(cut(trees.join(small(hot), region == hot["region"], "left_semi")))
        found = found.unionByName(parts.repartition("region").sortWithinPartitions("region", "key").mapInArrow(_candidates(SPARSE), schema))
    return found.distinct()


def _jaccard(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact similarity of each pair; a body's shingles are made once for a batch, however many pairs it is in."""
    for batch in rows:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = dict(zip(a, batch.column(2).to_pylist())) | dict(zip(b, batch.column(3).to_pylist()))
        names, sets = list(texts), {}
        for first, lowered in S.batches(list(texts.values())):
            shingle, begin = S.shingles(*S.words(lowered), N_WORDS)
            sets.update((names[first + k], np.unique(shingle[begin[k] : begin[k + 1]])) for k in range(len(lowered)))
        value = np.empty(len(a))
        for k, (left, right) in enumerate(zip(map(sets.get, a), map(sets.get, b))):
            common = len(np.intersect1d(left, right, assume_unique=True))
            value[k] = common / max(1, len(left) + len(right) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], names=["cls_a", "cls_b", "jaccard"])


def near_duplicates(chunks: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the chunks of at least 20 words.

    members: chunk_id, doc_id, cls, once for each chunk_id and body. links: cls_a < cls_b, jaccard, for different bodies
    of exact similarity >= ``threshold``. Nulls, empty and short texts take no part; repeated rows count once; an empty
    table gives empty results; other columns are ignored.
    """
    known = cut(features(chunks))
    members = known.select("chunk_id", "doc_id", "cls").distinct()
    pairs = cut(candidates(known))
    ends = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    wanted = cut(known.join(small(ends), "cls", "left_semi").groupBy("cls").agg(F.min("chunk_id").alias("chunk_id")))
    texts = (
        chunks.where("text is not null").select("chunk_id", body(F.col("text")).alias("body"))
        .join(small(wanted), "chunk_id").groupBy("cls").agg(F.min("body").alias("body"))
    )
    texts = cut(texts)
    both = (
        pairs.join(texts.select(F.col("cls").alias("cls_a"), F.col("body").alias("body_a")), "cls_a")
        .join(texts.select(F.col("cls").alias("cls_b"), F.col("body").alias("body_b")), "cls_b")
        .select("cls_a", "cls_b", "body_a", "body_b")
    )
    links = both.mapInArrow(_jaccard, "cls_a long, cls_b long, jaccard double").where(F.col("jaccard") >= threshold)
    return members, links


def found(chunks: DataFrame) -> DataFrame:
    """p1_found: every pair of chunks of different documents whose bodies are alike, smaller chunk_id first."""
    members, links = near_duplicates(chunks)
    copies = members.groupBy("cls").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    classes = links.select("cls_a", "cls_b").unionByName(copies.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")))
    a = members.select(F.col("cls").alias("cls_a"), F.col("chunk_id").alias("a"), F.col("doc_id").alias("doc_a"))
    b = members.select(F.col("cls").alias("cls_b"), F.col("chunk_id").alias("b"), F.col("doc_id").alias("doc_b"))
    pairs = classes.join(a, "cls_a").join(b, "cls_b").where("doc_a <> doc_b and (cls_a <> cls_b or a < b)")
    return pairs.select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b"))


def classes(chunks: DataFrame) -> DataFrame:
    """p1_classes: one row per chunk: its class of equal bodies, and the number of its links to other chunks.

    n_links counts the other members of its class and all members of classes linked to it, without listing pairs.
    """
    members, links = near_duplicates(chunks)
    size = members.groupBy("cls").agg(F.count("*").alias("size"), F.min("chunk_id").alias("class_id"))
    both = links.select("cls_a", "cls_b").unionByName(links.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b")))
    linked = (
        both.join(size.select(F.col("cls").alias("cls_b"), F.col("size").alias("other")), "cls_b")
        .groupBy(F.col("cls_a").alias("cls")).agg(F.sum("other").alias("linked"))
    )
    of = size.join(linked, "cls", "left").select("cls", "class_id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return members.join(of, "cls").select("chunk_id", "class_id", "n_links")
