"""Vector search: an embedder hook, cosine of query vectors against all rows, and a stand-in embedder of hashed tokens."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.config import DEFAULT, Config
from folioflow.functions.text import strip, tokens
from folioflow.operators.best import Best
from folioflow.operators.lexical import ranked

#: Takes texts, returns one vector for each as rows of a matrix.
Embedder = Callable[[list[str]], np.ndarray]

#: Query vectors in one product with a batch of rows.
QUERIES = 1000
#: Pairs of a query and a row that are scored at once in double precision.
PAIRS = 8192
#: Bytes of query vectors that travel to the rows at once.
HELD = 64 << 20
BUCKETS = 64


def embed(texts: DataFrame, key: str, text: str, embedder: Embedder, normalize: bool = True) -> DataFrame:
    """key, embedding: the vectors of texts by an injected function, called once for each Arrow batch where Spark placed it.

    Blank and null texts have no vector; others are trimmed. A zero vector stays zero. A failing embedder fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            matrix = np.asarray(embedder(batch.column(1).to_pylist()), dtype=np.float64)
            if normalize:
                matrix = matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1)), 1e-300)[:, None]
            starts = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, pa.array(matrix.ravel()))], names=[key, "embedding"])

    some = texts.select(key, strip(F.col(text)).alias("text")).where("text <> ''")
    return some.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<double>")


@lru_cache(maxsize=1 << 18)
def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode("utf-8", "replace")).hexdigest()[:4], 16) % BUCKETS


def hashed_tokens(texts: list[str]) -> np.ndarray:
    """A stand-in for an embedding model: the blank-separated tokens of a text counted in md5 buckets."""
    split = [text.split(" ") for text in texts]
    lengths = [len(x) for x in split]
    bucket = np.fromiter(map(_bucket, itertools.chain.from_iterable(split)), np.int64, sum(lengths))
    row = np.repeat(np.arange(len(texts)), lengths)
    return np.bincount(row * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS).astype(np.float64)


def hashed_vectors(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, embedding: unit vectors of texts by :func:`hashed_tokens`. A key counts once (its smallest text)."""
    once = texts.where(strip(F.col(text)) != "").groupBy(key).agg(F.min(text).alias(text))
    return hashed_of_tokens(once.select(key, tokens(F.col(text)).alias("tokens")), key)


def hashed_of_tokens(listed: DataFrame, key: str) -> DataFrame:
    """The same of texts that are already tokens (key, tokens); no tokens, no vector."""
    return embed(listed.select(key, F.array_join("tokens", " ").alias("text")), key, "text", hashed_tokens)


def _scores(block: np.ndarray, norms: np.ndarray, matrix: np.ndarray, sizes: np.ndarray, normalized: bool) -> np.ndarray:
    """Scores of pairs of rows in double precision, as they are given out."""
    score = np.einsum("ij,ij->i", block, matrix)
    return np.round(score if normalized else score / np.maximum(norms * sizes, 1e-10), 6)


def _scaled(rows: np.ndarray, norms: np.ndarray, normalized: bool) -> np.ndarray:
    return (rows if normalized else rows / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)


def _search(held, top_k: int, normalized: bool):
    """The best rows of every query among a task's rows: single precision finds what may be among them, double decides."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = held.value
        length = matrix.shape[1]
        parts = []
        for first in range(0, len(names), QUERIES):
            some = matrix[first : first + QUERIES].astype(np.float64)
            sizes = np.sqrt((some * some).sum(axis=1))
            parts.append((Best(len(some), top_k), names[first : first + QUERIES], first, sizes, _scaled(some, sizes, normalized)))
        for batch in rows:
            lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            usable = np.flatnonzero(lengths == length)
            if not len(usable):
                continue
            ids, at = np.unique(np.array(batch.column(0).take(pa.array(usable)).to_pylist(), dtype=object), return_index=True)
            values = batch.column(1).take(pa.array(usable[at])).flatten()
            block = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
            norms = np.sqrt((block * block).sum(axis=1))
            scaled = _scaled(block, norms, normalized)
            least, most = norms[norms > 0].min(initial=np.inf), norms.max()
            for best, _, first, sizes, asked in parts:
                low, high = sizes[sizes > 0].min(initial=np.inf), sizes.max()
                if 1e-4 < least and most < 1e6 and 1e-4 < low and high < 1e6:
                    slack = 1e-6 + (2 * length + 16) * 2.0**-24 * (sizes * most if normalized else 1.0)
                    score = asked @ scaled.T
                else:  # tiny, huge or non-finite: not by single precision
                    wide = matrix[first : first + QUERIES].astype(np.float64)
                    slack, score = 1e-6, wide @ block.T
                    if normalized:
                        slack = slack + np.nan_to_num(1e-13 * sizes * most, nan=1e300, posinf=1e300)
                    else:
                        score /= np.maximum(sizes[:, None] * norms, 1e-10)
                    score = np.where(np.isnan(score), np.inf, score)
                q, row = best.candidates(score, slack)
                exact = [
                    _scores(block[r], norms[r], matrix[first + x].astype(np.float64), sizes[x], normalized)
                    for x, r in ((q[s : s + PAIRS], row[s : s + PAIRS]) for s in range(0, len(q), PAIRS))
                ]
                if exact:
                    best.take(q, row, np.concatenate(exact), ids)
        for best, own, *_ in parts:
            yield best.found(own, "query_id")

    return run


def dense_topk(vectors: DataFrame, queries: DataFrame, top_k: int | None = None, normalized: bool = False, config: Config = DEFAULT) -> DataFrame:
    """query_id, chunk_id, score, rank: the rows of greatest cosine for every query vector.

    ``queries`` (query_id LONG, query) is a stated set that travels to the rows, which are not moved; one of more than
    ``HELD`` bytes goes in parts, each with a scan of its own. With ``normalized`` the vectors are trusted to be of unit
    length. Scores are rounded to 6 decimals, ties go to the smaller id; a zero vector scores 0; null and empty vectors,
    null ids, and vectors of another length than the query's take no part. Repeated rows of a chunk_id (of the same vector)
    count once.
    """
    top_k = config.dense_top_k if top_k is None else top_k
    spark, schema = vectors.sparkSession, "query_id long, chunk_id string, score double"
    asked = queries.where(F.col("query_id").isNotNull() & (F.size("query") > 0)).select("query_id", "query")
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("chunk_id").isNotNull()).select("chunk_id", "embedding")
    lengths = asked.groupBy(F.size("query").alias("n")).agg(F.count("*").alias("rows")).collect() if top_k > 0 else []  # one row a length
    found, width = [], 4 if dict(queries.dtypes)["query"] == "array<float>" else 8
    for length, n in sorted((r["n"], r["rows"]) for r in lengths):
        parts = math.ceil(n * length * width / HELD)
        for part in range(parts):
            mine = asked.where((F.size("query") == length) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).toArrow()
            matrix = mine.column("query").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            held = spark.sparkContext.broadcast((mine.column("query_id").to_numpy(), matrix))
            found.append(rows.mapInArrow(_search(held, top_k, normalized), schema))
    if not found:
        return spark.createDataFrame([], schema + ", rank int")
    once = reduce(DataFrame.unionByName, found).repartition("query_id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return ranked(once, top_k)


def hashed_topk(index: DataFrame, questions: DataFrame, top_k: int) -> DataFrame:
    """Dense ranking of questions by their hashed tokens; blank questions have no hits."""
    return dense_topk(index, hashed_vectors(questions, "query_id", "question").withColumnRenamed("embedding", "query"), top_k, normalized=True)
