"""Problem 6: encoding of the whole corpus with a public tokenizer: tiktoken with a local rank file.

Long texts are cut at safe boundaries first: between a character that is not white space and one that is, the tokenizer's
own pattern always cuts, and what follows does not depend on what came before. Decoding joins raw bytes.

Scale: a narrow pass without a shuffle; each Python worker reads the rank file once. Spark sends the driver's file
(``rank_file``) to every executor.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary cuts text before its merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a segment of a long text.
SEGMENT = 1 << 16
_BOUNDARY = re.compile(r"(?<=[^\W_]|[.,;:।])(?=[ \n][^\W_])")


@lru_cache(maxsize=4)
def encoding(rank_file: str):
    """The tiktoken encoding of a rank file, made once in each process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in segments of about ``size`` characters, cut only at safe boundaries (a text without any stays whole)."""
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str | None, rank_file: str = RANK_FILE) -> list[int]:
    """The ids of one text without special tokens; null and empty give []. A lone surrogate counts as U+FFFD."""
    if not text:
        return []
    tool = encoding(rank_file)
    return [i for segment in segments(text) for i in tool.encode_ordinary(segment)]


def decode_ids(ids: list[int], rank_file: str = RANK_FILE) -> str:
    """The text of ids, by joining the tokens' raw bytes."""
    tool = encoding(rank_file)
    return b"".join(map(tool.decode_single_token_bytes, ids)).decode("utf-8", "replace")


def _sent(frame: DataFrame, rank_file: str) -> str:
    """The name under which the executors have the rank file, which is added to the application once."""
    context, name = frame.sparkSession.sparkContext, os.path.basename(rank_file)
    if not any(x.endswith("/" + name) for x in context.listFiles):
        context.addFile(rank_file)
    return name


def _encode(name: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_file = SparkFiles.get(name)
        for batch in rows:
            texts = batch.column(1)
            for start in range(0, len(batch), 256):
                ids = [encode_text(x, rank_file) for x in texts.slice(start, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 256), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """doc_id, ids: one row per row of ``documents``; null and empty texts give an empty list, never null."""
    return documents.select("doc_id", "text").mapInArrow(_encode(_sent(documents, rank_file)), "doc_id long, ids array<int>")


def _count(name: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_file = SparkFiles.get(name)
        for batch in rows:
            n = pa.array([len(encode_text(x, rank_file)) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())], names=["source", "tokens", "bytes"])

    return run


def token_counts(documents: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """source, n_documents, n_tokens, n_bytes: the size of each source in tokens; a null source is its own group."""
    counted = documents.select("source", "text").mapInArrow(_count(_sent(documents, rank_file)), "source string, tokens long, bytes long")
    return counted.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("tokens").alias("n_tokens"), F.sum("bytes").alias("n_bytes"))
