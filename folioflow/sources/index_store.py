"""A search index as a folder of Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import dense, lexical
from folioflow.plans.lineage import cut, kept, small

TABLES = ("chunks", "postings", "corpus", "vectors", "vector_meta")
HASHED = "hashed-tokens"


@dataclass
class Index:
    """Chunks, postings (chunk_id, term, tf, doc_len), corpus (n, avgdl), vectors (chunk_id, embedding; a row may be repeated) and what they are."""

    chunks: DataFrame
    postings: DataFrame
    corpus: DataFrame
    vectors: DataFrame
    model: str = HASHED
    dimension: int = dense.BUCKETS
    normalized: bool = True

    def corpus_size(self) -> int:
        """The greater of the numbers of chunks of the lexical side and of vectors."""
        return max(lexical.totals(self.corpus)[0], self.vectors.select("chunk_id").distinct().count())


def build(
    chunks: DataFrame, vectors: DataFrame | None = None, embedder: dense.Embedder | None = None, model: str = HASHED, normalized: bool = False
) -> Index:
    """The index of a chunk table; duplicate chunk_ids count once, which :func:`duplicates` reports.

    The vectors are, in this order: those given (chunk_id, embedding; one row for each chunk, else ValueError; the dimension
    is that of the first in order of chunk_id and is not checked further), those of ``embedder`` (of unit length), or hashed
    tokens. ``normalized`` says that given vectors are of unit length; others are compared by their cosine.
    """
    listed = kept(lexical.tokenized(chunks))
    postings, corpus = lexical.postings_of(listed), lexical.corpus_of(listed)
    if vectors is not None:
        given = one_each(vectors)
        ids = given.select("chunk_id").distinct()
        gaps = ids.join(listed, "chunk_id", "left_anti").count(), listed.join(ids, "chunk_id", "left_anti").count()
        if any(gaps):
            raise ValueError(f"{gaps[0]} vectors have no chunk and {gaps[1]} chunks have no vector")
        first = given.where(F.size("embedding") > 0).agg(F.min_by(F.size("embedding"), "chunk_id")).first()[0]
        return Index(chunks, postings, corpus, given, model, first or 0, normalized)
    if embedder is not None:
        once = chunks.groupBy("chunk_id").agg(F.min("text").alias("text"))
        made = cut(dense.embed(once, "chunk_id", "text", embedder))
        row = made.first()
        return Index(chunks, postings, corpus, made, model, len(row["embedding"]) if row else 0, True)
    return Index(chunks, postings, corpus, dense.hashed_of_tokens(listed, "chunk_id"))


def one_each(vectors: DataFrame) -> DataFrame:
    """chunk_id, embedding of rows of one vector for each chunk_id; rows of the same vector may come again, so that no vector is shuffled.

    Of different vectors of a chunk_id the one of the smallest hash is taken.
    """
    mark = F.xxhash64("embedding")
    several = vectors.groupBy("chunk_id").agg(F.min(mark).alias("one"), F.max(mark).alias("other")).where("one < other").select("chunk_id", "one")
    rows = vectors.select("chunk_id", "embedding").join(small(cut(several)), "chunk_id", "left")
    return rows.where(F.col("one").isNull() | (F.col("one") == mark)).select("chunk_id", "embedding")


def duplicates(chunks: DataFrame) -> DataFrame:
    """chunk_id, n of ids with more than one text."""
    return chunks.groupBy("chunk_id").agg(F.count_distinct("text").alias("n")).where("n > 1")


def save(index: Index, folder: str) -> None:
    """Writes the tables; postings are placed and sorted by term, so that a question reads few row groups; a vector is written once."""
    index.chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    index.corpus.write.mode("overwrite").parquet(f"{folder}/corpus")
    index.vectors.dropDuplicates(["chunk_id"]).write.mode("overwrite").parquet(f"{folder}/vectors")
    meta = index.chunks.sparkSession.createDataFrame([(index.model, index.dimension, index.normalized)], "model string, dimension int, normalized boolean")
    meta.write.mode("overwrite").parquet(f"{folder}/vector_meta")


def load(spark: SparkSession, folder: str, model: str | None = None) -> Index:
    """Reads the tables; all that are missing are named in one FileNotFoundError. ``model`` replaces the stored name."""
    found, missing = {}, []
    for name in TABLES:
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            missing.append(f"{folder}/{name}")
    if missing:
        raise FileNotFoundError("missing index tables: " + ", ".join(missing))
    meta = found.pop("vector_meta").first()
    index = Index(**found, **meta.asDict())
    return replace(index, model=model) if model else index
