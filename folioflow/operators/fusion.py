"""Fusion of two rankings: min-max per side, weighted sum over a full outer join, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import DEFAULT, Config
from folioflow.operators.lexical import ranked


def min_max(score: Column, by: list[str]) -> Column:
    """Scores scaled to 0..1 within each group; all equal: 1 if positive, else 0."""
    group = Window.partitionBy(*by)
    low, high = F.min(score).over(group), F.max(score).over(group)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.when(score > 0, 1.0).otherwise(0.0))


def fuse(lexical: DataFrame, dense: DataFrame, top_k: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """query_id, chunk_id, score, rank, sources, raw and scaled scores of both sides.

    A side that lacks a chunk has a null raw score and 0 scaled. The candidate sets are part of the result's meaning:
    scaling depends on them. Scores are rounded to 6 decimals; ties go to the smaller chunk_id.
    """
    top_k = config.hybrid_top_k if top_k is None else top_k
    a = lexical.select("query_id", "chunk_id", F.col("score").alias("bm25_score"), min_max(F.col("score"), ["query_id"]).alias("a"))
    b = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), min_max(F.col("score"), ["query_id"]).alias("b"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer").select(
        "query_id", "chunk_id", "bm25_score", "dense_score", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")
    )
    sources = F.array_compact(F.array(F.when(F.col("bm25_score").isNotNull(), "bm25"), F.when(F.col("dense_score").isNotNull(), "dense")))
    scored = both.select(
        "query_id", "chunk_id", F.round(config.lexical_weight * F.col("a") + config.dense_weight * F.col("b"), 6).alias("score"),
        sources.alias("retrieval_sources"), "bm25_score", "dense_score",
        F.round("a", 6).alias("normalized_bm25_score"), F.round("b", 6).alias("normalized_dense_score"),
    )
    return ranked(scored, top_k)
