"""The queries of this subpackage by name, and SQL for those that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import abuse, boilerplate, encode, leaks, lookalike, neardup, oracles, split, vectors
from folioflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda spark, d: neardup.found(table(spark, d, "chunks")),
    "p1_classes": lambda spark, d: neardup.classes(table(spark, d, "chunks")),
    "p2_found": lambda spark, d: vectors.found(table(spark, d, "chunk_vectors")),
    "p2_neighbours": lambda spark, d: vectors.neighbours(table(spark, d, "chunk_vectors")),
    "p3_found": lambda spark, d: lookalike.found(table(spark, d, "pages")),
    "p3_consistent": lambda spark, d: lookalike.consistent(table(spark, d, "pages")),
    "p4_found": lambda spark, d: boilerplate.removed_lines(table(spark, d, "pages"), table(spark, d, "parsed_documents")),
    "p4_pages": lambda spark, d: boilerplate.cleaned(table(spark, d, "pages"), table(spark, d, "parsed_documents")),
    "p5_found": lambda spark, d: split.found(table(spark, d, "chunks")),
    "p5_pieces": lambda spark, d: split.pieces(table(spark, d, "chunks")),
    "p6_ids": lambda spark, d: encode.token_ids(table(spark, d, "documents")),
    "p6_source_tokens": lambda spark, d: encode.token_counts(table(spark, d, "documents")),
    "p7_found": lambda spark, d: leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p7_leaks": lambda spark, d: leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p8_found": lambda spark, d: abuse.found(table(spark, d, "documents"), table(spark, d, "review_labels")),
    "p8_scores": lambda spark, d: abuse.scores(table(spark, d, "documents"), table(spark, d, "review_labels")),
    "p8_rates": lambda spark, d: abuse.rates(table(spark, d, "documents"), table(spark, d, "review_labels")),
}

ORACLES: dict[str, str] = oracles.ORACLES
