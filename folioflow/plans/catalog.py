"""All queries of the core, by name, with the SQL they must agree with. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.config import DEFAULT
from folioflow.functions import text as T
from folioflow.operators import chunking, dense, evidence, fusion, lexical, pages, splitting
from folioflow.plans import chunk_oracles as K
from folioflow.plans import oracles as O
from folioflow.plans import split_oracles as X
from folioflow.plans.engine import Engine
from folioflow.plans.lineage import cut, small
from folioflow.sources import index_store
from folioflow.sources.tables import table


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: the questions whose id is divisible by 20."""
    return table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "question")


def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.clean_pages(table(spark, d, "pages"))


def text_gate(spark: SparkSession, d: str) -> DataFrame:
    return pages.native_text_gate(table(spark, d, "pages"))


def page_warnings(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_warnings(table(spark, d, "pages"))


def document_warnings(spark: SparkSession, d: str) -> DataFrame:
    return pages.document_warnings(table(spark, d, "pages"))


def document_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.document_text(table(spark, d, "pages"))


def document_report(spark: SparkSession, d: str) -> DataFrame:
    return pages.document_report(table(spark, d, "pages"), table(spark, d, "parsed_documents"))


def line_states(spark: SparkSession, d: str) -> DataFrame:
    states = chunking.line_states(chunking.page_lines(table(spark, d, "pages")))
    return states.select("doc_id", "page_number", "line_no", "is_table", "continues", "in_enumeration", "kind", "marker", "title", "grp")


def boundary_counts(spark: SparkSession, d: str) -> DataFrame:
    states = chunking.line_states(chunking.page_lines(table(spark, d, "pages")))
    return states.where("kind <> 'heading'").groupBy("kind", "marker").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_documents"))


def raw_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.raw_chunks(table(spark, d, "pages"), table(spark, d, "doc_meta"))


def merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.merged_chunks(table(spark, d, "pages"), table(spark, d, "doc_meta"))


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "pages"), table(spark, d, "doc_meta"))


def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The given chunks, with those above the limit by their own text split."""
    given = pages.last_delivery(table(spark, d, "chunks").drop("metadata"), ["chunk_id"], "loaded_at").drop("created_at", "loaded_at")
    filled = given.withColumns({c: F.coalesce(c, F.lit("")) for c in ("section_path", "section_title", "circular_number", "chunk_type")})
    return splitting.split_oversized(filled.withColumn("token_count", T.token_count(F.col("text"))))


def chunk_parts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "section_path", "section_title", "circular_number", "text").distinct()
    text, path = F.col("text"), F.col("section_path")
    return c.select(
        "chunk_id", T.body(text).alias("body"), T.parent_path(path).alias("parent_section"),
        T.header(F.col("circular_number"), path, F.col("section_title")).alias("header"), T.token_count(text).alias("n_tokens"),
        F.concat("doc_id", F.lit("__"), F.regexp_replace(path, "[^a-zA-Z0-9_.]", "_")).alias("id_stem"),
    )


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "text", "token_count", "chunk_type").distinct().withColumn("n", T.token_count(F.col("text")))
    n, big = F.col("n"), DEFAULT.max_chunk_tokens
    return c.groupBy("chunk_type").agg(
        F.count("*").alias("n_chunks"), F.count_if(F.col("token_count").isNull() | (F.col("token_count") != n)).alias("n_outdated"),
        F.count_if(n < DEFAULT.min_chunk_tokens).alias("n_small"),
        F.count_if((n > big) & ~F.col("chunk_type").startswith("table")).alias("n_oversized"), F.sum("n").cast("long").alias("n_tokens"),
    )


def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "parsed_documents").select("doc_id").distinct().withColumn("parts", F.lit(None))
    return chunking.with_metadata(known, table(spark, d, "doc_meta")).drop("parts")


def rejected_metadata(spark: SparkSession, d: str) -> DataFrame:
    return chunking.accepted_and_rejected_metadata(table(spark, d, "doc_meta"))[1].select("doc_id", "source_filename", "circular_number", "missing")


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return lexical.terms(lexical.postings(c), lexical.corpus(c)).select("term", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus(table(spark, d, "chunks")).select(F.col("n").alias("n_chunks"), F.round("avgdl", 6).alias("avgdl"))


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    grouped = lexical.postings(table(spark, d, "chunks")).groupBy("chunk_id")
    return grouped.agg(F.first("doc_len").cast("long").alias("doc_len"), F.count("*").alias("n_terms"), F.max("tf").cast("long").alias("max_tf"))


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    listed = cut(lexical.tokenized(table(spark, d, "chunks")))
    return lexical.bm25(lexical.postings_of(listed), lexical.corpus_of(listed), _questions(spark, d))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d)


def hashed_topk(spark: SparkSession, d: str) -> DataFrame:
    index = dense.hashed_vectors(table(spark, d, "chunks"), "chunk_id", "text")
    return dense.hashed_topk(index, _questions(spark, d), DEFAULT.dense_top_k)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("chunk_id"), "embedding", "vec_id")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return dense.dense_topk(rows, queries, normalized=True)


def _given(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks that have a vector, their vectors, and the stated set: chunks of documents whose number is divisible by 20."""
    given = table(spark, d, "chunk_vectors").where("chunk_id is not null and size(embedding) > 0").select("chunk_id", "embedding")
    vectors, ids = index_store.one_each(given), cut(given.select("chunk_id").distinct())
    chunks = table(spark, d, "chunks").select("chunk_id", "section_title", "text").join(small(ids), "chunk_id", "left_semi")
    number = F.regexp_extract("chunk_id", "([0-9]+)__", 1).cast("long")
    titles = cut(chunks.where(number % 20 == 0).groupBy("chunk_id").agg(F.min("section_title").alias("question")))
    asked = vectors.join(small(titles), "chunk_id").dropDuplicates(["chunk_id"])
    return chunks, vectors, asked.select(F.xxhash64("chunk_id").alias("query_id"), F.col("chunk_id").alias("query_chunk"), "question", F.col("embedding").alias("query"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest given vectors, which are not all of unit length and some zero, of a stated set of chunks."""
    _, vectors, asked = _given(spark, d)
    asked = cut(asked)
    hits = dense.dense_topk(vectors, asked)
    return hits.join(asked.select("query_id", "query_chunk"), "query_id").select("query_chunk", "chunk_id", "score", "rank")


def hybrid_vectors_topk(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over given vectors: a stated set of chunks asks with its titles and vectors."""
    chunks, vectors, asked = _given(spark, d)
    asked = cut(asked)
    engine = Engine(index_store.build(chunks, vectors, model="given"))
    hits = engine.search(asked.select("query_id", "question"), queries=asked.select("query_id", "query"))
    return hits.join(asked.select("query_id", "query_chunk"), "query_id").drop("query_id")


def min_max_scores(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d).select("query_id", "chunk_id", F.round(fusion.min_max(F.col("score"), ["query_id"]), 6).alias("scaled"))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every question's best chunks by BM25 and by vectors, scaled and fused."""
    return Engine(index_store.build(table(spark, d, "chunks").select("chunk_id", "text"))).search(_questions(spark, d))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    hits = cut(hybrid_topk(spark, d).select("query_id", "chunk_id", "rank"))  # at most 20 rows a question
    return evidence.hit_chunks(hits, table(spark, d, "chunks"))


def evidence_blocks(spark: SparkSession, d: str) -> DataFrame:
    return evidence.evidence(_hits(spark, d))


def citations(spark: SparkSession, d: str) -> DataFrame:
    return evidence.citations(_hits(spark, d))


def confidence_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", evidence.confidence_label(F.col("text")).alias("confidence_label"))


def valid_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", evidence.valid_question(F.col("text")).alias("is_valid"))


def vector_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and vectors that lack the other: the check before an index is built from precomputed vectors."""
    c = table(spark, d, "chunks").select("chunk_id").distinct().withColumn("c", F.lit(1))
    v = table(spark, d, "chunk_vectors").where(F.size("embedding") > 0).select("chunk_id").distinct().withColumn("v", F.lit(1))
    state = F.when(F.col("v").isNull(), "no vector").when(F.col("c").isNull(), "no chunk").otherwise("both")
    return c.join(v, "chunk_id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n_chunks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_pages, text_gate, page_warnings, document_warnings, document_text, document_report, line_states, boundary_counts, raw_chunks, merged_chunks,
        document_chunks, split_chunks, chunk_parts, chunk_counts, document_metadata, rejected_metadata, term_stats, corpus_stats, doc_lengths, bm25_topk,
        hashed_topk, dense_topk, cosine_topk, min_max_scores, hybrid_topk, hybrid_vectors_topk, evidence_blocks, citations, confidence_labels, valid_questions,
        vector_gaps,
    )
}

ORACLES: dict[str, str] = {
    "clean_pages": O.CLEAN_PAGES,
    "text_gate": O.TEXT_GATE,
    "page_warnings": O.PAGE_WARNINGS,
    "document_warnings": O.DOCUMENT_WARNINGS,
    "document_text": O.DOCUMENT_TEXT,
    "document_report": O.DOCUMENT_REPORT,
    "line_states": O.LINE_STATES,
    "boundary_counts": O.BOUNDARY_COUNTS,
    "raw_chunks": K.RAW_CHUNKS,
    "merged_chunks": K.MERGED_CHUNKS,
    "document_chunks": X.DOCUMENT_CHUNKS,
    "split_chunks": X.SPLIT_CHUNKS,
    "chunk_parts": O.CHUNK_PARTS,
    "chunk_counts": O.COUNTS,
    "document_metadata": O.METADATA,
    "rejected_metadata": O.REJECTED_METADATA,
    "term_stats": O.TERM_STATS,
    "corpus_stats": O.CORPUS_STATS,
    "doc_lengths": O.DOC_LENGTHS,
    "bm25_topk": O.BM25_TOPK,
    "hashed_topk": O.HASHED_TOPK,
    "dense_topk": O.DENSE_TOPK,
    "cosine_topk": O.COSINE_TOPK,
    "min_max_scores": O.MIN_MAX,
    "hybrid_topk": O.HYBRID_TOPK,
    "hybrid_vectors_topk": O.HYBRID_VECTORS,
    "evidence_blocks": O.EVIDENCE,
    "citations": O.CITATIONS,
    "confidence_labels": O.CONFIDENCE,
    "valid_questions": O.VALID,
    "vector_gaps": O.VECTOR_GAPS,
}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return hybrid_topk(spark, folder)
