"""Spark-first document retrieval analytics: cleaning, chunking, BM25, vectors, fusion."""
