"""Streaming ingest: new pages become chunks and postings of documents that are complete, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators import chunking, lexical


def page_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of pages as a stream; ``schema`` as DDL."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest(pages: DataFrame, doc_meta: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Chunks each batch's documents and appends chunks and postings under ``folder``, by batch.

    A document's pages must arrive in one batch: its chunks are final only after its last page. Every batch overwrites
    its own partition ``batch=N``, so a batch that is run again after a failure leaves one copy. idf and mean length are
    global: they are computed from the stored postings when searching.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        chunks = chunking.chunk_documents(batch, doc_meta)
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{folder}/chunks/batch={number}")
        lexical.postings(stored).write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        batch.unpersist()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
