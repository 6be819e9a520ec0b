"""From hits to answers: evidence text, citations, refusals, labels, validation of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import DEFAULT, Config
from folioflow.functions.text import page_label, strip

# Phrases of an answer that says the evidence does not suffice.
REFUSALS = [
    "cannot be determined from the provided",
    "cannot be determined based on the provided",
    "not provided in the documents",
    "not mentioned in the provided",
    "provided documents do not contain",
    "provided evidence does not contain",
    "no information is provided",
    "insufficient evidence",
    "insufficient information",
    "not covered in the provided",
    "not found in the provided",
]


def is_refusal(answer: Column) -> Column:
    """Whether an answer is null, blank or one of the refusals."""
    low = F.lower(answer)
    refused = strip(answer) == ""
    for phrase in REFUSALS:
        refused = refused | low.contains(phrase)
    return F.coalesce(refused, F.lit(True))


def confidence_label(answer: Column) -> Column:
    return F.when(is_refusal(answer), "insufficient_evidence").otherwise("grounded")


def valid_question(question: Column, config: Config = DEFAULT) -> Column:
    """1 to ``question_chars`` characters before trimming, and not all white space; null is not valid."""
    return F.coalesce(F.length(question).between(1, config.question_chars) & (strip(question) != ""), F.lit(False))


def hit_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the payload of their chunks (last delivery): joined after ranking, so only top rows meet the texts."""
    latest = Window.partitionBy("chunk_id").orderBy(F.desc_nulls_last("loaded_at"), F.xxhash64("text", "source_filename"))
    payload = chunks.select("chunk_id", "source_filename", "section_path", "section_title", "page_start", "page_end", "text", "loaded_at")
    met = payload.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    once = met.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r", "loaded_at")
    return hits.join(once, "chunk_id")


def evidence(found: DataFrame) -> DataFrame:
    """query_id, evidence: the numbered blocks of a question's hits in rank order, one per hit."""
    block = F.concat(
        F.lit("--- Document Evidence ["), F.col("rank").cast("string"), F.lit("] ---\nSource File: "), F.col("source_filename"),
        F.lit("\nSection Path: "), F.col("section_path"), F.lit(" ("), F.col("section_title"), F.lit(")\nPages: "),
        page_label(F.col("page_start"), F.col("page_end")), F.lit("\nContent:\n"), F.col("text"), F.lit("\n"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", F.coalesce(block, F.lit("")).alias("block"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("evidence"))


def citations(found: DataFrame) -> DataFrame:
    """query_id, position, chunk_id, source_filename, section_path, page_start, page_end: each chunk once, by first rank."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    once = found.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    place = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return once.select(
        "query_id", F.row_number().over(place).alias("position"), "chunk_id", "source_filename", "section_path", "page_start", "page_end"
    )
