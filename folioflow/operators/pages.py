"""Pages and documents: last delivery, cleaning, the gate against scanned files, warnings, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import DEFAULT, Config
from folioflow.functions.text import clean_page, strip


def last_delivery(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One row per key, the last by ``time`` (nulls first); equal times are decided by the row's other values."""
    rest = [F.xxhash64(*[c for c in df.columns if c not in keys])]
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(time), *rest)
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def clean_pages(pages: DataFrame) -> DataFrame:
    """page_id, doc_id, page_number, text, char_count of every page, from its raw text; a null raw text gives ''."""
    once = last_delivery(pages.select("page_id", "doc_id", "page_number", "raw_text", "loaded_at"), ["page_id"], "loaded_at")
    text = F.coalesce(clean_page(F.col("raw_text"), F.col("page_number")), F.lit(""))
    return once.select("page_id", "doc_id", "page_number", text.alias("text")).withColumn("char_count", F.length("text"))


def native_text_gate(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, n_pages, n_thin, accepted: rejected as scanned if more than half the pages have fewer than 50 characters.

    A null raw text counts as an empty page; repeated deliveries count once.
    """
    once = last_delivery(pages.select("page_id", "doc_id", "raw_text", "loaded_at"), ["page_id"], "loaded_at")
    thin = (F.length(strip(F.coalesce("raw_text", F.lit("")))) < config.scanned_page_chars).cast("long")
    counted = once.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(thin).alias("n_thin"))
    return counted.withColumn("accepted", F.col("n_thin") <= F.col("n_pages") * config.scanned_page_share)


def _warnings() -> Column:
    """What there is to warn about in a page (page_number, text, has_table): a table, then no text."""
    label = F.concat(F.lit("Page "), F.col("page_number").cast("string"))
    return F.array_compact(
        F.array(
            F.when(F.col("has_table"), F.concat(label, F.lit(": table detected"))),
            F.when(F.coalesce(strip(F.col("text")), F.lit("")) == "", F.concat(label, F.lit(": no text"))),
        )
    )


def page_warnings(pages: DataFrame) -> DataFrame:
    """page_id, warning: one row for each warning about a page: a table, no text."""
    once = last_delivery(pages.select("page_id", "page_number", "text", "has_table", "loaded_at"), ["page_id"], "loaded_at")
    return once.select("page_id", F.explode(_warnings()).alias("warning"))


def document_warnings(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, warnings: the warnings of a document's pages in order, then whether it is very short; empty if there is none."""
    once = last_delivery(pages.select("page_id", "doc_id", "page_number", "text", "has_table", "loaded_at"), ["page_id"], "loaded_at")
    placed = once.select("doc_id", "page_number", "page_id", _warnings().alias("some"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    told = F.when(F.size("some") > 0, F.struct("page_number", "page_id", "some"))
    grouped = placed.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(told)).alias("told"), F.sum("n").alias("n"))
    short = F.concat(F.lit("Document is very short: only "), F.col("n").cast("string"), F.lit(" total characters extracted."))
    last = F.when(F.col("n") < config.short_document_chars, F.array(short)).otherwise(F.array().cast("array<string>"))
    return grouped.select("doc_id", F.concat(F.flatten(F.col("told.some")), last).alias("warnings"))


def document_text(pages: DataFrame) -> DataFrame:
    """doc_id, text, total_chars: pages that have text, in order, each under a banner, joined by a blank line."""
    once = last_delivery(pages.select("page_id", "doc_id", "page_number", "text", "loaded_at"), ["page_id"], "loaded_at")
    some = once.where(F.coalesce("text", F.lit("")) != "")
    page = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("page_number", "page_id", page.alias("page"))))
    return some.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["page"]), "\n\n").alias("text"), F.sum(F.length("text")).cast("long").alias("total_chars")
    )


def document_report(pages: DataFrame, parsed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per parsed document: pages, characters, table pages, empty pages, whether short, its status.

    Status: ``empty`` without pages, ``scanned`` by the gate, else ``parsed``.
    """
    files = last_delivery(parsed.select("doc_id", "file_name", "parsed_at"), ["doc_id"], "parsed_at").drop("parsed_at")
    once = last_delivery(pages.select("page_id", "doc_id", "text", "raw_text", "has_table", "loaded_at"), ["page_id"], "loaded_at")
    text = F.coalesce("text", F.lit(""))
    thin = F.length(strip(F.coalesce("raw_text", F.lit("")))) < config.scanned_page_chars
    totals = once.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"),
        F.sum(F.length(text)).cast("long").alias("total_chars"),
        F.count_if(F.col("has_table")).alias("n_tables"),
        F.count_if(strip(text) == "").alias("n_empty"),
        F.count_if(thin).alias("n_thin"),
    )
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pages", "total_chars", "n_tables", "n_empty", "n_thin")}
    status = (
        F.when(F.col("n_pages") == 0, "empty").when(F.col("n_thin") > F.col("n_pages") * config.scanned_page_share, "scanned").otherwise("parsed")
    )
    return (
        files.join(totals, "doc_id", "left")
        .select("doc_id", "file_name", *zero.values())
        .withColumn("is_short", F.col("total_chars") < config.short_document_chars)
        .withColumn("status", status)
        .drop("n_thin")
    )
