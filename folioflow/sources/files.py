"""Files as pages: scan, extraction by a pluggable extractor, typed rejections, the page table."""

from __future__ import annotations

import fnmatch
import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import strip

#: What an extractor returns for one file: (text, number of tables) per page. It raises for a file it cannot open.
PageExtractor = Callable[[bytes], list[tuple[str, int]]]

SCHEMA = "path string, file_name string, page_number int, raw_text string, n_tables int, error_kind string, error string"


def text_pages(content: bytes) -> list[tuple[str, int]]:
    """Pages of a plain text file, separated by form feeds; no tables; a blank file has no pages."""
    return [(page, 0) for page in content.decode("utf-8").split("\f")] if content.strip() else []


def html_pages(content: bytes) -> list[tuple[str, int]]:
    """Pages of an HTML file, separated by ``<hr>``: visible text, block elements as lines, tables counted."""
    pages = []
    for part in re.split(r"(?i)<hr\b[^>]*>", content.decode("utf-8")):
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", part)
        text = re.sub(r"(?i)</?(?:p|div|li|tr|h[1-6]|br|table|ul|ol)\b[^>]*>", "\n", text)
        pages.append((html.unescape(re.sub(r"<[^>]+>", " ", text)), len(re.findall(r"(?i)<table\b", part))))
    return pages if content.strip() else []


def scan_files(spark: SparkSession, folder: str, pattern: str, extractor: PageExtractor = text_pages) -> DataFrame:
    """One row per page of every matching file, or one row with error_kind for a file that gives none.

    error_kind: ``open_failed`` (the extractor raised), ``empty`` (no pages, or a file of no bytes). One file's failure does
    not end the scan. A folder that does not exist or has no matching files gives no rows. Files are read and extracted
    where Spark places them; those of no bytes, over which Spark's reader passes, are added by their listing.
    """
    empty = spark.createDataFrame([], SCHEMA)
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in (problem.getCondition() or ""):
            raise
        return empty

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    pages, kind, error = extractor(bytes(content)), "empty", "no pages"
                except Exception as problem:  # noqa: BLE001: whatever a file's extraction raises is that file's rejection
                    pages, kind, error = [], "open_failed", str(problem)
                rows = [(path, name, k, text, tables, None, None) for k, (text, tables) in enumerate(pages, 1)]
                yield pd.DataFrame(rows or [(path, name, None, None, None, kind, error)], columns=SCHEMA.replace(",", "").split()[::2])

    names = spark.createDataFrame([(p, p.rsplit("/", 1)[-1], "empty", "no bytes") for p in _without_bytes(spark, folder, pattern)], "path string, file_name string, error_kind string, error string")
    return files.select("path", "content").mapInPandas(run, SCHEMA).unionByName(names, allowMissingColumns=True)


def _without_bytes(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """The paths of the matching files of no bytes, by the file system's own listing: names only."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(folder)
    listing = root.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while listing.hasNext():
        status = listing.next()
        path = status.getPath()
        if not status.getLen() and fnmatch.fnmatchcase(path.getName(), pattern) and not path.getName().startswith(("_", ".")):
            found.append(path.toString())
    return found


def accepted_and_rejected(scanned: DataFrame, thin_chars: int = 50, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Pages of accepted files, and rejections (path, error_kind, error); mostly empty files are rejected as ``scanned``."""
    failed = scanned.where(F.col("error_kind").isNotNull()).select("path", "error_kind", "error")
    good = scanned.where(F.col("error_kind").isNull())
    thin = (F.length(strip(F.coalesce("raw_text", F.lit("")))) < thin_chars).cast("int")
    poor = good.groupBy("path").agg(F.avg(thin).alias("thin")).where(F.col("thin") > share)
    rejected = failed.unionByName(poor.select("path", F.lit("scanned").alias("error_kind"), F.lit("too little text").alias("error")))
    return good.join(poor.select("path"), "path", "left_anti"), rejected


def as_pages(accepted: DataFrame) -> DataFrame:
    """The page table of accepted files: doc_id is the file name without its ending."""
    return accepted.select(
        F.regexp_replace("file_name", r"\.[^.]*$", "").alias("doc_id"),
        F.xxhash64("path", "page_number").alias("page_id"),
        "page_number",
        "raw_text",
        (F.col("n_tables") > 0).alias("has_table"),
        F.lit(None).cast("timestamp_ntz").alias("loaded_at"),
    )
