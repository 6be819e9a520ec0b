"""Problem 4: lines repeated across one source's documents, by compressed bitmaps of documents.

Every document has an ordinal; documents of a source have neighbouring ones. A bitmap of documents is kept as its 64-bit
words that are not zero, one row for each (word-aligned compression: a line of one document is one word, a line of all
documents of a source one word for 64 of them). Each line as written (variant) of a source has such a bitmap; those of
all variants of one normal form are united, exact cardinalities (bits set) are summed and compared with the thresholds, and
a line of a page is deleted if the bit of its document is set in the bitmap of a form above them.

Scale: pages become lines once, in a narrow pass; what is kept of a line is a few numbers. Bitmaps are built by hash
aggregation with map-side combination; a line in every document of a hot source is many words, not one group. The words
of the forms above the thresholds, a few forms for each source, meet the lines again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.plans.lineage import cut, small

MIN_DOCUMENTS = 3
MIN_SHARE_PERCENT = 10
MIN_LETTERS = 10
#: Documents of one word of a bitmap: 2^6.
BITS = 6


def normal_form(line: Column) -> Column:
    """A-Z lower-cased, runs of digits as ``0``, runs of anything but a-z and 0-9 as one blank, ends trimmed."""
    plain = F.regexp_replace(line, "[^A-Za-z0-9]+", " ")
    return F.trim(F.lower(F.regexp_replace(plain, "[0-9]+", "0")))  # lower-cased last: only ASCII is left


def documents(parsed: DataFrame) -> DataFrame:
    """doc_id, source, ordinal: each document with a file name once, whatever the number of its parsings.

    If parsings disagree on the name, the smallest counts. Ordinals are unique, of any size, and dense within a source.
    """
    source = F.lower(F.substring_index("file_name", "__", 1))
    once = parsed.where("doc_id is not null and file_name is not null").groupBy("doc_id").agg(F.min("file_name").alias("file_name"))
    placed = once.select("doc_id", source.alias("source")).repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    return cut(placed.select("doc_id", "source", F.monotonically_increasing_id().alias("ordinal")))


def lines(pages: DataFrame, known: DataFrame) -> DataFrame:
    """page_id, line_no, source, form, variant, word, bit: the lines that can be cases; null texts have none.

    form and variant are hashes of the normal form (96 bits) and of the line as written (64); ``bit`` is the document's bit
    in the word of that number.
    """
    texts = pages.where("text is not null and page_id is not null").select("page_id", "doc_id", "text")
    split = texts.join(small(known), "doc_id").select(
        "source", "ordinal", "page_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line")
    )  # outer: else the optimizer adds a filter that splits every text twice
    form = F.col("form")
    return (
        split.where(F.length("line") >= MIN_LETTERS).withColumn("form", normal_form(F.col("line")))
        .where(F.length(F.replace(F.replace(form, F.lit(" "), F.lit("")), F.lit("0"), F.lit(""))) >= MIN_LETTERS)
        .select(
            "page_id", F.col("line_no").cast("int").alias("line_no"), F.xxhash64("source").alias("source"), F.xxhash64(form).alias("form"),
            F.hash(form).alias("check"), F.xxhash64("line").alias("variant"), F.shiftright("ordinal", BITS).alias("word"),
            F.expr(f"shiftleft(1L, cast(ordinal % {1 << BITS} as int))").alias("bit"),
        )
    )


FORM = ["source", "form", "check"]


def bitmaps(all_lines: DataFrame) -> DataFrame:
    """source, form, check, word, bits: the bitmap of documents of each normal form, united from those of its variants."""
    variants = all_lines.groupBy(*FORM, "variant", "word").agg(F.bit_or("bit").alias("bits"))
    return variants.groupBy(*FORM, "word").agg(F.bit_or("bits").alias("bits"))


def frequent(united: DataFrame, known: DataFrame) -> DataFrame:
    """The bitmaps of the forms that occur in enough documents of their source, by exact cardinality."""
    sizes = known.groupBy(F.xxhash64("source").alias("source")).agg(F.count("*").alias("documents"))
    counted = united.groupBy(*FORM).agg(F.sum(F.bit_count("bits")).alias("n")).where(F.col("n") >= MIN_DOCUMENTS)
    enough = counted.join(sizes, "source").where(F.col("n") * 100 >= F.col("documents") * MIN_SHARE_PERCENT).select(*FORM)
    return united.join(small(cut(enough)), FORM, "left_semi")


def marked(all_lines: DataFrame, held: DataFrame) -> DataFrame:
    """page_id, line_no of every line whose document's bit is set in the bitmap of its form, each once."""
    met = all_lines.join(small(held), [*FORM, "word"])
    return met.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("page_id", "line_no").distinct()


def removed_lines(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """page_id, line_no of every line to be removed, each once.

    Documents are those of ``parsed`` with a file name, by distinct doc_id; pages of others, null texts and lines with
    fewer than 10 letters take no part. Repeated deliveries of a page or a file count once. Other columns are ignored.
    """
    known = documents(parsed)
    every = cut(lines(pages, known))
    return marked(every, cut(frequent(cut(bitmaps(every)), known)))


def cleaned(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """p4_pages: page_id, text without the removed lines, n_removed; every page once, a null text stays null."""
    gone = removed_lines(pages, parsed).groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    once = pages.where("page_id is not null").groupBy("page_id").agg(F.min("text").alias("text"))
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return once.join(gone, "page_id", "left").select("page_id", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
