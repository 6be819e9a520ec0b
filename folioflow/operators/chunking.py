"""Pages to chunks: line state by windows, one group of lines per chunk, paths by a fold over a document's groups.

One shuffle, by doc_id: the windows, the grouping of lines and the folds over a document all keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import DEFAULT, Config
from folioflow.functions import boundaries as B
from folioflow.functions import text as T
from folioflow.operators.merging import merge_small
from folioflow.operators.splitting import split_oversized

# The type of chunk that each structural boundary opens.
CHUNK_TYPES = {"top_level": "paragraph", "decimal": "subparagraph", "clause": "clause", "roman": "roman_item", "bullet": "bullet"}
IN_LIST = ("clause", "roman", "bullet")


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no, line, is_table of the lines with text; a table page is one row with its whole text.

    Of repeated deliveries of a page the last counts. Null texts have no lines (a table page with null text: '').
    """
    placed = pages.where("doc_id is not null").select("doc_id", "page_number", "text", "has_table", "loaded_at").repartition("doc_id")
    latest = Window.partitionBy("doc_id", "page_number").orderBy(F.desc_nulls_last("loaded_at"), "text")
    once = placed.withColumn("_r", F.row_number().over(latest)).where("_r = 1")
    is_table = F.coalesce("has_table", F.lit(False))
    rows = F.when(is_table, F.array(F.coalesce("text", F.lit("")))).otherwise(T.lines(F.col("text")))
    split = once.select("doc_id", "page_number", is_table.alias("is_table"), T.rows_of(rows, "line_no", "line"))
    split = split.where("line is not null")
    return split.where(F.col("is_table") | F.col("line").rlike(T.NS))


def line_states(lines: DataFrame) -> DataFrame:
    """Adds to each line: continues (the line before ended in a hyphen), in_enumeration, kind, marker, title, grp.

    A title is that of the last heading, '' before any; grp numbers the runs of lines that one chunk is made of.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number", "line_no")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    hyphen = F.when(~F.col("is_table"), F.col("_stripped").endswith("-"))
    states = lines.withColumn("_stripped", F.when(~F.col("is_table"), T.strip(line))).withColumn("continues", ~F.col("is_table") & F.coalesce(F.last(hyphen, ignorenulls=True).over(before), F.lit(False)))
    free = ~F.col("is_table") & ~F.col("continues")
    states = states.withColumn("_definite", F.when(free, B.definite_kind(line)))
    states = states.withColumn("in_enumeration", F.coalesce(F.last("_definite", ignorenulls=True).over(before).isin(*IN_LIST), F.lit(False)))
    states = states.withColumn("kind", F.when(free, B.boundary_kind(line, F.col("in_enumeration"), F.col("_definite"), F.col("_stripped"))))
    states = states.withColumn("marker", B.boundary_marker(line, F.col("kind")))
    title = F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("marker")), ignorenulls=True).over(so_far), F.lit(""))
    starts = F.col("kind").isNotNull() | F.col("is_table") | F.coalesce(F.lag("is_table").over(order), F.lit(False))
    return states.withColumn("title", title).withColumn("grp", F.sum(starts.cast("int")).over(so_far)).drop("_definite", "_stripped")


def line_groups(states: DataFrame) -> DataFrame:
    """One row per run of lines: body, pages, type, title, and the event that changes the section path, if any."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    kind, first_page = F.col("kind"), F.col("page_number") == 1
    sets_path = F.coalesce(kind.isin("top_level", "decimal", "clause", "roman"), F.lit(False))
    is_body = kind.isNull() & ~F.col("is_table")
    states = states.withColumn("_path_known", F.sum(sets_path.cast("int")).over(so_far) + F.sum(is_body.cast("int")).over(so_far))
    # the first line of text opens an implicit section if nothing has opened one
    opens = is_body & (F.col("_path_known") == 1)
    event = F.when(opens, F.struct(F.lit("start").alias("kind"), F.when(first_page, "preamble").otherwise("1").alias("marker"))).when(
        sets_path, F.struct(kind.alias("kind"), F.col("marker").alias("marker"))
    )
    kinds = F.create_map(*[F.lit(x) for pair in CHUNK_TYPES.items() for x in pair])
    opened = F.when(opens, F.when(first_page, "preamble").otherwise("paragraph")).when(kind != "heading", kinds[kind])
    states = states.withColumn("_event", event).withColumn("_type", opened)
    states = states.withColumn("_start", F.coalesce(F.last(F.when(F.col("_type").isNotNull(), F.col("page_number")), ignorenulls=True).over(so_far), F.lit(1)))
    states = states.withColumn("_type", F.coalesce(F.last("_type", ignorenulls=True).over(so_far), F.lit("paragraph")))
    rows = F.sort_array(F.collect_list(F.struct("page_number", "line_no", "line", F.col("_start").alias("start"), F.col("_type").alias("type"))))
    grouped = states.where(F.coalesce(kind != "heading", F.lit(True))).groupBy("doc_id", "grp").agg(
        rows.alias("rows"), F.max("is_table").alias("is_table"), F.max("title").alias("title"), F.max("_event").alias("event")
    )
    last = F.try_element_at("rows", F.lit(-1))
    joined = F.array_join(F.transform("rows", lambda x: x["line"]), "\n")
    grouped = grouped.withColumn("_text", joined).withColumn("_last", last)
    joined, last = F.col("_text"), F.col("_last")
    low = F.lower(joined)
    asks = low.contains("whether") | low.startswith("q") | low.contains(" if ")
    made = grouped.select(
        "doc_id", "grp", "is_table", "title", "event",
        F.when(F.col("is_table"), joined).otherwise(T.strip(joined)).alias("body"),
        F.when(F.col("is_table"), last["page_number"]).otherwise(last["start"]).alias("page_start"),
        last["page_number"].alias("page_end"),
        F.when(F.col("is_table"), F.when(asks, "table_qa").otherwise("table_raw")).otherwise(last["type"]).alias("chunk_type"),
    )
    return made.withColumn("kept", _kept(F.col("body"), F.col("is_table")))


#: Two words with a letter or a digit.
TWO_WORDS = rf"(?s)[\p{{L}}\p{{N}}]{T.NS}*{T.S}.*?[\p{{L}}\p{{N}}]"


def _kept(body: Column, is_table: Column) -> Column:
    """Whether a group becomes a chunk: tables always; text unless it is no more than a marker."""
    words = F.filter(F.split(body, f"{T.S}+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    only = F.try_element_at(words, F.lit(1))
    marker = only.rlike(r"^\p{Nd}+\.*$") | T.is_roman(only) | T.is_clause(only)
    return F.when(is_table | body.rlike(TWO_WORDS), True).otherwise((F.size(words) > 0) & ~F.coalesce(marker, F.lit(True)))


def document_chunks(groups: DataFrame) -> DataFrame:
    """doc_id, parts: per document its chunks in order, before merging: seq, path, title, type, pages and body."""
    ordered = F.sort_array(F.collect_list(F.struct("grp", "is_table", "title", "event", "body", "page_start", "page_end", "chunk_type", "kept")))
    documents = groups.groupBy("doc_id").agg(ordered.alias("groups"))
    none = F.array().cast("array<string>")
    paths = F.aggregate(
        "groups",
        F.struct(F.lit("").alias("path"), none.alias("paths")),
        lambda acc, g: _step(acc, F.coalesce(B.next_path(acc["path"], g["event"]["kind"], g["event"]["marker"]), acc["path"])),
        lambda acc: acc["paths"],
    )
    placed = documents.withColumn("groups", F.zip_with("groups", paths, lambda g, path: g.withField("path", path)))
    kept = placed.withColumn("groups", F.filter("groups", lambda g: g["kept"]))
    part = lambda g, i: F.struct(
        (i + 1).alias("seq"),
        F.when(g["path"] != "", g["path"]).when(g["is_table"], F.concat(F.lit("p."), g["page_start"].cast("string"))).otherwise("1").alias("path"),
        g["title"].alias("title"), g["chunk_type"].alias("type"), g["page_start"].alias("page_start"), g["page_end"].alias("page_end"),
        g["body"].alias("body"),
    )
    return kept.select("doc_id", F.transform("groups", part).alias("parts"))


def _step(acc: Column, path: Column) -> Column:
    return F.struct(path.alias("path"), F.concat(acc["paths"], F.array(path)).alias("paths"))


# Metadata without which a document is not accepted.
REQUIRED_METADATA = ("circular_number", "doc_id", "source_filename")


def accepted_and_rejected_metadata(doc_meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and the others with the sorted names of what is missing (null) as ``missing``.

    A table without one of the columns, or with one that is not a string, is refused as a whole: ValueError, TypeError.
    """
    if absent := sorted(set(REQUIRED_METADATA) - set(doc_meta.columns)):
        raise ValueError(f"metadata lacks the columns {absent}")
    if wrong := [name for name, kind in doc_meta.dtypes if name in REQUIRED_METADATA and kind != "string"]:
        raise TypeError(f"metadata columns that are not strings: {wrong}")
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_METADATA)))
    marked = doc_meta.withColumn("missing", missing)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def metadata(doc_meta: DataFrame) -> DataFrame:
    """One row per doc_id, the last by updated_at; absent numbers and dates are ''."""
    latest = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("updated_at"), "source_filename", "circular_number", "date_issued")
    once = doc_meta.where("doc_id is not null").withColumn("_r", F.row_number().over(latest)).where("_r = 1")
    return once.select("doc_id", "source_filename", *(F.coalesce(c, F.lit("")).alias(c) for c in ("circular_number", "date_issued")))


def with_metadata(documents: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """Documents with file name, number and date; one without metadata gets ``{doc_id}.pdf`` and empty fields."""
    known = documents.join(metadata(doc_meta), "doc_id", "left")
    return known.select(
        "doc_id", "parts",
        F.coalesce("source_filename", F.concat("doc_id", F.lit(".pdf"))).alias("source_filename"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("circular_number", "date_issued")),
    )


def as_chunks(documents: DataFrame) -> DataFrame:
    """The chunk table from documents' parts."""
    kept = ("doc_id", "source_filename", "circular_number", "date_issued")
    parts = documents.select(*kept, T.rows_of(F.col("parts"), "_i", "part")).where("part is not null").select(*kept, "part.*")
    text = F.concat(T.header(F.col("circular_number"), F.col("path"), F.col("title")), F.lit("\n"), F.col("body"))
    return parts.select(
        T.chunk_id(F.col("doc_id"), F.col("path"), F.col("seq")).alias("chunk_id"), "doc_id", "source_filename", "page_start", "page_end",
        F.col("path").alias("section_path"), T.parent_path(F.col("path")).alias("parent_section"), F.col("title").alias("section_title"),
        text.alias("text"), T.token_count(text).alias("token_count"), F.col("type").alias("chunk_type"),
        F.lit("structural").alias("parsing_method"), "circular_number", "date_issued",
    )


def documents(pages: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """Per document its unmerged chunks, with metadata."""
    return with_metadata(document_chunks(line_groups(line_states(page_lines(pages)))), doc_meta)


def raw_chunks(pages: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """Chunks before merging and splitting."""
    return as_chunks(documents(pages, doc_meta))


def merged_chunks(pages: DataFrame, doc_meta: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Chunks after small ones are merged, before splitting."""
    return as_chunks(merge_small(documents(pages, doc_meta), config))


def chunk_documents(pages: DataFrame, doc_meta: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The final chunks of all documents: grouped lines, small ones merged, oversized ones split."""
    return split_oversized(merged_chunks(pages, doc_meta, config), config)
