"""Splitting of oversized chunks at list items and sentences, with small children at the end rebalanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.config import DEFAULT, Config
from folioflow.functions import text as T

_BLANK = T.S.replace(r"\s", r" \t\r\f")  # white space within a line
# What begins a block; abbreviations and references whose dot ends no sentence.
ITEM = rf"\n(?={_BLANK}*(?:\([a-z]\)|(?i:\({T.ROMAN}\))|(?i:{T.ROMAN}\.)|[-–—•*]){_BLANK}+)"
SENTENCE = rf"(?<=[.?!]){T.S}+(?=[A-Z\"'(])"
FALSE_END = (
    r"(?:\b(?i:sec|section|sub-sec|sub-section|rule|sub-rule|clause|sub-clause|no|f\.no|circ|circular|notif|notification|"
    r"rs|dr|mr|mrs|ms|ca|cma|adv|e\.g|i\.e|viz|etc|al|w\.e\.f|r\.w|u/s|dt|dtd|dated|form|gstr|gstin|udin)"
    r"|\d|vs|v|fig|ref|\b(?i:Section)\s+\d+(?:\(\w+\))*)\.$"
)
PROVISO = r"(?i)\bProvided\s+(?:further\s+|also\s+)?that\b"

NONE = "array<string>"


def blocks(body: Column) -> Column:
    """The body's list items, and what stands before the first, as trimmed texts."""
    unix = F.regexp_replace(body, T.LINE_ENDS, "\n")
    return F.filter(F.transform(F.split(unix, ITEM, -1), T.strip), lambda b: b != "")


def no_end(sentence: Column) -> Column:
    """Whether the sentence so far ends in an abbreviation, number or reference, or an open proviso."""
    dot = sentence.endswith(".")
    return F.when(dot, sentence.rlike(FALSE_END)).otherwise(sentence.rlike(PROVISO))


def sentences(text: Column) -> Column:
    """Sentences of a text; pieces cut at a false end are glued with one blank."""
    pieces = F.filter(F.transform(F.split(text, SENTENCE, -1), T.strip), lambda p: p != "")
    start = F.struct(F.array().cast(NONE).alias("done"), F.lit("").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        glued = F.when(acc["open"] == "", piece).otherwise(F.concat(acc["open"], F.lit(" "), piece))
        stays = (acc["open"] == "") | no_end(acc["open"])
        return F.struct(
            F.when(stays, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(stays, glued).otherwise(piece).alias("open"),
        )

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def _total(units: Column) -> Column:
    return F.aggregate(units, F.lit(0), lambda n, u: n + T.token_count(u))


def packed(units: Column, budget: Column) -> Column:
    """Units packed in order into groups of at most ``budget`` tokens (a larger unit is a group of its own)."""
    start = F.struct(F.array().cast(f"array<{NONE}>").alias("groups"), F.array().cast(NONE).alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, unit: Column) -> Column:
        n = T.token_count(unit)
        fits = (F.size(acc["open"]) == 0) | (acc["n"] + n <= budget)
        return F.struct(
            F.when(fits, acc["groups"]).otherwise(F.concat(acc["groups"], F.array(acc["open"]))).alias("groups"),
            F.when(fits, F.concat(acc["open"], F.array(unit))).otherwise(F.array(unit)).alias("open"),
            F.when(fits, acc["n"] + n).otherwise(n).alias("n"),
        )

    finish = lambda acc: F.when(F.size(acc["open"]) == 0, acc["groups"]).otherwise(F.concat(acc["groups"], F.array(acc["open"])))
    return F.aggregate(units, start, step, finish)


def rebalanced(groups: Column, head_tokens: Column, config: Config) -> Column:
    """A last group that would be a small chunk takes one unit from the group before it, if that has more than one."""
    last, before = F.try_element_at(groups, F.lit(-1)), F.try_element_at(groups, F.lit(-2))
    moved = F.try_element_at(before, F.lit(-1))
    size = _total(last) + head_tokens
    can = (F.size(groups) >= 2) & (size < config.min_chunk_tokens) & (F.size(before) > 1) & (size + T.token_count(moved) <= config.max_chunk_tokens)
    changed = F.concat(
        F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 2, F.lit(0))),
        F.array(F.slice(before, F.lit(1), F.greatest(F.size(before) - 1, F.lit(0)))),
        F.array(F.concat(F.array(moved), last)),
    )
    return F.when(F.coalesce(can, F.lit(False)), changed).otherwise(groups)


def split_oversized(chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Chunks with those above the limit replaced by children ``path[k]``; tables and texts of one unit stay whole.

    A narrow operation: no shuffle. token_count is trusted (it is the count of the text). Null texts stay.
    """
    big = ~F.col("chunk_type").startswith("table") & (F.col("token_count") > config.max_chunk_tokens)
    head = F.concat(F.col("section_path"), F.lit("[1]"))
    work = chunks.withColumn("_head", T.token_count(T.header(F.col("circular_number"), head, F.col("section_title"))))
    work = work.withColumn("_budget", F.greatest(F.lit(config.min_body_budget), F.lit(config.max_chunk_tokens) - F.col("_head")))
    work = work.withColumn("_blocks", F.when(big, blocks(T.body(F.col("text")))))
    parts = F.flatten(F.transform("_blocks", lambda b: F.when(T.token_count(b) > F.col("_budget"), sentences(b)).otherwise(F.array(b))))
    work = work.withColumn("_units", F.when(F.size("_blocks") > 1, parts).when(big, sentences(T.body(F.col("text")))))
    work = work.withColumn("_groups", F.when(F.size("_units") > 1, packed(F.col("_units"), F.col("_budget"))))
    groups = rebalanced(F.col("_groups"), F.col("_head"), config)
    work = work.withColumn("_bodies", F.transform(groups, lambda g: T.strip(F.array_join(g, "\n"))))
    work = work.select("*", T.rows_of(F.col("_bodies"), "_k", "_body"))
    child, k = F.col("_body").isNotNull(), F.col("_k") + 1
    path = F.when(child, F.concat(F.col("section_path"), F.lit("["), k.cast("string"), F.lit("]"))).otherwise(F.col("section_path"))
    text = F.when(child, F.concat(T.header(F.col("circular_number"), path, F.col("section_title")), F.lit("\n"), F.col("_body"))).otherwise(F.col("text"))
    new = {
        "chunk_id": F.when(child, T.chunk_id(F.col("doc_id"), path, k)).otherwise(F.col("chunk_id")),
        "section_path": path,
        "text": text,
        "token_count": F.when(child, T.token_count(text)).otherwise(F.col("token_count")),
    }
    return work.select(*(new[c].alias(c) if c in new else F.col(c) for c in chunks.columns))
