"""Merging of small chunks into neighbours, as two folds over a document's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.config import DEFAULT, Config
from folioflow.functions import text as T


def compatible(a: Column, b: Column) -> Column:
    """Whether two parts of a document may be merged: no table, and the same, a related or a sibling section."""
    pa, pb = T.parent_path(a["path"]), T.parent_path(b["path"])
    return ~(a["type"].startswith("table") | b["type"].startswith("table")) & (
        (a["path"] == b["path"])
        | (a["type"].isin("preamble", "header") & b["type"].isin("preamble", "header"))
        | ((pa != "") & ((pa == b["path"]) | (pa == pb)))
        | ((pb != "") & (pb == a["path"]))
        | F.startswith(b["path"], F.concat(a["path"], F.lit(".")))
        | F.startswith(a["path"], F.concat(b["path"], F.lit(".")))
    )


def _size(part: Column) -> Column:
    return part["head_tokens"] + part["body_tokens"]


def _merged(target: Column, first: Column, second: Column) -> Column:
    """``target`` with the bodies of both, in order, and the pages of both."""
    body = F.when(first["body"] == "", second["body"]).when(second["body"] == "", first["body"]).otherwise(F.concat(first["body"], F.lit("\n"), second["body"]))
    return (
        target.withField("body", body)
        .withField("body_tokens", first["body_tokens"] + second["body_tokens"])
        .withField("page_start", F.least(first["page_start"], second["page_start"]))
        .withField("page_end", F.greatest(first["page_end"], second["page_end"]))
    )


def _fold(parts: Column, small_first: bool, config: Config) -> Column:
    """Replaces the last of the parts so far by its merger with the next one, or appends the next one."""

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        small = _size(last if small_first else part) < config.min_chunk_tokens
        fits = last["body_tokens"] + part["body_tokens"] + (part if small_first else last)["head_tokens"] <= config.max_chunk_tokens
        merged = _merged(part if small_first else last, last, part)
        can = (F.size(done) > 0) & small & fits & compatible(last, part)
        return F.when(can, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.slice(parts, 1, 0), step)


def merge_small(documents: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Documents with small parts merged: first each into the part before it, then what is left into the part after it.

    ``documents`` has doc_id, circular_number and parts; parts are numbered anew from 1.
    """
    measured = F.transform(
        "parts",
        lambda p: p.withField("head_tokens", T.token_count(T.header(F.col("circular_number"), p["path"], p["title"])))
        .withField("body_tokens", T.token_count(p["body"])),
    )
    out = documents.withColumn("parts", measured)
    out = out.withColumn("parts", _fold(F.col("parts"), False, config))
    out = out.withColumn("parts", _fold(F.col("parts"), True, config))
    return out.withColumn("parts", F.transform("parts", lambda p, i: p.dropFields("head_tokens", "body_tokens").withField("seq", i + 1)))
