"""Where sections begin: classification of a line, and how a boundary changes the section path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import NS, ROMAN, S, strip

D = r"\p{Nd}"
# The forms of markers. "Not followed by a digit" is written out, without look-around.
_REST = rf"(?:{S}+(?:[^\p{{Nd}}].*)?|{S}*)$"
_ANY_REST = rf"(?:{S}+.*|{S}*)$"
DECIMAL = rf"(?s)^{S}*({D}{{1,2}}(?:\.{D}{{1,2}})+)\.?{_REST}"
TOP_LEVEL = rf"(?s)^{S}*({D}{{1,2}})\.{_REST}"
ROMAN_PAREN = rf"(?is)^{S}*\(({ROMAN})\){_ANY_REST}"
CLAUSE = rf"(?s)^{S}*\(([a-z])\){_ANY_REST}"
BARE_ROMAN = rf"(?is)^{S}*({ROMAN})\.{_ANY_REST}"
BULLET = rf"(?s)^{S}*([-–—•*]){S}+.*$"
#: A numeral, and a letter that is none, as the last part of a section path.
END_ROMAN = rf"(?i)(?:^|[.]){S}*(?:\({ROMAN}\)|{ROMAN}){S}*$"
END_CLAUSE = rf"(?i)(?:^|[.]){S}*\([a-hj-uwyz]\){S}*$"
#: How any of these begin: one test that most lines fail.
POSSIBLE = rf"^{S}*[\p{{Nd}}(ivxIVX\-–—•*]"

# Openings of prose, statutes and letterheads that are never headings.
NO_HEADING_PREFIXES = [
    "provided that", "provided further that", "in terms of", "in order to", "in view of", "in accordance with",
    "in cases where", "in this regard", "in respect of", "as per", "as specified", "as clarified", "therefore",
    "accordingly", "however", "further", "furthermore", "it is", "it has", "it may", "instances have", "where ",
    "whether ", "which ", "when ", "what ", "the ", "this ", "these ", "such ", "various ", "subject:", "subject :",
    "government of india", "ministry of finance", "department of revenue", "central board", "gst policy wing",
    "circular no", "f. no", "f.no", "new delhi", "to,", "madam/sir", "sir/madam", "difficulty, if any", "hindi version",
    "schedule i", "schedule ii", "schedule iii", "section ", "rule ", "table ", "form ",
]
# Last words of a wrapped line.
WRAPPED_WORDS = (
    "the", "a", "an", "and", "or", "of", "in", "to", "for", "on", "at", "by", "as", "is", "are", "was", "were", "be", "been", "that",
    "which", "with", "from", "into", "under", "over", "only", "not", "no", "its", "their", "his", "her", "this", "these", "those", "any",
    "all", "each", "both", "than", "when", "where", "whether", "how", "may", "shall", "can", "will", "has", "have", "had", "also", "even",
    "such", "same", "other", "another", "so", "if", "else", "but", "sub-",
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
PREFIX_PATTERN = "^(?:" + "|".join(re.sub(r"([.])", r"[\1]", p) for p in NO_HEADING_PREFIXES) + ")"
TWO_NAMES = rf"^[A-Z][a-z]+ [A-Z][a-z]+({S}*\([^)]*\))?{S}*$"


def is_heading(stripped: Column) -> Column:
    """Whether a trimmed line is a heading: a short title line that is no sentence, letterhead, name or address."""
    tail = F.regexp_extract(F.regexp_replace(stripped, r"[.,;:)\-]+$", ""), rf"({NS}+){S}*$", 1)
    last_word = F.regexp_replace(F.lower(tail), r"[)\-,.]+$", "")
    return (  # the cheapest tests that most lines fail come first
        F.length(stripped).between(8, 120)
        & ~F.substring(stripped, -1, 1).isin(*".?!;,-")
        & stripped.rlike(r"^\p{Lu}")
        & ~stripped.rlike(rf"\. [A-Z]|[@/]|www\.|\(All\)|^(?:{MONTHS})")
        & ~F.lower(stripped).rlike(PREFIX_PATTERN)
        & (F.regexp_count(stripped, F.lit(rf"{NS}*\p{{L}}{NS}*")) >= 3)
        & ~stripped.rlike(TWO_NAMES)
        & ~last_word.isin(*WRAPPED_WORDS)
    )


def definite_kind(line: Column) -> Column:
    """The structural kind of a line that needs no context: decimal, top_level, roman, clause, bullet; else null."""
    marked = (
        F.when(line.rlike(DECIMAL), F.lit("decimal"))
        .when(line.rlike(TOP_LEVEL), F.lit("top_level"))
        .when(line.rlike(ROMAN_PAREN), F.lit("roman"))
        .when(line.rlike(CLAUSE), F.lit("clause"))
        .when(strip(line).rlike(rf"(?i)^{ROMAN}\.$"), F.lit("roman"))
        .when(line.rlike(BULLET), F.lit("bullet"))
    )
    return F.when(line.rlike(POSSIBLE), marked)


def boundary_kind(line: Column, in_enumeration: Column, definite: Column | None = None, stripped: Column | None = None) -> Column:
    """The kind of boundary: as :func:`definite_kind`; a numeral within a list; a heading; else null.

    ``definite`` and ``stripped`` (the line without white space at its ends) are used where they are known.
    """
    bare = in_enumeration & line.rlike(BARE_ROMAN)
    heading = is_heading(strip(line) if stripped is None else stripped)
    return F.coalesce(definite_kind(line) if definite is None else definite, F.when(bare, F.lit("roman")), F.when(heading, F.lit("heading")))


def boundary_marker(line: Column, kind: Column) -> Column:
    """The marker of a line of a known kind: number, ``(a)``, ``(i)`` or ``i.``, the bullet, or the heading's words."""
    paren = F.regexp_extract(line, ROMAN_PAREN, 1)
    roman = F.when(paren != "", F.concat(F.lit("("), F.lower(paren), F.lit(")"))).otherwise(F.concat(F.lower(F.regexp_extract(line, BARE_ROMAN, 1)), F.lit(".")))
    return (
        F.when(kind == "decimal", F.regexp_extract(line, DECIMAL, 1))
        .when(kind == "top_level", F.regexp_extract(line, TOP_LEVEL, 1))
        .when(kind == "roman", roman)
        .when(kind == "clause", F.concat(F.lit("("), F.regexp_extract(line, CLAUSE, 1), F.lit(")")))
        .when(kind == "bullet", F.regexp_extract(line, BULLET, 1))
        .when(kind == "heading", strip(F.regexp_replace(strip(line), ":+$", "")))
    )


def next_path(path: Column, kind: Column, marker: Column) -> Column:
    """The section path after a boundary; kinds that keep it (bullet, heading, null) return it unchanged."""
    join = lambda base: F.when(base == "", marker).otherwise(F.concat(base, F.lit("."), marker))
    no_roman = F.regexp_replace(path, END_ROMAN, "")
    return (
        F.when(kind.isin("top_level", "decimal", "start"), marker)
        .when(kind == "clause", join(F.regexp_replace(no_roman, END_CLAUSE, "")))
        .when(kind == "roman", join(no_roman))
        .otherwise(path)
    )
