"""Problem 3: text that looks the same in different characters, by grouping under an accent-sensitive collation in SQL.

Characters that look alike are mapped to one form with ``translate``, after composed look-alikes and composed signs are
taken apart, so that the stored composition does not matter: full-width forms, blanks of other widths, hyphens,
letters of other scripts; characters that do not show are dropped. The mapped values are compared under the collation
``UNICODE`` (case- and accent-sensitive), under which composed and decomposed accents are equal. Each class takes as its
canonical member the smallest stored text, by code point, and every page gets it by a join.

Scale: the texts themselves are grouped only where a partner can exist. Texts that are equal under the collation have
the same digits and ASCII signs in the same order; a 64-bit hash of these is grouped first (with map-side aggregation),
and texts whose hash is alone are their own class without a shuffle of their text.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.plans.lineage import cut, small

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ν": "v", "Ϲ": "C", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Ԛ": "Q", "Ԝ": "W", "ᴏ": "o", "ı": "i", "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "ց": "g", "հ": "h",
}
# Blanks that print as one blank, hyphens that print as "-", characters that do not print.
BLANKS = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011, 0xFE63]
UNSEEN = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}
#: Composed characters whose base is a look-alike or an ASCII sign, with their decompositions; all lie in COMPOSED_RANGES.
COMPOSED = {
    chr(c): apart for c in range(0x80, 0x2300)
    if (apart := unicodedata.normalize("NFD", chr(c))) != chr(c) and (apart[0] in LOOKALIKES or "!" <= apart[0] <= "~" and not apart[0].isalpha())
}
#: Few ranges are tried on every text: a class of all the single characters costs Java a test of each one for each letter.
COMPOSED_RANGES = "[\u037e-\u045e\u04d0-\u04f3\u1f08-\u1fff\u2260-\u226f]"



def _mapping() -> tuple[str, str]:
    """The characters to replace and their replacements; characters without one (at the end) are dropped."""
    pairs = dict(LOOKALIKES)
    pairs |= {chr(c): " " for c in BLANKS} | {chr(c): "-" for c in HYPHENS}
    pairs |= {chr(0xFF00 + c - 0x20): chr(c) for c in range(0x21, 0x7F)}  # full-width forms of ASCII
    return "".join(pairs) + "".join(map(chr, UNSEEN)), "".join(pairs.values())


def mapped(text: Column) -> Column:
    """The text with look-alike characters in one form, as a plain string; null stays null."""
    pairs = F.array(*(F.struct(F.lit(one).alias("one"), F.lit(apart).alias("apart")) for one, apart in COMPOSED.items()))
    apart = F.aggregate(pairs, text, lambda x, pair: F.replace(x, pair["one"], pair["apart"]))
    text = F.when(text.rlike(COMPOSED_RANGES) & text.rlike(f"[{''.join(COMPOSED)}]"), apart).otherwise(text)
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return F.translate(text, *_mapping())


def same_look(text: Column) -> Column:
    """The mapped text under the collation in which texts that look the same are equal."""
    return F.collate(mapped(text), "UNICODE")


def _blocking_key(look: Column) -> Column:
    """A hash that mapped texts equal under the collation share: of their ASCII digits and signs, in order; null for a blank text."""
    return F.when(look.rlike("[^\\s\\p{Z}]"), F.xxhash64(F.regexp_replace(look, "[^0-9!-/:-@\\[-`{-~]+", "")))


def classes(pages: DataFrame) -> DataFrame:
    """page_id, class_id, raw_text, canonical: every page that is not blank and can have a partner, with its class.

    The class is named by its smallest page_id; canonical is its smallest stored text. A page delivered again counts once.
    Texts are mapped once for the keys, and again only where a key is shared.
    """
    given = pages.where("page_id is not null and raw_text is not null").select("page_id", "raw_text")
    keyed = cut(given.select("page_id", mapped(F.col("raw_text")).alias("look")).select("page_id", _blocking_key(F.col("look")).alias("key"))).where("key is not null")
    shared = cut(
        keyed.groupBy("key").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).where("low <> high").select("key")
    )
    wanted = cut(keyed.join(small(shared), "key", "left_semi").select("page_id").distinct())
    once = cut(given.join(small(wanted), "page_id", "left_semi").groupBy("page_id").agg(F.min("raw_text").alias("raw_text")))
    looks = once.withColumn("look", same_look(F.col("raw_text")))
    named = looks.groupBy("look").agg(F.min("page_id").alias("class_id"), F.max("page_id").alias("last"), F.min("raw_text").alias("canonical"))
    named = named.where("class_id <> last").drop("last")
    return looks.join(named, "look").select("page_id", "class_id", "raw_text", "canonical")


def found(pages: DataFrame) -> DataFrame:
    """p3_found: pairs of pages whose raw_text is stored differently but looks the same, smaller page_id first."""
    known = cut(classes(pages).select("page_id", "class_id", F.sha2("raw_text", 256).alias("stored")))
    mixed = known.groupBy("class_id").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low <> high").select("class_id")
    members = known.join(mixed, "class_id", "left_semi")
    a = members.select("class_id", F.col("page_id").alias("page_id_a"), F.col("stored").alias("stored_a"))
    b = members.select("class_id", F.col("page_id").alias("page_id_b"), F.col("stored").alias("stored_b"))
    return a.join(b, "class_id").where("page_id_a < page_id_b and stored_a <> stored_b").select("page_id_a", "page_id_b")


def consistent(pages: DataFrame) -> DataFrame:
    """p3_consistent: page_id, class_id and text of every page: the canonical member of its class, else its own mapped text.

    Null and blank pages keep their text and are their own class. A page delivered again counts once.
    """
    canonical = classes(pages).select("page_id", "class_id", "canonical")
    once = pages.where("page_id is not null").groupBy("page_id").agg(F.min("raw_text").alias("raw_text"))
    text = F.coalesce(mapped(F.col("canonical")), mapped(F.col("raw_text")))
    return once.join(canonical, "page_id", "left").select("page_id", F.coalesce("class_id", "page_id").alias("class_id"), text.alias("text"))
