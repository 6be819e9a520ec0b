"""String functions as Columns: cleaning of page text, tokens, headers, ids, paths. Null in gives null out.

Patterns avoid look-around and use explicit classes, so that the same pattern text means the same in other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, as the inside of a character class.
WS = r"\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
S, NS = f"[{WS}]", f"[^{WS}]"
#: The same characters one by one.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A run of anything else: the complement of WS, by ranges, the most frequent first (much faster to match than NS).
WORD = (
    r"[!-~\x{A1}-\x{167F}\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}"
    r"\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}]+"
)

# Typographic marks and their plain forms.
MARKS, PLAIN = "“”‘’–—", "\"\"''--"
# A line that is only a page number; running headers of continuation pages.
PAGE_NUMBER = rf"(?im)^{S}*(?:page{S}*-?{S}*\p{{Nd}}+{S}*(?:of{S}*\p{{Nd}}+)?|-?{S}*\p{{Nd}}+{S}*-?){S}*$"
RUNNING_HEADERS = [
    rf"Circular{S}+No\.?{S}*\p{{Nd}}+{S}*(?:/{S}*\p{{Nd}}+{S}*)*{S}*-{S}*GST",
    rf"Government{S}+of{S}+India",
    rf"Ministry{S}+of{S}+Finance",
    rf"Department{S}+of{S}+Revenue",
    rf"Central{S}+Board{S}+of{S}+Indirect{S}+Taxes{S}+(?:and|&){S}+Customs",
    rf"GST{S}+Policy{S}+Wing",
]
#: One search token: letters and digits, then /parts, then -parts, then (parts).
TOKEN = r"[a-z0-9]+(?:/[a-z0-9]+)*(?:-[a-z0-9]+)*(?:\([a-z0-9]+\))*"
LINE_ENDS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def rows_of(array: Column, *names: str) -> Column:
    """The elements of an array as rows with their places, for a select; drop the row of nulls that an empty array gives.

    The outer form: the plain one makes the optimizer test the array's size in a filter, which computes it twice.
    """
    return F.posexplode_outer(array).alias(*names)


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends. (A trim looks at the ends only, a pattern at every character.)"""
    return F.btrim(text, F.lit(BLANKS))


def _unix(pattern: str) -> str:
    """Multi-line patterns take only LF as a line end."""
    return pattern.replace("(?im)", "(?imd)")


def plain_marks(text: Column) -> Column:
    """Typographic quotes and dashes in their plain forms."""
    return F.translate(text, MARKS, PLAIN)


def lines(text: Column) -> Column:
    """The lines of a text, whatever characters end them."""
    return F.split(F.regexp_replace(text, LINE_ENDS, "\n"), "\n", -1)


def clean_line(line: Column) -> Column:
    """Indentation kept (a tab as two blanks), runs of blanks inside as one, nothing at the end; a blank line is empty."""
    content = F.regexp_replace(F.regexp_replace(line, r"^[ \t]+", ""), rf"{S}+$", "")
    indent = F.replace(F.regexp_extract(line, r"^([ \t]*)", 1), F.lit("\t"), F.lit("  "))
    return F.when(content == "", F.lit("")).otherwise(F.concat(indent, F.regexp_replace(content, r"[ \t]+", " ")))


def without_running_headers(text: Column) -> Column:
    for header in RUNNING_HEADERS:
        text = F.regexp_replace(text, _unix(rf"(?im)^{S}*{header}{S}*$"), "")
    return text


def clean_page(raw: Column, page_number: Column) -> Column:
    """Cleaned text of a page: plain marks, no page numbers, no running headers after page 1, tidy lines, trimmed."""
    text = F.regexp_replace(plain_marks(raw), _unix(PAGE_NUMBER), "")
    text = F.when(page_number == 1, text).otherwise(without_running_headers(text))
    text = F.array_join(F.transform(lines(text), clean_line), "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def token_count(text: Column) -> Column:
    """Number of runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(WORD))


def tokens(text: Column) -> Column:
    """Search tokens in order; a composite token is followed by its parts."""
    whole = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    parts = lambda t: F.filter(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), lambda p: p != t)
    composite = lambda t: t.contains("-") | t.contains("/") | t.contains("(")
    return F.flatten(F.transform(whole, lambda t: F.when(composite(t), F.concat(F.array(t), parts(t))).otherwise(F.array(t))))


def header(number: Column, path: Column, title: Column) -> Column:
    """The context line of a chunk."""
    return F.concat(F.lit("["), number, F.lit(" | "), path, F.lit(" | "), title, F.lit("]"))


def body(text: Column) -> Column:
    """The text without its context line, trimmed; a text without one is trimmed only."""
    first = F.substring_index(text, "\n", 1)
    has = text.contains("\n") & first.startswith("[") & first.contains(" | ") & first.endswith("]")
    return strip(F.when(has, F.substr(text, F.length(first) + 2)).otherwise(text))


def chunk_id(doc_id: Column, path: Column, sequence: Column) -> Column:
    """``doc__path__0001``, with ``_`` for what is not a letter, digit, dot or underscore in the path."""
    return F.concat(doc_id, F.lit("__"), F.regexp_replace(path, "[^a-zA-Z0-9_.]", "_"), F.lit("__"), F.format_string("%04d", sequence))


def parent_path(path: Column) -> Column:
    """All before the last dot; empty where there is none."""
    return F.regexp_extract(path, r"(?s)^(.*)[.][^.]*$", 1)


def last_token(path: Column) -> Column:
    """What follows the last dot; all where there is none."""
    return F.substring_index(path, ".", -1)


# The numerals that count as roman.
ROMAN = "(?:i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)"


def is_roman(token: Column) -> Column:
    return strip(token).rlike(rf"(?i)^(?:\({ROMAN}\)|{ROMAN}\.|{ROMAN})$")


def is_clause(token: Column) -> Column:
    return strip(token).rlike(r"(?i)^\([a-z]\)$") & ~is_roman(token)


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("page "), start.cast("string"))).otherwise(
        F.concat(F.lit("pages "), start.cast("string"), F.lit("-"), end.cast("string"))
    )
