"""Problem 5: splitting oversized items at natural boundaries, by a recursive hierarchy of separators.

An item above the limit is cut by section, paragraph, sentence, word and, where one word alone is above the limit in
characters, by character. Pieces are packed greedily up to the limit; each starts with the last tokens of the one before.

Scale: only texts long enough to exceed the limit leave the JVM (a text of n tokens has at least 2n - 1 characters, an
exact condition); every item is cut on its own in an Arrow batch, without a shuffle but the removal of repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 1000
OVERLAP = 40
#: A token longer than this many characters is cut by character, so that a piece is bounded in characters too.
TOKEN_CHARS = 2000
TOKEN = re.compile(r"[^ \t\r\n]+")
HEADER = re.compile(r"\[[^\n]* \| [^\n]* \| [^\n]*\][ \t\r]*(?:\n|$)")
#: Separators from the strongest: before a numbered or lettered section, blank line, line, sentence, clause.
SEPARATORS = [
    re.compile(r"\n(?=[ \t]*(?:\d{1,2}(?:\.\d{1,2})*\.?|\([a-z]{1,4}\)|[-*•])[ \t])"),
    re.compile(r"\n[ \t\r]*\n"),
    re.compile(r"\n"),
    re.compile(r"(?<=[.?!।])[\"'”)]?[ \t]+(?=[A-Z(\"'“ऀ-ॿÀ-Þ])"),
    re.compile(r"(?<=[;:,])[ \t]+"),
]


def token_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, CR and LF; null stays null."""
    return F.regexp_count(text, F.lit("[^ \\t\\r\\n]+"))


def _units(text: str, start: int, end: int, tokens: list[tuple[int, int]], room: int, level: int) -> Iterator[tuple[int, int]]:
    """Ranges of token indexes, none above ``room``, cut at the strongest separators that suffice."""
    if end - start <= room:
        yield start, end
        return
    if level == len(SEPARATORS):
        for at in range(start, end, room):  # by word
            yield at, min(end, at + room)
        return
    begin, last = start, tokens[end - 1][1]
    token = start
    for match in SEPARATORS[level].finditer(text, tokens[start][0], last):
        while token < end and tokens[token][0] < match.end():
            token += 1
        if begin < token < end:
            yield from _units(text, begin, token, tokens, room, level + 1)
            begin = token
    yield from _units(text, begin, end, tokens, room, level + 1)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(piece, tokens, tokens shared with the piece before) of one text; a text within the limit is one piece.

    A header line is kept on every piece and counts. Consecutive bodies share exactly ``overlap`` tokens (fewer only if
    the header leaves less than twice that). Pieces are substrings of the body, so white space inside them is kept; the
    union of the bodies is the body without the white space at its ends.
    """
    if len(TOKEN.findall(text)) <= limit:
        return [(text, len(TOKEN.findall(text)), 0)]
    head = match.group() if (match := HEADER.match(text)) else ""
    n_head = len(TOKEN.findall(head))
    if n_head > limit // 2:  # not a header that can be repeated
        head, n_head = "", 0
    body = text[len(head) :]
    tokens = [(a, min(a + TOKEN_CHARS, m.end())) for m in TOKEN.finditer(body) for a in range(m.start(), m.end(), TOKEN_CHARS)]
    shared = min(overlap, (limit - n_head) // 2)
    room = limit - n_head - shared
    cuts, size = [0], 0
    for a, b in _units(body, 0, len(tokens), tokens, room, 0):
        if size and size + b - a > (room if len(cuts) > 1 else room + shared):
            cuts.append(a)
            size = 0
        size += b - a
    cuts.append(len(tokens))
    pieces = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        first = max(0, a - shared) if k else a
        joint = head if not head or head.endswith("\n") else head + "\n"
        piece = joint + body[tokens[first][0] : tokens[b - 1][1]]
        pieces.append((piece, len(TOKEN.findall(piece)), a - first))
    return pieces


def _split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["chunk_id", "piece_no", "n_pieces", "section_path", "text", "token_count", "shared_tokens"]
    types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
    for batch in rows:
        out = []
        for key, path, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            parts = split_text(text)
            out += [(key, k, len(parts), f"{path}[{k}]", piece, n, shared) for k, (piece, n, shared) in enumerate(parts, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)


def pieces(chunks: DataFrame) -> DataFrame:
    """chunk_id, piece_no, n_pieces, section_path, text, token_count, shared_tokens of each oversized item.

    Oversized: the full text has more than LIMIT tokens, whatever the stored count says, and the type is not a table's (a
    null type is not). section_path gets ``[piece_no]``; a null path counts as empty. Of repeated deliveries of a chunk the
    last counts. Null and short texts have no pieces; other columns are ignored.
    """
    long = chunks.where((F.length("text") > 2 * LIMIT) & ~F.coalesce(F.col("chunk_type").startswith("table"), F.lit(False)) & F.col("chunk_id").isNotNull())
    long = long.where(token_count(F.col("text")) > LIMIT).select("chunk_id", "text", "section_path", "loaded_at")
    latest = Window.partitionBy("chunk_id").orderBy(F.desc_nulls_last("loaded_at"), "text", "section_path")
    once = long.withColumn("r", F.row_number().over(latest)).where("r = 1")
    given = once.select("chunk_id", F.coalesce("section_path", F.lit("")).alias("section_path"), "text")
    schema = "chunk_id string, piece_no int, n_pieces int, section_path string, text string, token_count int, shared_tokens int"
    return given.mapInArrow(_split, schema)


def found(chunks: DataFrame) -> DataFrame:
    """p5_found: chunk_id of the items that were split."""
    return pieces(chunks).where("n_pieces > 1").select("chunk_id").distinct()
