"""SQL for DuckDB for the chunker's folds: section paths and merging, as recursions over a document's rows."""

from __future__ import annotations

from folioflow.functions import text as T
from folioflow.plans.oracles import METADATA, NL, STATES, S, count_words, q, strip

_roman = q(rf"(?i)^(?:\({T.ROMAN}\)|{T.ROMAN}\.|{T.ROMAN})$")
_up = lambda p: f"regexp_extract({p}, '(?s)^(.*)[.][^.]*$', 1)"
_last = lambda p: f"regexp_extract({p}, '([^.]*)$', 1)"
_is_roman = lambda t: f"regexp_matches({strip(t)}, {_roman})"
_no_roman = lambda p: f"CASE WHEN {_is_roman(_last(p))} THEN {_up(p)} ELSE {p} END"
_no_clause = lambda p: f"CASE WHEN regexp_matches({strip(_last(p))}, '(?i)^\\([a-z]\\)$') AND NOT {_is_roman(_last(p))} THEN {_up(p)} ELSE {p} END"

GROUPS = f"""{STATES},
body_rows AS (SELECT *, kind IS NULL AND NOT is_table AS is_body, coalesce(kind IN ('top_level', 'decimal', 'clause', 'roman'), false) AS sets_path FROM states),
opening AS (SELECT *, is_body AND sum(CASE WHEN is_body OR sets_path THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY page_number, line_no ROWS UNBOUNDED PRECEDING) = 1 AS opens FROM body_rows),
typed AS (SELECT *, CASE WHEN opens THEN CASE WHEN page_number = 1 THEN 'preamble' ELSE 'paragraph' END
  ELSE CASE kind WHEN 'top_level' THEN 'paragraph' WHEN 'decimal' THEN 'subparagraph' WHEN 'clause' THEN 'clause' WHEN 'roman' THEN 'roman_item' WHEN 'bullet' THEN 'bullet' END END AS own FROM opening),
placed AS (SELECT *, coalesce(last_value(CASE WHEN own IS NOT NULL THEN page_number END IGNORE NULLS) OVER w, 1) AS start,
  coalesce(last_value(own IGNORE NULLS) OVER w, 'paragraph') AS type FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, line_no ROWS UNBOUNDED PRECEDING)),
joined AS (SELECT doc_id, grp, bool_or(is_table) AS is_table, max(title) AS title, string_agg(line, {NL} ORDER BY page_number, line_no) AS text,
  max(page_number) AS page_end, arg_max(start, page_number * 1000000 + line_no) AS start, arg_max(type, page_number * 1000000 + line_no) AS type,
  max(CASE WHEN opens THEN CASE WHEN page_number = 1 THEN 'preamble' ELSE '1' END WHEN sets_path THEN marker END) AS marker,
  max(CASE WHEN opens THEN 'decimal' WHEN sets_path THEN kind END) AS kind FROM placed WHERE kind IS NULL OR kind <> 'heading' GROUP BY 1, 2),
groups AS (SELECT doc_id, is_table, title, CASE WHEN is_table THEN text ELSE {strip('text')} END AS body, CASE WHEN is_table THEN page_end ELSE start END AS page_start, page_end,
  CASE WHEN NOT is_table THEN type WHEN contains(lower(text), 'whether') OR starts_with(lower(text), 'q') OR contains(lower(text), ' if ') THEN 'table_qa' ELSE 'table_raw' END AS type,
  kind, marker, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS i FROM joined),
steps AS (SELECT doc_id, 1 AS i, coalesce(marker, '') AS path FROM groups WHERE i = 1
  UNION ALL SELECT g.doc_id, s.i + 1, CASE WHEN g.kind IN ('top_level', 'decimal') THEN g.marker
    WHEN g.kind = 'clause' THEN CASE WHEN {_no_clause('nr')} = '' THEN g.marker ELSE {_no_clause('nr')} || '.' || g.marker END
    WHEN g.kind = 'roman' THEN CASE WHEN nr = '' THEN g.marker ELSE nr || '.' || g.marker END ELSE s.path END
  FROM (SELECT *, {_no_roman('path')} AS nr FROM steps) s JOIN groups g ON g.doc_id = s.doc_id AND g.i = s.i + 1),
worded AS (SELECT g.*, s.path, list_filter(regexp_split_to_array(body, {q(S + '+')}), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')) AS words FROM groups g JOIN steps s USING (doc_id, i)),
kept AS (SELECT * FROM worded WHERE is_table OR (len(words) > 0 AND NOT (len(words) = 1 AND (regexp_matches(words[1], '^\\p{{Nd}}+\\.*$')
  OR regexp_matches(words[1], {_roman}) OR regexp_matches(words[1], '(?i)^\\([a-z]\\)$'))))),
meta AS ({METADATA.replace('parsed_documents', '(SELECT DISTINCT doc_id FROM pages WHERE doc_id IS NOT NULL)')}),
parts AS (SELECT k.doc_id, row_number() OVER (PARTITION BY k.doc_id ORDER BY i) AS seq,
  CASE WHEN path <> '' THEN path WHEN is_table THEN 'p.' || page_start ELSE '1' END AS path, title, type, page_start, page_end, body FROM kept k)"""

_header = "'[' || circular_number || ' | ' || path || ' | ' || title || ']'"


def _as_chunks(parts: str) -> str:
    return f"""SELECT doc_id || '__' || regexp_replace(path, '[^a-zA-Z0-9_.]', '_', 'g') || '__' || lpad(CAST(seq AS VARCHAR), 4, '0') AS chunk_id, doc_id, source_filename,
  page_start, page_end, path AS section_path, {_up('path')} AS parent_section, title AS section_title, {_header} || {NL} || body AS text,
  CAST({count_words(_header + ' || ' + NL + ' || body')} AS INT) AS token_count, type AS chunk_type, 'structural' AS parsing_method, circular_number, date_issued
  FROM {parts} JOIN meta USING (doc_id)"""


RAW_CHUNKS = f"WITH RECURSIVE {GROUPS} {_as_chunks('parts')}"


def _pass(name: str, source: str, small: str, target: str) -> str:
    """One fold: ``small`` is the side that must be small, ``target`` the side that keeps its identity (a: so far, b: next)."""
    related = f"""NOT starts_with(a.type, 'table') AND NOT starts_with(b.type, 'table') AND (a.path = b.path
      OR (a.type = 'preamble' AND b.type = 'preamble') OR ({_up('a.path')} <> '' AND ({_up('a.path')} = b.path OR {_up('a.path')} = {_up('b.path')}))
      OR ({_up('b.path')} <> '' AND {_up('b.path')} = a.path) OR starts_with(b.path, a.path || '.') OR starts_with(a.path, b.path || '.'))"""
    can = f"{small}.head + {small}.words < 30 AND {target}.head + a.words + b.words <= 1000 AND {related}"
    pick = lambda c: f"CASE WHEN {can} THEN {target}.{c} ELSE b.{c} END"
    body = f"CASE WHEN a.body = '' THEN b.body WHEN b.body = '' THEN a.body ELSE a.body || {NL} || b.body END"
    return f"""{name}_steps AS (SELECT doc_id, seq AS i, 1 AS part, path, title, type, page_start, page_end, body, head, words FROM {source} WHERE seq = 1
  UNION ALL SELECT b.doc_id, b.seq, CASE WHEN {can} THEN a.part ELSE a.part + 1 END, {pick('path')}, {pick('title')}, {pick('type')},
    CASE WHEN {can} THEN least(a.page_start, b.page_start) ELSE b.page_start END, CASE WHEN {can} THEN greatest(a.page_end, b.page_end) ELSE b.page_end END,
    CASE WHEN {can} THEN {body} ELSE b.body END, {pick('head')}, CASE WHEN {can} THEN a.words + b.words ELSE b.words END
  FROM {name}_steps a JOIN {source} b ON a.doc_id = b.doc_id AND b.seq = a.i + 1),
{name} AS (SELECT doc_id, part AS seq, path, title, type, page_start, page_end, body, head, words FROM {name}_steps QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY i DESC) = 1)"""


MERGED_CHUNKS = f"""WITH RECURSIVE {GROUPS},
sized AS (SELECT p.*, len(regexp_extract_all({_header}, {q(T.NS + '+')})) AS head, {count_words('body')} AS words FROM parts p JOIN meta USING (doc_id)),
{_pass('up', 'sized', 'b', 'a')}, {_pass('down', 'up', 'a', 'b')} {_as_chunks('down')}"""
