"""SQL for DuckDB for the splitting of oversized chunks: units by marked separators, sentences and packing by recursions.

RE2 has no look-around: separators are marked by a control character in a replacement that keeps what surrounds them.
"""

from __future__ import annotations

from folioflow.operators import splitting as P
from folioflow.plans.chunk_oracles import MERGED_CHUNKS
from folioflow.plans.oracles import NL, UNIX, count_words, q, strip

MARK = "chr(1)"
_item = P.ITEM.replace("(?=", "(", 1)
_sentence = P.SENTENCE.replace("(?<=[.?!])", "([.?!])").replace(r"(?=[A-Z\"'(])", r"([A-Z\"'(])")


def _pieces(text: str, pattern: str, replacement: str) -> str:
    cut = f"string_split(regexp_replace({text}, {q(pattern)}, {replacement}, 'g'), {MARK})"
    return f"list_filter(list_transform({cut}, lambda x: {strip('x')}), lambda x: x <> '')"


_blocks = _pieces(UNIX("body"), _item, f"{MARK} || '\\1'")
_sentences = _pieces("block", _sentence, f"'\\1' || {MARK} || '\\2'")
_false_end = f"CASE WHEN ends_with(a.text, '.') THEN regexp_matches(a.text, {q(P.FALSE_END)}) ELSE regexp_matches(a.text, {q(P.PROVISO)}) END"
_first = f"string_split(text, {NL})[1]"
_body = strip(f"CASE WHEN contains(text, {NL}) AND starts_with({_first}, '[') AND contains({_first}, ' | ') AND ends_with({_first}, ']') THEN substr(text, length({_first}) + 2) ELSE text END")
_clean = "regexp_replace({0}, '[^a-zA-Z0-9_.]', '_', 'g')"


def split_sql(given: str, columns: list[str]) -> str:
    """SQL after ``WITH RECURSIVE`` for the chunks of the CTE ``given`` with those above the limit replaced by children."""
    child = {
        "chunk_id": f"doc_id || '__' || {_clean.format('path')} || '__' || lpad(CAST(k AS VARCHAR), 4, '0')",
        "section_path": "path",
        "text": f"'[' || circular_number || ' | ' || path || ' | ' || section_title || ']' || {NL} || body",
        "token_count": "CAST(" + count_words(f"'[' || circular_number || ' | ' || path || ' | ' || section_title || ']' || {NL} || body") + " AS INT)",
    }
    own = ", ".join(f"{child[c]} AS {c}" if c in child else c for c in columns)
    return f"""
x_big AS (SELECT row_number() OVER (ORDER BY chunk_id, text) AS id, *, {_body} AS body,
  {count_words("'[' || circular_number || ' | ' || section_path || '[1] | ' || section_title || ']'")} AS head FROM {given} WHERE NOT starts_with(chunk_type, 'table') AND token_count > 1000),
x_cut AS (SELECT id, greatest(100, 1000 - head) AS budget, {_blocks} AS blocks, body FROM x_big),
x_blocks AS (SELECT id, budget, len(blocks) AS n, unnest(CASE WHEN len(blocks) > 1 THEN range(len(blocks)) ELSE [0] END) AS b,
  unnest(CASE WHEN len(blocks) > 1 THEN blocks ELSE [body] END) AS block FROM x_cut),
x_pieces AS (SELECT id, budget, b, CASE WHEN n = 1 OR {count_words('block')} > budget THEN {_sentences} ELSE [block] END AS p FROM x_blocks),
x_numbered AS (SELECT id, budget, b, unnest(range(len(p))) AS i, unnest(p) AS text FROM x_pieces),
x_glue AS (SELECT id, budget, b, i, text, 0 AS s FROM x_numbered WHERE i = 0
  UNION ALL SELECT n.id, n.budget, n.b, n.i, CASE WHEN {_false_end} THEN a.text || ' ' || n.text ELSE n.text END, CASE WHEN {_false_end} THEN a.s ELSE a.s + 1 END
  FROM x_glue a JOIN x_numbered n ON n.id = a.id AND n.b = a.b AND n.i = a.i + 1),
x_units AS (SELECT id, budget, text, {count_words('text')} AS n, row_number() OVER (PARTITION BY id ORDER BY b, s) AS u FROM
  (SELECT * FROM x_glue QUALIFY row_number() OVER (PARTITION BY id, b, s ORDER BY i DESC) = 1)),
x_fill AS (SELECT id, budget, u, n, n AS total, 1 AS g FROM x_units WHERE u = 1
  UNION ALL SELECT x.id, x.budget, x.u, x.n, CASE WHEN a.total + x.n <= x.budget THEN a.total + x.n ELSE x.n END, CASE WHEN a.total + x.n <= x.budget THEN a.g ELSE a.g + 1 END
  FROM x_fill a JOIN x_units x ON x.id = a.id AND x.u = a.u + 1),
x_sizes AS (SELECT id, g, count(*) AS members, max(u) AS last_u, sum(n) AS total, max(g) OVER (PARTITION BY id) AS groups FROM x_fill GROUP BY id, g),
x_moved AS (SELECT l.id, p.last_u AS u FROM x_sizes l JOIN x_sizes p ON p.id = l.id AND p.g = l.g - 1 JOIN x_big ON x_big.id = l.id JOIN x_units m ON m.id = p.id AND m.u = p.last_u
  WHERE l.g = l.groups AND l.total + head < 30 AND p.members > 1 AND l.total + head + m.n <= 1000),
x_grouped AS (SELECT f.id, CASE WHEN f.u = m.u THEN f.g + 1 ELSE f.g END AS k, u.text, u.u FROM x_fill f JOIN x_units u USING (id, u) LEFT JOIN x_moved m ON m.id = f.id AND m.u = f.u),
x_bodies AS (SELECT id, k, {strip(f"string_agg(text, {NL} ORDER BY u)")} AS body FROM x_grouped WHERE id IN (SELECT id FROM x_units GROUP BY 1 HAVING count(*) > 1) GROUP BY 1, 2),
x_children AS (SELECT x_big.* EXCLUDE (body), x_bodies.k, x_bodies.body, section_path || '[' || k || ']' AS path FROM x_big JOIN x_bodies USING (id))
SELECT {own} FROM x_children
UNION ALL SELECT {', '.join(columns)} FROM {given} WHERE starts_with(chunk_type, 'table') OR token_count <= 1000
UNION ALL SELECT {', '.join(columns)} FROM x_big WHERE id NOT IN (SELECT id FROM x_bodies)"""


_merged_with, _, _merged_select = MERGED_CHUNKS.rpartition("SELECT doc_id || '__'")
_columns = (
    "chunk_id doc_id source_filename page_start page_end section_path parent_section section_title text token_count chunk_type parsing_method circular_number date_issued"
).split()
DOCUMENT_CHUNKS = f"{_merged_with}, merged AS (SELECT doc_id || '__'{_merged_select}), {split_sql('merged', _columns)}"

_filled = ", ".join(f"coalesce({c}, '') AS {c}" for c in ("section_path", "section_title", "circular_number", "chunk_type"))
SPLIT_CHUNKS = f"""WITH RECURSIVE once AS (SELECT DISTINCT ON (chunk_id) * EXCLUDE (metadata, created_at, loaded_at, token_count, section_path, section_title, circular_number, chunk_type),
  {_filled}, CAST({count_words('text')} AS INT) AS token_count FROM chunks ORDER BY chunk_id, loaded_at DESC), {split_sql('once', _columns)}
UNION ALL SELECT {', '.join(_columns)} FROM once WHERE token_count IS NULL AND NOT starts_with(chunk_type, 'table')"""
