"""SQL for DuckDB for the problems that SQL can express over whole tables, written on its own."""

from __future__ import annotations

from folioflow.llm.lookalike import BLANKS, COMPOSED, HYPHENS, LIGATURES, LOOKALIKES, UNSEEN


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_body = r"regexp_replace(text, '^\[[^\n]* \| [^\n]* \| [^\n]*\][ \t\r]*(?:\n|$)', '')"
P1 = f"""
WITH c AS (SELECT DISTINCT chunk_id, doc_id, text FROM chunks WHERE text IS NOT NULL),
w AS (SELECT chunk_id, doc_id, regexp_extract_all(lower({_body}), '[a-z0-9]+') AS w FROM c),
s AS (SELECT chunk_id, doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
e AS (SELECT chunk_id, doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m
  FROM e a JOIN e b ON a.g = b.g AND a.chunk_id < b.chunk_id AND a.doc_id <> b.doc_id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY 1, 2)
SELECT x AS chunk_id_a, y AS chunk_id_b FROM p WHERE common / (n + m - common) >= 0.7"""

P1_CLASSES = f"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
w AS (SELECT chunk_id, regexp_extract_all(lower({_body}), '[a-z0-9]+') AS w FROM c),
m AS (SELECT DISTINCT chunk_id, array_to_string(w, ' ') AS body, w FROM w WHERE len(w) >= 20),
k AS (SELECT body, any_value(w) AS w, min(chunk_id) AS class_id, count(*) AS size FROM m GROUP BY 1),
s AS (SELECT class_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM k),
e AS (SELECT class_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m
  FROM e a JOIN e b ON a.g = b.g AND a.class_id <> b.class_id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY 1, 2),
l AS (SELECT x AS class_id, sum(size) AS linked FROM p JOIN k ON p.y = k.class_id WHERE common / (n + m - common) >= 0.7 GROUP BY 1)
SELECT chunk_id, class_id, CAST(size - 1 + coalesce(linked, 0) AS BIGINT) AS n_links FROM m JOIN k USING (body) LEFT JOIN l USING (class_id)"""

_from = "".join(LOOKALIKES) + "".join(map(chr, [*BLANKS, *HYPHENS])) + "".join(chr(0xFF00 + c - 0x20) for c in range(0x21, 0x7F))
_to = "".join(LOOKALIKES.values()) + " " * len(BLANKS) + "-" * len(HYPHENS) + "".join(chr(c) for c in range(0x21, 0x7F))
_look = "raw_text"
for _one, _many in LIGATURES.items():
    _look = f"replace({_look}, {_q(_one)}, {_q(_many)})"
_unseen = "[" + "".join(f"\\x{{{c:X}}}" for c in UNSEEN) + "]"
_look = f"nfc_normalize(regexp_replace(translate({_look}, {_q(_from)}, {_q(_to)}), {_q(_unseen)}, '', 'g'))"
P3 = f"""
WITH p AS (SELECT DISTINCT page_id, raw_text FROM pages WHERE raw_text IS NOT NULL), l AS (SELECT page_id, raw_text, {_look} AS look FROM p)
SELECT a.page_id AS page_id_a, b.page_id AS page_id_b FROM l a JOIN l b USING (look)
WHERE a.page_id < b.page_id AND a.raw_text <> b.raw_text AND regexp_matches(look, '[^\\s\\p{{Z}}]')"""

_mapped = "x"
for _one, _many in [*COMPOSED.items(), *LIGATURES.items()]:
    _mapped = f"replace({_mapped}, {_q(_one)}, {_q(_many)})"
_mapped = f"regexp_replace(translate({_mapped}, {_q(_from)}, {_q(_to)}), {_q(_unseen)}, '', 'g')"
P3_CONSISTENT = f"""
WITH p AS (SELECT page_id, min(raw_text) AS raw_text FROM pages GROUP BY 1), l AS (SELECT page_id, raw_text, {_look} AS look FROM p),
c AS (SELECT look, min(page_id) AS class_id, min(raw_text) AS canonical FROM l WHERE regexp_matches(look, '[^\\s\\p{{Z}}]') GROUP BY 1 HAVING count(*) > 1),
j AS (SELECT page_id, coalesce(class_id, page_id) AS class_id, coalesce(canonical, raw_text) AS x FROM l LEFT JOIN c USING (look))
SELECT page_id, class_id, {_mapped} AS text FROM j"""

P4 = r"""
WITH f AS (SELECT doc_id, lower(string_split(min(file_name), '__')[1]) AS source FROM parsed_documents WHERE file_name IS NOT NULL GROUP BY 1),
n AS (SELECT source, count(*) AS docs FROM f GROUP BY 1),
p AS (SELECT DISTINCT page_id, source, doc_id, string_split(text, chr(10)) AS t FROM pages JOIN f USING (doc_id) WHERE text IS NOT NULL),
l AS (SELECT page_id, source, doc_id, CAST(unnest(range(len(t))) AS INT) AS line_no, unnest(t) AS line FROM p),
k AS (SELECT *, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^a-z0-9]+', ' ', 'g')) AS form FROM l),
c AS (SELECT * FROM k WHERE length(regexp_replace(form, '[^a-z]', '', 'g')) >= 10),
h AS (SELECT source, form FROM c JOIN n USING (source) GROUP BY 1, 2, docs HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) * 10 >= docs)
SELECT page_id, line_no FROM c JOIN h USING (source, form)"""

P4_PAGES = f"""
WITH gone AS ({P4.strip()}),
once AS (SELECT page_id, min(text) AS text FROM pages GROUP BY 1),
every AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM once WHERE text IS NOT NULL),
kept AS (SELECT page_id, string_agg(line, chr(10) ORDER BY e.line_no) AS text FROM every e ANTI JOIN gone g USING (page_id, line_no) GROUP BY 1),
n AS (SELECT page_id, CAST(count(*) AS INT) AS n_removed FROM gone GROUP BY 1)
SELECT page_id, CASE WHEN once.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(n_removed, 0) AS n_removed
FROM once LEFT JOIN kept USING (page_id) LEFT JOIN n USING (page_id)"""

P5 = r"""
SELECT DISTINCT chunk_id FROM chunks
WHERE len(regexp_extract_all(text, '[^ \t\r\n]+')) > 1000 AND NOT coalesce(starts_with(chunk_type, 'table'), false)"""

P7 = """
WITH i AS (SELECT DISTINCT item_id, unnest([question, passage]) AS t FROM eval_items),
iw AS (SELECT item_id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM i WHERE t IS NOT NULL),
ik AS (SELECT item_id, least(len(w), 12) AS size, w, unnest(range(1, len(w) - least(len(w), 12) + 2)) AS pos FROM iw WHERE len(w) >= 8),
keys AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS k FROM ik),
sizes AS (SELECT DISTINCT size FROM keys),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
dk AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size)
SELECT DISTINCT doc_id, item_id FROM dk JOIN keys ON keys.size = dk.size AND keys.k = array_to_string(list_slice(w, pos, pos + dk.size - 1), ' ')"""

ORACLES = {"p1_found": P1, "p1_classes": P1_CLASSES, "p3_found": P3, "p3_consistent": P3_CONSISTENT, "p4_found": P4, "p4_pages": P4_PAGES, "p5_found": P5, "p7_found": P7}
