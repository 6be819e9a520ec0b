"""SQL for DuckDB that the core's queries must agree with, over the same tables.

The SQL is written on its own; only patterns and word lists, which are fixed values, are shared.
"""

from __future__ import annotations

from folioflow.functions import boundaries as B
from folioflow.functions import text as T
from folioflow.operators.evidence import REFUSALS


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


S = T.S
STRIP = q(f"^{S}+|{S}+$")


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def count_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(T.NS + '+')}))"


PAGES = "pages_once AS (SELECT DISTINCT ON (page_id) * FROM pages ORDER BY page_id, loaded_at DESC)"
CHUNKS = "chunks_once AS (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1)"
NL = "chr(10)"
UNIX = lambda x: f"regexp_replace({x}, {q(T.LINE_ENDS)}, {NL}, 'g')"

_headers = "t1"
for _h in T.RUNNING_HEADERS:
    _headers = f"regexp_replace({_headers}, {q(f'(?im)^{S}*{_h}{S}*$')}, '', 'g')"
_content = f"regexp_replace(regexp_replace(x, '^[ \\t]+', ''), {q(S + '+$')}, '')"
_line = f"CASE WHEN {_content} = '' THEN '' ELSE replace(regexp_extract(x, '^([ \\t]*)', 1), chr(9), '  ') || regexp_replace({_content}, '[ \\t]+', ' ', 'g') END"

CLEAN_PAGES = f"""
WITH {PAGES},
a AS (SELECT page_id, doc_id, page_number, regexp_replace(translate(raw_text, {q(T.MARKS)}, {q(T.PLAIN)}), {q(T.PAGE_NUMBER)}, '', 'g') AS t1 FROM pages_once),
b AS (SELECT *, CASE WHEN page_number = 1 THEN t1 ELSE {_headers} END AS t2 FROM a),
c AS (SELECT *, array_to_string(list_transform(string_split({UNIX('t2')}, {NL}), lambda x: {_line}), {NL}) AS t3 FROM b),
d AS (SELECT page_id, doc_id, page_number, coalesce({strip("regexp_replace(t3, '\\n{3,}', chr(10) || chr(10), 'g')")}, '') AS text FROM c)
SELECT page_id, doc_id, page_number, text, CAST(length(text) AS INT) AS char_count FROM d"""

_raw_length = f"length({strip('coalesce(raw_text, ' + q('') + ')')})"
TEXT_GATE = f"""
WITH {PAGES}, n AS (SELECT doc_id, count(*) AS n_pages, CAST(count(*) FILTER ({_raw_length} < 50) AS BIGINT) AS n_thin FROM pages_once GROUP BY 1)
SELECT *, n_thin <= n_pages * 0.5 AS accepted FROM n"""

PAGE_WARNINGS = f"""
WITH {PAGES}
SELECT page_id, 'Page ' || page_number || ': table detected' AS warning FROM pages_once WHERE has_table
UNION ALL SELECT page_id, 'Page ' || page_number || ': no text' FROM pages_once WHERE coalesce({strip('text')}, '') = ''"""

DOCUMENT_WARNINGS = f"""
WITH {PAGES},
w AS (SELECT doc_id, page_number, page_id, 1 AS k, 'Page ' || page_number || ': table detected' AS warning FROM pages_once WHERE has_table
  UNION ALL SELECT doc_id, page_number, page_id, 2, 'Page ' || page_number || ': no text' FROM pages_once WHERE coalesce({strip('text')}, '') = ''
  UNION ALL SELECT doc_id, NULL, NULL, 3, 'Document is very short: only ' || CAST(sum(length(coalesce(text, ''))) AS BIGINT) || ' total characters extracted.'
    FROM pages_once GROUP BY 1 HAVING sum(length(coalesce(text, ''))) < 200),
l AS (SELECT doc_id, list(warning ORDER BY page_number NULLS LAST, page_id, k) AS warnings FROM w GROUP BY 1)
SELECT doc_id, coalesce(warnings, []) AS warnings FROM (SELECT DISTINCT doc_id FROM pages_once WHERE doc_id IS NOT NULL) LEFT JOIN l USING (doc_id)"""

DOCUMENT_TEXT = f"""
WITH {PAGES}
SELECT doc_id, string_agg('--- Page ' || page_number || ' ---' || {NL} || text, {NL} || {NL} ORDER BY page_number, page_id) AS text,
CAST(sum(length(text)) AS BIGINT) AS total_chars FROM pages_once WHERE coalesce(text, '') <> '' GROUP BY 1"""

DOCUMENT_REPORT = f"""
WITH {PAGES}, files AS (SELECT DISTINCT ON (doc_id) doc_id, file_name FROM parsed_documents ORDER BY doc_id, parsed_at DESC),
n AS (SELECT doc_id, count(*) AS n_pages, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS total_chars, count(*) FILTER (has_table) AS n_tables,
  count(*) FILTER ({strip("coalesce(text, '')")} = '') AS n_empty, count(*) FILTER ({_raw_length} < 50) AS n_thin FROM pages_once GROUP BY 1),
j AS (SELECT doc_id, file_name, coalesce(n_pages, 0) AS n_pages, coalesce(total_chars, 0) AS total_chars, coalesce(n_tables, 0) AS n_tables,
  coalesce(n_empty, 0) AS n_empty, coalesce(n_thin, 0) AS n_thin FROM files LEFT JOIN n USING (doc_id))
SELECT doc_id, file_name, n_pages, total_chars, n_tables, n_empty, total_chars < 200 AS is_short,
CASE WHEN n_pages = 0 THEN 'empty' WHEN n_thin > n_pages * 0.5 THEN 'scanned' ELSE 'parsed' END AS status FROM j"""

# lines, as the chunker sees them
_tail = f"regexp_extract(regexp_replace(s, '[.,;:)\\-]+$', ''), {q('(' + T.NS + '+)' + S + '*$')}, 1)"
HEADING = f"""(length(s) BETWEEN 8 AND 120 AND regexp_matches(s, '^\\p{{Lu}}') AND NOT regexp_matches(s, '[.?!;,\\-]$')
  AND regexp_replace(lower({_tail}), '[)\\-,.]+$', '') NOT IN ({', '.join(q(w) for w in B.WRAPPED_WORDS)})
  AND NOT regexp_matches(lower(s), {q(B.PREFIX_PATTERN)}) AND NOT regexp_matches(s, '\\. [A-Z]')
  AND len(list_filter(regexp_split_to_array(s, {q(S + '+')}), lambda w: regexp_matches(w, '\\p{{L}}'))) >= 3
  AND NOT regexp_matches(s, '@|http://|https://|www\\.') AND NOT regexp_matches(s, {q(B.TWO_NAMES)})
  AND NOT regexp_matches(s, {q('^(?:' + B.MONTHS + ')')}) AND NOT regexp_matches(s, '\\(All\\)|/'))"""
DEFINITE = f"""CASE WHEN regexp_matches(line, {q(B.DECIMAL)}) THEN 'decimal' WHEN regexp_matches(line, {q(B.TOP_LEVEL)}) THEN 'top_level'
  WHEN regexp_matches(line, {q(B.ROMAN_PAREN)}) THEN 'roman' WHEN regexp_matches(line, {q(B.CLAUSE)}) THEN 'clause'
  WHEN regexp_matches(s, {q('(?i)^' + T.ROMAN + chr(92) + '.$')}) THEN 'roman' WHEN regexp_matches(line, {q(B.BULLET)}) THEN 'bullet' END"""
MARKER = f"""CASE kind WHEN 'decimal' THEN regexp_extract(line, {q(B.DECIMAL)}, 1) WHEN 'top_level' THEN regexp_extract(line, {q(B.TOP_LEVEL)}, 1)
  WHEN 'roman' THEN CASE WHEN regexp_matches(line, {q(B.ROMAN_PAREN)}) THEN '(' || lower(regexp_extract(line, {q(B.ROMAN_PAREN)}, 1)) || ')'
    ELSE lower(regexp_extract(line, {q(B.BARE_ROMAN)}, 1)) || '.' END
  WHEN 'clause' THEN '(' || regexp_extract(line, {q(B.CLAUSE)}, 1) || ')' WHEN 'bullet' THEN regexp_extract(line, {q(B.BULLET)}, 1)
  WHEN 'heading' THEN {strip("regexp_replace(s, ':+$', '')")} END"""
LINES = f"""
page_last AS (SELECT DISTINCT ON (doc_id, page_number) doc_id, page_number, coalesce(text, '') AS text, text IS NULL AS no_text, coalesce(has_table, false) AS is_table
  FROM pages WHERE doc_id IS NOT NULL ORDER BY doc_id, page_number, loaded_at DESC, text),
cut AS (SELECT doc_id, page_number, is_table, CASE WHEN is_table THEN [text] WHEN no_text THEN [] ELSE string_split({UNIX('text')}, {NL}) END AS parts FROM page_last),
lines_all AS (SELECT doc_id, page_number, is_table, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM cut),
lines AS (SELECT doc_id, page_number, CAST(line_no AS INT) AS line_no, is_table, line, {strip('line')} AS s FROM lines_all WHERE is_table OR {strip('line')} <> '')"""
STATES = f"""{LINES},
h AS (SELECT *, NOT is_table AND coalesce(last_value(CASE WHEN NOT is_table THEN ends_with(s, '-') END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY page_number, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS continues FROM lines),
k AS (SELECT *, CASE WHEN NOT is_table AND NOT continues THEN {DEFINITE} END AS definite FROM h),
e AS (SELECT *, coalesce(last_value(definite IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IN ('clause', 'roman', 'bullet'), false) AS in_enumeration FROM k),
f AS (SELECT *, CASE WHEN is_table OR continues THEN NULL WHEN definite IS NOT NULL THEN definite
  WHEN in_enumeration AND regexp_matches(line, {q(B.BARE_ROMAN)}) THEN 'roman' WHEN {HEADING} THEN 'heading' END AS kind FROM e),
m AS (SELECT *, {MARKER} AS marker FROM f),
states AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN marker END IGNORE NULLS) OVER w, '') AS title,
  CAST(sum(CASE WHEN kind IS NOT NULL OR is_table OR was_table THEN 1 ELSE 0 END) OVER w AS BIGINT) AS grp
  FROM (SELECT *, coalesce(lag(is_table) OVER (PARTITION BY doc_id ORDER BY page_number, line_no), false) AS was_table FROM m)
  WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
LINE_STATES = f"WITH {STATES} SELECT doc_id, page_number, line_no, is_table, continues, in_enumeration, kind, marker, title, grp FROM states"
BOUNDARY_COUNTS = f"WITH {STATES} SELECT kind, marker, count(*) AS n_lines, count(DISTINCT doc_id) AS n_documents FROM states WHERE kind IS NOT NULL AND kind <> 'heading' GROUP BY 1, 2"

_tok = f"unnest(regexp_extract_all(lower(text), {q(T.TOKEN)}))"
TOKENS = f"""{CHUNKS},
whole AS (SELECT chunk_id, {_tok} AS t FROM chunks_once WHERE text IS NOT NULL),
tokens AS (SELECT chunk_id, t AS term FROM whole UNION ALL
  SELECT chunk_id, p FROM (SELECT chunk_id, t, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS p FROM whole WHERE regexp_matches(t, '[(/-]')) WHERE p <> t),
postings AS (SELECT chunk_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY chunk_id) AS doc_len FROM tokens GROUP BY 1, 2),
corpus AS (SELECT (SELECT count(*) FROM chunks_once) AS n, (SELECT count(*) FROM tokens) / (SELECT count(*) FROM chunks_once) AS avgdl)"""
IDF = "ln(1.0 + (n - df + 0.5) / (df + 0.5))"
TERM_STATS = f"WITH {TOKENS} SELECT term, df, round({IDF}, 6) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1), corpus"
CORPUS_STATS = f"WITH {TOKENS} SELECT n AS n_chunks, round(avgdl, 6) AS avgdl FROM corpus"
DOC_LENGTHS = f"WITH {TOKENS} SELECT chunk_id, CAST(any_value(doc_len) AS BIGINT) AS doc_len, count(*) AS n_terms, max(tf) AS max_tf FROM postings GROUP BY 1"
ASKED = f"""questions AS (SELECT DISTINCT item_id AS query_id, question FROM eval_items WHERE item_id % 20 = 0 AND {strip('question')} <> ''),
asked_whole AS (SELECT query_id, unnest(regexp_extract_all(lower(question), {q(T.TOKEN)})) AS t FROM questions),
asked_all AS (SELECT query_id, t AS term FROM asked_whole UNION ALL
  SELECT query_id, p FROM (SELECT query_id, t, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS p FROM asked_whole WHERE regexp_matches(t, '[(/-]')) WHERE p <> t),
asked AS (SELECT query_id, term, count(*) AS qtf FROM asked_all GROUP BY 1, 2)"""
BM25 = f"""{TOKENS}, {ASKED},
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
bm AS (SELECT query_id, chunk_id, round(sum(qtf * {IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))), 6) AS score
  FROM asked JOIN postings USING (term) JOIN dfs USING (term), corpus GROUP BY 1, 2),
lexical AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 20)"""
BM25_TOPK = f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM lexical"
HASHED = f"""
bucketed AS (SELECT chunk_id, CAST('0x' || substr(md5(term), 1, 4) AS INT) % 64 AS bucket, count(*)::DOUBLE AS n FROM tokens
  WHERE chunk_id IN (SELECT chunk_id FROM chunks_once WHERE {strip('text')} <> '') GROUP BY 1, 2),
vectors AS (SELECT chunk_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS weight FROM bucketed),
asked_buckets AS (SELECT query_id, CAST('0x' || substr(md5(term), 1, 4) AS INT) % 64 AS bucket, count(*)::DOUBLE AS n FROM asked_all GROUP BY 1, 2),
asked_vectors AS (SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS weight FROM asked_buckets),
ds AS (SELECT query_id, chunk_id, round(sum(v.weight * a.weight), 6) AS score FROM vectors v JOIN asked_vectors a USING (bucket) GROUP BY 1, 2),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM ds QUALIFY rank <= 20)"""
HASHED_TOPK = f"WITH {TOKENS}, {ASKED}, {HASHED} SELECT query_id, chunk_id, score, rank FROM dense"


def _scaled(side: str) -> str:
    low, high = "min(score) OVER (PARTITION BY query_id)", "max(score) OVER (PARTITION BY query_id)"
    return f"SELECT query_id, chunk_id, score, CASE WHEN {high} > {low} THEN (score - {low}) / ({high} - {low}) WHEN score > 0 THEN 1.0 ELSE 0.0 END AS scaled FROM {side}"


HYBRID = f"""{BM25}, {HASHED}, la AS ({_scaled('lexical')}), da AS ({_scaled('dense')}),
fused AS (SELECT query_id, chunk_id, round(0.5 * coalesce(la.scaled, 0) + 0.5 * coalesce(da.scaled, 0), 6) AS score,
  list_filter([CASE WHEN la.score IS NOT NULL THEN 'bm25' END, CASE WHEN da.score IS NOT NULL THEN 'dense' END], lambda x: x IS NOT NULL) AS retrieval_sources,
  la.score AS bm25_score, da.score AS dense_score, round(coalesce(la.scaled, 0), 6) AS normalized_bm25_score, round(coalesce(da.scaled, 0), 6) AS normalized_dense_score
  FROM la FULL OUTER JOIN da USING (query_id, chunk_id)),
hybrid AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM fused QUALIFY rank <= 20)"""
HYBRID_TOPK = f"WITH {HYBRID} SELECT * FROM hybrid"
MIN_MAX = f"WITH {BM25} SELECT query_id, chunk_id, round(scaled, 6) AS scaled FROM ({_scaled('lexical')})"
HITS = f"""{HYBRID}, payload AS (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id, loaded_at DESC),
hits AS (SELECT query_id, rank, p.* FROM hybrid JOIN payload p USING (chunk_id))"""
_pages = "CASE WHEN page_start = page_end THEN 'page ' || page_start ELSE 'pages ' || page_start || '-' || page_end END"
EVIDENCE = f"""WITH {HITS} SELECT query_id, string_agg(coalesce('--- Document Evidence [' || rank || '] ---' || {NL} || 'Source File: ' || source_filename || {NL}
  || 'Section Path: ' || section_path || ' (' || section_title || ')' || {NL} || 'Pages: ' || {_pages} || {NL} || 'Content:' || {NL} || text || {NL}, ''), {NL} ORDER BY rank) AS evidence
  FROM hits GROUP BY 1"""
CITATIONS = f"""WITH {HITS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS INT) AS position,
  chunk_id, source_filename, section_path, page_start, page_end FROM hits"""
GIVEN = """
gv AS (SELECT chunk_id, any_value(list_transform(embedding, lambda x: x::DOUBLE)) AS e FROM chunk_vectors WHERE len(embedding) > 0 GROUP BY 1),
ga AS (SELECT chunk_id AS query_chunk, min(section_title) AS question, any_value(e) AS e FROM chunks JOIN gv USING (chunk_id)
  WHERE CAST(regexp_extract(chunk_id, '([0-9]+)__', 1) AS BIGINT) % 20 = 0 GROUP BY 1),
gs AS (SELECT query_chunk, b.chunk_id, round(list_inner_product(a.e, b.e) / greatest(sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)), 1e-10), 6) AS score FROM ga a, gv b),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_chunk ORDER BY score DESC, chunk_id) AS INT) AS rank FROM gs QUALIFY rank <= 20)"""
COSINE_TOPK = f"WITH {GIVEN} SELECT query_chunk, chunk_id, score, rank FROM dense"
_given_tokens = TOKENS.replace("FROM chunks GROUP BY 1", "FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM gv) GROUP BY 1")
_given_asked = ASKED[ASKED.index("asked_whole AS") :]
_given_side = lambda side: _scaled(side).replace("query_id", "query_chunk")
HYBRID_VECTORS = f"""WITH {GIVEN}, {_given_tokens},
questions AS (SELECT query_chunk AS query_id, question FROM ga WHERE {strip('question')} <> ''), {_given_asked},
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
bm AS (SELECT query_id AS query_chunk, chunk_id, round(sum(qtf * {IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))), 6) AS score
  FROM asked JOIN postings USING (term) JOIN dfs USING (term), corpus GROUP BY 1, 2),
lexical AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_chunk ORDER BY score DESC, chunk_id) AS INT) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 20),
la AS ({_given_side('lexical')}), da AS ({_given_side('dense')}),
fused AS (SELECT query_chunk, chunk_id, round(0.5 * coalesce(la.scaled, 0) + 0.5 * coalesce(da.scaled, 0), 6) AS score,
  list_filter([CASE WHEN la.score IS NOT NULL THEN 'bm25' END, CASE WHEN da.score IS NOT NULL THEN 'dense' END], lambda x: x IS NOT NULL) AS retrieval_sources,
  la.score AS bm25_score, da.score AS dense_score, round(coalesce(la.scaled, 0), 6) AS normalized_bm25_score, round(coalesce(da.scaled, 0), 6) AS normalized_dense_score
  FROM la FULL OUTER JOIN da USING (query_chunk, chunk_id))
SELECT *, CAST(row_number() OVER (PARTITION BY query_chunk ORDER BY score DESC, chunk_id) AS INT) AS rank FROM fused QUALIFY rank <= 20"""
DENSE = """
WITH v AS (SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS chunk_id, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.chunk_id, round({score}, 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s QUALIFY rank <= 20"""
DENSE_TOPK = DENSE.format(score="list_inner_product(a.e, b.e)")

_refused = f"coalesce({strip('text')} = ''" + "".join(f" OR contains(lower(text), {q(p)})" for p in REFUSALS) + ", true)"
CONFIDENCE = f"SELECT doc_id, CASE WHEN {_refused} THEN 'insufficient_evidence' ELSE 'grounded' END AS confidence_label FROM documents"
VALID = f"SELECT doc_id, coalesce(length(text) BETWEEN 1 AND 1000 AND {strip('text')} <> '', false) AS is_valid FROM documents"
CHUNK_PARTS = f"""
WITH c AS (SELECT DISTINCT chunk_id, doc_id, section_path, section_title, circular_number, text FROM chunks), d AS (SELECT *, string_split(text, {NL})[1] AS f FROM c)
SELECT chunk_id, {strip(f"CASE WHEN contains(text, {NL}) AND starts_with(f, '[') AND contains(f, ' | ') AND ends_with(f, ']') THEN substr(text, length(f) + 2) ELSE text END")} AS body,
regexp_extract(section_path, '(?s)^(.*)[.][^.]*$', 1) AS parent_section, '[' || circular_number || ' | ' || section_path || ' | ' || section_title || ']' AS header,
CAST({count_words('text')} AS INT) AS n_tokens, doc_id || '__' || regexp_replace(section_path, '[^a-zA-Z0-9_.]', '_', 'g') AS id_stem FROM d"""
COUNTS = f"""
WITH c AS (SELECT DISTINCT chunk_id, text, token_count, chunk_type FROM chunks), n AS (SELECT *, {count_words('text')} AS n FROM c)
SELECT chunk_type, count(*) AS n_chunks, count(*) FILTER (token_count IS NULL OR token_count <> n) AS n_outdated, count(*) FILTER (n < 30) AS n_small,
count(*) FILTER (n > 1000 AND NOT starts_with(chunk_type, 'table')) AS n_oversized, CAST(sum(n) AS BIGINT) AS n_tokens FROM n GROUP BY 1"""
METADATA = """
WITH m AS (SELECT DISTINCT ON (doc_id) doc_id, source_filename, coalesce(circular_number, '') AS circular_number, coalesce(date_issued, '') AS date_issued
  FROM doc_meta WHERE doc_id IS NOT NULL ORDER BY doc_id, updated_at DESC, source_filename NULLS FIRST, circular_number NULLS FIRST, date_issued NULLS FIRST),
d AS (SELECT DISTINCT doc_id FROM parsed_documents)
SELECT doc_id, coalesce(source_filename, doc_id || '.pdf') AS source_filename, coalesce(circular_number, '') AS circular_number, coalesce(date_issued, '') AS date_issued
FROM d LEFT JOIN m USING (doc_id)"""
VECTOR_GAPS = """
SELECT CASE WHEN v.chunk_id IS NULL THEN 'no vector' WHEN c.chunk_id IS NULL THEN 'no chunk' ELSE 'both' END AS state, count(*) AS n_chunks
FROM (SELECT DISTINCT chunk_id FROM chunks) c FULL OUTER JOIN (SELECT DISTINCT chunk_id FROM chunk_vectors WHERE len(embedding) > 0) v USING (chunk_id) GROUP BY 1"""
REJECTED_METADATA = """
SELECT doc_id, source_filename, circular_number, list_filter([CASE WHEN circular_number IS NULL THEN 'circular_number' END,
  CASE WHEN doc_id IS NULL THEN 'doc_id' END, CASE WHEN source_filename IS NULL THEN 'source_filename' END], lambda x: x IS NOT NULL) AS missing
FROM doc_meta WHERE circular_number IS NULL OR doc_id IS NULL OR source_filename IS NULL"""
