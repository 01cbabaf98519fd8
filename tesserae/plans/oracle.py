"""Reference SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

import re

from tesserae.functions.columns import DEFINITION_WORDS, FILE_EXTENSIONS
from tesserae.operators import rules
from tesserae.operators.answer import LEAST_CHARS, NOTHING_FOUND, TRUNCATED
from tesserae.plans.queries import DIM, MAX_CHARS, TOP_K


def _names(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _alternatives(words) -> str:
    return "|".join(w.replace(".", r"\.").replace("-", r"\-") for w in words)


_FILES = """f AS (SELECT file_id, repo, name, repo || '/' || name AS rel_path, text FROM files
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1)"""
_CHUNKS = """c AS (SELECT chunk_id, file_id, repo, repo || '/' || metadata.file AS file, metadata.start_line AS start_line, metadata.end_line AS end_line,
  metadata.symbol AS symbol, metadata.language AS language, text, vector FROM chunks
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) = 1)"""
_QUESTIONS = "q AS (SELECT DISTINCT question_id, question FROM questions WHERE question IS NOT NULL)"
_CHANGES = """ch AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY received_at DESC) = 1)"""
#: Lines of the files that are not blank.
_FILE_LINES = r"""ln AS (SELECT file, no, line FROM (SELECT rel_path AS file, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS no, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM f WHERE text IS NOT NULL)
    WHERE regexp_matches(line, '[^\s\x1c-\x1f]'))"""
_LF = r"regexp_replace(text, '\r\n?', chr(10), 'g')"


def _secret(path: str) -> str:
    name = f"lower(regexp_extract({path}, '[^/]*$'))"
    suffix = rf"regexp_extract({name}, '^.+(\.[^./]+)$', 1)"
    globs = rules.SECRET_GLOBS.replace(r"\A", "^").replace(r"\z", "$")
    return f"NOT regexp_matches({name}, '({_alternatives(rules.TEMPLATE_ENDINGS)})$') AND ({name} IN ({_names(rules.SECRET_NAMES)}) OR {suffix} IN ({_names(rules.SECRET_SUFFIXES)}) OR regexp_matches({name}, '{globs}'))"


#: The example patterns as conditions on ``name``.
_PATTERNS = {
    "*.md": r"regexp_matches(name, '(?s)^.*\.md$')",
    "deploy/": "name = 'deploy' OR starts_with(name, 'deploy/')",
    "ops/": "name = 'ops' OR starts_with(name, 'ops/')",
    "tests": "list_contains(string_split(name, '/'), 'tests')",
    "*_test.py": r"regexp_matches(name, '(?s)^.*_test\.py$')",
    "lib/util/[a-f]*": "regexp_matches(name, '(?s)^lib/util/[a-f].*$')",
}
_ANY_PATTERN = " OR ".join(f"({p})" for p in _PATTERNS.values())


def _path_reason_of(path: str) -> str:
    """The reason for another column than ``name``."""
    return re.sub(r"\bname\b", path, _path_reason())


def _path_reason() -> str:
    base, parents = "regexp_extract(name, '[^/]*$')", "string_split(name, '/')[1:-2]"
    suffix = rf"regexp_extract({base}, '^.+(\.[^./]+)$', 1)"
    return f"""CASE WHEN name = '{rules.IGNORE_FILE}' THEN 'ignore file'
      WHEN list_has_any({parents}, [{_names(rules.IGNORED_DIRS)}]) THEN 'directory'
      WHEN {suffix} IN ({_names(rules.IGNORED_SUFFIXES)}) THEN 'suffix'
      WHEN regexp_matches({base}, '({_alternatives(rules.IGNORED_ENDINGS)})$') THEN 'ending'
      WHEN {base} IN ({_names(rules.LOCK_FILES)}) THEN 'lock file'
      WHEN {_secret('name')} THEN 'secret'
      WHEN {_ANY_PATTERN} THEN 'pattern' END"""


_PAIRS = "regexp_replace(substr(hex(encode(text)), 1, 16384), '(..)', '\\1 ', 'g')"
_RATIO = f"""CASE WHEN length(text) = 0 THEN 1.0 WHEN contains({_PAIRS}, '00 ') THEN 0.0
  ELSE (length({_PAIRS}) - length(regexp_replace({_PAIRS}, '(09|0A|0D|[2-6][0-9A-F]|7[0-9A-E]) ', '', 'g')))::DOUBLE / length({_PAIRS}) END"""

_DELIVERIES = """d AS (SELECT repo || '/' || name AS file, file_hash, epoch_us(ingested_at) AS us FROM files WHERE file_hash IS NOT NULL),
  first AS (SELECT file, file_hash FROM d WHERE us <= (SELECT (min(us) + max(us)) // 2 FROM d) QUALIFY row_number() OVER (PARTITION BY file ORDER BY us DESC, file_hash DESC) = 1),
  last AS (SELECT file, file_hash FROM d QUALIFY row_number() OVER (PARTITION BY file ORDER BY us DESC, file_hash DESC) = 1),
  cur AS (SELECT DISTINCT repo || '/' || name AS file FROM files)"""

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def _slots(source: str, key: str, text: str) -> str:
    """CTEs ending in ``slots``: the hashed bag of tokens."""
    words = _WORDS.format(text)
    return f"""tk AS (SELECT {key}, unnest(CASE WHEN len({words}) = 0 THEN [{text}] ELSE {words} END) AS token FROM {source}),
      th AS (SELECT {key}, sha256(token) AS h FROM tk),
      slots AS (SELECT {key}, (('0x' || substr(h, 1, 2))::INT % {DIM})::INT AS slot,
        sum((CASE WHEN ('0x' || substr(h, 3, 2))::INT % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * (1 + ('0x' || substr(h, 5, 2))::INT / 255.0::DOUBLE)) AS value FROM th GROUP BY ALL)"""


#: Questions as unit vectors, and their eight nearest chunks.
_ASKED = f"""{_QUESTIONS}, {_slots('q', 'question_id', 'question')},
  qn AS (SELECT question_id, sqrt(sum(value * value)) AS n FROM slots GROUP BY ALL),
  grid AS (SELECT question_id, slot FROM (SELECT DISTINCT question_id FROM slots), range({DIM}) r(slot)),
  asked AS (SELECT grid.question_id, list(coalesce(value, 0.0) / CASE WHEN n = 0 THEN 1.0 ELSE n END ORDER BY grid.slot) AS qv
    FROM grid JOIN qn USING (question_id) LEFT JOIN slots ON slots.question_id = grid.question_id AND slots.slot = grid.slot GROUP BY ALL)"""
_COSINE = "round(coalesce(CASE WHEN list_sum([x * x for x in vector]) = 0 OR list_sum([x * x for x in qv]) = 0 THEN 0.0 ELSE list_cosine_similarity(qv, vector) END, 0.0), 6) + 0.0"
_KNN = f"""near AS (SELECT question_id, chunk_id, {_COSINE} AS score FROM asked, c WHERE len(vector) = {DIM}),
  knn AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM near QUALIFY rank <= {TOP_K})"""

_EDGE = r"""["''`,;:!?\[\]{}<>]"""
_IDENT = "^[A-Za-z_][A-Za-z0-9_]*$"
_TERMS = rf"""raws AS (
    SELECT question_id, unnest(regexp_split_to_array(trim(regexp_replace(question, '`[^`]+`', ' ', 'g')), '\s+')) AS raw, false AS explicit FROM q
    UNION ALL SELECT question_id, unnest(regexp_split_to_array(trim(span), '\s+')), true FROM (SELECT question_id, unnest(regexp_extract_all(question, '`([^`]+)`', 1)) AS span FROM q)),
  t1 AS (SELECT *, regexp_replace(regexp_replace(raw, '^{_EDGE}+|{_EDGE}+$', '', 'g'), '\.+$', '') AS t FROM raws),
  t2 AS (SELECT question_id, explicit, ends_with(t, '()') AS call, regexp_replace(regexp_replace(regexp_replace(t, '^[()]+|[()]+$', '', 'g'), '\.+$', ''), '^\./', '') AS token FROM t1),
  t3 AS (SELECT *, NOT call AND regexp_full_match(token, '(?:[\w.-]+/)*(?:[\w.-]*\w\.[A-Za-z][A-Za-z0-9]*|\.[\w-]+)')
      AND (contains(token, '/') OR (starts_with(token, '.') AND len(token) - len(replace(token, '.', '')) = 1) OR lower(regexp_extract(token, '[^.]*$')) IN ({_names(FILE_EXTENSIONS)})) AS is_file
    FROM t2 WHERE token <> ''),
  t4 AS (SELECT *, string_split(token, '.') AS parts FROM t3 WHERE NOT is_file),
  t5 AS (SELECT question_id, explicit, call, len(parts) > 1 AND len([p for p in parts if regexp_matches(p, '{_IDENT}')]) = len(parts) AS dotted, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS nth FROM t4),
  terms AS (SELECT DISTINCT question_id, 'filename' AS kind, token AS term FROM t3 WHERE is_file
    UNION SELECT question_id, 'symbol', part FROM t5 WHERE regexp_matches(part, '{_IDENT}') AND (explicit OR call OR (dotted AND nth = n AND len(part) >= 2)
      OR (len(part) >= 2 AND ((contains(part, '_') AND regexp_matches(part, '[^_]')) OR regexp_matches(part, '[a-z][A-Z]|[A-Z]{{2}}[a-z]')))))"""
#: A definition of a term as one search through each text, without the extraction that the engine uses.
_EXACT = rf"""ex AS (SELECT question_id, chunk_id, min(r) AS r FROM (
      SELECT question_id, chunk_id, 0 AS r FROM terms JOIN c ON c.symbol = term WHERE kind = 'symbol'
      UNION ALL SELECT question_id, chunk_id, 1 FROM (SELECT DISTINCT term FROM terms WHERE kind = 'symbol') n
        JOIN c ON contains(c.text, n.term) AND regexp_matches(c.text, '\b(?:{'|'.join(DEFINITION_WORDS)})\s+(?:\([^)]*\)\s*)?' || n.term || '\b') JOIN terms t ON t.term = n.term AND t.kind = 'symbol'
      UNION ALL SELECT question_id, chunk_id, 2 FROM terms JOIN c ON c.file = term OR ends_with(c.file, '/' || term) WHERE kind = 'filename') GROUP BY ALL),
  exact AS (SELECT question_id, chunk_id, CASE r WHEN 0 THEN 'symbol' WHEN 1 THEN 'definition' ELSE 'filename' END AS match, r FROM ex)"""
_SCORED = f"""scored AS (SELECT exact.question_id, exact.chunk_id, match, r, CASE WHEN len(vector) = {DIM} THEN {_COSINE} ELSE 0.0 END AS score, file, coalesce(start_line, 0) AS line
  FROM exact JOIN c ON c.chunk_id = exact.chunk_id JOIN asked ON asked.question_id = exact.question_id)"""
_MERGED = f"""al AS (SELECT question_id, chunk_id, match, r AS o1, -score AS o2, file AS o3, line AS o4, 0 AS o5 FROM scored
    UNION ALL SELECT question_id, chunk_id, 'vector', 3, 0.0, '', 0, rank FROM knn),
  one AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY o1, o2, o3, o4, o5) = 1),
  merged AS (SELECT question_id, chunk_id, match, row_number() OVER (PARTITION BY question_id ORDER BY o1, o2, o3, o4, o5, chunk_id) AS rank FROM one QUALIFY rank <= {TOP_K})"""
_ALL = f"WITH {_CHUNKS}, {_ASKED}, {_TERMS}, {_EXACT}, {_SCORED}, {_KNN}, {_MERGED}"
_REF = "CASE WHEN start_line IS NOT NULL AND end_line IS NOT NULL THEN file || ':L' || start_line || '-L' || end_line ELSE file END"
_BUDGET = rf"""h0 AS (SELECT merged.question_id, merged.rank, merged.match, c.* FROM merged JOIN c ON c.chunk_id = merged.chunk_id),
  h1 AS (SELECT *, {_REF} AS ref, '[' || rank || '] ' || concat_ws(' | ', 'Source: ' || {_REF}, 'Symbol: ' || nullif(symbol, ''), 'Language: ' || nullif(language, ''),
      CASE WHEN match <> 'vector' THEN 'Match: exact ' || match END) AS header FROM h0),
  h2 AS (SELECT *, length(header) + 1 + CASE WHEN rank > 1 THEN 2 ELSE 0 END AS head FROM h1),
  h3 AS (SELECT *, sum(head + length(text)) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS until FROM h2),
  h4 AS (SELECT *, until - head - length(text) AS before, {MAX_CHARS} - (until - head - length(text)) - head - {len(TRUNCATED)} AS room FROM h3),
  kept AS (SELECT question_id, rank, chunk_id, header, ref, CASE WHEN until <= {MAX_CHARS} THEN text ELSE substr(text, 1, room::BIGINT) || '\n... [truncated]' END AS body
    FROM h4 WHERE until <= {MAX_CHARS} OR (before <= {MAX_CHARS} AND (room >= {LEAST_CHARS} OR (rank = 1 AND room > 0))))""".replace("'\\n... [truncated]'", "chr(10) || '... [truncated]'")
_CONTEXT = "ctx AS (SELECT question_id, string_agg(header || chr(10) || body, chr(10) || chr(10) ORDER BY rank) AS context FROM kept GROUP BY ALL)"
_CITED = "cited AS (SELECT question_id, string_agg('- [' || ref || ']', chr(10) ORDER BY r) AS citations FROM (SELECT question_id, ref, min(rank) AS r FROM kept GROUP BY ALL) GROUP BY ALL)"

_ACTIONS = f"""{_CHANGES}, ev AS (
    SELECT repo, path, {{'a': committed_at, 'b': ord, 'c': change_id}} AS w, 'delete' AS action FROM ch WHERE status = 'D' OR (status = 'R' AND path <> new_path)
    UNION ALL SELECT repo, CASE WHEN status = 'R' THEN new_path ELSE path END, {{'a': committed_at, 'b': ord, 'c': change_id}}, 'upsert' FROM ch WHERE status <> 'D'),
  act AS (SELECT repo, path, action FROM ev WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY w.a DESC NULLS LAST, w.b DESC NULLS LAST, w.c DESC, action DESC) = 1)"""

ORACLE = {
    "file_catalog": rf"WITH {_FILES} SELECT file_id, rel_path, regexp_extract(rel_path, '[^/]*$') AS base, regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^.+\.([^./]+)$', 1) AS extension, length(text)::BIGINT AS n_chars, (length({_LF}) - length(replace({_LF}, chr(10), '')) + 1)::BIGINT AS n_lines FROM f",
    "content_hash": f"WITH {_FILES} SELECT file_id, sha256(text) AS sha256 FROM f",
    "skip_reason": f"WITH {_FILES} SELECT file_id, coalesce({_path_reason()}, CASE WHEN {_RATIO} < 0.75 THEN 'binary' END) AS reason FROM f",
    "secret_filter": f"SELECT rel_path, {_secret('rel_path')} AS secret FROM (SELECT repo || '/' || name AS rel_path FROM files UNION SELECT repo || '/' || path FROM changes)",
    "ignore_patterns": " UNION ALL ".join(f"SELECT DISTINCT name, '{p}' AS pattern FROM files WHERE {cond}" for p, cond in _PATTERNS.items()),
    "binary_ratio": f"SELECT doc_id, round(r, 6) AS ratio, r < 0.75 AS is_binary FROM (SELECT doc_id, {_RATIO} AS r FROM documents)",
    "duplicate_content": f"WITH {_FILES} SELECT sha256(text) AS sha256, count(*) AS n_files, count(DISTINCT repo) AS n_repos FROM f GROUP BY 1 HAVING count(*) > 1",
    "stale_files": "SELECT file FROM (SELECT repo || '/' || path AS file FROM changes UNION SELECT repo || '/' || metadata.file FROM chunks) EXCEPT SELECT repo || '/' || name FROM files",
    "unchanged_files": f"WITH {_DELIVERIES} SELECT last.file FROM last JOIN first ON first.file = last.file AND first.file_hash = last.file_hash",
    "to_process": f"WITH {_DELIVERIES} SELECT cur.file FROM cur LEFT JOIN last USING (file) LEFT JOIN first USING (file) WHERE first.file_hash IS NULL OR last.file_hash IS NULL OR first.file_hash <> last.file_hash",
    "parse_changes": f"WITH {_CHANGES} SELECT change_id, status, path, CASE WHEN status = 'R' THEN new_path END AS new_path FROM ch",
    "plan_reindex": f"""WITH {_CHANGES}, x AS (SELECT status, repo || '/' || path AS path, repo || '/' || new_path AS new_path FROM ch), p AS (SELECT DISTINCT repo || '/' || name AS path, name FROM files),
      t AS (SELECT DISTINCT CASE WHEN status = 'R' THEN new_path ELSE path END AS path FROM x WHERE status <> 'D'), there AS (SELECT p.path, {_path_reason()} AS reason FROM t JOIN p ON p.path = t.path)
      SELECT path, 'delete' AS action FROM (SELECT path FROM x WHERE status = 'D' UNION SELECT path FROM x WHERE status = 'R' AND path <> new_path UNION SELECT path FROM there WHERE reason IS NOT NULL)
      UNION ALL SELECT path, 'upsert' FROM there WHERE reason IS NULL""",
    "apply_changes": f"""WITH {_ACTIONS} SELECT DISTINCT repo || '/' || name AS file, 'indexed' AS origin FROM files WHERE repo || '/' || name NOT IN (SELECT repo || '/' || path FROM act)
      UNION ALL SELECT repo || '/' || path, 'changed' FROM act WHERE action = 'upsert'""",
    "snapshot_files": "SELECT repo || '/' || name AS file FROM files WHERE file_hash IS NOT NULL UNION SELECT repo || '/' || metadata.file FROM chunks",
    "parse_change_logs": f"WITH {_CHANGES} SELECT repo, (row_number() OVER (PARTITION BY repo ORDER BY change_id) - 1)::INT AS ord, status, path, CASE WHEN status = 'R' THEN new_path END AS new_path FROM ch",
    "closing_chunks": rf"WITH {_CHUNKS} SELECT chunk_id, length(text)::INT AS n_chars FROM c WHERE regexp_full_match(text, '[\s{{}}()\[\];,]*')",
    "feed_index": f"""WITH {_FILES}, {_ACTIONS} SELECT rel_path AS file, sha256(text) AS file_hash FROM act JOIN f ON f.rel_path = act.repo || '/' || act.path
      WHERE action = 'upsert' AND {_path_reason_of('rel_path')} IS NULL AND {_RATIO} >= 0.75""",
    "stream_reindex": f"WITH {_ACTIONS} SELECT repo, path, action FROM act",
    "whole_file_chunks": rf"WITH {_FILES} SELECT file_id, 1 AS start_line, (length({_LF}) - length(replace({_LF}, chr(10), '')) + 1)::INT AS end_line, regexp_extract(regexp_extract(name, '[^/]*$'), '^.+\.([^./]+)$', 1) AS language FROM f WHERE regexp_matches(text, '\S')",
    "chunk_coverage": f"WITH {_FILES}, {_CHUNKS} SELECT c.repo, count(*) AS n_chunks, count(*) FILTER (array_to_string(string_split({_LF.replace('text', 'f.text')}, chr(10))[start_line:end_line], chr(10)) = c.text) AS n_exact FROM c JOIN f ON f.file_id = c.file_id GROUP BY 1",
    "file_batches": "SELECT rel_path, ((row_number() OVER (ORDER BY string_split(rel_path, '/'), rel_path) - 1) // 32)::INT AS batch FROM (SELECT DISTINCT repo || '/' || name AS rel_path FROM files)",
    "index_report": f"WITH {_DELIVERIES} SELECT count(*) AS scanned, count(*) FILTER (last.file_hash = first.file_hash) AS unchanged, count(*) FILTER (coalesce(last.file_hash <> first.file_hash, true)) AS to_index FROM cur LEFT JOIN last USING (file) LEFT JOIN first USING (file)",
    "tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest(CASE WHEN len({_WORDS.format('text')}) = 0 THEN [text] ELSE {_WORDS.format('text')} END) AS token FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "hashed_embedding": f"WITH src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {_slots('src', 'doc_id', 'text')} SELECT doc_id, slot, round(value, 6) AS value FROM slots",
    "embedding_norm": f"WITH src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {_slots('src', 'doc_id', 'text')} SELECT doc_id, round(sqrt(sum(value * value)), 6) AS norm FROM slots GROUP BY 1",
    "cosine_topk": f"""SELECT query_id, item_id, score, rank::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= {TOP_K}""",
    "batch_knn": f"WITH {_CHUNKS}, {_ASKED}, {_KNN} SELECT question_id, chunk_id, score, rank::INT AS rank FROM knn",
    "query_terms": f"WITH {_QUESTIONS}, {_TERMS} SELECT question_id, kind, term FROM terms",
    "exact_symbol": f"WITH {_CHUNKS}, {_QUESTIONS}, {_TERMS}, {_EXACT} SELECT question_id, chunk_id FROM exact WHERE match = 'symbol'",
    "exact_definition": f"WITH {_CHUNKS}, {_QUESTIONS}, {_TERMS}, {_EXACT} SELECT question_id, chunk_id FROM exact WHERE match = 'definition'",
    "exact_filename": rf"""WITH {_CHUNKS}, {_QUESTIONS}, {_TERMS}, named AS (SELECT DISTINCT file_id AS question_id, name FROM files WHERE file_id IN (SELECT question_id FROM q)),
      wanted AS (SELECT question_id, term FROM terms WHERE kind = 'filename' UNION SELECT question_id, name FROM named UNION SELECT question_id, regexp_extract(name, '[^/]*$') FROM named)
      SELECT DISTINCT question_id, chunk_id FROM wanted JOIN c ON c.file = term OR ends_with(c.file, '/' || term)""",
    "ast_chunk_lines": f"WITH {_FILES}, {_FILE_LINES} SELECT file, count(*) AS n_lines, sum(no)::BIGINT AS line_sum, sha256(string_agg(line, chr(10) ORDER BY no)) AS sha256 FROM ln GROUP BY 1",
    "line_chunk_lines": f"WITH {_FILES}, {_FILE_LINES} SELECT file, count(*) AS n_lines, sum(no)::BIGINT AS line_sum, sha256(string_agg(line, chr(10) ORDER BY no)) AS sha256 FROM ln GROUP BY 1",
    "snapshot_update": f"""WITH {_FILES}, {_FILE_LINES}, n AS (SELECT file, count(*) AS n_lines FROM ln GROUP BY 1), {_CHANGES},
      kept AS (SELECT rel_path AS file, text FROM f WHERE {_path_reason_of('rel_path')} IS NULL AND {_RATIO} >= 0.75 AND rel_path NOT IN (SELECT repo || '/' || path FROM ch WHERE status = 'D'))
      SELECT kept.file, sha256(text) AS file_hash, coalesce(n_lines, 0)::BIGINT AS n_lines FROM kept LEFT JOIN n USING (file)""",
    "exact_ranked": f"WITH {_CHUNKS}, {_ASKED}, {_TERMS}, {_EXACT}, {_SCORED} SELECT question_id, chunk_id, match, (row_number() OVER (PARTITION BY question_id ORDER BY r, score DESC, file, line, chunk_id))::INT AS rank FROM scored",
    "merged_hits": f"{_ALL} SELECT question_id, chunk_id, match, rank::INT AS rank FROM merged",
    "context_budget": f"{_ALL}, {_BUDGET} SELECT question_id, rank::INT AS rank, chunk_id, length(body)::BIGINT AS n_chars FROM kept",
    "context_text": f"{_ALL}, {_BUDGET}, {_CONTEXT} SELECT question_id, length(context)::BIGINT AS n_chars, sha256(context) AS sha256 FROM ctx",
    "citations": f"{_ALL}, {_BUDGET}, {_CITED} SELECT question_id, citations FROM cited",
    "ask": f"{_ALL}, {_BUDGET}, {_CONTEXT}, {_CITED} SELECT q.question_id, coalesce('The index holds this on the question: ' || string_split(context, chr(10))[1], '{NOTHING_FOUND}') AS answer, length(context)::BIGINT AS context_chars, citations FROM q LEFT JOIN ctx USING (question_id) LEFT JOIN cited USING (question_id)",
}
