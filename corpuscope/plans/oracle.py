"""The same results in DuckDB SQL, written from the semantics and not from the Spark code."""

from corpuscope.plans import fixtures
from corpuscope.plans.queries import NOW

_NAMES = dict(documents="documents", events="events", conversations="conversations", benchmark="benchmark",
              log_lines="log_lines", all=", 'g'", concatenated="string_agg(line, chr(10) order by event_id)")
_FIXTURES = {name: text.format(**_NAMES) for name, text in dict(
    all_files=fixtures.FILES, scans=fixtures.SCANS, log_lines=fixtures.LOG_LINES, logs=fixtures.LOGS,
    logged=fixtures.DECISIONS, questions=fixtures.QUERIES).items()}


def _with(*ctes, then):
    return "with " + ",\n".join(f"{name} as ({body})" for name, body in ctes) + "\n" + then


def _fixture(*names):
    return [(n, _FIXTURES[n]) for n in names]


_FILES = _fixture("all_files") + [("files", """
select * from (select *, lower(regexp_extract(file_path, '\\.([^.]*)$', 1)) as ext from all_files)
where ext in ('c','h','cpp','cc','py','js','ts','java','go','rs','sh')
  and not contains(substr(file_path, 5), '/.')""")]

_SNAPSHOTS = _FILES + [("snapshots", """
select file_path, sid,
  case when ext in ('c','h') then 'c' when ext in ('cpp','cc') then 'cpp' when ext = 'py' then 'python'
       when ext = 'js' then 'javascript' when ext = 'ts' then 'typescript' when ext = 'rs' then 'rust'
       when ext = 'sh' then 'bash' else ext end as language,
  mtime as last_modified, cast(length(content) - length(replace(content, chr(10), '')) as bigint) as lines_of_code,
  sha256(content) as content_hash, content from files""")]


def _vectors(name, source, key, text):
    """(key, dim, weight) of the hashed embedding."""
    byte = lambda at: f"(((instr('0123456789abcdef', substr(h, {at}, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, {at + 1}, 1)) - 1) % 128)"
    return (name, f"""
select key, dim, n / sqrt(sum(n * n) over (partition by key)) as weight from (
  select key, dim, cast(count(*) as double) as n from (
    select key, unnest([{', '.join(byte(a) for a in (7, 15, 23, 31))}]) as dim from (
      select key, sha256(token) as h from (
        select {key} as key, unnest(string_split_regex({text}, '[ \\t\\n\\r,.!?;:()\\[\\]{{}}<>/=+\\-*"''`#@]+')) as token
        from {source}) where token <> '')) group by key, dim)""")


def _scores(name, corpus, asked, threshold):
    return (name, f"""
select q.key as query_id, c.key as item, round(sum(q.weight * c.weight) / (1 + 1e-8), 6) as score
from {asked} q join {corpus} c on q.dim = c.dim group by q.key, c.key
having sum(q.weight * c.weight) / (1 + 1e-8) > {threshold}""")


_FILE_VECTORS = _vectors("file_vectors", "files", "file_path", "content")
_PASSAGE_VECTORS = _vectors("query_vectors", "benchmark", "item_id", "text")

# --- logs
_LINES = """
select sid, log_day, event_id, user_id, event_type, line,
  case when user_id % 5 = 0 and event_type = 'error' then 'traceback'
       when event_type in ('error', 'view', 'click') then 'compiler' else 'other' end as kind from log_lines"""
_SESSIONS = _fixture("log_lines", "logs") + [("kinds", _LINES), ("sessions", """
select *, sha256(concat(sid, '_', command, '_', cast(timestamp as varchar))) as session_id from (
  select sid, log_day, timestamp, output, concat('make ', sid) as command,
    case when contains(output, 'error:') or contains(output, 'Error:') or contains(output, 'ERROR:')
           or contains(output, 'Traceback') then 1 else 0 end as exit_code from logs)""")]
_FOUND = _SESSIONS + [("tracebacks", """
select s.session_id, s.sid, 'ValueError' as error_type, concat('b_', cast(k.user_id as varchar), '.py') as file_path,
  k.event_id % 70 + 1 as line_number, cast(-1 as bigint) as column_number,
  concat('bad: ', cast(k.event_id % 50 as varchar)) as message, s.timestamp, k.event_id as ordinal
from kinds k join sessions s using (sid, log_day) where k.kind = 'traceback'"""), ("compiled", """
select session_id, sid,
  case when starts_with(p[4], ' error') then 'compile_error' when starts_with(p[4], ' warning') then 'compile_warning'
       else 'compile_note' end as error_type,
  p[1] as file_path, cast(p[2] as bigint) as line_number, cast(p[3] as bigint) as column_number,
  substr(line, length(p[1]) + length(p[2]) + length(p[3]) + length(p[4]) + 6) as message, timestamp, event_id as ordinal
from (select s.session_id, s.sid, s.timestamp, k.event_id, k.line, string_split(k.line, ':') as p
      from kinds k join sessions s using (sid, log_day) where k.kind = 'compiler')"""), ("generic", """
select session_id, sid, 'generic_error' as error_type, cast(null as varchar) as file_path, cast(-1 as bigint) as line_number,
  cast(-1 as bigint) as column_number, 'Command failed (non-zero exit)' as message, timestamp, cast(0 as bigint) as ordinal, command,
  cast(exit_code as bigint) as exit_code
from sessions where exit_code <> 0 and session_id not in (select session_id from tracebacks)
  and session_id not in (select session_id from compiled)""")]
_ERRORS = _FOUND + [("errors", """
select * exclude (rn) from (
  select *, row_number() over (partition by session_id, file_path, line_number, message order by ordinal) as rn from (
    select * from tracebacks
    union all select * from compiled where session_id not in (select session_id from tracebacks)
    union all select * exclude (command, exit_code) from generic)) where rn = 1""")]
_ERROR_COLUMNS = "select session_id, sid, error_type, file_path, line_number, column_number, message from "
_RECENT = ("recent", """
select * from (
  select *, row_number() over (partition by sid order by timestamp desc, error_type, message, file_path nulls first, line_number) as position
  from (select sid, error_type, message, file_path, line_number, max(timestamp) as timestamp from errors
        group by sid, error_type, message, file_path, line_number))""")

# --- patterns
# The default rules once more, so that the check does not rest on the rule reader.
_RULES = [
    ("c", "pattern:function", r'^[a-zA-Z_][a-zA-Z0-9_]*\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)\s*\{', "function.declared", "log"),
    ("c", "pattern:sql_query", r'(mysql_query|sqlite3_exec|PQexec|pg_query)\s*\([^,]*,\s*"([^"]+)"', "database.query", "report"),
    ("c", "pattern:api_call", r'(curl_easy_init|http_get|fetch|request)\s*\(', "api.called", "log"),
    ("python", "pattern:function", r'^def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', "function.declared", "log"),
    ("python", "pattern:sql_query", r'(cursor\.execute|db\.query|session\.query)\s*\(', "database.query", "report"),
]
_PATTERNS = _SNAPSHOTS + [
    ("lines", """select sid, file_path, language, unnest(string_split(content, chr(10))) as line,
  generate_subscripts(string_split(content, chr(10)), 1) as line_number from snapshots"""),
    ("rules", "select * from (values " + ",\n".join(
        f"('{lang}', '{name}', '{key}', '{action}')" for lang, name, _, key, action in _RULES)
     + ") r(language, pattern_name, log_key, action)"),
    ("found", "\nunion all\n".join(
        f"select sid, file_path, '{name}' as pattern_name, unnest(regexp_extract_all(line, '{rx}', 0)) as matched_text, "
        f"line_number, '{key}' as log_key, '{action}' as action from lines where language = '{lang}'"
        for lang, name, rx, key, action in _RULES))]

_WATCHED_FILES = [(name, text.replace("from all_files)", "from (select * replace (concat(content, chr(10), 'int late(int a) {', chr(10), 'def late(', chr(10)) as content, mtime + 100 as mtime) from all_files where doc_id % 5 = 0 and content is not null))")
                   if name == "files" else text) for name, text in _PATTERNS]
_WATCHED = _with(*_WATCHED_FILES, ("matched", "select file_path, count(*) as matches from found group by file_path"), then="""
select file_path, 'watched' as sid, last_modified, lines_of_code, content_hash, coalesce(matches, 0) as matches,
  concat('File ', regexp_extract(file_path, '([^/]*)$', 1), ' changed (', cast(lines_of_code as varchar), ' lines)') as rationale
from snapshots left join matched using (file_path)""")

# --- decisions
_NODE = "sha256(concat(key, '|', value, '|', rationale)) as node_id"
_HUMAN = ("human", f"""select {_NODE}, sid, 'human_decision' as action, key, value, rationale, timestamp, cast(1.0 as double) as confidence,
  'human' as source_model, cast(0 as bigint) as source, ordinal from logged""")
_PATTERN_DECISIONS = ("from_patterns", f"""select {_NODE}, * from (select sid, 'pattern_detected' as action, log_key as key, matched_text as value,
  concat('Pattern ''', pattern_name, ''' in ', file_path, ':', cast(line_number as varchar)) as rationale,
  cast({NOW} as bigint) as timestamp, cast(0.95 as double) as confidence, 'pattern_engine' as source_model, cast(2 as bigint) as source,
  line_number as ordinal from found where action = 'log')""")
_ERROR_DECISIONS = ("from_errors", f"""select {_NODE}, * from (select sid, 'terminal_error' as action, error_type as key, place as value,
  concat('Error in ', place, ' — ', message) as rationale, timestamp, cast(1.0 as double) as confidence,
  'terminal_parser' as source_model, cast(5 as bigint) as source, ordinal
  from (select *, concat(coalesce(file_path, ''), ':', cast(greatest(line_number, 0) as varchar)) as place from errors))""")
_CHANGE_DECISIONS = ("from_changes", f"""select {_NODE}, * from (select sid, 'file_changed' as action, 'file.modified' as key, name as value,
  concat('File ', name, ' changed (', cast(lines_of_code as varchar), ' lines)') as rationale, cast({NOW} as bigint) as timestamp,
  cast(1.0 as double) as confidence, 'file_watcher' as source_model, cast(2 as bigint) as source, cast(0 as bigint) as ordinal
  from (select *, regexp_extract(file_path, '([^/]*)$', 1) as name from snapshots))""")
_DECISION_COLUMNS = ("select node_id, sid, action, key, value, rationale, timestamp, round(confidence, 2) as confidence, "
                     "source_model, source from ")


def _latest(name, source, key="node_id", order="timestamp desc, ordinal desc, sid desc"):
    return (name, f"""select * exclude (rn) from (
  select *, row_number() over (partition by {key} order by {order}) as rn from {source}) where rn = 1""")


_LEDGER = _fixture("logged") + [_HUMAN, _latest("decisions", "human")]

# --- packages
_ASSUMPTIONS = ("assumptions", """
select sid, position, kind, name, value, "constraint" from (
  select *, row_number() over (partition by sid order by kind, age, tie) as position from (
    select sid, 0 as kind, -timestamp as age, node_id as tie, key as name, value, rationale as "constraint" from decisions
    union all
    select sid, 1, 0, file_path, concat('file.', file_path),
      concat(content_hash, ':', cast(lines_of_code as varchar), ':', language), '' from snapshots))""")
_INVARIANTS = ("invariants", """
select sid, position, concat('fix_', error_type) as name,
  concat(error_type, ' at ', coalesce(file_path, '?'), ':', cast(greatest(line_number, 0) as varchar), ' — ', message) as condition
from recent""")
_PACKAGE = _SNAPSHOTS + _LEDGER + _ERRORS + [_RECENT, _ASSUMPTIONS, _INVARIANTS]

# --- full text
_TOKEN_RX = r"[^\p{L}\p{N}]+"
_POSTINGS = _FILES + [("postings", f"""
select file_path, sid, field, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos from (
  select file_path, sid, field, list_filter(string_split_regex(lower(strip_accents(body)), '{_TOKEN_RX}'), lambda x: x <> '') as tokens from (
    select file_path, sid, 'file_path' as field, file_path as body from files
    union all select file_path, sid, 'content', content from files
    union all select file_path, sid, 'sid', sid from files))""")]
_HITS = [("words", """
select query_id, unnest(w) as word, len(w) as n_words from (
  select query_id, list_distinct(string_split(lower(strip_accents(query_text)), ' ')) as w from questions
  where regexp_matches(query_text, '^[0-9A-Za-zÀ-ɏ ]+$') and len(query_text) > 0)"""), ("hits", """
select query_id, file_path, sid from words join (select distinct file_path, sid, token from postings) on word = token
group by query_id, file_path, sid, n_words having count(distinct word) = n_words""")]

_REPORT_METRICS = ("metrics", """
select sid, cast(sum(files) as bigint) as files, cast(sum(functions) as bigint) as functions, cast(sum(queries) as bigint) as queries,
  cast(sum(api_calls) as bigint) as api_calls, cast(sum(errors) as bigint) as errors from (
  select sid, 1 as files, 0 as functions, 0 as queries, 0 as api_calls, 0 as errors from snapshots
  union all select sid, 0, cast(log_key = 'function.declared' as int), cast(log_key = 'database.query' as int),
    cast(log_key = 'api.called' as int), 0 from found
  union all select sid, 0, 0, 0, 0, 1 from errors) group by sid""")

_CHANGED = _fixture("scans") + [("seen", """
select *, lag(mtime) over (partition by file_path order by scan_no) as previous_mtime from scans""")]
_CHANGED_SQL = _with(*_CHANGED, then="select scan_no, file_path, mtime, previous_mtime from seen where mtime <> previous_mtime")

_RANK = "row_number() over (partition by query_id order by score desc, {tie}) as rank"
_FILES_TOPK = _with(*_FILES, _FILE_VECTORS, _PASSAGE_VECTORS, _scores("scores", "file_vectors", "query_vectors", 0.01), then=f"""
select query_id, sid, file_path, score, rank from (
  select query_id, sid, file_path, score, {_RANK.format(tie='file_path')} from scores join files on file_path = item) where rank <= 10""")

_COUNTS_SQL = _with(*_POSTINGS, then="select token, count(distinct file_path) as documents, count(*) as occurrences from postings group by token")
_BATCH_SQL = _with(*_POSTINGS, *_fixture("questions"), *_HITS, then="select query_id, file_path, sid from hits")
_CLAUSE_CTES = [*_POSTINGS, ("s", "select source, 3 * min(doc_id) as q from documents group by source"),
                ("f", "select distinct file_path, sid from postings")]
_CLAUSE_HITS = """
select q as query_id, file_path, sid from s cross join f
where exists (select 1 from postings p where p.file_path = f.file_path and p.token in (s.source, 'curl'))
  and not exists (select 1 from postings p where p.file_path = f.file_path and p.field = 'content' and p.token in ('la', 'der'))
union all
select q + 1, file_path, sid from s cross join f
where exists (select 1 from postings a join postings b on a.file_path = b.file_path and a.field = b.field and b.pos = a.pos + 1
              where a.file_path = f.file_path and a.field = 'content' and a.token = 'select' and b.token = '1')
  and exists (select 1 from postings p where p.file_path = f.file_path and p.field = 'file_path' and p.token = 'src')
  and exists (select 1 from postings p where p.file_path = f.file_path and p.field = 'file_path' and p.token = s.source)
union all
select q + 2, file_path, sid from s cross join f
where exists (select 1 from postings p where p.file_path = f.file_path and (starts_with(p.token, 'cur') or starts_with(p.token, 'sqlit')))
  and exists (select 1 from postings p where p.file_path = f.file_path and p.token = s.source)
  and exists (select 1 from postings p where p.file_path = f.file_path and p.token = 'the')"""
_CLAUSES_SQL = _with(*_CLAUSE_CTES, then=_CLAUSE_HITS)

_DIFF_SQL = _with(*_fixture("scans"), then="""
select file_path, case when a.mtime is null then 'added' when b.mtime is null then 'removed' else 'changed' end as change
from (select * from scans where scan_no = 1) a full outer join (select * from scans where scan_no = 3) b using (file_path)
where a.mtime is distinct from b.mtime""")

SQL = {
    "snapshot_files": _with(*_SNAPSHOTS, then="select * exclude (content) from snapshots"),
    "language_counts": _with(*_SNAPSHOTS, then="select sid, language, count(*) as files, cast(sum(lines_of_code) as bigint) as lines_of_code from snapshots group by sid, language"),
    "embed_sparse": _with(*_FILES, _FILE_VECTORS, then="select key as file_path, cast(dim as bigint) as dim, round(weight, 6) as weight from file_vectors"),
    "cosine_topk": """
with cells as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from embeddings),
means as (select label as query_id, dim, avg(x) as x from cells group by label, dim),
norms as (select vec_id, sqrt(sum(x * x)) as norm from cells group by vec_id),
mean_norms as (select query_id, sqrt(sum(x * x)) as norm from means group by query_id),
dots as (select m.query_id, c.vec_id, sum(m.x * c.x) as dot from means m join cells c using (dim) group by m.query_id, c.vec_id),
scores as (select query_id, vec_id, round(dot / (n.norm * m.norm + 1e-8), 6) as score
  from dots join norms n using (vec_id) join mean_norms m using (query_id) where dot / (n.norm * m.norm + 1e-8) > 0)
select cast(query_id as bigint) as query_id, vec_id, score, rank from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 10""",
    "cosine_topk_indexed": """
with cells as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from embeddings),
norms as (select vec_id, sqrt(sum(x * x)) as norm from cells group by vec_id),
dots as (select a.vec_id as query_id, b.vec_id, sum(a.x * b.x) as dot from cells a join cells b using (dim) group by a.vec_id, b.vec_id),
scores as (select query_id, d.vec_id, round(dot / (n.norm * m.norm + 1e-8), 6) as score
  from dots d join norms n on n.vec_id = d.vec_id join norms m on m.vec_id = query_id where dot / (n.norm * m.norm + 1e-8) > 0)
select query_id, vec_id, score, rank from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 10""",
    "similar_files_topk": _FILES_TOPK,
    "similar_files_topk_blocks": _FILES_TOPK,
    "similar_files_in_sessions": _FILES_TOPK.replace("partition by query_id order", "partition by query_id, sid order").replace(
        "where rank <= 10", "where rank <= 10 and sid in ('de', 'en')"),
    "similar_files_hybrid": _with(
        *_POSTINGS, *_fixture("questions"), *_HITS, _FILE_VECTORS, _vectors("query_vectors", "questions", "query_id", "query_text"),
        _scores("scores", "file_vectors", "query_vectors", 0.01), then=f"""
select query_id, sid, file_path, score, rank from (
  select query_id, sid, file_path, score, {_RANK.format(tie='file_path')} from (
    select query_id, sid, file_path, score from scores join files on file_path = item
    union all
    select query_id, sid, file_path, 0.99 from hits h
    where not exists (select 1 from scores s where s.query_id = h.query_id and s.item = h.file_path))) where rank <= 10"""),
    "search_decisions": _with(
        *_LEDGER, _vectors("decision_vectors", "decisions", "node_id", "concat(key, ' ', value, ' ', rationale)"), _PASSAGE_VECTORS,
        _scores("scores", "decision_vectors", "query_vectors", 0.1), then=f"""
select query_id, sid, node_id, key, value, score, rank, cast(round(score * 100) as bigint) as percent from (
  select query_id, sid, node_id, key, value, score, {_RANK.format(tie='node_id')} from scores join decisions on node_id = item) where rank <= 20"""),
    "postings_counts": _COUNTS_SQL,
    "text_search_and": _with(*_POSTINGS, then="select file_path from postings where token in ('the', 'execute', 'cursor') group by file_path having count(distinct token) = 3"),
    "text_search_or": _with(*_POSTINGS, then="select distinct file_path from postings where token in ('curl', 'cursor', 'src3')"),
    "text_search_not": _with(*_POSTINGS, then="select distinct file_path from postings where token = 'de' and file_path not in (select file_path from postings where token in ('la', 'the'))"),
    "text_search_phrase": _with(*_POSTINGS, then="select distinct a.file_path from postings a join postings b on a.file_path = b.file_path and a.field = b.field and b.pos = a.pos + 1 where a.token = 'select' and b.token = '1'"),
    "text_search_prefix": _with(*_POSTINGS, then="select distinct file_path from postings where starts_with(token, 'curl')"),
    "text_search_field": _with(*_POSTINGS, then="select distinct file_path from postings where field = 'sid' and token = 'en'"),
    "text_search_session": _with(*_POSTINGS, then="select distinct file_path from postings where token in ('cursor', 'curl') and sid = 'de'"),
    "text_search_batch": _BATCH_SQL,
    "text_search_clauses": _CLAUSES_SQL,
    "text_search_stored_batch": _BATCH_SQL,
    "text_search_stored_clauses": _CLAUSES_SQL,
    "stored_postings_counts": _COUNTS_SQL,
    "similar_files_clauses": _with(
        *_CLAUSE_CTES, ("hits", _CLAUSE_HITS), ("asked", """
select q + k as query_id, source as query_text from s cross join (values (0), (1), (2)) t(k)"""),
        _FILE_VECTORS, _vectors("query_vectors", "asked", "query_id", "query_text"),
        _scores("scores", "file_vectors", "query_vectors", 0.01), ("ranked", """
select query_id, sid, file_path, score from scores join files on file_path = item
union all
select query_id, sid, file_path, 0.99 from hits h
where not exists (select 1 from scores s where s.query_id = h.query_id and s.item = h.file_path)"""), then=f"""
select query_id, sid, file_path, score, rank from (select *, {_RANK.format(tie='file_path')} from ranked) where rank <= 10
union all
select query_id + {fixtures.NAMED}, sid, file_path, score, rank from (
  select *, {_RANK.format(tie='file_path').replace('query_id order', 'query_id, sid order')} from ranked where sid in ('de', 'en')) where rank <= 10"""),
    "pattern_matches": _with(*_PATTERNS, then="select sid, file_path, pattern_name, matched_text, line_number, log_key from found"),
    "pattern_wildcard_rule": """
with lines as (select url as file_path, unnest(string_split(html, chr(10))) as line,
  generate_subscripts(string_split(html, chr(10)), 1) as line_number from pages),
found as (select file_path, line_number, unnest(regexp_extract_all(line, 'href="[^"]+"')) as m from lines)
select file_path, 'link.found' as log_key, count(*) as links, cast(sum(line_number) as bigint) as line_sum, count(distinct m) as distinct_links
from found group by file_path""",
    "pattern_decisions": _with(*_PATTERNS, _PATTERN_DECISIONS, _latest("merged", "from_patterns"), then=_DECISION_COLUMNS + "merged"),
    "log_sessions": _with(*_SESSIONS, then="select session_id, sid, command, output, cast(exit_code as bigint) as exit_code, timestamp from sessions"),
    "session_vectors": _with(*_SESSIONS, _vectors("v", "sessions", "session_id", "concat(command, ' ', output)"), then="select key as session_id, count(*) as dims, round(sum(weight), 4) as total from v group by key"),
    "parse_tracebacks": _with(*_FOUND, then=_ERROR_COLUMNS + "tracebacks"),
    "parse_compiler_lines": _with(*_FOUND, then=_ERROR_COLUMNS + "compiled"),
    "generic_failures": _with(*_FOUND, then="select session_id, sid, error_type, message, command, exit_code from generic"),
    "parse_logs": _with(*_ERRORS, then=_ERROR_COLUMNS + "errors"),
    "parse_log_chunks": _with(*_ERRORS, then=_ERROR_COLUMNS + "errors"),
    "log_chunk_sessions": _with(*_SESSIONS, then="select session_id, sid, command, cast(exit_code as bigint) as exit_code, timestamp from sessions"),
    "parse_log_files": _with(*_fixture("log_lines"), ("kinds", _LINES), ("logs", """
select sid, count_if(kind = 'traceback') as tracebacks, count_if(kind = 'compiler') as compiled,
  count(distinct (event_id % 70, event_id % 50)) filter (where kind = 'traceback') as traceback_errors,
  count(distinct (p[1], p[2], substr(line, length(p[1]) + length(p[2]) + length(p[3]) + 4))) filter (where kind = 'compiler') as compiler_errors,
  max(cast(contains(line, 'error:') or contains(line, 'Error:') or contains(line, 'Traceback') as bigint)) as exit_code
from (select *, string_split(line, ':') as p from kinds) group by sid"""), then="""
select sid as name, 'make all' as command, exit_code,
  case when tracebacks > 0 then traceback_errors when compiled > 0 then compiler_errors else exit_code end as errors from logs"""),
    "rule_files": """
with s as (select distinct source from documents)
select 'same' as pattern_name, 'c' as language, '' as action, '' as log_key, source as regex, 1 as usable from s
union all select 'same', '', '', 'b', concat('(', source), 0 from s
union all select 'last', '', 'log', '', 'x=y', 1 from s""",
    "index_tree": _with(*_SNAPSHOTS, then="""
select file_path, sid, lines_of_code, content_hash, case when doc_id % 3 = 0 then 'unreadable' else '' end as reason
from snapshots join (select file_path, doc_id from files) using (file_path)"""),
    "workspace_postings": _COUNTS_SQL,
    "index_folder": _with(*_SNAPSHOTS, then="select file_path, 'folder' as sid, language, last_modified, lines_of_code, content_hash from snapshots where content is not null"),
    "analyze_file": _with(*_fixture("all_files"), then="""
select file_path, 'one' as sid, 'unknown' as language, cast(length(content) - length(replace(content, chr(10), '')) as bigint) as lines_of_code,
  sha256(content) as content_hash from all_files
where file_path = (select min(file_path) from all_files where doc_id % 14 = 11 and doc_id % 23 <> 0)"""),
    "workspace_session": _with(*_SNAPSHOTS, then="select * exclude (content) from snapshots where sid = 'de'"),
    "watched_folders": _WATCHED,
    "workspace_reports": _with(
        *_PATTERNS, *_fixture("logged"), _HUMAN, _PATTERN_DECISIONS, _latest("decided", "(select * from human union all by name select * from from_patterns)"), then="""
select 'reports' as metric, 2 * count(distinct sid) as n from snapshots
union all select 'packages', count(distinct sid) from (select sid from decided union all select sid from snapshots)
union all select 'imported', count(distinct (key, value)) from (
  select key, value from decided union all
  select concat('file.', file_path), concat(content_hash, ':', cast(lines_of_code as varchar), ':', language) from snapshots)"""),
    "errors_reparsed": _with(*_ERRORS, then=_ERROR_COLUMNS + "errors"),
    "errors_by_session": _with(*_ERRORS, then="select sid, session_id, error_type, file_path, line_number, column_number, message, timestamp, strftime(to_timestamp(timestamp) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as logged_at from errors"),
    "recent_distinct_errors": _with(*_ERRORS, _RECENT, then="select sid, position, error_type, file_path, line_number, message, timestamp from recent"),
    "clear_errors": _with(*_ERRORS, then=_ERROR_COLUMNS + "errors where sid <> 'u10'"),
    "clear_errors_count": _with(*_ERRORS, then="select count(*) as deleted from errors where sid = 'u10'"),
    "upsert_decisions": _with(*_LEDGER, then=_DECISION_COLUMNS + "decisions"),
    "upsert_decisions_per_session": _with(*_fixture("logged"), _HUMAN, _latest("d", "human", "sid, node_id"), then=_DECISION_COLUMNS + "d"),
    "decision_ledger": _with(
        *_PATTERNS, *_ERRORS, *_fixture("logged"), _HUMAN, _PATTERN_DECISIONS, _ERROR_DECISIONS, _CHANGE_DECISIONS,
        ("produced", "select * from human union all by name select * from from_patterns union all by name select * from from_errors union all by name select * from from_changes"),
        _latest("merged", "produced"), then=_DECISION_COLUMNS + "merged"),
    "list_decisions": _with(*_LEDGER, then="""
select sid, node_id, key, action, confidence, cast(round(confidence * 100) as bigint) as confidence_percent,
  substr(value, 1, 63) as value_short, value, timestamp, strftime(to_timestamp(timestamp) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as logged_at from decisions"""),
    "snapshot_takeover": _with(*_SNAPSHOTS, ("taken", "select s.* exclude (content, sid), case when f.doc_id in (select doc_id from labels) then 'second' else s.sid end as sid from snapshots s join files f using (file_path)"), then="select * from taken"),
    "session_report": _with(*_PATTERNS, *_ERRORS, _REPORT_METRICS, then=f"""
select sha256(concat(sid, '_{NOW}')) as report_id, sid, cast({NOW} as bigint) as generated_at,
  concat('=== Analysis Report (session: ', sid, ') ===', chr(10), 'Files indexed   : ', files, chr(10), 'Functions found : ', functions, chr(10),
    'DB queries      : ', queries, chr(10), 'API calls       : ', api_calls, chr(10), 'Errors logged   : ', errors, chr(10)) as report_text,
  concat('{{"files":', files, ',"functions":', functions, ',"queries":', queries, ',"api_calls":', api_calls, ',"errors":', errors, '}}') as metrics,
  files, functions, queries, api_calls, errors from metrics"""),
    "status": _with(*_PATTERNS, *_ERRORS, *_LEDGER, then=" union all ".join(
        f"select '{m}' as metric, count(*) as n from {t}" for m, t in (
            ("files", "snapshots"), ("patterns", "found"), ("decisions", "decisions"), ("sessions", "sessions"), ("errors", "errors")))),
    "workspace_status": _with(
        *_PATTERNS, *_ERRORS, *_fixture("logged"), _HUMAN, _PATTERN_DECISIONS, _ERROR_DECISIONS, then="""
select 'snapshots' as metric, count(*) as n from snapshots
union all select 'patterns', count(*) from found
union all select 'decisions', count(distinct node_id) from (
  select node_id from human union all select node_id from from_patterns union all select node_id from from_errors)
union all select 'sessions', count(*) from sessions
union all select 'errors', count(*) from errors where sid <> 'u10'
union all select 'packages', 0"""),
    "package_assumptions": _with(*_PACKAGE, then="select sid, position, name, value, \"constraint\" from assumptions"),
    "package_invariants": _with(*_PACKAGE, then="select sid, position, name, condition from invariants"),
    "package_preamble": _with(*_PACKAGE, then=f"""
select sha256(concat(sid, '_5.0.0_{NOW}')) as package_id, sid, '5.0.0' as version,
  concat('=== SESSION RESUME (v5.0.0) ===', chr(10), 'Session: ', sid, chr(10), 'Decisions: ', coalesce(d, 0), '  |  Errors: ', coalesce(e, 0),
    '  |  Files: ', coalesce(f, 0), chr(10), chr(10),
    case when e > 0 then concat('--- ERRORS TO FIX ---', chr(10), error_lines, chr(10)) else '' end,
    '--- KEY DECISIONS ---', chr(10), coalesce(decision_lines, '')) as preamble
from (select sid, count(*) filter (where kind = 0) as d, count(*) filter (where kind = 1) as f,
        string_agg(concat('  ', name, ' = ', value, chr(10)), '' order by position) filter (where kind = 0) as decision_lines
      from assumptions group by sid)
full outer join (select sid, count(*) as e, string_agg(concat('  [', position, '] ', condition, chr(10)), '' order by position) as error_lines
      from invariants group by sid) using (sid)"""),
    "package_round_trip": _with(*_PACKAGE, then="""
select sid, 'assumption' as kind, position, name, value, "constraint" as extra from assumptions
union all select sid, 'invariant', position, name, condition, '' from invariants"""),
    "import_decisions": _with(*_PACKAGE, ("imported", f"""
select {_NODE}, *, cast(1 as int) from (select sid, 'sid_import' as action, name as key, value, concat('Imported from SID: ', "constraint") as rationale,
  cast({NOW} as bigint) as timestamp, cast(0.95 as double) as confidence, 'sid_import' as source_model, cast(6 as bigint) as source, position as ordinal from assumptions)"""),
        _latest("merged", "imported"), then=_DECISION_COLUMNS + "merged"),
    "changed_files": _CHANGED_SQL,
    "changed_files_stream": _CHANGED_SQL,
    "changed_files_stream_with_new": _with(*_CHANGED, then="select scan_no, file_path, mtime, coalesce(previous_mtime, -1) as previous_mtime from seen where mtime <> previous_mtime or previous_mtime is null"),
    "changed_files_with_new": _with(*_CHANGED, then="select scan_no, file_path, mtime, coalesce(previous_mtime, -1) as previous_mtime from seen where mtime <> previous_mtime or (previous_mtime is null and scan_no > 1)"),
    "snapshot_diff": _DIFF_SQL,
    "snapshot_diff_folders": _DIFF_SQL,
    "pattern_many_rules": _with(*_FILES, ("rules", """
select concat('p', item_id) as pattern_name, concat(lower(split_part(text, ' ', 1)), ' [a-z]+') as rx from benchmark
where regexp_full_match(split_part(text, ' ', 1), '[A-Za-z]{4,}')"""),
        ("lines", """select sid, file_path, unnest(string_split(content, chr(10))) as line,
  generate_subscripts(string_split(content, chr(10)), 1) as line_number from files"""), then="""
select sid, file_path, pattern_name, unnest(regexp_extract_all(line, rx, 0)) as matched_text, line_number, 'word.found' as log_key
from lines join rules on contains(line, replace(rx, '[a-z]+', ''))"""),
}
