"""Independent SQL (DuckDB dialect) for every registered query.

These strings re-derive the note tables from the driver's test tables and
answer each query in plain SQL; the verification harness runs them next to
the Spark plans and compares results. DuckDB's regex engine is ASCII-only for
word classes, so for word-boundary patterns non-ASCII letters and numbers are
first replaced by '_' (a word character), which reproduces Unicode word
boundaries for the ASCII-only matches these patterns produce.
"""

from __future__ import annotations

import re

from cairn import schema as S

AS_OF = S.AS_OF_SQL
WS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WS_CHARS = WS[1:-1]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


CATS = sql_list(S.CATEGORIES)
RULES = ", ".join(q(c) for c in S.RULE_CATEGORIES)
STOP = sql_list(S.ACRONYM_STOPWORDS)
TECH = "|".join(re.escape(w) for grp in S.TECH_TERMS for w in grp)


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS}+'), lambda w: w <> '')"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def ascii_words(e: str) -> str:
    """Non-ASCII letters and numbers -> '_' so that ASCII \\b equals Unicode \\b."""
    return (f"regexp_replace(regexp_replace({e}, '[^\\x00-\\x7F\\PL]', '_', 'g'), "
            f"'[^\\x00-\\x7F\\PN]', '_', 'g')")


def summary_sql(title: str, content: str) -> str:
    first = strip_ws(f"split_part({content}, '.', 1)")
    return f"""(SELECT substring(CASE WHEN least(len(w), 20) < 5 THEN {title} || ': ' || body ELSE body END, 1, 200)
      FROM (SELECT w, CASE WHEN len(w) <= 20 THEN f ELSE array_to_string(w[1:20], ' ') || '...' END AS body
            FROM (SELECT f, {words('f')} AS w FROM (SELECT {first} AS f))))"""


def entities_sql(text: str) -> str:
    return f"""(SELECT list_sort(list_distinct(flatten([
        regexp_extract_all(ta, '\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b'),
        list_filter(regexp_extract_all(ta, '\\b[A-Z]{{2,}}\\b'), lambda x: NOT list_contains({STOP}, x)),
        regexp_extract_all(t, '[@#][\\pL\\pN_]+'),
        regexp_extract_all(t, '"([^"]{{2,30}})"', 1),
        regexp_extract_all(t, '''([^'']{{2,30}})''', 1),
        regexp_extract_all(ta, '\\b(?:{TECH})\\b')])))
      FROM (SELECT t, {ascii_words('t')} AS ta FROM (SELECT {text} AS t)))"""


def ttl_days_sql(cat: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in S.TTL_DAYS.items())
    return f"(CASE {cat} {whens} END)"


def expiry_sql(cat: str, prio: str, base: str) -> str:
    d = ttl_days_sql(cat)
    n = (f"(CASE WHEN {prio} >= 2 THEN NULL WHEN {prio} = 1 THEN CAST(floor({d} * 1.5) AS INTEGER) "
         f"ELSE {d} END)")
    return f"({base} + to_days({n}))"


def rule_priority_sql(cat: str, prio: str) -> str:
    return f"(CASE WHEN {cat} IN ({RULES}) THEN greatest({prio}, 2) ELSE {prio} END)"


def tokens_sql(content: str) -> str:
    return f"CAST(greatest(1, floor(length({content}) / 4)) AS INTEGER)"


def slugify_sql(e: str) -> str:
    s = strip_ws(f"lower({e})")
    s = f"regexp_replace({s}, '[^a-z0-9{WS_CHARS}-]', '', 'g')"
    s = f"regexp_replace({s}, '[{WS_CHARS}_]+', '-', 'g')"
    s = f"regexp_replace({s}, '-+', '-', 'g')"
    return f"regexp_replace({s}, '\\A-+|-+\\z', '', 'g')"


def round_sql(e: str, places: int = 4) -> str:
    m = float(10 ** places)
    return f"(CAST(floor(({e}) * {m!r} + 0.5) AS DOUBLE) / {m!r})"


def snap_sql(e: str) -> str:
    return round_sql(e, 12)


def recency_sql(ts: str) -> str:
    days = f"coalesce(greatest(0.0, CAST(date_diff('microsecond', {ts}, {AS_OF}) AS DOUBLE) / 86400000000.0), 0.0)"
    return f"(1.0 / (1.0 + 0.1 * {days}))"


def access_sql(n: str) -> str:
    return f"least(1.0, CAST({n} AS DOUBLE) / 10.0)"


def relevance_sql(sim: str, ts: str, n: str) -> str:
    return f"(0.7 * ({sim}) + 0.15 * {recency_sql(ts)} + 0.15 * {access_sql(n)})"


# ------------------------------------------------------------- adapters

MEMORIES_BASE = f"""
SELECT d.doc_id,
       'p' || CAST(d.doc_id % 4 AS VARCHAR) AS project,
       CAST(d.doc_id AS VARCHAR) AS id,
       {CATS}[CAST(d.doc_id % 11 AS INTEGER) + 1] AS category,
       array_to_string({words('d.text')}[1:6], ' ') AS title,
       d.text AS content,
       CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE [d.lang, d.source] END AS tags,
       CAST(NULL AS VARCHAR) AS metadata,
       e.embedding,
       CASE WHEN d.doc_id % 17 = 0 THEN 'archived' ELSE 'active' END AS status,
       CAST(CASE WHEN d.doc_id % 23 = 0 THEN 2 WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS raw_priority,
       CASE WHEN d.doc_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS source,
       CAST([] AS VARCHAR[]) AS related_ids,
       CAST(coalesce(v.n_views // 2, 0) AS INTEGER) AS access_count,
       {AS_OF} - to_days(CAST(CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 10 ELSE d.doc_id % 400 END AS INTEGER)) AS created_at
FROM documents d
LEFT JOIN embeddings e ON e.vec_id = d.doc_id
LEFT JOIN (SELECT user_id, count(*) AS n_views FROM events WHERE event_type = 'view' GROUP BY user_id) v
       ON v.user_id = d.doc_id
"""

MEMORIES = f"""
SELECT project, id, category, title, content,
       {summary_sql('title', 'content')} AS summary,
       tags, metadata, embedding, status,
       CAST({rule_priority_sql('category', 'raw_priority')} AS INTEGER) AS priority,
       source, related_ids,
       {entities_sql("title || ' ' || content")} AS entities,
       access_count,
       {expiry_sql('category', rule_priority_sql('category', 'raw_priority'), 'created_at')} AS expires_at,
       created_at,
       created_at + to_hours(CAST(doc_id % 7 AS INTEGER)) AS updated_at
FROM ({MEMORIES_BASE})
"""

SEARCH_QUERIES = f"""
SELECT vec_id AS query_id,
       'p' || CAST(vec_id % 4 AS VARCHAR) AS project,
       embedding,
       CASE WHEN vec_id % 5 = 0 THEN {CATS}[CAST(vec_id % 11 AS INTEGER) + 1] END AS category,
       CASE WHEN vec_id % 3 = 0 THEN ['en'] END AS tags,
       'active' AS status,
       5 AS q_limit,
       CASE WHEN vec_id % 2 = 0 THEN 0.1 ELSE 0.2 END AS min_similarity,
       1000 AS token_budget
FROM embeddings
"""

SESSION_EVENTS = """
SELECT 'p' || CAST(user_id % 4 AS VARCHAR) AS project, event_id AS seq, ts,
       CASE WHEN event_type = 'signup' THEN 'start' ELSE 'end' END AS kind,
       last_value(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS)
           OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_id,
       CASE WHEN event_type = 'purchase' THEN props END AS summary,
       CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS INTEGER) END AS memories_created,
       CASE WHEN event_type = 'purchase' THEN CAST(event_id % 7 AS INTEGER) END AS memories_accessed
FROM events WHERE event_type IN ('signup', 'purchase')
"""

PROVENANCE = """
SELECT 'p' || CAST(user_id % 4 AS VARCHAR) AS project, CAST(user_id AS VARCHAR) AS memory_id,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' WHEN 'view' THEN 'access'
            WHEN 'error' THEN 'soft_delete' WHEN 'purchase' THEN 'reembed' END AS operation,
       props AS details, ts AS created_at, event_id AS op_seq
FROM events
"""

REGISTRY = """
SELECT 'u' || CAST(user_id AS VARCHAR) AS slug, 'User ' || CAST(user_id AS VARCHAR) AS display_name,
       CASE WHEN user_id % 2 = 0 THEN 'Notes of user ' || CAST(user_id AS VARCHAR) END AS description,
       min(ts) AS created_at, max(ts) AS last_accessed,
       'projects/u' || CAST(user_id AS VARCHAR) AS db_path
FROM events GROUP BY user_id
"""


def with_tables(body: str, *names: str) -> str:
    """Prefix a query with the adapter CTEs it uses."""
    defs = {"memories": MEMORIES, "search_queries": SEARCH_QUERIES, "session_events": SESSION_EVENTS,
            "provenance": PROVENANCE, "registry": REGISTRY}
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in names)
    return f"WITH {ctes}\n{body}"


# --------------------------------------------------------------- search

def _search_hits(min_filter: bool = True) -> str:
    """CTE list (without WITH) producing ``hits`` for C1."""
    mf = "AND 1.0 - distance >= min_similarity" if min_filter else ""
    return f"""
live AS (SELECT * FROM memories
         WHERE (expires_at IS NULL OR expires_at > {AS_OF}) AND embedding IS NOT NULL AND len(embedding) > 0),
pairs AS (
  SELECT q.query_id, m.project, m.id, m.category, m.tags, m.access_count, m.updated_at,
         q.min_similarity, q.q_limit, q.category AS q_category, q.tags AS q_tags,
         1.0 - floor((list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[]))
             / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
                * sqrt(list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[]))))) * 1e12 + 0.5) / 1e12 AS distance
  FROM search_queries q JOIN live m ON m.project = q.project AND m.status = q.status
  WHERE len(m.embedding) = len(q.embedding)
    AND list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])) > 0
    AND list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) > 0),
t1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank_d
       FROM pairs QUALIFY rank_d <= q_limit * 3),
filt AS (SELECT * FROM t1
         WHERE TRUE {mf}
           AND (q_category IS NULL OR q_category = '' OR category = q_category)
           AND (q_tags IS NULL OR len(q_tags) = 0 OR coalesce(list_has_any(tags, q_tags), false))),
scored AS (SELECT *, {round_sql(snap_sql('1.0 - distance'))} AS similarity,
                  {round_sql(relevance_sql(snap_sql('1.0 - distance'), 'updated_at', 'access_count'))} AS relevance_score
           FROM filt),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, distance, id) AS rank
         FROM scored QUALIFY rank <= q_limit)"""


def search_topk_sql() -> str:
    body = _search_hits(min_filter=False)
    return (f"WITH memories AS ({MEMORIES}), search_queries AS ({SEARCH_QUERIES}),{body}\n"
            f"SELECT query_id, id, CAST(rank_d AS INTEGER) AS rank_d, {round_sql(snap_sql('1.0 - distance'))} AS similarity FROM t1")


def search_sql() -> str:
    return (f"WITH memories AS ({MEMORIES}), search_queries AS ({SEARCH_QUERIES}),{_search_hits()}\n"
            "SELECT h.query_id, CAST(h.rank AS INTEGER) AS rank, h.id, m.title, h.category, h.similarity, "
            "h.relevance_score, h.access_count, m.summary, m.content\n"
            "FROM hits h JOIN memories m ON m.project = h.project AND m.id = h.id")


def search_bump_sql() -> str:
    return (f"WITH memories AS ({MEMORIES}), search_queries AS ({SEARCH_QUERIES}),{_search_hits()},\n"
            "n AS (SELECT project, id, count(*) AS hits FROM hits GROUP BY project, id)\n"
            "SELECT m.project, m.id, CAST(m.access_count + coalesce(n.hits, 0) AS INTEGER) AS access_count\n"
            "FROM memories m LEFT JOIN n ON n.project = m.project AND n.id = m.id")


def search_budgeted_sql() -> str:
    return (f"WITH RECURSIVE memories AS ({MEMORIES}), search_queries AS ({SEARCH_QUERIES}),{_search_hits()},\n"
            f"""items AS (SELECT h.query_id, CAST(h.rank AS INTEGER) AS rank, h.id, m.title, m.summary, h.category,
                  h.similarity, h.relevance_score, {tokens_sql('m.content')} AS tokens,
                  CAST(q.token_budget AS BIGINT) AS budget, m.content, m.status
           FROM hits h JOIN memories m ON m.project = h.project AND m.id = h.id
           JOIN search_queries q ON q.query_id = h.query_id),
fold AS (
  SELECT query_id, rank, tokens <= budget AS fits,
         CAST(CASE WHEN tokens <= budget THEN tokens ELSE 0 END AS BIGINT) AS used, budget
  FROM items WHERE rank = 1
  UNION ALL
  SELECT i.query_id, i.rank, f.used + i.tokens <= f.budget,
         CASE WHEN f.used + i.tokens <= f.budget THEN f.used + i.tokens ELSE f.used END, f.budget
  FROM fold f JOIN items i ON i.query_id = f.query_id AND i.rank = f.rank + 1)
SELECT i.query_id, i.rank, i.id, i.title, i.summary, i.category, i.similarity, i.relevance_score, i.tokens,
       f.fits, max(f.used) OVER (PARTITION BY i.query_id) AS tokens_used,
       bool_or(NOT f.fits) OVER (PARTITION BY i.query_id) AS has_more,
       CASE WHEN f.fits THEN i.content END AS content, CASE WHEN f.fits THEN i.status END AS status
FROM items i JOIN fold f ON f.query_id = i.query_id AND f.rank = i.rank""")


# -------------------------------------------------------------- batches

def title_sql(e: str) -> str:
    return f"array_to_string({words(e)}[1:6], ' ')"


RECALL_REQUESTS = f"""
SELECT e.event_id AS request_id, 'p' || CAST(e.user_id % 4 AS VARCHAR) AS project,
       CASE WHEN e.event_type = 'view' THEN CAST(e.user_id AS VARCHAR) END AS id,
       CASE WHEN e.event_type = 'click' THEN {title_sql('d.text')} END AS title,
       e.event_id AS op_seq
FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id
WHERE e.event_type IN ('view', 'click', 'error')
"""

STORE_BATCH = f"""
SELECT 'p' || CAST(conv_id % 4 AS VARCHAR) AS project,
       CASE WHEN role = 'system' THEN 'system_prompt' ELSE {CATS}[CAST((conv_id + turn) % 11 AS INTEGER) + 1] END AS category,
       {title_sql('text')} AS title, text AS content, [role] AS tags,
       CAST(to_json({{'conv': conv_id, 'turn': turn}}) AS VARCHAR) AS metadata,
       CAST(turn % 3 AS INTEGER) AS priority, role AS source, CAST([] AS VARCHAR[]) AS related_ids,
       conv_id * 100 + turn AS op_seq
FROM conversations
"""

PATCHES = f"""
SELECT 'p' || CAST(l.doc_id % 4 AS VARCHAR) AS project, CAST(l.doc_id AS VARCHAR) AS id,
       CASE WHEN l.quality <> 1 AND l.toxic = 1 THEN '' END AS title,
       CASE WHEN l.quality = 1 THEN d.text || ' revised.' END AS content,
       CASE WHEN l.toxic = 1 THEN CAST([] AS VARCHAR[]) END AS tags,
       CAST(NULL AS VARCHAR) AS metadata, CAST(NULL AS VARCHAR) AS status,
       CAST(CASE WHEN l.toxic = 1 THEN 3 END AS INTEGER) AS priority,
       CAST(NULL AS VARCHAR[]) AS related_ids, CAST(l.doc_id AS BIGINT) AS op_seq
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id
UNION ALL
SELECT 'p' || CAST(user_id % 4 AS VARCHAR), CAST(user_id AS VARCHAR), NULL, NULL, NULL, props, NULL,
       CAST(floor(value) % 3 AS INTEGER), NULL, event_id + 1000000000
FROM events WHERE event_type = 'click'
"""

SOFT_DELETE_IDS = """
SELECT 'p' || CAST(user_id % 4 AS VARCHAR) AS project, CAST(user_id AS VARCHAR) AS id,
       props AS reason, event_id AS op_seq
FROM events WHERE event_type = 'error'
"""

HARD_DELETE_IDS = """
SELECT 'p' || CAST(doc_id % 4 AS VARCHAR) AS project, CAST(doc_id AS VARCHAR) AS id,
       CAST(NULL AS VARCHAR) AS reason, doc_id AS op_seq
FROM labels WHERE toxic = 1
"""

IMPORT_PARSED = f"""
SELECT 'p' || CAST(doc_id % 4 AS VARCHAR) AS project,
       CASE WHEN doc_id % 10 = 1 THEN 'x' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS id,
       CASE WHEN doc_id % 10 = 3 THEN 'misc' ELSE {CATS}[CAST(doc_id % 11 AS INTEGER) + 1] END AS category,
       {title_sql('text')} AS title,
       CASE WHEN doc_id % 10 = 0 THEN text || ' edited' WHEN doc_id % 10 = 2 THEN '' ELSE text END AS content,
       [lang] AS tags, 0 AS priority, 'import' AS source, CAST(NULL AS VARCHAR) AS metadata, doc_id AS op_seq
FROM documents
"""

REGISTRY_BATCH = f"""
SELECT CASE WHEN conv_id % 3 = 0 THEN 'Team ' || CAST(conv_id AS VARCHAR)
            WHEN conv_id % 2 = 0 THEN 'U_' || CAST(conv_id AS VARCHAR) ELSE 'u' || CAST(conv_id AS VARCHAR) END AS slug,
       'Conversation ' || CAST(conv_id AS VARCHAR) || ' turn ' || CAST(turn AS VARCHAR) AS display_name,
       CASE WHEN role = 'user' THEN NULL ELSE {title_sql('text')} END AS description,
       conv_id * 100 + turn AS op_seq
FROM conversations
"""

TOUCH_EVENTS = """
SELECT 'u' || CAST(user_id AS VARCHAR) AS slug, ts FROM events WHERE event_type = 'signup'
"""

DELETE_SLUGS = """
SELECT 'u' || CAST(user_id AS VARCHAR) AS slug FROM events GROUP BY user_id
HAVING arg_max(event_type, (ts, event_id)) = 'error'
"""

_ALL = {"memories": lambda: MEMORIES, "search_queries": lambda: SEARCH_QUERIES,
        "session_events": lambda: SESSION_EVENTS, "provenance": lambda: PROVENANCE,
        "registry": lambda: REGISTRY, "recall_requests": lambda: RECALL_REQUESTS,
        "store_batch": lambda: STORE_BATCH, "patches": lambda: PATCHES,
        "soft_delete_ids": lambda: SOFT_DELETE_IDS, "hard_delete_ids": lambda: HARD_DELETE_IDS,
        "import_parsed": lambda: IMPORT_PARSED, "registry_batch": lambda: REGISTRY_BATCH,
        "touch_events": lambda: TOUCH_EVENTS, "delete_slugs": lambda: DELETE_SLUGS}


def sql(body: str, *tables: str, recursive: bool = False, extra: str = "") -> str:
    """``WITH`` the named adapter tables (and ``extra`` CTEs), then ``body``."""
    ctes = [f"{t} AS ({_ALL[t]()})" for t in tables]
    if extra:
        ctes.append(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + body


def ts_text_sql(e: str) -> str:
    return (f"(CASE WHEN {e} IS NULL THEN NULL WHEN strftime({e}, '%f') = '000000' "
            f"THEN strftime({e}, '%Y-%m-%d %H:%M:%S') ELSE strftime({e}, '%Y-%m-%d %H:%M:%S.%f') END)")


def note_id_sql(*parts: str) -> str:
    h = f"sha256(concat_ws(chr(1), {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"
    return (f"(SELECT substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-4' || substring(h, 14, 3) || '-' "
            f"|| substring(h, 17, 4) || '-' || substring(h, 21, 12) FROM (SELECT {h} AS h))")


AUTO = q(S.AUTO_CLOSE_SUMMARY)

REPLAY = f"""
starts AS (SELECT project, session_id AS id, ts AS started_at, seq AS start_seq,
                  lead(ts) OVER (PARTITION BY project ORDER BY seq) AS next_start,
                  lead(seq) OVER (PARTITION BY project ORDER BY seq) AS next_seq
           FROM session_events WHERE kind = 'start' AND ts <= {AS_OF}),
ends AS (SELECT project, session_id AS id, seq AS end_seq, ts, summary,
                coalesce(memories_created, 0) AS mc, coalesce(memories_accessed, 0) AS ma
         FROM session_events WHERE kind = 'end' AND session_id IS NOT NULL AND ts <= {AS_OF}),
je AS (SELECT s.project, s.id, arg_max_null(e.ts, e.end_seq) AS end_ts,
              arg_max_null(e.summary, e.end_seq) AS end_summary,
              arg_max_null(e.mc, e.end_seq) AS end_mc, arg_max_null(e.ma, e.end_seq) AS end_ma,
              min(e.end_seq) AS first_end_seq
       FROM starts s JOIN ends e ON e.project = s.project AND e.id = s.id AND e.end_seq > s.start_seq
       GROUP BY s.project, s.id),
sessions AS (
  SELECT s.project, s.id, s.started_at,
         CASE WHEN je.first_end_seq IS NOT NULL THEN je.end_ts ELSE s.next_start END AS ended_at,
         CASE WHEN je.first_end_seq IS NOT NULL THEN je.end_summary
              WHEN s.next_start IS NOT NULL THEN {AUTO} END AS summary,
         CAST(CASE WHEN je.first_end_seq IS NOT NULL THEN je.end_mc WHEN s.next_start IS NOT NULL THEN 0 END AS INTEGER) AS memories_created,
         CAST(CASE WHEN je.first_end_seq IS NOT NULL THEN je.end_ma WHEN s.next_start IS NOT NULL THEN 0 END AS INTEGER) AS memories_accessed,
         (s.next_start IS NOT NULL AND (je.first_end_seq IS NULL OR je.first_end_seq > s.next_seq)) AS auto_closed,
         CASE WHEN s.next_start IS NOT NULL AND (je.first_end_seq IS NULL OR je.first_end_seq > s.next_seq) THEN s.next_start END AS closed_at
  FROM starts s LEFT JOIN je ON je.project = s.project AND je.id = s.id)"""


def last_session_sql(src: str) -> str:
    return f"""
ls_all AS (SELECT project, summary, row_number() OVER (PARTITION BY project ORDER BY ended_at DESC, id DESC) AS rn
           FROM {src} WHERE ended_at IS NOT NULL),
ls_real AS (SELECT project, summary, row_number() OVER (PARTITION BY project ORDER BY ended_at DESC, id DESC) AS rn
            FROM {src} WHERE ended_at IS NOT NULL AND summary IS NOT NULL AND summary <> {AUTO}),
last_session AS (SELECT a.project, CASE WHEN a.summary = {AUTO} THEN b.summary ELSE a.summary END AS last_session_summary
                 FROM (SELECT * FROM ls_all WHERE rn = 1) a LEFT JOIN (SELECT * FROM ls_real WHERE rn = 1) b
                 ON a.project = b.project)"""


RULES_SPLIT = """
rules AS (SELECT * FROM memories WHERE category IN ('mandatory_rules', 'forbidden_rules') AND status = 'active'),
rules_split AS (
  SELECT r.project, r.category, CAST(row_number() OVER (PARTITION BY r.project, r.category
              ORDER BY r.priority DESC NULLS LAST, r.created_at ASC NULLS LAST, r.id) AS INTEGER) AS position,
         r.id, r.priority, r.created_at, c.n_mandatory, c.n_forbidden, c.total
  FROM rules r JOIN (SELECT project, count(*) FILTER (WHERE category = 'mandatory_rules') AS n_mandatory,
                            count(*) FILTER (WHERE category = 'forbidden_rules') AS n_forbidden, count(*) AS total
                     FROM rules GROUP BY project) c ON c.project = r.project)"""


def top_sql(name: str, where: str, order: str, n: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY {order}) AS INTEGER) AS position
                       FROM memories WHERE {where}) WHERE position <= {n})"""


SPRINT_TOP = top_sql("sprint_top", "category = 'sprint' AND status = 'active'",
                     "priority DESC NULLS LAST, updated_at DESC NULLS LAST, id", S.ACTIVE_SPRINT_CAP)
DECISIONS_TOP = top_sql("decisions_top",
                        f"category = 'decision' AND status = 'active' AND created_at >= {AS_OF} - INTERVAL 7 DAY",
                        "created_at DESC NULLS LAST, id", S.RECENT_DECISIONS_CAP)


def overlay_sql() -> str:
    """J5 in SQL: last non-null per field and the texts used for derivation."""
    fields = ["title", "content", "tags", "metadata", "status", "priority", "related_ids"]
    given = " OR ".join(f"{f} IS NOT NULL" for f in fields)
    lnn = ",\n       ".join(f"arg_max({f}, op_seq) FILTER (WHERE {f} IS NOT NULL) AS p_{f}" for f in fields)
    return f"""
keyed AS (SELECT p.* FROM patches p WHERE EXISTS (SELECT 1 FROM memories m WHERE m.project = p.project AND m.id = p.id)),
valid AS (SELECT * FROM keyed WHERE {given}),
kstar AS (SELECT project, id, max(op_seq) FILTER (WHERE title IS NOT NULL OR content IS NOT NULL) AS k_star
          FROM valid GROUP BY project, id),
agg AS (SELECT v.project, v.id, {lnn},
       max(k.k_star) AS k_star,
       arg_max_null(v.title, v.op_seq) FILTER (WHERE v.op_seq = k.k_star) AS k_title,
       arg_max_null(v.content, v.op_seq) FILTER (WHERE v.op_seq = k.k_star) AS k_content,
       arg_max(v.title, v.op_seq) FILTER (WHERE v.op_seq < k.k_star AND v.title IS NOT NULL) AS prev_title,
       arg_max(v.content, v.op_seq) FILTER (WHERE v.op_seq < k.k_star AND v.content IS NOT NULL) AS prev_content,
       count(*) AS n_patches
  FROM valid v JOIN kstar k ON k.project = v.project AND k.id = v.id GROUP BY v.project, v.id),
overlay AS (
  SELECT m.project, m.id, m.category, m.summary, m.entities, m.embedding, m.source, m.access_count,
         m.expires_at, m.created_at, m.updated_at,
         {", ".join(f"coalesce(a.p_{f}, m.{f}) AS {f}" for f in fields)},
         a.k_star IS NOT NULL AS text_changed,
         CASE WHEN a.k_title IS NULL OR a.k_title = '' THEN coalesce(a.prev_title, m.title) ELSE a.k_title END AS derive_title,
         CASE WHEN a.k_content IS NULL OR a.k_content = '' THEN coalesce(a.prev_content, m.content) ELSE a.k_content END AS derive_content,
         a.n_patches
  FROM memories m JOIN agg a ON a.project = m.project AND a.id = m.id)"""


VALID_SLUG_RE = "(?:[a-z0-9][a-z0-9-]*[a-z0-9]|[a-z0-9])\\n?"

STORE_NOTES = f"""
store_ok AS (SELECT * FROM store_batch WHERE category IN (SELECT unnest({CATS}))),
store_notes AS (
  SELECT project, {note_id_sql('project', 'title', 'content', 'op_seq', "'store'")} AS id, category, title, content,
         {summary_sql('title', 'content')} AS summary,
         coalesce(tags, CAST([] AS VARCHAR[])) AS tags,
         CASE WHEN metadata IN ('{{}}', 'null') THEN NULL ELSE metadata END AS metadata,
         'active' AS status,
         CAST({rule_priority_sql('category', 'coalesce(priority, 0)')} AS INTEGER) AS priority,
         coalesce(source, 'assistant') AS source,
         {entities_sql("title || ' ' || content")} AS entities,
         0 AS access_count,
         {expiry_sql('category', rule_priority_sql('category', 'coalesce(priority, 0)'), AS_OF)} AS expires_at,
         {AS_OF} AS created_at, op_seq
  FROM store_ok)"""


def json_string_sql(e: str) -> str:
    s = f"replace({e}, '\\', '\\\\')"
    s = f"replace({s}, '\"', '\\\"')"
    s = f"replace({s}, chr(10), '\\n')"
    s = f"replace({s}, chr(13), '\\r')"
    s = f"replace({s}, chr(9), '\\t')"
    return f"('\"' || {s} || '\"')"


def render_sql() -> str:
    """N5 over the columns of ``memories``."""
    opt = lambda cond, val: f"CASE WHEN {cond} THEN [{val}] ELSE CAST([] AS VARCHAR[]) END"
    return f"""array_to_string(flatten([
  ['---', 'id: ' || id, 'category: ' || category, 'title: "' || title || '"', 'status: ' || status,
   'priority: ' || CAST(priority AS VARCHAR)],
  {opt("len(coalesce(tags, CAST([] AS VARCHAR[]))) > 0", "'tags: [' || array_to_string(tags, ', ') || ']'")},
  {opt("len(coalesce(entities, CAST([] AS VARCHAR[]))) > 0", "'entities: [' || array_to_string(entities, ', ') || ']'")},
  {opt("source IS NOT NULL AND source <> ''", "'source: ' || source")},
  {opt("expires_at IS NOT NULL", "'expires_at: ' || " + ts_text_sql('expires_at'))},
  {opt("created_at IS NOT NULL", "'created_at: ' || " + ts_text_sql('created_at'))},
  {opt("updated_at IS NOT NULL", "'updated_at: ' || " + ts_text_sql('updated_at'))},
  {opt("metadata IS NOT NULL AND metadata <> ''", "'metadata: ' || " + json_string_sql('metadata'))},
  ['---', '', '# ' || title, ''],
  CASE WHEN summary IS NOT NULL AND summary <> '' THEN ['> ' || summary, ''] ELSE CAST([] AS VARCHAR[]) END,
  [coalesce(content, ''), ''],
  CASE WHEN len(coalesce(related_ids, CAST([] AS VARCHAR[]))) > 0
       THEN flatten([['## Related'], list_transform(related_ids, lambda r: '- ' || r), ['']])
       ELSE CAST([] AS VARCHAR[]) END]), chr(10))"""


def rounded_list_sql(e: str) -> str:
    """A vector as doubles of 4 places."""
    return f"list_transform({e}, lambda x: {round_sql('CAST(x AS DOUBLE)')})"


# V6: tokens dealt into 384 places by md5, signed, and scaled to length one
VECTORS = r"""
tokens AS (SELECT project, id, unnest(regexp_extract_all(lower(title || chr(10) || content), '[\pL\pN]+|_+')) AS t FROM memories),
places AS (SELECT project, id, CAST('0x' || substring(md5(t), 1, 8) AS BIGINT) % 384 AS j,
                  sum(CASE WHEN substring(md5(t), 9, 1) >= '8' THEN -1 ELSE 1 END) AS s FROM tokens GROUP BY ALL),
norms AS (SELECT project, id, sqrt(CAST(sum(s * s) AS DOUBLE)) AS n FROM places GROUP BY ALL),
vectors AS (SELECT g.project, g.id, list(CAST(coalesce(CASE WHEN n.n > 0 THEN p.s / n.n END, 0) AS FLOAT) ORDER BY g.j) AS vec
            FROM (SELECT project, id, j FROM memories, range(384) AS r(j)) g
            LEFT JOIN places p ON p.project = g.project AND p.id = g.id AND p.j = g.j
            LEFT JOIN norms n ON n.project = g.project AND n.id = g.id GROUP BY g.project, g.id)"""
