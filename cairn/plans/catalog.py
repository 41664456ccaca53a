"""Registered queries: one Spark plan per operator, keyed like SURVEY section 2.

Each entry takes ``(spark, sf_dir)``, reads the driver's whole test tables
through the adapters and returns a DataFrame whose column names match the
SQL in ``plans.oracle``.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.functions import score as V
from cairn.operators import search as SR
from cairn.plans import adapters as AD
from cairn.plans import oracle as O
from cairn.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)          # workers must import cairn too
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _as_of():
    return AD.as_of_col()


# ----------------------------------------------------------------- search

@register("t1_vector_topk", O.search_topk_sql())
def t1_vector_topk(spark, sf):
    mem = AD.memories(spark, sf)
    qs = AD.search_queries(spark, sf)
    c = SR.candidates(qs, mem, _as_of(), apply_min_similarity=False)
    return c.select("query_id", "id", "rank_d",
                    V.round_places(V.snap(F.lit(1.0) - F.col("distance"))).alias("similarity"))


@register("c1_search", O.search_sql())
def c1_search(spark, sf):
    mem = AD.memories(spark, sf)
    qs = AD.search_queries(spark, sf)
    hits = SR.rerank(SR.candidates(qs, mem, _as_of()), qs, _as_of())
    hits = SR.attach_notes(hits, mem, ["title", "summary", "content"])
    return hits.select("query_id", "rank", "id", "title", "category", "similarity",
                       "relevance_score", "access_count", "summary", "content")


@register("t1_vector_topk_blocked", O.search_topk_sql())
def t1_vector_topk_blocked(spark, sf):
    c = SR.candidates(AD.search_queries(spark, sf), AD.memories(spark, sf), _as_of(), apply_min_similarity=False,
                      strategy="blocked", block_rows=500, query_block_rows=200)
    return c.select("query_id", "id", "rank_d",
                    V.round_places(V.snap(F.lit(1.0) - F.col("distance"))).alias("similarity"))


@register("c1_search_blocked", O.search_sql())
def c1_search_blocked(spark, sf):
    hits = SR.search(AD.search_queries(spark, sf), AD.memories(spark, sf), _as_of(), strategy="blocked")
    return hits.select("query_id", "rank", "id", "title", "category", "similarity",
                       "relevance_score", "access_count", "summary", "content")


@register("m5_bump_search_hits", O.search_bump_sql())
def m5_bump_search_hits(spark, sf):
    """Every search hit counts as one access of its note."""
    mem = AD.memories(spark, sf)
    hits = SR.search(AD.search_queries(spark, sf), mem, _as_of())
    return M.bump_access(mem, SR.access_events(hits)).select("project", "id", "access_count")


@register("c2_search_budgeted", O.search_budgeted_sql())
def c2_search_budgeted(spark, sf):
    mem = AD.memories(spark, sf)
    qs = AD.search_queries(spark, sf)
    out = SR.search_budgeted(qs, mem, _as_of())
    return out.select("query_id", "rank", "id", "title", "summary", "category", "similarity",
                      "relevance_score", "tokens", "fits", "tokens_used", "has_more", "content", "status")


# ======================================================================
# Everything below: Spark plan + oracle SQL per operator.
# ======================================================================

from cairn.functions import text as X  # noqa: E402
from cairn.operators import filters as FL  # noqa: E402
from cairn.operators import listing as L  # noqa: E402
from cairn.operators import maintain as M  # noqa: E402
from cairn.operators import sessions as SE  # noqa: E402

from cairn.session import scratch_path  # noqa: E402
from cairn.sources import snapshot as SN  # noqa: E402
from cairn.sources import tables as TB  # noqa: E402

Osql = O.sql


def _written(spark, df, schema, by="project"):
    """A stored copy of a table in the shared scratch folder."""
    path = scratch_path(spark, f"table-{uuid.uuid4().hex}")
    w = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write
    (w.partitionBy(by) if by else w).parquet(path)
    return path
AS = O.AS_OF


def _mem(spark, sf):
    return AD.memories(spark, sf)


# ---------------------------------------------------------- scans (S)

@register("s1_read_memories", Osql(f"""
SELECT project, id, category, title, content, summary, coalesce(tags, CAST([] AS VARCHAR[])) AS tags, metadata,
       status, priority, source, coalesce(related_ids, CAST([] AS VARCHAR[])) AS related_ids,
       coalesce(entities, CAST([] AS VARCHAR[])) AS entities, access_count,
       {O.ts_text_sql('expires_at')} AS expires_at, {O.ts_text_sql('created_at')} AS created_at,
       {O.ts_text_sql('updated_at')} AS updated_at
FROM memories""", "memories"))
def s1_read_memories(spark, sf):
    """S1 + P1: the stored note table read back and served (no vector)."""
    return L.serve(TB.read_memories(spark, _written(spark, _mem(spark, sf), S.MEMORIES)))


@register("s2_read_provenance", Osql("SELECT * FROM provenance", "provenance"))
def s2_read_provenance(spark, sf):
    return TB.read_provenance(spark, _written(spark, AD.provenance(spark, sf), S.PROVENANCE)).select(
        "project", "memory_id", "operation", "details", "created_at", "op_seq")


@register("s3_read_sessions", Osql(
    "SELECT project, id, started_at, ended_at, summary, memories_created, memories_accessed FROM sessions",
    "session_events", extra=O.REPLAY.strip()))
def s3_read_sessions(spark, sf):
    path = _written(spark, SE.replay(AD.session_events(spark, sf), _as_of()), S.SESSIONS)
    return TB.read_sessions(spark, path).select(
        "project", "id", "started_at", "ended_at", "summary", "memories_created", "memories_accessed")


@register("s4_read_projects", Osql("""
SELECT slug, display_name, description, created_at, last_accessed, db_path,
       CAST(row_number() OVER (ORDER BY last_accessed DESC NULLS LAST, slug) AS INTEGER) AS position
FROM registry""", "registry"))
def s4_read_projects(spark, sf):
    """Registry, newest access first (position is the global order; the
    registry is one row per project)."""
    from cairn.operators.ranking import rank_within
    stored = TB.read_projects(spark, _written(spark, AD.registry(spark, sf), S.PROJECTS, by=None))
    return rank_within(stored, [], [F.col("last_accessed").desc_nulls_last(), F.col("slug")])


@register("s5_append_memories", Osql("""
SELECT project, id, category, title, content, 'active' AS status, 0 AS priority, 0 AS access_count,
       CAST([] AS VARCHAR[]) AS tags, CAST([] AS VARCHAR[]) AS entities FROM memories""", "memories"))
def s5_append_memories(spark, sf):
    """Notes inserted with the required fields only get the column defaults."""
    path = scratch_path(spark, f"append-{uuid.uuid4().hex}")
    TB.append_memories(_mem(spark, sf).select("project", "id", "category", "title", "content"), path, _as_of())
    return TB.read_memories(spark, path).select("project", "id", "category", "title", "content", "status", "priority",
                                                "access_count", "tags", "entities")


def _snapshots(spark, sf):
    """Every project of the note table copied to a folder of its own."""
    mem = AD.memories(spark, sf)
    names = [r.project for r in mem.select("project").distinct().collect()]
    registry = spark.createDataFrame([(p, p, None, None, None, f"projects/{p}") for p in sorted(names)], S.PROJECTS)
    base = scratch_path(spark, f"snapshots-{uuid.uuid4().hex}")
    for p in sorted(names):
        registry = SN.snapshot_project({"memories": mem, "provenance": AD.provenance(spark, sf)}, registry, p, f"{base}/{p}", _as_of())
    return registry, [f"{base}/{p}" for p in sorted(names)]


@register("s9_snapshot_project", Osql("SELECT project, id, title, content, status FROM memories", "memories"))
def s9_snapshot_project(spark, sf):
    _, paths = _snapshots(spark, sf)
    return spark.read.schema(S.MEMORIES).parquet(*[f"{p}/memories" for p in paths]).select("project", "id", "title", "content", "status")


@register("s11_sync_snapshot", Osql("SELECT project AS slug, project AS display_name, count(*) AS notes FROM memories GROUP BY project", "memories"))
def s11_sync_snapshot(spark, sf):
    """S10 + S11: every snapshot counted and registered by its folder name."""
    registry, paths = _snapshots(spark, sf)
    counts = []
    for p in paths:
        registry, n, _ = SN.sync_snapshot(spark, registry, p, _as_of())
        counts.append((p, n))
    return registry.join(spark.createDataFrame(counts, "db_path string, notes long"), "db_path").select("slug", "display_name", "notes")


@register("s12_upgrade_v1", Osql("""
SELECT project, id, title, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR[]) AS entities,
       CAST(NULL AS TIMESTAMP) AS expires_at, status
FROM memories""", "memories"))
def s12_upgrade_v1(spark, sf):
    """A v1-shaped table (no summary/entities/expires_at) upgraded."""
    v1 = _mem(spark, sf).select(*[c.name for c in S.MEMORIES_V1.fields])
    return TB.upgrade_v1(v1).select("project", "id", "title", "summary", "entities", "expires_at", "status")


# ---------------------------------------------------- enrichment (E)

@register("e1_summary", Osql("SELECT id, summary FROM memories", "memories"))
def e1_summary(spark, sf):
    return _mem(spark, sf).select("id", "summary")


def _doc_regex(name, spark_fn, sql_expr):
    @register(name, f"SELECT doc_id, {sql_expr} AS {name.split('_', 1)[1]} FROM documents")
    def q_(spark, sf):
        d = AD._read(spark, sf, "documents")
        return d.select("doc_id", spark_fn(F.col("text")).alias(name.split("_", 1)[1]))
    q_.__name__ = name
    return q_


_ASC = O.ascii_words("text")
_doc_regex("e2_camel_case", X.camel_case, f"regexp_extract_all({_ASC}, '\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b')")
_doc_regex("e3_acronyms", lambda t: F.array_sort(X.acronyms(t)),
           f"list_sort(list_distinct(list_filter(regexp_extract_all({_ASC}, '\\b[A-Z]{{2,}}\\b'), "
           f"lambda x: NOT list_contains({O.STOP}, x))))")
_doc_regex("e4_mentions", X.mentions, "regexp_extract_all(text, '@[\\pL\\pN_]+')")
_doc_regex("e5_hashtags", X.hashtags, "regexp_extract_all(text, '#[\\pL\\pN_]+')")
_doc_regex("e6_double_quoted", X.double_quoted, "regexp_extract_all(text, '\"([^\"]{2,30})\"', 1)")
_doc_regex("e7_single_quoted", X.single_quoted, "regexp_extract_all(text, '''([^'']{2,30})''', 1)")
_doc_regex("e8_tech_terms", X.tech_terms, f"regexp_extract_all({_ASC}, '\\b(?:{O.TECH})\\b')")


@register("e9_entities", Osql("SELECT id, entities FROM memories", "memories"))
def e9_entities(spark, sf):
    return _mem(spark, sf).select("id", "entities")


@register("e10_expiry", Osql("SELECT id, category, priority, created_at, expires_at FROM memories", "memories"))
def e10_expiry(spark, sf):
    return _mem(spark, sf).select("id", "category", "priority", "created_at", "expires_at")


@register("e11_rule_priority", Osql(
    f"SELECT op_seq, category, priority AS raw_priority, CAST({O.rule_priority_sql('category', 'priority')} AS INTEGER) AS priority FROM store_batch",
    "store_batch"))
def e11_rule_priority(spark, sf):
    b = AD.store_batch(spark, sf)
    return b.select("op_seq", "category", F.col("priority").alias("raw_priority"),
                    X.rule_priority("category", "priority").alias("priority"))


@register("e12_tokens", Osql(f"SELECT id, {O.tokens_sql('content')} AS tokens FROM memories", "memories"))
def e12_tokens(spark, sf):
    return _mem(spark, sf).select("id", X.tokens("content").alias("tokens"))


@register("e13_embedding_text", Osql("SELECT id, title || chr(10) || content AS embedding_text FROM memories", "memories"))
def e13_embedding_text(spark, sf):
    return _mem(spark, sf).select("id", X.embedding_text("title", "content").alias("embedding_text"))


# ------------------------------------------------------ identifiers (N)

@register("n1_slugify", Osql(f"SELECT id, title, {O.slugify_sql('title')} AS slug FROM memories", "memories"))
def n1_slugify(spark, sf):
    return _mem(spark, sf).select("id", "title", X.slugify("title").alias("slug"))


@register("n2_valid_slug", Osql(f"""
SELECT id, regexp_full_match(title, '(?:[a-z0-9][a-z0-9-]*[a-z0-9]|[a-z0-9])\\n?') AS title_valid,
       regexp_full_match({O.slugify_sql('title')}, '(?:[a-z0-9][a-z0-9-]*[a-z0-9]|[a-z0-9])\\n?') AS slug_valid
FROM memories""", "memories"))
def n2_valid_slug(spark, sf):
    return _mem(spark, sf).select("id", X.valid_slug("title").alias("title_valid"),
                                  X.valid_slug(X.slugify("title")).alias("slug_valid"))


@register("n3_file_slug", Osql(f"SELECT id, substring({O.slugify_sql('title')}, 1, 60) AS file_slug FROM memories",
                               "memories"))
def n3_file_slug(spark, sf):
    return _mem(spark, sf).select("id", X.file_slug("title").alias("file_slug"))


# ------------------------------------------------------ vectors (V)

_PAIRS_SQL = """
pairs AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _pairs(spark, sf):
    e = AD._read(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


_COS = ("CASE WHEN len(a) = len(b) AND list_dot_product(a, a) > 0 AND list_dot_product(b, b) > 0 "
        "THEN 1.0 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END")


@register("v1_cosine_distance", Osql(f"SELECT vec_id, {O.round_sql(_COS, 6)} AS distance FROM pairs",
                                     extra=_PAIRS_SQL.strip()))
def v1_cosine_distance(spark, sf):
    """V1 over each vector and its successor (a linear pairing)."""
    return _pairs(spark, sf).select("vec_id", V.round_places(V.cosine_distance("a", "b"), 6).alias("distance"))


@register("v2_dot_similarity", Osql(
    f"SELECT vec_id, {O.round_sql('CASE WHEN len(a) = len(b) THEN list_dot_product(a, b) END', 6)} AS dot FROM pairs",
    extra=_PAIRS_SQL.strip()))
def v2_dot_similarity(spark, sf):
    return _pairs(spark, sf).select("vec_id", V.round_places(V.dot_similarity("a", "b"), 6).alias("dot"))


@register("v3_recency", Osql(f"SELECT id, {O.round_sql(O.recency_sql('updated_at'), 10)} AS recency FROM memories",
                             "memories"))
def v3_recency(spark, sf):
    return _mem(spark, sf).select("id", V.round_places(V.recency("updated_at", _as_of()), 10).alias("recency"))


@register("v4_access_score", Osql(f"SELECT id, {O.access_sql('access_count')} AS access_score FROM memories",
                                  "memories"))
def v4_access_score(spark, sf):
    return _mem(spark, sf).select("id", V.access_score("access_count").alias("access_score"))


@register("v5_relevance", Osql(f"""
SELECT m.id, {O.round_sql(O.relevance_sql(O.snap_sql('1.0 - (' + _COS + ')'), 'm.updated_at', 'm.access_count'))} AS relevance_score
FROM memories m JOIN pairs p ON CAST(p.vec_id AS VARCHAR) = m.id""", "memories", extra=_PAIRS_SQL.strip()))
def v5_relevance(spark, sf):
    """V5 with the similarity of each note's vector to its successor."""
    m = _mem(spark, sf)
    p = _pairs(spark, sf).select(F.col("vec_id").cast("string").alias("id"),
                                 V.snap(F.lit(1.0) - V.cosine_distance("a", "b")).alias("sim"))
    return m.join(p, "id").select(
        "id", V.round_places(V.relevance("sim", "updated_at", "access_count", _as_of())).alias("relevance_score"))


# ------------------------------------------------------ filters (F)

@register("f1_by_status", Osql("SELECT project, id, status FROM memories WHERE status = 'archived'", "memories"))
def f1_by_status(spark, sf):
    return FL.by_status(_mem(spark, sf), S.ARCHIVED).select("project", "id", "status")


@register("f2_by_category", Osql("SELECT project, id FROM memories WHERE category = 'decision'", "memories"))
def f2_by_category(spark, sf):
    return FL.by_category(_mem(spark, sf), "decision").select("project", "id")


@register("f3_any_tag", Osql("SELECT project, id FROM memories WHERE coalesce(list_has_any(tags, ['en', 'src3']), false)",
                             "memories"))
def f3_any_tag(spark, sf):
    return FL.any_tag(_mem(spark, sf), ["en", "src3"]).select("project", "id")


@register("f4_alive", Osql(f"SELECT project, id, expires_at FROM memories WHERE expires_at IS NULL OR expires_at > {AS}",
                           "memories"))
def f4_alive(spark, sf):
    return FL.alive(_mem(spark, sf), _as_of()).select("project", "id", "expires_at")


@register("f5_min_similarity", Osql(
    f"SELECT vec_id, {O.round_sql(O.snap_sql('1.0 - (' + _COS + ')'))} AS similarity FROM pairs "
    f"WHERE 1.0 - ({_COS}) >= 0.1", extra=_PAIRS_SQL.strip()))
def f5_min_similarity(spark, sf):
    p = _pairs(spark, sf).withColumn("sim", F.lit(1.0) - V.cosine_distance("a", "b"))
    return FL.min_similarity(p, 0.1, "sim").select(
        "vec_id", V.round_places(V.snap(F.col("sim"))).alias("similarity"))


@register("f6_recent", Osql(f"SELECT project, id, created_at FROM memories WHERE created_at >= {AS} - INTERVAL 7 DAY",
                            "memories"))
def f6_recent(spark, sf):
    return FL.recent(_mem(spark, sf), _as_of()).select("project", "id", "created_at")


@register("f7_rules_only", Osql(
    "SELECT project, id, category, priority FROM memories "
    "WHERE category IN ('mandatory_rules', 'forbidden_rules') AND status = 'active'", "memories"))
def f7_rules_only(spark, sf):
    return FL.rules_only(_mem(spark, sf)).select("project", "id", "category", "priority")


@register("f8_valid_category", Osql(f"""
SELECT op_seq, category, category IN (SELECT unnest({O.CATS})) AS accepted,
       CASE WHEN category IN (SELECT unnest({O.CATS})) THEN NULL ELSE 'Invalid category ''' || category || '''' END AS reason
FROM store_batch""", "store_batch"))
def f8_valid_category(spark, sf):
    ok, bad = FL.valid_category(AD.store_batch(spark, sf))
    return (ok.select("op_seq", "category", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"))
            .unionByName(bad.select("op_seq", "category", F.lit(False).alias("accepted"), "reason")))


# -------------------------------------------------------- joins (J)

@register("j1_lookup_by_id", Osql("""
SELECT r.request_id, m.id, m.title, m.status
FROM recall_requests r JOIN memories m ON m.project = r.project AND m.id = r.id""", "memories", "recall_requests"))
def j1_lookup_by_id(spark, sf):
    req = AD.recall_requests(spark, sf).filter(F.col("id").isNotNull()).select("request_id", "project", "id")
    found, _ = M.lookup_by_id(_mem(spark, sf), req)
    return found.select("request_id", "id", "title", "status")


_FIRST_TITLE = """
first_title AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, title ORDER BY updated_at DESC, id DESC) AS rn
                               FROM memories WHERE status = 'active') WHERE rn = 1)"""


@register("j2_lookup_by_title", Osql("""
SELECT r.request_id, f.id, f.title, f.updated_at
FROM recall_requests r JOIN first_title f ON f.project = r.project AND f.title = r.title
WHERE r.id IS NULL""", "memories", "recall_requests", extra=_FIRST_TITLE.strip()))
def j2_lookup_by_title(spark, sf):
    req = AD.recall_requests(spark, sf).filter(F.col("id").isNull() & F.col("title").isNotNull())
    return M.lookup_by_title(_mem(spark, sf), req.select("request_id", "project", "title"), ["updated_at"]).select(
        "request_id", "id", "title", "updated_at")


@register("j4_import_diff", Osql("""
SELECT p.project, p.id, p.op_seq,
       CASE WHEN p.category NOT IN (SELECT unnest(%s)) THEN 'error'
            WHEN p.content IS NULL OR p.content = '' THEN 'skipped'
            WHEN m.id IS NOT NULL AND (m.content IS DISTINCT FROM p.content OR m.title IS DISTINCT FROM p.title) THEN 'updated'
            WHEN m.id IS NOT NULL THEN 'skipped' ELSE 'created' END AS outcome
FROM import_parsed p LEFT JOIN memories m ON m.project = p.project AND m.id = p.id""" % O.CATS,
    "memories", "import_parsed"))
def j4_import_diff(spark, sf):
    return M.import_diff(AD.import_parsed(spark, sf), _mem(spark, sf)).select("project", "id", "op_seq", "outcome")


@register("j5_patch_join", Osql("""
SELECT project, id, title, content, tags, metadata, status, priority, derive_title, n_patches FROM overlay
UNION ALL
SELECT project, id, NULL, NULL, NULL, NULL, 'rejected: ' || CASE WHEN EXISTS (SELECT 1 FROM memories m WHERE m.project = p.project AND m.id = p.id)
       THEN 'No fields to update' ELSE 'Memory ''' || id || ''' not found' END, NULL, NULL, NULL
FROM patches p WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.project = p.project AND m.id = p.id)
   OR (title IS NULL AND content IS NULL AND tags IS NULL AND metadata IS NULL AND status IS NULL AND priority IS NULL AND related_ids IS NULL)""",
    "memories", "patches", extra=O.overlay_sql().strip()))
def j5_patch_join(spark, sf):
    over, rej = M.patch_join(_mem(spark, sf), AD.patches(spark, sf))
    a = over.select("project", "id", "title", "content", "tags", "metadata", "status", "priority",
                    "derive_title", F.col("n_patches").cast("long").alias("n_patches"))
    b = rej.select("project", "id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content"),
                   F.lit(None).cast(S.STR_ARRAY).alias("tags"), F.lit(None).cast("string").alias("metadata"),
                   F.concat(F.lit("rejected: "), F.col("reason")).alias("status"), F.lit(None).cast("int").alias("priority"),
                   F.lit(None).cast("string").alias("derive_title"), F.lit(None).cast("long").alias("n_patches"))
    return a.unionByName(b)


@register("j6_drop_ids", Osql("""
SELECT project, id FROM memories m
WHERE NOT EXISTS (SELECT 1 FROM hard_delete_ids h WHERE h.project = m.project AND h.id = m.id)""",
    "memories", "hard_delete_ids"))
def j6_drop_ids(spark, sf):
    return M.drop_ids(_mem(spark, sf), AD.hard_delete_ids(spark, sf)).select("project", "id")


# --------------------------------------------------- aggregations (A)

_SWEPT = f"""
swept AS (SELECT * REPLACE (CASE WHEN status = 'active' AND expires_at IS NOT NULL AND expires_at <= {AS}
                                 THEN 'expired' ELSE status END AS status) FROM memories),
listed AS (SELECT * FROM swept WHERE status = 'active' AND coalesce(list_has_any(tags, ['en']), false)
           AND (expires_at IS NULL OR expires_at > {AS}))"""


@register("a1_filtered_total", Osql("SELECT project, count(*) AS total FROM listed GROUP BY project",
                                    "memories", extra=_SWEPT.strip()))
def a1_filtered_total(spark, sf):
    f = L.list_filtered(L.sweep_expired(_mem(spark, sf), _as_of()), _as_of(), tags=["en"])
    return L.filtered_total(f)


@register("a2_rules_split", Osql(
    "SELECT DISTINCT project, n_mandatory, n_forbidden, total FROM rules_split", "memories",
    extra=O.RULES_SPLIT.strip()))
def a2_rules_split(spark, sf):
    return L.rules_split(_mem(spark, sf)).select("project", "n_mandatory", "n_forbidden", "total").distinct()


@register("a3_count_by_category", Osql(
    "SELECT project, category, count(*) AS count FROM memories WHERE status = 'active' GROUP BY project, category",
    "memories"))
def a3_count_by_category(spark, sf):
    return L.count_by_category(_mem(spark, sf))


_DIFF = f"""
diff AS (SELECT p.*, CASE WHEN p.category NOT IN (SELECT unnest({O.CATS})) THEN 'error'
            WHEN p.content IS NULL OR p.content = '' THEN 'skipped'
            WHEN m.id IS NOT NULL AND (m.content IS DISTINCT FROM p.content OR m.title IS DISTINCT FROM p.title) THEN 'updated'
            WHEN m.id IS NOT NULL THEN 'skipped' ELSE 'created' END AS outcome
         FROM import_parsed p LEFT JOIN memories m ON m.project = p.project AND m.id = p.id)"""


@register("a4_import_report", Osql("""
SELECT project, count(*) FILTER (WHERE outcome = 'created') AS created, count(*) FILTER (WHERE outcome = 'updated') AS updated,
       count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'error') AS error
FROM diff GROUP BY project""", "memories", "import_parsed", extra=_DIFF.strip()))
def a4_import_report(spark, sf):
    return M.import_report(M.import_diff(AD.import_parsed(spark, sf), _mem(spark, sf)))


@register("a5_reembed_impact", Osql(
    "SELECT project, count(*) AS to_reembed FROM memories WHERE status = 'active' GROUP BY project", "memories"))
def a5_reembed_impact(spark, sf):
    return M.reembed_impact(_mem(spark, sf))


@register("a6_budget_fold", Osql("""
SELECT f.project, f.position, s.id, f.tokens, f.fits, max(f.used) OVER (PARTITION BY f.project) AS tokens_used,
       bool_or(NOT f.fits) OVER (PARTITION BY f.project) AS has_more
FROM fold f JOIN sprint_top s ON s.project = f.project AND s.position = f.position""",
    "memories", recursive=True, extra=O.SPRINT_TOP.strip() + f""",
items AS (SELECT project, position, {O.tokens_sql('content')} AS tokens FROM sprint_top),
fold AS (SELECT project, position, tokens, tokens <= 1000 AS fits,
                CAST(CASE WHEN tokens <= 1000 THEN tokens ELSE 0 END AS BIGINT) AS used FROM items WHERE position = 1
         UNION ALL
         SELECT i.project, i.position, i.tokens, f.used + i.tokens <= 1000,
                CASE WHEN f.used + i.tokens <= 1000 THEN f.used + i.tokens ELSE f.used END
         FROM fold f JOIN items i ON i.project = f.project AND i.position = f.position + 1)"""))
def a6_budget_fold(spark, sf):
    """A6 over each project's active sprint list (top 10) with 1,000 tokens."""
    s = L.active_by_category(_mem(spark, sf), "sprint", S.ACTIVE_SPRINT_CAP)
    s = s.withColumn("tokens", X.tokens("content")).withColumn("budget", F.lit(1000).cast("long"))
    out = SR.budget_fold(s, "project", "position", "tokens", "budget", ["id"])
    return out.select("project", "position", "id", "tokens", "fits", "tokens_used", "has_more")


@register("a7_trail_total", Osql("SELECT project, memory_id, count(*) AS total FROM provenance GROUP BY project, memory_id", "provenance"))
def a7_trail_total(spark, sf):
    return M.trail_total(AD.provenance(spark, sf))


@register("a8_orphans_closed", Osql(
    "SELECT project, count(*) AS sessions, CAST(sum(CAST(auto_closed AS INTEGER)) AS BIGINT) AS orphans_closed "
    "FROM sessions GROUP BY project", "session_events", extra=O.REPLAY.strip()))
def a8_orphans_closed(spark, sf):
    return SE.orphans_closed(SE.replay(AD.session_events(spark, sf), _as_of()))


# ------------------------------------------------------ top-k / sort (T)

@register("t2_rerank", Osql(
    "SELECT query_id, id, CAST(rank AS INTEGER) AS rank, relevance_score FROM hits", "memories", "search_queries",
    extra=O._search_hits().strip()))
def t2_rerank(spark, sf):
    qs = AD.search_queries(spark, sf)
    return SR.rerank(SR.candidates(qs, _mem(spark, sf), _as_of()), qs, _as_of()).select(
        "query_id", "id", "rank", "relevance_score")


def _page_sql(order: str, lo: int, hi: int) -> str:
    return Osql(f"""
SELECT project, id, title, updated_at, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY {order}) AS INTEGER) AS position FROM memories)
WHERE position > {lo} AND position <= {hi}""", "memories")


@register("t3_page", _page_sql("title ASC NULLS LAST, id", 10, 30))
def t3_page(spark, sf):
    return L.page(_mem(spark, sf), "title", "asc", limit=20, offset=10).select(
        "project", "id", "title", "updated_at", "position")


@register("t3_page_fallback", _page_sql("updated_at DESC NULLS LAST, id", 0, 25))
def t3_page_fallback(spark, sf):
    """Unknown sort field and upper-case order fall back to updated_at desc."""
    return L.page(_mem(spark, sf), "Title", "DESC", limit=25, offset=0).select(
        "project", "id", "title", "updated_at", "position")


@register("t4_order_rules", Osql("""
SELECT project, id, category, CAST(row_number() OVER (PARTITION BY project
       ORDER BY priority DESC NULLS LAST, created_at ASC NULLS LAST, id) AS INTEGER) AS position
FROM memories WHERE category IN ('mandatory_rules', 'forbidden_rules') AND status = 'active'""", "memories"))
def t4_order_rules(spark, sf):
    return L.order_rules(_mem(spark, sf)).select("project", "id", "category", "position")


@register("t5_order_trail", Osql("""
SELECT project, memory_id, op_seq, operation, CAST(row_number() OVER (PARTITION BY project, memory_id ORDER BY created_at ASC NULLS LAST, op_seq) AS INTEGER) AS position,
       count(*) OVER (PARTITION BY project, memory_id) AS total
FROM provenance""", "provenance"))
def t5_order_trail(spark, sf):
    return M.trail(AD.provenance(spark, sf)).select("project", "memory_id", "op_seq", "operation", "position", "total")


@register("t6_recent_by_category", Osql(
    "SELECT project, id, created_at, position FROM decisions_top", "memories", extra=O.DECISIONS_TOP.strip()))
def t6_recent_by_category(spark, sf):
    return L.recent_by_category(_mem(spark, sf), _as_of()).select("project", "id", "created_at", "position")


@register("t7_active_by_category", Osql(
    "SELECT project, id, priority, updated_at, position FROM sprint_top", "memories", extra=O.SPRINT_TOP.strip()))
def t7_active_by_category(spark, sf):
    return L.active_by_category(_mem(spark, sf)).select("project", "id", "priority", "updated_at", "position")


@register("t8_last_session", Osql("SELECT project, last_session_summary FROM last_session", "session_events",
                                  extra=O.REPLAY.strip() + "," + O.last_session_sql("sessions")))
def t8_last_session(spark, sf):
    return SE.last_session(SE.replay(AD.session_events(spark, sf), _as_of()))


@register("t9_export_order", Osql("""
SELECT project, id, category, title, CAST(row_number() OVER (PARTITION BY project ORDER BY category, title, id) AS INTEGER) AS position
FROM memories WHERE status = 'active'""", "memories"))
def t9_export_order(spark, sf):
    return L.export_order(_mem(spark, sf)).select("project", "id", "category", "title", "position")


# ------------------------------------------------------ composites (C)

@register("c3_recall", Osql("""
SELECT r.request_id, r.project,
       CASE WHEN r.id IS NOT NULL AND r.id <> '' THEN r.id ELSE f.id END AS id,
       CASE WHEN r.id IS NOT NULL AND r.id <> '' THEN m.title WHEN r.title IS NOT NULL AND r.title <> '' THEN r.title END AS title,
       coalesce(m.status, f.status) AS status,
       coalesce(m.access_count, f.access_count) AS access_count,
       coalesce(m.content, f.content) AS content, coalesce(m.summary, f.summary) AS summary,
       coalesce(m.tags, f.tags) AS tags, coalesce(m.priority, f.priority) AS priority,
       coalesce(m.updated_at, f.updated_at) AS updated_at,
       CASE WHEN (r.id IS NULL OR r.id = '') AND (r.title IS NULL OR r.title = '') THEN 'Provide either memory_id or title'
            WHEN coalesce(m.id, f.id) IS NULL THEN 'Memory not found' ELSE 'ok' END AS outcome
FROM recall_requests r
LEFT JOIN memories m ON r.id IS NOT NULL AND r.id <> '' AND m.project = r.project AND m.id = r.id
LEFT JOIN first_title f ON (r.id IS NULL OR r.id = '') AND r.title IS NOT NULL AND r.title <> ''
                        AND f.project = r.project AND f.title = r.title""",
    "memories", "recall_requests", extra=_FIRST_TITLE.strip()))
def c3_recall(spark, sf):
    ans, _, _ = M.recall(_mem(spark, sf), AD.recall_requests(spark, sf), _as_of())
    return ans.select("request_id", "project", "id", "title", "status", "access_count", "content", "summary", "tags",
                      "priority", "updated_at", "outcome")


@register("c4_list", Osql("""
SELECT * FROM (
  SELECT project, id, priority, updated_at,
         CAST(row_number() OVER (PARTITION BY project ORDER BY priority DESC NULLS LAST, id) AS INTEGER) AS position,
         count(*) OVER (PARTITION BY project) AS total
  FROM listed) WHERE position <= 50""", "memories", extra=_SWEPT.strip()))
def c4_list(spark, sf):
    out = L.list_notes(_mem(spark, sf), _as_of(), tags=["en"], sort_by="priority", order="desc", limit=50)
    return out.select("project", "id", "priority", "updated_at", "position", "total")


@register("c5_rules", Osql("SELECT r.project, r.category, r.position, r.id, m.title, m.content, m.tags, "
                           "r.n_mandatory, r.n_forbidden, r.total FROM rules_split r "
                           "JOIN memories m ON m.project = r.project AND m.id = r.id",
                           "memories", extra=O.RULES_SPLIT.strip()))
def c5_rules(spark, sf):
    return L.rules_split(_mem(spark, sf)).select("project", "category", "position", "id", "title", "content", "tags",
                                                 "n_mandatory", "n_forbidden", "total")


_DIGEST = O.REPLAY.strip() + f""",
projects AS (SELECT DISTINCT project FROM memories),
closed AS (SELECT s.project, s.id,
                  CASE WHEN s.ended_at IS NULL THEN {AS} ELSE s.ended_at END AS ended_at,
                  CASE WHEN s.ended_at IS NULL THEN {O.AUTO} ELSE s.summary END AS summary,
                  s.ended_at IS NULL AS closed_now
           FROM sessions s WHERE s.project IN (SELECT project FROM projects)
           UNION ALL
           SELECT s.project, s.id, s.ended_at, s.summary, false FROM sessions s
           WHERE s.project NOT IN (SELECT project FROM projects)),""" + O.last_session_sql("closed") + ",\n" + \
    O.RULES_SPLIT.strip() + ",\n" + O.SPRINT_TOP.strip() + ",\n" + O.DECISIONS_TOP.strip()


@register("c6_session_digest", Osql("""
SELECT d.project, d.section, d.position, d.id, m.title, m.content, d.last_session_summary, d.orphans_closed FROM (
SELECT p.project, 'header' AS section, 0 AS position, CAST(NULL AS VARCHAR) AS id, l.last_session_summary,
       CAST(coalesce(c.n, 0) AS BIGINT) AS orphans_closed
FROM projects p LEFT JOIN last_session l ON l.project = p.project
LEFT JOIN (SELECT project, count(*) FILTER (WHERE closed_now) AS n FROM closed GROUP BY project) c ON c.project = p.project
UNION ALL SELECT project, category, position, id, NULL, NULL FROM rules_split
UNION ALL SELECT project, 'active_sprint', position, id, NULL, NULL FROM sprint_top
UNION ALL SELECT project, 'recent_decisions', position, id, NULL, NULL FROM decisions_top) d
LEFT JOIN memories m ON m.project = d.project AND m.id = d.id""",
    "memories", "session_events", extra=_DIGEST))
def c6_session_digest(spark, sf):
    mem = _mem(spark, sf)
    sessions = SE.replay(AD.session_events(spark, sf), _as_of())
    return SE.session_digest(mem, sessions, mem.select("project"), _as_of())


@register("c7_trail", Osql("""
SELECT p.project, p.memory_id, p.operation, p.details, p.created_at, p.op_seq,
       CAST(row_number() OVER (PARTITION BY p.project, p.memory_id ORDER BY p.created_at ASC NULLS LAST, p.op_seq) AS INTEGER) AS position,
       count(*) OVER (PARTITION BY p.project, p.memory_id) AS total
FROM provenance p WHERE EXISTS (SELECT 1 FROM memories m WHERE m.project = p.project AND m.id = p.memory_id)""", "memories", "provenance"))
def c7_trail(spark, sf):
    return M.trail(AD.provenance(spark, sf), _mem(spark, sf).select("project", "id")).select(
        "project", "memory_id", "operation", "details", "created_at", "op_seq", "position", "total")


# ---------------------------------------------------- maintenance (M)

from cairn.functions import embed as EM  # noqa: E402


@register("m1_store", Osql("""
SELECT project, id, category, title, summary, entities, tags, metadata, status, priority, source, access_count,
       expires_at, created_at FROM store_notes""", "store_batch", extra=O.STORE_NOTES.strip()))
def m1_store(spark, sf):
    notes, _, _ = M.store(AD.store_batch(spark, sf), _as_of(), "store")
    return notes.select("project", "id", "category", "title", "summary", "entities", "tags", "metadata", "status",
                        "priority", "source", "access_count", "expires_at", "created_at")


@register("m15_record", Osql("""
SELECT project, id AS memory_id, 'create' AS operation,
       CAST(to_json({'category': category, 'title': title, 'source': source, 'entities_extracted': CAST(len(entities) AS INTEGER)}) AS VARCHAR) AS details,
       created_at, op_seq
FROM store_notes""", "store_batch", extra=O.STORE_NOTES.strip()))
def m15_record(spark, sf):
    """M15 as written by M1: one create row per stored note."""
    _, trail, _ = M.store(AD.store_batch(spark, sf), _as_of(), "store")
    return trail


@register("m2_update", Osql(f"""
SELECT project, id, title, content,
       CASE WHEN text_changed THEN {O.summary_sql('derive_title', 'derive_content')} ELSE summary END AS summary,
       CASE WHEN text_changed THEN {O.entities_sql("derive_title || ' ' || derive_content")} ELSE entities END AS entities,
       tags, metadata, status, priority, {AS} AS updated_at
FROM overlay""", "memories", "patches", extra=O.overlay_sql().strip()))
def m2_update(spark, sf):
    out, _, _ = M.update(_mem(spark, sf), AD.patches(spark, sf), _as_of())
    return out.select("project", "id", "title", "content", "summary", "entities", "tags", "metadata", "status",
                      "priority", "updated_at")


@register("m2_update_audit", Osql(f"""
SELECT project, id AS memory_id, 'update' AS operation,
       CAST(to_json({{'changed_fields': list_filter([
           CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN content IS NOT NULL THEN 'content' END,
           CASE WHEN tags IS NOT NULL THEN 'tags' END, CASE WHEN metadata IS NOT NULL THEN 'metadata' END,
           CASE WHEN status IS NOT NULL THEN 'status' END, CASE WHEN priority IS NOT NULL THEN 'priority' END,
           CASE WHEN related_ids IS NOT NULL THEN 'related_ids' END], lambda x: x IS NOT NULL)}}) AS VARCHAR) AS details,
       {AS} AS created_at, op_seq
FROM patches p WHERE EXISTS (SELECT 1 FROM memories m WHERE m.project = p.project AND m.id = p.id)
  AND (title IS NOT NULL OR content IS NOT NULL OR tags IS NOT NULL OR metadata IS NOT NULL OR status IS NOT NULL
       OR priority IS NOT NULL OR related_ids IS NOT NULL)""", "memories", "patches"))
def m2_update_audit(spark, sf):
    _, trail, _ = M.update(_mem(spark, sf), AD.patches(spark, sf), _as_of())
    return trail


@register("m3_soft_delete", Osql(f"""
SELECT m.project, m.id, CASE WHEN h.id IS NOT NULL THEN 'archived' ELSE m.status END AS status,
       CASE WHEN h.id IS NOT NULL THEN {AS} ELSE m.updated_at END AS updated_at
FROM memories m LEFT JOIN (SELECT DISTINCT project, id FROM soft_delete_ids) h ON h.project = m.project AND h.id = m.id""",
    "memories", "soft_delete_ids"))
def m3_soft_delete(spark, sf):
    state, _, _ = M.soft_delete(_mem(spark, sf), AD.soft_delete_ids(spark, sf), _as_of())
    return state.select("project", "id", "status", "updated_at")


@register("m4_hard_delete", Osql("""
SELECT h.project, h.id, CASE WHEN m.id IS NOT NULL THEN 'hard_delete' ELSE 'rejected' END AS outcome,
       CASE WHEN m.id IS NOT NULL THEN '{"reason":null}' ELSE 'Memory ''' || h.id || ''' not found' END AS details
FROM hard_delete_ids h LEFT JOIN memories m ON m.project = h.project AND m.id = h.id
UNION ALL SELECT project, id, 'rejected', 'Memory ''' || id || ''' not found' FROM hard_delete_ids""",
    "memories", "hard_delete_ids"))
def m4_hard_delete(spark, sf):
    """M4: audit rows of removed notes and rejects of unknown and already
    removed ids (the remaining state is ``j6_drop_ids``)."""
    ids = AD.hard_delete_ids(spark, sf)
    again = ids.withColumn("op_seq", F.col("op_seq") + 1_000_000_000)  # every call a second time
    _, trail, rej = M.hard_delete(_mem(spark, sf), ids.unionByName(again), _as_of())
    return (trail.select("project", F.col("memory_id").alias("id"), F.lit("hard_delete").alias("outcome"), "details")
            .unionByName(rej.select("project", "id", F.lit("rejected").alias("outcome"), F.col("reason").alias("details"))))


@register("m5_bump_access", Osql("""
SELECT m.project, m.id, CAST(m.access_count + coalesce(h.n, 0) AS INTEGER) AS access_count
FROM memories m LEFT JOIN (
  SELECT r.project, CASE WHEN r.id IS NOT NULL AND r.id <> '' THEN r.id ELSE f.id END AS id, count(*) AS n
  FROM recall_requests r
  LEFT JOIN memories mm ON r.id IS NOT NULL AND r.id <> '' AND mm.project = r.project AND mm.id = r.id
  LEFT JOIN first_title f ON (r.id IS NULL OR r.id = '') AND r.title IS NOT NULL AND r.title <> ''
                          AND f.project = r.project AND f.title = r.title
  WHERE coalesce(mm.id, f.id) IS NOT NULL GROUP BY 1, 2) h ON h.project = m.project AND h.id = m.id""",
    "memories", "recall_requests", extra=_FIRST_TITLE.strip()))
def m5_bump_access(spark, sf):
    mem = _mem(spark, sf)
    _, hits, _ = M.recall(mem, AD.recall_requests(spark, sf), _as_of())
    return M.bump_access(mem, hits).select("project", "id", "access_count")


@register("m6_sweep_expired", Osql(f"""
SELECT project, id, CASE WHEN status = 'active' AND expires_at IS NOT NULL AND expires_at <= {AS}
                         THEN 'expired' ELSE status END AS status FROM memories""", "memories"))
def m6_sweep_expired(spark, sf):
    return L.sweep_expired(_mem(spark, sf), _as_of()).select("project", "id", "status")


@register("m8_import_apply", Osql(f"""
SELECT project, {O.note_id_sql('project', 'title', 'content', 'op_seq', "'import'")} AS id, 'created' AS kind, title,
       {O.summary_sql('title', 'content')} AS summary, coalesce(tags, CAST([] AS VARCHAR[])) AS tags,
       CAST({O.rule_priority_sql('category', 'coalesce(priority, 0)')} AS INTEGER) AS priority,
       coalesce(source, 'import') AS source,
       {O.expiry_sql('category', O.rule_priority_sql('category', 'coalesce(priority, 0)'), AS)} AS expires_at,
       {AS} AS updated_at
FROM diff WHERE outcome = 'created'
UNION ALL
SELECT m.project, m.id, 'updated', d.title, {O.summary_sql('d.title', 'd.content')},
       coalesce(d.tags, CAST([] AS VARCHAR[])), m.priority, m.source, m.expires_at, {AS}
FROM diff d JOIN memories m ON m.project = d.project AND m.id = d.id WHERE d.outcome = 'updated'""",
    "memories", "import_parsed", extra=_DIFF.strip()))
def m8_import_apply(spark, sf):
    mem = _mem(spark, sf)
    diff = M.import_diff(AD.import_parsed(spark, sf), mem)
    created, updated, _ = M.import_apply(mem, diff, _as_of(), "import")
    cols = ["project", "id", "kind", "title", "summary", "tags", "priority", "source", "expires_at", "updated_at"]
    return (created.withColumn("kind", F.lit("created")).select(*cols)
            .unionByName(updated.withColumn("kind", F.lit("updated")).select(*cols)))


@register("m9_start_sessions", Osql(
    f"SELECT project, session_id AS id, ts AS started_at FROM session_events WHERE kind = 'start' AND ts <= {AS}",
    "session_events"))
def m9_start_sessions(spark, sf):
    return SE.replay(AD.session_events(spark, sf), _as_of()).select("project", "id", "started_at")


@register("m10_close_orphans", Osql(
    "SELECT project, id, auto_closed, closed_at, ended_at FROM sessions "
    "WHERE auto_closed", "session_events", extra=O.REPLAY.strip()))
def m10_close_orphans(spark, sf):
    """M10 (log form): the sessions a later start auto-closed, and when."""
    s = SE.replay(AD.session_events(spark, sf), _as_of()).filter("auto_closed")
    return s.select("project", "id", "auto_closed", "closed_at", "ended_at")


@register("m11_end_sessions", Osql(
    f"SELECT project, id, ended_at, summary, memories_created, memories_accessed FROM sessions "
    f"WHERE ended_at IS NOT NULL AND summary IS DISTINCT FROM {O.AUTO}", "session_events", extra=O.REPLAY.strip()))
def m11_end_sessions(spark, sf):
    s = SE.replay(AD.session_events(spark, sf), _as_of())
    return s.filter(F.col("ended_at").isNotNull() & ~F.col("summary").eqNullSafe(S.AUTO_CLOSE_SUMMARY)).select(
        "project", "id", "ended_at", "summary", "memories_created", "memories_accessed")


@register("m12_upsert_projects", Osql(f"""
SELECT coalesce(r.slug, l.slug) AS slug,
       CASE WHEN l.slug IS NOT NULL THEN l.display_name ELSE r.display_name END AS display_name,
       CASE WHEN l.slug IS NOT NULL THEN l.description ELSE r.description END AS description,
       coalesce(r.created_at, {AS}) AS created_at,
       CASE WHEN l.slug IS NOT NULL THEN {AS} ELSE r.last_accessed END AS last_accessed,
       coalesce(r.db_path, 'projects/' || l.slug) AS db_path
FROM registry r FULL OUTER JOIN (
  SELECT slug, arg_max_null(display_name, op_seq) AS display_name, arg_max_null(description, op_seq) AS description
  FROM (SELECT CASE WHEN regexp_full_match(slug, '{O.VALID_SLUG_RE}') THEN slug ELSE {O.slugify_sql('slug')} END AS slug,
               display_name, description, op_seq FROM registry_batch)
  GROUP BY slug) l ON l.slug = r.slug""", "registry", "registry_batch"))
def m12_upsert_projects(spark, sf):
    return M.upsert_projects(AD.registry(spark, sf), AD.registry_batch(spark, sf), _as_of())


@register("m13_touch_projects", Osql("""
SELECT r.slug, r.display_name, r.description, r.created_at, coalesce(t.ts, r.last_accessed) AS last_accessed, r.db_path
FROM registry r LEFT JOIN (SELECT slug, max(ts) AS ts FROM touch_events GROUP BY slug) t ON t.slug = r.slug""",
    "registry", "touch_events"))
def m13_touch_projects(spark, sf):
    return M.touch_projects(AD.registry(spark, sf), AD.touch_events(spark, sf))


@register("m14_delete_projects", Osql(
    "SELECT * FROM registry WHERE slug NOT IN (SELECT slug FROM delete_slugs)", "registry", "delete_slugs"))
def m14_delete_projects(spark, sf):
    return M.delete_projects(AD.registry(spark, sf), AD.delete_slugs(spark, sf))


# ----------------------------------------------------------------- embedder

def _vector(c):
    """A vector as doubles of 4 places."""
    return F.transform(F.col(c).cast("array<double>"), lambda x: V.round_places(x)).alias(c)


@register("v6_embed", Osql(f"""
SELECT m.project, m.id, CAST(len(v.vec) AS INTEGER) AS dim, {O.rounded_list_sql('v.vec')} AS vec
FROM memories m JOIN vectors v USING (project, id)""", "memories", extra=O.VECTORS.strip()))
def v6_embed(spark, sf):
    """V6: every note's title and content embedded (default hash embedder)."""
    e = EM.HashEmbedder().embed(_mem(spark, sf).select(
        "project", "id", X.embedding_text("title", "content").alias("t")), "t", "vec")
    return e.select("project", "id", F.size("vec").alias("dim"), _vector("vec"))


@register("m7_reembed", Osql(f"""
SELECT m.project, m.id, m.status, CASE WHEN m.status = 'active' THEN {O.rounded_list_sql('v.vec')} ELSE {O.rounded_list_sql('m.embedding')} END AS embedding,
       CASE WHEN m.status = 'active' THEN {AS} ELSE m.updated_at END AS updated_at
FROM memories m JOIN vectors v USING (project, id)""", "memories", extra=O.VECTORS.strip()))
def m7_reembed(spark, sf):
    """M7: the note table after re-embedding its active notes."""
    state, _ = EM.reembed(_mem(spark, sf), EM.HashEmbedder(), _as_of())
    return state.select("project", "id", "status", _vector("embedding"), "updated_at")


@register("m7_reembed_audit", Osql(f"""
SELECT project, id AS memory_id, 'reembed' AS operation, '{{"model":"hash-384"}}' AS details, {AS} AS created_at
FROM memories WHERE status = 'active'""", "memories"))
def m7_reembed_audit(spark, sf):
    _, trail = EM.reembed(_mem(spark, sf), EM.HashEmbedder(), _as_of())
    return trail.select("project", "memory_id", "operation", "details", "created_at")


@register("c10_reembed_for_model", Osql(f"""
SELECT m.project, count(*) FILTER (WHERE m.status = 'active') AS to_reembed, count(*) FILTER (WHERE m.status = 'active') AS audited,
       count(*) FILTER (WHERE m.updated_at = {AS} OR m.status = 'active') AS updated,
       CAST(sum(CASE WHEN m.status = 'active' THEN len(v.vec) ELSE coalesce(len(m.embedding), 0) END) AS BIGINT) AS components
FROM memories m JOIN vectors v USING (project, id) GROUP BY m.project""", "memories", extra=O.VECTORS.strip()))
def c10_reembed_for_model(spark, sf):
    """A switch from another model: impact, audit rows and new state per project."""
    impact, state, trail = EM.reembed_for_model(_mem(spark, sf), "previous-model", EM.HashEmbedder(), _as_of())
    done = state.groupBy("project").agg(F.count(F.when(F.col("updated_at") == _as_of(), 1)).alias("updated"),
                                        F.sum(F.coalesce(F.size("embedding"), F.lit(0)).cast("long")).alias("components"))
    audited = trail.groupBy("project").agg(F.count(F.lit(1)).alias("audited"))
    return impact.join(audited, "project").join(done, "project").select("project", "to_reembed", "audited", "updated", "components")


# ------------------------------------------------------ interchange (N, S7)

from cairn.functions import markdown as MD  # noqa: E402
from cairn.sources import markdown_tree as MT  # noqa: E402


@register("n5_render_markdown", Osql(f"SELECT id, {O.render_sql()} AS markdown FROM memories", "memories"))
def n5_render_markdown(spark, sf):
    """Every note rendered as its Markdown file text."""
    return _mem(spark, sf).select("id", MD.render_row().alias("markdown"))


@register("n4_parse_markdown", Osql(f"""
SELECT id, id AS p_id, category,
       CASE WHEN regexp_full_match(title, '[0-9]+') THEN coalesce(nullif(ltrim(title, '0'), ''), '0') ELSE title END AS title,
       status, priority,
       CASE WHEN len(coalesce(tags, CAST([] AS VARCHAR[]))) > 0 THEN tags END AS tags, source,
       {O.strip_ws("array_to_string(CASE WHEN r > 0 THEN ls[1:r - 1] ELSE ls END, chr(10))")} AS content
FROM (SELECT *, list_position(list_transform(ls, lambda l: starts_with(l, '## Related')), true) AS r
      FROM (SELECT *, string_split({O.strip_ws('content')}, chr(10)) AS ls FROM memories))""", "memories"))
def n4_parse_markdown(spark, sf):
    """N4 over N5: each note rendered and parsed back (lossy rules applied)."""
    p = MD.parse_df(_mem(spark, sf).select("id", MD.render_row().alias("md")), "md", "p")
    return p.select("id", F.col("p.id").alias("p_id"), F.col("p.category").alias("category"),
                    F.col("p.title").alias("title"), F.col("p.status").alias("status"),
                    F.col("p.priority").alias("priority"), F.col("p.tags").alias("tags"),
                    F.col("p.source").alias("source"), F.col("p.content").alias("content"))


@register("s7_rendered_files", Osql(f"""
SELECT project, category || '/' || substring({O.slugify_sql('title')}, 1, 60) || '.md' AS rel,
       arg_max({O.render_sql()}, (title, id)) AS body, count(*) AS notes
FROM memories WHERE status = 'active' GROUP BY 1, 2""", "memories"))
def s7_rendered_files(spark, sf):
    """S7 content: the file set of each project's export after same-slug
    collisions (last by title, id wins)."""
    return MT.rendered_files(FL.by_status(_mem(spark, sf), S.ACTIVE), ["project"])


from cairn.plans import flows  # noqa: E402, F401 - registers the streaming and file-tree queries
