"""Table schemas and the constants that are part of the semantics.

Timestamps are ``TIMESTAMP_NTZ`` throughout: the notes store zone-less
instants read as UTC, and zone-less columns make results independent of the
session time zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# The eleven note categories, in their declared order.
CATEGORIES = [
    "decision", "session", "sprint", "project_plan", "architecture", "devops",
    "mandatory_rules", "forbidden_rules", "developer_docs", "feedback", "reference",
]
# Categories holding rules: never expire, priority at least 2.
RULE_CATEGORIES = ["mandatory_rules", "forbidden_rules"]
RULE_PRIORITY_FLOOR = 2

# Time-to-live in days per category; rule categories never expire (absent).
TTL_DAYS = {
    "session": 30,
    "sprint": 90,
    "decision": 365,
    "project_plan": 365,
    "architecture": 365,
    "devops": 180,
    "developer_docs": 180,
    "feedback": 90,
    "reference": 365,
}
# TTL multiplier: priority 1 -> 1.5; priority 2 or more -> never expires;
# any other priority -> 1.0.
TTL_MULTIPLIER_P1 = 1.5

# Composite relevance weights: similarity, recency, access.
RELEVANCE_WEIGHTS = (0.7, 0.15, 0.15)
RECENCY_DECAY_PER_DAY = 0.1
ACCESS_SATURATION = 10.0
SEARCH_OVERSAMPLE = 3
SEARCH_LIMIT = 10
SEARCH_MIN_SIMILARITY = 0.3

# Listing.
LIST_LIMIT = 50
LIST_SORT_FIELDS = ["created_at", "updated_at", "title", "priority", "access_count", "category"]
LIST_SORT_ORDERS = ["asc", "desc"]
LIST_DEFAULT_SORT = ("updated_at", "desc")

# Session digest.
RECENT_DAYS = 7
RECENT_DECISIONS_CAP = 20
ACTIVE_SPRINT_CAP = 10
AUTO_CLOSE_SUMMARY = "[Auto-closed: session was not properly ended (context overflow or crash)]"

# Summary and tokens.
SUMMARY_MAX_WORDS = 20
SUMMARY_MIN_WORDS = 5
SUMMARY_MAX_CHARS = 200
CHARS_PER_TOKEN = 4

# Entity extraction: acronyms that are not entities.
ACRONYM_STOPWORDS = ["THE", "AND", "FOR", "NOT", "BUT", "ARE", "WAS", "HAS", "ALL", "ANY", "CAN"]
# Technology dictionary, six groups, matched as whole words, case-sensitive.
TECH_TERMS = [
    ["React", "Vue", "Angular", "Next.js", "Nuxt", "Svelte"],
    ["PostgreSQL", "MySQL", "MongoDB", "Redis", "DuckDB", "SQLite"],
    ["Docker", "Kubernetes", "AWS", "GCP", "Azure", "Cloudflare"],
    ["Python", "TypeScript", "JavaScript", "Rust", "Go", "Java"],
    ["FastAPI", "Django", "Flask", "Express", "FastMCP"],
    ["GitHub", "GitLab", "Jira", "Linear", "Slack", "Notion"],
]

# Export.
FILE_SLUG_MAX = 60
EXPORT_DIR_NAME = ".memory"
EXPORT_INDEX_NAME = "MEMORY_INDEX.md"

# Embedding.
EMBED_DIM = 384
EMBED_BATCH = 32

# Status values.
ACTIVE, ARCHIVED, EXPIRED = "active", "archived", "expired"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

STR_ARRAY = T.ArrayType(T.StringType())
VECTOR = T.ArrayType(T.FloatType())
TS = T.TimestampNTZType()

MEMORY_COLUMNS = [
    "id", "category", "title", "content", "summary", "tags", "metadata", "embedding",
    "status", "priority", "source", "related_ids", "entities", "access_count",
    "expires_at", "created_at", "updated_at",
]

MEMORIES = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("tags", STR_ARRAY),
    T.StructField("metadata", T.StringType()),
    T.StructField("embedding", VECTOR),
    T.StructField("status", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("related_ids", STR_ARRAY),
    T.StructField("entities", STR_ARRAY),
    T.StructField("access_count", T.IntegerType()),
    T.StructField("expires_at", TS),
    T.StructField("created_at", TS),
    T.StructField("updated_at", TS),
])

# The first schema generation lacked summary, entities and expires_at.
MEMORIES_V1 = T.StructType([f for f in MEMORIES.fields
                            if f.name not in ("summary", "entities", "expires_at")])

PROVENANCE = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("memory_id", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("created_at", TS),
    T.StructField("op_seq", T.LongType()),
])

SESSIONS = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("started_at", TS),
    T.StructField("ended_at", TS),
    T.StructField("summary", T.StringType()),
    T.StructField("memories_created", T.IntegerType()),
    T.StructField("memories_accessed", T.IntegerType()),
    T.StructField("metadata", T.StringType()),
])

PROJECTS = T.StructType([
    T.StructField("slug", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", TS),
    T.StructField("last_accessed", TS),
    T.StructField("db_path", T.StringType()),
])

# A batch of searches: one row per query.
SEARCH_QUERIES = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("project", T.StringType()),
    T.StructField("embedding", VECTOR),
    T.StructField("category", T.StringType()),
    T.StructField("tags", STR_ARRAY),
    T.StructField("status", T.StringType()),
    T.StructField("limit", T.IntegerType()),
    T.StructField("min_similarity", T.DoubleType()),
    T.StructField("token_budget", T.IntegerType()),
])

# Fixed evaluation instant used by the adapters and the registered queries.
AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
