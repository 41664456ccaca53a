"""Registered queries that run a stream or exchange a file tree: each writes
its source from the driver's whole tables to the shared scratch folder, runs
the job over it to the end, and returns what the job stored."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn import schema as S
from cairn.plans import adapters as AD
from cairn.plans import catalog as C
from cairn.plans import oracle as O
from cairn.session import scratch_path
from cairn.operators import maintain as M
from cairn.operators import sessions as SE
from cairn.streaming import jobs as J
from cairn.streaming import session_calls as SC

register, Osql, AS = C.register, O.sql, O.AS_OF

#: Files of a replayed source that make one micro-batch, and time slices it arrives in.
FILES, SLICES = 4, 8


def _folder(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _ended(query):
    """Waits for an availableNow query; its failure is the caller's."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# ------------------------------------------------------------- streams (R)

@register("r1_stream_store", Osql("""
SELECT n.project, n.category, n.title, n.summary, n.entities, n.tags, n.metadata, n.priority, n.source, n.expires_at, n.created_at,
       CAST(to_json({'category': n.category, 'title': n.title, 'source': n.source, 'entities_extracted': CAST(len(n.entities) AS INTEGER)}) AS VARCHAR) AS details,
       n.op_seq, CAST(1 AS BIGINT) AS ids
FROM store_notes n""", "store_batch", extra=O.STORE_NOTES.strip()))
def r1_stream_store(spark, sf):
    """Every conversation turn sent twice, in several files; each note is
    stored once, with one audit row under the same id."""
    src, out = _folder(spark, "raw"), _folder(spark, "stored")
    raw = AD.store_batch(spark, sf).withColumn("ts", C._as_of()).select([f.name for f in J.RAW_NOTE.fields])
    raw.repartition(FILES).write.parquet(src)
    raw.repartition(FILES - 1).write.mode("append").parquet(src)  # sent again
    _ended(J.stream_store(spark, src, out, files_per_trigger=FILES - 1))
    notes = spark.read.parquet(f"{out}/notes").drop("batch_id")
    trail = spark.read.parquet(f"{out}/audit").select("project", F.col("memory_id").alias("id"), "details", "op_seq")
    ids = trail.groupBy("project", "op_seq").agg(F.count_distinct("id").alias("ids"))
    return notes.join(trail, ["project", "id"]).join(ids, ["project", "op_seq"]).select(
        "project", "category", "title", "summary", "entities", "tags", "metadata", "priority", "source", "expires_at",
        "created_at", "details", "op_seq", "ids")


@register("r2_stream_access", C.ORACLE["m5_bump_access"])
def r2_stream_access(spark, sf):
    """R2: the recall hits as a stream of files, folded into running totals that are then applied to the notes."""
    mem = AD.memories(spark, sf)
    _, hits, _ = M.recall(mem, AD.recall_requests(spark, sf), C._as_of())
    src, out = _folder(spark, "hits"), _folder(spark, "totals")
    hits.withColumn("ts", C._as_of()).select([f.name for f in J.HIT.fields]).repartition(SLICES).write.parquet(src)
    _ended(J.stream_access(spark, src, out, files_per_trigger=FILES))
    return J.apply_access(mem, J.access_totals(spark, out)).select("project", "id", "access_count")


@register("r3_stream_sessions", C.ORACLE["s3_read_sessions"])
def r3_stream_sessions(spark, sf):
    """The session calls as files that arrive out of order, a few to a batch."""
    src, out = _folder(spark, "calls"), _folder(spark, "updates")
    delay = SC.replay_files(spark, AD.session_events(spark, sf).filter(F.col("ts") <= C._as_of()), src, SLICES)
    _ended(SC.stream_sessions(spark, src, out, delay, files_per_trigger=FILES))
    return SC.sessions_from_updates(spark.read.schema(SC.SESSION_UPDATE).parquet(out))


# --------------------------------------------------------- file trees (S, C)

from cairn.functions import markdown as MD  # noqa: E402
from cairn.functions import score as V  # noqa: E402
from cairn.functions import text as X  # noqa: E402
from cairn.operators import listing as L  # noqa: E402
from cairn.operators import search as SR  # noqa: E402
from cairn.sources import markdown_tree as MT  # noqa: E402
from cairn.sources import note_files as NF  # noqa: E402
from cairn.sources import snapshot as SN  # noqa: E402


def _exported(spark, sf):
    """Every project's active notes as a tree in the shared folder: (counts, roots, totals)."""
    return MT.export_trees(AD.memories(spark, sf), _folder(spark, "trees"), C._as_of())


_RENDERED = f"""
rendered AS (SELECT project, category, substring({O.slugify_sql('title')}, 1, 60) AS stem, arg_max({O.render_sql()}, (title, id)) AS body
             FROM memories WHERE status = 'active' GROUP BY ALL)"""


@register("s6_read_tree", Osql("""
SELECT project, category, stem, replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, CAST(NULL AS VARCHAR) AS error
FROM rendered
UNION ALL SELECT 'none', NULL, NULL, NULL, 'No .memory directory found'""", "memories", extra=_RENDERED.strip()))
def s6_read_tree(spark, sf):
    """All projects' exported trees read back in one scan, and a root that has none."""
    _, roots, _ = _exported(spark, sf)
    rows = MT.read_trees(spark, roots | {"none": _folder(spark, "nothing")}, split_bytes=4 << 20)
    return rows.select("project", "category", "stem", "text", F.regexp_replace("error", " at .*", "").alias("error"))


_INDEX = f"""
act AS (SELECT * FROM memories WHERE status = 'active'),
cnt AS (SELECT project, category, count(*) AS n FROM act GROUP BY ALL),
tot AS (SELECT project, count(*) AS total FROM act GROUP BY ALL),
doc_lines AS (
  SELECT project, 0 AS k1, '' AS k2, i AS k3, '' AS k4, '' AS k5,
         ['# Memory Index - ' || project, '', 'Exported: ' || strftime({AS}, '%Y-%m-%d %H:%M'), '', 'Total: ' || total || ' memories', '',
          '## Categories', '', '| Category | Count |', '|----------|-------|'][i + 1] AS line FROM tot, range(10) AS r(i)
  UNION ALL SELECT project, 1, category, 0, '', '', '| [' || category || '](./' || category || '/) | ' || n || ' |' FROM cnt
  UNION ALL SELECT project, 1, chr(65535), 0, '', '', '' FROM tot
  UNION ALL SELECT project, 2, category, -2, '', '', '## ' || category FROM cnt
  UNION ALL SELECT project, 2, category, -1, '', '', '' FROM cnt
  UNION ALL SELECT project, 2, category, 0, title, id, '- [' || title || '](./' || category || '/' || substring({O.slugify_sql('title')}, 1, 60) || '.md) - ' || coalesce(summary, 'None') FROM act
  UNION ALL SELECT project, 2, category, 1, '', '', '' FROM cnt),
docs AS (SELECT project, string_split(string_agg(line, chr(10) ORDER BY k1, k2, k3, k4, k5), chr(10)) AS ls FROM doc_lines GROUP BY project)"""


@register("s8_index", Osql("""
SELECT project, line, CAST(sum(strlen(line) + 1) OVER (PARTITION BY project ORDER BY i) - strlen(line) - 1 AS BIGINT) AS at
FROM (SELECT project, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs)""", "memories", extra=_INDEX.strip()))
def s8_index(spark, sf):
    """The index documents written in parts and read back by byte ranges: every line at its place."""
    mem = AD.memories(spark, sf)
    active = mem.filter(F.col("status") == S.ACTIVE)
    top = _folder(spark, "indexes")
    roots = {r["project"]: f"{top}/{r['project']}" for r in active.select("project").distinct().collect()}
    MT.write_indexes(active, roots, C._as_of())
    return MT.read_indexes(spark, roots, split_bytes=64 << 10).select("project", "line", "at")


@register("c8_export", Osql("""
SELECT c.project, c.category, c.n AS exported, r.files, r.bytes, x.lines
FROM cnt c JOIN (SELECT project, category, count(*) AS files, CAST(sum(strlen(body)) AS BIGINT) AS bytes FROM rendered GROUP BY ALL) r USING (project, category)
JOIN (SELECT project, CAST(len(ls) AS BIGINT) AS lines FROM docs) x USING (project)""", "memories", extra=_RENDERED.strip() + "," + _INDEX))
def c8_export(spark, sf):
    """All projects exported; notes exported per category, and the files, bytes and index lines found in the trees."""
    counts, roots, _ = _exported(spark, sf)
    files = MT.count_files(spark, roots)
    lines = MT.read_indexes(spark, roots).groupBy("project").agg(F.count(F.lit(1)).alias("lines"))
    return counts.join(files, ["project", "category"]).join(lines, "project")


_IMPORTED = f"""
files AS (
  SELECT project, id, category,
         CASE WHEN regexp_full_match(title, '[0-9]+') THEN coalesce(nullif(ltrim(title, '0'), ''), '0') ELSE title END AS title,
         regexp_full_match(title, '[0-9]+') AS number, tags, priority, source,
         {O.strip_ws("array_to_string(CASE WHEN r > 0 THEN ls[1:r - 1] ELSE ls END, chr(10))")} AS content
  FROM (SELECT *, list_position(list_transform(ls, lambda l: starts_with(l, '## Related')), true) AS r
        FROM (SELECT *, string_split({O.strip_ws("replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))")}, chr(10)) AS ls FROM import_parsed))
  WHERE category <> 'misc'),
tree_diff AS (
  SELECT f.*, m.id IS NOT NULL AS found, m.priority AS m_priority, m.source AS m_source, m.expires_at AS m_expires,
         CASE WHEN f.content = '' THEN 'skipped'
              WHEN m.id IS NOT NULL AND (m.content IS DISTINCT FROM f.content OR m.title IS DISTINCT FROM f.title OR f.number) THEN 'updated'
              WHEN m.id IS NOT NULL THEN 'skipped' ELSE 'created' END AS outcome
  FROM files f LEFT JOIN memories m ON m.project = f.project AND m.id = f.id)"""


@register("c9_import", Osql(f"""
SELECT project, outcome AS kind, CASE WHEN found THEN id END AS id, title, content, {O.summary_sql('title', 'content')} AS summary, tags,
       CASE WHEN found THEN m_priority ELSE CAST({O.rule_priority_sql('category', 'coalesce(priority, 0)')} AS INTEGER) END AS priority,
       CASE WHEN found THEN m_source ELSE source END AS source,
       CASE WHEN found THEN m_expires ELSE {O.expiry_sql('category', O.rule_priority_sql('category', 'coalesce(priority, 0)'), AS)} END AS expires_at,
       CAST(NULL AS BIGINT) AS n
FROM tree_diff WHERE outcome IN ('created', 'updated')
UNION ALL
SELECT DISTINCT project, 'error', NULL, 'Unknown category: misc', NULL, NULL, CAST(NULL AS VARCHAR[]), NULL, NULL, CAST(NULL AS TIMESTAMP), NULL
FROM import_parsed WHERE category = 'misc'
UNION ALL
SELECT project, 'report ' || o.kind, NULL, NULL, NULL, NULL, CAST(NULL AS VARCHAR[]), NULL, NULL, CAST(NULL AS TIMESTAMP),
       count(*) FILTER (WHERE outcome = o.kind) + CASE WHEN o.kind = 'error' AND any_value(project) IN (SELECT project FROM import_parsed WHERE category = 'misc') THEN 1 ELSE 0 END
FROM tree_diff, (SELECT unnest(['created', 'updated', 'skipped', 'error']) AS kind) o GROUP BY project, o.kind""",
    "memories", "import_parsed", extra=_IMPORTED.strip()))
def c9_import(spark, sf):
    """Every document written as a note file of its project, the trees then imported into the note table."""
    top = _folder(spark, "import")
    p = AD.import_parsed(spark, sf)
    none, no_list = F.lit(None).cast("string"), F.array().cast(S.STR_ARRAY)
    body = MD.render("id", "category", "title", F.lit(S.ACTIVE), "priority", "tags", no_list, "source", F.lit(None).cast(S.TS),
                     F.lit(None).cast(S.TS), F.lit(None).cast(S.TS), none, none, "content", no_list)
    rel = F.concat("project", F.lit(f"/{S.EXPORT_DIR_NAME}/"), "category", F.lit("/note-"), F.col("op_seq").cast("string"), F.lit(".md"))
    NF.register(spark)
    p.select(rel.alias("rel"), body.alias("body")).write.format("note_files").mode("append").save(top)
    roots = {r["project"]: f"{top}/{r['project']}" for r in p.select("project").distinct().collect()}
    created, updated, _, report, errors = MT.import_trees(AD.memories(spark, sf), roots, C._as_of(), "import")
    cols = ["title", "content", "summary", "tags", "priority", "source", "expires_at"]
    rows = created.select("project", F.lit("created").alias("kind"), none.alias("id"), *cols).unionByName(
        updated.select("project", F.lit("updated").alias("kind"), "id", *cols))
    rows = rows.unionByName(errors.select("project", F.lit("error").alias("kind"), F.col("error").alias("title")), allowMissingColumns=True)
    counts = report.unpivot("project", list(M.IMPORT_OUTCOMES), "outcome", "n").select("project", F.concat(F.lit("report "), "outcome").alias("kind"), F.col("n"))
    return rows.unionByName(counts, allowMissingColumns=True)


# ------------------------------------------------------------ search (T)

@register("t1_vector_topk_pivots", O.search_topk_sql())
def t1_vector_topk_pivots(spark, sf):
    """T1 over a pivot index of all searchable notes."""
    c = SR.candidates(AD.search_queries(spark, sf), AD.memories(spark, sf), C._as_of(), apply_min_similarity=False,
                      strategy="pivots", block_rows=200, query_block_rows=200)
    return c.select("query_id", "id", "rank_d", V.round_places(V.snap(F.lit(1.0) - F.col("distance"))).alias("similarity"))


# ------------------------------------------------------- served shapes (P)

@register("p2_search_index", f"SELECT query_id, rank, id, title, summary, category, similarity FROM ({O.search_sql()})")
def p2_search_index(spark, sf):
    """The light rows of all searches."""
    mem, qs = AD.memories(spark, sf), AD.search_queries(spark, sf)
    return L.search_index(SR.attach_notes(SR.rerank(SR.candidates(qs, mem, C._as_of()), qs, C._as_of()), mem, ["title", "summary"]))


@register("p3_project_info", Osql("""
SELECT *, CAST(row_number() OVER (ORDER BY last_accessed DESC NULLS LAST, slug) AS INTEGER) AS position FROM registry""", "registry"))
def p3_project_info(spark, sf):
    """All projects, newest access first."""
    from cairn.operators.ranking import rank_within
    info = SN.project_info(AD.registry(spark, sf))
    return rank_within(info, [], [F.col("last_accessed").desc_nulls_last(), F.col("slug")])


# ------------------------------------------------ bucketed rewrites (M2-M6)

_HITS = C.ORACLE["m5_bump_access"]


@register("m3_bucketed_rewrites", Osql(f"""
SELECT m.project, m.id, b.access_count,
       CASE WHEN d.id IS NOT NULL THEN 'archived' WHEN m.status = 'active' AND m.expires_at IS NOT NULL AND m.expires_at <= {AS} THEN 'expired'
            ELSE m.status END AS status,
       CASE WHEN d.id IS NOT NULL THEN {AS} ELSE m.updated_at END AS updated_at
FROM memories m JOIN ({_HITS}) b ON b.project = m.project AND b.id = m.id
LEFT JOIN (SELECT DISTINCT project, id FROM soft_delete_ids) d ON d.project = m.project AND d.id = m.id""", "memories", "soft_delete_ids"))
def m3_bucketed_rewrites(spark, sf):
    """M3, M5 and M6 one after another on a bucketed note table, a generation each."""
    from cairn.sources.buckets import NoteTable
    notes = NoteTable(spark, _folder(spark, "bucketed"), buckets=16)
    notes.commit(AD.memories(spark, sf))
    first = notes.read()  # as stored: it stands until the bump is committed
    _, hits, _ = M.recall(first, AD.recall_requests(spark, sf), C._as_of())
    notes.commit(M.soft_delete(notes.read(), AD.soft_delete_ids(spark, sf), C._as_of())[0])
    notes.commit(M.bump_access(notes.read(), hits))
    notes.commit(L.sweep_expired(notes.read(), C._as_of()))
    return notes.read().select("project", "id", "access_count", "status", "updated_at")


# -------------------------------------------------------------- JSON

@register("e15_metadata_json", Osql("""
SELECT project, id, 'object' AS kind, CAST(metadata ->> '$.conv' AS BIGINT) AS conv, CAST(metadata ->> '$.turn' AS INTEGER) AS turn,
       CAST(NULL AS VARCHAR) AS missing, category, title, source, CAST(len(entities) AS INTEGER) AS entities_extracted
FROM store_notes""", "store_batch", extra=O.STORE_NOTES.strip()))
def e15_metadata_json(spark, sf):
    """The metadata of all stored notes and the details of their audit rows decoded."""
    notes, trail, _ = M.store(AD.store_batch(spark, sf), C._as_of(), "store")
    of = lambda name, kind="string": X.json_field("details", f"$.{name}", kind).alias(name)
    details = trail.select("project", F.col("memory_id").alias("id"), of("category"), of("title"), of("source"), of("entities_extracted", "int"))
    return notes.select("project", "id", X.json_kind("metadata").alias("kind"), X.json_field("metadata", "$.conv", "long").alias("conv"),
                        X.json_field("metadata", "$.turn", "int").alias("turn"), X.json_field("metadata", "$.none").alias("missing")).join(details, ["project", "id"])
