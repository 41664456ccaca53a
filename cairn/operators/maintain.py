"""Table maintenance as set-based jobs.

Each operator takes the current table plus a batch of requests and returns the
new state (or the touched rows) and, where the reference writes an audit row,
an audit DataFrame. Row-level UPDATE/DELETE on Parquet does not exist; callers
persist new state with ``sources.tables.overwrite_projects`` (dynamic
partition overwrite of the touched projects only).

Batches carry ``op_seq``: calls in the reference are sequential, so when a
batch holds several requests for one note the later one wins field by field.
Those "last non-null per field" rules are grouped aggregates (``max_by``),
which combine map-side, so a note with millions of patches never lands in one
task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.functions import text as X
from cairn.operators import filters as FL

AUDIT_COLUMNS = ["project", "memory_id", "operation", "details", "created_at", "op_seq"]


def json_obj(*cols: Column) -> Column:
    """A JSON object of the given (aliased) columns; NULL values are kept as
    ``null`` like Python's ``json.dumps``."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def audit(df: DataFrame, memory_id: str, operation: str | Column, details: Column | None,
          created_at, op_seq: str = "op_seq") -> DataFrame:
    """Audit rows; empty details -> NULL."""
    op = F.lit(operation) if isinstance(operation, str) else operation
    det = F.lit(None).cast("string") if details is None else details
    det = F.when(det.isin("{}", "null"), F.lit(None).cast("string")).otherwise(det)
    return df.select(F.col("project"), F.col(memory_id).alias("memory_id"), op.alias("operation"),
                     det.alias("details"), FL._ts(created_at).alias("created_at"),
                     F.col(op_seq).cast("long").alias("op_seq"))


# ------------------------------------------------------------- lookups

#: Slots of the filter that keeps unrequested notes out of a lookup's shuffle,
#: and the table size from which it is built.
LOOKUP_SLOTS = 1 << 20
FILTER_BYTES_CONF = "cairn.lookup.filterBytes"
DEFAULT_FILTER_BYTES = 1 << 30


def requested(memories: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``memories`` whose ``keys`` may be among those of
    ``requests``: a semi-join on a hash cut to ``LOOKUP_SLOTS`` values. The
    broadcast side has at most that many longs, however many requests there
    are; rows let through by chance fall out of the exact join that follows.
    A table smaller than ``cairn.lookup.filterBytes`` is joined as it is."""
    from cairn.operators.ranking import estimated_bytes
    least = int(memories.sparkSession.conf.get(FILTER_BYTES_CONF, str(DEFAULT_FILTER_BYTES)))
    size = estimated_bytes(memories)
    if size is not None and size < least:
        return memories
    slot = F.pmod(F.xxhash64(*keys), F.lit(LOOKUP_SLOTS)).alias("_slot")
    slots = requests.select(slot).distinct()
    return memories.select("*", slot).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")


def lookup_by_id(memories: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact id, any status. Returns (found, not_found)."""
    found = requests.join(requested(memories, requests, ["project", "id"]), ["project", "id"], "inner")
    missing = requests.join(memories.select("project", "id"), ["project", "id"], "left_anti")
    return found, missing


def first_by_title(memories: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(project, title, id): the note a title lookup returns, i.e. active,
    newest ``updated_at``, ties by the larger id. One grouped ``max_by`` per
    (project, title) over ids only, so a title shared by a third of all rows
    is reduced map-side and no text rides in the buffer. With ``requests``
    only titles that may be asked for are grouped."""
    thin = FL.by_status(memories, S.ACTIVE).select("project", "title", "id", "updated_at")
    if requests is not None:
        thin = requested(thin, requests, ["project", "title"])
    return thin.groupBy("project", "title").agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"))


def lookup_by_title(memories: DataFrame, requests: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact title, active only, first match. The id is found first; the
    note's ``columns`` (default: all) come from one join by id."""
    named = requests.drop("id").join(first_by_title(memories, requests), ["project", "title"], "inner")
    keep = [c for c in (columns or memories.columns) if c not in ("project", "id", "title")]
    notes = requested(memories, named, ["project", "id"]).select("project", "id", *keep)
    return named.join(notes, ["project", "id"], "inner")


def recall(memories: DataFrame, requests: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests (request_id, project, id, title, op_seq). The id wins when
    both are given; neither -> rejected. Returns (answers, access events,
    audit). Answers carry the served note (P1) as read, before the increment
    (Q8); a batch reads its notes once, so repeated requests for a note show
    the same count (sequential calls would count up).

    Titles become ids first, over thin rows; the notes' texts are read for one
    last join by id, behind a filter of the requested ids."""
    has_id = F.col("id").isNotNull() & (F.col("id") != "")
    has_title = F.col("title").isNotNull() & (F.col("title") != "")
    r = requests.select("request_id", "project", "id", "title", "op_seq",
                        has_id.alias("_by_id"), (~has_id & has_title).alias("_by_title"))
    keep = ["category", "status", "access_count", "content", "summary", "tags", "metadata", "priority", "source",
            "related_ids", "entities", "created_at", "updated_at", "expires_at"]
    asked = r.filter(F.col("_by_title")).select("project", "title")
    named = first_by_title(memories, asked).select("project", "title", F.col("id").alias("_fid"), F.lit(True).alias("_by_title"))
    r = r.join(named, ["project", "title", "_by_title"], "left").withColumn(
        "_target", F.when(F.col("_by_id"), F.col("id")).otherwise(F.col("_fid")))
    wanted = r.select("project", F.col("_target").alias("id"))
    m = requested(memories, wanted, ["project", "id"]).select(
        "project", F.col("id").alias("_target"), F.col("title").alias("_t"), F.lit(True).alias("_found"), *keep)
    j = r.join(m, ["project", "_target"], "left")
    outcome = (F.when(~F.col("_by_id") & ~F.col("_by_title"), F.lit("Provide either memory_id or title"))
               .when(F.col("_found").isNull(), F.lit("Memory not found")).otherwise(F.lit("ok")))
    answers = j.select(
        "request_id", "project",
        F.when(F.col("_by_id"), F.col("id")).otherwise(F.col("_fid")).alias("id"),
        F.when(F.col("_by_id"), F.col("_t")).when(F.col("_by_title"), F.col("title")).alias("title"),
        "op_seq", *keep, outcome.alias("outcome"))
    hits = answers.filter(F.col("outcome") == "ok")
    trail = audit(hits, "id", "access", json_obj(F.lit("recall").alias("method")), as_of)
    return answers, hits.select("project", "id", "op_seq"), trail


def bump_access(memories: DataFrame, hits: DataFrame) -> DataFrame:
    """M5: +1 per hit. Hits are pre-counted per note (partial aggregate)
    before the join, so the join side is one row per touched note."""
    n = hits.groupBy("project", "id").agg(F.count(F.lit(1)).alias("_hits"))
    return (memories.join(n, ["project", "id"], "left")
            .withColumn("access_count", (F.col("access_count") + F.coalesce("_hits", F.lit(0))).cast("int"))
            .drop("_hits"))


def drop_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose (project, id) is not listed."""
    return memories.join(ids.select("project", "id"), ["project", "id"], "left_anti")


# --------------------------------------------------------------- store

def enriched(valid: DataFrame, as_of, run_id: str, embedder=None) -> DataFrame:
    """The notes that M1 stores for valid rows of a batch, with their ``op_seq``."""
    if not run_id:
        raise ValueError("run_id names the batch: without one, storing a note twice would give one id")
    ts = FL._ts(as_of)
    prio = X.rule_priority("category", F.coalesce("priority", F.lit(0)))
    ok = X.with_summary(valid, "title", "content", "_summary")
    ok = X.with_entities(ok.withColumn("_etext", F.concat(F.col("title"), F.lit(" "), F.col("content"))),
                         "_etext", "_entities")
    notes = ok.select(
        "project",
        X.note_id("project", "title", "content", "op_seq", F.lit(run_id)).alias("id"),
        "category", "title", "content",
        F.col("_summary").alias("summary"),
        F.coalesce("tags", F.array().cast(S.STR_ARRAY)).alias("tags"),
        F.when(F.col("metadata").isin("{}", "null"), F.lit(None).cast("string"))
         .otherwise(F.col("metadata")).alias("metadata"),
        F.lit(None).cast(S.VECTOR).alias("embedding"),
        F.lit(S.ACTIVE).alias("status"),
        prio.cast("int").alias("priority"),
        F.coalesce("source", F.lit("assistant")).alias("source"),
        F.coalesce("related_ids", F.array().cast(S.STR_ARRAY)).alias("related_ids"),
        F.col("_entities").alias("entities"),
        F.lit(0).alias("access_count"),
        X.expiry("category", prio, ts).alias("expires_at"),
        ts.alias("created_at"), ts.alias("updated_at"),
        "op_seq")
    if embedder is not None:
        notes = embedder.embed(notes.withColumn("_etext", X.embedding_text("title", "content")),
                               "_etext", "embedding").drop("_etext")
    return notes


def create_trail(notes: DataFrame) -> DataFrame:
    """M15 for ``enriched`` notes: one create row each."""
    details = json_obj(F.col("category"), F.col("title"), F.col("source"),
                       F.size("entities").alias("entities_extracted"))
    return audit(notes, "id", "create", details, F.col("created_at"))


def store(batch: DataFrame, as_of, run_id: str, embedder=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1: validate (F8), raise rule priority (E11), derive summary (E1),
    entities (E9), expiry from the raised priority (E10), vector (E13 + V6),
    and an id; status active, access 0, created = updated = ``as_of``.

    ``batch``: project, category, title, content, tags, metadata (JSON text
    or NULL), priority, source, related_ids, op_seq. Returns (notes, audit,
    rejected). A repeatable id is derived from (project, title, content,
    op_seq, ``run_id``) instead of a random UUID: every batch that is stored
    has its own ``run_id``, so the same note stored twice gets two ids, while
    a repeated attempt of one batch gets the same.
    """
    ok, rejected = FL.valid_category(batch)
    notes = enriched(ok, as_of, run_id, embedder)
    return notes.drop("op_seq"), create_trail(notes), rejected


# -------------------------------------------------------------- update

PATCH_FIELDS = ["title", "content", "tags", "metadata", "status", "priority", "related_ids"]


def _last_non_null(field: str) -> Column:
    return F.max_by(F.col(field), F.when(F.col(field).isNotNull(), F.col("op_seq")))


def patch_join(memories: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlay the given fields of all valid patches of a note on the
    stored row (last non-null per field by ``op_seq``).

    Returns (overlaid, rejected): rejected holds unknown ids and empty patches
    with a reason. The overlaid row also carries ``derive_title`` /
    ``derive_content``: the texts the last title/content-changing call used to
    re-derive summary, entities and vector, which follow the reference's
    ``new or existing`` rule (an empty string falls back to the value stored
    before that call, Q10).
    """
    given = F.lit(False)
    for f in PATCH_FIELDS:
        given = given | F.col(f).isNotNull()
    stored = memories.select("project", "id", F.lit(True).alias("_stored"))
    unknown, nothing = F.col("_stored").isNull(), ~given
    rejected = (patches.join(stored, ["project", "id"], "left").filter(unknown | nothing)
                .withColumn("reason", F.when(unknown, F.concat(F.lit("Memory '"), F.col("id"), F.lit("' not found")))
                            .otherwise(F.lit("No fields to update"))).drop("_stored"))
    # Aggregated before any join: unknown ids fall out of the join below.
    valid = patches.filter(given)

    text_call = F.col("title").isNotNull() | F.col("content").isNotNull()
    # One grouped pass (partial aggregation before the shuffle): last
    # non-null per field, the last title/content-changing call k* with its
    # title and content, and the op_seq of the latest title and content.
    agg = valid.groupBy("project", "id").agg(
        *[_last_non_null(f).alias(f"p_{f}") for f in PATCH_FIELDS],
        F.max(F.when(text_call, F.col("op_seq"))).alias("k_star"),
        F.max_by(F.col("title"), F.when(text_call, F.col("op_seq"))).alias("k_title"),
        F.max_by(F.col("content"), F.when(text_call, F.col("op_seq"))).alias("k_content"),
        F.max(F.when(F.col("title").isNotNull(), F.col("op_seq"))).alias("t_seq"),
        F.max(F.when(F.col("content").isNotNull(), F.col("op_seq"))).alias("c_seq"),
        F.count(F.lit(1)).alias("n_patches"))
    # The value stored just before k* is the latest one, unless k* itself set
    # it; it only matters when k* gave an empty string (Q10). Only those
    # notes need a second look, restricted to their earlier patches.
    empty_t = (F.col("t_seq") == F.col("k_star")) & (F.col("k_title") == "")
    empty_c = (F.col("c_seq") == F.col("k_star")) & (F.col("k_content") == "")
    need = agg.filter(empty_t | empty_c).select("project", "id", F.col("k_star").alias("_k"))
    earlier = valid.join(need, ["project", "id"]).filter(F.col("op_seq") < F.col("_k"))
    second = earlier.groupBy("project", "id").agg(
        _last_non_null("title").alias("t_before"), _last_non_null("content").alias("c_before"))
    agg = agg.join(second, ["project", "id"], "left")
    agg = (agg.withColumn("prev_title", F.when(F.col("t_seq") == F.col("k_star"), F.col("t_before"))
                          .otherwise(F.col("p_title")))
              .withColumn("prev_content", F.when(F.col("c_seq") == F.col("k_star"), F.col("c_before"))
                          .otherwise(F.col("p_content"))))
    m = memories.join(agg, ["project", "id"], "inner")

    def derive(f):
        # `new or existing`: empty or missing -> the value stored before the call.
        stored_before = F.coalesce(F.col(f"prev_{f}"), F.col(f))
        return F.when(F.col(f"k_{f}").isNull() | (F.col(f"k_{f}") == ""), stored_before).otherwise(F.col(f"k_{f}"))

    out = m.select(
        *[c for c in memories.columns if c not in PATCH_FIELDS],
        *[F.coalesce(F.col(f"p_{f}"), F.col(f)).alias(f) for f in PATCH_FIELDS],
        F.col("k_star").isNotNull().alias("text_changed"),
        derive("title").alias("derive_title"), derive("content").alias("derive_content"),
        "n_patches")
    return out, rejected


def update(memories: DataFrame, patches: DataFrame, as_of, embedder=None):
    """M2: apply patches; when a title or content was given, re-derive
    summary, entities and vector from ``derive_title``/``derive_content``.
    Never recomputes expiry or the rule floor, accepts any status (Q11).
    Returns (touched notes, audit, rejected); audit has one row per applied
    call with its ``changed_fields``."""
    over, rejected = patch_join(memories, patches)
    ts = FL._ts(as_of)
    over = X.with_summary(over, "derive_title", "derive_content", "_summary")
    over = X.with_entities(over.withColumn(
        "_etext", F.concat(F.col("derive_title"), F.lit(" "), F.col("derive_content"))), "_etext", "_entities")
    out = over.withColumn("summary", F.when(F.col("text_changed"), F.col("_summary")).otherwise(F.col("summary"))) \
              .withColumn("entities", F.when(F.col("text_changed"), F.col("_entities")).otherwise(F.col("entities"))) \
              .withColumn("updated_at", ts).drop("_summary", "_entities", "_etext")
    if embedder is not None:
        out = embedder.embed(out.withColumn("_etext", X.embedding_text("derive_title", "derive_content")),
                             "_etext", "_new_vec")
        out = out.withColumn("embedding", F.when(F.col("text_changed"), F.col("_new_vec"))
                             .otherwise(F.col("embedding"))).drop("_etext", "_new_vec")
    fields = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in PATCH_FIELDS]),
                      lambda x: x.isNotNull())
    # names of the given fields only: no text rides through the join
    given = patches.select("project", "id", "op_seq", fields.alias("_fields")).filter(F.size("_fields") > 0) \
        .join(memories.select("project", "id"), ["project", "id"], "left_semi")
    trail = audit(given, "id", "update", json_obj(F.col("_fields").alias("changed_fields")), as_of)
    return out.drop("text_changed", "derive_title", "derive_content", "n_patches"), trail, rejected


def merged(memories: DataFrame, touched: DataFrame) -> DataFrame:
    """The note table with the rows of ``touched`` (same columns) in place of
    its own, for operators that return the touched notes only (M2, M8)."""
    rest = [c for c in memories.columns if c not in ("project", "id")]
    new = touched.select("project", "id", F.struct(*rest).alias("_new"))
    j = memories.join(new, ["project", "id"], "left")
    return j.select("project", "id", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in rest]) \
        .select(memories.columns)


# -------------------------------------------------------------- delete

def _requests_found(memories: DataFrame, ids: DataFrame):
    found = ids.join(memories.select("project", "id"), ["project", "id"], "left_semi")
    missing = ids.join(memories.select("project", "id"), ["project", "id"], "left_anti").withColumn(
        "reason", F.concat(F.lit("Memory '"), F.col("id"), F.lit("' not found")))
    return found, missing


def soft_delete(memories: DataFrame, ids: DataFrame, as_of):
    """M3: archive listed notes, ``updated_at`` = as_of; audit first, with the
    reason. ``ids``: project, id, reason, op_seq. Returns (state, audit,
    rejected)."""
    found, missing = _requests_found(memories, ids)
    hit = found.select("project", "id").distinct().withColumn("_hit", F.lit(True))
    state = (memories.join(hit, ["project", "id"], "left")
             .withColumn("status", F.when(F.col("_hit"), F.lit(S.ARCHIVED)).otherwise(F.col("status")))
             .withColumn("updated_at", F.when(F.col("_hit"), FL._ts(as_of)).otherwise(F.col("updated_at")))
             .drop("_hit"))
    trail = audit(found, "id", "soft_delete", json_obj(F.col("reason").alias("reason")), as_of)
    return state, trail, missing


def hard_delete(memories: DataFrame, ids: DataFrame, as_of):
    """M4: remove listed notes (J6); the audit rows stay. Of several calls for
    one note the first by ``op_seq`` removes it and the others find nothing.
    Returns (state, audit, rejected)."""
    found, missing = _requests_found(memories, ids)
    first = found.groupBy("project", "id").agg(F.min("op_seq").alias("_first"))
    found = found.join(first, ["project", "id"])
    late = found.filter(F.col("op_seq") > F.col("_first")).drop("_first").withColumn(
        "reason", F.concat(F.lit("Memory '"), F.col("id"), F.lit("' not found")))
    found = found.filter(F.col("op_seq") == F.col("_first")).drop("_first")
    missing = missing.unionByName(late)
    trail = audit(found, "id", "hard_delete", json_obj(F.col("reason").alias("reason")), as_of)
    return drop_ids(memories, found), trail, missing


# -------------------------------------------------------------- import

IMPORT_OUTCOMES = ("created", "updated", "skipped", "error")


def import_diff(parsed: DataFrame, memories: DataFrame) -> DataFrame:
    """Classify parsed notes against stored ones (any status): invalid
    category -> error; no content -> skipped; id found and title or content
    differ -> updated; id found and equal -> skipped; otherwise created. A
    title that front matter reads as a number or list (``title_not_text``)
    never equals the stored text; a new note whose priority is no number
    (``priority_not_number``) is an error, and so is a note to store or update
    whose tags are no list (``tags_not_list``)."""
    for flag in ("title_not_text", "priority_not_number", "tags_not_list"):
        if flag not in parsed.columns:
            parsed = parsed.withColumn(flag, F.lit(False))
    m = memories.select("project", "id", F.col("title").alias("_t"), F.col("content").alias("_c"),
                        F.lit(True).alias("_found"))
    j = parsed.join(m, ["project", "id"], "left")
    changed = F.col("_found") & (~F.col("_c").eqNullSafe(F.col("content")) | ~F.col("_t").eqNullSafe(F.col("title")) |
                                 F.coalesce("title_not_text", F.lit(False)))
    no_list = F.coalesce("tags_not_list", F.lit(False))
    outcome = (F.when(~F.coalesce(F.col("category").isin(*S.CATEGORIES), F.lit(False)), F.lit("error"))
               .when(F.col("content").isNull() | (F.col("content") == ""), F.lit("skipped"))
               .when(no_list & (changed | F.col("_found").isNull()), F.lit("error"))
               .when(changed, F.lit("updated"))
               .when(F.col("_found"), F.lit("skipped"))
               .when(F.coalesce("priority_not_number", F.lit(False)), F.lit("error"))
               .otherwise(F.lit("created")))
    known = F.coalesce(F.col("category").isin(*S.CATEGORIES), F.lit(False))
    reason = F.when(outcome == "error", F.when(known & no_list & F.col("_found"), F.concat(F.lit("Update "), F.col("id"), F.lit(": tags are no list")))
                    .when(known & no_list, F.concat(F.lit("Insert "), F.col("title"), F.lit(": tags are no list")))
                    .when(known, F.concat(F.lit("Insert "), F.col("title"), F.lit(": priority is not a number")))
                    .otherwise(F.concat(F.lit("Unknown category: "), F.coalesce("category", F.lit("")))))
    return j.withColumn("outcome", outcome).withColumn("reason", reason).drop("_t", "_c", "_found", "title_not_text", "priority_not_number", "tags_not_list")


def import_apply(memories: DataFrame, diff: DataFrame, as_of, run_id: str, embedder=None):
    """M8: creates as in M1 (source / priority / tags of the file, its
    metadata text as a JSON string, new id even when the file's id is
    unknown, Q14); updates set title, content, summary, entities, vector,
    tags and ``updated_at`` only. ``run_id`` names this import: another run
    gives other ids to the same files. Returns (new notes, updated notes, audit)."""
    from cairn.functions.markdown import json_string

    new = diff.filter(F.col("outcome") == "created").withColumn(
        "source", F.coalesce("source", F.lit("import")))
    meta = F.when(F.col("metadata") != "", json_string(F.col("metadata")))
    created, trail_c, _ = store(new.select("project", "category", "title", "content", "tags", meta.alias("metadata"),
                                           "priority", "source",
                                           F.array().cast(S.STR_ARRAY).alias("related_ids"), "op_seq"),
                                as_of, run_id, embedder)
    trail_c = trail_c.withColumn("details", json_obj(F.lit("import").alias("source")))
    upd = diff.filter(F.col("outcome") == "updated").select(
        "project", "id", F.col("title").alias("n_title"), F.col("content").alias("n_content"),
        F.col("tags").alias("n_tags"), "op_seq")
    ts = FL._ts(as_of)
    u = (memories.join(upd, ["project", "id"], "inner")
         .withColumn("title", F.col("n_title")).withColumn("content", F.col("n_content"))
         .withColumn("tags", F.coalesce("n_tags", F.array().cast(S.STR_ARRAY)))
         .withColumn("updated_at", ts))
    u = X.with_summary(u, "title", "content")
    u = X.with_entities(u.withColumn("_etext", F.concat(F.col("title"), F.lit(" "), F.col("content"))),
                        "_etext").drop("_etext")
    if embedder is not None:
        u = embedder.embed(u.withColumn("_etext", X.embedding_text("title", "content")), "_etext", "embedding") \
            .drop("_etext")
    trail_u = audit(u, "id", "update", json_obj(F.lit("import").alias("source")), as_of)
    return created, u.drop("n_title", "n_content", "n_tags", "op_seq"), trail_c.unionByName(trail_u)


def import_report(diff: DataFrame) -> DataFrame:
    """A4: created / updated / skipped / error counts per project."""
    return diff.groupBy("project").agg(
        *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in IMPORT_OUTCOMES])


def reembed_impact(memories: DataFrame) -> DataFrame:
    """A5: active notes per project that a model switch re-embeds."""
    return FL.by_status(memories, S.ACTIVE).groupBy("project").agg(F.count(F.lit(1)).alias("to_reembed"))


# ------------------------------------------------------------ registry

def upsert_projects(registry: DataFrame, batch: DataFrame, as_of, root: str = "projects") -> DataFrame:
    """Batch (slug, display_name, description, op_seq). Invalid slugs are
    slugified first; the last call per slug wins. Known slug: new name and
    description (may become NULL), last_accessed = as_of. Unknown: insert."""
    ts = FL._ts(as_of)
    b = batch.withColumn("slug", F.when(X.valid_slug("slug"), F.col("slug")).otherwise(X.slugify("slug")))
    last = b.groupBy("slug").agg(F.max_by(F.struct("display_name", "description"), "op_seq").alias("b"))
    j = registry.join(last, "slug", "full_outer")
    hit = F.col("b").isNotNull()
    return j.select(
        "slug",
        F.when(hit, F.col("b.display_name")).otherwise(F.col("display_name")).alias("display_name"),
        F.when(hit, F.col("b.description")).otherwise(F.col("description")).alias("description"),
        F.coalesce("created_at", ts).alias("created_at"),
        F.when(hit, ts).otherwise(F.col("last_accessed")).alias("last_accessed"),
        F.coalesce("db_path", F.concat(F.lit(root.rstrip("/") + "/"), F.col("slug"))).alias("db_path"))


def touch_projects(registry: DataFrame, events: DataFrame) -> DataFrame:
    """last_accessed = the latest touching call (store / session start)
    per slug; events: (slug, ts). Pre-aggregated, then one row per slug joins."""
    last = events.groupBy("slug").agg(F.max("ts").alias("_ts"))
    return (registry.join(last, "slug", "left")
            .withColumn("last_accessed", F.coalesce("_ts", "last_accessed")).drop("_ts"))


def delete_projects(registry: DataFrame, slugs: DataFrame) -> DataFrame:
    """Registry rows not listed (the data stays)."""
    return registry.join(slugs.select("slug"), "slug", "left_anti")


# ---------------------------------------------------------------- audit

def trail(provenance: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Audit rows of the listed notes (project, id; all when
    None) with their position by (created_at, op_seq) and the note's total. A
    note id may occur in several projects (snapshots copy ids), so a note is
    (project, memory_id)."""
    from cairn.operators.ranking import rank_within
    p = provenance if ids is None else provenance.join(
        ids.select("project", F.col("id").alias("memory_id")).distinct(), ["project", "memory_id"], "left_semi")
    totals = trail_total(p)
    ranked = rank_within(p, ["project", "memory_id"], [F.col("created_at").asc_nulls_last(), F.col("op_seq")])
    return ranked.join(totals, ["project", "memory_id"])


def trail_total(provenance: DataFrame) -> DataFrame:
    """Number of audit rows per note of a project."""
    return provenance.groupBy("project", "memory_id").agg(F.count(F.lit(1)).alias("total"))
