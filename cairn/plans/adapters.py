"""Adapters: the driver's test tables -> the note tables this library works on.

The same derivations are written independently in SQL in ``plans.oracle``;
the two must agree row for row. Every adapter reads whole tables: attribute
rules use the row id only to *derive* values (category, status, ...), never to
select a subset of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.functions import text as X


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work (regex over whole texts) at least one
    partition per core. At scale the scan already has far more splits than
    cores and this is a no-op; on a small file with few row groups it is one
    round-robin exchange."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no SparkContext / RDD API available
        return df
    return df.repartition(cores) if n < cores else df


def as_of_col():
    return F.lit(S.AS_OF).cast(S.TS)


_STORED: dict[str, str] = {}


def use_stored_memories(sf_dir: str, path: str | None) -> None:
    """Serve ``memories(spark, sf_dir)`` from a table already written at
    ``path`` (the enriched table as a deployment would store it)."""
    if path is None:
        _STORED.pop(sf_dir.rstrip("/"), None)
    else:
        _STORED[sf_dir.rstrip("/")] = path


def materialize_memories(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Derive and write the ``memories`` table partitioned by project."""
    derive_memories(spark, sf_dir).write.mode("overwrite").partitionBy("project").parquet(path)
    return path


def memories(spark: SparkSession, sf_dir: str, as_of=None) -> DataFrame:
    """The note table: the stored one when registered, else derived."""
    stored = _STORED.get(sf_dir.rstrip("/"))
    if stored is not None and as_of is None:
        return spark.read.schema(S.MEMORIES).parquet(stored)
    return derive_memories(spark, sf_dir, as_of)


def derive_memories(spark: SparkSession, sf_dir: str, as_of=None) -> DataFrame:
    """The ``memories`` table derived from documents, embeddings and events.

    One row per document. Plan: documents and embeddings join on their id
    (shuffle join at scale, co-partitioned by id); view counts are
    pre-aggregated per user before their join, so the events table never
    shuffles whole.
    """
    as_of = as_of_col() if as_of is None else as_of
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    vecs = _read(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding"))
    views = (_read(spark, sf_dir, "events").filter(F.col("event_type") == "view")
             .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_views")))

    d = (docs.join(vecs, docs.doc_id == vecs.vec_id, "left")
         .join(views, docs.doc_id == views.user_id, "left"))
    i = F.col("doc_id")
    cats = F.array(*[F.lit(c) for c in S.CATEGORIES])
    raw_priority = (F.when(i % 23 == 0, 2).when(i % 5 == 0, 1).otherwise(0)).cast("int")
    category = F.element_at(cats, (i % len(S.CATEGORIES) + 1).cast("int"))
    created = F.timestamp_add("DAY", -F.when(i % 3 == 0, i % 10).otherwise(i % 400).cast("int"), as_of)

    base = d.select(
        F.concat(F.lit("p"), (i % 4).cast("string")).alias("project"),
        i.cast("string").alias("id"),
        category.alias("category"),
        X.first_words("text", 6).alias("title"),
        F.col("text").alias("content"),
        F.when(i % 29 == 0, F.lit(None).cast(S.STR_ARRAY))
         .otherwise(F.array(F.col("lang"), F.col("source"))).alias("tags"),
        F.lit(None).cast("string").alias("metadata"),
        F.col("embedding"),
        F.when(i % 17 == 0, F.lit(S.ARCHIVED)).otherwise(F.lit(S.ACTIVE)).alias("status"),
        X.rule_priority(category, raw_priority).alias("priority"),
        F.when(i % 3 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("source"),
        F.array().cast(S.STR_ARRAY).alias("related_ids"),
        F.coalesce(F.floor(F.col("n_views") / 2), F.lit(0)).cast("int").alias("access_count"),
        created.alias("created_at"),
        F.timestamp_add("HOUR", (i % 7).cast("int"), created).alias("updated_at"),
    )
    base = X.with_summary(base, "title", "content")
    base = X.with_entities(base.withColumn("_etext", F.concat(F.col("title"), F.lit(" "), F.col("content"))),
                           "_etext")
    return base.select(
        "project", "id", "category", "title", "content", "summary",
        "tags", "metadata", "embedding", "status", "priority", "source", "related_ids", "entities",
        "access_count",
        X.expiry("category", "priority", "created_at").alias("expires_at"),
        "created_at", "updated_at",
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of searches: every stored vector is also one query of its project.

    Parameters vary by id so that the post-filters bite: a category on every
    fifth query, the tag 'en' on every third, min similarity 0.1 / 0.2.
    """
    v = F.col("vec_id")
    cats = F.array(*[F.lit(c) for c in S.CATEGORIES])
    return _read(spark, sf_dir, "embeddings").select(
        v.alias("query_id"),
        F.concat(F.lit("p"), (v % 4).cast("string")).alias("project"),
        F.col("embedding"),
        F.when(v % 5 == 0, F.element_at(cats, (v % len(S.CATEGORIES) + 1).cast("int"))).alias("category"),
        F.when(v % 3 == 0, F.array(F.lit("en"))).alias("tags"),
        F.lit(S.ACTIVE).alias("status"),
        F.lit(5).cast("int").alias("limit"),
        F.when(v % 2 == 0, F.lit(0.1)).otherwise(F.lit(0.2)).alias("min_similarity"),
        F.lit(1000).cast("int").alias("token_budget"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session start / end calls from ``events``, in call order (``seq``).

    A ``signup`` starts a session (id = event id) in project ``p<user % 4>``;
    a ``purchase`` ends the latest earlier session started by the same user,
    summary = props, counts taken from the event value. Ends without an
    earlier start of their user carry no session id and change nothing.
    Several users share a project, so starts close each other's sessions and
    late ends overwrite auto-closes, as in the reference.
    """
    from cairn.operators.ranking import groups_fit_one_task, rank_within
    ev = _read(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "purchase")).select(
        "event_id", "user_id", "ts", "event_type", "props", "value")
    is_start = F.col("event_type") == "signup"
    if groups_fit_one_task(ev, ["user_id"]):
        w = (Window.partitionBy("user_id").orderBy("event_id")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ev = ev.withColumn("_sid", F.last(F.when(is_start, F.col("event_id").cast("string")), ignorenulls=True).over(w))
        return _session_rows(ev, is_start)
    # The latest earlier start of the same user, without a per-user window:
    # for an end at position P among all the user's calls and at position E
    # among its ends, P - E starts precede it, so its session is the start at
    # position P - E among the user's starts (an equi-join).
    allpos = rank_within(ev, ["user_id"], ["event_id"], "_p_all")
    starts = rank_within(ev.filter(is_start), ["user_id"], ["event_id"], "_p_start").select(
        F.col("user_id").alias("_su"), "_p_start", F.col("event_id").cast("string").alias("_sid"))
    ends = rank_within(ev.filter(~is_start), ["user_id"], ["event_id"], "_p_end").select(
        F.col("event_id").alias("_eid"), "_p_end")
    ev = (allpos.join(ends, F.col("event_id") == F.col("_eid"), "left")
          .withColumn("_k", F.when(is_start, F.lit(None)).otherwise(F.col("_p_all") - F.col("_p_end"))))
    ev = ev.join(starts, (F.col("user_id") == F.col("_su")) & (F.col("_k") == F.col("_p_start")), "left")
    return _session_rows(ev, is_start)


def _session_rows(ev: DataFrame, is_start) -> DataFrame:
    last_start = F.when(is_start, F.col("event_id").cast("string")).otherwise(F.col("_sid"))
    return ev.select(
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.when(is_start, F.lit("start")).otherwise(F.lit("end")).alias("kind"),
        last_start.alias("session_id"),
        F.when(~is_start, F.col("props")).alias("summary"),
        F.when(~is_start, F.floor(F.col("value")).cast("int")).alias("memories_created"),
        F.when(~is_start, (F.col("event_id") % 7).cast("int")).alias("memories_accessed"),
    )


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows from ``events``: one per event."""
    op = (F.when(F.col("event_type") == "signup", "create")
          .when(F.col("event_type") == "click", "update")
          .when(F.col("event_type") == "view", "access")
          .when(F.col("event_type") == "error", "soft_delete")
          .when(F.col("event_type") == "purchase", "reembed"))
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project"),
        F.col("user_id").cast("string").alias("memory_id"),
        op.alias("operation"),
        F.col("props").alias("details"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("op_seq"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project registry: one project per event user, first and last activity."""
    ev = _read(spark, sf_dir, "events")
    g = ev.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_accessed"))
    slug = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return g.select(
        slug.alias("slug"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("display_name"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Notes of user "), F.col("user_id").cast("string"))).alias("description"),
        "created_at", "last_accessed",
        F.concat(F.lit("projects/"), slug).alias("db_path"),
    )


# ------------------------------------------------------------------ batches
# Request batches for the maintenance operators, each derived from a whole
# test table so that its size grows with the data.

def _title_of(text_col):
    return X.first_words(text_col, 6)


def recall_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 requests from events: a view recalls note ``user_id`` by id, a
    click recalls by that note's title, an error names neither (rejected)."""
    ev = _read(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click", "error"))
    # the title is made before the join, so that whole texts are not shuffled
    docs = _read(spark, sf_dir, "documents").select("doc_id", _title_of("text").alias("_title"))
    j = ev.join(docs, ev.user_id == docs.doc_id, "left")
    return j.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project"),
        F.when(F.col("event_type") == "view", F.col("user_id").cast("string")).alias("id"),
        F.when(F.col("event_type") == "click", F.col("_title")).alias("title"),
        F.col("event_id").alias("op_seq"))


def store_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 batch: every conversation turn stored as a note. System turns carry
    an invalid category and are rejected by F8."""
    c = _read(spark, sf_dir, "conversations")
    cats = F.array(*[F.lit(x) for x in S.CATEGORIES])
    k = F.col("conv_id") + F.col("turn")
    return c.select(
        F.concat(F.lit("p"), (F.col("conv_id") % 4).cast("string")).alias("project"),
        F.when(F.col("role") == "system", F.lit("system_prompt"))
         .otherwise(F.element_at(cats, (k % len(S.CATEGORIES) + 1).cast("int"))).alias("category"),
        _title_of("text").alias("title"),
        F.col("text").alias("content"),
        F.array(F.col("role")).alias("tags"),
        F.to_json(F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"))).alias("metadata"),
        (F.col("turn") % 3).cast("int").alias("priority"),
        F.col("role").alias("source"),
        F.array().cast(S.STR_ARRAY).alias("related_ids"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("op_seq"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 patches: one per label row (revised content for quality 1, cleared
    tags and priority 3 for toxic, an empty-string title for toxic
    low-quality, nothing at all for clean low-quality -> rejected), then one
    per click event (metadata = props, priority from the value), later."""
    lab = _read(spark, sf_dir, "labels")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    l = lab.join(docs, "doc_id", "left")
    q1, tox = F.col("quality") == 1, F.col("toxic") == 1
    a = l.select(
        F.concat(F.lit("p"), (F.col("doc_id") % 4).cast("string")).alias("project"),
        F.col("doc_id").cast("string").alias("id"),
        F.when(~q1 & tox, F.lit("")).alias("title"),
        F.when(q1, F.concat(F.col("text"), F.lit(" revised."))).alias("content"),
        F.when(tox, F.array().cast(S.STR_ARRAY)).alias("tags"),
        F.lit(None).cast("string").alias("metadata"),
        F.lit(None).cast("string").alias("status"),
        F.when(tox, F.lit(3)).cast("int").alias("priority"),
        F.lit(None).cast(S.STR_ARRAY).alias("related_ids"),
        F.col("doc_id").cast("long").alias("op_seq"))
    ev = _read(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    b = ev.select(
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project"),
        F.col("user_id").cast("string").alias("id"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("content"),
        F.lit(None).cast(S.STR_ARRAY).alias("tags"),
        F.col("props").alias("metadata"),
        F.lit(None).cast("string").alias("status"),
        (F.floor(F.col("value")) % 3).cast("int").alias("priority"),
        F.lit(None).cast(S.STR_ARRAY).alias("related_ids"),
        (F.col("event_id") + 1_000_000_000).alias("op_seq"))
    return a.unionByName(b)


def soft_delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 requests: every error event archives note ``user_id``."""
    ev = _read(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return ev.select(
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project"),
        F.col("user_id").cast("string").alias("id"), F.col("props").alias("reason"),
        F.col("event_id").alias("op_seq"))


def hard_delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 requests: toxic-labelled documents are removed."""
    lab = _read(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    return lab.select(
        F.concat(F.lit("p"), (F.col("doc_id") % 4).cast("string")).alias("project"),
        F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("reason"),
        F.col("doc_id").alias("op_seq"))


def import_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4/M8 input: every document as a parsed note file. Ids ending in 1 are
    unknown to the store, ending in 3 sit in an unknown category folder,
    content ending in 0 was edited, ending in 2 is empty."""
    d = _read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    cats = F.array(*[F.lit(x) for x in S.CATEGORIES])
    return d.select(
        F.concat(F.lit("p"), (i % 4).cast("string")).alias("project"),
        F.when(i % 10 == 1, F.concat(F.lit("x"), i.cast("string"))).otherwise(i.cast("string")).alias("id"),
        F.when(i % 10 == 3, F.lit("misc")).otherwise(
            F.element_at(cats, (i % len(S.CATEGORIES) + 1).cast("int"))).alias("category"),
        _title_of("text").alias("title"),
        F.when(i % 10 == 0, F.concat(F.col("text"), F.lit(" edited")))
         .when(i % 10 == 2, F.lit("")).otherwise(F.col("text")).alias("content"),
        F.array(F.col("lang")).alias("tags"),
        F.lit(0).alias("priority"), F.lit("import").alias("source"),
        F.lit(None).cast("string").alias("metadata"),
        i.alias("op_seq"))


def registry_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 batch: every conversation turn registers or renames a project:
    ``u<conv>`` (even ids arrive as 'U_<conv>' and need slugifying), or, for
    ids divisible by 3, 'Team <conv>', which the registry does not know."""
    c = _read(spark, sf_dir, "conversations")
    cid = F.col("conv_id").cast("string")
    return c.select(
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Team "), cid))
         .when(F.col("conv_id") % 2 == 0, F.concat(F.lit("U_"), cid)).otherwise(F.concat(F.lit("u"), cid)).alias("slug"),
        F.concat(F.lit("Conversation "), cid, F.lit(" turn "), F.col("turn").cast("string")).alias("display_name"),
        F.when(F.col("role") == "user", F.lit(None).cast("string")).otherwise(_title_of("text")).alias("description"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("op_seq"))


def touch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 input: session starts touch project ``u<user>``."""
    ev = _read(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    return ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("slug"), "ts")


def delete_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 input: projects of users whose latest event is an error."""
    last = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.filter(F.col("last") == "error").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("slug"))
