"""Session lifecycle as a replayed event log.

Calls arrive as rows ``(project, seq, ts, kind, session_id, summary,
memories_created, memories_accessed)`` with ``kind`` 'start' or 'end'.
Replaying them one by one is equivalent to this set-based form:

* every start inserts an open session (M9);
* a start closes every open session of its project (M10). Because each start
  closes all open ones, the only session a start can find open is the one
  opened by the project's previous start, so "closed by the next start" is
  ``lead(ts)`` over the project's starts;
* an end overwrites end time, summary and counts of its session, whatever its
  state (M11, Q17); an unknown id changes nothing. The last end wins.

So ``ended_at = coalesce(last explicit end, next start)``, and the summary is
the explicit one or the auto-close text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.operators import filters as FL
from cairn.operators.ranking import next_within, rank_within


def replay(events: DataFrame, as_of=None) -> DataFrame:
    """Session table after replaying the calls (up to ``as_of`` if given).

    Columns: project, id, started_at, ended_at, summary, memories_created,
    memories_accessed, metadata, auto_closed (closed by a later start before
    any explicit end), closed_at (that start), start_seq.
    """
    ev = events if as_of is None else events.filter(F.col("ts") <= FL._ts(as_of))
    for c in ("memories_created", "memories_accessed"):
        if c not in ev.columns:
            ev = ev.withColumn(c, F.lit(0))
    starts = ev.filter(F.col("kind") == "start").select(
        "project", F.col("session_id").alias("id"), F.col("ts").alias("started_at"),
        F.col("seq").alias("start_seq"))
    # lead() over a project's starts, skew-safe (a project is never one task).
    starts = next_within(starts, ["project"], ["start_seq"], ["started_at", "start_seq"]) \
        .withColumnRenamed("next_started_at", "next_start").withColumnRenamed("next_start_seq", "next_seq")
    ends = ev.filter((F.col("kind") == "end") & F.col("session_id").isNotNull()).select(
        "project", F.col("session_id").alias("id"), F.col("seq").alias("end_seq"),
        F.struct(F.col("seq"), F.col("ts"), F.col("summary"),
                 F.coalesce(F.col("memories_created"), F.lit(0)).cast("int").alias("mc"),
                 F.coalesce(F.col("memories_accessed"), F.lit(0)).cast("int").alias("ma")).alias("e"))
    j = starts.join(ends, ["project", "id"], "left").filter(
        F.col("end_seq").isNull() | (F.col("end_seq") > F.col("start_seq")))
    per = j.groupBy("project", "id", "started_at", "start_seq", "next_start", "next_seq").agg(
        F.max("e").alias("last_end"), F.min("end_seq").alias("first_end_seq"))
    # Sessions whose only ends precede the start were dropped by the filter;
    # add them back without an end.
    per = starts.join(per.select("project", "id", "last_end", "first_end_seq"), ["project", "id"], "left")
    has_end = F.col("last_end").isNotNull()
    auto = F.col("next_start").isNotNull() & (
        F.col("first_end_seq").isNull() | (F.col("first_end_seq") > F.col("next_seq")))
    return per.select(
        "project", "id", "started_at",
        F.when(has_end, F.col("last_end.ts")).otherwise(F.col("next_start")).alias("ended_at"),
        F.when(has_end, F.col("last_end.summary"))
         .when(F.col("next_start").isNotNull(), F.lit(S.AUTO_CLOSE_SUMMARY)).alias("summary"),
        F.when(has_end, F.col("last_end.mc")).when(F.col("next_start").isNotNull(), F.lit(0)).alias("memories_created"),
        F.when(has_end, F.col("last_end.ma")).when(F.col("next_start").isNotNull(), F.lit(0)).alias("memories_accessed"),
        F.lit(None).cast("string").alias("metadata"),
        auto.alias("auto_closed"), F.when(auto, F.col("next_start")).alias("closed_at"), "start_seq")


def orphans_closed(sessions: DataFrame) -> DataFrame:
    """Per project, the number of sessions a later start auto-closed."""
    return sessions.groupBy("project").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum(F.col("auto_closed").cast("int")).alias("orphans_closed"))


def close_at(sessions: DataFrame, projects: DataFrame, as_of) -> DataFrame:
    """M10 for a new start at ``as_of`` in each listed project: every open
    session of the project ends now with the auto-close text and zero counts.
    Adds ``closed_now``."""
    p = projects.select("project").distinct().withColumn("_start", F.lit(True))
    s = sessions.join(p, "project", "left")
    now = F.col("_start").isNotNull() & F.col("ended_at").isNull()
    return s.select(
        *[F.when(now, v).otherwise(F.col(c)).alias(c) for c, v in [
            ("ended_at", FL._ts(as_of)), ("summary", F.lit(S.AUTO_CLOSE_SUMMARY)),
            ("memories_created", F.lit(0)), ("memories_accessed", F.lit(0))]],
        *[c for c in sessions.columns if c not in ("ended_at", "summary", "memories_created", "memories_accessed")],
        now.alias("closed_now"))


def last_session(sessions: DataFrame) -> DataFrame:
    """Per project the latest ended session's summary; if that is the
    auto-close text, the latest ended one with a non-NULL, non-auto summary
    (else NULL). A NULL latest summary stays NULL. Ties in end time: id."""
    return sessions.filter(F.col("ended_at").isNotNull()).groupBy("project").agg(*_latest()).select(
        "project", _last_summary().alias("last_session_summary"))


def _latest() -> list:
    """Aggregates of ``_last_summary``; sessions that have not ended count nowhere."""
    real = F.col("summary").isNotNull() & (F.col("summary") != S.AUTO_CLOSE_SUMMARY)
    key = F.when(F.col("ended_at").isNotNull(), F.struct("ended_at", "id"))
    return [F.max_by("summary", key).alias("latest"),
            F.max_by(F.when(real, F.col("summary")), F.when(real, key)).alias("latest_real")]


def _last_summary():
    return F.when(F.col("latest") == S.AUTO_CLOSE_SUMMARY, F.col("latest_real")).otherwise(F.col("latest"))


def digest_items(memories: DataFrame, as_of) -> DataFrame:
    """The listed notes of C6: section, position, id, title, content.

    One scan of the four categories and one ranking by (project, section):
    each section's order is turned into two descending keys. Sprint notes and
    decisions are cut to their caps; titles and contents join back by id."""
    category = F.col("category")
    section = (F.when(category.isin(*S.RULE_CATEGORIES), category).when(category == "sprint", "active_sprint")
               .when((category == "decision") & FL.is_recent(as_of, S.RECENT_DAYS), "recent_decisions"))
    thin = FL.by_status(memories.filter(category.isin(*S.RULE_CATEGORIES, "sprint", "decision")), S.ACTIVE).select(
        "project", "id", section.alias("section"), "priority", "updated_at", "created_at").filter(F.col("section").isNotNull())
    micros = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(S.TS), F.col(c))
    sec = F.col("section")
    thin = thin.select("project", "section", "id",
                       F.when(sec == "recent_decisions", micros("created_at")).otherwise(F.col("priority").cast("long")).alias("k1"),
                       F.when(sec == "active_sprint", micros("updated_at")).when(sec != "recent_decisions", -micros("created_at")).alias("k2"))
    ranked = rank_within(thin, ["project", "section"], [F.col("k1").desc_nulls_last(), F.col("k2").desc_nulls_last(), F.col("id")])
    cap = F.when(sec == "active_sprint", S.ACTIVE_SPRINT_CAP).when(sec == "recent_decisions", S.RECENT_DECISIONS_CAP)
    kept = ranked.filter(cap.isNull() | (F.col("position") <= cap)).select("project", "section", "position", "id")
    texts = memories.filter(category.isin(*S.RULE_CATEGORIES, "sprint", "decision")).select("project", "id", "title", "content")
    return kept.join(texts, ["project", "id"])


def session_digest(memories: DataFrame, sessions: DataFrame, starts: DataFrame, as_of) -> DataFrame:
    """What a session start at ``as_of`` returns, for every project in
    ``starts``, in long form.

    One header row per project (section 'header', position 0) carries
    ``last_session_summary`` and ``orphans_closed``; item rows list the
    mandatory and forbidden rules (all, ordered), the active sprint notes
    (top 10) and the decisions of the last 7 days (top 20), each with its
    title and content.
    No per-project array is built: the rule lists are unbounded."""
    projects = starts.select("project").distinct()
    closed = close_at(sessions, projects, as_of)
    per = closed.groupBy("project").agg(F.sum(F.col("closed_now").cast("int")).alias("orphans_closed"), *_latest())
    header = projects.join(per, "project", "left").select(
        "project", F.lit("header").alias("section"), F.lit(0).alias("position"),
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("content"), _last_summary().alias("last_session_summary"),
        F.coalesce("orphans_closed", F.lit(0)).cast("long").alias("orphans_closed"))
    mem = memories.join(projects, "project", "left_semi")
    items = digest_items(mem, as_of).select(
        "project", "section", F.col("position").cast("int").alias("position"), "id", "title", "content",
        F.lit(None).cast("string").alias("last_session_summary"),
        F.lit(None).cast("long").alias("orphans_closed"))
    return header.unionByName(items)
