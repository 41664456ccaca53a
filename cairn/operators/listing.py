"""Listing, paging, rules and per-project ordered lists.

The reference serves one project per call with ``ORDER BY ... LIMIT n``; here
one plan serves every project at once, so each ``LIMIT`` becomes a
``row_number()`` per project (Spark plans a partial ``WindowGroupLimit``
before the shuffle for a literal bound, so only the top rows per project and
task cross the exchange). Sorts append ``id`` as the last key and put NULLs
last in both directions, as the embedded engine did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.operators import filters as FL
from cairn.operators.ranking import rank_within



def rule_order() -> list[Column]:
    """Rules: priority desc, created_at asc, then id (NULLs last)."""
    return [F.col("priority").desc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col("id").asc()]


def ts_text(c) -> Column:
    """Timestamp as Python ``str(datetime)``: seconds, plus 6 fraction digits
    only when the microseconds are not zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def serve(df: DataFrame, include_embedding: bool = False) -> DataFrame:
    """The served row shape. NULL arrays -> [], timestamps as text,
    embedding dropped unless asked."""
    empty = F.array().cast(S.STR_ARRAY)
    cols = [c for c in ["project"] if c in df.columns] + [
        "id", "category", "title", "content", "summary",
        F.coalesce("tags", empty).alias("tags"), "metadata", "status", "priority", "source",
        F.coalesce("related_ids", empty).alias("related_ids"),
        F.coalesce("entities", empty).alias("entities"), "access_count",
        ts_text("expires_at").alias("expires_at"), ts_text("created_at").alias("created_at"),
        ts_text("updated_at").alias("updated_at")]
    if include_embedding:
        cols.append("embedding")
    return df.select(*cols)


def search_index(hits: DataFrame) -> DataFrame:
    """Light result row of a search hit."""
    return hits.select("query_id", "rank", "id", "title", "summary", "category", "similarity")


def sweep_expired(df: DataFrame, as_of) -> DataFrame:
    """M6: active notes whose expiry has passed become 'expired' (no audit,
    no updated_at change)."""
    gone = (F.col("status") == S.ACTIVE) & F.col("expires_at").isNotNull() & (
        F.col("expires_at") <= FL._ts(as_of))
    return df.withColumn("status", F.when(gone, F.lit(S.EXPIRED)).otherwise(F.col("status")))


def _order(sort_by: str, order: str) -> list[Column]:
    if sort_by not in S.LIST_SORT_FIELDS:
        sort_by = S.LIST_DEFAULT_SORT[0]
    if order not in S.LIST_SORT_ORDERS:
        order = S.LIST_DEFAULT_SORT[1]
    c = F.col(sort_by)
    return [c.asc_nulls_last() if order == "asc" else c.desc_nulls_last(), F.col("id").asc()]


def page(df: DataFrame, sort_by: str = "updated_at", order: str = "desc",
         limit: int = S.LIST_LIMIT, offset: int = 0, group: str = "project") -> DataFrame:
    """The slice ``(offset, offset + limit]`` per group in the whitelisted
    order (unknown field or order -> updated_at desc; case-sensitive)."""
    w = Window.partitionBy(group).orderBy(*_order(sort_by, order))
    hi = offset + limit
    return (df.withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= F.lit(hi))
            .filter(F.col("position") > F.lit(offset)))


def list_filtered(df: DataFrame, as_of, category: str | None = None, status: str = S.ACTIVE,
                  tags: list[str] | None = None) -> DataFrame:
    """The predicate of C4 (after the sweep): status, category, tags, and for
    status 'active' the expiry check."""
    out = FL.any_tag(FL.by_category(FL.by_status(df, status), category), tags)
    if status == S.ACTIVE:
        out = FL.alive(out, as_of)
    return out


def filtered_total(filtered: DataFrame, group: str = "project") -> DataFrame:
    """A1: COUNT(*) per group under the page's predicate."""
    return filtered.groupBy(group).agg(F.count(F.lit(1)).alias("total"))


def list_notes(df: DataFrame, as_of, category: str | None = None, status: str = S.ACTIVE,
               tags: list[str] | None = None, sort_by: str = "updated_at", order: str = "desc",
               limit: int = S.LIST_LIMIT, offset: int = 0) -> DataFrame:
    """C4: sweep, filter, page and total per project.

    The page is a per-project ``row_number`` with a literal bound, so each
    task keeps only its top ``offset + limit`` rows per project before the
    shuffle (partial ``WindowGroupLimit``); the total is a partial-aggregated
    count joined back (one row per project). Neither step gathers a whole
    project into one task, however hot it is."""
    f = list_filtered(sweep_expired(df, as_of), as_of, category, status, tags)
    return page(f, sort_by, order, limit, offset).join(filtered_total(f), "project")


def order_rules(df: DataFrame) -> DataFrame:
    """T4 on F7: rules by priority desc, created_at asc (then id), no limit.
    Positions are skew-safe (``rank_within``): a project is never one task."""
    return rank_within(FL.rules_only(df), ["project"], rule_order())


RULE_TEXT = ["title", "content", "summary", "tags"]


def rules_split(df: DataFrame) -> DataFrame:
    """The two rule lists per project and their sizes, in long form:
    one whole rule per row with its ``position`` within its own category,
    plus ``n_mandatory``, ``n_forbidden`` and ``total`` of the project. Only
    keys are ranked; the texts join back by id.

    No per-project array is collected (a project may hold a third of all
    rows); the counts are a partial-aggregated ``groupBy`` joined back, which
    is one row per project."""
    r = FL.rules_only(df)
    counts = r.groupBy("project").agg(
        F.count(F.when(F.col("category") == "mandatory_rules", 1)).alias("n_mandatory"),
        F.count(F.when(F.col("category") == "forbidden_rules", 1)).alias("n_forbidden"),
        F.count(F.lit(1)).alias("total"))
    return (rank_within(r, ["project", "category"], rule_order())
            .select("project", "category", "position", "id", "priority", "created_at")
            .join(r.select("project", "id", *RULE_TEXT), ["project", "id"])
            .join(counts, "project"))


def count_by_category(df: DataFrame) -> DataFrame:
    """A3: active notes per project and category."""
    return FL.by_status(df, S.ACTIVE).groupBy("project", "category").agg(
        F.count(F.lit(1)).alias("count"))


def recent_by_category(df: DataFrame, as_of, category: str = "decision",
                       days: int = S.RECENT_DAYS, n: int = S.RECENT_DECISIONS_CAP) -> DataFrame:
    """Active notes of a category created in the last ``days``, newest
    first, top ``n`` per project (expiry not checked, Q7)."""
    f = FL.recent(FL.by_status(df.filter(F.col("category") == category), S.ACTIVE), as_of, days)
    w = Window.partitionBy("project").orderBy(F.col("created_at").desc_nulls_last(), F.col("id"))
    return f.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def active_by_category(df: DataFrame, category: str = "sprint", n: int = S.ACTIVE_SPRINT_CAP) -> DataFrame:
    """Active notes of a category by priority desc, updated desc, top n."""
    f = FL.by_status(df.filter(F.col("category") == category), S.ACTIVE)
    w = Window.partitionBy("project").orderBy(F.col("priority").desc_nulls_last(),
                                              F.col("updated_at").desc_nulls_last(), F.col("id"))
    return f.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def export_order(df: DataFrame) -> DataFrame:
    """Active notes by category, then title (then id); skew-safe positions."""
    return rank_within(FL.by_status(df, S.ACTIVE), ["project"], ["category", "title", "id"])


def ordered_ids(ranked: DataFrame, name: str, group: str = "project") -> DataFrame:
    """Collapse ``(group, position, id)`` rows into one ordered id array."""
    return ranked.groupBy(group).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias(name))
