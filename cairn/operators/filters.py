"""Row filters and predicates (F1-F8).

Each is a plain ``filter`` so Catalyst pushes it to the Parquet scan where the
column is stored (status, category, expires_at, created_at) and prunes
``project`` partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import schema as S


def _ts(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast(S.TS)


def by_status(df: DataFrame, status: str | None = S.ACTIVE) -> DataFrame:
    """equality on status (default active)."""
    return df.filter(F.col("status") == (status or S.ACTIVE))


def by_category(df: DataFrame, category: str | None) -> DataFrame:
    """equality; empty or None means no filter."""
    return df if not category else df.filter(F.col("category") == category)


def any_tag_predicate(tags_col: Column, wanted) -> Column:
    """At least one wanted tag present; NULL tags never match."""
    if isinstance(wanted, Column):
        return F.coalesce(F.arrays_overlap(tags_col, wanted), F.lit(False))
    return F.coalesce(F.arrays_overlap(tags_col, F.array(*[F.lit(t) for t in wanted])), F.lit(False))


def any_tag(df: DataFrame, tags: list[str] | None) -> DataFrame:
    """at least one wanted tag; empty list = no filter."""
    return df if not tags else df.filter(any_tag_predicate(F.col("tags"), tags))


def alive_predicate(as_of) -> Column:
    """``expires_at IS NULL OR expires_at > as_of`` (strict)."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > _ts(as_of))


def alive(df: DataFrame, as_of) -> DataFrame:
    return df.filter(alive_predicate(as_of))


def min_similarity(df: DataFrame, x: float, col: str = "similarity") -> DataFrame:
    """keep rows with similarity at least ``x``."""
    return df.filter(F.col(col) >= F.lit(x))


def is_recent(as_of, days: int = S.RECENT_DAYS) -> Column:
    return F.col("created_at") >= F.timestamp_add("DAY", F.lit(-days), _ts(as_of))


def recent(df: DataFrame, as_of, days: int = S.RECENT_DAYS) -> DataFrame:
    """created within ``days`` before ``as_of`` (inclusive)."""
    return df.filter(is_recent(as_of, days))


def rules_only(df: DataFrame) -> DataFrame:
    """active notes of the two rule categories (expiry not checked)."""
    return df.filter(F.col("category").isin(*S.RULE_CATEGORIES) & (F.col("status") == S.ACTIVE))


def valid_category(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F8: split a raw batch into accepted rows and rejected rows with reason."""
    ok = F.col("category").isin(*S.CATEGORIES)
    accepted = batch.filter(F.coalesce(ok, F.lit(False)))
    rejected = batch.filter(~F.coalesce(ok, F.lit(False))).withColumn(
        "reason", F.concat(F.lit("Invalid category '"), F.coalesce(F.col("category"), F.lit("None")),
                           F.lit("'")))
    return accepted, rejected
