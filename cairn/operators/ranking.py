"""Skew-safe positions within groups.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends each whole group to one
task. When one project (or note, or user) may hold a third of all rows,
that task is the job. ``rank_within`` computes the same numbers without it:

1. range-partition by (g, o): the partitioner samples the keys, so a hot
   group is cut into many consecutive ranges;
2. number rows locally per (range partition, group): a window keyed by the
   pair, which is spread evenly however hot the group is;
3. carry: per group, the row counts of its earlier range partitions (a tiny
   table, at most one row per range partition a group spans), joined back.

Order keys must be unique within a group (callers append ``id``). The
range-partitioned rows are checkpointed once (to the shared
``spark.checkpoint.dir``) so both uses see the same partition assignment,
also after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import ensure_checkpoint_dir


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


MAX_GROUP_CONF = "cairn.rank.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000


SMALL_INPUT_CONF = "cairn.rank.smallInputBytes"
DEFAULT_SMALL_INPUT_BYTES = 256 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """Sum of the plan's input (leaf) size estimates, without running a job.
    Join estimates multiply; the inputs bound what any group can hold.
    None if unavailable."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001 - estimates are an optimisation only
        return None


def largest_group(df: DataFrame, group: list[str]) -> int:
    """Rows in the largest group: one partial-aggregated count job over the
    group columns only."""
    if not group:
        return df.count()
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def groups_fit_one_task(df: DataFrame, group: list[str], max_group_rows: int | None = None) -> bool:
    """True when a plain window over ``group`` is safe: the plan's input is
    small (no job), or the largest group, counted exactly, is at most
    ``max_group_rows`` (default from ``cairn.rank.maxGroupRows``)."""
    spark = df.sparkSession
    if max_group_rows is None:
        max_group_rows = int(spark.conf.get(MAX_GROUP_CONF, str(DEFAULT_MAX_GROUP_ROWS)))
    small = int(spark.conf.get(SMALL_INPUT_CONF, str(DEFAULT_SMALL_INPUT_BYTES)))
    est = estimated_bytes(df)
    return (max_group_rows > 0 and est is not None and est <= small) or largest_group(df, group) <= max_group_rows


def rank_within(df: DataFrame, group: list[str], order: list, name: str = "position",
                num_partitions: int | None = None, max_group_rows: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row within its group.

    When the largest group is at most ``max_group_rows`` (default from the
    session conf ``cairn.rank.maxGroupRows``, 2,000,000) one task can sort
    it, and this is a plain ``row_number()`` window. Beyond that the group is
    split by range partitioning with a carry of earlier counts."""
    spark = df.sparkSession
    # A whole input this small cannot hold a hot group worth splitting: skip
    # the counting job. Otherwise measure the largest group exactly.
    if groups_fit_one_task(df, group, max_group_rows):
        w = Window.partitionBy(*group).orderBy(*_cols(order)) if group else Window.orderBy(*_cols(order))
        return df.withColumn(name, F.row_number().over(w))
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    # The range bounds come from sampling and the partition id is read after
    # the exchange, so the assignment must be fixed before it is used twice
    # (local numbering and carry): a reliable checkpoint cuts the lineage.
    ranged = (df.repartitionByRange(n, *_cols(group), *_cols(order))
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid", *group).orderBy(*_cols(order))))
    counts = ranged.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(F.col("_pid").alias("_c_pid"), *[F.col(g).alias(f"_c_{g}") for g in group],
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # NULL is a group of its own, as in a window: null-safe keys.
    cond = F.col("_pid") == F.col("_c_pid")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    joined = local.join(carry, cond)
    return joined.withColumn(name, (F.col("_local") + F.col("_before")).cast("int")).drop(
        "_pid", "_local", "_before", "_c_pid", *[f"_c_{g}" for g in group])


def next_within(df: DataFrame, group: list[str], order: list, cols: list[str],
                prefix: str = "next_", max_group_rows: int | None = None) -> DataFrame:
    """``lead(c)`` over (group, order) for each c in ``cols``: positions from
    ``rank_within`` and an equi-join of position p with p + 1 (both keys
    spread evenly, so no group lands in one task)."""
    if groups_fit_one_task(df, group, max_group_rows):
        w = Window.partitionBy(*group).orderBy(*_cols(order)) if group else Window.orderBy(*_cols(order))
        return df.select("*", *[F.lead(c).over(w).alias(prefix + c) for c in cols])
    r = rank_within(df, group, order, "_pos", max_group_rows=0)
    nxt = r.select(*[F.col(g).alias(f"_n_{g}") for g in group], (F.col("_pos") - 1).alias("_n_pos"),
                   *[F.col(c).alias(prefix + c) for c in cols])
    cond = F.col("_pos") == F.col("_n_pos")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_n_{g}"))
    return r.join(nxt, cond, "left").drop("_pos", "_n_pos", *[f"_n_{g}" for g in group])
