"""Stored tables: typed scans and writes.

Layout: each table is Parquet partitioned by ``project``, so a one-project
read is partition pruning and a maintenance job rewrites only the projects it
touched (dynamic partition overwrite). Parquet has no row-level UPDATE or
DELETE; new state is computed with joins (``operators.maintain``) and
written back here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema as S


def read_memories(spark: SparkSession, path: str, projects: list[str] | None = None) -> DataFrame:
    """The typed 17-column note table plus ``project``. Listing projects
    prunes partitions; filters on other columns push to the Parquet scan."""
    df = spark.read.schema(S.MEMORIES).parquet(path)
    return df.filter(F.col("project").isin(projects)) if projects else df


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows."""
    return spark.read.schema(S.PROVENANCE).parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """S3: session rows."""
    return spark.read.schema(S.SESSIONS).parquet(path)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """The registry, newest access first."""
    return spark.read.schema(S.PROJECTS).parquet(path).orderBy(
        F.col("last_accessed").desc_nulls_last(), F.col("slug"))


def with_defaults(df: DataFrame, as_of) -> DataFrame:
    """Column defaults of an insert: status active, priority 0, access 0,
    created/updated = as_of, empty arrays, missing columns NULL."""
    ts = F.lit(as_of).cast(S.TS) if not hasattr(as_of, "_jc") else as_of
    defaults = {
        "status": F.lit(S.ACTIVE), "priority": F.lit(0), "access_count": F.lit(0),
        "created_at": ts, "updated_at": ts,
        "tags": F.array().cast(S.STR_ARRAY), "related_ids": F.array().cast(S.STR_ARRAY),
        "entities": F.array().cast(S.STR_ARRAY),
    }
    cols = []
    for f in S.MEMORIES.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if f.name in defaults:
                c = F.coalesce(c, defaults[f.name])
        else:
            c = defaults.get(f.name, F.lit(None))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append_memories(df: DataFrame, path: str, as_of) -> None:
    """Insert rows with defaults, partitioned by project."""
    with_defaults(df, as_of).write.mode("append").partitionBy("project").parquet(path)


def overwrite_projects(df: DataFrame, path: str, schema=S.MEMORIES) -> None:
    """Replace the partitions of the projects present in ``df`` only.

    A project that became empty writes no rows, so its old folder would stay;
    callers remove such projects with ``drop_project_partitions``."""
    (df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path))


def drop_project_partitions(spark: SparkSession, path: str, projects: list[str]) -> None:
    """Delete the folders of emptied projects through the Hadoop file system
    (works on any shared store the cluster is configured for)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in projects:
        target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/project={p}")
        fs = target.getFileSystem(conf)
        if fs.exists(target):
            fs.delete(target, True)


def upgrade_v1(df: DataFrame) -> DataFrame:
    """Add the columns a v1 table lacks (summary, entities, expires_at)
    as NULL, keep existing ones; idempotent on a v2 table."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], S.MEMORIES)
    cols = [f.name for f in S.MEMORIES.fields]
    return df.unionByName(empty, allowMissingColumns=True).select(*cols)


def empty_provenance(spark: SparkSession) -> DataFrame:
    """The provenance table a v1 upgrade creates."""
    return spark.createDataFrame([], S.PROVENANCE)
