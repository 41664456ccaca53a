"""Project snapshots and the registry.

A project's data is three tables (memories, provenance, sessions). A snapshot
is those tables filtered to the project and written as Parquet under one
folder; the registry row's ``db_path`` names the folder. All moves are Spark
reads and writes, so they work on any shared file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.functions import text as X
from cairn.operators import maintain as M

TABLES = {"memories": S.MEMORIES, "provenance": S.PROVENANCE, "sessions": S.SESSIONS}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _registry_row(spark: SparkSession, slug: str, name: str | None, desc: str | None, path: str) -> DataFrame:
    return spark.createDataFrame([(slug, name, desc, path, 0)],
                                 "slug string, display_name string, description string, db_path string, op_seq long")


def snapshot_project(tables: dict[str, DataFrame], registry: DataFrame, project: str, target: str,
                     as_of) -> DataFrame:
    """Copy one project's three tables to ``target`` (Parquet, one
    sub-folder per table) and point the registry at it; nothing else of the
    registry row changes. The source stays as the backup. A project that
    already lies at ``target`` is left as it is; one the registry does not
    know is refused with a ValueError. Returns the new registry."""
    spark = registry.sparkSession
    known = registry.filter(F.col("slug") == project).select("db_path").first()
    if known is None:
        raise ValueError(f"Project '{project}' not found")
    if known["db_path"] == target:
        return registry
    for name, schema in TABLES.items():
        df = tables.get(name)
        if df is None:
            df = spark.createDataFrame([], schema)
        df.filter(F.col("project") == project).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]) \
          .write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")
    return registry.withColumn("db_path", F.when(F.col("slug") == project, F.lit(target)).otherwise(F.col("db_path")))


def attach_snapshot(spark: SparkSession, registry: DataFrame, path: str, as_of,
                    slug: str | None = None, display_name: str | None = None,
                    description: str | None = None) -> tuple[DataFrame, bool]:
    """Register an existing snapshot folder (slug from the folder name
    when not given, slugified; display name: the folder name); when the folder holds no snapshot, create an
    empty project there. Returns (registry, created_new)."""
    folder = path.rstrip("/").rsplit("/", 1)[-1]
    s = slug or folder
    s = spark.range(1).select(F.when(X.valid_slug(F.lit(s)), F.lit(s)).otherwise(X.slugify(F.lit(s)))).first()[0]
    created = not _exists(spark, f"{path.rstrip('/')}/memories")
    if created:
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    row = _registry_row(spark, s, display_name or folder, description, path)
    out = M.upsert_projects(registry, row, as_of)
    return out.withColumn("db_path", F.when(F.col("slug") == s, F.lit(path)).otherwise(F.col("db_path"))), created


def sync_snapshot(spark: SparkSession, registry: DataFrame, path: str, as_of, slug: str | None = None):
    """Register and validate a snapshot by counting its notes; an
    unreadable snapshot yields an error instead. Returns
    (registry or None, note count or None, error or None)."""
    try:
        n = spark.read.schema(S.MEMORIES).parquet(f"{path.rstrip('/')}/memories").count()
    except Exception as e:  # noqa: BLE001 - report, do not raise
        return None, None, f"Cannot open snapshot at {path}: {type(e).__name__}"
    reg, _ = attach_snapshot(spark, registry, path, as_of, slug)
    return reg, n, None


def project_info(registry: DataFrame, slug: str | None = None) -> DataFrame:
    """Every project (newest access first) or one; an unknown slug gives
    an empty result (the caller reports 'not found')."""
    if slug is None:
        return registry.orderBy(F.col("last_accessed").desc_nulls_last(), "slug")
    return registry.filter(F.col("slug") == slug)
