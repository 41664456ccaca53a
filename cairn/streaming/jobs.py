"""Streaming forms of the write path: R1 and R2 (R3 is ``session_calls``).

The reference applies one call at a time; these jobs consume call streams
and keep the same end state:

* ``stream_store`` (R1): raw notes -> enriched notes, audit rows and rejects.
  A note sent again within the watermark's delay is stored once. Each batch
  enriches its notes once for all three sinks, and names itself in their ids.
* ``stream_access`` (R2): recall/search hits -> running access counts per
  note, folded into a stored table that records the last batch of every row,
  so a batch that is repeated adds nothing.

R1's sinks put each micro-batch under ``batch_id=<n>`` with overwrite: a
replayed batch rewrites its own folder. Checkpoints live under the shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import schema as S
from cairn.operators import filters as FL
from cairn.operators import maintain as M
from cairn.session import scratch_path

RAW_NOTE = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("tags", S.STR_ARRAY), T.StructField("metadata", T.StringType()),
    T.StructField("priority", T.IntegerType()), T.StructField("source", T.StringType()),
    T.StructField("related_ids", S.STR_ARRAY), T.StructField("op_seq", T.LongType()),
    T.StructField("ts", S.TS),
])

HIT = T.StructType([T.StructField("project", T.StringType()), T.StructField("id", T.StringType()),
                    T.StructField("op_seq", T.LongType()), T.StructField("ts", S.TS)])

#: Folders the running totals are dealt into; a batch rewrites those it touches.
BUCKETS = 64
TOTALS = T.StructType([T.StructField("project", T.StringType()), T.StructField("id", T.StringType()),
                       T.StructField("hits", T.LongType()), T.StructField("last_batch", T.LongType()),
                       T.StructField("bucket", T.IntegerType())])


def _batch_writer(out: str, fmt: str = "parquet"):
    def write(df: DataFrame, batch_id: int):
        df.write.mode("overwrite").format(fmt).save(f"{out.rstrip('/')}/batch_id={batch_id}")
    return write


def _name(out: str) -> str:
    return hashlib.sha1(out.rstrip("/").encode()).hexdigest()[:12]


def _checkpoint(spark: SparkSession, name: str, out: str) -> str:
    """One checkpoint per (job, sink) under the shared checkpoint folder."""
    return scratch_path(spark, f"streams/{name}-{_name(out)}")


# ------------------------------------------------------------------ R1

def once(raw: DataFrame, delay: str) -> DataFrame:
    """Each sent note once: a copy of all its fields that comes within
    ``delay`` of event time goes. Only a digest is kept as state."""
    fields = F.to_json(F.struct(*[f.name for f in RAW_NOTE.fields]), {"ignoreNullFields": "false"})
    return (raw.withColumn("_time", F.col("ts").cast("timestamp")).withColumn("_key", F.md5(fields))
            .withWatermark("_time", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_time", "_key"))


def store_writer(out: str, embedder=None):
    """The sink of R1: notes, audit and rejects of one batch, enriched once."""
    out = out.rstrip("/")

    def write(df: DataFrame, batch_id: int):
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        ok, rejected = FL.valid_category(df)
        # the row's own event time is the note's ``as_of``
        notes = M.enriched(ok, F.col("ts"), f"{_name(out)}-{batch_id}", embedder).persist(StorageLevel.MEMORY_AND_DISK)
        for name, rows in (("notes", notes.drop("op_seq")), ("audit", M.create_trail(notes)), ("rejected", rejected)):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        notes.unpersist()
        df.unpersist()

    return write


def stream_store(spark: SparkSession, source: str, out: str, fmt: str = "parquet", trigger_once: bool = True,
                 embedder=None, delay: str = "1 day", files_per_trigger: int = 1000):
    """Raw notes under ``source`` -> ``out/notes`` and ``out/audit``
    (and ``out/rejected``); with an ``Embedder`` the notes get vectors. Rows
    without a time, or later than ``delay``, can't be told from copies already
    forgotten and are dropped."""
    raw = spark.readStream.schema(RAW_NOTE).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(source)
    w = (once(raw.filter(F.col("ts").isNotNull()), delay).writeStream.foreachBatch(store_writer(out, embedder))
         .option("checkpointLocation", _checkpoint(spark, "store", out)))
    return (w.trigger(availableNow=True) if trigger_once else w).start()


# ------------------------------------------------------------------ R2

def fold_hits(hits: DataFrame, out: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Adds one batch of hits to the totals under ``out``. Only the folders of
    touched notes are rewritten, each at once; a row of ``last_batch`` >=
    ``batch_id`` holds this batch already and stays, so a batch may be
    repeated, also after it was written in part."""
    spark = hits.sparkSession
    bucket = F.pmod(F.xxhash64("project", "id"), F.lit(buckets)).cast("int")
    hits = hits.filter(F.col("project").isNotNull() & F.col("id").isNotNull())  # a hit of no note counts nowhere
    new = hits.groupBy("project", "id").agg(F.count(F.lit(1)).alias("_n")).withColumn("bucket", bucket).persist(StorageLevel.MEMORY_AND_DISK)
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    if touched:
        old = totals(spark, out).filter(F.col("bucket").isin(touched))
        j = old.join(new, ["project", "id", "bucket"], "full_outer")
        adds = F.col("_n").isNotNull() & (F.coalesce("last_batch", F.lit(-1).cast("long")) < batch_id)
        rows = j.select("project", "id", (F.coalesce("hits", F.lit(0).cast("long")) + F.when(adds, F.col("_n")).otherwise(0)).alias("hits"),
                        F.when(adds, F.lit(batch_id).cast("long")).otherwise(F.col("last_batch")).alias("last_batch"), "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)
    new.unpersist()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """The stored totals; none before the first batch."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], TOTALS)
    return spark.read.schema(TOTALS).parquet(out)


def stream_access(spark: SparkSession, source: str, out: str, fmt: str = "parquet", trigger_once: bool = True,
                  files_per_trigger: int = 1000, buckets: int = BUCKETS):
    """R2: hits under ``source`` -> the running totals under ``out``."""
    hits = spark.readStream.schema(HIT).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(source)
    w = (hits.writeStream.foreachBatch(lambda df, n: fold_hits(df, out, n, buckets))
         .option("checkpointLocation", _checkpoint(spark, "access", out)))
    return (w.trigger(availableNow=True) if trigger_once else w).start()


def access_totals(spark: SparkSession, out: str) -> DataFrame:
    """The running total per note from R2's table."""
    return totals(spark, out).select("project", "id", "hits")


def apply_access(memories: DataFrame, totals: DataFrame) -> DataFrame:
    """M5 with precomputed totals."""
    return (memories.join(totals, ["project", "id"], "left")
            .withColumn("access_count", (F.col("access_count") + F.coalesce("hits", F.lit(0))).cast("int"))
            .drop("hits"))
