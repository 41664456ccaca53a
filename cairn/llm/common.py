"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Folder of the public vocabulary files (a parameter everywhere it is used).
TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file: the installed package's, else the default folder's."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZERS, name)
    return public_tokenizers.path(name)


def prepare(spark: SparkSession) -> SparkSession:
    """Shared scratch folder known, package shipped to the Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared scratch folder."""
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


#: With this setting the shuffle files of a write go as soon as it ends, else only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Writes within leave no shuffle files behind; each has a plan of its own, so nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read back:
    a reliable cut of lineage that survives the loss of executors. The write's
    shuffle files are removed when it ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables made by ``stored`` that nothing reads any more, through
    Spark's own file system interface. Others, and None, are left alone."""
    for df in tables:
        path = getattr(df, "stored_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc.hadoopConfiguration()).delete(where, True)


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) only, whatever else a table holds; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Memory that a task has freed goes back to the system, as a Python worker
    lives on after it; nothing where the C library can't."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run``, for ``mapInArrow``, which gives back its memory when it ends."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def by_size(batch, column: str = "text", limit: int = 4 << 20) -> Iterator:
    """Slices of an Arrow batch whose texts hold about ``limit`` bytes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0), dtype=np.int64))
    at, base = 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        base, at = int(ends[to - 1]), to


def with_n_chars(docs: DataFrame, changed) -> DataFrame:
    """``n_chars`` follows the text in changed rows, where it is a whole number."""
    kind = dict(docs.dtypes).get("n_chars")
    if kind not in ("bigint", "int"):
        return docs
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def new_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
