"""Bucketed note tables: maintenance that rewrites notes without shuffling them.

``NoteTable`` keeps the notes in Parquet bucketed by (project, id) and sorted
within buckets. Requests, hits or patches that are joined with it by note are
shuffled to the table's buckets (they are small); the notes are read bucket by
bucket and stay where they are, and the new state is written bucket by bucket.
That holds for all of M2-M6, J1, J4, J5 and J6 as they are, since they join by
(project, id).

Parquet has no update, so each change writes a next *generation* of the table
beside the current one and then makes it current with one small pointer file,
written whole under a new name. Readers of the old generation go on; it is
dropped when the generation after next is committed. A commit that names a generation
other than the next one is refused, so two writers cannot lose each
other's change unseen. A failed or repeated write leaves a folder that
nothing points to, and the next commit writes over it.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema as S

KEYS = ["project", "id"]
BUCKETS = 64
AUTO = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


class NoteTable:
    """The note table under ``path`` with ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, schema=S.MEMORIES):
        self.spark, self.path, self.buckets, self.schema = spark, path.rstrip("/"), buckets, schema
        self._jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._top = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._top.getFileSystem(conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._top, name)

    # generations ------------------------------------------------------

    def generation(self) -> int:
        """Number of the current generation, 0 before the first."""
        if not self._fs.exists(self._top):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._top)]
        return max([int(n[len("current-"):]) for n in names if n.startswith("current-")], default=0)

    def _name(self, generation: int) -> str:
        import hashlib
        return f"notes_{hashlib.sha1(self.path.encode()).hexdigest()[:12]}_{generation}"

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation-{generation}"

    def read(self, generation: int | None = None) -> DataFrame:
        """The notes of a generation (the current one); none before the first."""
        g = self.generation() if generation is None else generation
        if not g:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.table(self._register(g))

    def _register(self, generation: int) -> str:
        """The session's catalog entry of a generation written by any session."""
        name = self._name(generation)
        if not self.spark.catalog.tableExists(name):
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            keys = ", ".join(KEYS)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet "
                           f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self._folder(generation)}'")
        return name

    def commit(self, notes: DataFrame, after: int | None = None) -> int:
        """Writes ``notes`` as the generation that follows ``after`` (default:
        the current one) and makes it current. Returns its number."""
        now = self.generation()
        if after is not None and after != now:
            raise RuntimeError(f"generation {after} is no longer current: it is {now}")
        g = now + 1
        folder = self._at(f"generation-{g}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(g)}")
        if self._fs.exists(folder):  # of a write that did not end
            self._fs.delete(folder, True)
        with self.by_bucket():
            (self.rows(notes).write.format("parquet").bucketBy(self.buckets, *KEYS).sortBy(*KEYS)
             .option("path", self._folder(g)).saveAsTable(self._name(g)))
        made = self._fs.create(self._at(f"current-{g}"), False)  # fails if another writer was faster
        made.close()
        self._drop(g - 2)
        return g

    def rows(self, notes: DataFrame) -> DataFrame:
        """``notes`` in the table's columns and buckets. Spark leaves the
        repartition out where they come from the table's buckets already."""
        return notes.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).repartition(self.buckets, *KEYS)

    @contextmanager
    def by_bucket(self):
        """Scans keep their buckets also where no join asks for them (a small
        side is broadcast), as the write that follows needs them."""
        conf = self.spark.conf
        before = conf.get(AUTO, None)
        conf.set(AUTO, "false")
        try:
            yield
        finally:
            conf.unset(AUTO) if before is None else conf.set(AUTO, before)

    def _drop(self, generation: int) -> None:
        if generation > 0:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(generation)}")
            for name in (f"current-{generation}", f"generation-{generation}"):
                if self._fs.exists(self._at(name)):
                    self._fs.delete(self._at(name), True)
