"""Exact top-k of many queries over many notes, each side shuffled a bounded number of times.

Notes and queries are packed: a row holds up to ``PACK_ROWS`` notes, or
``QUERY_ROWS`` queries, of one (project, status, vector length) as Arrow bytes.
Per such group the query packs are dealt into ``qs`` rows and the note packs
into ``ms`` columns of a grid of cells. A task streams one cell at a time, its
queries first (about ``CELL_QUERIES`` at most), then its notes pack by pack, and
holds the queries, their k nearest so far and one tile of scores. So the
notes are shuffled ``qs`` times, the queries ``ms`` times, and ``ms`` x k rows a
query come out, whatever the number of blocks or scan tasks. ``qs`` x ``ms``
follows the cluster's cores; only groups of more than ``CELL_QUERIES`` queries
for each of these rows have more.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import scratch_path

PACK_ROWS, QUERY_ROWS, TILE, CELL_QUERIES = 1_024, 256, 1_024, 16_384
#: Scores are compared with this much slack before they are snapped to 12 places.
EPS = 4e-12
#: Hits held beyond the k nearest before they are cut.
HELD = 1 << 16
GROUP = ["project", "status", "dim"]
CELL = [*GROUP, "qc", "mc"]
PACK = "project string, status string, dim int, n int, rows binary"


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def snap(similarity: np.ndarray) -> np.ndarray:
    """``score.snap`` in numpy: 12 places, so that equal vectors score equally
    wherever they stand in a matrix product."""
    return np.floor(similarity * 1e12 + 0.5) / 1e12


def matrix(vectors) -> np.ndarray:
    """An Arrow list column of one length as a float64 matrix (null components: NaN)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a direction, their unit vectors)."""
    norm = np.linalg.norm(m, axis=1)
    ok = np.flatnonzero(norm > 0)
    return ok, m[ok] / norm[ok][:, None]


def split(batch, vector: str, order: str, limit: int):
    """(project, status, dim, rows by ``order``): the rows of a batch by group, ``limit`` at most at a time."""
    import pyarrow.compute as pc

    dims = pc.fill_null(pc.list_value_length(batch.column(vector)), 0).to_numpy(zero_copy_only=False)
    keys = pd.DataFrame({"p": batch.column("project").to_pandas(), "s": batch.column("status").to_pandas(), "d": dims})
    rest = batch.drop_columns(["project", "status"])
    for (project, status, dim), at in keys.groupby(["p", "s", "d"], sort=False).indices.items():
        if dim > 0:
            own = rest.take(np.sort(at))
            own = own.take(pc.sort_indices(own, sort_keys=[(order, "ascending")], null_placement="at_start"))
            for k in range(0, own.num_rows, limit):
                yield project, status, int(dim), own.slice(k, limit)


def to_bytes(batch) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(raw):
    import pyarrow as pa

    return pa.ipc.open_stream(raw).read_next_batch()


def packs(df: DataFrame, vector: str, order: str, limit: int) -> DataFrame:
    """``df`` (project, status, ``vector``, ...) as rows of ``PACK``; rows without a group or vector are in none."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                for project, status, dim, own in split(batch, vector, order, limit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([project], pa.string()), pa.array([status], pa.string()), pa.array([dim], pa.int32()),
                         pa.array([own.num_rows], pa.int32()), pa.array([to_bytes(own)], pa.binary())], names=["project", "status", "dim", "n", "rows"])
    return df.mapInArrow(run, PACK)


class Nearest:
    """The k nearest notes of each query so far, by (distance, id)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: np.ndarray, least: np.ndarray):
        self.ids, self.vectors, self.k, self.least = ids, vectors, k, least
        self.low = least - EPS  # cosines below it cannot enter
        self.hits, self.fresh, self.full = [], 0, int(k.sum())

    def add(self, notes, vectors: np.ndarray, only: np.ndarray | None = None) -> None:
        """Notes (sorted by id, with their unit vectors) for all queries, or ``only`` those of these numbers."""
        import pyarrow as pa

        every = np.arange(len(self.ids)) if only is None else only
        for at in range(0, len(every), TILE):
            rows = every[at : at + TILE]
            s = self.vectors[rows] @ vectors.T
            mask = s >= self.low[rows][:, None]
            over = np.flatnonzero(np.count_nonzero(mask, axis=1) > self.k[rows])
            if len(over):
                most = int(self.k[rows][over].max())
                if most < s.shape[1]:
                    own = np.where(mask[over], s[over], -np.inf)
                    kth = np.partition(own, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
                    mask[over] &= own >= kth[:, None] - EPS
            r, c = np.nonzero(mask)
            if not len(r):
                continue
            d = 1.0 - snap(s[r, c])
            ok = 1.0 - d >= self.least[rows][r]
            r, c, d = r[ok], c[ok], d[ok]
            o = np.lexsort((c, d, r))
            r, c, d = r[o], c[o], d[o]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < self.k[rows][r]
            r, c, d = rows[r[keep]], c[keep], d[keep]
            hits = notes.take(pa.array(c))
            self.hits.append(hits.append_column("r", pa.array(r, pa.int64())).append_column("distance", pa.array(d, pa.float64())))
            self.fresh += len(r)
        if self.fresh > max(HELD, self.full):
            self.cut()

    def cut(self) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.hits:
            return
        t = pa.Table.from_batches(self.hits).combine_chunks()
        o = pc.sort_indices(t, sort_keys=[("r", "ascending"), ("distance", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        r = t.column("r").to_numpy()[o]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        o, r, nth = (x[nth < self.k[r]] for x in (o, r, nth))
        t = t.take(pa.array(o)).combine_chunks()
        last = np.flatnonzero(nth == self.k[r] - 1)
        full = r[last]
        self.low[full] = np.maximum(self.least[full], 1.0 - t.column("distance").to_numpy()[last]) - EPS
        self.hits, self.fresh = t.to_batches(), 0

    def rows(self, project: str, names: list[str]):
        """Record batches of the columns ``names``: query_id, project, distance and the notes' own."""
        import pyarrow as pa

        self.cut()
        for b in self.hits:
            for at in range(0, b.num_rows, 8192):
                own = b.slice(at, 8192)
                made = {"query_id": pa.array(self.ids[own.column("r").to_numpy()], pa.int64()), "project": pa.array([project] * own.num_rows, pa.string())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else own.column(c) for c in names], names=names)


def asked(batches) -> Nearest | None:
    """The queries of a cell's packs; those without a direction or with no k are left out."""
    q = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in ("query_id", "k", "q_min")]
    ok, vectors = unit(np.concatenate([matrix(b.column("q_embedding")) for b in batches]))
    some = q[1][ok] > 0
    ok, vectors = ok[some], vectors[some]
    return Nearest(q[0][ok].astype(np.int64), vectors, q[1][ok].astype(np.int64), q[2][ok].astype(np.float64)) if len(ok) else None


class Scan:
    """One cell: its queries, then its notes."""

    def __init__(self, key):
        self.key, self.held, self.near = key, [], None

    def take(self, kind: int, row: dict, rows) -> None:
        if kind == 0:
            self.held.append(rows)
            return
        if self.held:
            self.near, self.held = asked(self.held), []
        if self.near is not None:
            ok, vectors = unit(matrix(rows.column("embedding")))
            if len(ok):
                self.near.add(rows.take(ok).drop_columns(["embedding"]), vectors)

    def out(self, names):
        return self.near.rows(self.key[0], names) if self.near is not None else ()


def streamed(scan, names: list[str], extra: tuple = ()):
    """A task's cells, one after another, through ``scan`` objects."""
    def run(batches):
        now = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in CELL)))
            kinds = batch.column("kind").to_pylist()
            more = {c: batch.column(c).to_pylist() for c in extra}
            for i, key in enumerate(keys):
                if now is None or now.key != key:
                    if now is not None:
                        yield from now.out(names)
                    now = scan(key)
                now.take(kinds[i], {c: v[i] for c, v in more.items()}, from_bytes(batch.column("rows")[i].as_buffer()))
        if now is not None:
            yield from now.out(names)
    return run


def grid(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """(group, qs, ms): rows and columns of each group's cells. Tasks are shared
    out by work, about four a core, with more query rows than note columns, as
    the k candidates a query has in each column weigh most."""
    tasks = 4 * notes.sparkSession.sparkContext.defaultParallelism
    sizes = notes.groupBy(*GROUP).agg(F.sum("n").alias("nm")).join(queries.groupBy(*GROUP).agg(F.sum("n").alias("nq")), GROUP)
    work = F.col("nm").cast("double") * F.col("nq")
    whole = sizes.agg(F.sum(work)).first()[0] or 1.0
    share = sizes.withColumn("tasks", F.ceil(work * tasks / F.lit(whole)))
    share = share.withColumn("qs", F.greatest(F.ceil(F.col("nq") / CELL_QUERIES), F.least(F.ceil(F.col("nq") / QUERY_ROWS), F.ceil(2 * F.sqrt("tasks")))))
    return share.select(*GROUP, F.col("qs").cast("int").alias("qs"),
                        F.greatest(F.lit(1), F.least(F.ceil(F.col("nm") / PACK_ROWS), F.ceil(F.col("tasks") / F.col("qs")))).cast("int").alias("ms"))


def dealt(notes: DataFrame, queries: DataFrame, shape: DataFrame, by: list[str], extra: tuple = (), known: DataFrame | None = None) -> DataFrame:
    """Packs in their cells, sorted: queries (kind 0), ``known`` rows of the
    group (kind 1), notes (kind 2) dealt by the hash of ``by`` and in its order."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    own = [c for c in dict.fromkeys([*by, *extra]) if c != "rows"]
    empty = [F.lit(None).cast(notes.schema[c].dataType).alias(c) for c in own]
    cols = [*CELL, "kind", *own, "rows"]
    q = queries.join(shape, GROUP).withColumn("qc", part("qs", "rows")).withColumn("mc", every("ms"))
    rows = q.select(*CELL, F.lit(0).alias("kind"), *empty, "rows").select(*cols)
    if known is not None:
        k = known.join(shape, GROUP).withColumn("qc", every("qs")).withColumn("mc", every("ms"))
        rows = rows.unionByName(k.select(*CELL, F.lit(1).alias("kind"), *empty, "rows").select(*cols))
    n = notes.join(shape, GROUP).withColumn("mc", part("ms", *by)).withColumn("qc", every("qs"))
    rows = rows.unionByName(n.select(*CELL, F.lit(2).alias("kind"), *own, "rows").select(*cols))
    return rows.repartition(*CELL).sortWithinPartitions(*CELL, "kind", *own)


def nearest(queries: DataFrame, notes: DataFrame, schema, pack_rows: int = PACK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Candidates (``schema``): rows that hold each query's k nearest notes of
    its group. ``queries``: query_id, project, status, q_embedding, k, q_min;
    ``notes``: project, status, id, embedding and the columns to carry. Packs
    are written to the shared scratch folder first."""
    base = scratch_path(notes.sparkSession, f"packs-{uuid.uuid4().hex}")
    n = stored(packs(notes, "embedding", "id", min(pack_rows, PACK_ROWS)), f"{base}/notes")
    q = stored(packs(queries, "q_embedding", "query_id", min(query_rows, QUERY_ROWS)), f"{base}/queries")
    cells = dealt(n, q, grid(n, q), ["rows"])
    return cells.mapInArrow(streamed(Scan, [f.name for f in schema.fields]), schema)
