"""Clustering around centroids by a progressive search in the Walsh-Hadamard
domain, in exact integers.

A vector of 64 components x becomes the integers floor(1024 * x) and those
their Walsh-Hadamard transform (sums and differences only, so integers too).
The transform keeps distances up to the factor 64, and its coefficients run
from coarse (few sign changes) to fine. ``nearest`` adds squared coefficient
differences in that order for all centroids at once; a centroid whose partial
sum is already strictly greater than the whole distance of another one is left
out, the others go on until all 64 coefficients are in. Nothing is rounded, so
the result is that of a full comparison, ties to the smaller number.

``cluster`` writes the transformed vectors once and reads them in each round;
a round sends back one row of sums per task, centroid and coefficient, which Spark adds up. As the
transform is linear and its own inverse up to 64, sums of vectors are read off
the sums of coefficients. Only the centroids live on the driver.

Vectors that are null, empty, of another length, or hold a null or non-finite
component take no part, nor do those with a component over 10^17 / 1024, whose
distances the result could not hold; a distance or inertia over a long is null.
Rows of one id are vectors of their own; equal ids start in the order of their
components. A row without an id is clustered but never a starting centroid.
With fewer vectors than centroids there are as many centroids as vectors with
an id; without any, as for an empty table, no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stored

DIM, SCALE = 64, 1024
CENTROIDS, ROUNDS = 8, 10
#: Coefficients compared before each elimination, coarse to fine.
STEPS = (2, 4, 8, 16, 32, 64)
#: Up to this size of a component all sums of 64 squares fit 64 bits.
NARROW = 1 << 20
MOST = 10**17
TOP = (1 << 63) - 1


def walsh_order(n: int = DIM) -> np.ndarray:
    """Rows of the Hadamard matrix by their number of sign changes."""
    bits = np.array([[bin(i & j).count("1") & 1 for j in range(n)] for i in range(n)])
    return np.argsort(np.abs(np.diff(bits, axis=1)).sum(axis=1), kind="stable")


ORDER = walsh_order()
BACK = np.argsort(ORDER)


def _butterfly(v: np.ndarray) -> np.ndarray:
    v, h = v.copy(), 1
    while h < v.shape[-1]:
        pairs = v.reshape(*v.shape[:-1], -1, 2, h)
        a, b = pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]
        v = np.stack([a, b], axis=-2).reshape(v.shape)
        h *= 2
    return v


def transform(v: np.ndarray) -> np.ndarray:
    """Coefficients of integer vectors (rows), coarse to fine."""
    return _butterfly(v)[..., ORDER]


def restore(coefficients: np.ndarray) -> np.ndarray:
    """The integer vectors of ``coefficients`` (Python integers)."""
    return _butterfly(np.asarray(coefficients, dtype=object)[..., BACK]) // coefficients.shape[-1]


def nearest(x: np.ndarray, c: np.ndarray, steps=STEPS) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of ``x`` the nearest row of ``c`` and 64 times their squared
    distance; and the number of coefficients compared."""
    n, k = len(x), len(c)
    rows = np.arange(n)
    first = steps[0]
    d = x[:, None, :first] - c[None, :, :first]
    part = (d * d).sum(axis=2)
    # an upper bound: the whole distance of the centroid that leads after the first step
    lead = part.argmin(axis=1)
    d = x[:, first:] - c[lead, first:]
    most = part[rows, lead] + (d * d).sum(axis=1)
    alive = part <= most[:, None]
    work = n * k * first + n * (x.shape[1] - first)
    for at, to in zip(steps, steps[1:]):
        i, j = np.nonzero(alive)
        d = x[i, at:to] - c[j, at:to]
        part[i, j] += (d * d).sum(axis=1)
        alive[i, j] = part[i, j] <= most[i]
        work += len(i) * (to - at)
    # the leader is never out, so each row has one left; those left hold whole sums
    part[~alive] = TOP if part.dtype != object else part.max(initial=0) + 1
    best = part.argmin(axis=1)
    return best, part[rows, best], work


def vectors_of(table: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > MOST / SCALE))
    return rows.where((F.size("v") == DIM) & ~F.coalesce(bad, F.lit(True)))


CODED = "vec_id long, coefficients binary, wide string"


def coded(vectors: DataFrame) -> DataFrame:
    """(vec_id, coefficients as little-endian 32-bit integers; in ``wide`` as
    decimal numbers where those are too small)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column("v").flatten(), dtype=np.float64).reshape(-1, DIM)
            q = np.floor(v * SCALE)
            small = np.abs(q).max(axis=1) <= NARROW
            w = transform(np.where(small[:, None], q, 0).astype(np.int64)).astype("<i4")
            wide = [None if s else ",".join(map(str, transform(np.array([int(y) for y in row], dtype=object)))) for s, row in zip(small.tolist(), q)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in w], pa.binary()), pa.array(wide, pa.string())], names=["vec_id", "coefficients", "wide"])

    return vectors.mapInArrow(run, CODED)


def _placed(batch, centroids: list[list[int]]):
    """For a batch of ``coded``: its coefficients, centroid numbers and squared distances (whole numbers times 64)."""
    w = np.frombuffer(b"".join(batch.column("coefficients").to_pylist()), "<i4").reshape(-1, DIM).astype(np.int64)
    far = max(abs(y) for c in centroids for y in c) > NARROW * DIM
    wide = [] if far else [i for i, s in enumerate(batch.column("wide").to_pylist()) if s is not None]
    c = np.array(centroids, dtype=object if far else np.int64)
    if far:
        w = w.astype(object)
        for i, s in enumerate(batch.column("wide").to_pylist()):
            if s is not None:
                w[i] = [int(y) for y in s.split(",")]
        return (w, *nearest(w, c)[:2])
    best, d, _ = nearest(w, c)
    if wide:
        w, d, best = w.astype(object), d.astype(object), best.copy()
        for i in wide:
            w[i] = [int(y) for y in batch.column("wide")[i].as_py().split(",")]
        best[wide], d[wide], _ = nearest(w[wide], c.astype(object))
    return w, best, d


def _sums(centroids):
    def run(batches):
        import pyarrow as pa

        total = np.zeros((len(centroids), DIM), dtype=object)
        n = np.zeros(len(centroids), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                w, best, _ = _placed(b, centroids)
                for k in np.unique(best):
                    total[k] += w[best == k].sum(axis=0)
                n += np.bincount(best, minlength=len(centroids))
        held = [(int(k), j, str(total[k, j]), int(n[k])) for k in np.flatnonzero(n) for j in range(DIM)]
        yield pa.RecordBatch.from_arrays([pa.array(list(col), kind) for col, kind in zip(zip(*held) if held else [[]] * 4, (pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["cluster", "j", "s", "n"])

    return run


def moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids (as coefficients) after one round over ``table`` (as of ``coded``)."""
    parts = table.mapInArrow(_sums(centroids), "cluster int, j int, s string, n long")
    sums = parts.groupBy("cluster", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"), F.sum("n").alias("n")).collect()  # at most centroids x 64 rows
    out = [list(c) for c in centroids]
    for k in {r["cluster"] for r in sums}:
        own = sorted((r["j"], int(r["s"]), r["n"]) for r in sums if r["cluster"] == k)
        mean = restore(np.array([s for _, s, _ in own], dtype=object)) // own[0][2]
        out[k] = [int(y) for y in transform(mean)]
    return out


def _fits(values):
    return [int(y) if int(y) <= TOP else None for y in values]


def placed(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                _, best, d = _placed(b, centroids)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(_fits(d // DIM), pa.int64())], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of "seed:vec_id", transformed."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where(F.col("vec_id").isNotNull()).select(order.alias("h"), F.transform("v", lambda x: F.floor(x * SCALE)).alias("q")).orderBy("h", "q").limit(k).collect()
    return [[int(y) for y in transform(np.array([int(y) for y in r["q"]], dtype=object))] for r in rows]


def cluster(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) for ``table`` (vec_id, embedding), and the final centroids as integer components."""
    vectors = vectors_of(table)
    centroids = starts(vectors, k, seed)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False)), []
    rows = stored(coded(vectors), "coefficients")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    return placed(rows, centroids), [[int(y) for y in restore(np.array(c, dtype=object))] for c in centroids]


def report(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = cluster(table, k, rounds, seed)
    rows = stored(rows, "clusters") if centroids else rows
    digest = {i: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(centroids)}
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    lost = F.count(F.lit(1)) == F.count("distance")  # an inertia of distances that don't all fit is null
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.when(lost, total).alias("s")).collect()} if centroids else {}  # at most k rows
    whole = None if None in sums.values() else sum(sums.values())
    long = lambda s: F.lit(None if s is None or s > TOP else int(s)).cast("long")
    own, sha = F.lit(None).cast("long"), F.lit(None).cast("string")
    for i, s in sums.items():
        own, sha = F.when(F.col("cluster") == i, long(s)).otherwise(own), F.when(F.col("cluster") == i, F.lit(digest[i])).otherwise(sha)
    return rows.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), long(whole).alias("inertia"), sha.alias("centroid_sha256"))
