"""Vector search: exact cosine top-k, re-rank, token budget.

Physical design
---------------
Exact top-k needs every (query, note) score of a project, but it must never
*emit* all pairs. Scores are computed inside a task as a dense matrix product
and only a local top-k per query leaves the task:

* ``broadcast`` strategy (default when the query batch is provably small:
  rows x vector bytes below ``max_broadcast_bytes``): the query vectors go to
  every executor once; each memory partition compares its notes pack by pack in
  ``mapInArrow`` and keeps, per query, its k nearest (ties by id). The
  memories table is scanned once and never shuffled; only candidates
  (queries x partitions x k rows at most) reach the exchange.
* ``blocked`` strategy (any size): a grid of cells (``operators.cells``). Per
  (project, status, vector length) notes and queries are packed and dealt to
  the rows and columns of a grid that follows the cluster's cores; a task
  streams the notes of a cell past its queries. A hot project holding a third
  of all rows has more cells.
* ``pivots`` strategy: a stored index whose blocks a query can rule out by the
  triangle inequality (``operators.pivots``); for stores searched again and
  again, and too large to score in full.

The global cut is one window ordered by (distance, id) per query, with a
literal bound so the planner inserts a partial ``WindowGroupLimit`` before
the exchange. The min-similarity filter commutes with the cut (both follow
distance) and is applied inside the kernel; category and tag filters must
stay above the cut (they can make a search return fewer than ``limit``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import schema as S
from cairn.functions import score as V
from cairn.functions import text as X
from cairn.operators import cells as CE
from cairn.operators import filters as FL
from cairn.operators.cells import snap

# Columns of a note carried through the kernel: small scalars needed to
# filter and score candidates. Texts are joined back for the final hits only.
CARRY = ["category", "tags", "access_count", "updated_at"]

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("project", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("tags", S.STR_ARRAY),
    T.StructField("access_count", T.IntegerType()),
    T.StructField("updated_at", S.TS),
])


# --------------------------------------------------------------- kernels

def _by_length(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length: positions of the usable rows (not NULL, empty or
    zero) and their unit rows as one float64 matrix. Vectors of different
    lengths are never compared (a store may hold two models' vectors)."""
    lens = np.fromiter((len(v) if v is not None else 0 for v in vectors), dtype=np.int64, count=len(vectors))
    out = {}
    for dim in np.unique(lens[lens > 0]).tolist():
        pos = np.flatnonzero(lens == dim)
        m = np.concatenate(vectors.iloc[pos].to_numpy()).astype(np.float64).reshape(len(pos), dim)
        nrm = np.linalg.norm(m, axis=1)
        ok = nrm > 0
        if ok.any():
            out[dim] = pos[ok], m[ok] / nrm[ok][:, None]
    return out


def local_topk(q_ids: np.ndarray, q_mat: np.ndarray, q_k: np.ndarray, q_min: np.ndarray,
               m_ids: np.ndarray, m_mat: np.ndarray):
    """Exact per-query top-k of one block by (distance, id).

    Returns (query_index, memory_index, distance) arrays. A query keeps at
    most ``q_k`` rows and only those with ``1 - distance >= q_min``.
    Ties at the k-th distance are resolved by id, so the local cut never
    drops a row the global cut would keep.
    """
    if len(q_ids) == 0 or len(m_ids) == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0)
    order = np.argsort(m_ids, kind="stable")            # id order = column order
    dist = 1.0 - snap(q_mat @ m_mat[order].T)            # nq x nm
    kmax = int(q_k.max())
    mask = (1.0 - dist) >= q_min[:, None]
    if dist.shape[1] > kmax:
        kth = np.partition(dist, kmax - 1, axis=1)[:, kmax - 1:kmax]
        mask &= dist <= kth
    r, c = np.nonzero(mask)
    d = dist[r, c]
    o = np.lexsort((c, d, r))                            # by query, distance, id
    r, c, d = r[o], c[o], d[o]
    first = np.searchsorted(r, r, side="left")
    keep = (np.arange(len(r)) - first) < q_k[r]
    return r[keep], order[c[keep]], d[keep]


def local_topk_chunked(q_ids, q_mat, q_k, q_min, m_ids, m_mat, q_chunk: int = 1024, m_chunk: int = 8192):
    """``local_topk`` over a block of any size with bounded memory: the score
    matrix is built in (query chunk x note chunk) tiles of at most
    ``q_chunk * m_chunk`` doubles; per query the tiles' cuts are merged by
    (distance, id). Exact: each tile keeps every row that could be in the
    query's top-k."""
    nq, nm = len(q_ids), len(m_ids)
    if nq <= q_chunk and nm <= m_chunk:
        return local_topk(q_ids, q_mat, q_k, q_min, m_ids, m_mat)
    id_rank = np.empty(nm, dtype=np.int64)
    id_rank[np.argsort(m_ids, kind="stable")] = np.arange(nm)
    rs, ms, ds = [], [], []
    for q0 in range(0, nq, q_chunk):
        q1 = min(nq, q0 + q_chunk)
        for m0 in range(0, nm, m_chunk):
            m1 = min(nm, m0 + m_chunk)
            r, mi, d = local_topk(q_ids[q0:q1], q_mat[q0:q1], q_k[q0:q1], q_min[q0:q1],
                                  m_ids[m0:m1], m_mat[m0:m1])
            rs.append(r + q0)
            ms.append(mi + m0)
            ds.append(d)
    r, mi, d = np.concatenate(rs), np.concatenate(ms), np.concatenate(ds)
    o = np.lexsort((id_rank[mi], d, r))
    r, mi, d = r[o], mi[o], d[o]
    first = np.searchsorted(r, r, side="left")
    keep = (np.arange(len(r)) - first) < q_k[r]
    return r[keep], mi[keep], d[keep]


def _broadcast_kernel(bc):
    def run(batches):
        info, near = bc.value, {}                     # running top-k of this task
        for batch in batches:
            if not batch.num_rows:
                continue
            for proj, status, dim, notes in CE.split(batch, "embedding", "id", CE.PACK_ROWS):
                qi = info.get((proj, status), {}).get(dim)
                if qi is None:
                    continue
                ok, mat = CE.unit(CE.matrix(notes.column("embedding")))
                if len(ok):
                    if (proj, status, dim) not in near:
                        near[proj, status, dim] = CE.Nearest(qi["ids"], qi["mat"], qi["k"], qi["min"])
                    near[proj, status, dim].add(notes.take(ok).drop_columns(["embedding"]), mat)
        for (proj, _, _), found in near.items():
            yield from found.rows(proj, CANDIDATE_SCHEMA.names)
    return run


# ------------------------------------------------------------ operators

def searchable(memories: DataFrame, as_of) -> DataFrame:
    """Notes a search may see: alive (any status, Q5) and with a vector."""
    return (FL.alive(memories, as_of)
            .filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
            .select("project", "status", "id", "embedding", *CARRY))


def _query_frame(queries: DataFrame, oversample: int, with_min: bool) -> DataFrame:
    lim = F.coalesce(F.col("limit"), F.lit(S.SEARCH_LIMIT))
    qmin = (F.coalesce(F.col("min_similarity"), F.lit(S.SEARCH_MIN_SIMILARITY)) if with_min
            else F.lit(-math.inf))
    return queries.select(
        "query_id", "project", F.coalesce(F.col("status"), F.lit(S.ACTIVE)).alias("status"),
        F.col("embedding").alias("q_embedding"),
        (lim * oversample).cast("long").alias("k"), qmin.cast("double").alias("q_min"))


def choose_strategy(queries: DataFrame, strategy: str = "auto", max_broadcast_bytes: int = 64 << 20,
                    oversample: int = S.SEARCH_OVERSAMPLE):
    """Size check before anything is broadcast: query rows x (bytes per
    vector + k candidate rows) against ``max_broadcast_bytes``, so a batch
    with few queries but huge limits goes blocked too. Returns (strategy,
    n_queries, k_max) for exactly these arguments; one small aggregate job."""
    if strategy not in ("auto", "broadcast"):
        return strategy, None, None
    lim = F.coalesce(F.col("limit"), F.lit(S.SEARCH_LIMIT)) * oversample
    st = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"),
                     F.max(lim).alias("kmax"), F.sum(lim.cast("long")).alias("rows")).first()
    n_q, dim, kmax = st["n"], st["dim"] or 0, st["kmax"] or 1
    est = n_q * (dim * 8 + 64) + (st["rows"] or 0) * 128
    if strategy == "broadcast" and est > max_broadcast_bytes:
        raise ValueError(f"query batch of ~{est} bytes exceeds the broadcast bound")
    return ("broadcast" if est <= max_broadcast_bytes else "blocked"), n_q, kmax


def candidates(queries: DataFrame, memories: DataFrame, as_of, oversample: int = S.SEARCH_OVERSAMPLE,
               apply_min_similarity: bool = True, strategy: str = "auto",
               max_broadcast_bytes: int = 64 << 20, block_rows: int = 20_000,
               query_block_rows: int = 2_048, index=None) -> DataFrame:
    """Per query, the ``limit * oversample`` nearest live notes of its
    project and status, by cosine distance then id (exact).

    Returns ``CANDIDATE_SCHEMA`` plus ``rank_d`` (1-based distance rank).
    With ``apply_min_similarity`` the F5 filter is applied below the cut.
    ``strategy="pivots"`` searches a pivot index (``operators.pivots``):
    ``index``, or one built for this call with blocks of ``block_rows``.
    """
    spark = queries.sparkSession
    q = _query_frame(queries, oversample, apply_min_similarity)
    mem = searchable(memories, as_of)
    strategy, n_q, kmax = choose_strategy(queries, strategy, max_broadcast_bytes, oversample)

    bc = None
    if strategy == "broadcast":
        if n_q == 0:
            return spark.createDataFrame([], T.StructType(CANDIDATE_SCHEMA.fields + [
                T.StructField("rank_d", T.IntegerType())]))
        # One row more than counted: a batch that grew since the check is
        # refused, never cut.
        pdf = q.limit(int(n_q) + 1).toPandas()
        if len(pdf) > n_q:
            raise RuntimeError("the query batch grew while it was read; store it first")
        groups = {}
        for (proj, status), g in pdf.groupby(["project", "status"], sort=False):
            for dim, (pos, mat) in _by_length(g["q_embedding"]).items():
                sub = g.iloc[pos]
                k = sub["k"].to_numpy(dtype=np.int64)
                some = k > 0
                if some.any():
                    groups.setdefault((proj, status), {})[dim] = {
                        "ids": sub["query_id"].to_numpy(dtype=np.int64)[some], "mat": mat[some],
                        "k": k[some], "min": sub["q_min"].to_numpy(dtype=np.float64)[some]}
        bc = spark.sparkContext.broadcast(groups)
    if bc is not None:
        projects = sorted({p for p, _ in groups})
        # Prune the scan to queried projects (partition pruning on a
        # project-partitioned table); the kernel skips other statuses.
        mem = mem.filter(F.col("project").isin(projects)) if projects else mem.limit(0)
        local = mem.mapInArrow(_broadcast_kernel(bc), CANDIDATE_SCHEMA)
        kq = q.select("query_id", "k")
        local = local.join(F.broadcast(kq), "query_id")   # k per query: n_q rows, checked above
    elif strategy == "pivots":
        from cairn.operators import pivots as PV
        local, _ = PV.nearest(spark, index or PV.PivotIndex.build(mem, block_rows=block_rows), q, query_block_rows)
        kmax = None
    else:
        local = _blocked(q, mem, block_rows, query_block_rows)
        kmax = None

    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc(), F.col("id").asc())
    if kmax is None:
        kmax = q.agg(F.max("k")).first()[0] or 1
    ranked = local.withColumn("rank_d", F.row_number().over(w))
    # Literal bound first (enables the partial WindowGroupLimit), then each
    # query's own k.
    return (ranked.filter(F.col("rank_d") <= int(kmax)).filter(F.col("rank_d") <= F.col("k"))
            .drop("k"))


def _blocked(q: DataFrame, mem: DataFrame, block_rows: int, query_block_rows: int) -> DataFrame:
    local = CE.nearest(q, mem, CANDIDATE_SCHEMA, block_rows, query_block_rows)
    return local.join(q.select("query_id", "k"), "query_id")


def rerank(cands: DataFrame, queries: DataFrame, as_of) -> DataFrame:
    """F2 + F3 above the cut, V5 relevance, T2: first ``limit`` by rounded
    relevance desc, then distance, then id."""
    qp = queries.select("query_id", F.col("category").alias("q_category"),
                        F.col("tags").alias("q_tags"),
                        F.coalesce(F.col("limit"), F.lit(S.SEARCH_LIMIT)).alias("q_limit"))
    c = cands.join(qp, "query_id")
    c = c.filter(F.col("q_category").isNull() | (F.col("q_category") == "") |
                 (F.col("category") == F.col("q_category")))
    c = c.filter(F.col("q_tags").isNull() | (F.size("q_tags") == 0) |
                 F.coalesce(F.arrays_overlap(F.col("tags"), F.col("q_tags")), F.lit(False)))
    sim = V.snap(F.lit(1.0) - F.col("distance"))
    c = c.withColumn("similarity", V.round_places(sim, 4)).withColumn(
        "relevance_score", V.round_places(V.relevance(sim, "updated_at", "access_count", as_of), 4))
    w = Window.partitionBy("query_id").orderBy(F.col("relevance_score").desc(),
                                               F.col("distance").asc(), F.col("id").asc())
    return (c.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= F.col("q_limit"))
            .drop("q_category", "q_tags", "q_limit"))


NOTE_COLUMNS = ["title", "summary", "content", "metadata", "status", "priority", "source", "related_ids",
                "created_at", "expires_at", "entities"]


def attach_notes(hits: DataFrame, memories: DataFrame, columns: list[str]) -> DataFrame:
    """Join note fields back onto hits: a plain join whose form AQE picks from
    the measured size of the hits (no side is forced)."""
    return hits.join(memories.select("project", "id", *columns), ["project", "id"], "inner")


def search(queries: DataFrame, memories: DataFrame, as_of, **kw) -> DataFrame:
    """Hits per query with ``rank``, rounded ``similarity`` and
    ``relevance_score``, and the note as served (access_count as read, Q8).
    Feed ``access_events(hits)`` to M5 to count the accesses."""
    hits = rerank(candidates(queries, memories, as_of, **kw), queries, as_of)
    return attach_notes(hits, memories, NOTE_COLUMNS)


def access_events(hits: DataFrame) -> DataFrame:
    """Search hits as access events for M5 (one per hit)."""
    return hits.select("project", "id")


def budget_fold(ranked: DataFrame, group: str, order: str, cost: str, budget: str,
                carry: list[str]) -> DataFrame:
    """Greedy-with-skip over ranked items per group.

    Walks items in ``order``; an item fits if the running total plus its cost
    stays within the budget, in which case the total grows. A non-fitting
    item is skipped and a later smaller one may still fit. Adds ``fits``,
    ``tokens_used`` (group total) and ``has_more`` (some item did not fit).
    Per group the list is bounded by the caller's limit.
    """
    item = F.struct(F.col(order).alias("o"), F.col(cost).alias("c"),
                    *[F.col(x).alias(x) for x in carry])
    g = ranked.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"),
                                  F.first(budget).alias("budget"))
    acc0 = F.struct(F.lit(0).cast("long").alias("used"),
                    F.array().cast(T.ArrayType(T.BooleanType())).alias("fits"))

    def step(acc, x):
        ok = acc["used"] + x["c"] <= F.col("budget")
        return F.struct(F.when(ok, acc["used"] + x["c"]).otherwise(acc["used"]).alias("used"),
                        F.concat(acc["fits"], F.array(ok)).alias("fits"))

    folded = g.select(group, "items", F.aggregate("items", acc0, step).alias("acc"))
    zipped = folded.select(group, F.col("acc.used").alias("tokens_used"),
                           F.posexplode(F.arrays_zip(F.col("items").alias("item"),
                                                     F.col("acc.fits").alias("fits"))))
    out = zipped.select(group, "tokens_used", F.col("col.item.o").alias(order),
                        F.col("col.item.c").alias(cost),
                        *[F.col(f"col.item.{x}").alias(x) for x in carry],
                        F.col("col.fits").alias("fits"))
    w = Window.partitionBy(group)
    return out.withColumn("has_more", F.max((~F.col("fits")).cast("int")).over(w) == 1)


def search_budgeted(queries: DataFrame, memories: DataFrame, as_of, **kw) -> DataFrame:
    """Per hit the index entry (id, title, summary, category, similarity),
    its ``tokens``, whether it is in the budgeted details (``fits``), the
    served note's fields for those details (NULL for the others), and per
    query the ``tokens_used`` and ``has_more``. Queries without a positive
    budget keep every hit as detail (plain search)."""
    hits = search(queries, memories, as_of, **kw)
    b = queries.select("query_id", "token_budget")
    index = ["id", "title", "summary", "category", "similarity", "relevance_score"]
    detail = [c for c in [*NOTE_COLUMNS, "tags", "access_count", "updated_at"] if c not in index]
    h = hits.join(b, "query_id").withColumn("tokens", X.tokens("content"))
    h = h.withColumn("budget", F.when(F.col("token_budget") > 0, F.col("token_budget").cast("long"))
                     .otherwise(F.lit(None).cast("long")))
    # Only token counts go through the fold; texts join back by (query, rank).
    folded = budget_fold(h.filter(F.col("budget").isNotNull()), "query_id", "rank", "tokens", "budget", [])
    plain = (h.filter(F.col("budget").isNull())
             .select("query_id", F.lit(None).cast("long").alias("tokens_used"), "rank", "tokens",
                     F.lit(True).alias("fits"), F.lit(False).alias("has_more")))
    both = folded.unionByName(plain.select(*folded.columns))
    return (both.join(h.select("query_id", "rank", *index, *detail), ["query_id", "rank"])
            .select("query_id", "tokens_used", "rank", "tokens", *index, "fits", "has_more",
                    *[F.when(F.col("fits"), F.col(c)).alias(c) for c in detail]))
