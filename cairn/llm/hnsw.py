"""Approximate nearest neighbours by cosine: one hierarchical navigable
small-world graph per shard, shard results merged.

``build_index`` writes one row per shard (about ``SHARD`` distinct vectors of
one dimension, dealt by hash): the vectors, and per level the neighbours as one
flat array. Equal vectors share a node, which keeps as many of their smallest
ids as a query can ask for; nothing else of a copy can enter a result, as ties
go to the smaller id. ``search`` sends blocks of queries to every shard and
keeps the nearest per query.

Recall depends on ``links``, ``build_width`` and ``search_width``; the tests
measure it against brute force. Scores are cosines in double precision of the
original vectors.

Vectors that are null, empty, zero, or hold a null or non-finite component take
no part, as query or candidate; rows without an id neither. A row with the
query's id is never its candidate. Vectors of another dimension are no
candidates. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cairn.llm.common import stored

SHARD = 8192
LINKS = 16  # per node; twice as many on the lowest level
BUILD_WIDTH = 80
SEARCH_WIDTH = 120
QUERY_BLOCK = 1 << 15


class Graph:
    """Unit vectors and neighbours; ``levels[l]`` is (nodes x width) with -1 for none."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 0):
        self.v, self.links, self.width = vectors, links, width
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.top = np.minimum(np.floor(-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(links)).astype(int), 8) if n else np.zeros(0, int)
        self.levels = [np.full((n, links * (1 if k else 2)), -1, dtype=np.int32) for k in range(int(self.top.max(initial=0)) + 1)]
        self.size = [np.zeros(n, dtype=np.int32) for _ in self.levels]
        self.entry, self.height = 0, int(self.top[0]) if n else 0
        self.seen, self.mark = np.zeros(n, dtype=np.int32), 0
        for i in range(1, n):
            self._insert(i)

    @classmethod
    def of(cls, vectors, levels, entry):
        g = cls(vectors[:0])
        g.v, g.levels, g.entry, g.height = vectors, levels, entry, len(levels) - 1
        g.size = [(x >= 0).sum(axis=1) for x in levels]
        g.seen = np.zeros(len(vectors), dtype=np.int32)
        return g

    def _greedy(self, q, at: int, level: int) -> int:
        best = float(self.v[at] @ q)
        while True:
            near = self.levels[level][at, : self.size[level][at]]
            if not len(near):
                return at
            s = self.v[near] @ q
            k = int(s.argmax())
            if s[k] <= best:
                return at
            best, at = float(s[k]), int(near[k])

    def _beam(self, q, at: int, level: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found from ``at``, as (similarity, node)."""
        self.mark += 1
        mark, seen, nb, size, v = self.mark, self.seen, self.levels[level], self.size[level], self.v
        s = float(v[at] @ q)
        seen[at] = mark
        todo, found = [(-s, at)], [(s, at)]
        while todo:
            d, c = heapq.heappop(todo)
            if len(found) >= width and -d < found[0][0]:
                break
            near = nb[c, : size[c]]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            sims = v[near] @ q
            if len(found) >= width:
                ok = sims > found[0][0]
                near, sims = near[ok], sims[ok]
            for s, i in zip(sims.tolist(), near.tolist()):
                if len(found) < width:
                    heapq.heappush(found, (s, i))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, i))
                else:
                    continue
                heapq.heappush(todo, (-s, i))
        return found

    def _choose(self, sims: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Nearest first, leaving out nodes nearer to one chosen than to the
        query; free places go to the nearest left out."""
        order = np.argsort(-sims, kind="stable")
        nodes, sims = nodes[order], sims[order]
        if len(nodes) <= most:
            return nodes
        between = self.v[nodes] @ self.v[nodes].T
        blocked = np.zeros(len(nodes), dtype=bool)
        out: list[int] = []
        for k in range(len(nodes)):
            if not blocked[k]:
                out.append(k)
                if len(out) == most:
                    break
                blocked |= between[k] > sims
        if len(out) < most:
            rest = np.setdiff1d(np.arange(len(nodes)), out, assume_unique=True)
            out += rest[: most - len(out)].tolist()
        return nodes[out]

    def _insert(self, i: int) -> None:
        q, at, top = self.v[i], self.entry, int(self.top[i])
        for level in range(self.height, top, -1):
            at = self._greedy(q, at, level)
        for level in range(min(top, self.height), -1, -1):
            found = self._beam(q, at, level, self.width)
            sims, nodes = np.array([f[0] for f in found]), np.array([f[1] for f in found])
            near = self._choose(sims, nodes, self.links)
            at = int(nodes[sims.argmax()])
            nb, size = self.levels[level], self.size[level]
            nb[i, : len(near)] = near
            size[i] = len(near)
            most = nb.shape[1]
            for j in near.tolist():
                k = int(size[j])
                if k < most:
                    nb[j, k] = i
                    size[j] = k + 1
                else:
                    all_ = np.append(nb[j], i)
                    # room for later links, so that a full list isn't chosen anew each time
                    kept = self._choose(self.v[all_] @ self.v[j], all_, most - most // 4)
                    nb[j] = -1
                    nb[j, : len(kept)] = kept
                    size[j] = len(kept)
        if top > self.height:
            self.entry, self.height = i, top

    def nearest(self, q: np.ndarray, width: int) -> np.ndarray:
        if not len(self.v):
            return np.zeros(0, np.int64)
        at = self.entry
        for level in range(self.height, 0, -1):
            at = self._greedy(q, at, level)
        return np.array([i for _, i in self._beam(q, at, 0, width)])


INDEX = "shard int, dim int, n int, vectors binary, members binary, levels array<binary>, entry int"


def usable(v: Column) -> Column:
    """No null, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def vectors_of(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v is array<double>."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    # -0.0 becomes 0.0, so equal vectors are equal rows
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def _unit(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / top
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def build_index(vectors: DataFrame, k: int, shard: int = SHARD, links: int = LINKS, width: int = BUILD_WIDTH) -> DataFrame:
    """One row per shard of ``vectors`` (vec_id, v); written once. Serves
    queries for up to ``k`` neighbours."""
    keep = k + 1
    by_vector = W.Window.partitionBy("v").orderBy("vec_id")
    first = vectors.distinct().withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= keep)
    nodes = stored(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v")), "nodes")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards, at = {}, 0
    for dim in sorted(sizes):
        shards[dim] = (at, max(1, -(-sizes[dim] // shard)))
        at += shards[dim][1]
    number = F.lit(0)
    for dim, (base, n) in shards.items():
        number = F.when(F.col("dim") == dim, base + F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(n))).otherwise(number)

    def make(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        v = np.array(pdf["v"].tolist(), dtype=np.float64)
        members = np.full((len(pdf), keep), -1, dtype=np.int64)
        for i, ids in enumerate(pdf["ids"]):
            members[i, : len(ids)] = ids
        g = Graph(_unit(v), links, width, seed=int(key[0]))
        return pd.DataFrame({"shard": [int(key[0])], "dim": [v.shape[1]], "n": [len(v)], "vectors": [v.astype("<f8").tobytes()], "members": [members.astype("<i8").tobytes()],
                             "levels": [[x.astype("<i4").tobytes() for x in g.levels]], "entry": [g.entry]})

    dealt = nodes.withColumn("shard", number.cast("int"))
    # one task per shard: shards are what is built in parallel
    return stored(dealt.repartition(max(1, at), "shard").groupBy("shard").applyInPandas(make, INDEX), "hnsw")


FOUND = "query_id long, vec_id long, score double"


def _search_shard(k: int, keep: int, links: int, width: int):
    def run(key, queries, index):
        import pandas as pd

        if not len(queries) or not len(index):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        row = index.iloc[0]
        n, dim = int(row["n"]), int(row["dim"])
        v = np.frombuffer(row["vectors"], "<f8").reshape(n, dim)
        members = np.frombuffer(row["members"], "<i8").reshape(n, keep)
        levels = [np.frombuffer(x, "<i4").reshape(n, -1) for x in row["levels"]]
        g = Graph.of(_unit(v), levels, int(row["entry"]))
        norm = np.sqrt((v * v).sum(axis=1))
        out = []
        qs = np.array(queries["v"].tolist(), dtype=np.float64)
        for qid, q, u in zip(queries["query_id"].tolist(), qs, _unit(qs)):
            near = g.nearest(u, width)
            s = (v[near] * q).sum(axis=1) / (norm[near] * np.sqrt((q * q).sum()))
            top = np.argsort(-s, kind="stable")[: k + 1]
            # a node at the cut may tie with others: all found with its score stay
            top = np.flatnonzero(s >= s[top[-1]])
            best = sorted((-float(s[t]), int(i)) for t in top for i in members[near[t]] if i >= 0 and i != qid)[:k]
            out += [(qid, i, -x) for x, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH, links: int = LINKS, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row of
    ``queries`` (query_id, v). Every block of queries visits every shard of its
    dimension, so a task holds one shard and one block."""
    n = queries.count()
    blocks = max(1, -(-n // block))
    shards = index.select(F.col("shard").alias("to_shard"), "dim")
    q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("v"))
    q = q.join(shards, "dim").select(F.col("to_shard").alias("shard"), "block", "query_id", "v")  # a stated query set against all shards
    i = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = q.groupBy("shard", "block").cogroup(i.groupBy("shard", "block")).applyInPandas(_search_shard(k, k + 1, links, width), FOUND)
    best = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column, k: int = 5, **kw) -> DataFrame:
    """The ``k`` nearest other rows of every row of (vec_id, embedding) for
    which ``is_query`` holds."""
    v = stored(vectors_of(table), "vectors")
    index = build_index(v, k, **{a: kw[a] for a in ("shard", "links", "width") if a in kw})
    queries = v.where(is_query).select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"])
    return search(index, queries, k, kw.get("search_width", SEARCH_WIDTH), kw.get("links", LINKS), kw.get("block", QUERY_BLOCK))
