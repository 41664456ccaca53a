"""Exact search over a pivot index equals a full comparison, and reads fewer blocks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.operators import pivots as PV
from cairn.operators import search as SR

AS_OF = dt.datetime(2024, 1, 31)


def _notes(spark, vectors, project=lambda i: "p"):
    rows = [(project(i), f"n{i:05}", "decision", "t", "c", "s", [], None, None if v is None else [float(x) for x in v], "active" if i % 11 else "archived", 0, "user", [], [], i % 5, None, AS_OF, AS_OF)
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, S.MEMORIES)


def _queries(spark, rows):
    return spark.createDataFrame([(i, p, [float(x) for x in v], None, None, st, k, m, None) for i, p, v, st, k, m in rows], S.SEARCH_QUERIES)


def _clustered(n, clusters=12, dim=16, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(clusters, dim))
    return c[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))


def _rows(df):
    return sorted((r["query_id"], r["rank_d"], r["id"], round(r["distance"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    v = _clustered(1500)
    v[100:160] = v[7]  # copies: ties by id
    mem = _notes(spark, v, lambda i: "p" if i % 5 else "q").cache()
    q = _queries(spark, [(i, "p" if i % 3 else "q", v[i * 9], "archived" if i % 7 == 0 else None, 4, [None, 0.2, 0.9, 2.0][i % 4]) for i in range(90)])
    return mem, q


@pytest.mark.parametrize("with_min", [False, True])
def test_equals_the_full_comparison(clustered, with_min):
    mem, q = clustered
    a = SR.candidates(q, mem, AS_OF, apply_min_similarity=with_min, strategy="blocked")
    b = SR.candidates(q, mem, AS_OF, apply_min_similarity=with_min, strategy="pivots", block_rows=40, query_block_rows=16)
    assert _rows(a) == _rows(b) and a.count() > 100


def test_reads_fewer_blocks_whatever_the_scan_tasks(spark, clustered):
    mem, q = clustered
    frame = SR._query_frame(q, 3, False)
    seen = []
    for parts in (2, 13):
        index = PV.PivotIndex.build(SR.searchable(mem.repartition(parts), AS_OF), block_rows=40)
        found, visited = PV.nearest(spark, index, frame, 16)
        pairs = visited.count()
        every = frame.join(index.blocks.groupBy("project", "status").agg(F.count("*").alias("n")), ["project", "status"]).agg(F.sum("n")).first()[0]
        assert pairs < 0.4 * every
        assert index.blocks.agg(F.max("n")).first()[0] <= 80
        seen.append((pairs, found.count(), every))
    assert seen[0] == seen[1]


def test_one_index_serves_several_batches(spark, clustered):
    mem, q = clustered
    index = PV.PivotIndex.build(SR.searchable(mem, AS_OF), block_rows=60)
    for part in (q.filter("query_id < 20"), q.filter("query_id >= 20")):
        assert _rows(SR.candidates(part, mem, AS_OF, strategy="pivots", index=index)) == _rows(SR.candidates(part, mem, AS_OF, strategy="blocked"))


def test_odd_vectors_and_empty_sides(spark):
    v = [None, [], [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 2.0, 0.0], [1.0, 1.0], [5.0, 5.0, 0.0], [-1.0, 0.0, 0.0]]
    mem = _notes(spark, v)
    q = _queries(spark, [(1, "p", [1.0, 0.1, 0.0], None, 50, None), (2, "p", [2.0, 1.0], None, 1, None), (3, "p", [0.0, 0.0, 0.0], None, 5, None), (4, "none", [1.0, 0.0, 0.0], None, 5, None)])
    a, b = (SR.candidates(q, mem, AS_OF, apply_min_similarity=False, strategy=s) for s in ("blocked", "pivots"))
    assert _rows(a) == _rows(b) and {r[0] for r in _rows(b)} == {1, 2}
    for m, x in ((mem.limit(0), q), (mem, q.limit(0))):
        assert SR.candidates(x, m, AS_OF, strategy="pivots").count() == 0


def test_all_notes_alike(spark):
    mem = _notes(spark, [[1.0, 2.0]] * 300)
    q = _queries(spark, [(1, "p", [1.0, 2.0], None, 3, None), (2, "p", [-1.0, 1.0], None, 2, None)])
    a = SR.candidates(q, mem, AS_OF, apply_min_similarity=False, strategy="blocked")
    b = SR.candidates(q, mem, AS_OF, apply_min_similarity=False, strategy="pivots", block_rows=20)
    assert _rows(a) == _rows(b)
