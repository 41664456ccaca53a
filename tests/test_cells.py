"""A grid of cells answers as a full comparison does, and what leaves it does not grow with the number of blocks."""

import datetime as dt

import numpy as np
import pytest

from cairn import schema as S
from cairn.operators import cells as CE
from cairn.operators import pivots as PV
from cairn.operators import search as SR

AS_OF = dt.datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def spread(spark):
    """Vectors spread evenly: few blocks can be ruled out."""
    v = np.random.default_rng(5).normal(size=(1200, 24))
    notes = spark.createDataFrame([("p", f"n{i:05}", "decision", "t", "c", "s", [], None, [float(x) for x in r], "active", 0, "user", [], [], i % 5, None, AS_OF, AS_OF) for i, r in enumerate(v)], S.MEMORIES)
    asked = spark.createDataFrame([(i, "p", [float(x) for x in r], None, None, None, 4, None, None) for i, r in enumerate(v[:200])], S.SEARCH_QUERIES)
    return SR.searchable(notes, AS_OF).cache(), SR._query_frame(asked, 3, False).cache()


@pytest.mark.parametrize("rows", [30, 300])
def test_k_rows_a_query_leave_a_column_of_cells(spread, rows):
    notes, q = spread
    columns = 2  # 1,200 notes are two packs
    assert SR._blocked(q, notes, rows, 10).count() <= 200 * 12 * columns
    found, _ = PV.nearest(notes.sparkSession, PV.PivotIndex.build(notes, block_rows=rows), q, 10)
    assert found.count() <= 200 * 12 * columns


def _random(n, d, seed):
    m = np.random.default_rng(seed).normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_running_top_k_equals_one_comparison(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(CE, "HELD", 40)  # cut often
    monkeypatch.setattr(CE, "TILE", 7)
    q, m = _random(20, 8, 1), _random(500, 8, 2)
    m[100:220] = m[3]  # copies: ties by id
    ids = np.array([f"i{i:03}" for i in np.random.default_rng(3).permutation(500)], dtype=object)
    k, least = np.arange(1, 21), np.where(np.arange(20) % 3 == 0, 0.3, -np.inf)
    near = CE.Nearest(np.arange(20), q, k, least)
    for at in range(0, 500, 60):
        part = np.arange(at, min(at + 60, 500))
        part = part[np.argsort(ids[part])]
        near.add(pa.record_batch({"id": pa.array(ids[part], pa.string())}), m[part])
    got = sorted((x, i, round(d, 10)) for b in near.rows("p", ["query_id", "id", "distance"]) for x, i, d in zip(*(b.column(c).to_pylist() for c in range(3))))
    r, c, d = SR.local_topk(np.arange(20), q, k, least, ids, m)
    assert got == sorted((int(x), ids[i], round(float(y), 10)) for x, i, y in zip(r, c, d))


def test_vectors_that_are_no_numbers_match_nothing(spark):
    v = [[1.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], [0.5, 0.5]]
    notes = spark.createDataFrame([("p", str(i), "decision", "t", "c", "s", [], None, x, "active", 0, "user", [], [], 0, None, AS_OF, AS_OF) for i, x in enumerate(v)], S.MEMORIES)
    asked = spark.createDataFrame([(i, "p", x, None, None, None, 5, None, None) for i, x in enumerate(v)], S.SEARCH_QUERIES)
    for strategy in ("broadcast", "blocked", "pivots"):
        rows = SR.candidates(asked, notes, AS_OF, apply_min_similarity=False, strategy=strategy).collect()
        assert sorted((r["query_id"], r["id"]) for r in rows) == [(0, "0"), (0, "4"), (4, "0"), (4, "4")]


def test_a_broadcast_task_holds_about_k_rows_a_query(spark):
    """the kernel's running answer is bounded, however many batches a task has."""
    import pyarrow as pa

    q, m = _random(50, 8, 1), _random(6000, 8, 2)
    near = CE.Nearest(np.arange(50), q, np.full(50, 5), np.full(50, -np.inf))
    most = 0
    for at in range(0, 6000, 300):
        near.add(pa.record_batch({"id": pa.array([f"{i:05}" for i in range(at, at + 300)])}), m[at : at + 300])
        most = max(most, sum(b.num_rows for b in near.hits))
    assert most <= CE.HELD + 50 * 5
    near.cut()
    assert sum(b.num_rows for b in near.hits) == 250
    assert sum(b.num_rows for b in near.hits[:1]) == 250 and near.hits[0].schema.names == ["id", "r", "distance"]  # no vectors are held
