import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import hnsw


def brute(rows, is_query, k):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if is_query(i):
            s = {(-float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q))), j) for j, v in ok if j != i and len(v) == len(q)}
            out[i] = sorted(s)[:k]
    return out


def test_recall_of_one_graph():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 48))
    v = (centre[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 48))).astype(np.float64)
    u = hnsw._unit(v)
    g = hnsw.Graph(u)
    again = hnsw.Graph.of(u, g.levels, g.entry)
    hit = 0
    for i in range(0, 3000, 50):
        true = set(np.argsort(-(u @ u[i]), kind="stable")[:6].tolist())
        f = again.nearest(u[i], hnsw.SEARCH_WIDTH)
        hit += len(true & set(f[np.argsort(-(u[f] @ u[i]), kind="stable")[:6]].tolist()))
    assert hit / (6 * 60) >= 0.95


@pytest.mark.parametrize("shard,block", [(5000, 1000), (60, 7)])
def test_equals_brute_force_on_a_small_table(docs_of, shard, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 8)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[0]) for i in range(40)] + [(2000, [2 * x for x in base[1]])]
    rows += [(3000, None), (3010, [0.0] * 8), (3020, [float("nan")] * 8), (3030, [None] * 8), (3040, []), (None, base[2]), (3050, [float("inf")] + [1.0] * 7)]
    rows += [(4000, [1.0, 2.0]), (4010, [2.0, 1.0]), (4011, [-0.0, 1.0]), (4012, [0.0, 1.0]), (5, base[5])]
    t = docs_of([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = hnsw.nearest(t, F.col("vec_id") % 10 == 0, 5, shard=shard, block=block).collect()
    want = brute(dict.fromkeys((i, tuple(v) if v is not None else None) for i, v in rows), lambda i: i % 10 == 0, 5)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {i for i, v in want.items() if v}
    for i, v in by.items():
        assert [r for r, _, _ in sorted(v)] == list(range(1, len(v) + 1))
        assert [j for _, j, _ in sorted(v)] == [j for _, j in want[i]], i
        assert np.allclose([s for _, _, s in sorted(v)], [-s for s, _ in want[i]], atol=1e-12)


def test_empty_table(docs_of):
    t = docs_of([], "vec_id long, embedding array<float>")
    assert hnsw.nearest(t, F.col("vec_id") % 10 == 0, 5).collect() == []
