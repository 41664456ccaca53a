import hashlib
import math

import numpy as np
import pytest

from cairn.llm import hadamard as H

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=8, rounds=10, seed=3):
    """Everything in Python integers, row by row."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for o, (_, v) in zip(own, kept) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, o, d in found if o == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, o, d, total[o], sum(total.values()), sha[o]) for i, o, d in found), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_transform_keeps_distances_and_goes_back():
    rng = np.random.default_rng(1)
    v = rng.integers(-5000, 5000, (20, 64))
    w = H.transform(v)
    assert (((w[:, None] - w[None]) ** 2).sum(axis=2) == 64 * ((v[:, None] - v[None]) ** 2).sum(axis=2)).all()
    assert (H.restore(w) == v).all()
    constant = H.transform(np.ones((1, 64), dtype=np.int64))
    assert constant[0, 0] == 64 and not constant[0, 1:].any()
    basis = H.restore(64 * np.eye(64, dtype=np.int64))  # coefficient k has k sign changes
    assert [int((np.diff(np.sign(b.astype(int))) != 0).sum()) for b in basis] == list(range(64))


def test_progressive_search_equals_full_comparison():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (8, 64))
    v = centres[rng.integers(0, 8, 3000)] + rng.integers(-40, 40, (3000, 64))
    v[:8], v[8] = centres, (centres[0] + centres[1]) // 2
    centres[5] = centres[2]  # ties go to the smaller number
    x, c = H.transform(v), H.transform(centres)
    best, d, work = H.nearest(x, c)
    full = ((v[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (d == 64 * full.min(axis=1)).all() and 5 not in best
    assert work < 0.5 * x.shape[0] * 8 * 64


def test_report_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 64))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.3 * rng.normal(size=64)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, [0.5] * 64), (200, rows[3][1]), (201, [0.0] * 64), (202, [-0.0004] * 64), (None, [0.25] * 64)]
    dropped = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] * 64), (306, [float("inf")] * 64)]
    df = spark.createDataFrame(rows + dropped, SCHEMA)
    assert rows_of(H.report(df)) == plain(rows)
    clash = df.selectExpr("vec_id", "embedding", "1 as cluster", "'x' as distance", "2 as coefficients", "3 as v").repartition(5)
    assert rows_of(H.report(clash)) == plain(rows)


@pytest.mark.parametrize("n", [1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert rows_of(H.report(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_all_equal_vectors(spark):
    rows = [(i, [1.5] * 64) for i in range(40)]
    got = rows_of(H.report(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and {r[1:3] for r in got} == {(0, 0)}


def test_wide_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=64) * (3e4 if i % 3 else 1)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(H.report(df)) == plain(rows)
    huge = spark.createDataFrame([*rows, (99, [1e12] * 64), (98, [-1e12] * 64), (97, [1e300] * 64)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in H.report(huge, k=1).collect()}
    assert 97 not in got and got[99]["distance"] is None and got[99]["inertia"] is None and len(got) == 42


def test_no_vectors(spark):
    empty = H.report(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert H.report(spark.createDataFrame([(None, [1.0] * 64), (1, None)], SCHEMA)).count() == 0
