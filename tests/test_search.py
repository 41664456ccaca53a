"""Search: budget fold, re-rank ties, status/expiry rules, strategy equality."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.operators import search as SR
from cairn.plans import adapters as AD

AS_OF = dt.datetime(2024, 1, 31)
SF = "/root/testdata/sf0.001"


def _ts(spark):
    return F.lit(AS_OF).cast(S.TS)


def test_budget_fold_greedy_with_skip(spark):
    rows = [(1, r, t, 100) for r, t in enumerate([50, 60, 10, 40, 5], start=1)]
    df = spark.createDataFrame(rows, "g long, rank int, tokens int, budget long")
    out = SR.budget_fold(df, "g", "rank", "tokens", "budget", []).orderBy("rank").collect()
    assert [r["fits"] for r in out] == [True, False, True, True, False]
    assert {r["tokens_used"] for r in out} == {100}
    assert all(r["has_more"] for r in out)


def _mem_rows(spark, rows):
    return spark.createDataFrame(rows, S.MEMORIES)


def _note(project, id_, vec, status="active", expires=None, updated=AS_OF, access=0, category="decision",
          tags=None, content="c"):
    return (project, id_, category, f"t{id_}", content, "s", tags, None, vec, status, 0, "assistant", [], [],
            access, expires, updated, updated)


def _queries(spark, rows):
    return spark.createDataFrame(rows, S.SEARCH_QUERIES)


def test_expired_status_search_finds_only_alive(spark):
    """Q5: search applies the expiry predicate for every status."""
    mem = _mem_rows(spark, [
        _note("p", "a", [1.0, 0.0], status="expired", expires=AS_OF - dt.timedelta(days=1)),
        _note("p", "b", [1.0, 0.1], status="expired", expires=None),
        _note("p", "c", [1.0, 0.2], status="active", expires=AS_OF),          # expires_at = as_of: not alive
    ])
    q = _queries(spark, [(1, "p", [1.0, 0.0], None, None, "expired", 5, -1.0, None)])
    got = SR.search(q, mem, _ts(spark)).select("id").collect()
    assert [r.id for r in got] == ["b"]


def test_rerank_ties_keep_distance_then_id(spark):
    mem = _mem_rows(spark, [
        _note("p", "b", [1.0, 0.0]), _note("p", "a", [1.0, 0.0]), _note("p", "c", [0.9, 0.1]),
    ])
    q = _queries(spark, [(1, "p", [1.0, 0.0], None, None, "active", 3, -1.0, None)])
    got = SR.search(q, mem, _ts(spark)).orderBy("rank").select("id").collect()
    assert [r.id for r in got] == ["a", "b", "c"]


def test_category_and_tag_filters_after_cut(spark):
    """Q2: filters run after the limit*3 cut, so fewer than limit may return."""
    rows = [_note("p", f"n{i}", [1.0, 0.01 * i], category="devops" if i >= 3 else "decision",
                  tags=["x"] if i == 4 else None) for i in range(6)]
    mem = _mem_rows(spark, rows)
    q = _queries(spark, [(1, "p", [1.0, 0.0], "devops", None, "active", 1, -1.0, None),
                         (2, "p", [1.0, 0.0], None, ["x"], "active", 1, -1.0, None)])
    got = {r.query_id: r.id for r in SR.search(q, mem, _ts(spark)).collect()}
    # limit 1 -> cut of 3 (n0..n2): no devops note survives; tag x is n4, cut too.
    assert got == {}


def test_null_and_zero_vectors_excluded(spark):
    mem = _mem_rows(spark, [_note("p", "z", [0.0, 0.0]), _note("p", "n", None), _note("p", "ok", [0.0, 1.0])])
    q = _queries(spark, [(1, "p", [0.0, 1.0], None, None, "active", 5, -1.0, None)])
    assert [r.id for r in SR.search(q, mem, _ts(spark)).collect()] == ["ok"]


def test_strategies_agree_on_test_tables(spark):
    mem = AD.memories(spark, SF)
    qs = AD.search_queries(spark, SF)
    cols = ["query_id", "id", "rank_d"]
    a = SR.candidates(qs, mem, _ts(spark), strategy="broadcast").select(*cols).collect()
    b = SR.candidates(qs, mem, _ts(spark), strategy="blocked", block_rows=37, query_block_rows=11).select(*cols).collect()
    assert sorted(a) == sorted(b) and len(a) > 0


def test_local_topk_ties_by_id():
    q = np.array([[1.0, 0.0]])
    m = np.array([[1.0, 0.0]] * 5)
    ids = np.array(["e", "d", "c", "b", "a"], dtype=object)
    r, mi, d = SR.local_topk(np.array([7]), q, np.array([2]), np.array([-np.inf]), ids, m)
    assert list(ids[mi]) == ["a", "b"]


def test_budgeted_search_keys(spark):
    """The reference test: 'Brief content.' and 2,000 x 'A' with budget 100."""
    mem = _mem_rows(spark, [_note("p", "s", [1.0, 0.0], content="Brief content."),
                            _note("p", "l", [1.0, 0.05], content="A" * 2000)])
    q = _queries(spark, [(1, "p", [1.0, 0.0], None, None, "active", 10, -1.0, 100)])
    out = {r.id: r for r in SR.search_budgeted(q, mem, _ts(spark)).collect()}
    assert out["s"].fits and not out["l"].fits
    assert out["s"].tokens_used == 3 and out["s"].has_more


def test_chunked_topk_equals_single_block():
    rng = np.random.default_rng(7)
    q = rng.normal(size=(37, 8)); q /= np.linalg.norm(q, axis=1, keepdims=True)
    m = rng.normal(size=(301, 8)); m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[50] = m[49]                                            # an exact tie
    ids = np.array([f"n{i:04d}" for i in rng.permutation(301)], dtype=object)
    qid, k, qmin = np.arange(37), np.full(37, 6), np.full(37, -np.inf)
    a = SR.local_topk(qid, q, k, qmin, ids, m)
    b = SR.local_topk_chunked(qid, q, k, qmin, ids, m, q_chunk=5, m_chunk=17)
    key = lambda t: sorted(zip(t[0].tolist(), ids[t[1]].tolist()))
    assert key(a) == key(b)


def test_any_tag_rules(spark):
    from cairn.operators import filters as FL
    df = spark.createDataFrame([("a", None), ("b", []), ("c", ["x"]), ("d", ["y", "x"])], "id string, tags array<string>")
    assert [r.id for r in FL.any_tag(df, ["x"]).orderBy("id").collect()] == ["c", "d"]
    assert FL.any_tag(df, []).count() == 4 and FL.any_tag(df, None).count() == 4


def test_list_expired_status_after_sweep(spark):
    """Q5/Q6: listing sweeps first, and status 'expired' lists them (search would not)."""
    from cairn.operators import listing as L
    mem = _mem_rows(spark, [
        _note("p", "old", [1.0, 0.0], expires=AS_OF - dt.timedelta(days=2)),
        _note("p", "new", [1.0, 0.0], expires=AS_OF + dt.timedelta(days=2)),
        _note("p", "gone", [1.0, 0.0], status="expired", expires=AS_OF - dt.timedelta(days=9))])
    out = L.list_notes(mem, _ts(spark), status="expired", sort_by="title", order="asc").collect()
    assert sorted(r.id for r in out) == ["gone", "old"] and {r.total for r in out} == {2}
    act = L.list_notes(mem, _ts(spark)).collect()
    assert [r.id for r in act] == ["new"]


def test_search_same_hits_under_both_strategies(spark):
    mem = AD.memories(spark, SF)
    qs = AD.search_queries(spark, SF)
    cols = ["query_id", "rank", "id", "similarity", "relevance_score", "title"]
    a = SR.search(qs, mem, _ts(spark)).select(*cols).collect()
    qs2 = AD.search_queries(spark, SF)
    b = SR.search(qs2, mem, _ts(spark), strategy="blocked", block_rows=41, query_block_rows=13).select(*cols).collect()
    assert sorted(a) == sorted(b) and len(a) > 0


def test_second_call_uses_its_own_arguments(spark):
    mem = _mem_rows(spark, [_note("p", f"n{i}", [1.0, 0.01 * i]) for i in range(9)])
    q = _queries(spark, [(1, "p", [1.0, 0.0], None, None, "active", 2, -1.0, None)])
    assert SR.candidates(q, mem, _ts(spark), oversample=1).count() == 2
    assert SR.candidates(q, mem, _ts(spark), oversample=3).count() == 6
    assert SR.choose_strategy(q)[0] == "broadcast"
    assert SR.choose_strategy(q, max_broadcast_bytes=1)[0] == "blocked"


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_vectors_of_several_lengths_in_one_project(spark, strategy):
    mem = _mem_rows(spark, [_note("p", "two", [1.0, 0.0]), _note("p", "three", [1.0, 0.0, 0.0]), _note("p", "four", [1.0] * 4)])
    q = _queries(spark, [(1, "p", [1.0, 0.0], None, None, "active", 5, -1.0, None),
                         (2, "p", [1.0, 0.0, 0.0], None, None, "active", 5, -1.0, None),
                         (3, "p", [1.0] * 5, None, None, "active", 5, -1.0, None)])
    got = {(r.query_id, r.id) for r in SR.candidates(q, mem, _ts(spark), strategy=strategy).collect()}
    assert got == {(1, "two"), (2, "three")}


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_equal_vectors_tie_by_id(spark, strategy):
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(7, 33)).astype(np.float32).tolist()
    mem = _mem_rows(spark, [_note("p", f"{k:02d}{i:03d}", vecs[k]) for i in range(40) for k in range(7)]).repartition(5)
    q = _queries(spark, [(k, "p", v, None, None, "active", 4, -1.0, None) for k, v in enumerate(vecs)])
    got = SR.candidates(q, mem, _ts(spark), strategy=strategy, block_rows=50, query_block_rows=3).collect()
    for k in range(7):
        ids = [r.id for r in sorted(got, key=lambda r: r.rank_d) if r.query_id == k]
        assert ids == [f"{k:02d}{i:03d}" for i in range(12)]


def test_budget_details_carry_the_note(spark):
    mem = _mem_rows(spark, [_note("p", "a", [1.0, 0.0], content="x" * 40), _note("p", "b", [1.0, 0.1], content="y" * 4000)])
    q = _queries(spark, [(1, "p", [1.0, 0.0], None, None, "active", 5, -1.0, 100)])
    got = {r.id: r for r in SR.search_budgeted(q, mem, _ts(spark)).collect()}
    assert got["a"].fits and got["a"].content == "x" * 40 and not got["b"].fits and got["b"].content is None
