"""Physical plan properties the design relies on (checked on the stored table)."""

import pytest

from cairn.plans import adapters as AD
from cairn.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "memories")
    AD.use_stored_memories(SF, AD.materialize_memories(spark, SF, path))
    yield
    AD.use_stored_memories(SF, None)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_search_plan(spark, stored, monkeypatch):
    from cairn.operators import search as SR
    acc = spark.sparkContext.accumulator(0)
    orig = SR._broadcast_kernel

    def counting(bc):
        run = orig(bc)

        def wrapped(batches):
            acc.add(1)
            yield from run(batches)
        return wrapped
    monkeypatch.setattr(SR, "_broadcast_kernel", counting)
    df = catalog.QUERIES["c1_search"](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    # one kernel task per scan partition: the search runs once
    assert acc.value == spark.read.parquet(AD._STORED[SF]).rdd.getNumPartitions()
    # the distance cut is a literal-bounded window group limit
    assert "WindowGroupLimit" in _optimized(df)
    plan = _plan(df)
    # alive filter pushed to the scan
    assert "PushedFilters: [Or(IsNull(expires_at)" in plan
    # texts are read only for the hits, and no broadcast of them is forced
    assert "ReadSchema: struct<id:string,title:string,content:string,summary:string>" in plan
    assert "broadcast" not in str(df._jdf.queryExecution().logical()).lower().split("join inner")[0]


def test_list_plan_prunes_columns_and_limits_early(spark, stored):
    df = catalog.QUERIES["c4_list"](spark, SF)
    plan = _plan(df)
    assert "embedding" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert "WindowGroupLimit" in _optimized(df)


def test_maintenance_aggregates_are_partial(spark, stored):
    df = catalog.QUERIES["m2_update"](spark, SF)
    plan = _plan(df)
    # patches are aggregated per note below the exchange, before any join
    lines = plan.split("\n")
    partial = [i for i, x in enumerate(lines) if "partial_max_by(title" in x]
    assert partial
    for i in partial:
        below = [x for x in lines[i + 1:] if x.strip()]
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
        own = []
        for x in below:
            if len(x) - len(x.lstrip(" :+-")) <= depth:
                break
            own.append(x)
        assert not any("Exchange" in x for x in own[:1])


@pytest.fixture
def filtered(spark):
    """Lookups as on a table too large to shuffle."""
    from cairn.operators import maintain as M
    spark.conf.set(M.FILTER_BYTES_CONF, "0")
    yield
    spark.conf.unset(M.FILTER_BYTES_CONF)


def _depths(plan):
    return [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.split("\n") if x.strip()]


def _no_text_in_aggregates(plan):
    for line in plan.split("\n"):
        if "Aggregate(" in line:
            assert "content" not in line, line


@pytest.mark.parametrize("name", ["c3_recall", "j2_lookup_by_title"])
def test_lookups_read_texts_for_the_last_join_only(spark, stored, filtered, name):
    df = catalog.QUERIES[name](spark, SF)
    plan = _plan(df)
    _no_text_in_aggregates(plan)
    joins = [x for x in plan.split("\n") if "Join" in x and "LeftSemi" not in x]
    carrying = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert joins and carrying
    # the scan that reads the notes' columns stands behind the filter of requested ids
    lines = _depths(plan)
    wide = [i for i, (_, x) in enumerate(lines) if "ReadSchema" in x and ("content" in x if name == "c3_recall" else "updated_at" in x) and "memories" in x]
    assert wide
    semi = [i for i, (_, x) in enumerate(lines) if "LeftSemi" in x]
    assert semi and any(i < wide[-1] for i in semi)


def test_filtered_lookups_give_the_same_rows(spark, stored):
    from cairn.operators import maintain as M
    names = ["c3_recall", "j1_lookup_by_id", "j2_lookup_by_title", "m5_bump_access"]
    rows = lambda: [sorted(map(str, catalog.QUERIES[n](spark, SF).collect())) for n in names]
    plain = rows()
    spark.conf.set(M.FILTER_BYTES_CONF, "0")
    old, M.LOOKUP_SLOTS = M.LOOKUP_SLOTS, 8  # most rows pass by chance
    try:
        assert rows() == plain
    finally:
        M.LOOKUP_SLOTS = old
        spark.conf.unset(M.FILTER_BYTES_CONF)


def test_digest_scans_the_notes_once_for_keys_and_once_for_texts(spark, stored):
    plan = catalog.QUERIES["c6_session_digest"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    read = [x.split("ReadSchema")[1] for x in plan.split("\n") if "FileScan" in x]
    assert sum("content" in x for x in read) == 1 and sum("priority" in x for x in read) == 1
    assert sum("props" in x for x in read) == 1  # the session log is replayed once
