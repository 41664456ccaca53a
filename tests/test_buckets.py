"""Bucketed note tables: no note is shuffled by a rewrite, generations are safe."""

import os

import pytest
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.operators import listing as L
from cairn.operators import maintain as M
from cairn.plans import adapters as AD
from cairn.sources.buckets import NoteTable

SF = "/root/testdata/sf0.001"

REWRITES = {
    "m2": lambda sp, m: M.merged(m, M.update(m, AD.patches(sp, SF), S.AS_OF)[0]),
    "m3": lambda sp, m: M.soft_delete(m, AD.soft_delete_ids(sp, SF), S.AS_OF)[0],
    "m4": lambda sp, m: M.hard_delete(m, AD.hard_delete_ids(sp, SF), S.AS_OF)[0],
    "m5": lambda sp, m: M.bump_access(m, AD.soft_delete_ids(sp, SF)),
    "m6": lambda sp, m: L.sweep_expired(m, F.lit(S.AS_OF).cast(S.TS)),
}


@pytest.fixture
def table(spark, tmpdir_path):
    t = NoteTable(spark, f"{tmpdir_path}/notes", buckets=8)
    t.commit(AD.memories(spark, SF))
    return t


def _above_wide_scans(plan):
    """Operators above each scan that reads vectors, innermost first."""
    lines = [x for x in plan.split("\n") if x.strip()]
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "FileScan" in x and "embedding#" in x:
            d, above = depth[i], []
            for j in range(i - 1, -1, -1):
                if depth[j] < d:
                    above.append(lines[j].strip(" :+-").split()[0])
                    d = depth[j]
            yield x, above


@pytest.mark.parametrize("broadcast", ["100k", "-1"])
@pytest.mark.parametrize("name", list(REWRITES))
def test_no_exchange_on_the_note_side(spark, table, name, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        state = REWRITES[name](spark, table.read())
        with table.by_bucket():
            scans = list(_above_wide_scans(table.rows(state)._jdf.queryExecution().executedPlan().toString()))
        assert scans
        for scan, above in scans:
            assert "Bucketed: true" in scan and "Exchange" not in above, above
        g = table.commit(state)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    parts = [f for f in os.listdir(f"{table.path}/generation-{g}") if f.startswith("part-")]
    assert len(parts) <= 8  # a file a bucket
    want = REWRITES[name](spark, AD.memories(spark, SF))
    cols = ["project", "id", "title", "content", "summary", "status", "access_count", "updated_at"]
    assert sorted(map(str, table.read().select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_generations(spark, table):
    old = table.read()
    assert table.generation() == 1 and NoteTable(spark, f"{table.path}x").read().count() == 0
    assert table.commit(table.read().filter("project = 'p1'"), after=1) == 2
    with pytest.raises(RuntimeError, match="no longer current"):
        table.commit(old, after=1)
    assert table.generation() == 2 and old.count() == 200  # readers of the old generation go on
    os.makedirs(f"{table.path}/generation-3")
    with open(f"{table.path}/generation-3/part-0.parquet", "w") as f:
        f.write("left by a write that did not end")
    assert table.commit(table.read().filter("status = 'active'")) == 3
    assert sorted(x for x in os.listdir(table.path) if not x.startswith(".")) == ["current-2", "current-3", "generation-2", "generation-3"]
    assert table.read(2).count() == 50 and {r[0] for r in table.read().select("project").distinct().collect()} == {"p1"}


def test_a_table_written_by_another_session(spark, table):
    n = table.read().count()
    spark.sql(f"DROP TABLE {table._name(1)}")
    again = NoteTable(spark, table.path, buckets=8)
    assert again.read().count() == n
    state = M.bump_access(again.read(), AD.soft_delete_ids(spark, SF))
    with again.by_bucket():
        plan = again.rows(state)._jdf.queryExecution().executedPlan().toString()
    assert all("Exchange" not in above for _, above in _above_wide_scans(plan))


def test_merged_keeps_untouched_rows_and_new_nulls(spark):
    mem = AD.memories(spark, SF)
    touched = mem.filter("project = 'p0'").withColumn("summary", F.lit(None).cast("string"))
    got = M.merged(mem, touched)
    assert got.columns == mem.columns and got.count() == mem.count()
    assert got.filter("summary is null").count() == got.filter("project = 'p0'").count()
    assert M.merged(mem, mem.limit(0)).exceptAll(mem).count() == 0
