"""Maintenance edge cases on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from cairn import schema as S
from cairn.functions import text as X
from cairn.operators import maintain as M
from cairn.sources import tables as TB

AS_OF = dt.datetime(2024, 1, 31)
PATCH = ("project string, id string, title string, content string, tags array<string>, metadata string, "
         "status string, priority int, related_ids array<string>, op_seq long")


def _ts():
    return F.lit(AS_OF).cast(S.TS)


def _mem(spark):
    rows = [("p", "a", "decision", "Old title", "Old content. More.", "s", ["t"], None, None, "active", 0,
             "assistant", [], [], 0, None, AS_OF, AS_OF),
            ("p", "b", "decision", "B title", "B content", "s", None, None, None, "active", 0,
             "assistant", [], [], 0, None, AS_OF, AS_OF)]
    return spark.createDataFrame(rows, S.MEMORIES)


def test_update_rules(spark):
    patches = spark.createDataFrame([
        ("p", "a", "", None, None, None, None, None, None, 1),                 # empty title: derive from old (Q10)
        ("p", "a", None, None, [], "{}", "weird", None, None, 2),              # clear tags, {} metadata (Q12)
        ("p", "b", None, None, None, None, None, None, None, 3),               # empty patch
        ("p", "zz", "x", None, None, None, None, None, None, 4),               # unknown id
    ], PATCH)
    out, trail, rej = M.update(_mem(spark), patches, _ts())
    a = out.filter("id = 'a'").first()
    assert a.title == "" and a.tags == [] and a.metadata == "{}" and a.status == "weird"
    want = spark.createDataFrame([("Old title", "Old content. More.")], "t string, c string").select(
        X.summary("t", "c"), X.entities("t", "c")).first()
    assert a.summary == want[0] and a.entities == want[1]
    assert sorted(r.reason for r in rej.collect()) == ["Memory 'zz' not found", "No fields to update"]
    assert sorted(r.details for r in trail.collect()) == [
        '{"changed_fields":["tags","metadata","status"]}', '{"changed_fields":["title"]}']


def test_update_later_patch_wins_and_derives_from_stored(spark):
    patches = spark.createDataFrame([
        ("p", "a", "New", None, None, None, None, None, None, 1),
        ("p", "a", None, "Fresh body words here now ok", None, None, None, None, None, 2),
        ("p", "a", "Newest", None, None, None, None, 7, None, 3),
    ], PATCH)
    out, _, _ = M.update(_mem(spark), patches, _ts())
    a = out.first()
    assert (a.title, a.content, a.priority) == ("Newest", "Fresh body words here now ok", 7)
    assert a.summary == "Fresh body words here now ok" and a.updated_at == AS_OF


def test_deletes(spark):
    mem = _mem(spark)
    ids = spark.createDataFrame([("p", "a", "why", 1), ("p", "q", None, 2)],
                                "project string, id string, reason string, op_seq long")
    state, trail, rej = M.soft_delete(mem, ids, _ts())
    assert state.filter("id = 'a'").first().status == "archived"
    assert trail.first().details == '{"reason":"why"}' and rej.first().id == "q"
    state, trail, rej = M.hard_delete(mem, ids, _ts())
    assert [r.id for r in state.collect()] == ["b"] and trail.count() == 1


def test_emptied_project_partition_removed(spark, tmpdir_path):
    path = f"{tmpdir_path}/memories"
    TB.append_memories(_mem(spark).drop("access_count"), path, _ts())
    mem = TB.read_memories(spark, path)
    ids = mem.select("project", "id", F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("op_seq"))
    state, _, _ = M.hard_delete(mem, ids, _ts())
    assert state.count() == 0
    TB.overwrite_projects(state, path)
    TB.drop_project_partitions(spark, path, ["p"])
    assert TB.read_memories(spark, path).count() == 0


def test_upgrade_v1_idempotent(spark):
    v1 = _mem(spark).select(*[f.name for f in S.MEMORIES_V1.fields])
    up = TB.upgrade_v1(v1)
    assert up.columns == [f.name for f in S.MEMORIES.fields]
    assert up.filter(F.col("summary").isNotNull() | F.col("entities").isNotNull()).count() == 0
    assert TB.upgrade_v1(_mem(spark)).filter(F.col("summary").isNotNull()).count() == 2


def test_upsert_projects(spark):
    reg = spark.createDataFrame([("my-app", "Old", "d", AS_OF, AS_OF, "x")], S.PROJECTS)
    batch = spark.createDataFrame([("my-app", "New", None, 1), ("My_App2", "Two", "e", 2)],
                                  "slug string, display_name string, description string, op_seq long")
    later = AS_OF + dt.timedelta(days=1)
    out = {r.slug: r for r in M.upsert_projects(reg, batch, F.lit(later).cast(S.TS)).collect()}
    assert out["my-app"].display_name == "New" and out["my-app"].description is None
    assert out["my-app"].last_accessed == later and out["myapp2"].created_at == later


def test_update_empty_title_after_earlier_title_patch(spark):
    """Q10 across calls: 'A' then '' -> the second call derives from 'A'
    (the value stored just before it), while '' is what is stored."""
    patches = spark.createDataFrame([
        ("p", "a", "A", None, None, None, None, None, None, 1),
        ("p", "a", "", None, None, None, None, None, None, 2),
    ], PATCH)
    out, _, _ = M.update(_mem(spark), patches, _ts())
    a = out.first()
    assert a.title == "" and a.summary == "A: Old content"


def test_second_hard_delete_of_a_note_finds_nothing(spark):
    ids = spark.createDataFrame([("p", "a", "why", 2), ("p", "a", "again", 5), ("p", "zz", None, 3)], "project string, id string, reason string, op_seq long")
    state, trail, rej = M.hard_delete(_mem(spark), ids, _ts())
    assert [r.id for r in state.collect()] == ["b"]
    assert [(r.memory_id, r.op_seq) for r in trail.collect()] == [("a", 2)]
    assert sorted((r.id, r.op_seq, r.reason) for r in rej.collect()) == [("a", 5, "Memory 'a' not found"), ("zz", 3, "Memory 'zz' not found")]


def test_trail_keeps_projects_apart(spark):
    p = spark.createDataFrame([("p", "a", "create", None, AS_OF, 1), ("q", "a", "create", None, AS_OF, 2), ("p", "a", "update", None, AS_OF, 3)],
                              "project string, memory_id string, operation string, details string, created_at timestamp_ntz, op_seq long")
    got = sorted((r.project, r.position, r.total) for r in M.trail(p).collect())
    assert got == [("p", 1, 2), ("p", 2, 2), ("q", 1, 1)]
    ids = spark.createDataFrame([("q", "a")], "project string, id string")
    assert [(r.project, r.total) for r in M.trail(p, ids).collect()] == [("q", 1)]


def test_recall_answers_with_the_whole_note(spark):
    req = spark.createDataFrame([(1, "p", "a", None, 1), (2, "p", None, "B title", 2), (3, "p", "zz", None, 3)], "request_id long, project string, id string, title string, op_seq long")
    got = {r.request_id: r for r in M.recall(_mem(spark), req, _ts())[0].collect()}
    assert got[1].content == "Old content. More." and got[1].tags == ["t"] and got[2].content == "B content" and got[3].content is None
