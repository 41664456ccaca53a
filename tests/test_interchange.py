"""Markdown tree and snapshots: render/parse rules, export -> import round trip."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.functions import markdown as MD
from cairn.sources import markdown_tree as MT
from cairn.sources import snapshot as SN

AS_OF = dt.datetime(2024, 1, 31)


def _ts():
    return F.lit(AS_OF).cast(S.TS)


def _notes(spark, project, items):
    rows = []
    for i, (cat, title, content) in enumerate(items):
        rows.append((project, f"id{i}", cat, title, content, f"sum {i}", ["a", "b"], None, None, "active", 0,
                     "assistant", [], ["X"], 0, None, AS_OF, AS_OF))
    return spark.createDataFrame(rows, S.MEMORIES)


def _parse(spark, text):
    return MD.parse_df(spark.createDataFrame([(text,)], "t string"), "t", "p").first().p


def test_parse_edge_cases(spark):
    assert _parse(spark, "no front matter") is None
    p = _parse(spark, "---\nid: 1\ntitle: 007\npriority: 2\ntags: [x, y]\n---\n\n# T\n\n> sum\n\nbody\n## Related\n- a\n")
    assert p.id == "1" and p.title == "7" and p.title_is_number and p.priority == 2 and p.tags == ["x", "y"]
    assert p.content == "body"
    p = _parse(spark, '---\ntitle: "a: b"\ntags: []\n---\nfirst\n# T\n\nkeep\n')
    assert p.title == "a: b" and p.tags == [] and p.content == "first\nkeep"
    p = _parse(spark, '---\ntitle: [x]\n---\n# T\nno summary line\n')
    assert p.title_is_list and p.content == "no summary line"
    p = _parse(spark, "---\ntitle: x\n---\n## Related\n- a\n")
    assert p.content == ""
    p = _parse(spark, "---\ntitle: " + "0" * 3 + "9" * 45 + "\npriority: 99999999999999\n---\nb")
    assert p.title == "9" * 45 and p.priority is None and p.priority_not_number


def test_render_then_parse_round_trip(spark):
    df = _notes(spark, "p", [("decision", "Use Redis", "We chose Redis.\nSecond line.")])
    txt = df.select(MD.render_row().alias("t")).first().t
    assert txt.startswith("---\nid: id0\ncategory: decision\ntitle: \"Use Redis\"\nstatus: active\npriority: 0\n")
    assert "tags: [a, b]" in txt and "\n# Use Redis\n\n> sum 0\n\nWe chose Redis.\nSecond line.\n" in txt
    p = _parse(spark, txt)
    assert (p.id, p.title, p.content, p.tags) == ("id0", "Use Redis", "We chose Redis.\nSecond line.", ["a", "b"])


def test_export_layout_and_import_round_trip(spark, tmpdir_path):
    mem = _notes(spark, "src", [("decision", "Use Redis", "Redis for caching."),
                                ("architecture", "Layers", "Three layers."),
                                ("devops", "Deploy", "Docker on AWS.")])
    summary, counts = MT.export(mem, "src", tmpdir_path, _ts())
    assert summary["files"] == 3 and summary["index"].endswith("MEMORY_INDEX.md")
    base = os.path.join(tmpdir_path, ".memory")
    assert sorted(os.listdir(base)) == ["MEMORY_INDEX.md", "architecture", "decision", "devops"]
    assert os.listdir(os.path.join(base, "decision")) == ["use-redis.md"]
    index = open(os.path.join(base, "MEMORY_INDEX.md")).read()
    assert index.startswith("# Memory Index - src\n\nExported: 2024-01-31 00:00\n\nTotal: 3 memories\n")
    assert "| [decision](./decision/) | 1 |" in index and "- [Use Redis](./decision/use-redis.md) - sum 0" in index
    # hidden folder and unknown category folder
    os.makedirs(os.path.join(base, ".hidden"))
    open(os.path.join(base, ".hidden", "x.md"), "w").write("---\ntitle: h\n---\nbody")
    os.makedirs(os.path.join(base, "misc"))
    open(os.path.join(base, "misc", "y.md"), "w").write("---\ntitle: m\n---\nbody")
    target = spark.createDataFrame([], S.MEMORIES)
    created, updated, trail, report, errors = MT.import_tree(target, tmpdir_path, "dst", _ts(), "run")
    r = report.first()
    assert (r.created, r.updated, r.skipped) == (3, 0, 0)
    assert [e.error for e in errors.collect()] == ["Unknown category: misc"]
    assert sorted(x.title for x in created.collect()) == ["Deploy", "Layers", "Use Redis"]
    # Importing into the source itself: same ids, same text -> all skipped.
    _, _, _, r2, _ = MT.import_tree(mem, tmpdir_path, "src", _ts(), "run")
    r2 = r2.first()
    assert (r2.created, r2.updated, r2.skipped) == (0, 0, 3)


def test_no_active_notes_exports_nothing(spark, tmpdir_path):
    mem = _notes(spark, "p", [("decision", "A", "b")]).withColumn("status", F.lit("archived"))
    summary, counts = MT.export(mem, "p", tmpdir_path, _ts())
    assert summary["files"] == 0 and not os.path.exists(os.path.join(tmpdir_path, ".memory"))


def test_snapshot_attach_sync(spark, tmpdir_path):
    mem = _notes(spark, "proj", [("decision", "A", "b")])
    empty = spark.createDataFrame([], S.PROJECTS)
    target = os.path.join(tmpdir_path, "proj-snap")
    with pytest.raises(ValueError, match="not found"):
        SN.snapshot_project({"memories": mem}, empty, "proj", target, _ts())
    reg = spark.createDataFrame([("proj", "Proj", "d", AS_OF, AS_OF, "old")], S.PROJECTS)
    moved = SN.snapshot_project({"memories": mem}, reg, "proj", target, F.lit(AS_OF + dt.timedelta(days=3)).cast(S.TS))
    row = moved.first()
    assert (row.db_path, row.display_name, row.last_accessed) == (target, "Proj", AS_OF)
    assert SN.snapshot_project({"memories": mem}, moved, "proj", target, _ts()).first() == row  # already there
    reg = empty
    reg3, n, err = SN.sync_snapshot(spark, reg, target, _ts())
    assert err is None and n == 1 and reg3.filter("slug = 'proj-snap'").count() == 1
    reg4, created = SN.attach_snapshot(spark, reg, os.path.join(tmpdir_path, "New_Proj"), _ts())
    assert created and (reg4.first().slug, reg4.first().display_name) == ("newproj", "New_Proj")
    named, _ = SN.attach_snapshot(spark, reg, os.path.join(tmpdir_path, "New_Proj"), _ts(), display_name="N", description="D")
    assert (named.first().display_name, named.first().description) == ("N", "D")
    _, _, err = SN.sync_snapshot(spark, reg, os.path.join(tmpdir_path, "missing"), _ts())
    assert err is not None


def test_project_info(spark):
    reg = spark.createDataFrame([
        ("a", "A", None, AS_OF, AS_OF, "x"),
        ("b", "B", "d", AS_OF, AS_OF + dt.timedelta(days=1), "y")], S.PROJECTS)
    assert [r.slug for r in SN.project_info(reg).collect()] == ["b", "a"]
    assert SN.project_info(reg, "a").first().display_name == "A"
    assert SN.project_info(reg, "zz").count() == 0


def test_parse_without_heading_and_empty_content_skipped(spark, tmpdir_path):
    p = _parse(spark, "---\ntitle: t\n---\n\nline one\n> kept quote\n")
    assert p.content == "line one\n> kept quote"
    base = os.path.join(tmpdir_path, ".memory", "decision")
    os.makedirs(base)
    open(os.path.join(base, "empty.md"), "w").write("---\ntitle: e\n---\n# e\n\n")
    open(os.path.join(base, "full.md"), "w").write("---\nsource: x\n---\nbody only\n")
    # an empty front matter block does not match the file pattern: parse error
    open(os.path.join(base, "bad.md"), "w").write("---\n---\nbody\n")
    target = spark.createDataFrame([], S.MEMORIES)
    created, _, _, report, errors = MT.import_tree(target, tmpdir_path, "p", _ts(), "run")
    r = report.first()
    assert (r.created, r.skipped) == (1, 1)
    assert [e.error for e in errors.collect()] == ["Failed to parse: bad.md"]
    assert created.first().title == "full"            # title defaults to the file stem


def test_import_of_fields_that_are_no_text(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, ".memory", "decision")
    os.makedirs(base)
    files = {"meta.md": '---\ntitle: m\nmetadata: "{\\"a\\": 1}"\n---\n# m\n\nbody\n',
             "prio.md": "---\ntitle: p\npriority: high\n---\n# p\n\nbody\n",
             "num.md": "---\nid: n1\ntitle: 123\n---\n# 123\n\nsame\n"}
    for name, text in files.items():
        with open(os.path.join(base, name), "w") as f:
            f.write(text)
    mem = _notes(spark, "p", [("decision", "123", "same")]).withColumn("id", F.lit("n1"))
    created, updated, _, report, errors = MT.import_tree(mem, tmpdir_path, "p", _ts(), run_id="one")
    r = report.first()
    assert (r.created, r.updated, r.skipped, r.error) == (1, 1, 0, 1)  # a number never equals the stored text
    assert [e.error for e in errors.collect()] == ["Insert p: priority is not a number"]
    note = created.first()
    assert json.loads(json.loads(note.metadata).replace('\\"', '"')) == {"a": 1}
    again = MT.import_tree(mem, tmpdir_path, "p", _ts(), run_id="two")[0].first()
    assert again.id != note.id
    assert MT.import_tree(mem, tmpdir_path, "p", _ts(), run_id="one")[0].first().id == note.id
