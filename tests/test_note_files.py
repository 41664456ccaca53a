"""The note_files data source and the tree operations over it."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.sources import markdown_tree as MT
from cairn.sources import note_files as NF

AS_OF = dt.datetime(2024, 1, 31)
TS = AS_OF  # an instant or a column


def _write(base, files):
    for rel, data in files.items():
        path = os.path.join(base, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())


def _notes(spark, rows):
    return spark.createDataFrame([(p, i, c, t, x, s, ["a"], None, None, st, 0, "user", [], [], 0, None, AS_OF, AS_OF) for p, i, c, t, x, s, st in rows], S.MEMORIES)


def test_every_kind_of_entry(spark, tmpdir_path):
    front = "---\ntitle: t\n---\nbody"
    _write(f"{tmpdir_path}/a/.memory", {"decision/one.md": front, "decision/.dot.md": front, "decision/two.txt": front, "decision/deep/x.md": front,
                                        "decision/bad.md": b"---\ntitle: \xff\n---\n", "decision/crlf.md": b"---\r\ntitle: w\r\n---\r\nl1\r\nl2\rl3", "sprint/dir.md/x": front,
                                        ".hidden/h.md": front, "top.md": front, "misc/note": front, "empty/.keep": ""})
    rows = MT.read_trees(spark, {"a": f"{tmpdir_path}/a", "b": f"{tmpdir_path}/b"}, split_bytes=100).collect()
    files = {(r["category"], r["stem"]): r["text"] for r in rows if r["path"] and not r["error"]}
    assert files == {("decision", "one"): front, ("decision", ".dot"): front, ("decision", "crlf"): "---\ntitle: w\n---\nl1\nl2\nl3"}
    assert sorted(r["error"] for r in rows if r["error"]) == sorted([
        "Unknown category: misc", "Unknown category: empty", "dir.md: is a directory", "bad.md: not UTF-8 at byte 11",
        f"No .memory directory found at file:{tmpdir_path}/b"])
    assert all(r["project"] == ("b" if "No .memory" in (r["error"] or "") else "a") for r in rows)


def test_text_source_gives_the_same_files(spark, tmpdir_path):
    _write(f"{tmpdir_path}/.memory", {"decision/one.md": "x\r\ny", "decision/a b%20é.md": "z", "misc/m.md": "q"})
    a = MT.read_markdown_tree(spark, tmpdir_path, "p").select("project", "category", "stem", "text", "error")
    b = MT._text_tree(spark, f"file:{tmpdir_path}", "p").select("project", "category", "stem", "text", "error")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert MT._text_tree(spark, f"file:{tmpdir_path}/none", "p").count() == 0


def test_partitions_follow_the_size(spark, tmpdir_path):
    _write(f"{tmpdir_path}/.memory", {f"decision/n{i}.md": "x" * 1000 for i in range(40)})
    load = lambda n: MT.read_trees(spark, {"p": tmpdir_path}, n)
    assert load(1 << 30).rdd.getNumPartitions() == 1
    assert load(10 * (NF.OPEN_COST + 1000)).rdd.getNumPartitions() == 4
    assert load(1).count() == 40


def test_a_file_appears_whole_or_not_at_all(tmpdir_path):
    fs, _ = NF.file_system(tmpdir_path)
    NF.put(fs, f"{tmpdir_path}/a.md", b"first", "1")
    NF.put(fs, f"{tmpdir_path}/a.md", b"again", "2")
    assert open(f"{tmpdir_path}/a.md").read() == "again"

    class Broken:
        type_name = "local"

        def __getattr__(self, name):
            if name == "move":
                raise OSError("gone")
            return getattr(fs, name)

    with pytest.raises(OSError):
        NF.put(Broken(), f"{tmpdir_path}/a.md", b"half", "3")
    assert os.listdir(tmpdir_path) == ["a.md"] and open(f"{tmpdir_path}/a.md").read() == "again"


def test_a_failed_job_leaves_nothing_behind(spark, tmpdir_path):
    NF.register(spark)
    ok = spark.range(40).select(F.concat(F.lit("p/.memory/decision/n"), F.col("id").cast("string"), F.lit(".md")).alias("rel"), F.lit("body").alias("body"))
    bad = ok.repartition(4).withColumn("body", F.when(F.col("rel").contains("n17."), F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("note_files").mode("append").save(tmpdir_path)
    assert [f for _, _, fs in os.walk(tmpdir_path) for f in fs] == []
    ok.write.format("note_files").mode("append").save(tmpdir_path)
    assert sorted(os.listdir(tmpdir_path)) == ["p"] and len(os.listdir(f"{tmpdir_path}/p/.memory/decision")) == 40


def _index(notes, project):
    """The index document written out."""
    own = [n for n in notes if n[0] == project and n[6] == "active"]
    cats = sorted({n[2] for n in own})
    out = [f"# Memory Index - {project}", "", "Exported: 2024-01-31 00:00", "", f"Total: {len(own)} memories", "", "## Categories", "", "| Category | Count |", "|----------|-------|"]
    out += [f"| [{c}](./{c}/) | {sum(n[2] == c for n in own)} |" for c in cats] + [""]
    for c in cats:
        out += [f"## {c}", ""]
        out += [f"- [{n[3]}](./{c}/{n[3].lower().replace(' ', '-')}.md) - {n[5]}" for n in sorted((n for n in own if n[2] == c), key=lambda n: (n[3], n[1]))] + [""]
    return "\n".join(out)


def test_trees_and_indexes_of_many_projects(spark, tmpdir_path):
    notes = [(f"p{i % 3}", f"id{i:03}", ("decision", "sprint", "devops")[i % 7 % 3], f"Note é {i % 50}", f"text {i}", "sum\nmary" if i % 9 == 0 else f"s{i}" if i % 5 else None, "active" if i % 4 else "archived") for i in range(120)]
    notes += [("gone", "g", "decision", "t", "x", "s", "archived")]
    df = _notes(spark, notes).repartition(7)
    counts, roots, totals = MT.export_trees(df, tmpdir_path, TS)
    assert set(roots) == {"p0", "p1", "p2"} and sorted(os.listdir(tmpdir_path)) == ["p0", "p1", "p2"]
    active = [n for n in notes if n[6] == "active"]
    files = {(n[0], n[2], n[3]) for n in active}
    assert totals["files"] == len(files) and sum(r["exported"] for r in counts.collect()) == len(active)
    on_disk = [os.path.join(d, f) for d, _, fs in os.walk(tmpdir_path) for f in fs]
    assert len(on_disk) == len(files) + 3 and sum(os.path.getsize(f) for f in on_disk if not f.endswith(S.EXPORT_INDEX_NAME)) == totals["bytes"]
    for p in roots:
        path = f"{tmpdir_path}/{p}/.memory/{S.EXPORT_INDEX_NAME}"
        want = _index([(*n[:3], n[3].replace(" é", " é"), *n[4:]) for n in notes], p).replace("-é-", "-")
        assert open(path, encoding="utf-8").read() == want.replace("note-é", "note")
        for split in (13, 200, 1 << 20):
            lines = sorted((r["at"], r["line"]) for r in MT.read_indexes(spark, {p: roots[p]}, split).collect()) if split > 13 or p == "p0" else None
            if lines is not None:
                assert "\n".join(x for _, x in lines) == open(path, encoding="utf-8").read()
                assert all(a + len(x.encode()) + 1 == b for (a, x), (b, _) in zip(lines, lines[1:]))
    again = MT.import_trees(df, roots, TS, "run")[3].collect()
    assert all(r["created"] == 0 and r["error"] == 0 for r in again)


def test_index_of_one_project_without_shuffle_luck(spark, tmpdir_path):
    notes = [("p", f"{i:05}", "decision", f"T {i:05}", "x", "s", "active") for i in range(2000)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts of one document
    try:
        paths = MT.write_indexes(_notes(spark, notes), {"p": tmpdir_path}, TS)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert open(paths["p"]).read() == _index(notes, "p")
    assert os.listdir(f"{tmpdir_path}/.memory") == [S.EXPORT_INDEX_NAME]


def test_tags_that_are_no_list_are_errors(spark, tmpdir_path):
    head = "---\n{}title: {}\ntags: {}\n---\nbody"
    _write(f"{tmpdir_path}/.memory/decision", {
        "a.md": head.format("", "a", "plain"), "b.md": head.format("", "b", "5"), "c.md": head.format("", "c", "0"), "d.md": head.format("", "d", ""),
        "e.md": head.format("", "e", "[x, y]"), "f.md": head.format("id: i1\n", "f", "plain"), "g.md": head.format("id: i2\n", "same", "plain")})
    mem = _notes(spark, [("p", "i1", "decision", "old", "old", "s", "active"), ("p", "i2", "decision", "same", "body", "s", "active")])
    created, updated, _, report, errors = MT.import_tree(mem, tmpdir_path, "p", TS, "run")
    assert {r["title"]: r["tags"] for r in created.collect()} == {"c": [], "d": [], "e": ["x", "y"]}
    assert updated.count() == 0 and sorted(r["error"] for r in errors.collect()) == ["Insert a: tags are no list", "Insert b: tags are no list", "Update i1: tags are no list"]
    r = report.first()
    assert (r["created"], r["updated"], r["skipped"], r["error"]) == (3, 0, 1, 3)  # an unchanged note is skipped whatever its tags


def test_no_note_and_no_root(spark, tmpdir_path):
    counts, roots, totals = MT.export_trees(_notes(spark, [("p", "i", "decision", "t", "x", "s", "archived")]), tmpdir_path, TS)
    assert (counts.count(), roots, totals) == (0, {}, {"files": 0, "bytes": 0, "index": {}}) and os.listdir(tmpdir_path) == []
    created, updated, _, report, errors = MT.import_tree(_notes(spark, [("p", "i", "decision", "t", "x", "s", "active")]), tmpdir_path, "p", TS, "run")
    assert created.count() == updated.count() == 0 and "No .memory directory" in errors.first()["error"]




def test_note_files_are_counted_where_tasks_run(spark, tmpdir_path, monkeypatch):
    _write(f"{tmpdir_path}/a/.memory", {"decision/one.md": "12345", "decision/\u00fc.md": "\u00fc", "decision/_b.md": "x", "decision/.two.md.7": "x", "decision/two.txt": "x",
                                        "rule/c.md": "123", "MEMORY_INDEX.md": "x", ".write-1/1": "x", "empty/.keep": ""})
    _write(f"{tmpdir_path}/b/.memory", {"rule/d.md": ""})
    with monkeypatch.context() as m:
        m.setattr(NF, "sizes", lambda *a: pytest.fail("a list of files on the driver"))
        got = MT.count_files(spark, {p: f"{tmpdir_path}/{p}" for p in "abc"}).collect()
    assert {tuple(r) for r in got} == {("a", "decision", 2, 7), ("a", "rule", 1, 3), ("b", "rule", 1, 0)}
    assert MT.count_files(spark, {"c": f"{tmpdir_path}/c"}).count() == 0


def test_export_leaves_no_list_of_files_to_the_driver():
    import inspect

    from cairn.plans import flows
    assert "count_files" in inspect.getsource(flows.c8_export) and "binaryFile" not in inspect.getsource(flows.c8_export)
