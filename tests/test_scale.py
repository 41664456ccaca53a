"""Work that was repeated, or grew faster than its input."""

import datetime as dt
import json
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.plans import adapters as AD
from cairn.sources import markdown_tree as MT
from cairn.streaming import session_calls as SC

AS_OF = dt.datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame([("p", f"n{i}", "decision", f"Title {i}", f"Text {i}", "s", [], None, None, "active", 0, "user", [], [], 0, None, AS_OF, AS_OF) for i in range(300)], S.MEMORIES)


def test_small_files_share_tasks(spark, notes, tmp_path):
    """a task's share of a tree is measured by what its files hold."""
    _, roots, _ = MT.export_trees(notes, str(tmp_path), AS_OF)
    rows = MT.read_trees(spark, roots, split_bytes=4 << 20)
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 300


def test_an_import_reads_the_trees_once(spark, notes, tmp_path):
    """what follows reads the classified files, not the trees."""
    _, roots, _ = MT.export_trees(notes, str(tmp_path / "t"), AS_OF)
    (tmp_path / "t/p/.memory/misc").mkdir()
    known = notes.withColumn("content", F.when(F.col("id") == "n7", "other").otherwise(F.col("content"))).filter("id <> 'n9'")
    created, updated, trail, report, errors = MT.import_trees(known, roots, AS_OF, "run")
    shutil.rmtree(tmp_path / "t")
    assert [r["title"] for r in created.collect()] == ["Title 9"]
    assert [r["id"] for r in updated.collect()] == ["n7"] and trail.count() == 2
    assert [r["error"] for r in errors.collect()] == ["Unknown category: misc"]
    assert [tuple(r) for r in report.select("created", "updated", "skipped", "error").collect()] == [(1, 1, 298, 1)]


class _Map(dict):
    def __init__(self):
        self.written = 0

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self.written += len(v[0]) if isinstance(v[0], str) else 8
        self[k] = v

    def removeKey(self, k):
        del self[k]


class _Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, _Map())

    def getValueState(self, *_):
        class Value:
            v = None
            exists = lambda self: self.v is not None
            get = lambda self: self.v

            def update(self, v):
                self.v = v

            def clear(self):
                self.v = None
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_slots_calls_are_written_once_however_many_chunks():
    """chunks add to a slot without rewriting what it holds."""
    handle, calls = _Handle(), SC.SessionCalls()
    calls.init(handle)
    chunks = [pd.DataFrame({"us": [1_000_000 + 10 * k], "seq": [k], "kind": ["start"], "session_id": [f"s{k}"], "summary": [None], "memories_created": [None], "memories_accessed": [None]}) for k in (5, 3, 1, 4, 2, 0, *range(6, 200))]
    for at in range(0, 200, 20):  # micro-batches
        list(calls.handleInputRows(("p",), iter(chunks[at : at + 20]), None))
    size = sum(len(json.dumps([1_000_000, 100, "start", "s100", None, 0, 0])) + 12 for _ in chunks)
    assert sum(m.written for m in handle.maps.values()) <= size
    assert handle.timers == [SC.SLOT_MS]

    class Due:
        def getExpiryTimeInMs(self):
            return SC.SLOT_MS
    out = pd.concat(calls.handleExpiredTimer(("p",), None, Due()))
    assert out[out["kind"] == "start"]["id"].tolist() == [f"s{k}" for k in range(200)]
    assert len(out) == 399 and not any(handle.maps.values())


def test_recall_requests_join_titles_not_texts(spark, tmp_path):
    """F8: texts are cut to titles before they are shuffled."""
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, "click"), (2, 9, "click"), (3, 2, "view"), (4, 3, "error")], "event_id long, user_id long, event_type string").write.parquet(f"{sf}/events.parquet")
    spark.createDataFrame([(1, "a b  c d e f g h"), (2, "x"), (3, None)], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    df = AD.recall_requests(spark, sf)
    assert sorted((r["request_id"], r["id"], r["title"]) for r in df.collect()) == [(1, None, "a b c d e f"), (2, None, None), (3, "2", None), (4, None, None)]
    below = df._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1]
    assert "_title" in below.splitlines()[0] or "AS _title" in below
