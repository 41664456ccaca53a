"""Streaming jobs replayed from files equal the batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.operators import maintain as M
from cairn.operators import sessions as SE
from cairn.plans import adapters as AD
from cairn.streaming import jobs as J
from cairn.streaming import session_calls as SC

SF = "/root/testdata/sf0.001"
COLS = ["project", "id", "started_at", "ended_at", "summary", "memories_created", "memories_accessed"]


def _split_write(df, path, n=3, mode="overwrite"):
    """Write ``df`` as ``n`` files so the stream sees several files."""
    df.repartition(n).write.mode(mode).parquet(path)


def _run(query):
    query.awaitTermination(300)
    assert query.exception() is None and not query.isActive
    return query


# ------------------------------------------------------------------ R3

def _sessions(spark, out):
    return sorted(map(str, SC.sessions_from_updates(spark.read.schema(SC.SESSION_UPDATE).parquet(out)).select(*COLS).collect()))


def _calls(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(p, s, t0 + dt.timedelta(minutes=m) if m is not None else None, k, i, x, a, b) for p, s, m, k, i, x, a, b in rows], SC.SESSION_CALL)


def test_calls_in_shuffled_file_order_equal_the_batch_form(spark, tmpdir_path):
    calls = AD.session_events(spark, SF)
    delay = SC.replay_files(spark, calls, f"{tmpdir_path}/calls", 6)
    q = _run(SC.stream_sessions(spark, f"{tmpdir_path}/calls", f"{tmpdir_path}/upd", delay, files_per_trigger=2))
    batch = sorted(map(str, SE.replay(calls).select(*COLS).collect()))
    assert _sessions(spark, f"{tmpdir_path}/upd") == batch and batch
    with_rows = [p for p in q.recentProgress if p.numInputRows]
    assert len(with_rows) > 3  # the trigger is limited
    assert all(s.numRowsDroppedByWatermark == 0 for p in q.recentProgress for s in p.stateOperators)
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal < 40  # taken slots are gone


def test_rules_of_the_session_log(spark, tmpdir_path):
    rows = [("p", 3, 30, "start", "b", None, None, None), ("p", 1, 10, "start", "a", None, None, None),
            ("p", 2, 20, "end", "nobody", "unknown", 1, 1), ("p", 4, 40, "end", "a", "late", 2, None),
            ("p", 5, 40, "end", "b", "done", 3, 4), ("p", 6, 50, "start", "c", None, None, None), ("p", 7, 60, "end", None, "no id", 1, 1),
            ("q", 8, 15, "start", "d", None, None, None), (None, 9, 16, "start", "x", None, None, None), ("q", 10, None, "start", "y", None, None, None),
            ("q", 11, 17, "pause", "d", None, None, None), ("", 12, 100000, SC.TICK, None, None, None, None)]
    df = _calls(spark, rows)
    df.filter("kind <> 'tick'").repartition(3).write.parquet(f"{tmpdir_path}/calls")
    df.filter("kind = 'tick'").write.mode("append").parquet(f"{tmpdir_path}/calls")
    _run(SC.stream_sessions(spark, f"{tmpdir_path}/calls", f"{tmpdir_path}/upd", "2 hours", files_per_trigger=1, slot_ms=60_000))
    got = {r["id"]: r for r in SC.sessions_from_updates(spark.read.schema(SC.SESSION_UPDATE).parquet(f"{tmpdir_path}/upd")).collect()}
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"]["ended_at"], got["a"]["summary"], got["a"]["memories_created"], got["a"]["memories_accessed"]) == (t(40), "late", 2, 0)
    assert (got["b"]["ended_at"], got["b"]["summary"]) == (t(40), "done")
    assert got["c"]["ended_at"] is None and got["d"]["ended_at"] is None


def test_state_goes_on_over_runs_and_waits_for_the_watermark(spark, tmpdir_path):
    src, out = f"{tmpdir_path}/calls", f"{tmpdir_path}/upd"
    _calls(spark, [("p", 1, 0, "start", "a", None, None, None), ("p", 3, 200, "start", "c", None, None, None)]).coalesce(1).write.parquet(src)
    _run(SC.stream_sessions(spark, src, out, "3 hours", slot_ms=60_000))
    assert spark.read.schema(SC.SESSION_UPDATE).parquet(out).select("id").collect() == [("a",)]  # c may still be preceded
    _calls(spark, [("p", 2, 100, "start", "b", None, None, None), ("", 9, 10000, SC.TICK, None, None, None, None)]).coalesce(1).write.mode("append").parquet(src)
    _run(SC.stream_sessions(spark, src, out, "3 hours", slot_ms=60_000))
    kinds = [(r["seq"], r["kind"], r["id"]) for r in spark.read.schema(SC.SESSION_UPDATE).parquet(out).orderBy("seq", "kind").collect()]
    assert kinds == [(1, "start", "a"), (2, "auto_close", "a"), (2, "start", "b"), (3, "auto_close", "b"), (3, "start", "c")]


def test_no_calls(spark, tmpdir_path):
    delay = SC.replay_files(spark, _calls(spark, []), f"{tmpdir_path}/calls", 2)
    _run(SC.stream_sessions(spark, f"{tmpdir_path}/calls", f"{tmpdir_path}/upd", delay))
    assert spark.read.schema(SC.SESSION_UPDATE).parquet(f"{tmpdir_path}/upd").count() == 0


# ------------------------------------------------------------------ R2

def _hits(spark):
    _, hits, _ = M.recall(AD.memories(spark, SF), AD.recall_requests(spark, SF), F.lit(S.AS_OF).cast(S.TS))
    return hits.withColumn("ts", F.lit(S.AS_OF).cast(S.TS))


def _totals(spark, out):
    return {(r.project, r.id): r.hits for r in J.access_totals(spark, out).collect()}


def test_stream_access_equals_batch(spark, tmpdir_path):
    hits = _hits(spark)
    _split_write(hits, f"{tmpdir_path}/hits", 5)
    q = _run(J.stream_access(spark, f"{tmpdir_path}/hits", f"{tmpdir_path}/acc", files_per_trigger=2, buckets=4))
    want = {(r.project, r.id): r["count"] for r in hits.groupBy("project", "id").count().collect()}
    assert _totals(spark, f"{tmpdir_path}/acc") == want and want
    assert len([p for p in q.recentProgress if p.numInputRows]) == 3


def test_repeated_and_partly_written_batches_add_nothing(spark, tmpdir_path):
    hits, out = _hits(spark), f"{tmpdir_path}/acc"
    first, second = hits.filter("op_seq % 2 = 0"), hits.filter("op_seq % 2 = 1")
    assert _totals(spark, out) == {}
    J.fold_hits(first, out, 0, 4)
    J.fold_hits(first, out, 0, 4)
    # a failed attempt of batch 1 that reached two folders only
    bucket = F.pmod(F.xxhash64("project", "id"), F.lit(4))
    J.fold_hits(second.filter(bucket < 2), out, 1, 4)
    J.fold_hits(second, out, 1, 4)
    J.fold_hits(second, out, 1, 4)
    J.fold_hits(hits.limit(0), out, 2, 4)
    J.fold_hits(hits.select("project", F.lit(None).cast("string").alias("id"), "op_seq", "ts"), out, 3, 4)
    J.fold_hits(first, out, 7, 4)  # batches may be skipped
    count = lambda df: {(r.project, r.id): r["count"] for r in df.groupBy("project", "id").count().collect()}
    assert _totals(spark, out) == count(hits.unionByName(first))


# ------------------------------------------------------------------ R1

def _raw(spark):
    return AD.store_batch(spark, SF).withColumn("ts", F.lit(S.AS_OF).cast(S.TS)).select(*[f.name for f in J.RAW_NOTE.fields])


def test_stream_store_equals_batch_and_stores_a_resent_note_once(spark, tmpdir_path):
    batch, src = _raw(spark), f"{tmpdir_path}/raw"
    _split_write(batch, src)
    _split_write(batch, src, 2, "append")
    _run(J.stream_store(spark, src, f"{tmpdir_path}/out", files_per_trigger=2))
    want, trail, rejected = M.store(batch, F.lit(S.AS_OF).cast(S.TS), "any")
    cols = ["project", "title", "summary", "entities", "priority", "expires_at"]
    read = lambda name: spark.read.parquet(f"{tmpdir_path}/out/{name}")
    assert sorted(map(str, read("notes").select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert sorted(map(str, read("audit").select("project", "details", "op_seq").collect())) == sorted(map(str, trail.select("project", "details", "op_seq").collect()))
    assert read("rejected").count() == rejected.count() > 0
    assert {r[0] for r in read("notes").select("id").collect()} == {r[0] for r in read("audit").select("memory_id").collect()}
    assert read("notes").select("id").distinct().count() == want.count()


def test_each_batch_names_its_notes_and_a_repeated_one_keeps_the_names(spark, tmpdir_path):
    raw, ids = _raw(spark).limit(5), []
    for n in (0, 0, 1):
        J.store_writer(f"{tmpdir_path}/out")(raw, n)
        ids.append({r[0] for r in spark.read.parquet(f"{tmpdir_path}/out/notes/batch_id={n}").select("id").collect()})
    assert ids[0] == ids[1] and not ids[0] & ids[2]


def test_one_enrichment_feeds_all_sinks(spark, tmpdir_path):
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        name = "counting"

        def embed(self, df, text, out):
            def run(x):
                seen.add(1)
                return [float(len(x))]

            return df.withColumn(out, F.udf(run, S.VECTOR)(F.col(text)))

    raw = spark.createDataFrame(_raw(spark).filter("category <> 'system_prompt'").limit(20).collect(), J.RAW_NOTE)
    J.store_writer(f"{tmpdir_path}/out", Counting())(raw, 0)
    assert seen.value == 20


def test_stream_store_with_embedder(spark, tmpdir_path):
    from cairn.functions.embed import HashEmbedder
    src = f"{tmpdir_path}/raw"
    _split_write(_raw(spark).limit(40), src, n=2)
    _run(J.stream_store(spark, src, f"{tmpdir_path}/out", embedder=HashEmbedder()))
    got = spark.read.parquet(f"{tmpdir_path}/out/notes")
    dims = {r[0] for r in got.select(F.size("embedding")).collect()}
    assert dims == {384}


def test_a_batch_needs_a_name(spark):
    with pytest.raises(ValueError):
        M.store(_raw(spark), S.AS_OF, "")
