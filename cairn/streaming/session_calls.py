"""Session calls as a stream, with keyed state that waits for late calls.

``transformWithState`` keeps two things per project:

* calls not yet taken, as map state from a time slot (``SLOT_MS`` of event
  time) and a number to a part of that slot's calls, and how many parts a slot has;
* the id of the open session, as value state.

A call is put into its slot as it arrives, chunk by chunk, so a project's
micro-batch is never gathered; a chunk's calls are new parts, and what is there
already is neither read nor written again. Each slot sets one event-time timer. When the
watermark has passed the slot's end, no call of it can arrive any more: the
timer takes the slot's calls one by one in (ts, seq) order, writes their
updates and removes the slot. So calls may arrive in any order within the
watermark's delay, in any number of files and batches, and give the same
updates; a task holds one slot of one project at a time. Calls later than the
delay are dropped by Spark, which counts them in the query's progress
(``numRowsDroppedByWatermark``).

A ``tick`` call changes nothing; it only moves the watermark (a deployment
sends one when a source falls silent). Calls without a project, a time, a seq or a
known kind are ignored, and so is an end without a session id.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairn import schema as S
from cairn.session import scratch_path

SESSION_CALL = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ts", S.TS),
    T.StructField("kind", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("memories_created", T.IntegerType()),
    T.StructField("memories_accessed", T.IntegerType()),
])

SESSION_UPDATE = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("ts", S.TS), T.StructField("summary", T.StringType()),
    T.StructField("memories_created", T.IntegerType()), T.StructField("memories_accessed", T.IntegerType()),
])

SLOT_MS = 3_600_000
TICK = "tick"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _int(x) -> int:
    return 0 if x is None or pd.isna(x) else int(x)


class SessionCalls(StatefulProcessor):
    """One project's calls in order; see the module's text."""

    def __init__(self, slot_ms: int = SLOT_MS):
        self.slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slot long", "n long")
        self.calls = handle.getMapState("calls", "slot long, part long", "calls string")
        self.open = handle.getValueState("open", "id string")

    def handleInputRows(self, key, rows, timerValues):
        parts: dict[int, int] = {}  # of the slots this batch adds to
        for chunk in rows:
            chunk = chunk[chunk["kind"] != TICK]
            slot = chunk["us"] // 1000 // self.slot_ms * self.slot_ms
            for s, part in chunk.groupby(slot, sort=True):
                s = int(s)
                lines = "\n".join(json.dumps([int(us), int(seq), kind, sid, text, _int(mc), _int(ma)]) for us, seq, kind, sid, text, mc, ma in zip(
                    part["us"], part["seq"], part["kind"], part["session_id"], part["summary"], part["memories_created"], part["memories_accessed"]))
                if s not in parts:
                    known = self.parts.containsKey((s,))
                    parts[s] = self.parts.getValue((s,))[0] if known else 0
                    if not known:
                        self.handle.registerTimer(s + self.slot_ms)
                self.calls.updateValue((s, parts[s]), (lines,))
                parts[s] += 1
        for s, n in parts.items():
            self.parts.updateValue((s,), (n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = expiredTimerInfo.getExpiryTimeInMs()
        open_id = self.open.get()[0] if self.open.exists() else None
        for (s,) in sorted(tuple(k) for k in self.parts.keys()):
            if s + self.slot_ms > due:
                break
            keys = [(s, k) for k in range(self.parts.getValue((s,))[0])]
            calls = sorted(json.loads(x) for k in keys for x in self.calls.getValue(k)[0].split("\n"))
            out = []
            for us, seq, kind, sid, text, mc, ma in calls:
                ts = pd.Timestamp(us, unit="us")
                if kind == "start":
                    if open_id is not None:
                        out.append((key[0], open_id, seq, "auto_close", ts, S.AUTO_CLOSE_SUMMARY, 0, 0))
                    out.append((key[0], sid, seq, "start", ts, None, None, None))
                    open_id = sid
                else:
                    out.append((key[0], sid, seq, "end", ts, text, mc, ma))
                    if sid == open_id:
                        open_id = None
            for k in keys:
                self.calls.removeKey(k)
            self.parts.removeKey((s,))
            yield self._frame(out)
        if open_id is None:
            self.open.clear()
        else:
            self.open.update((open_id,))

    @staticmethod
    def _frame(rows) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[f.name for f in SESSION_UPDATE.fields])
        return out.astype({"ts": "datetime64[us]", "memories_created": "Int32", "memories_accessed": "Int32"})

    def close(self) -> None:
        pass


def session_updates(calls: DataFrame, delay: str, slot_ms: int = SLOT_MS) -> DataFrame:
    """Update records (start / end / auto_close) of a stream of calls."""
    known = F.col("kind").isin("start", TICK) | ((F.col("kind") == "end") & F.col("session_id").isNotNull())
    timed = (calls.filter(F.col("project").isNotNull() & F.col("ts").isNotNull() & F.col("seq").isNotNull() & known)
             .withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay))
    # ticks stay in: a filter on kind would be pushed below the watermark
    return timed.withColumn("us", F.unix_micros("event_time")).drop("ts").groupBy("project").transformWithStateInPandas(
        SessionCalls(slot_ms), SESSION_UPDATE, outputMode="append", timeMode="eventTime")


def stream_sessions(spark: SparkSession, source: str, out: str, delay: str = "1 day", fmt: str = "parquet",
                    trigger_once: bool = True, files_per_trigger: int = 1000, slot_ms: int = SLOT_MS):
    """Session calls in files under ``source`` -> update records under
    ``out``, one folder a batch, so that a repeated batch rewrites its own;
    ``sessions_from_updates`` folds them into the session table. At most
    ``files_per_trigger`` files make one batch."""
    from cairn.streaming.jobs import _batch_writer, _checkpoint

    conf, key = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, ROCKSDB)  # read when the query starts
    try:
        calls = spark.readStream.schema(SESSION_CALL).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(source)
        w = (session_updates(calls, delay, slot_ms).writeStream.outputMode("append").foreachBatch(_batch_writer(out))
             .option("checkpointLocation", _checkpoint(spark, "sessions", out)))
        return (w.trigger(availableNow=True) if trigger_once else w).start()
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def replay_files(spark: SparkSession, calls: DataFrame, path: str, slices: int) -> str:
    """Writes ``calls`` as a source folder whose files arrive out of order: time is
    cut into ``slices``, each pair of neighbouring slices arrives in reverse, and a tick ends
    the stream. Returns the delay that covers the disorder."""
    names = [f.name for f in SESSION_CALL.fields]
    made = scratch_path(spark, f"calls-{uuid.uuid4().hex}")
    calls.select(names).write.parquet(made)  # every slice reads them
    calls = spark.read.schema(calls.select(names).schema).parquet(made)
    lo, hi = calls.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        lo = hi = S.AS_OF
    step = max(1, int((hi - lo).total_seconds() * 1e6) // slices + 1)
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(lo).cast(S.TS).cast("timestamp"))) / step)
    for k in (i ^ 1 if i ^ 1 < slices else i for i in range(slices)):
        calls.filter(at == k).select(names).write.mode("append").parquet(path)
    delay = 2 * step // 1_000_000 + 1
    tick = spark.range(1).select(F.lit("").alias("project"), F.lit(0).cast("long").alias("seq"), (F.lit(hi).cast(S.TS) + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(TICK).alias("kind"),
                                 *[F.lit(None).cast(f.dataType).alias(f.name) for f in SESSION_CALL.fields[4:]])
    tick.write.mode("append").parquet(path)
    return f"{delay} seconds"


def sessions_from_updates(updates: DataFrame) -> DataFrame:
    """Fold update records into sessions: the start gives ``started_at``;
    the last end/auto-close by ``seq`` gives end, summary and counts
    (a late end overwrites an auto-close, Q17; an unknown id has no start
    and is dropped)."""
    starts = updates.filter(F.col("kind") == "start").select(
        "project", "id", F.col("ts").alias("started_at"), F.col("seq").alias("start_seq"))
    ends = updates.filter(F.col("kind") != "start").join(starts.select("project", "id", "start_seq"),
                                                         ["project", "id"]).filter(F.col("seq") > F.col("start_seq"))
    last = ends.groupBy("project", "id").agg(
        F.max(F.struct("seq", "ts", "summary", "memories_created", "memories_accessed", "kind")).alias("e"))
    j = starts.join(last, ["project", "id"], "left")
    return j.select("project", "id", "started_at", F.col("e.ts").alias("ended_at"),
                    F.col("e.summary").alias("summary"),
                    F.col("e.memories_created").alias("memories_created"),
                    F.col("e.memories_accessed").alias("memories_accessed"))
