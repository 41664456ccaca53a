"""Session replay on hand-made call logs (M9-M11, T8, A8, C6 pieces)."""

import datetime as dt

from pyspark.sql import functions as F

from cairn import schema as S
from cairn.operators import sessions as SE

T0 = dt.datetime(2024, 1, 1)
AUTO = S.AUTO_CLOSE_SUMMARY
SCHEMA = ("project string, seq long, ts timestamp_ntz, kind string, session_id string, summary string, "
          "memories_created int, memories_accessed int")


def _t(m):
    return T0 + dt.timedelta(minutes=m)


def _calls(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _state(df):
    return {r.id: r for r in df.collect()}


def test_two_orphans_late_end_double_end_unknown(spark):
    calls = _calls(spark, [
        ("p", 1, _t(1), "start", "s1", None, None, None),
        ("p", 2, _t(2), "start", "s2", None, None, None),      # closes s1
        ("p", 3, _t(3), "start", "s3", None, None, None),      # closes s2
        ("p", 4, _t(4), "end", "s1", "late", 2, 3),            # late end overwrites auto-close (Q17)
        ("p", 5, _t(5), "end", "s3", "first", 1, 1),
        ("p", 6, _t(6), "end", "s3", "second", 4, 4),          # double end: last wins
        ("p", 7, _t(7), "end", "nope", "x", 0, 0),             # unknown id: nothing
        ("p", 8, _t(8), "start", "s4", None, None, None),      # s3 already ended: no orphan
    ])
    st = _state(SE.replay(calls))
    assert (st["s1"].ended_at, st["s1"].summary, st["s1"].memories_created) == (_t(4), "late", 2)
    assert (st["s2"].ended_at, st["s2"].summary) == (_t(3), AUTO)
    assert (st["s3"].ended_at, st["s3"].summary) == (_t(6), "second")
    assert st["s4"].ended_at is None and "nope" not in st
    a8 = SE.orphans_closed(SE.replay(calls)).first()
    assert (a8.sessions, a8.orphans_closed) == (4, 2)


def _last(spark, rows):
    df = spark.createDataFrame(rows, "project string, id string, ended_at timestamp_ntz, summary string")
    r = SE.last_session(df).collect()
    return r[0].last_session_summary if r else "no-row"


def test_last_session_rules(spark):
    assert _last(spark, [("p", "a", None, None)]) == "no-row"
    assert _last(spark, [("p", "a", _t(1), "real"), ("p", "b", _t(2), AUTO)]) == "real"
    assert _last(spark, [("p", "a", _t(1), "real"), ("p", "b", _t(2), None)]) is None
    assert _last(spark, [("p", "a", _t(1), AUTO), ("p", "b", _t(2), AUTO)]) is None
    assert _last(spark, [("p", "a", _t(1), None), ("p", "b", _t(2), AUTO)]) is None


def test_start_closes_open_then_digest_header(spark):
    calls = _calls(spark, [
        ("p", 1, _t(1), "start", "s1", None, None, None),
        ("p", 2, _t(2), "end", "s1", "done", 1, 0),
        ("p", 3, _t(3), "start", "s2", None, None, None),
    ])
    sessions = SE.replay(calls)
    closed = SE.close_at(sessions, spark.createDataFrame([("p",)], "project string"), F.lit(_t(10)).cast(S.TS))
    st = _state(closed)
    assert st["s2"].closed_now and st["s2"].summary == AUTO and st["s2"].ended_at == _t(10)
    # latest ended is the auto-close -> fall back to the real summary
    assert SE.last_session(closed).first().last_session_summary == "done"
