"""The queue of an encoder session: the stream against its batch form, over triggers, restarts, flushes and idle sessions."""

import random

import pytest

from bitloom.streaming import session as S

CALLS = "session_id long, seq long, op string, force_key boolean"


@pytest.fixture(autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def plain(calls, interval, lag):
    """One call after another, as an encoder takes them."""
    out, state = [], {}
    for i, seq, op, force in sorted(calls):
        s = state.setdefault(i, {"queue": [], "n": 0, "ended": False})
        if op == "flush":
            out += [(i, *p, seq, None) for p in s["queue"]]
            s["queue"], s["ended"] = [], True
        elif s["ended"]:
            out.append((i, seq, None, None, seq, S.FLUSHED))
        else:
            s["queue"].append((seq, s["n"], s["n"] == 0 or force or bool(interval and s["n"] % interval == 0)))
            s["n"] += 1
            if len(s["queue"]) > lag:
                out.append((i, *s["queue"].pop(0), seq, None))
    return sorted(out, key=str)


def calls():
    r = random.Random(2)
    rows = [(i, n, "send", r.random() < 0.2) for i in range(5) for n in range(20)]
    rows = [(i, n, "flush" if (i, n) in ((1, 9), (1, 14), (2, 19), (4, 0)) else op, f) for i, n, op, f in rows]
    return rows


@pytest.mark.parametrize("interval, lag", [(4, 3), (0, 0), (3, 30)])
def test_batch_form(spark, interval, lag):
    rows = calls()
    got = S.queued_packets(spark.createDataFrame(rows, CALLS), interval, lag).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, interval, lag)
    assert S.queued_packets(spark.createDataFrame([], CALLS), interval, lag).count() == 0


def test_stream_over_triggers_and_a_restart(spark, tmp_path):
    rows, source, out = sorted(calls(), key=lambda r: r[1]), str(tmp_path / "calls"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(CALLS).parquet(source)
        query = S.queued_stream(stream, 4, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    for part in (rows[:37], rows[37:60], rows[60:]):  # each time the query starts again from its checkpoint
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(source)
        run()
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == plain(rows, 4, 3)


def test_idle_sessions_are_flushed(spark, tmp_path):
    import time

    source = str(tmp_path / "calls")
    spark.createDataFrame([(1, n, "send", False) for n in range(3)], CALLS).coalesce(1).write.parquet(source)
    query = S.queued_stream(spark.readStream.schema(CALLS).parquet(source), 0, 10, idle_ms=1).writeStream.format("memory").queryName("idle").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while spark.table("idle").count() < 3 and time.time() < until:
            time.sleep(1)
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("idle").collect())) == [(1, 0, 0, True, None, None), (1, 1, 1, False, None, None), (1, 2, 2, False, None, None)]
