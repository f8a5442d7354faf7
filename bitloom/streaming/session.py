"""Encoder sessions on a stream of raw frames: frame numbers, key frames and the queue of packets, as state of each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PACKETS = "session_id long, seq long, frame_count long, is_key boolean, obus string"


def _packets(frames: DataFrame, interval: int) -> DataFrame:
    count = F.col("frame_count")
    key = (count == 0) | F.col("force_key") | ((count % interval == 0) if interval else F.lit(False))
    return frames.withColumn("is_key", key).withColumn("obus", F.when(key, "2,1,6").otherwise("2,6"))


def packets(frames: DataFrame, interval: int) -> DataFrame:
    """Batch form: frames (session_id, seq, force_key) numbered by seq; the first, forced and every interval-th are key.

    interval 0: only first and forced ones.
    """
    order = W.partitionBy("session_id").orderBy("seq")
    numbered = frames.withColumn("frame_count", (F.row_number().over(order) - 1).cast("long"))
    return _packets(numbered, interval).select("session_id", "seq", "frame_count", "is_key", "obus")


def packet_stream(frames: DataFrame, interval: int) -> DataFrame:
    """Streaming form: how many frames a session has sent so far is its state; within a trigger frames go by seq."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sent = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("seq")
        rows["frame_count"] = range(sent, sent + len(rows))
        state.update((sent + len(rows),))
        key_frame = (rows["frame_count"] == 0) | rows["force_key"] | (rows["frame_count"] % interval == 0 if interval else False)
        yield rows.assign(is_key=key_frame, obus=["2,1,6" if k else "2,6" for k in key_frame])[["session_id", "seq", "frame_count", "is_key", "obus"]]

    return frames.groupBy("session_id").applyInPandasWithState(step, PACKETS, "sent long", "append", "NoTimeout")


QUEUED = "session_id long, seq long, frame_count long, is_key boolean, released_by long, error string"
#: What is said of a frame that comes after its session was flushed.
FLUSHED = "session was flushed"


def queued_packets(calls: DataFrame, interval: int, lag: int) -> DataFrame:
    """Batch form of the queue: calls (session_id, seq, op, force_key), op being send or flush, by seq.

    A frame sent waits until lag more were sent after it, or until the session's first flush, and its packet names the
    call that released it; what neither releases gives no row. Frames sent after that flush give a row with an error.
    Further flushes do nothing.
    """
    every, order = W.partitionBy("session_id"), W.partitionBy("session_id").orderBy("seq")
    known = calls.withColumn("ends", F.min(F.when(F.col("op") == "flush", F.col("seq"))).over(every))
    sent = known.where("op = 'send' and (ends is null or seq < ends)").withColumn("frame_count", (F.row_number().over(order) - 1).cast("long"))
    later = F.lead("seq", lag).over(order) if lag else F.col("seq")
    key = (F.col("frame_count") == 0) | F.col("force_key") | ((F.col("frame_count") % interval == 0) if interval else F.lit(False))
    packets = sent.withColumn("released_by", F.coalesce(later, "ends")).where("released_by is not null").select("session_id", "seq", "frame_count", key.alias("is_key"), "released_by", F.lit(None).cast("string").alias("error"))
    late = known.where("op = 'send' and seq > ends").select("session_id", "seq", F.lit(None).cast("long").alias("frame_count"), F.lit(None).cast("boolean").alias("is_key"), F.col("seq").alias("released_by"), F.lit(FLUSHED).alias("error"))
    return packets.unionByName(late)


def _packet(session_id: int, seq: int, frame_count: int | None, is_key: bool | None, released_by: int | None, error: str | None = None) -> Row:
    return Row(session_id=session_id, seq=seq, frame_count=frame_count, is_key=is_key, released_by=released_by, error=error)


class QueuedSession(StatefulProcessor):
    """The queue as state: a list of waiting packets, first in first out, how many frames were sent, and whether it ended."""

    def __init__(self, interval: int, lag: int, idle_ms: int | None):
        self.interval, self.lag, self.idle_ms = interval, lag, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "seq long, frame_count long, is_key boolean")
        self.sent = handle.getValueState("sent", "n long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        waiting = [tuple(x) for x in self.queue.get()] if self.queue.exists() else []
        n, ended = self.sent.get() if self.sent.exists() else (0, False)
        for call in sorted(rows, key=lambda r: r["seq"]):
            if call["op"] == "flush":
                yield from (_packet(key[0], *packet, call["seq"]) for packet in waiting)
                waiting, ended = [], True
            elif ended:
                yield _packet(key[0], call["seq"], None, None, call["seq"], FLUSHED)
            else:
                waiting.append((call["seq"], n, n == 0 or bool(call["force_key"]) or bool(self.interval and n % self.interval == 0)))
                n += 1
                if len(waiting) > self.lag:
                    yield _packet(key[0], *waiting.pop(0), call["seq"])
        if waiting:
            self.queue.put(waiting)
        else:
            self.queue.clear()
        self.sent.update((n, ended))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if waiting:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """A session that nobody calls any more is flushed; no call released its packets."""
        waiting = [tuple(x) for x in self.queue.get()] if self.queue.exists() else []
        self.queue.clear()
        self.sent.update((self.sent.get()[0], True))
        yield from (_packet(key[0], *packet, None) for packet in waiting)

    def close(self) -> None:
        pass


def queued_stream(calls: DataFrame, interval: int, lag: int, idle_ms: int | None = None) -> DataFrame:
    """Streaming form of queued_packets; within a trigger calls go by seq. With idle_ms, sessions without calls are flushed.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    return calls.groupBy("session_id").transformWithState(QueuedSession(interval, lag, idle_ms), QUEUED, "Append", "None" if idle_ms is None else "ProcessingTime")
