"""Structured Streaming over event logs and conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream of files; ts as a timestamp for watermarks."""
    return spark.readStream.schema(EVENT_SCHEMA).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their value by window and type; what comes later than `late` is dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of each user that end after a gap: start, end and number of events."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return by.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def running_last(events: DataFrame, late: str = "2 days", keep_hours: int = 24) -> DataFrame:
    """The number of events and last type of each user so far, updated a micro-batch at a time; a user's state goes once the watermark is `keep_hours` beyond the last event."""

    def step(key: tuple, rows: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        n, last, at = state.get if state.exists else (0, "", 0)
        for part in rows:
            n += len(part)
            newest = part.loc[part["ts"].idxmax()]
            ms = int(newest["ts"].timestamp() * 1000)
            if ms >= at:
                at, last = ms, newest["event_type"]
        state.update((n, last, at))
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + keep_hours * 3_600_000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_type": [last]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, last_type string", "n bigint, last string, at bigint", "update", "EventTimeTimeout")


def rolling_compression(messages: DataFrame, trigger: int = 40, keep: int = 6, batch: int = 20) -> DataFrame:
    """conv_id, step and the turns of each batch of messages that a conversation's rolling summary takes in.

    Once `trigger` messages of user and assistant are open, the first `batch` of them go, but never one of the last `keep`.
    The state of a conversation is its open turns, fewer than `trigger` of them; a micro-batch holds turns in any order, and
    later micro-batches later turns."""
    if trigger < batch + keep or batch < 1:
        raise ValueError("the trigger must hold a batch and the messages to keep")

    def step(key: tuple, rows: Iterator, state) -> Iterator:
        import pandas as pd

        open_turns, done = state.get if state.exists else ([], 0)
        arrived = sorted(t for part in rows for t in part["turn"].tolist())
        out = []
        for turn in arrived:
            open_turns = [*open_turns, turn]
            if len(open_turns) >= trigger:
                out.append((key[0], done, open_turns[:batch]))
                open_turns, done = open_turns[batch:], done + 1
        state.update((open_turns, done))
        yield pd.DataFrame(out, columns=["conv_id", "step", "turns"])

    said = messages.filter("role IN ('user', 'assistant') AND length(text) > 0").select("conv_id", F.col("turn").cast("long").alias("turn"))
    return said.groupBy("conv_id").applyInPandasWithState(step, "conv_id bigint, step bigint, turns array<bigint>", "open array<bigint>, done bigint", "append", "NoTimeout")


def index_batches(changes: DataFrame, folder: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", deleted_col: str = "deleted") -> None:
    """Takes all that a stream of changes has into the keyword index in `folder`, a micro-batch a segment, and stops.

    A row is a document, new or in place of the one of its id, or with a true `deleted_col` the end of one. A micro-batch has
    an id once at most. The batch's number goes into the index, so one that Spark runs again changes nothing."""
    from marlstone.operators import index

    def take(batch: DataFrame, number: int) -> None:
        known = index.load(batch.sparkSession, folder)
        gone = batch.filter(deleted_col).select(id_col)
        index.add(known, number, batch.filter(~F.coalesce(deleted_col, F.lit(False))), id_col, text_col, gone)

    changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class _Sessions(StatefulProcessor):
    """Keeps the open sessions of one user; see session_store."""

    def __init__(self, ttl_ms: int, cap: int):
        self.ttl_ms, self.cap = ttl_ms, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "session string", "started bigint, last bigint, n bigint")

    def _end(self, user, session: str, why: str):
        started, last, n = self.open.getValue((session,))
        self.open.removeKey((session,))
        return Row(user_id=user, session=session, started=started, last=last, n=n, ended=why)

    def _held(self) -> dict[str, tuple]:
        return {k[0]: tuple(v) for k, v in self.open.iterator()}

    def handleInputRows(self, key, rows, timerValues):
        for r in sorted(rows, key=lambda r: (r.ms, r.event_id)):
            held = self._held()
            for s in stale(held, r.ms, self.ttl_ms):
                yield self._end(key[0], s, "expired")
                del held[s]
            if r.session not in held and len(held) >= self.cap:
                yield self._end(key[0], oldest(held), "evicted")
            started, _, n = held.get(r.session, (r.ms, r.ms, 0))
            self.open.updateValue((r.session,), (started, r.ms, n + 1))
            self.handle.registerTimer(r.ms + self.ttl_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for s in stale(self._held(), expiredTimerInfo.getExpiryTimeInMs(), self.ttl_ms):
            yield self._end(key[0], s, "expired")

    def close(self) -> None:
        pass


def stale(held: dict[str, tuple], now: int, ttl_ms: int) -> list[str]:
    """Sessions (started, last, n) without a message for more than `ttl_ms`, the longest silent first."""
    return sorted((s for s, v in held.items() if now - v[1] > ttl_ms), key=lambda s: (held[s][1], s))


def oldest(held: dict[str, tuple]) -> str:
    """The session that was used least recently."""
    return min(held, key=lambda s: (held[s][1], s))


SESSION_END = "user_id bigint, session string, started bigint, last bigint, n bigint, ended string"


def session_store(messages: DataFrame, ttl_ms: int, cap: int, late: str = "1 hour") -> DataFrame:
    """The sessions that end, of a stream of messages (user_id, session, ts, event_id): SESSION_END, times in milliseconds.

    A session ends when `ttl_ms` go by without a message (expired), or when its user opens one more than `cap` and it is the
    one used least recently (evicted). A user's state is at most `cap` sessions. A timer ends a session without any later
    message, once the watermark has passed it. Messages of a micro-batch are taken in the order of their times; micro-batches
    come in order. Needs the RocksDB state store."""
    rows = messages.select("user_id", "session", "ts", "event_id", (F.unix_micros("ts") / 1000).cast("long").alias("ms"))
    return rows.withWatermark("ts", late).groupBy("user_id").transformWithState(_Sessions(ttl_ms, cap), SESSION_END, "Append", "EventTime")


def replayed_sessions(messages: DataFrame, ttl_ms: int, cap: int) -> DataFrame:
    """The same over a whole table, and `open` for sessions that haven't ended: rows pass in order, with one user's sessions held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held, out = None, {}, []

        def end(s: str, why: str) -> None:
            out.append((user, s, *held.pop(s), why))

        def flush():
            batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
            out.clear()
            return batch

        for batch in batches:
            for u, session, ms in zip(*(batch.column(c).to_pylist() for c in ("user_id", "session", "ms"))):
                if u != user:
                    for s in sorted(held):
                        end(s, "open")
                    user = u
                for s in stale(held, ms, ttl_ms):
                    end(s, "expired")
                if session not in held and len(held) >= cap:
                    end(oldest(held), "evicted")
                started, _, n = held.get(session, (ms, ms, 0))
                held[session] = (started, ms, n + 1)
            yield flush()
        for s in sorted(held):
            end(s, "open")
        yield flush()

    names = [c.split()[0] for c in SESSION_END.split(", ")]
    schema = pa.schema([(c, pa.string() if c in ("session", "ended") else pa.int64()) for c in names])
    rows = messages.select("user_id", "session", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ms"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ms", "event_id").mapInArrow(run, SESSION_END)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that is there to `path`, exactly once by the checkpoint, and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
