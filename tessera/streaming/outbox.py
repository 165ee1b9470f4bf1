"""Ordered projection of an outbox stream: each aggregate's events in order, with retries after a delay and dead letters.

One stateful operator keeps, for each aggregate, the next sequence number, the attempts at it and the events that wait behind
it (a map state of blocks of 64 sequence numbers, so that an event costs a share of one read and one write, however many wait). Retries are timers in event time: a failed event is tried again when the
watermark has passed its delay. Outcomes leave as rows; `project` writes them by epoch, so that a replayed epoch
overwrites what it wrote before, and a restart from the checkpoint continues.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "aggregate string, seq long, event_id long, status string, attempts int, error string"


class OrderedProjector(StatefulProcessor):
    """apply(event, attempt) is called for an aggregate's events in order of seq, without gaps; an exception is a failed attempt.

    Outcomes: applied; replayed (seq was passed before); dead_letter (max_attempts failed; the aggregate stops there, and later
    events wait until the letter is resolved outside). apply must be idempotent: after a lost executor an epoch runs again.
    """

    def __init__(self, apply: Callable[[dict[str, Any], int], None], max_attempts: int, delay_ms: int):
        if max_attempts < 1 or delay_ms < 0:
            raise ValueError("max_attempts must be positive and the delay must not be below 0")
        self.apply, self.max_attempts, self.delay_ms = apply, max_attempts, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "next long, attempts int, clock long, stopped boolean")
        self.waiting = handle.getMapState("waiting", "block long", "events string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        cursor, out = self.cursor.get(), []
        held = _Waiting(self.waiting, new=cursor is None)
        cursor = tuple(cursor or _START)
        for part in rows:
            at = (part["ts"].astype("datetime64[ns]" if part["ts"].dt.tz is None else "datetime64[ns, UTC]").astype("int64") // 1_000_000).tolist()
            columns = [part[c].tolist() for c in part.columns]
            for ms, *values in zip(at, *columns, strict=True):
                event = dict(zip(part.columns, values, strict=True))
                seq = int(event["seq"])
                if seq < cursor[0] or seq in held.of(seq):
                    out.append((key[0], seq, int(event["event_id"]), "replayed", 0, None))
                else:
                    held.put(seq, [ms, {c: v if type(v) in _PLAIN else str(v) if isinstance(v, pd.Timestamp) else json.loads(json.dumps(v, default=str)) for c, v in event.items()}])
        yield from self._advance(key[0], held, cursor, timerValues.getCurrentWatermarkInMs(), out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(key[0], _Waiting(self.waiting), tuple(self.cursor.get() or _START), timerValues.getCurrentWatermarkInMs(), [])

    def _advance(self, key: str, held: _Waiting, cursor: tuple, now: int, out: list) -> Iterator[pd.DataFrame]:
        """Apply what is next until an event is missing, has to be tried again later, or is a dead letter."""
        nxt, attempts, clock, stopped = cursor
        while not stopped and (attempts == 0 or clock <= now):
            if nxt not in held.of(nxt):
                break
            at, event = held.of(nxt)[nxt]
            if attempts == 0:
                clock = max(clock, at)  # tries are dated by event time, so that their number does not depend on batches
            attempts += 1
            try:
                self.apply(dict(event), attempts)
            except Exception as error:  # noqa: BLE001  # whatever the target raises is a failed attempt
                if attempts >= self.max_attempts:
                    stopped = True
                    out.append((key, nxt, event["event_id"], "dead_letter", attempts, f"{type(error).__name__}: {error}"[:4000]))
                    break
                clock += self.delay_ms
                if clock > now:
                    self.handle.registerTimer(clock)
                continue
            out.append((key, nxt, event["event_id"], "applied", attempts, None))
            held.drop(nxt)
            nxt, attempts = nxt + 1, 0
        if (nxt, attempts, clock, stopped) != cursor or cursor == _START:
            self.cursor.update((nxt, attempts, clock, stopped))
        held.store()
        if out:
            yield pd.DataFrame({c: np.array(values, dtype=kind) for (c, kind), values in zip(_COLUMNS.items(), zip(*out, strict=True), strict=True)}, copy=False)


_COLUMNS = {"aggregate": object, "seq": "int64", "event_id": "int64", "status": object, "attempts": "int32", "error": object}
_START = (1, 0, 0, False)
_PLAIN = (int, float, str, bool, type(None))
_BLOCK = 64


class _Waiting:
    """The events of an aggregate that wait, by seq: the blocks that are touched are read once and written once."""

    def __init__(self, state: Any, new: bool = False):
        self.state, self.new = state, new
        self.blocks: dict[int, dict[int, list]] = {}
        self.stored: set[int] = set()
        self.changed: set[int] = set()

    def of(self, seq: int) -> dict[int, list]:
        """The waiting events of the block of a seq."""
        n = seq // _BLOCK
        if n not in self.blocks:
            found = None if self.new else self.state.getValue((n,))
            if found is not None:
                self.stored.add(n)
            self.blocks[n] = {} if found is None else {int(k): v for k, v in json.loads(found[0]).items()}
        return self.blocks[n]

    def put(self, seq: int, item: list) -> None:
        self.of(seq)[seq] = item
        self.changed.add(seq // _BLOCK)

    def drop(self, seq: int) -> None:
        del self.of(seq)[seq]
        self.changed.add(seq // _BLOCK)

    def store(self) -> None:
        for n in self.changed:
            if self.blocks[n]:
                self.state.updateValue((n,), (json.dumps(self.blocks[n]),))
            elif n in self.stored:
                self.state.removeKey((n,))


@contextmanager
def _state_store(spark: SparkSession):
    """The state store with list states and timers, for the query started within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def project(stream: DataFrame, apply: Callable[[dict[str, Any], int], None], root: str, max_attempts: int = 10, delay: str = "30 seconds", late: str = "0 seconds") -> None:
    """Project all that an outbox stream (aggregate, seq, event_id, ts, …) holds now into `root`.

    seq counts an aggregate's events from 1; ts is when the event became available. Tables: root/outcomes/epoch=N (OUTCOME), the
    checkpoint lies in root/checkpoint, so a later call goes on where this one ended. Rows of the same aggregate and seq are replays.
    Rows older than the watermark (`late` behind the newest ts) are not dropped by a stateful operator of this kind unless they come
    after it; choose `late` as long as events may be delayed.
    """
    spark = stream.sparkSession
    seconds = spark.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {delay})").first()[0]
    rows = stream.withWatermark("ts", late).groupBy("aggregate")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/outcomes/epoch={epoch}")

    with _state_store(spark):
        out = rows.transformWithStateInPandas(OrderedProjector(apply, max_attempts, seconds), OUTCOME, "Append", "EventTime")
        out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/outcomes").parquet(f"{root}/outcomes/epoch=*").drop("epoch")


def quarantine_items(done: DataFrame, run: str) -> DataFrame:
    """Dead letters as quarantine items (record_key, stage, reason_code, severity, raw_value_redacted, run)."""
    raw = F.to_json(F.struct(F.col("event_id").alias("outbox_event_id"), F.col("error").substr(1, 1000).alias("error")))
    dead = done.filter("status = 'dead_letter'")
    return dead.select(F.col("aggregate").alias("record_key"), F.lit("project").alias("stage"), F.lit("projection_retry_exhausted").alias("reason_code"), F.lit("blocked").alias("severity"), raw.alias("raw_value_redacted"), F.lit(run).alias("run"))
