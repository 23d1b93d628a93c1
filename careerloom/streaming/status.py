"""Status of every document from its progress events: one value of state per document, dropped some time after the document is finished."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from careerloom.operators.common import KEY
from careerloom.runtime import cut, discard
from careerloom.sources.versions import VersionedTables

# Fixed status of each progress event.
EVENT_STATUS = {
    "started": "pending",
    "progress": "processing",
    "entity_extracted": "processing",
    "complete": "complete",
    "error": "error",
}
FINISHED = ("complete", "error")
_STATE = "status string, progress int, error_message string, started_at timestamp, last_ts timestamp, n_events long"
_FIELDS = ["status", "progress", "error_message", "started_at", "last_ts", "n_events"]


def _next(state: tuple | None, event: str, payload: str | None, ts: pd.Timestamp, keep: timedelta) -> tuple:
    """The state after one more event. What comes later than ``keep`` after the end is a new run."""
    if state is not None and state[0] in FINISHED and ts > state[4] + keep:
        state = None
    status, progress, error, started, _, n = state or (None, 0, None, ts, None, 0)
    status = EVENT_STATUS.get(event, status)
    if event == "progress":
        try:
            progress = int(json.loads(payload or "")["progress"])
        except (ValueError, KeyError, TypeError):
            pass  # an event without a number leaves the progress as it was
    elif event == "complete":
        progress = 100
    elif event == "error":
        error = payload or error
    return status, progress, error, started, ts, n + 1


class _Document(StatefulProcessor):
    def __init__(self, keep: timedelta, zone: str):
        self.keep, self.zone = keep, zone  # times come in the session's zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.document = handle.getValueState("document", _STATE)

    def _timer(self, state: tuple | None) -> int | None:
        """When a finished document's state is dropped; an unfinished one has no timer."""
        if state is None or state[0] not in FINISHED:
            return None
        end = (state[4] + self.keep).tz_localize(self.zone, ambiguous=True, nonexistent="shift_forward")
        return int(end.timestamp() * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A document has few rows, so plain lists; every call of the handle is a round trip to the store.
        events = sorted(
            (e for part in rows for e in zip(part["ts"], part["event_id"], part["event"], part["payload"])), key=lambda e: (e[0] is pd.NaT, e[0], e[1])
        )
        state = self.document.get()
        if state is not None:
            state = (*state[:3], pd.Timestamp(state[3]), pd.Timestamp(state[4]), state[5])
        before = self._timer(state)
        for ts, _, event, payload in events:
            state = _next(state, event, payload, ts, self.keep)
        self.document.update((*state[:3], state[3].to_pydatetime(), state[4].to_pydatetime(), state[5]))
        after = self._timer(state)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        yield pd.DataFrame([(*key, *state)], columns=[KEY, "document_id", *_FIELDS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.document.clear()
        yield pd.DataFrame(columns=[KEY, "document_id", *_FIELDS])

    def close(self) -> None:
        pass


def document_runs(events: DataFrame, keep: str = "1 day") -> DataFrame:
    """The same for a table of events: the last run of every document.

    ``session_id, document_id, status, progress, error_message, started_at, last_ts, n_events``. The error
    text is the last one of the run, the progress the last one told, 100 after completion.
    """
    each = Window.partitionBy(KEY, "document_id").orderBy("ts", "event_id")
    before = F.lag(F.struct("event", "ts")).over(each)
    ended = F.coalesce(before["event"].isin(*FINISHED) & (F.col("ts") > before["ts"] + F.expr(f"INTERVAL {keep}")), F.lit(False))
    runs = events.withColumn("fresh", ended.cast("int")).withColumn("run", F.sum("fresh").over(each))
    order = F.struct("ts", "event_id")
    told = F.when(F.col("event") == "complete", F.lit(100)).when(
        F.col("event") == "progress", F.get_json_object("payload", "$.progress").try_cast("int")
    )
    runs = runs.withColumn("told", told)
    known = F.coalesce(*[F.when(F.col("event") == e, F.lit(s)) for e, s in EVENT_STATUS.items()])
    last = lambda c, on: F.max_by(c, F.when(on, order))
    runs = runs.groupBy(KEY, "document_id", "run").agg(
        last(known, known.isNotNull()).alias("status"),
        F.coalesce(last(F.col("told"), F.col("told").isNotNull()), F.lit(0)).alias("progress"),
        last(F.col("payload"), (F.col("event") == "error") & (F.col("payload") != "")).alias("error_message"),
        F.min("ts").alias("started_at"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"),
    )
    columns = [c for c in runs.columns if c not in (KEY, "document_id", "run")]
    return runs.groupBy(KEY, "document_id").agg(F.max_by(F.struct(*columns), "run").alias("r")).select(KEY, "document_id", "r.*")


def stream_document_status(
    events: DataFrame, path: str, checkpoint: str, keep: timedelta = timedelta(days=1), delay: str = "1 hour"
) -> StreamingQuery:
    """Keep the status table current: each batch commits the documents that changed.

    A document's state is dropped once the watermark is ``keep`` past its end,
    so state holds what is being worked on, not what ever was.
    """
    spark = events.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    key_type = events.schema[KEY].dataType.simpleString()
    id_type = events.schema["document_id"].dataType.simpleString()
    status = (
        events.withWatermark("ts", delay)
        .groupBy(KEY, "document_id")
        .transformWithStateInPandas(_Document(keep, spark.conf.get("spark.sql.session.timeZone")), f"{KEY} {key_type}, document_id {id_type}, {_STATE}", "Update", "EventTime")
    )

    def commit(batch: DataFrame, batch_id: int) -> None:
        # The commit reads it twice; the states are worked out once.
        changed = cut(batch.filter(F.col("status").isNotNull()))
        tables = VersionedTables(batch.sparkSession, path, (KEY, "document_id"))
        tables.commit(batch_id, changed, status=changed)
        discard(changed)

    # The query takes its state store from the session as it starts.
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (
            status.writeStream.outputMode("update")
            .foreachBatch(commit)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(provider, before)


def current_status(spark, path: str) -> DataFrame:
    return VersionedTables(spark, path, (KEY, "document_id")).read("status")


def session_changes(status: DataFrame) -> DataFrame:
    """When something last changed in a session, and how far its documents are."""
    return status.groupBy(KEY).agg(
        F.max("last_ts").alias("updated_at"),
        F.count_if(F.col("status") == "complete").alias("complete"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.count("*").alias("documents"),
    )
