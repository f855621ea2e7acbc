"""Order status as a Structured Streaming job with keyed state.

Status events of an order may arrive late, out of order and more than once.  Per
order the state holds what is settled (all events older than the watermark, in
time order) and the events that are not yet.  When the watermark passes an event
it is folded in for good: its transition is checked and never looked at again.
Every time an order is touched, its current row is emitted: the settled part and
the open events on top, so the newest row of each order is what a batch over all
events so far would say.  An event older than the watermark is late and dropped;
a repeated one is known by its id while it is open and late afterwards.

The sink writes each epoch's rows under the epoch's number and replaces them
when the epoch is replayed (``deltas.py``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import TRANSITIONS
from . import deltas

STEP = "struct<event_id:bigint,ts:timestamp_ntz,from_status:string,to_status:string>"
ROW = f"order_id long, status string, completed_at timestamp_ntz, n_events long, settled array<{STEP}>, open array<{STEP}>"
STATE = "settled string, open string"
NOTHING = {"status": None, "completed_at": None, "n": 0}


def fold(settled: dict, events: list[tuple[int, int, str]], allowed: dict[str, list[str]]) -> tuple[dict, list[tuple]]:
    """The state after (ts in microseconds, event id, status) events in order, and the steps that are not allowed."""
    out, bad = dict(settled), []
    for ts, event_id, status in events:
        before = out["status"]
        if before is not None and before != status and status not in allowed.get(before, []):
            bad.append((event_id, ts, before, status))
        if status == "completed" and out["completed_at"] is None:
            out["completed_at"] = ts
        out["status"], out["n"] = status, out["n"] + 1
    return out, bad


def _steps(bad: list[tuple]) -> list[dict]:
    return [{"event_id": e, "ts": pd.Timestamp(ts, unit="us").to_pydatetime(), "from_status": a, "to_status": b} for e, ts, a, b in bad]


def advance(allowed: dict[str, list[str]]):
    """The state function: new events in, the order's current row out."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        settled, waiting = NOTHING, []
        if state.exists:
            settled, waiting = (json.loads(x) for x in state.get)
        open_ = {e[1]: tuple(e) for e in waiting}
        if not state.hasTimedOut:
            for b in batches:
                for ts, event_id, status in zip(b["ts"].astype("datetime64[us]").astype("int64"), b["event_id"], b["status"]):
                    open_.setdefault(int(event_id), (int(ts), int(event_id), status))
        passed = state.getCurrentWatermarkMs() * 1000
        events = sorted(open_.values())
        ripe = [e for e in events if e[0] < passed]
        rest = events[len(ripe):]
        settled, bad = fold(settled, ripe, allowed)
        now, doubtful = fold(settled, rest, allowed)
        state.update((json.dumps(settled), json.dumps(rest)))
        if rest:  # woken when the watermark has passed the first of them
            state.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        done = None if now["completed_at"] is None else pd.Timestamp(now["completed_at"], unit="us")
        yield pd.DataFrame({"order_id": [key[0]], "status": [now["status"]], "completed_at": pd.Series([done], dtype="datetime64[us]"),
                            "n_events": [now["n"]], "settled": [_steps(bad)], "open": [_steps(doubtful)]})
    return run


def order_rows(events: DataFrame, delay: str = "1 day", transitions: dict[str, list[str]] | None = None) -> DataFrame:
    """Current rows of the orders that the stream ``events`` (order_id, event_id, ts, status) touches.

    Events without an order, id, time or status take no part."""
    known = events.where("order_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL AND status IS NOT NULL").select(
        F.col("order_id").cast("long").alias("order_id"), F.col("event_id").cast("long").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"), "status")
    return known.withWatermark("ts", delay).groupBy("order_id").applyInPandasWithState(
        advance(transitions or TRANSITIONS), ROW, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def start_order_stream(events: DataFrame, state_path: str, checkpoint: str, delay: str = "1 day", available_now: bool = True):
    """Run ``order_rows`` into ``state_path``."""
    w = (order_rows(events, delay).writeStream.outputMode("update").foreachBatch(deltas.writer(state_path))
         .option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def _newest(rows: DataFrame) -> DataFrame:
    """One row an order: the newest state and all settled steps so far."""
    return rows.groupBy("order_id").agg(
        F.max_by(F.struct("status", "completed_at", "n_events", "open"), "epoch").alias("now"),
        F.flatten(F.collect_list("settled")).alias("settled"), F.max("epoch").alias("epoch")).select(
        "order_id", "now.*", "settled", "epoch")


def compact_orders(spark: SparkSession, state_path: str) -> None:
    """Fold the epochs so far into one base table."""
    deltas.compact(spark, state_path, _newest)


def orders_now(spark: SparkSession, state_path: str) -> DataFrame:
    """L4: status, first completion and number of events of every order."""
    return _newest(deltas.read(spark, state_path)).select("order_id", "status", "completed_at", "n_events")


def illegal_now(spark: SparkSession, state_path: str) -> DataFrame:
    """L4: steps that are not allowed, settled or among the open events."""
    rows = _newest(deltas.read(spark, state_path))
    return rows.select("order_id", F.explode(F.concat("settled", "open")).alias("s")).select(
        "order_id", "s.event_id", "s.ts", "s.from_status", "s.to_status")
