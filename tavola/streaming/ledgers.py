"""Ledgers as Structured Streaming jobs.

The event log is read as a stream; each micro-batch is folded into a delta
(``groupBy(key)`` sums) and written under its epoch (``deltas.py``), so a
replayed batch after a failure replaces its own output (exactly-once per epoch
with the checkpointed offsets); ``compact_*`` folds old epochs into one table.
Current state = the batch ledger function over all deltas, the same code
as the batch path.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from . import deltas

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event log as a stream.  ``path`` is a folder of parquet files, or one
    file (then its folder is watched for files of that name)."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if path.endswith(".parquet") and not os.path.isdir(path):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def _delta_writer(state_path: str, key: str, aggs):
    return deltas.writer(state_path, lambda batch: batch.groupBy(key).agg(*aggs))


def compact_loyalty(spark: SparkSession, state_path: str) -> None:
    """Fold the loyalty deltas so far into one row a customer."""
    deltas.compact(spark, state_path, lambda rows: rows.groupBy("customer_id").agg(
        F.sum("points").alias("points"), F.sum("n").alias("n"), F.max("epoch").alias("epoch")))


def compact_stock(spark: SparkSession, state_path: str) -> None:
    """Fold the stock deltas so far into one row an item."""
    deltas.compact(spark, state_path, lambda rows: rows.groupBy("inventory_id").agg(
        F.sum("delta").alias("delta"), F.max("ts").alias("ts"), F.max("epoch").alias("epoch")))


def start_loyalty_stream(spark: SparkSession, events_path: str, state_path: str, checkpoint: str,
                         available_now: bool = True):
    """Stream purchase events into loyalty point deltas (L2)."""
    ev = read_event_stream(spark, events_path)
    pts = (ev.where(F.col("event_type") == "purchase")
           .select(F.col("user_id").alias("customer_id"), F.floor("value").cast("long").alias("points")))
    writer = _delta_writer(state_path, "customer_id",
                           [F.sum("points").alias("points"), F.count(F.lit(1)).alias("n")])
    w = pts.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def loyalty_from_deltas(spark: SparkSession, customers: DataFrame, state_path: str) -> DataFrame:
    """Current loyalty state from the stream's deltas (L2 over summed deltas)."""
    d = deltas.read(spark, state_path)
    earned = d.groupBy("customer_id").agg(F.sum("points").alias("p"), F.sum("n").alias("n"))
    # expand deltas to the point-event shape the batch function expects
    events = earned.select("customer_id", F.col("p").alias("points"))
    out = L.loyalty_state(customers, events)
    return out.join(earned.select("customer_id", F.col("n").alias("_n")), "customer_id", "left") \
        .withColumn("n_events", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def start_stock_stream(spark: SparkSession, events_path: str, state_path: str, checkpoint: str,
                       movements: dict[str, int], available_now: bool = True):
    """Stream stock movements (L3): event type -> quantity delta per item."""
    ev = read_event_stream(spark, events_path)
    delta = None
    for k, v in movements.items():
        delta = F.when(F.col("event_type") == k, F.lit(v)) if delta is None else delta.when(F.col("event_type") == k, F.lit(v))
    mv = (ev.where(F.col("event_type").isin(*movements))
          .select(F.get_json_object("props", "$.k").cast("long").alias("inventory_id"), "ts", delta.alias("delta")))
    writer = _delta_writer(state_path, "inventory_id",
                           [F.sum("delta").alias("delta"), F.max(F.when(F.col("delta") > 0, F.col("ts"))).alias("ts")])
    w = mv.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def stock_from_deltas(spark: SparkSession, inv: DataFrame, state_path: str) -> DataFrame:
    """Current stock state from the stream's deltas: same columns as L3."""
    d = deltas.read(spark, state_path)
    mv = d.groupBy("inventory_id").agg(F.sum("delta").cast("long").alias("net_movement"),
                                       F.max("ts").alias("last_restocked"))
    s = inv.select("inventory_id", "quantity_on_hand", "reorder_level").join(mv, "inventory_id", "left") \
        .fillna(0, ["net_movement"])
    return (s.withColumn("quantity_on_hand", F.col("quantity_on_hand") + F.col("net_movement"))
            .withColumn("needs_reorder", F.col("quantity_on_hand") <= F.col("reorder_level")))
