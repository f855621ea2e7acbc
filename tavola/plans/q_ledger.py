"""Ledger queries (L*): event logs folded into state, with SQL oracles.

Inputs come from the driver tables: order lines for order totals, and the
``events`` stream for loyalty points (purchases), stock movements and
order status changes (each user is an open order / tab).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import round_even
from ..operators import ledger as L
from ..sources import driver as D
from .registry import REGISTRY, register
from .sqlviews import VIEWS, with_views

# Event type -> order status, and stock movement per event type.
EVENT_STATUS = {"view": "pending", "click": "confirmed", "signup": "preparing", "purchase": "completed",
                "error": "cancelled"}
EVENT_STOCK_DELTA = {"purchase": -1, "signup": 5}


def _case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {repr(v) if not isinstance(v, str) else chr(39) + v + chr(39)}"
                     for k, v in mapping.items())
    return f"CASE {col} {whens} END"


def _map(col, mapping):
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v))
    return expr


def _lines(spark, sf):
    li = D.read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("total_price"),
                     round_even(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("discount"))


def _totals(spark, sf):
    return L.order_totals(_lines(spark, sf), "order_id", "total_price", "discount")


_TOTALS = """SELECT order_id, subtotal, discount_amount, round_even(CAST(subtotal AS DECIMAL(20,2)) * 0.085, 2) AS tax_amount
FROM (SELECT l_orderkey AS order_id, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS subtotal,
        SUM(CAST(round_even(l_extendedprice * l_discount, 2) AS DECIMAL(18,2))) AS discount_amount
      FROM lineitem GROUP BY 1)"""


@register("l01_order_totals", with_views("""
SELECT order_id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(discount_amount AS DOUBLE) AS discount_amount,
  CAST(tax_amount AS DOUBLE) AS tax_amount, CAST(subtotal + tax_amount - discount_amount AS DOUBLE) AS total FROM t""",
                                         extra={"t": _TOTALS}))
def l01(spark, sf):
    """L1 order totals rebuilt from lines: exact subtotal, half-even tax, discount."""
    t = _totals(spark, sf)
    return t.select("order_id", *[F.col(c).cast("double").alias(c)
                                  for c in ("subtotal", "discount_amount", "tax_amount", "total")])


@register("l02_loyalty_state", with_views("""
SELECT cu.customer_id, cu.loyalty_points AS opening_points, COALESCE(e.earned, 0) AS earned_points,
  COALESCE(e.n, 0) AS n_events, cu.loyalty_points + COALESCE(e.earned, 0) AS loyalty_points,
  CASE WHEN cu.loyalty_points + COALESCE(e.earned, 0) >= 2000 THEN 'platinum'
       WHEN cu.loyalty_points + COALESCE(e.earned, 0) >= 1000 THEN 'gold'
       WHEN cu.loyalty_points + COALESCE(e.earned, 0) >= 500 THEN 'silver' ELSE 'bronze' END AS loyalty_tier
FROM cu LEFT JOIN (SELECT user_id, CAST(SUM(CAST(floor(value) AS BIGINT)) AS BIGINT) AS earned, COUNT(*) AS n
  FROM events WHERE event_type = 'purchase' GROUP BY 1) e ON cu.customer_id = e.user_id""", "cu"))
def l02(spark, sf):
    """L2 loyalty points ledger: purchase events earn floor(value) points; tier recomputed."""
    ev = (D.activity(spark, sf).where(F.col("event_type") == "purchase")
          .select(F.col("user_id").alias("customer_id"), F.floor("value").cast("long").alias("points")))
    return L.loyalty_state(D.customers(spark, sf), ev)


_MOVES = f"""SELECT k AS inventory_id, ts, {_case('event_type', EVENT_STOCK_DELTA)} AS delta FROM act
  WHERE event_type IN ({', '.join(repr(k) for k in EVENT_STOCK_DELTA)})"""


@register("l03_stock_state", with_views("""
SELECT inv.inventory_id, inv.quantity_on_hand + COALESCE(m.net, 0) AS quantity_on_hand, inv.reorder_level,
  CAST(COALESCE(m.net, 0) AS BIGINT) AS net_movement, m.last_restocked,
  inv.quantity_on_hand + COALESCE(m.net, 0) <= inv.reorder_level AS needs_reorder
FROM inv LEFT JOIN (SELECT inventory_id, SUM(delta) AS net, max(CASE WHEN delta > 0 THEN ts END) AS last_restocked
  FROM moves GROUP BY 1) m ON inv.inventory_id = m.inventory_id""", "inv", "act", extra={"moves": _MOVES}))
def l03(spark, sf):
    """L3 stock ledger: purchases consume, sign-ups restock; reorder flag."""
    a = D.activity(spark, sf).where(F.col("event_type").isin(*EVENT_STOCK_DELTA))
    mv = a.select(F.col("k").alias("inventory_id"), "ts", _map("event_type", EVENT_STOCK_DELTA).alias("delta"))
    return L.stock_state(D.inventory(spark, sf), mv)


_STATUS_EV = f"SELECT user_id AS order_id, event_id, ts, {_case('event_type', EVENT_STATUS)} AS status FROM events"


def _status_events(spark, sf):
    e = D.read(spark, sf, "events")
    return e.select(F.col("user_id").alias("order_id"), "event_id", "ts", _map("event_type", EVENT_STATUS).alias("status"))


@register("l04_order_state", with_views("""
SELECT order_id, arg_max(status, (ts, event_id)) AS status, min(CASE WHEN status = 'completed' THEN ts END) AS completed_at,
  COUNT(*) AS n_events FROM sev GROUP BY 1""", extra={"sev": _STATUS_EV}))
def l04(spark, sf):
    """L4 order status from events: last status wins, first completion time."""
    return L.order_state(_status_events(spark, sf))


_TT = ", ".join(f"('{a}', '{b}')" for a, nxt in L.TRANSITIONS.items() for b in nxt)


@register("l04_illegal_transitions", with_views(f"""
SELECT order_id, event_id, ts, from_status, to_status FROM (
  SELECT order_id, event_id, ts, lag(status) OVER (PARTITION BY order_id ORDER BY ts, event_id) AS from_status,
         status AS to_status FROM sev)
WHERE from_status IS NOT NULL AND from_status <> to_status
  AND (from_status, to_status) NOT IN (SELECT (a, b) FROM (VALUES {_TT}) AS t(a, b))""", extra={"sev": _STATUS_EV}))
def l04i(spark, sf):
    """L4 status changes not allowed by the transition table."""
    return L.illegal_transitions(_status_events(spark, sf))


@register("l05_duplicate_payments", """
SELECT user_id, k, COUNT(*) AS n_payments FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events WHERE event_type = 'purchase') GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def l05(spark, sf):
    """L5 repeated payments for the same (user, item) tab."""
    pay = D.activity(spark, sf).where(F.col("event_type") == "purchase")
    return L.duplicate_payments(pay, ["user_id", "k"])


@register("l06_apply_payments", with_views(f"""
SELECT t.order_id, CAST(t.subtotal AS DOUBLE) AS subtotal, CAST(t.tax_amount AS DOUBLE) AS tax_amount,
  CAST(t.discount_amount AS DOUBLE) AS discount_amount, CAST(COALESCE(p.tip, 0) AS DOUBLE) AS tip_amount,
  CASE WHEN p.n IS NOT NULL THEN CAST(t.subtotal + t.tax_amount - t.discount_amount + p.tip AS DOUBLE)
       ELSE CAST(t.subtotal + t.tax_amount - t.discount_amount AS DOUBLE) END AS total,
  CASE WHEN p.n IS NOT NULL THEN 'completed' ELSE ord.status END AS status
FROM t JOIN ord ON t.order_id = ord.id
LEFT JOIN (SELECT user_id AS order_id, SUM(CAST(round_even(value, 2) AS DECIMAL(18,2))) AS tip, COUNT(*) AS n
  FROM events WHERE event_type = 'purchase' GROUP BY 1) p ON t.order_id = p.order_id""", "ord", extra={"t": _TOTALS}))
def l06(spark, sf):
    """L6 payments (purchase events, tab = user) applied to rebuilt order totals."""
    t = _totals(spark, sf)
    o = t.join(D.orders(spark, sf).select(F.col("id").alias("order_id"), "status"), "order_id")
    pay = (D.activity(spark, sf).where(F.col("event_type") == "purchase")
           .select(F.col("user_id").alias("order_id"), round_even("value", 2).alias("tip_amount")))
    out = L.apply_payments(o, pay)
    return out.select("order_id", *[F.col(c).cast("double").alias(c) for c in
                                    ("subtotal", "tax_amount", "discount_amount", "tip_amount", "total")], "status")


def _stream_dir(spark) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tavola-stream-{uuid.uuid4().hex}"


@register("l02s_loyalty_stream", None)
def l02s(spark, sf):
    """L2 as a Structured Streaming job: purchase events folded per
    micro-batch (foreachBatch, per-epoch deltas), state read back."""
    import os

    from ..streaming import ledgers as SL
    d = _stream_dir(spark)
    q = SL.start_loyalty_stream(spark, os.path.join(sf, "events.parquet"), f"{d}/state", f"{d}/ckpt")
    q.awaitTermination()
    return SL.loyalty_from_deltas(spark, D.customers(spark, sf), f"{d}/state")


@register("l03s_stock_stream", None)
def l03s(spark, sf):
    """L3 as a Structured Streaming job over the event log."""
    import os

    from ..streaming import ledgers as SL
    d = _stream_dir(spark)
    q = SL.start_stock_stream(spark, os.path.join(sf, "events.parquet"), f"{d}/state", f"{d}/ckpt", EVENT_STOCK_DELTA)
    q.awaitTermination()
    return SL.stock_from_deltas(spark, D.inventory(spark, sf), f"{d}/state")


def _event_stream(spark, sf):
    import os

    from ..streaming import ledgers as SL
    return SL.read_event_stream(spark, os.path.join(sf, "events.parquet"))


def _order_stream(spark, sf) -> str:
    """L4 run over the event log; where its state lies."""
    from ..streaming import order_status as OS
    d = _stream_dir(spark)
    ev = _event_stream(spark, sf).select(F.col("user_id").alias("order_id"), "event_id", "ts",
                                         _map("event_type", EVENT_STATUS).alias("status"))
    OS.start_order_stream(ev, f"{d}/state", f"{d}/ckpt").awaitTermination()
    return f"{d}/state"


@register("l04s_order_stream", None)
def l04s(spark, sf):
    """L4 as a Structured Streaming job with keyed state: order status."""
    from ..streaming import order_status as OS
    return OS.orders_now(spark, _order_stream(spark, sf))


@register("l04s_illegal_stream", None)
def l04si(spark, sf):
    """L4 as a Structured Streaming job with keyed state: status changes that are not allowed."""
    from ..streaming import order_status as OS
    return OS.illegal_now(spark, _order_stream(spark, sf))


def _payment_stream(spark, sf):
    return _event_stream(spark, sf).where("event_type = 'purchase'").select(
        F.col("event_id").alias("payment_id"), F.col("ts").alias("paid_at"), F.col("user_id").alias("order_id"), "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"), round_even("value", 2).alias("tip_amount"))


@register("l05s_duplicate_payments_stream", None)
def l05s(spark, sf):
    """L5 as a Structured Streaming job: payments once each, counted by tab."""
    from ..streaming import payments as P
    d = _stream_dir(spark)
    P.start_payment_counts(_payment_stream(spark, sf), ["user_id", "k"], f"{d}/state", f"{d}/ckpt").awaitTermination()
    return P.duplicates_now(spark, f"{d}/state", ["user_id", "k"])


@register("l06s_payments_stream", None)
def l06s(spark, sf):
    """L6 as a stream-stream join of orders and payments."""
    import os

    from ..streaming import payments as P
    d = _stream_dir(spark)
    path = os.path.join(sf, "orders.parquet")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = reader.option("pathGlobFilter", os.path.basename(path)).parquet(sf) if _is_file(spark, path) else reader.parquet(path)
    placed = stream.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("ordered_at"))
    P.start_payment_stream(placed, _payment_stream(spark, sf), f"{d}/state", f"{d}/ckpt").awaitTermination()
    o = _totals(spark, sf).join(D.orders(spark, sf).select(F.col("id").alias("order_id"), "status"), "order_id")
    out = P.orders_with_payments(spark, o, f"{d}/state")
    return out.select("order_id", *[F.col(c).cast("double").alias(c) for c in
                                    ("subtotal", "tax_amount", "discount_amount", "tip_amount", "total")], "status")


def _is_file(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


# the streamed ledgers must equal the batch ledgers: same oracle SQL
REGISTRY["l02s_loyalty_stream"].sql = REGISTRY["l02_loyalty_state"].sql
REGISTRY["l03s_stock_stream"].sql = REGISTRY["l03_stock_state"].sql
REGISTRY["l04s_order_stream"].sql = REGISTRY["l04_order_state"].sql
REGISTRY["l04s_illegal_stream"].sql = REGISTRY["l04_illegal_transitions"].sql
REGISTRY["l05s_duplicate_payments_stream"].sql = REGISTRY["l05_duplicate_payments"].sql
REGISTRY["l06s_payments_stream"].sql = REGISTRY["l06_apply_payments"].sql
