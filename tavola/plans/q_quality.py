"""Data quality queries (Q*) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import customers as C
from ..operators import quality as Q
from ..operators import reports as R
from ..sources import driver as D
from .registry import AS_OF, register
from .sqlviews import VIEWS, floor_days, with_views

T = f"TIMESTAMP '{AS_OF}'"

# Spark column types of the views used below (the profile reports them).
TX_TYPES = [("order_id", "bigint"), ("customer_id", "bigint"), ("item_id", "bigint"), ("item_name", "string"),
            ("category", "string"), ("subcategory", "string"), ("quantity", "bigint"), ("total_price", "double"),
            ("unit_price", "double"), ("discount_amount", "double"), ("ts", "timestamp_ntz"), ("status", "string"),
            ("transaction_id", "string")]
MI_COLS = ["id", "name", "description", "category", "subcategory", "price", "cost", "prep_time_minutes",
           "is_vegetarian", "is_vegan", "is_gluten_free", "is_active"]
CU_COLS = ["customer_id", "name", "nation", "segment", "balance", "loyalty_points", "loyalty_tier", "is_active"]


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _fail_sql(r: Q.Rule) -> str:
    c, k, v = f'"{r.column}"', r.check, r.value
    if k == "not_null":
        return f"COUNT(*) FILTER (WHERE {c} IS NULL)"
    if k == "unique":
        return (f"COUNT(*) - COUNT(DISTINCT {c}) - CASE WHEN COUNT(*) FILTER (WHERE {c} IS NULL) > 0 "
                "THEN 1 ELSE 0 END")
    if k == "ge":
        return f"COUNT(*) FILTER (WHERE {c} < {_lit(v)})"
    if k == "le":
        return f"COUNT(*) FILTER (WHERE {c} > {_lit(v)})"
    if k == "min_len":
        return f"COUNT(*) FILTER (WHERE length({c}) < {v})"
    if k == "max_len":
        return f"COUNT(*) FILTER (WHERE length({c}) > {v})"
    if k == "in_set":
        return f"COUNT(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({', '.join(_lit(x) for x in v)}))"
    if k == "regex":
        return f"COUNT(*) FILTER (WHERE {c} IS NOT NULL AND NOT regexp_matches(CAST({c} AS VARCHAR), {_lit(v)}))"
    raise ValueError(k)


def rules_sql(table_sql: str, columns: list[str], rules, name: str, strict: bool = False) -> str:
    """SQL twin of ``quality.run_rules`` for a table with known columns."""
    cols = set(columns)
    present = [r for r in rules if r.column in cols]
    missing = sorted({r.column for r in rules if r.column not in cols})
    extra = sorted(cols - {r.column for r in rules}) if strict else []
    aggs = ", ".join([f"CAST({_fail_sql(r)} AS BIGINT) AS _r{i}" for i, r in enumerate(present)] or ["1 AS _x"])
    sel = [f"SELECT '{name}' AS schema, '{r.check}' AS \"check\", '{r.column}' AS \"column\", _r{i} AS failures, "
           f"_r{i} = 0 AS passed FROM one" for i, r in enumerate(present)]
    sel += [f"SELECT '{name}', 'present', '{m}', CAST(1 AS BIGINT), false" for m in missing]
    sel += [f"SELECT '{name}', 'strict', '{x}', CAST(1 AS BIGINT), false" for x in extra]
    return f"WITH t AS ({table_sql}), one AS (SELECT {aggs} FROM t)\n" + "\nUNION ALL ".join(sel)


def _schema_sql(table_sql: str, columns: list[str], schema: str) -> str:
    s = Q.SCHEMAS[schema]
    return rules_sql(table_sql, columns, s.rules, s.name, s.strict)


@register("q01_validate_transactions", _schema_sql(VIEWS["tx"], [c for c, _ in TX_TYPES], "transactions"))
def q01t(spark, sf):
    """Q1 strict transactions schema (unique ids, ranges, extra columns)."""
    return Q.validate(D.transactions(spark, sf), "transactions")


@register("q01_validate_menu_items", _schema_sql(VIEWS["mi"], MI_COLS, "menu_items"))
def q01m(spark, sf):
    """Q1 menu-items schema."""
    return Q.validate(D.menu_items(spark, sf), "menu_items")


@register("q01_validate_customers", _schema_sql(VIEWS["cu"], CU_COLS, "customers"))
def q01c(spark, sf):
    """Q1 customers schema (missing declared columns are reported)."""
    return Q.validate(D.customers(spark, sf), "customers")


@register("q01_validate_daily_sales", _schema_sql(with_views("""
SELECT CAST(ts AS DATE) AS date, CAST(SUM(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
  COUNT(DISTINCT order_id) AS total_orders, CAST(SUM(quantity) AS BIGINT) AS total_items FROM tx GROUP BY 1""", "tx"),
    ["date", "total_revenue", "total_orders", "total_items"], "daily_sales"))
def q01d(spark, sf):
    """Q1 daily-sales schema over the daily aggregates."""
    daily = R.daily_aggregates(D.transactions(spark, sf)).select(
        "date", "total_revenue", "total_orders", F.col("total_items_sold").alias("total_items"))
    return Q.validate(daily, "daily_sales")


@register("q01_validate_customer_features", _schema_sql(with_views(f"""
SELECT customer_id, {floor_days(T, 'max(ts)')} AS recency_days, COUNT(*) AS frequency,
  CAST(SUM(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) AS monetary,
  CAST(SUM(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg_order_value
FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id""", "tx"),
    ["customer_id", "recency_days", "frequency", "monetary", "avg_order_value"], "customer_features"))
def q01f(spark, sf):
    """Q1 customer-features schema over RFM metrics."""
    rfm = C.rfm_metrics(D.transactions(spark, sf), AS_OF)
    feats = rfm.select("customer_id", F.col("recency").alias("recency_days"), "frequency", "monetary",
                       (F.col("monetary") / F.col("frequency")).alias("avg_order_value"))
    return Q.validate(feats, "customer_features")


_CUSTOM = [
    {"column": "status", "check": "in_set", "params": {"values": ["completed", "pending", "preparing"]}},
    {"column": "total", "check": "range", "params": {"min": 1000, "max": 400000}},
    {"column": "id", "check": "unique"},
    {"column": "customer_id", "check": "not_null"},
    {"column": "order_type", "check": "regex", "params": {"pattern": "^(dine_in|takeout)$"}},
    {"column": "table_number", "check": "not_null"},
]


def _custom_rules():
    rules = []
    for c in _CUSTOM:
        p = c.get("params", {})
        if c["check"] == "range":
            rules += [Q.Rule(c["column"], "ge", p["min"]), Q.Rule(c["column"], "le", p["max"])]
        elif c["check"] == "in_set":
            rules.append(Q.Rule(c["column"], "in_set", tuple(p["values"])))
        elif c["check"] == "regex":
            rules.append(Q.Rule(c["column"], "regex", p["pattern"]))
        else:
            rules.append(Q.Rule(c["column"], c["check"]))
    return rules


@register("q02_custom_checks", rules_sql(VIEWS["ord"], ["id", "customer_id", "status", "order_type", "total",
                                                        "created_at", "completed_at"], _custom_rules(), "custom"))
def q02(spark, sf):
    """Q2 custom checks on orders: set, range, unique, not-null, regex, missing column."""
    return Q.check(D.orders(spark, sf), _CUSTOM)


def _profile_sql() -> str:
    parts = []
    for c, t in TX_TYPES:
        num = t in ("bigint", "double", "int")
        q = f'"{c}"'
        stats = (f"min(CAST({q} AS DOUBLE)), max(CAST({q} AS DOUBLE)), round_even(avg(CAST({q} AS DOUBLE)), 6), "
                 f"round_even(stddev_samp(CAST({q} AS DOUBLE)), 6)") if num else \
            "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT COUNT(*), {len(TX_TYPES)}, '{c}', '{t}', COUNT(*) FILTER (WHERE {q} IS NULL), "
                     f"round_even(CAST(COUNT(*) FILTER (WHERE {q} IS NULL) AS DOUBLE) * 100.0 / COUNT(*), 6), "
                     f"COUNT(DISTINCT {q}), {stats} FROM tx")
    body = "\nUNION ALL ".join(parts)
    return with_views(f"""SELECT * FROM ({body}) AS p(row_count, column_count, "column", dtype, null_count, null_pct,
  unique_count, "min", "max", mean, std)""", "tx")


@register("q03_profile", _profile_sql())
def q03(spark, sf):
    """Q3 column profile of the transactions table."""
    return Q.profile(D.transactions(spark, sf))


_REQUIRED = ["transaction_id", "customer_id", "item_id", "quantity", "total_price", "ts"]


@register("q05_completeness", with_views("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"round_even(CAST(COUNT(*) - COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100.0 / COUNT(*), 6) AS completeness_pct "
    "FROM tx" for c in _REQUIRED), "tx"))
def q05(spark, sf):
    """Q5 completeness of the required transaction columns."""
    return Q.completeness(D.transactions(spark, sf), _REQUIRED)


@register("q07_rule_violations", with_views(f"""
SELECT 'positive_order_id' AS rule, COUNT(*) FILTER (WHERE NOT COALESCE(order_id > 0, false)) AS violations FROM tx
UNION ALL SELECT 'positive_quantity', COUNT(*) FILTER (WHERE NOT COALESCE(quantity > 0, false)) FROM tx
UNION ALL SELECT 'positive_price', COUNT(*) FILTER (WHERE NOT COALESCE(total_price > 0, false)) FROM tx
UNION ALL SELECT 'no_future_timestamp', COUNT(*) FILTER (WHERE NOT COALESCE(ts <= {T}, false)) FROM tx
UNION ALL SELECT 'numeric_item_id', COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(CAST(item_id AS VARCHAR), '^[0-9]+$'), false)) FROM tx
UNION ALL SELECT 'transaction_id_format', COUNT(*) FILTER (WHERE NOT COALESCE(regexp_matches(transaction_id, '^[0-9]+-[0-9]+$'), false)) FROM tx""",
                                             "tx"))
def q07(spark, sf):
    """Q7 id formats, positive numbers, no future timestamps."""
    from ..functions.timeutil import ts_lit
    return Q.rule_violations(D.transactions(spark, sf), {
        "positive_order_id": F.col("order_id") > 0,
        "positive_quantity": F.col("quantity") > 0,
        "positive_price": F.col("total_price") > 0,
        "no_future_timestamp": F.col("ts") <= ts_lit(AS_OF),
        "numeric_item_id": F.col("item_id").cast("string").rlike("^[0-9]+$"),
        "transaction_id_format": F.col("transaction_id").rlike("^[0-9]+-[0-9]+$"),
    })


@register("q08_iqr_outliers", with_views("""
SELECT tx.* FROM tx, (SELECT quantile_cont(total_price, [0.25, 0.75]) AS q FROM tx) s
WHERE total_price < s.q[1] - (s.q[2] - s.q[1]) * 1.5 OR total_price > s.q[2] + (s.q[2] - s.q[1]) * 1.5""", "tx"))
def q08(spark, sf):
    """Q8 IQR outliers of line value."""
    return Q.iqr_outliers(D.transactions(spark, sf), "total_price")


@register("q09_zscore_outliers", with_views("""
SELECT tx.* FROM tx, (SELECT COUNT(*) AS n, SUM(CAST(total_price AS DECIMAL(18,2))) AS a,
  SUM(CAST(CAST(total_price AS DECIMAL(18,2)) AS DECIMAL(38,2)) * CAST(CAST(total_price AS DECIMAL(18,2)) AS DECIMAL(38,2))) AS b
  FROM tx) m
WHERE abs((total_price - CAST(a AS DOUBLE) / CAST(n AS DOUBLE)) / sqrt(greatest((CAST(b AS DOUBLE) -
  CAST(a AS DOUBLE) * CAST(a AS DOUBLE) / CAST(n AS DOUBLE)) / (CAST(n AS DOUBLE) - 1.0), 0.0))) > 2.5""", "tx"))
def q09(spark, sf):
    """Q9 z-score outliers of line value (|z| > 2.5)."""
    return Q.zscore_outliers(D.transactions(spark, sf), "total_price", 2.5)


_DRIFT_COLS = ["quantity", "total_price", "unit_price"]


@register("q10_mean_drift", with_views("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round_even(b, 6) AS base_mean, round_even(cu, 6) AS current_mean, "
    f"round_even(abs(cu - b) / b, 6) AS drift_ratio, round_even(abs(cu - b) / b, 6) > 0.1 AS has_drift FROM "
    f"(SELECT avg(CAST({c} AS DOUBLE)) FILTER (WHERE ts < TIMESTAMP '2000-01-01') AS b, "
    f"avg(CAST({c} AS DOUBLE)) FILTER (WHERE ts >= TIMESTAMP '2000-01-01') AS cu FROM tx)" for c in _DRIFT_COLS),
    "tx"))
def q10(spark, sf):
    """Q10 mean drift of line columns, before vs after 2000."""
    tx = D.transactions(spark, sf)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    return Q.mean_drift(tx.where(F.col("ts") < cut), tx.where(F.col("ts") >= cut), _DRIFT_COLS)


_HEALTH_COLS = ["recency_days", "total_spent", "avg_order_value", "std_order_value", "orders_per_month",
                "item_diversity"]


@register("q11_feature_health", None)
def q11(spark, sf):
    """Q11 finite values and positive variance of segmentation features."""
    return Q.feature_health(C.segment_features(D.transactions(spark, sf), AS_OF), _HEALTH_COLS)


@register("q11_health_of_given_columns", """
SELECT 'p_size' AS "column", CAST(0 AS BIGINT) AS non_finite, round(var_samp(p_size), 3) AS variance, var_samp(p_size) > 0 AS healthy FROM part
UNION ALL SELECT 'cents', CAST(0 AS BIGINT), round(var_samp(p_retailprice), 3), var_samp(p_retailprice) > 0 FROM part
UNION ALL SELECT 'flat', CAST(0 AS BIGINT), 0.0, false
UNION ALL SELECT 'broken', count(*) FILTER (p_size % 7 = 0), NULL, false FROM part""")
def q11_given(spark, sf):
    """Q11 over given columns: two sound ones, one without variance, one with infinite values."""
    p = D.read(spark, sf, "part").select("p_size", F.col("p_retailprice").cast("double").alias("cents"), F.lit(1.0).alias("flat"),
                                         F.when(F.col("p_size") % 7 == 0, float("inf")).otherwise(1.0).alias("broken"))
    h = Q.feature_health(p, ["p_size", "cents", "flat", "broken"])
    return h.select("column", "non_finite", F.when(~F.isnan("variance"), F.round("variance", 3)).alias("variance"), "healthy")
