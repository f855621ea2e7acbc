"""Data quality.

Every rule of a schema becomes one conditional count, and all counts of a
table are computed in a single aggregation pass (one scan, one tiny
shuffle).  The report is a table ``(schema, check, column, failures,
passed)`` instead of an exception, so it can be stored (Q4) and compared.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_even
from ..functions.bins import exact_quantiles
from ..functions.scalars import scalar_struct, scalar_value
from ..functions.stats import mean_of, s1, s2, std_of


@dataclass(frozen=True)
class Rule:
    column: str
    check: str          # not_null | unique | ge | le | min_len | max_len | in_set | regex | type
    value: Any = None


@dataclass(frozen=True)
class Schema:
    name: str
    rules: tuple[Rule, ...]
    strict: bool = False


def _rules(spec: Mapping[str, dict]) -> tuple[Rule, ...]:
    out = []
    for col, opts in spec.items():
        if not opts.get("nullable", False):
            out.append(Rule(col, "not_null"))
        for key in ("unique", "ge", "le", "min_len", "max_len", "in_set", "regex", "type"):
            if key in opts and opts[key] is not False:
                out.append(Rule(col, key, None if key == "unique" else opts[key]))
    return tuple(out)


# The five declared schemas (column -> rules), in the
# application's column names.
SCHEMAS = {
    "transactions": Schema("transactions", _rules({
        "transaction_id": {"unique": True},
        "ts": {},
        "customer_id": {"nullable": True},
        "item_id": {},
        "item_name": {},
        "quantity": {"ge": 1, "le": 100},
        "unit_price": {"ge": 0, "le": 1000},
        "total_price": {"ge": 0},
    }), strict=True),
    "menu_items": Schema("menu_items", _rules({
        "id": {"unique": True},
        "name": {"min_len": 1, "max_len": 200},
        "category": {},
        "subcategory": {"nullable": True},
        "price": {"ge": 0, "le": 500},
        "cost": {"ge": 0, "nullable": True},
        "prep_time_minutes": {"ge": 0, "le": 180, "nullable": True},
    })),
    "customers": Schema("customers", _rules({
        "customer_id": {"unique": True},
        "first_name": {},
        "last_name": {},
        "email": {"nullable": True},
        "phone": {"nullable": True},
        "registration_date": {},
        "total_orders": {"ge": 0, "nullable": True},
        "total_spent": {"ge": 0, "nullable": True},
    })),
    "daily_sales": Schema("daily_sales", _rules({
        "date": {},
        "total_revenue": {"ge": 0},
        "total_orders": {"ge": 0},
        "total_items": {"ge": 0},
    })),
    "customer_features": Schema("customer_features", _rules({
        "customer_id": {"unique": True},
        "recency_days": {"ge": 0},
        "frequency": {"ge": 1},
        "monetary": {"ge": 0},
        "avg_order_value": {"ge": 0},
    })),
}


def _fail_expr(rule: Rule) -> Column:
    c = F.col(rule.column)
    k, v = rule.check, rule.value
    if k == "not_null":
        return F.count_if(c.isNull())
    if k == "unique":
        # duplicates beyond the first occurrence, NULL counted as one value
        return (F.count(F.lit(1)) - F.countDistinct(c)
                - F.when(F.count_if(c.isNull()) > 0, 1).otherwise(0))
    if k == "ge":
        return F.count_if(c < F.lit(v))
    if k == "le":
        return F.count_if(c > F.lit(v))
    if k == "min_len":
        return F.count_if(F.length(c) < v)
    if k == "max_len":
        return F.count_if(F.length(c) > v)
    if k == "in_set":
        return F.count_if(c.isNotNull() & ~c.isin(*v))
    if k == "regex":
        return F.count_if(c.isNotNull() & ~c.cast("string").rlike(v))
    if k == "type":
        return F.count_if(c.isNotNull() & c.cast("string").try_cast(v).isNull())
    raise ValueError(f"unknown check {k}")


def run_rules(df: DataFrame, rules: Sequence[Rule], schema_name: str, strict: bool = False,
              declared: Sequence[str] | None = None) -> DataFrame:
    """Evaluate rules in one pass; missing columns and (strict) extra columns
    are reported without touching the data."""
    cols = set(df.columns)
    present = [r for r in rules if r.column in cols]
    missing = sorted({r.column for r in rules if r.column not in cols})
    extra = sorted(cols - set(declared or [r.column for r in rules])) if strict else []
    aggs = [_fail_expr(r).cast("long").alias(f"_r{i}") for i, r in enumerate(present)]
    rows = [F.struct(F.lit(r.check).alias("check"), F.lit(r.column).alias("column"),
                     F.col(f"_r{i}").alias("failures")) for i, r in enumerate(present)]
    rows += [F.struct(F.lit("present").alias("check"), F.lit(m).alias("column"),
                      F.lit(1).cast("long").alias("failures")) for m in missing]
    rows += [F.struct(F.lit("strict").alias("check"), F.lit(x).alias("column"),
                      F.lit(1).cast("long").alias("failures")) for x in extra]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    return (one.select(F.explode(F.array(*rows)).alias("_r"))
            .select(F.lit(schema_name).alias("schema"), "_r.check", "_r.column", "_r.failures",
                    (F.col("_r.failures") == 0).alias("passed")))


def validate(df: DataFrame, schema: str | Schema, sample_fraction: float | None = None,
             seed: int = 42) -> DataFrame:
    """Q1: validate against a declared schema.  ``sample_fraction`` validates
    a seeded sample instead of the whole table (the reference option)."""
    sch = SCHEMAS[schema] if isinstance(schema, str) else schema
    data = df.sample(fraction=sample_fraction, seed=seed) if sample_fraction else df
    return run_rules(data, sch.rules, sch.name, sch.strict)


def check(df: DataFrame, checks: Sequence[dict], name: str = "custom") -> DataFrame:
    """Q2: custom checks ``{"column", "check", "params"}``: not_null, unique,
    range (min/max), in_set (values), regex (pattern); missing columns reported."""
    rules = []
    for c in checks:
        col, kind, p = c["column"], c["check"], c.get("params", {})
        if kind == "range":
            if p.get("min") is not None:
                rules.append(Rule(col, "ge", p["min"]))
            if p.get("max") is not None:
                rules.append(Rule(col, "le", p["max"]))
        elif kind == "in_set":
            rules.append(Rule(col, "in_set", tuple(p.get("values", []))))
        elif kind == "regex":
            rules.append(Rule(col, "regex", p["pattern"]))
        else:
            rules.append(Rule(col, kind))
    return run_rules(df, rules, name)


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Q3: one row per column: type, nulls, % null, distinct, and for numeric
    columns min, max, mean, sample std.

    The plain statistics are one aggregation pass.  Exact distinct counts come
    from (column, hash of value, value) rows, deduplicated inside each task
    before the shuffle: a dozen ``countDistinct`` in one aggregate would expand
    every row a dozenfold.  ``approx`` counts with HyperLogLog instead."""
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"_null{i}"))
        if approx:
            aggs.append(F.approx_count_distinct(c).alias(f"_dist{i}"))
        if f.dataType.simpleString() in _NUMERIC:
            d = c.cast("double")
            aggs += [F.min(d).alias(f"_min{i}"), F.max(d).alias(f"_max{i}"),
                     F.avg(d).alias(f"_mean{i}"), F.stddev_samp(d).alias(f"_std{i}")]
    one = df.agg(*aggs)
    if not approx:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{f.name}`").cast("string").alias("v"))
                          for i, f in enumerate(df.schema.fields)])
        values = df.select(F.explode(cells).alias("c")).select("c.i", "c.v").where(F.col("v").isNotNull()).distinct()
        counts = values.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
        found = counts.agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m")).scalar()  # a row a column
        one = one.select("*", *[F.coalesce(found[i], F.lit(0)).alias(f"_dist{i}") for i in range(len(df.columns))])
    rows = []
    for i, f in enumerate(df.schema.fields):
        num = f.dataType.simpleString() in _NUMERIC
        nul = F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"_null{i}").cast("long").alias("null_count"),
            round_even(F.col(f"_null{i}") * 100.0 / F.col("_n"), 6).alias("null_pct"),
            F.col(f"_dist{i}").cast("long").alias("unique_count"),
            (F.col(f"_min{i}") if num else nul).alias("min"), (F.col(f"_max{i}") if num else nul).alias("max"),
            (round_even(F.col(f"_mean{i}"), 6) if num else nul).alias("mean"),
            (round_even(F.col(f"_std{i}"), 6) if num else nul).alias("std")))
    return (one.select("_n", F.explode(F.array(*rows)).alias("_r"))
            .select(F.col("_n").alias("row_count"), F.lit(len(df.columns)).alias("column_count"), "_r.*"))


def append_report(report: DataFrame, path: str) -> None:
    """Q4: append a validation report (with a run timestamp) to a table."""
    report.withColumn("validated_at", F.current_timestamp()).write.mode("append").parquet(path)


def completeness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q5: non-null count and completeness (%) of required columns."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_m{i}")
                                                   for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").cast("long").alias("null_count"),
                     round_even((F.col("_n") - F.col(f"_m{i}")) * 100.0 / F.col("_n"), 6).alias("completeness_pct"))
            for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Q7: rows violating each named rule (a Column that must be true)."""
    one = df.agg(*[F.count_if(~F.coalesce(cond, F.lit(False))).cast("long").alias(f"_v{i}")
                   for i, cond in enumerate(rules.values())])
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"_v{i}").alias("violations"))
            for i, name in enumerate(rules)]
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Q8: rows outside [q1 - k*iqr, q3 + k*iqr] (exact linear quartiles)."""
    q = scalar_value(exact_quantiles(df, col, [0.25, 0.75]))
    q1, q3 = q[0], q[1]
    lo, hi = q1 - (q3 - q1) * k, q3 + (q3 - q1) * k
    x = F.col(col).cast("double")
    return df.where((x < lo) | (x > hi))


def zscore_outliers(df: DataFrame, col: str, z: float = 3.0) -> DataFrame:
    """Q9: rows with |x - mean| / sample std > z (exact decimal moments)."""
    m = scalar_struct(df.agg(F.count(F.lit(1)).alias("n"), s1(col).alias("a"), s2(col).alias("b")))
    mean = mean_of(m["a"], m["n"])
    std = std_of(m["a"], m["b"], m["n"])
    x = F.col(col).cast("double")
    return df.where(F.abs((x - mean) / std) > z)


def mean_drift(base: DataFrame, cur: DataFrame, cols: Sequence[str], tol: float = 0.1) -> DataFrame:
    """Q10: per column mean in both tables, relative change, drift flag (> tol)."""
    b = base.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    c_ = cur.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    sb, sc = scalar_struct(b), scalar_struct(c_)
    rows = [F.struct(F.lit(c).alias("column"), sb[c].alias("base_mean"), sc[c].alias("current_mean"))
            for c in cols]
    out = b.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    ratio = F.abs(F.col("current_mean") - F.col("base_mean")) / F.col("base_mean")
    return (out.withColumn("drift_ratio", round_even(ratio, 6))
            .withColumn("has_drift", F.col("drift_ratio") > tol)
            .withColumn("base_mean", round_even("base_mean", 6))
            .withColumn("current_mean", round_even("current_mean", 6)))


def feature_health(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q11: non-finite count and sample variance per feature; healthy when
    all values are finite and the variance is positive."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).cast("long").alias(f"_bad{i}"),
                 F.var_samp(x).alias(f"_var{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_bad{i}").alias("non_finite"),
                     round_even(F.col(f"_var{i}"), 6).alias("variance"),
                     ((F.col(f"_bad{i}") == 0) & (F.coalesce(F.col(f"_var{i}"), F.lit(0.0)) > 0)).alias("healthy"))
            for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def metric_alerts(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Q12: metric rows above their limit.  ``metrics``: (key, metric, value);
    ``limits``: (metric, max_value) -- a small rule table, joined on metric."""
    return (metrics.join(limits, "metric")
            .where(F.col("value") > F.col("max_value"))
            .withColumn("alert", F.concat(F.col("metric"), F.lit(" above limit"))))


def degradation_alerts(base: DataFrame, cur: DataFrame, tol: float = 0.5, keys: Sequence[str] = ("key", "metric")) -> DataFrame:
    """Q12: relative worsening (cur - base) / base above ``tol`` per metric."""
    b = base.select(*keys, F.col("value").alias("base_value"))
    c = cur.select(*keys, F.col("value").alias("current_value"))
    j = b.join(c, list(keys))
    deg = F.when(F.col("base_value") != 0,
                 (F.col("current_value") - F.col("base_value")) / F.abs(F.col("base_value")))
    return (j.withColumn("degradation", round_even(deg, 6))
            .withColumn("degraded", F.col("degradation") > tol))
