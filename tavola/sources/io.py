"""Sources and sinks.

Every reader takes an explicit schema: nothing is inferred, so a scan of a
large CSV does not need a pass over the data to guess types, and a bad
value becomes NULL (PERMISSIVE) instead of a changed column type.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.boosting import Booster

# Stored analytic table schemas (FIXTURES.md §3).
TRANSACTIONS_SCHEMA = ("transaction_id string, order_id string, customer_id string, item_id string, "
                       "item_name string, category string, quantity int, unit_price double, total_price double, "
                       "discount_amount double, tax_amount double, timestamp string, payment_method string, "
                       "order_type string, server_id string, table_number int")
MENU_SCHEMA = ("item_id string, name string, description string, category string, subcategory string, "
               "cost double, price double, prep_time_minutes int, is_vegetarian boolean, is_vegan boolean, "
               "is_gluten_free boolean, calories int, allergens string, is_active boolean, created_at string")
CUSTOMERS_SCHEMA = ("customer_id string, first_name string, last_name string, email string, phone string, "
                    "loyalty_tier string, loyalty_points int, total_orders int, total_spent double, "
                    "average_order_value double, preferred_category string, dietary_preferences string, "
                    "created_at string, last_order_date string")
INVENTORY_SCHEMA = ("inventory_id string, ingredient_name string, category string, quantity_on_hand int, "
                    "unit string, unit_cost double, reorder_level int, reorder_quantity int, supplier_id string, "
                    "last_restocked date, expiry_date date, storage_location string")
COOCCURRENCE_SCHEMA = ("item_id_1 string, item_id_2 string, item_name_1 string, item_name_2 string, "
                       "cooccurrence_count long, support double, confidence_1_to_2 double, "
                       "confidence_2_to_1 double, lift double")
DAILY_SCHEMA = ("date date, total_revenue double, total_orders long, total_items_sold long, unique_customers long, "
                "avg_order_value double, day_of_week int, is_weekend boolean, month int, year int")
ITEM_DAILY_SCHEMA = ("date date, item_id string, item_name string, category string, quantity_sold long, "
                     "revenue double, num_orders long")
MENU_IMPORT_SCHEMA = "name string, description string, price string, cost string, category string, is_active string, image_url string"


def _read(spark: SparkSession, path: str, schema: str | StructType, fmt: str | None = None) -> DataFrame:
    """Read by column name with declared types.  CSV columns arrive as text
    (no inference pass) and are cast by name; a declared column missing from
    the file is NULL; a value that does not parse is NULL (``try_cast``)."""
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if fmt == "csv":
        raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
               .option("inferSchema", False).csv(path))
        cols = {c.lower(): c for c in raw.columns}
        sel = [(F.col(f"`{cols[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in cols
                else F.lit(None).cast(f.dataType)).alias(f.name) for f in st.fields]
        return raw.select(*sel)
    return spark.read.schema(st).format(fmt).load(path)


def _json_list(col: str):
    """JSON list text -> array<string>; NULL or bad JSON -> empty list."""
    return F.coalesce(F.from_json(F.col(col), "array<string>"), F.array().cast("array<string>"))


def load_transactions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Transactions with the timestamp parsed."""
    return _read(spark, path, TRANSACTIONS_SCHEMA, fmt).withColumn("timestamp", F.to_timestamp("timestamp"))


def load_menu_items(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Menu items; ``name`` -> ``item_name``; allergens JSON -> array (NULL -> [])."""
    df = _read(spark, path, MENU_SCHEMA, fmt)
    return (df.withColumnRenamed("name", "item_name").withColumn("allergens", _json_list("allergens"))
            .withColumn("created_at", F.to_timestamp("created_at")))


def load_customers(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """S3: customers; dietary preferences JSON -> array (NULL -> [])."""
    df = _read(spark, path, CUSTOMERS_SCHEMA, fmt)
    return (df.withColumn("dietary_preferences", _json_list("dietary_preferences"))
            .withColumn("created_at", F.to_timestamp("created_at"))
            .withColumn("last_order_date", F.to_timestamp("last_order_date")))


def load_inventory(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Inventory."""
    return _read(spark, path, INVENTORY_SCHEMA, fmt)


def load_cooccurrence(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Item co-occurrence pairs."""
    return _read(spark, path, COOCCURRENCE_SCHEMA, fmt)


def load_daily_aggregates(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Daily aggregates with the date parsed."""
    return _read(spark, path, DAILY_SCHEMA, fmt)


def load_item_daily_sales(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Item x day sales."""
    return _read(spark, path, ITEM_DAILY_SCHEMA, fmt)


def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
               lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
               properties: dict | None = None) -> DataFrame:
    """Relational source over JDBC, read in parallel ranges of a numeric
    key (the database driver jar must be on the classpath)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    return reader.load()


def import_menu(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """CSV menu import with a per-row error list.  Quoted fields are
    honoured; name and category are required; price must be > 0; a bad
    cost becomes price x 0.4; is_active is false only for 'false'.
    Returns (valid rows, rejected rows with ``errors``)."""
    raw = (spark.read.schema(MENU_IMPORT_SCHEMA).option("header", True).option("mode", "PERMISSIVE")
           .option("quote", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
           .csv(path))
    price = F.col("price").try_cast("double")
    cost = F.col("cost").try_cast("double")
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, F.lit("Name is required")),
        F.when(price.isNull() | F.isnan(price) | (price <= 0), F.lit("Invalid price")),
        F.when(F.coalesce(F.length("category"), F.lit(0)) == 0, F.lit("Category is required"))))
    parsed = raw.select(
        F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(price, F.lit(0.0)).alias("price"),
        F.coalesce(cost, F.coalesce(price, F.lit(0.0)) * 0.4).alias("cost"),
        F.coalesce("category", F.lit("")).alias("category"),
        (F.lower(F.coalesce("is_active", F.lit("true"))) != "false").alias("is_active"),
        F.coalesce("image_url", F.lit("")).alias("image_url"), errors.alias("errors"))
    return parsed.where(F.size("errors") == 0).drop("errors"), parsed.where(F.size("errors") > 0)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None, mode: str = "overwrite",
                fmt: str = "parquet") -> None:
    """Table sink; large fact tables are written partitioned by date so
    later scans prune partitions."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def save_model(model, path: str, metadata: dict | None = None) -> None:
    """Persist a boosted model or a Spark ML one (PipelineModel), with a JSON metadata file."""
    spark = SparkSession.active()
    if isinstance(model, Booster):
        model.save(spark, os.path.join(path, "booster"))
    else:
        model.write().overwrite().save(path)
    if metadata is not None:
        spark.createDataFrame([(json.dumps(metadata, default=str),)], "metadata string") \
            .coalesce(1).write.mode("overwrite").text(os.path.join(path, "tavola_metadata"))


def load_model(path: str):
    """Load a saved model and its metadata (or None)."""
    spark = SparkSession.active()
    try:
        model = Booster.load(spark, os.path.join(path, "booster"))
    except AnalysisException:  # no such folder: a Spark ML model
        from pyspark.ml import PipelineModel
        model = PipelineModel.load(path)
    meta = None
    mpath = os.path.join(path, "tavola_metadata")
    try:
        rows = spark.read.text(mpath).collect()
        meta = json.loads(rows[0][0]) if rows else None
    except Exception:  # noqa: BLE001 - metadata is optional
        meta = None
    return model, meta


def save_embeddings(df: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding") -> None:
    """(id, array<float>) as Parquet."""
    df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("embedding")) \
        .write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Read (id, embedding) vectors."""
    return spark.read.parquet(path)
