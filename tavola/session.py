"""SparkSession helpers.

The library never builds its own session inside an operator: every operator
takes DataFrames.  ``get_spark`` is for scripts, tests and the bench; on a
cluster the session comes from ``spark-submit`` and its settings win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  UTC keeps timestamp arithmetic identical to
# the oracle; ANSI makes bad casts and x/0 fail loudly instead of silently.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tavola") -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _REQUIRED.items():
        builder = builder.config(key, value)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.driver.memory", os.environ.get("TAVOLA_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names shared storage and is taken as given.  A
    single-JVM session (``local[...]``: tests, bench) gets a scratch folder
    when it is unset; any other session without it is refused, because its
    executors could not read one another's files.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    given = sc.getCheckpointDir()
    if given:
        return given.replace("file:/", "file:///", 1) if given.startswith("file:/") and given[6:7] != "/" else given
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tavola-ckpt-")
    sc.setCheckpointDir(path)
    return f"file://{path}"


def written(df: DataFrame) -> DataFrame:
    """The table, written once to the shared folder and read back.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and the
    planner sees the true size of the files (a checkpoint keeps the estimate of
    the plan behind it, which iterations multiply without bound).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tavola-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
