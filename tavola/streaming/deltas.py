"""Per-epoch output of streams, read as one table and compacted.

A micro-batch is written under ``deltas/epoch=<n>`` with overwrite of that epoch
only, so a replayed batch replaces its own rows.  ``compact`` folds all epochs so
far into ``base/epoch=<n>`` (the highest it holds) and then removes them; a reader
takes the newest finished base and the epochs above it, so a compaction that
stops half-way is harmless.  It must not run while an epoch is being written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def writer(state_path: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """A foreachBatch function that writes the epoch's rows, with its number as a column."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.withColumn("epoch", F.lit(epoch_id).cast("long")).write.mode("overwrite").parquet(f"{state_path}/deltas/epoch={epoch_id}")
    return write


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """Epoch -> folder, of the finished ones."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return {}
    out = {}
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        if name.startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out[int(name[6:])] = status.getPath().toString()
    return out


def _live(spark: SparkSession, state_path: str) -> tuple[dict[int, str], dict[int, str], list[str]]:
    bases, epochs = (_folders(spark, f"{state_path}/{k}") for k in ("base", "deltas"))
    upto = max(bases, default=-1)
    return bases, epochs, [*([bases[upto]] if bases else []), *(p for e, p in sorted(epochs.items()) if e > upto)]


def read(spark: SparkSession, state_path: str) -> DataFrame:
    """All rows of the newest base and the epochs since, with ``epoch``."""
    paths = _live(spark, state_path)[2]
    if not paths:
        raise FileNotFoundError(f"no epoch has been written under {state_path}")
    return spark.read.schema(spark.read.parquet(paths[-1]).schema).parquet(*paths)


def compact(spark: SparkSession, state_path: str, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Replace base and epochs by one base; ``fold`` reduces their rows (and gives ``epoch`` back)."""
    bases, epochs, live = _live(spark, state_path)
    upto = max([*bases, *epochs], default=-1)
    if upto < 0 or upto in bases:  # nothing since the last one
        return
    fold(read(spark, state_path)).write.mode("overwrite").parquet(f"{state_path}/base/epoch={upto}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in [p for e, p in bases.items() if e < upto] + list(epochs.values()):
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
