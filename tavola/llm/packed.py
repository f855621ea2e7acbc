"""Fixed-size entries shuffled as packed arrays: one row per batch and part instead of one per entry.

There is one part for each shuffle partition.  Parts are named by numbers that
Spark's hash partitioning sends to different partitions, so parts, which are
even, stay apart and each task holds one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of

DDL = "part int, entries binary"


def part_names(spark: SparkSession) -> np.ndarray:
    """A name for each part: the k-th is dealt to shuffle partition k."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tried = spark.range(32 * n + 64).select(F.col("id").cast("int").alias("name"))
    found = tried.groupBy(F.expr(f"pmod(hash(name), {n})").alias("k")).agg(F.min("name").alias("name")).collect()
    names = np.arange(n, dtype=np.int32)  # n rows; a partition that none was found for shares
    for row in found:
        names[row.k] = row["name"]
    return names


def pack(e: np.ndarray, place: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """Entries by part: number ``place`` (uint64) modulo the number of ``parts``."""
    part = parts[(place % np.uint64(len(parts))).astype(np.int64)]
    order = np.argsort(part, kind="stable")
    e, part = e[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    first = np.concatenate([[0], cuts]).astype(np.int64)[:len(e) or 0]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first]), pa.array([x.tobytes() for x in np.split(e, cuts)] if len(e) else [], pa.binary())],
        ["part", "entries"])


def packing(arrays: Iterable[tuple[np.ndarray, np.ndarray]], parts: np.ndarray, flush: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """``pack`` of (entries, places) arrays, some ``flush`` entries at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for e, place in arrays:
        if len(e):
            held.append((e, place))
            size += len(e)
        if size >= flush:
            yield pack(*map(np.concatenate, zip(*held)), parts)
            held, size = [], 0
    if held:
        yield pack(*map(np.concatenate, zip(*held)), parts)


def gathered(df: DataFrame, parts: np.ndarray) -> DataFrame:
    """Packed rows with those of one part together."""
    return df.repartition(len(parts), "part").sortWithinPartitions("part")


def parts_of(batches, kind: np.dtype) -> Iterator[np.ndarray]:
    """All entries of each part of a ``gathered`` table, part by part."""
    part, held = None, []
    for p, entries in rows_of(batches, "part", "entries"):
        if p != part and held:
            yield np.concatenate(held)
            held = []
        part = p
        held.append(np.frombuffer(entries, kind))
    if held:
        yield np.concatenate(held)


def stretches(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: the number, from 0, of the stretch of equal keys that each entry lies in."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)
