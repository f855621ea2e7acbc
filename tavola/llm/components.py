"""Connected components of a link table, by alternating large and small stars.

Each round hangs every node's larger neighbours (large star), then its smaller
ones (small star), on the smallest node in sight, until each component is one
star around its smallest node: a logarithmic number of rounds.  The smallest and
the largest neighbour of every node, which a round starts from, tell whether it
is needed: in stars no node has a smaller neighbour and another one.  Links never
leave Spark; each round is a table in the shared folder, deleted when it has served.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node that has a link to another one: a written table.

    Repeated links and links in both directions count once; a link of a node
    with itself or with a null is none; no links give no rows; other columns
    are ignored.
    """
    edges = (links.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).transform(written))
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = (both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("high"))
                  .select("u", F.least("u", "m").alias("m"), F.expr("m < u AND m < high").alias("open")).transform(written))
        if not lowest.agg(F.bool_or("open")).first()[0]:
            forget(edges)
            return lowest.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = (edges.select(F.col("u").alias("larger"), F.col("v").alias("u")).join(lowest, "u")
                 .select(F.col("larger").alias("u"), F.col("m").alias("v")).transform(written))
        least = large.groupBy("u").agg(F.min("v").alias("m")).transform(written)
        old, edges = edges, (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                             .unionAll(least.select("u", F.col("m").alias("v"))).distinct().transform(written))
        for table in (old, lowest, large, least):
            forget(table)
