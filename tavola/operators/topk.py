"""Exact top-n dot products between sparse rows, with postings that cannot matter left out.

Both sides are (id, term, weight) with positive weights.  A left row's terms are
taken rarest first.  ``rest`` of a term is the most that it and all later terms
can add: the sum of the row's weights times the largest weight of each term.

1. The first terms, as many as their postings allow, give partial products with
   the rows that share them.  The n-th largest is a floor for the row's n-th best.
2. Only terms whose ``rest`` reaches the floor can bring in a row that the top n
   needs; later, frequent terms are not joined for candidates at all.
3. A candidate whose products so far and the rest of the other terms together
   miss the floor goes.  For those that stay the other terms are added, each one
   by an equi join on (row, term).

Rounding and equal scores are kept exact: the floor is lowered by what rounding
to ``digits`` can hide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_even
from ..session import ensure_checkpoint_dir


def top_products(left: DataFrame, right: DataFrame, n: int, digits: int, other_than_self: bool = False,
                 probe: int = 64) -> DataFrame:
    """``id``, ``other``, ``score``, ``rank``: for each left row the ``n`` right rows of the largest rounded product over 0.

    Equal scores go to the smaller id.  ``probe``: postings a wanted row that
    the first step reads for each left row, at least those of its rarest term.
    Weights of 0, and nulls, bring nothing."""
    ensure_checkpoint_dir(left.sparkSession)
    b = right.where("w > 0").select(F.col("id").alias("other"), "term", F.col("w").alias("wb"))
    stats = b.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("wb").alias("most"))
    by_rarity = Window.partitionBy("id").orderBy("df", "term")
    a = (left.where("w > 0").select("id", "term", F.col("w").alias("wa")).join(stats, "term")
         .withColumn("read", F.sum("df").over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)))
         .withColumn("rest", F.sum(F.col("wa") * F.col("most")).over(by_rarity.rowsBetween(0, Window.unboundedFollowing)))
         .select("id", "term", "wa", "rest", F.coalesce("read", F.lit(0)).alias("read")).checkpoint())

    def products(terms: DataFrame) -> DataFrame:
        pairs = terms.join(b, "term")
        if other_than_self:
            pairs = pairs.where(F.col("id") != F.col("other"))
        return pairs.groupBy("id", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("part"))

    slack = 0.5 * 10.0 ** -digits + 1e-9
    nth = Window.partitionBy("id").orderBy(F.desc("part"))
    floor = (products(a.where(F.col("read") < probe * n)).withColumn("_k", F.row_number().over(nth)).where(F.col("_k") <= n)
             .groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("part").alias("_part"))
             .select("id", F.when(F.col("_n") == n, F.bround("_part", digits) - 2 * slack).otherwise(0.0).alias("floor")))
    a = a.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    joined = F.col("rest") >= F.col("floor")
    outside = a.where(~joined).groupBy("id").agg(F.max("rest").alias("outside"), F.first("floor").alias("floor"))
    found = products(a.where(joined)).join(outside, "id", "left")
    found = found.where(F.col("outside").isNull() | (F.col("part") + F.col("outside") >= F.col("floor")))
    more = (found.where(F.col("outside").isNotNull()).select("id", "other").join(a.where(~joined).select("id", "term", "wa"), "id")
            .join(b, ["other", "term"]).groupBy("id", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("more")))
    whole = (found.join(more, ["id", "other"], "left")
             .select("id", "other", round_even(F.col("part") + F.coalesce("more", F.lit(0.0)), digits).alias("score")).where("score > 0"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("other"))
    return whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
