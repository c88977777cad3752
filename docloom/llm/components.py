"""Connected components of a graph of ordered ids (longs, digests), by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stored

MOST_ROUNDS = 60


def _sum(edges: DataFrame) -> tuple:
    # decimal: sums of hashes don't fit a long
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(edges: DataFrame) -> DataFrame:
    """``id, root`` for every node of the undirected edges ``a, b``; root is the smallest id of
    the node's component. Loops and repeated edges do no harm; without edges there are no rows.

    Each round links the larger neighbours of every node to its smallest one, then the node and
    its smaller neighbours too; depths halve, so rounds grow with the logarithm of the longest
    chain. Smallest neighbours are aggregated before the shuffle, and the join that hands them
    out is an equi-join that adaptive execution may split. Rounds are stored, never collected."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    was = None
    for _ in range(MOST_ROUNDS):
        mark = _sum(now)
        if mark == was or not mark[0]:
            break
        was = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.*").where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    own = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(own)
