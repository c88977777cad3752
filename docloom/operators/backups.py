"""Backups that are checked without comparing rows: digests of parts, and a tree over them.

A part's digest is the sum of its rows' hashes: it depends on no order, and counts repeated rows. Digests
of parts add up to those of groups of parts, and to one of the whole. Two tables are compared from the top:
only the children of what differs are looked at, down to the parts, which alone are then restored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.store import stored

#: Parts of a table, and parts or groups under one node.
PARTS, FANOUT = 256, 16
NODE = "level int, node int, rows long, digest string"
SAVED = "__part"


def part_of(key: Column, parts: int = PARTS) -> Column:
    """A row's part: by an integer key itself, else by its hash."""
    return F.pmod(key, F.lit(parts)).cast("int")


def tree(df: DataFrame, part: Column, parts: int = PARTS) -> DataFrame:
    """``level, node, rows, digest``: level 0 is the whole, the last level the parts. Null columns count as
    such; a column ``__part`` is no part of a row; maps can't be hashed. An empty part has no node."""
    columns = sorted(c for c in df.columns if c != SAVED)
    # two hashes with other seeds: 128 bits, summed apart; nulls are marked, as the hash skips them
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    wide = lambda *more: F.xxhash64(*more, *marked).cast("decimal(38,0)")
    per = df.select(part.alias("node"), wide().alias("a"), wide(F.lit("again")).alias("b"))
    sums = (F.sum("rows").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    now = stored(per.groupBy("node").agg(F.count("*").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b")))
    levels, size = [now], parts
    while size > 1:
        size = -(-size // FANOUT)
        now = now.groupBy(F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(*sums)
        levels.append(now)
    out = None
    for level, nodes in enumerate(reversed(levels)):
        said = nodes.select(F.lit(level).alias("level"), "node", "rows", F.concat_ws(":", "a", "b").alias("digest"))
        out = said if out is None else out.unionByName(said)
    return out


def differing(ours: DataFrame, theirs: DataFrame, parts: int = PARTS) -> DataFrame:
    """``part, ours, theirs`` of two trees: rows of the parts that differ. Each level looks only below what
    differs above it; equal tables end at the root."""
    ours, theirs = stored(ours), stored(theirs)
    depth, size = 0, parts
    while size > 1:
        depth, size = depth + 1, -(-size // FANOUT)
    other = theirs.select("level", "node", F.col("rows").alias("r"), F.col("digest").alias("d"))
    both = ours.join(other, ["level", "node"], "full").where(~F.col("digest").eqNullSafe(F.col("d")))
    found = both.where("level = 0")
    for level in range(1, depth + 1):
        above = found.select(F.col("node").alias("up"))
        found = both.where(F.col("level") == level).join(above, F.floor(F.col("node") / FANOUT) == F.col("up"), "left_semi")
    rows = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select(F.col("node").alias("part"), rows(F.col("rows")).alias("ours"), rows(F.col("r")).alias("theirs"))


def backup(df: DataFrame, part: Column, path: str, parts: int = PARTS) -> None:
    """Rows by part, and the tree that they have: written last, so a backup without one is not finished."""
    df.withColumn(SAVED, part).hint("rebalance", SAVED).write.partitionBy(SAVED).parquet(f"{path}/rows")
    tree(df, part, parts).write.parquet(f"{path}/tree")


def saved(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A backup's rows, with ``__part``, and its tree. Files that are lost or can't be read give no rows."""
    rows = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    rows = rows.schema(f"{schema}, {SAVED} int") if schema else rows
    return rows.parquet(f"{path}/rows"), spark.read.schema(NODE).parquet(f"{path}/tree")


def drill(spark: SparkSession, path: str, schema: str | None = None, parts: int = PARTS) -> DataFrame:
    """``part, ours, theirs`` where a backup's rows no longer have the digests that they were saved with: a
    restore would not give back what was there. No row: the backup is good."""
    rows, was = saved(spark, path, schema)
    return differing(tree(rows, F.col(SAVED), parts), was, parts)


def restored(live: DataFrame, part: Column, path: str, parts: DataFrame) -> DataFrame:
    """``live`` with the backup's rows in the given parts (``part``), of which alone the backup is read. They are no
    more than a tree has parts, so they are broadcast."""
    wanted = F.broadcast(parts.select(F.col("part").alias("__p")))
    rows, _ = saved(live.sparkSession, path)
    kept = live.join(wanted, part == F.col("__p"), "left_anti")
    back = rows.join(wanted, F.col(SAVED) == F.col("__p"), "left_semi").drop(SAVED)
    return kept.unionByName(back.select(*live.columns))
