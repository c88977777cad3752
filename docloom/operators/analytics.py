"""Log analytics: percentiles, calendars, sessions, limits, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.store import stored


def nearest_rank(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: the value at index ``round(p * (n - 1))``, halves to even."""
    return at_ranks(df, group, value, {name: lambda n, p=p: F.bround(F.lit(p) * (n - 1), 0) for name, p in shares.items()})


def medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``group, median, n``: the middle value of each group, or half the sum of the two in the middle."""
    two = at_ranks(df, group, value, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)})
    return two.select(*group, ((F.col("low") + F.col("high")) / 2).alias("median"), "n")


def at_ranks(df: DataFrame, group: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Of each group the values at some ranks (from 0, of its number of values), and that number, ``n``.

    Equal values are counted first, in every task. The counts are sorted by ranges of group and value,
    so that no group is in one task; the ranges' totals say in which range an index lies, and only
    that one is counted up to it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    placed = stored(counts.repartitionByRange(*group, value).withColumn("__part", F.spark_partition_id()))
    parts = placed.groupBy(*group, "__part").agg(F.sum("__n").alias("__sum"))
    all_ = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # a row for each range
    upto = F.sum("__sum").over(all_.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("__upto", upto).withColumn("__all", F.sum("__sum").over(all_))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("__all")).cast("double").alias("at")) for name, rank in ranks.items()])
    parts = parts.select(*group, "__part", (F.col("__upto") - F.col("__sum")).alias("__before"), "__upto", "__all", F.explode(wanted).alias("w"))
    parts = parts.withColumn("__at", F.col("w.at")).where((F.col("__before") <= F.col("__at")) & (F.col("__at") < F.col("__upto")))
    inside = placed.join(parts, [*group, "__part"])
    here = Window.partitionBy(*group, "__part", "w").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__now", F.col("__before") + F.sum("__n").over(here)).where(F.col("__now") > F.col("__at"))
    first = inside.groupBy(*group, F.col("w.name").alias("name")).agg(F.min(value).alias("v"), F.first("__all").alias("n"))
    return first.groupBy(*group).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ranks], F.max("n").alias("n"))


def calendar(days: DataFrame, day: str) -> DataFrame:
    """Every day from the first to the last of ``day``, one row each."""
    return days.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias(day))


def sessions(df: DataFrame, key: str, ts: Column, gap_seconds: int) -> DataFrame:
    """Numbers the sessions of each key: a gap longer than ``gap_seconds`` starts the next."""
    w = Window.partitionBy(key).orderBy("__at", "event_id")
    timed = df.withColumn("__at", ts)
    starts = F.coalesce((F.col("__at") - F.lag("__at").over(w) > gap_seconds).cast("int"), F.lit(0))
    return timed.withColumn("__starts", starts).withColumn("session", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def most_at_once(df: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """Most intervals open at once for each key: a running sum of starts and ends, ends first."""
    marks = df.select(key, F.explode(F.array(F.struct(start.alias("at"), F.lit(1).alias("step")), F.struct(end.alias("at"), F.lit(-1).alias("step")))).alias("m"))
    open_now = F.sum("m.step").over(Window.partitionBy(key).orderBy("m.at", "m.step").rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("open", open_now).groupBy(key).agg(F.max("open").alias("most"))


def retention(days: DataFrame, day: str, daily: int, weekly: int) -> DataFrame:
    """Days to keep: the newest ``daily`` ones, then of each of the last ``weekly`` weeks that have days
    besides those the newest of these. One row for each day is ranked, whatever the log's size."""
    every = Window.partitionBy(F.lit(0)).orderBy(F.desc(day))
    d = days.select(day).distinct().withColumn("nth", F.row_number().over(every)).withColumn("week", F.date_trunc("week", F.col(day)).cast("date"))
    rest = F.col("nth") > daily
    newest = F.row_number().over(Window.partitionBy("week", rest).orderBy(F.desc(day))) == 1
    d = d.withColumn("by_week", rest & newest)
    week_no = F.when(F.col("by_week"), F.sum(F.col("by_week").cast("int")).over(every.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("kept", F.when(~rest, "daily").when(week_no <= weekly, "weekly").otherwise("dropped"))


def over_limit(df: DataFrame, key: str, at: str, seconds: int, most: int, order: str) -> DataFrame:
    """Rows that come when their key has had ``most`` others in the seconds before: a sliding window."""
    seen = F.count("*").over(Window.partitionBy(key).orderBy(F.floor(F.col(at) * 1000).cast("long")).rangeBetween(-seconds * 1000, 0)) - 1
    return df.withColumn("__seen", seen).select(key, order, (F.col("__seen") < most).alias("allowed"))
