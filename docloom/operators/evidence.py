"""Checking evidence and answers: sums, differences, versions, figures, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Tolerance of a verified relation, most summands, and how far back a difference looks.
TOLERANCE, MOST_SUMMANDS, LOOK_BACK = 0.5, 20, 8


def column_sums(cells: DataFrame, table: str, row: str, value: str) -> DataFrame:
    """Cells equal to the sum of the 2 to 20 cells right above them: ``table, row, operands, total``.

    Running sums turn every run into a difference of two of them, so a cell needs one value for
    each run length: a few lags, not a self-join. The longest run that fits wins."""
    w = Window.partitionBy(table).orderBy(row)
    upto = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = cells.select(table, row, F.col(value).alias("total")).withColumnRenamed("total", value)
    df = df.withColumn("__upto", upto).withColumn("__pos", F.row_number().over(w))
    before = F.collect_list("__upto").over(w.rowsBetween(-MOST_SUMMANDS, -1))
    fits = F.filter(
        F.transform(F.reverse("__before"), lambda b, i: F.when(F.abs(F.col("__upto") - b - F.col(value)) <= TOLERANCE, i + 1)),
        lambda n: n >= 2,
    )
    df = df.withColumn("__before", before).withColumn("operands", F.array_max(fits))
    return df.where("operands is not null").select(table, row, "operands", F.col(value).alias("total"))


def column_differences(cells: DataFrame, table: str, row: str, value: str) -> DataFrame:
    """Cells equal to an earlier minus a later one of the eight above: the nearest such pair."""
    w = Window.partitionBy(table).orderBy(row)
    back = F.collect_list(F.struct(F.col(row).alias("r"), F.col(value).alias("v"))).over(w.rowsBetween(-LOOK_BACK, -1))
    df = cells.select(table, row, value).withColumn("__back", F.reverse(back))
    pairs = F.flatten(
        F.transform("__back", lambda later, i: F.transform(F.slice("__back", i + 2, F.lit(LOOK_BACK)), lambda earlier: F.struct(earlier.alias("a"), later.alias("b"))))
    )
    hit = F.get(F.filter(pairs, lambda p: F.abs(p["a"]["v"] - p["b"]["v"] - F.col(value)) <= TOLERANCE), 0)
    df = df.withColumn("__hit", hit).where("__hit is not null")
    return df.select(table, row, F.col("__hit.a.r").alias("minuend"), F.col("__hit.b.r").alias("subtrahend"))


def unsupported(answer: Column, evidence: Column) -> Column:
    """Numbers of three digits or more in the answer that the evidence nowhere has."""
    plain = F.regexp_replace(evidence, ",", "")
    return F.filter(T.numeric_tokens(answer), lambda n: (F.length(n) >= 3) & ~F.contains(plain, F.regexp_replace(n, ",", "")))


def previous(df: DataFrame, key: str, order: str, role: str, text: str, out: str) -> DataFrame:
    """Adds the last earlier text of the given role in the same conversation."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(F.col("role") == role, F.col(text)), ignorenulls=True).over(w))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct terms over the smaller number of distinct terms; 0 without terms."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)
