"""Tables in long form (table, row, column, cell): regions, headers, clean grids, pipe tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows missing that part two tables, rows of a block, where a header may be, and
#: how numeric it may look against the rows below.
GAP, BLOCK_ROWS, HEADER_ROWS = 2, 40, 12
HEADER_SHARE, CONTRAST, LOOK_AHEAD = 0.34, 0.25, 10
#: What spreadsheets write for errors.
ERRORS = ("#REF!", "#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#VALUE!")


def regions(rows: DataFrame, sheet: str, row: str, gap: int = GAP) -> DataFrame:
    """Numbers the tables of a sheet, and 40-row blocks in them: more than ``gap`` missing row
    numbers start the next table (gaps and islands)."""
    w = Window.partitionBy(sheet).orderBy(row)
    starts = F.coalesce((F.col(row) - F.lag(row).over(w) - 1 > gap).cast("int"), F.lit(0))
    out = rows.withColumn("__s", starts).withColumn("region", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")
    nth = F.row_number().over(Window.partitionBy(sheet, "region").orderBy(row)) - 1
    return out.withColumn("block", F.floor(nth / BLOCK_ROWS).cast("int"))


def clean(cell: Column) -> Column:
    """A cell on one line, errors empty, pipes escaped, 300 characters."""
    text = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))
    return F.when(F.upper(text).isin(*ERRORS), "").otherwise(F.substring(F.replace(text, F.lit("|"), F.lit("\\|")), 1, 300))


def is_numeric(cell: Column) -> Column:
    return cell.rlike(r"^\(?-?[\d,]+(\.\d+)?%?\)?$")


def squared(cells: DataFrame) -> DataFrame:
    """Clean cells without the rows and columns that are empty throughout."""
    c = cells.withColumn("cell", clean(F.col("cell")))
    some = lambda *k: F.max((F.col("cell") != "").cast("int")).over(Window.partitionBy(*k)) == 1
    return c.withColumn("__r", some("table", "row")).withColumn("__c", some("table", "col")).where("__r and __c").drop("__r", "__c")


def headers(cells: DataFrame) -> DataFrame:
    """``table, header_row``: the first of the top twelve rows, at least half filled, that is much
    less numeric than one of the ten rows below it; a table without one has no row here."""
    filled = F.col("cell") != ""
    rows = cells.groupBy("table", "row").agg(F.count_if(filled).alias("filled"), F.count("*").alias("width"), F.count_if(filled & is_numeric(F.col("cell"))).alias("numeric"))
    rows = rows.withColumn("share", F.when(F.col("filled") > 0, F.col("numeric") / F.col("filled")).otherwise(0.0))
    w = Window.partitionBy("table").orderBy("row")
    rows = rows.withColumn("nth", F.row_number().over(w)).withColumn("below", F.max("share").over(w.rowsBetween(1, LOOK_AHEAD)))
    header = (F.col("nth") <= HEADER_ROWS) & (F.col("filled") >= 2) & (2 * F.col("filled") >= F.col("width")) & (F.col("share") <= HEADER_SHARE) & (F.col("below") - F.col("share") >= CONTRAST)
    return rows.where(header).groupBy("table").agg(F.min("row").alias("header_row"))


def pipe_rows(cells: DataFrame) -> DataFrame:
    """``table, row, text``: each row as a pipe-table line, cells in order of their column."""
    per = cells.groupBy("table", "row").agg(F.sort_array(F.collect_list(F.struct("col", "cell"))).alias("c"))
    return per.select("table", "row", F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["cell"]), " | "), F.lit(" |")).alias("text"))
