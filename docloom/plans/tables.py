"""Table-source queries: orders and lines as spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.retrieval import read
from docloom.sources import tables as S


def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as rows of a sheet: islands of order numbers less than 501 apart."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    out = S.regions(rows, "o_custkey", "o_orderkey", 500)
    return out.groupBy("o_custkey", "region").agg(F.min("o_orderkey").alias("first_row"), F.max("o_orderkey").alias("last_row"), F.count("*").alias("n"), F.max("block").alias("last_block"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation as a table: a line of names every seventh row, else figures."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("table"), F.col("c_custkey").alias("row"), "c_name", "c_mktsegment", "c_acctbal")
    text = F.col("row") % 7 == 0
    columns = [
        F.when(text, F.col("c_name")).otherwise(F.col("row").cast("string")),
        F.when(text, F.col("c_mktsegment")).otherwise(F.format_number("c_acctbal", 2)),
        F.when(F.col("row") % 5 == 0, "#N/A").otherwise(F.lit("")),
    ]
    return c.select("table", "row", F.posexplode(F.array(*columns)).alias("col", "cell"))


def grid_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells left of each nation's table: errors emptied, empty rows and columns dropped."""
    return S.squared(_cells(spark, sf_dir)).groupBy("table", "col").agg(F.count("*").alias("cells"), F.min("row").alias("first_row"))


def header_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header row of each nation's table, by numeric contrast."""
    return S.headers(S.squared(_cells(spark, sf_dir)))


def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pipe_rows(S.squared(_cells(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (table_regions, grid_clean, header_search, pipe_tables)}

_CELLS = """c AS (SELECT c_nationkey AS t, c_custkey AS row, [CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE c_custkey::VARCHAR END,
    CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE format('{:,.2f}', c_acctbal) END] AS v FROM customer),
cell AS (SELECT t, row, i::INTEGER AS col, v[i + 1] AS cell FROM c, unnest([0, 1]) AS r(i))"""

SQL = {
    "table_regions": """WITH l AS (SELECT *, coalesce((o_orderkey - lag(o_orderkey) OVER w - 1 > 500)::INTEGER, 0) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
        r AS (SELECT *, sum(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS region FROM l)
        SELECT o_custkey, region, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row, count(*) AS n, ((count(*) - 1) // 40)::INTEGER AS last_block FROM r GROUP BY o_custkey, region""",
    "grid_clean": f'WITH {_CELLS} SELECT t AS "table", col, count(*) AS cells, min(row) AS first_row FROM cell GROUP BY ALL',
    "header_search": f"""WITH {_CELLS}, r AS (SELECT t, row, count(*) FILTER (regexp_matches(cell, '^\\(?-?[0-9,]+(\\.[0-9]+)?%?\\)?$')) / count(*)::DOUBLE AS share FROM cell GROUP BY t, row),
        b AS (SELECT *, row_number() OVER w AS nth, max(share) OVER (PARTITION BY t ORDER BY row ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS below FROM r WINDOW w AS (PARTITION BY t ORDER BY row))
        SELECT t AS "table", min(row) AS header_row FROM b WHERE nth <= 12 AND share <= 0.34 AND below - share >= 0.25 GROUP BY t""",
    "pipe_tables": f"""WITH {_CELLS} SELECT t AS "table", row, '| ' || string_agg(cell, ' | ' ORDER BY col) || ' |' AS text FROM cell GROUP BY t, row""",
}
