"""Measurements, conflicts and tables in text: clauses are written from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import measures as M
from docloom.operators import retrieval as R
from docloom.plans.language import content_list, listed, normal, quoted
from docloom.plans.retrieval import read

#: Orders of a customer that are compared with each other: as many as an answer has sources.
SOURCES = 12


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    # a small file is one task, but its texts are work for many; rows of a customer stay together
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("| Delay penalty rate | "), k % 4 + 1, F.lit("% |\nThe agreed delivery notice period is "), k % 3 * 15 + 15, F.lit(" days; total contract value of order AED-"), k, F.lit(" is "), F.format_number(F.floor("o_totalprice"), 0),
        F.lit(" AED dated "), F.date_format("day", "dd/MM/yyyy"), F.lit("\n11. section heading number 40 items\nretention released in 2026\nsigned on 5 March 2026 by parties\nmaintenance visits yearly 3\nwarranty period months "), k % 2 * 12 + 12,
    )
    return o.select("o_custkey", "o_orderkey", "day", text.alias("text"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity of the clauses with its unit and the words that name it."""
    m = M.measurements(_clauses(spark, sf_dir), ["o_orderkey"], F.col("text"))
    return m.select("o_orderkey", "segment", "pos", "value", "unit", F.array_join("label", " ").alias("label"))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreements among the newest twelve clauses of each customer."""
    c = R.ranked(_clauses(spark, sf_dir), ["o_custkey"], F.desc("day"), F.col("o_orderkey")).where(F.col("rank") <= SOURCES)
    return M.conflicts(M.measurements(c, ["o_custkey", "o_orderkey"], F.col("text")), "o_custkey", "o_orderkey")


def text_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of pipe tables in the text, where a table has three rows."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("before | no\n| Item | Fee |\n|---|---|\n| part "), k, F.lit(" | "), k % 50, F.lit(" |\n"), F.when(k % 3 > 0, F.concat(F.lit("| total |  "), k % 50 + 1, F.lit(" |\n"))).otherwise(""), F.lit("after"))
    return M.grid(read(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", F.col("t"))


def taught_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taught figures that a passage of the same customer's newest twelve states otherwise."""
    c = R.ranked(_clauses(spark, sf_dir), ["o_custkey"], F.desc("day"), F.col("o_orderkey"), out="citation").where(F.col("citation") <= SOURCES)
    line = F.get(F.split("text", "\n"), 1)
    passages = c.select(F.col("o_custkey").alias("group"), "citation", T.content(line).alias("terms"), T.numeric_tokens(F.regexp_replace(line, ",", "")).alias("numbers"))
    say = F.concat(F.lit("delivery notice period should be "), F.col("c_custkey") % 5 * 15, F.lit(" days"))
    t = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_custkey").alias("group"), T.content(say).alias("item_terms"), T.numeric_tokens(say).alias("item_numbers"))
    return M.number_conflicts(t, passages)


QUERIES = {f.__name__: f for f in (measurements, conflicts, text_grids, taught_conflicts)}

_TEXT = """c AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, '| Delay penalty rate | ' || (o_orderkey % 4 + 1) || '% |' || chr(10) || 'The agreed delivery notice period is ' || (o_orderkey % 3 * 15 + 15) || ' days; total contract value of order AED-' || o_orderkey
  || ' is ' || format('{:,}', floor(o_totalprice)::BIGINT) || ' AED dated ' || strftime(o_orderdate, '%d/%m/%Y') || chr(10) || '11. section heading number 40 items' || chr(10) || 'retention released in 2026' || chr(10) || 'signed on 5 March 2026 by parties' || chr(10)
  || 'maintenance visits yearly 3' || chr(10) || 'warranty period months ' || (o_orderkey % 2 * 12 + 12) AS text FROM orders)"""
_STOP = listed((*M.V.ARABIC_STOPWORDS, *M.V.ENGLISH_STOPWORDS))
_NUM = quoted(M.NUMBER)
_MEASURED = f"""s0 AS (SELECT o_custkey, o_orderkey, (i - 1)::INTEGER AS segment, {normal('ss[i]')} AS s FROM (SELECT *, regexp_split_to_array(text, '[|\\n\\r;]+') AS ss FROM src), unnest(range(1, len(ss) + 1)) AS r(i)),
  s1 AS (SELECT *, regexp_split_to_array(s, '\\s+') AS ws FROM s0 WHERE s <> '' AND NOT regexp_matches(s, {quoted(M.MARKER)})),
  w AS (SELECT *, i AS p, ws[i] AS w, coalesce(ws[i + 1], '') AS nx, coalesce(ws[i + 2], '') AS nx2, CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END AS pr, CASE WHEN i > 2 THEN ws[i - 2] ELSE '' END AS pr2 FROM s1, unnest(range(1, len(ws) + 1)) AS r(i)),
  v AS (SELECT o_custkey, o_orderkey, segment, (p - 1)::INTEGER AS pos, w, replace(regexp_extract(w, {_NUM}, 1), ',', '') AS value, regexp_extract(nx, '^(\\p{{L}}+)', 1) AS f, regexp_extract(w, {_NUM}, 2) AS pc,
    list_sort(list_distinct(list_filter(flatten(list_transform(ws[greatest(p - 8, 1) : p - 1], lambda x: regexp_split_to_array(x, '[^\\p{{L}}\\p{{N}}_]+'))), lambda x: length(x) > 2 AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains({_STOP}, x)))) AS label
    FROM w WHERE regexp_matches(w, {_NUM}) AND NOT (regexp_full_match(w, '[0-9]{{1,2}}') AND regexp_full_match(nx, '\\p{{L}}+') AND regexp_matches(nx2, '^[0-9]{{4}}\\b')) AND NOT (regexp_matches(w, '^[0-9]{{4}}\\b') AND regexp_full_match(pr, '\\p{{L}}+') AND regexp_full_match(pr2, '[0-9]{{1,2}}'))),
  u AS (SELECT o_custkey, o_orderkey, segment, pos, w, value, label, CASE WHEN pc = '%' THEN '%' WHEN length(f) BETWEEN 2 AND 12 AND NOT list_contains({_STOP}, f) THEN f ELSE '' END AS unit FROM v),
  m AS (SELECT o_custkey, o_orderkey, segment, pos, value, unit, label FROM u WHERE len(label) >= 2 AND NOT (unit = '' AND length(value) < 2) AND NOT (unit = '' AND length(value) = 4 AND value::BIGINT BETWEEN 1900 AND 2100 AND NOT contains(w, ',')))"""
_TOP = "src AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey) <= 12)"
_NUMBERS = lambda x: f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '\\d[\\d.,]*'), lambda n: regexp_replace(n, '[.,]+$', ''))))"

SQL = {
    "measurements": f"WITH {_TEXT}, src AS (SELECT * FROM c), {_MEASURED} SELECT o_orderkey, segment, pos, value, unit, array_to_string(label, ' ') AS label FROM m",
    "conflicts": f"""WITH {_TEXT}, {_TOP}, {_MEASURED}, p AS (SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, a.value AS "left", b.value AS "right", array_to_string(list_sort(list_intersect(a.label, b.label)), ' ') AS shared, a.segment AS s1, a.pos AS p1, b.segment AS s2, b.pos AS p2
          FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.value <> b.value WHERE len(list_intersect(a.label, b.label)) >= 2 AND (a.unit = '' OR b.unit = '' OR starts_with(a.unit, b.unit) OR starts_with(b.unit, a.unit))),
        f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY o_custkey, a, b, shared ORDER BY s1, p1, s2, p2) = 1)
        SELECT o_custkey, a, b, "left", "right", shared, row_number() OVER (PARTITION BY o_custkey ORDER BY a, b, shared)::INTEGER AS place FROM f QUALIFY place <= 12""",
    "text_grids": """SELECT o_orderkey, row::INTEGER AS row, col::INTEGER AS col, CASE WHEN row = 1 THEN ['Item', 'Fee'][col + 1] WHEN row = 2 THEN ['part ' || o_orderkey, (o_orderkey % 50)::VARCHAR][col + 1] ELSE ['total', (o_orderkey % 50 + 1)::VARCHAR][col + 1] END AS cell
        FROM orders, unnest([1, 2, 3]) AS r(row), unnest([0, 1]) AS q(col) WHERE o_orderkey % 3 > 0""",
    "taught_conflicts": f"""WITH {_TEXT}, src AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey) AS citation FROM c QUALIFY citation <= 12),
        p AS (SELECT o_custkey, citation, {content_list('string_split(text, chr(10))[2]')} AS terms, {_NUMBERS("replace(string_split(text, chr(10))[2], ',', '')")} AS numbers FROM src),
        y AS (SELECT c_custkey, 'delivery notice period should be ' || c_custkey % 5 * 15 || ' days' AS say FROM customer), t AS (SELECT c_custkey, {content_list('say')} AS terms, {_NUMBERS('say')} AS numbers FROM y)
        SELECT c_custkey AS item, citation::INTEGER AS citation, array_to_string(t.numbers[1:3], ', ') AS taught, array_to_string(p.numbers[1:3], ', ') AS stated FROM t JOIN p ON o_custkey = c_custkey
        WHERE len(list_intersect(t.terms, p.terms)) >= 2 AND NOT list_has_any(t.numbers, p.numbers) AND len(p.numbers) > 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY citation) = 1""",
}
