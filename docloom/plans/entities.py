"""Facts of eleven kinds, fact sheets, dated sections and rivals: papers are written from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import entities as N
from docloom.operators import retrieval as R
from docloom.plans.language import content_list, normal, quoted
from docloom.plans.layout import _lines
from docloom.plans.retrieval import read


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    text = F.concat(
        F.lit("| Item | Value |\n| --- | --- |\n| Contract value | "), F.format_number(k * 13 + 1000, 0), F.lit(" AED |\n| Delay rate of contract | "), k % 9 + 1, F.lit("% |\n| **Site** | Plot "), k % 77, F.lit(" |\nSigned "), F.date_format("day", "dd/MM/yyyy"),
        F.lit(" by Harbour Marine Contracting, "), k % 50, F.lit(" days under Clause 4."), k % 7, F.lit(" with form AB-F-"), k % 90 + 10, F.lit(", ref PO-2024-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" of شركة النخيل، المهندس / احمد علي\n```\ncode\n```"),
    )
    return o.select("o_orderkey", "o_custkey", "day", text.alias("text"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.entities(_papers(spark, sf_dir), "o_orderkey", F.col("text"))


def paper_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all kinds in each paper, label and value rows among them."""
    return _facts(spark, sf_dir)


def section_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents have tables, lists, code, and their first terms: twelve by count."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 4 == 0, "| a | b |\n").when(F.col("doc_id") % 4 == 1, "- item\n").when(F.col("doc_id") % 4 == 2, "```\n").otherwise(""), T.text_or_empty("text")).alias("t"))
    flags = [c.alias(n) for n, c in zip(("has_table", "has_list", "has_code"), N.described(F.col("t")))]
    return d.select("doc_id", *flags)


def fact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each customer's papers in the order of a sheet, 45 at most."""
    f = _facts(spark, sf_dir).join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").drop("o_orderkey")
    return N.fact_sheet(f, "o_custkey").select("o_custkey", "kind", "value", "label", "place")


def ambiguous_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a question that name several labels of a paper."""
    asked = read(spark, sf_dir, "orders").select("o_orderkey", F.explode(T.content(F.when(F.col("o_orderkey") % 2 == 0, "what is the contract rate").otherwise("where is the site"))).alias("term"))
    # papers have nine lines
    return N.ambiguous_terms(asked, N.labelled(_papers(spark, sf_dir), "o_orderkey", F.col("text")), "o_orderkey")


def dated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 newest dated sections of each customer as of 1998: a date in the heading or the body; future ones
    do not count."""
    k = F.col("o_orderkey")
    p = _papers(spark, sf_dir).withColumn("later", F.date_add("day", (k % 900).cast("int")))
    heading = F.when(k % 3 == 0, F.concat(F.lit("Update of "), F.date_format("day", "d-M-yyyy"))).otherwise("Notes")
    body = F.when(k % 3 == 1, F.concat(F.lit("held on "), F.date_format("day", "dd/MM/yyyy"), F.lit(", due "), F.date_format("later", "dd/MM/yyyy"))).otherwise("no day")
    s = p.select(F.col("o_custkey").alias("doc"), k.alias("section"), heading.alias("heading"), body.alias("body"))
    d = N.dated_sections(s, "doc", F.lit("1998-06-30").cast("date"))
    return d.select("doc", "section", F.col("day").cast("string").alias("day"), "timeline_rank")


def dated_sweep_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each dated section: its first line, else that of the next order of the customer."""
    d = dated_sections(spark, sf_dir)
    l = _lines(spark, sf_dir).join(read(spark, sf_dir, "orders"), F.col("doc") == F.col("o_orderkey")).where("o_orderkey % 4 > 0")
    chunks = l.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("section"), (F.col("o_orderkey") * 100 + F.col("rn")).alias("chunk"))
    w = R.Window.partitionBy("o_custkey").orderBy("o_orderkey")
    related = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("section"), F.lead("o_orderkey").over(w).alias("other")).where("other is not null")
    return N.swept(d.select("doc", "section", "timeline_rank"), chunks, related, "doc")


def supersede_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that one in force replaces, with how many do: same customer, six terms and 45 % in common."""
    k = F.col("o_orderkey")
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("term"), (k % 4 + i + F.when(i > 5, k % 3 * 10).otherwise(0)).cast("string"))), " ")
    o = read(spark, sf_dir, "orders").select("o_custkey", k.alias("o_orderkey"), F.when(F.col("o_orderstatus") == "P", "current").otherwise("unknown").alias("standing"), T.content(words).alias("terms"))
    return N.rivals(o, "o_custkey", "o_orderkey")


def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of papers: breadcrumb, labels, leading sentences; terms where a paper has neither."""
    k = F.col("o_orderkey")
    labels = F.when(k % 3 == 0, F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.concat(F.lit("label "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    sentences = F.when(k % 3 == 1, F.array(F.lit("First one."), F.repeat(F.lit("long words "), 28), F.lit("Third."))).otherwise(F.array().cast("array<string>"))
    terms = F.array(F.lit("order"), k.cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", N.summary(F.concat(F.lit("Papers > "), k), labels, sentences, terms).alias("summary"))


QUERIES = {f.__name__: f for f in (paper_entities, section_flags, fact_sheet, ambiguous_labels, dated_sections, dated_sweep_arm, supersede_rivals, section_summaries)}

_T = """p AS (SELECT o_orderkey, o_custkey, o_orderkey AS k, o_orderdate::DATE AS day, '| Item | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| Contract value | ' || format('{:,}', o_orderkey * 13 + 1000) || ' AED |' || chr(10) || '| Delay rate of contract | ' || (o_orderkey % 9 + 1) || '% |' || chr(10) || '| **Site** | Plot ' || o_orderkey % 77 || ' |' || chr(10)
  || 'Signed ' || strftime(o_orderdate, '%d/%m/%Y') || ' by Harbour Marine Contracting, ' || o_orderkey % 50 || ' days under Clause 4.' || o_orderkey % 7 || ' with form AB-F-' || (o_orderkey % 90 + 10) || ', ref PO-2024-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' of شركة النخيل، المهندس / احمد علي' || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' AS text FROM orders)"""
SECOND = r"regexp_split_to_array(value, '\s+')[2]"
_ORG = lambda k: " AND length(value) >= 8" if k == "organization" else f" AND length(value) >= 7 AND regexp_matches(value, '[0-9]') AND NOT regexp_matches(value, '{N.DATE}')" if k == "identifier" else f" AND NOT list_contains([{', '.join(quoted(w) for w in N.NO_NAMES)}], {normal(SECOND)})" if k == "person" else ""
_BY = " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, value, '' AS label, {1000 + i} AS o FROM (SELECT o_orderkey, trim(unnest(regexp_extract_all(text, {quoted(pt)}, 1))) AS value FROM p) WHERE value <> '' AND length(value) <= 120{_ORG(k)}" for i, (k, pt) in enumerate(N.KINDS))
_F = f"""{_T}, r AS (SELECT o_orderkey, 'amount' AS kind, format('{{:,}}', k * 13 + 1000) || ' AED' AS value, 'Contract value' AS label, 2 AS o FROM p UNION ALL SELECT o_orderkey, 'percentage', (k % 9 + 1) || '%', 'Delay rate of contract', 3 FROM p UNION ALL SELECT o_orderkey, 'attribute', 'Plot ' || k % 77, 'Site', 4 FROM p),
f AS (SELECT o_orderkey, kind, value, label FROM (SELECT * FROM r UNION ALL {_BY}) QUALIFY row_number() OVER (PARTITION BY o_orderkey, kind, {normal('value')} ORDER BY o, value) = 1)"""
_D = """s AS (SELECT o_custkey AS doc, o_orderkey AS section, o_orderkey AS k, o_orderdate::DATE AS day, o_orderdate::DATE + (o_orderkey % 900)::INTEGER AS later FROM orders WHERE o_orderkey % 3 < 2),
d AS (SELECT doc, section, CASE WHEN k % 3 = 1 AND later <= DATE '1998-06-30' THEN later ELSE day END AS day FROM s WHERE day <= DATE '1998-06-30'), t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY day DESC, section)::INTEGER AS timeline_rank FROM d QUALIFY timeline_rank <= 14)"""

SQL = {
    "paper_entities": f"WITH {_F} SELECT * FROM f",
    "section_flags": r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '| a | b |' || chr(10) WHEN 1 THEN '- item' || chr(10) WHEN 2 THEN '```' || chr(10) ELSE '' END || coalesce(text, '') AS t FROM documents)
        SELECT doc_id, regexp_matches(t, '(?m)^\s{0,3}\|') AS has_table, regexp_matches(t, '(?m)^\s{0,3}(?:[-*+]|\d{1,3}[.)])\s+') AS has_list, regexp_matches(t, '(?m)^\s{0,3}(?:`{3,}|~{3,})') AS has_code FROM t""",
    "fact_sheet": f"""WITH {_F}, c AS (SELECT o_custkey, f.kind, value, label FROM f JOIN orders USING (o_orderkey) QUALIFY row_number() OVER (PARTITION BY o_custkey, label, value ORDER BY f.kind) = 1)
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN label <> '' THEN 0 ELSE coalesce(list_position(['amount', 'date', 'percentage', 'duration', 'person', 'organization'], kind), 7) END, kind, value)::INTEGER AS place FROM c QUALIFY place <= 45""",
    "ambiguous_labels": f"""WITH q AS (SELECT o_orderkey, unnest({content_list("CASE WHEN o_orderkey % 2 = 0 THEN 'what is the contract rate' ELSE 'where is the site' END")}) AS term FROM orders) SELECT o_orderkey, term, 2 AS labels FROM q WHERE term = 'contract'""",
    "dated_sections": f"WITH {_D} SELECT doc, section, day::VARCHAR AS day, timeline_rank FROM t",
    "dated_sweep_arm": f"""WITH {_D}, c AS (SELECT DISTINCT o_custkey AS doc, o_orderkey AS section, o_orderkey * 100 + 1 AS chunk FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 > 0), r AS (SELECT o_custkey AS doc, o_orderkey AS section, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS other FROM orders),
        j AS (SELECT t.doc, coalesce(c.chunk, x.chunk) AS chunk, timeline_rank FROM t LEFT JOIN c ON c.doc = t.doc AND c.section = t.section LEFT JOIN r ON r.doc = t.doc AND r.section = t.section LEFT JOIN c x ON x.doc = t.doc AND x.section = r.other) SELECT doc, chunk, min(timeline_rank) AS timeline_rank FROM j WHERE chunk IS NOT NULL GROUP BY doc, chunk""",
    "supersede_rivals": """WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderstatus = 'P' AS cur, list_distinct(list_transform(range(0, 10), lambda i: 'term' || (o_orderkey % 4 + i + CASE WHEN i > 5 THEN o_orderkey % 3 * 10 ELSE 0 END))) AS ts FROM orders),
        m AS (SELECT a.k, b.k AS lead_k, len(list_intersect(a.ts, b.ts)) AS s, least(len(a.ts), len(b.ts)) AS n, a.o_custkey FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND NOT a.cur AND b.cur), g AS (SELECT * FROM m WHERE s >= 6 AND s / n::DOUBLE >= 0.45::DOUBLE), h AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY o_custkey, lead_k) <= 3)
        SELECT k AS o_orderkey, count(*) AS rivals FROM h GROUP BY k""",
    "section_summaries": """SELECT o_orderkey, 'Papers > ' || o_orderkey || ': ' || CASE o_orderkey % 3 WHEN 0 THEN (SELECT string_agg('label ' || i, '; ' ORDER BY i) FROM range(1, 15) r(i)) WHEN 1 THEN 'First one.' ELSE 'order, ' || o_orderkey END AS summary FROM orders""",
}
