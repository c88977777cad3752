"""Layout queries: an order is a document or a page, its lines are paragraphs, words and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import layout as Y
from docloom.operators import retrieval as R
from docloom.plans.retrieval import read


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    return R.ranked(l, ["l_orderkey"], *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], out="rn").withColumn("doc", F.col("l_orderkey"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    text = F.when(k % 3 == 0, F.concat(k % 9 + 1, F.lit("."), F.col("l_linenumber"), F.when(k % 6 == 0, F.concat(F.lit("."), k % 4)).otherwise(""), F.lit(" Heading"))).otherwise(F.concat(F.lit("Text of part "), k, F.when(k % 7 == 0, ".").otherwise("")))
    style = F.when((F.col("doc") % 3 == 0) & (k % 2 == 0), k % 6 + 1)
    return _lines(spark, sf_dir).select("doc", F.col("rn").alias("ord"), text.alias("text"), style.cast("int").alias("style"), ((F.col("l_suppkey") % 2 == 0) & (F.col("doc") % 5 > 0)).alias("bold"), (F.floor((F.col("rn") - 1) / 3) + 1).alias("page"))


def docx_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of each document with their level and the tier that gave them."""
    return Y.headings(_paragraphs(spark, sf_dir), "doc")


def docx_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by heading, or by page where a document has no headings."""
    p = _paragraphs(spark, sf_dir)
    return Y.sections(p.select("doc", "ord", "page"), "doc", Y.headings(p, "doc"))


def docx_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and tables of a document in its order, each kind with numbers of its own."""
    l = _lines(spark, sf_dir).withColumn("kind", F.when(F.col("l_returnflag") == "R", "table").otherwise("paragraph"))
    return R.ranked(l, ["doc", "kind"], F.col("rn"), out="nth").select("doc", F.col("rn").alias("ord"), "kind", "nth")


def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of words in reading order: of three words each; every second document is Arabic."""
    text = F.when(F.col("doc") % 2 == 0, F.get(F.array(*[F.lit(w) for w in ("بند", "عقد", "مبلغ", "AED")]), (F.col("l_partkey") % 4).cast("int"))).otherwise(F.concat(F.lit("w"), F.col("l_partkey")))
    w = _lines(spark, sf_dir).select("doc", F.floor((F.col("rn") - 1) / 3).alias("line"), (F.col("l_suppkey") * 10 + F.col("rn")).alias("x"), text.alias("text"))
    return Y.page_lines(w, ["doc", "line"])


def heading_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of their brand's document, sizes as font sizes: short lines set larger than the body
    that don't end like a sentence are headings, unless there are more than six a page of ten lines."""
    p = read(spark, sf_dir, "part").withColumn("text", F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, ".").otherwise("")))
    per = p.groupBy("p_brand", "p_size").agg(F.sum(F.length("text")).alias("c"))
    body = per.groupBy("p_brand").agg((-F.max(F.struct("c", (-F.col("p_size")).alias("s")))["s"]).alias("body"))
    big = per.join(body, "p_brand").where(F.col("p_size") >= 1.15 * F.col("body"))
    levels = R.ranked(big, ["p_brand"], F.desc("p_size"), out="nth").select("p_brand", "p_size", F.least("nth", F.lit(6)).alias("level"))
    found = p.where((F.length("text") <= Y.MAX_CHARS) & ~F.col("text").rlike(Y.SENTENCE_END)).join(levels, ["p_brand", "p_size"])
    pages = p.groupBy("p_brand").agg(F.ceil(F.count("*") / 10).alias("pages"))
    n = found.groupBy("p_brand").agg(F.count("*").alias("n")).join(pages, "p_brand").where("n <= 6 * pages")
    return found.join(n, "p_brand", "left_semi").select("p_brand", "p_partkey", "level")


def logical_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose Arabic was stored in drawing order, read the right way round: every second customer's."""
    said = F.concat(F.lit("الطلب رقم "), F.col("o_orderkey"))
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_custkey") % 2 == 0, said).otherwise(F.concat(F.reverse(F.col("o_orderkey").cast("string")), F.reverse(F.lit("الطلب رقم ")))).alias("cell"))
    drawn = o.withColumn("cell", F.when(F.col("o_custkey") % 2 == 0, F.col("cell")).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.reverse(F.lit("الطلب رقم ")))))
    return Y.logical_cells(drawn, "o_custkey")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of words; every fourth page is prose; every fifth line of a table has no label."""
    k, rn = F.col("l_partkey"), F.col("rn")
    y = 100 + 12 * rn + k % 3 * 0.4
    word = lambda x0, x1, t: F.struct(F.lit(x0).cast("double").alias("x0"), F.lit(x1).cast("double").alias("x1"), t.cast("string").alias("text"))
    prose = F.array(*[word(20 + 55 * i, 20 + 55 * i + 50, F.lit(f"word{i}")) for i in range(6)])
    label = F.when(rn % 5 > 0, F.array(word(20, 60, F.lit("Item")), word(64, 110, F.concat(F.lit("P"), k))))
    table = F.concat(F.coalesce(label, F.array().cast("array<struct<x0:double,x1:double,text:string>>")), F.when(rn % 5 == 4, F.array().cast("array<struct<x0:double,x1:double,text:string>>")).otherwise(F.array(word(200, 230, F.col("l_quantity").cast("int")))), F.array(word(320, 360, F.col("l_suppkey"))))
    l = _lines(spark, sf_dir).select("doc", y.alias("y"), F.explode(F.when(F.col("doc") % 4 == 3, prose).otherwise(table)).alias("w"))
    return l.select("doc", "y", "w.x0", "w.x1", "w.text")


def figures_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of pages that one reading cut short, completed by another of the same boxes: an order's lines are
    words, their quantities and prices what was read; some boxes lie apart, some readings disagree."""
    k, at = F.col("l_partkey"), F.col("rn")
    whole = F.when(k % 5 == 4, F.concat((k % 40 + 1).cast("string"), F.lit("/"), (k % 14 + 1).cast("string"), F.lit("/2024"))).otherwise(F.concat((k % 9 + 1).cast("string"), F.lit(","), F.lpad((k * 7 % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0")))
    part = F.when(k % 3 == 0, F.substring_index(whole, ",", 1)).when(k % 3 == 1, F.regexp_extract(whole, r"\d+$", 0)).otherwise(whole)
    box = lambda shift: {"left": at * 40 + k % 7 + shift, "right": at * 40 + 30 + shift, "top": F.col("l_suppkey") % 5 * 20 + shift}
    l = _lines(spark, sf_dir)
    said = l.select("doc", (2 * at).alias("n"), *[v.cast("double").alias(c) for c, v in box(0).items()], part.alias("text"))
    unit = l.select("doc", (2 * at + 1).alias("n"), *[v.cast("double").alias(c) for c, v in box(35).items()], F.concat(F.lit("unit"), k % 3).alias("text"))
    other = l.select("doc", (2 * at).alias("n"), *[v.cast("double").alias(c) for c, v in box(F.when(k % 11 == 0, 20).otherwise(k % 4 * 4)).items()], whole.alias("text"))
    return Y.completed(said.unionByName(unit), other, ["doc"])


def layout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages without ruled tables in the columns that white space parts."""
    return Y.layout_cells(_words(spark, sf_dir), "doc").select("doc", "row", "col", "columns", "text")


def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of what reads as a table, continuation lines folded in."""
    t = Y.tables(Y.layout_cells(_words(spark, sf_dir), "doc"), "doc")
    return t.select("doc", "row", F.array_join("cells", "|").alias("cells"), "n")


def assisted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of another reader that are kept, as their numbers agree with ours."""
    l = _lines(spark, sf_dir).groupBy("doc").agg(F.sort_array(F.collect_list("l_partkey")).alias("ps"))
    theirs = F.concat(F.when(F.col("doc") % 7 == 0, F.repeat(F.lit("ilji "), 12)).otherwise("Item cost "), F.array_join(F.transform("ps", lambda p: (p * 13 + 100).cast("string")), " | "))
    ours = F.array_join(F.transform(F.filter("ps", lambda p: (p + F.col("doc")) % 3 == 0), lambda p: (p * 13 + 100).cast("string")), " ")
    n, share, kept = Y.agreed(theirs, ours)
    return l.select("doc", n.alias("numbers"), F.round(share, 6).alias("share"), kept.alias("kept"))


def scan_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, orders as pages of text: which are scans."""
    text = F.when((F.col("o_orderkey") + F.col("o_custkey")) % 5 < F.col("o_custkey") % 6, "short").otherwise(F.repeat(F.lit("a line of typed text "), 3))
    return Y.scanned(read(spark, sf_dir, "orders").select("o_custkey", text.alias("t")), "o_custkey", F.col("t"))


def better_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose second reading (foreign symbols out, every ninth cut short) replaces the first."""
    damage = lambda t: T.count_of(t, r"[#*$%&|<>]") / F.greatest(F.length(t), F.lit(1))
    d = read(spark, sf_dir, "documents").select("doc_id", T.text_or_empty("text").alias("t"))
    again = F.regexp_replace("t", r"[#*$%]", "")
    again = F.when(F.col("doc_id") % 9 == 0, F.substring(again, 1, F.floor(F.length(again) / 2).cast("int"))).otherwise(again)
    return d.select("doc_id", Y.better_reading(F.col("t"), again, damage).alias("replaced"))


def new_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read from pictures with figures that the typed page lacks, where a page has three."""
    l = _lines(spark, sf_dir)
    typed = l.where(F.col("l_suppkey") % 2 == 0).select("doc", F.concat(F.lit("typed "), F.format_number(F.col("l_partkey") * 11 + 1000, 0), F.lit(".50")).alias("text"))
    seen = l.select("doc", F.col("rn").alias("line"), F.concat(F.lit("read 7 and "), F.col("l_partkey") * 11 + 1000).alias("text"))
    return Y.new_figure_lines(typed, seen, "doc")


def covered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages that no table of the page accounts for."""
    l = _lines(spark, sf_dir)
    q = F.col("l_quantity").cast("int").cast("string")
    cells = l.where(F.col("l_suppkey") % 2 == 0).select("doc", F.col("rn").alias("row"), F.posexplode(F.array(F.concat(F.lit("part "), F.col("l_partkey")), q)).alias("col", "cell"))
    text = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" part "), F.col("l_partkey"), F.lit("  "), q)).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("part "), F.col("l_partkey"))).otherwise("prose of the page")
    return Y.uncovered_lines(l.select("doc", "rn", text.alias("text")), cells, "doc").select("doc", "rn", "text")


def table_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids that a page keeps: ruled ones, and only where it has none those of its layout."""
    l = _lines(spark, sf_dir)
    g = l.select("doc", F.col("rn").alias("grid"), F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(1).alias("source"), (F.col("l_partkey") % 4).alias("n_rows"), (F.col("l_partkey") % 5).alias("n_cols"))
    return Y.first_source(g, "doc").select("doc", "grid", "source")


def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (orders) that are to be read again, for pictures on typed pages (a day's lines) or for a damaged text
    layer; what was done for every seventh is not done again."""
    l = _lines(spark, sf_dir).withColumn("page", F.floor((F.col("rn") - 1) / 4))
    k = F.col("l_partkey")
    typed = l.select("doc", "page", F.struct("doc", "page").alias("key"), F.concat(F.lit("typed text of the line "), k, F.when(k % 9 == 0, " ###$%&").otherwise("")).alias("text"))
    seen = l.select("doc", "page", F.struct("doc", "page").alias("key"), F.col("rn").alias("line"), F.concat(F.lit("read "), k * F.when(k % 5 == 0, 1).otherwise(11) + F.when(k % 5 == 0, 0).otherwise(100_000)).alias("text"))
    odd = T.count_of(F.col("text"), r"[^\p{L}\p{N}\s.,;:!?'\"()\-]")
    chars = typed.groupBy("doc", "page").agg(F.sum(F.length("text")).alias("chars"), (F.sum(odd) / F.sum(F.length("text"))).alias("damage"))
    areas = l.groupBy("doc", "page").agg(Y.picture_share(F.sum(F.col("l_quantity").cast("double") * 100), F.lit(50_000.0)).alias("share"))
    fresh = Y.new_figure_lines(typed, seen, "key").select("key.doc", "key.page", "line")
    done = l.select("doc").distinct().where("doc % 7 = 0").select("doc", F.lit("damaged").alias("repair"))
    return Y.repairs(chars.join(areas, ["doc", "page"]), fresh, done, "doc")


def picture_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each page (a day of an order) that large pictures cover, and documents with a page that
    pictures cover by 15 %."""
    l = _lines(spark, sf_dir).where(F.col("l_quantity") * 4000 >= 400 * 200)
    area = l.groupBy("doc", F.floor((F.col("rn") - 1) / 2).alias("page")).agg(F.sum(F.col("l_quantity") * 100).alias("area"))
    shares = area.select("doc", "page", F.round(Y.picture_share(F.col("area"), F.lit(12_000.0)), 6).alias("share"))
    return shares.withColumn("repaired", F.max((F.col("share") >= Y.PICTURED).cast("int")).over(R.Window.partitionBy("doc")) == 1)


QUERIES = {
    f.__name__: f
    for f in (
        docx_headings, docx_sections, docx_walk, pdf_lines, figures_completed, repairs, heading_sizes, logical_tables, layout_columns, layout_tables, assisted_tables, scan_decision, better_readings, new_figures, covered_lines,
        table_choice, picture_shares,
    )
}

_L = "l AS (SELECT *, l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INTEGER AS rn, l_partkey AS k FROM lineitem)"
_HEADS = f"""{_L}, p AS (SELECT doc, rn AS ord, (rn - 1) // 3 + 1 AS page, CASE WHEN k % 3 = 0 THEN (k % 9 + 1) || '.' || l_linenumber || CASE WHEN k % 6 = 0 THEN '.' || k % 4 ELSE '' END || ' Heading' ELSE 'Text of part ' || k || CASE WHEN k % 7 = 0 THEN '.' ELSE '' END END AS text,
    CASE WHEN doc % 3 = 0 AND k % 2 = 0 THEN k % 6 + 1 END AS style, l_suppkey % 2 = 0 AND doc % 5 > 0 AS bold FROM l),
  f AS (SELECT *, bold AND length(text) <= 120 AND NOT regexp_matches(text, '[.:;,!?]$') AS looks, style IS NOT NULL AS styled FROM p), g AS (SELECT *, looks AND regexp_matches(text, '^[0-9]') AS numbered FROM f),
  t AS (SELECT *, CASE WHEN count(*) FILTER (styled) OVER w >= 3 THEN 'style' WHEN count(*) FILTER (numbered) OVER w >= 3 THEN 'number' WHEN count(*) FILTER (looks) OVER w > 0 AND count(*) FILTER (looks) OVER w <= 0.35::DOUBLE * count(*) OVER w THEN 'shape' ELSE 'style' END AS tier FROM g WINDOW w AS (PARTITION BY doc)),
  h AS (SELECT doc, ord, tier, CASE WHEN tier = 'style' THEN least(style, 4) WHEN regexp_matches(text, '^[0-9]') THEN length(regexp_extract(text, '^[0-9.]+')) - length(replace(regexp_extract(text, '^[0-9.]+'), '.', '')) + 1 ELSE 1 END::INTEGER AS level FROM t WHERE CASE tier WHEN 'style' THEN styled WHEN 'number' THEN numbered ELSE looks END)"""
_PROSE = " UNION ALL ".join(f"SELECT doc, y, {20 + 55 * i}::DOUBLE AS x0, {70 + 55 * i}::DOUBLE AS x1, 'word{i}' AS text FROM b WHERE doc % 4 = 3" for i in range(6))
_CELLS = f"""{_L}, b AS (SELECT doc, rn, k, l_quantity::INTEGER AS q, l_suppkey AS s, 100 + 12 * rn + k % 3 * 0.4::DOUBLE AS y FROM l),
  n AS (SELECT doc, count(*) AS rows FROM b WHERE doc % 4 <> 3 GROUP BY doc),
  c AS (SELECT doc, round_even(y / 3, 0)::INTEGER AS row, rn, k, q, s, y FROM b JOIN n USING (doc) WHERE rows >= 3)"""

SQL = {
    "repairs": rf"""WITH {_L}, p AS (SELECT doc, (rn - 1) // 4 AS page, rn, k, l_quantity::DOUBLE AS q, 'typed text of the line ' || k || CASE WHEN k % 9 = 0 THEN ' ###$%&' ELSE '' END AS text, (CASE WHEN k % 5 = 0 THEN k ELSE k * 11 + 100000 END)::VARCHAR AS seen FROM l),
        a AS (SELECT doc, page, sum(length(text)) AS chars, sum(CASE WHEN k % 9 = 0 THEN 6 ELSE 0 END) / sum(length(text))::DOUBLE AS damage, least(1, sum(q * 100) / 50000) AS share, list(k::VARCHAR) AS ks FROM p GROUP BY doc, page),
        f AS (SELECT doc, page, count(*) FILTER (length(seen) >= 2 AND NOT list_contains(ks, seen)) AS new FROM p JOIN a USING (doc, page) GROUP BY doc, page),
        r AS (SELECT doc, page, unnest(list_filter([CASE WHEN chars >= 40 AND share >= 0.15 AND new >= 3 THEN 'pictured' END, CASE WHEN damage >= 0.08 THEN 'damaged' END], lambda x: x IS NOT NULL)) AS repair FROM a JOIN f USING (doc, page))
        SELECT doc, repair, count(*) AS pages FROM r WHERE NOT (repair = 'damaged' AND doc % 7 = 0) GROUP BY doc, repair""",
    "figures_completed": f"""WITH {_L},
        a AS (SELECT doc, rn, k, CASE WHEN k % 5 = 4 THEN (k % 40 + 1) || '/' || (k % 14 + 1) || '/2024' ELSE (k % 9 + 1) || ',' || lpad((k * 7 % 1000)::VARCHAR, 3, '0') || '.' || lpad((k % 100)::VARCHAR, 2, '0') END AS whole,
          rn * 40 + k % 7 AS x, l_suppkey % 5 * 20 AS y, CASE WHEN k % 11 = 0 THEN 20 ELSE k % 4 * 4 END AS shift FROM l),
        w AS (SELECT *, CASE k % 3 WHEN 0 THEN split_part(whole, ',', 1) WHEN 1 THEN regexp_extract(whole, '[0-9]+$') ELSE whole END AS word, 'unit' || k % 3 AS next FROM a),
        c AS (SELECT *, count(*) OVER (PARTITION BY doc, word, next) AS again FROM w),
        m AS (SELECT c.doc, c.rn, c.word, a.rn AS frn, a.whole AS figure FROM c JOIN a ON a.doc = c.doc AND abs(a.x + a.shift - c.x) <= 12 AND abs(a.rn * 40 + 30 + a.shift - (c.rn * 40 + 30)) <= 12 AND abs(a.y + a.shift - c.y) <= 12
          WHERE again = 1 AND NOT regexp_matches(word, '[./]') AND NOT (a.k % 5 = 4 AND (a.k % 40 + 1 > 31 OR a.k % 14 + 1 > 12)) AND length(replace(a.whole, ',', '')) > length(c.word) AND (starts_with(replace(a.whole, ',', ''), c.word) OR ends_with(a.whole, c.word)))
        SELECT doc, 2 * rn AS n, word, arg_min(figure, frn) AS figure FROM m GROUP BY doc, rn, word""",
    "docx_headings": f"WITH {_HEADS} SELECT doc, ord, level, tier FROM h",
    "docx_sections": f"""WITH {_HEADS}, s AS (SELECT p.doc, p.ord, CASE WHEN p.doc IN (SELECT doc FROM h) THEN sum(CASE WHEN h.ord IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc ORDER BY p.ord ROWS UNBOUNDED PRECEDING) ELSE page END::BIGINT AS section FROM p LEFT JOIN h ON h.doc = p.doc AND h.ord = p.ord)
        SELECT doc, section, min(ord) AS first, count(*) AS n FROM s GROUP BY doc, section""",
    "docx_walk": f"WITH {_L}, w AS (SELECT doc, rn AS ord, CASE WHEN l_returnflag = 'R' THEN 'table' ELSE 'paragraph' END AS kind FROM l) SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY ord)::INTEGER AS nth FROM w",
    "pdf_lines": f"""WITH {_L}, w AS (SELECT doc, (rn - 1) // 3 AS line, l_suppkey * 10 + rn AS x, CASE WHEN doc % 2 = 0 THEN ['بند', 'عقد', 'مبلغ', 'AED'][k % 4 + 1] ELSE 'w' || k END AS text FROM l),
        g AS (SELECT doc, line, string_agg(text, ' ' ORDER BY x, text) AS a, string_agg(text, ' ' ORDER BY x DESC, text DESC) AS d FROM w GROUP BY doc, line),
        r AS (SELECT *, coalesce((length(a) - length(regexp_replace(a, '{T.ARABIC}', '', 'g'))) / nullif(length(a) - length(regexp_replace(a, '\\p{{L}}', '', 'g')), 0)::DOUBLE > 0.5, false) AS rtl FROM g) SELECT doc, line::BIGINT AS line, CASE WHEN rtl THEN d ELSE a END AS text, rtl FROM r""",
    "heading_sizes": """WITH p AS (SELECT *, p_name || CASE WHEN p_partkey % 4 = 0 THEN '.' ELSE '' END AS text FROM part), z AS (SELECT p_brand, p_size, sum(length(text)) AS c FROM p GROUP BY ALL), b AS (SELECT p_brand, p_size AS body FROM z QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, p_size) = 1),
        v AS (SELECT p_brand, p_size, least(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC), 6)::INTEGER AS level FROM z JOIN b USING (p_brand) WHERE p_size >= 1.15 * body), f AS (SELECT p_brand, p_partkey, level FROM p JOIN v USING (p_brand, p_size) WHERE p_partkey % 4 <> 0 AND length(text) <= 120)
        SELECT * FROM f WHERE p_brand IN (SELECT p_brand FROM (SELECT p_brand, count(*) AS n FROM f GROUP BY p_brand) JOIN (SELECT p_brand, ceil(count(*) / 10.0) AS pages FROM p GROUP BY p_brand) USING (p_brand) WHERE n <= 6 * pages)""",
    "logical_tables": "SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 2 = 0 OR count(*) OVER (PARTITION BY o_custkey) >= 2 THEN 'الطلب رقم ' || o_orderkey ELSE o_orderkey || reverse('الطلب رقم ') END AS cell FROM orders",
    "layout_columns": f"""WITH {_CELLS} SELECT doc, row, 0 AS col, 3 AS columns, 'Item P' || k AS text FROM c WHERE rn % 5 > 0 UNION ALL SELECT doc, row, 1, 3, q::VARCHAR FROM c WHERE rn % 5 <> 4 UNION ALL SELECT doc, row, 2, 3, s::VARCHAR FROM c""",
    "layout_tables": f"""WITH {_CELLS}, g AS (SELECT doc, y - lag(y) OVER (PARTITION BY doc ORDER BY rn) AS g FROM c), m AS (SELECT doc, list_sort(list(g)) AS gs FROM g WHERE g > 0 GROUP BY doc), t AS (SELECT c.*, CASE WHEN rn % 5 > 0 THEN 'Item P' || k ELSE '' END AS a, CASE WHEN rn % 5 <> 4 THEN q::VARCHAR ELSE '' END AS b, s::VARCHAR AS d FROM c)
        SELECT doc, (rn - 1)::INTEGER AS row, a || '|' || b || '|' || d AS cells, 1 AS n FROM t""",
    "assisted_tables": f"""WITH {_L}, g AS (SELECT doc, list(k) AS ps FROM l GROUP BY doc), n AS (SELECT doc, list_distinct(list_transform(ps, lambda p: p * 13 + 100)) AS a, list_distinct(list_transform(list_filter(ps, lambda p: (p + doc) % 3 = 0), lambda p: p * 13 + 100)) AS b FROM g),
        s AS (SELECT doc, len(a)::INTEGER AS numbers, round(len(b) / len(a)::DOUBLE, 6) AS share FROM n) SELECT *, numbers >= 3 AND share >= 0.3 AND doc % 7 <> 0 AS kept FROM s""",
    "scan_decision": "SELECT o_custkey, count(*) AS pages, round(avg(((o_orderkey + o_custkey) % 5 < o_custkey % 6)::INTEGER), 6) AS share, avg(((o_orderkey + o_custkey) % 5 < o_custkey % 6)::INTEGER) >= 0.6 AS scan FROM orders GROUP BY o_custkey",
    "better_readings": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[#*$%]', '', 'g') AS r FROM documents), u AS (SELECT doc_id, t, CASE WHEN doc_id % 9 = 0 THEN substring(r, 1, (length(r) // 2)::INTEGER) ELSE r END AS r FROM t),
        d AS (SELECT doc_id, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) / greatest(length(t), 1)::DOUBLE AS a, (length(r) - length(regexp_replace(r, '[#*$%&|<>]', '', 'g'))) / greatest(length(r), 1)::DOUBLE AS b, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS la, length(r) - length(regexp_replace(r, '\p{L}', '', 'g')) AS lb FROM u)
        SELECT doc_id, b <= a / 2 AND lb >= la * 0.85::DOUBLE AS replaced FROM d""",
    "new_figures": f"""WITH {_L}, f AS (SELECT doc, rn AS line FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.doc = a.doc AND b.l_suppkey % 2 = 0 AND b.k = a.k)) SELECT doc, line FROM f QUALIFY count(*) OVER (PARTITION BY doc) >= 3""",
    "covered_lines": f"""WITH {_L}, t AS (SELECT doc, rn, CASE k % 3 WHEN 0 THEN ' part ' || k || '  ' || l_quantity::INTEGER WHEN 1 THEN 'part ' || k ELSE 'prose of the page' END AS text, CASE k % 3 WHEN 0 THEN 'part ' || k || ' ' || l_quantity::INTEGER WHEN 1 THEN 'part ' || k ELSE 'prose of the page' END AS x FROM l),
        c AS (SELECT doc, 'part ' || k AS x FROM l WHERE l_suppkey % 2 = 0 UNION SELECT doc, l_quantity::INTEGER::VARCHAR FROM l WHERE l_suppkey % 2 = 0 UNION SELECT doc, 'part ' || k || ' ' || l_quantity::INTEGER FROM l WHERE l_suppkey % 2 = 0)
        SELECT doc, rn, text FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = t.doc AND c.x = t.x)""",
    "table_choice": f"WITH {_L}, g AS (SELECT doc, rn AS grid, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END AS source FROM l WHERE k % 4 >= 2 AND k % 5 >= 2) SELECT * FROM g QUALIFY source = min(source) OVER (PARTITION BY doc)",
    "picture_shares": f"""WITH {_L}, a AS (SELECT doc, (rn - 1) // 2 AS page, sum(l_quantity * 100) AS area FROM l WHERE l_quantity * 4000 >= 80000 GROUP BY doc, page), s AS (SELECT doc, page::BIGINT AS page, round(least(1, area / 12000.0::DOUBLE), 6) AS share FROM a)
        SELECT *, max((share >= 0.15)::INTEGER) OVER (PARTITION BY doc) = 1 AS repaired FROM s""",
}
