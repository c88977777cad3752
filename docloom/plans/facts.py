"""Fact, date and matching queries. Notes are written from orders, as the corpus has no such text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import facts as X
from docloom.operators import retrieval as R
from docloom.plans.retrieval import _BASE, bm25_topk, read, retrieval_eval, rrf_fuse

#: One word for another, and words that stand for each other.
CANONICAL = {"small": "compact", "large": "big", "gizmo": "gadget"}
SYNONYMS = (("red", "crimson"), ("ring", "band"), ("widget", "gadget"))
#: Retrieval measures that must hold, with how much may be lost.
GATE = (("questions", 1.0, 0.0), ("hit_rate", 1.0, 0.02), ("mrr", 0.627, 0.02))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    state = F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "O", "in force").otherwise("open")
    note = F.concat(
        F.lit("Order "), "o_orderkey", F.lit(" dated "), F.date_format("day", "dd/MM/yyyy"), F.lit(", total "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2),
        F.lit(" AED, due in "), F.col("o_orderkey") % 60 + 1, F.lit(" days, then "), F.date_format(F.date_add("day", (F.col("o_orderkey") % 60 + 1).cast("int")), "dd/MM/yyyy"),
        F.lit("; status "), state, F.lit(", ref PO-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(", share "), F.col("o_custkey") % 100, F.lit("%."),
    )
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "day", note.alias("note"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.facts(_notes(spark, sf_dir), "o_orderkey", F.col("note"))


def entities_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in the notes, once each."""
    return _facts(spark, sf_dir)


def value_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that found values are classified as on their own."""
    f = _facts(spark, sf_dir).select("kind", X.classify(F.col("value")).alias("class"))
    return f.groupBy("kind", "class").agg(F.count("*").alias("n"))


def dates_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _notes(spark, sf_dir).select("o_orderkey", X.dates(F.col("note")).alias("ds"))
    return d.select("o_orderkey", F.size("ds").cast("long").alias("n"), F.array_min("ds").cast("string").alias("first"), F.array_max("ds").cast("string").alias("last"))


def evidence_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest date of a note that isn't after the last order."""
    notes = _notes(spark, sf_dir)
    as_of = notes.agg(F.max("day").alias("d")).first().d
    return notes.select("o_orderkey", F.array_max(F.filter(X.dates(F.col("note")), lambda d: d <= F.lit(as_of))).cast("string").alias("day"))


def standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).groupBy(X.standing(F.col("note")).alias("standing")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer by recency against their newest one."""
    newest = F.max("day").over(Window.partitionBy("o_custkey"))
    n = _notes(spark, sf_dir).withColumn("weight", F.round(R.recency(F.col("day"), newest), 6))
    return R.ranked(n, ["o_custkey"], F.desc("weight"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "weight", "rank")


def explicit_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the last day of each month that has any."""
    n = _notes(spark, sf_dir)
    wanted = n.groupBy(F.date_trunc("month", "day").alias("m")).agg(F.max("day").alias("day")).select("day")
    return n.join(wanted, "day", "left_semi").select("o_orderkey", F.col("day").cast("string").alias("day"))


def relative_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in windows relative to the last one: calendar units start on Mondays and firsts."""
    n = _notes(spark, sf_dir)
    d = F.lit(n.agg(F.max("day").alias("d")).first().d)
    month, week = F.date_trunc("month", d).cast("date"), F.date_trunc("week", d).cast("date")
    spans = (
        ("past 10 days", F.date_sub(d, 10), d),
        ("this week", week, F.date_add(week, 6)),
        ("last week", F.date_sub(week, 7), F.date_sub(week, 1)),
        ("this month", month, F.last_day(d)),
        ("last month", F.add_months(month, -1).cast("date"), F.date_sub(month, 1)),
    )
    windows = F.array(*[F.struct(F.lit(name).alias("name"), a.alias("a"), b.alias("b")) for name, a, b in spans])
    inside = n.select("o_totalprice", F.explode(F.filter(windows, lambda w: (F.col("day") >= w["a"]) & (F.col("day") <= w["b"]))).alias("w"))
    return inside.groupBy(F.col("w.name").alias("period")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def dated_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 newest dated orders of each customer, with their place in time."""
    n = R.ranked(_notes(spark, sf_dir), ["o_custkey"], F.desc("day"), F.col("o_orderkey"), out="timeline_rank")
    return n.where("timeline_rank <= 14").select("o_custkey", "o_orderkey", "timeline_rank")


def ranged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders between a customer's first superseded and last order in force, oldest first, if two
    or more."""
    n = _notes(spark, sf_dir).withColumn("s", X.standing(F.col("note")))
    ends = n.groupBy("o_custkey").agg(F.min(F.when(F.col("s") == "superseded", F.col("day"))).alias("a"), F.max(F.when(F.col("s") == "current", F.col("day"))).alias("b"))
    inside = n.join(ends, "o_custkey").where("day >= a and day <= b").withColumn("k", F.count("*").over(Window.partitionBy("o_custkey")))
    return R.ranked(inside.where("k >= 2"), ["o_custkey"], F.col("day"), F.col("o_orderkey"), out="place").select("o_custkey", "o_orderkey", "place")


def amount_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with different totals on one day: the lowest and the highest."""
    n = _notes(spark, sf_dir).groupBy("o_custkey", "day").agg(F.countDistinct("o_totalprice").alias("values"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return n.where("values > 1").withColumn("day", F.col("day").cast("string"))


def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of a nation whose balances are within five of each other."""
    pairs = X.band_join(read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier"), ("c_nationkey", "s_nationkey"), ("c_acctbal", "s_acctbal"), 5.0)
    return pairs.select("c_custkey", "s_suppkey", F.round(F.abs(F.col("c_acctbal") - F.col("s_acctbal")), 2).alias("apart"))


def letter_swap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part words with their first letters exchanged, repaired by the vocabulary of all names."""
    words = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    vocabulary = words.groupBy("word").agg(F.count("*").alias("n"))
    odd = F.concat(F.substring("word", 2, 1), F.substring("word", 1, 1), F.expr("substring(word, 3)"))
    broken = words.where(F.col("p_partkey") % 3 == 0).select(odd.alias("word"))
    return X.unswapped(broken, vocabulary)


def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent terms of four letters or more of each document."""
    t = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.terms(T.text_or_empty("text"))).alias("term")).where(F.length("term") >= 4)
    return R.ranked(t.groupBy("doc_id", "term").agg(F.count("*").alias("n")), ["doc_id"], F.desc("n"), F.col("term")).where("rank <= 5")


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in their usual words."""
    lookup = F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv])
    named = read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.split("p_name", " "), lambda w: F.coalesce(F.try_element_at(lookup, w), w)), " ").alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stand for a word of a part name, once each."""
    groups = spark.createDataFrame([(i, w) for i, g in enumerate(SYNONYMS) for w in g], "g int, word string")
    words = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    fired = words.join(F.broadcast(groups), "word").select("p_partkey", "g", F.col("word").alias("had"))
    more = fired.join(F.broadcast(groups), "g").where("word <> had").join(words, ["p_partkey", "word"], "left_anti")
    return more.select("p_partkey", "word").distinct()


def ambiguous_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of several part names, and how many."""
    n = read(spark, sf_dir, "part").select("p_name", F.explode(T.terms(F.col("p_name"))).alias("word")).groupBy("word").agg(F.countDistinct("p_name").alias("names"))
    return n.where("names >= 2")


def locator_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an order's lines are, as text."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return l.select("l_orderkey", F.when(F.col("a") == F.col("b"), F.format_string("order %d, line %d", "l_orderkey", "a")).otherwise(F.format_string("order %d, lines %d-%d", "l_orderkey", "a", "b")).alias("label"))


# --- pools ---------------------------------------------------------------------------------------


def _pool_terms(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best documents of each question, and which of its terms each has."""
    top = bm25_topk(spark, sf_dir, k).select("item_id", "doc_id")
    asked = R.question_terms(read(spark, sf_dir, "benchmark"), "item_id", "text")
    has = top.join(R.chunk_stats(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id").select("item_id", "doc_id", F.explode(F.array_distinct("terms")).alias("term"))
    return asked, has.join(asked, ["item_id", "term"], "left_semi")


def pool_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each question term in the pool of its 20 best documents."""
    asked, has = _pool_terms(spark, sf_dir, 20)
    n = bm25_topk(spark, sf_dir, 20).groupBy("item_id").agg(F.count("*").alias("n"))
    df = has.groupBy("item_id", "term").agg(F.count("*").alias("df"))
    return asked.join(n, "item_id").join(df, ["item_id", "term"], "left").select("item_id", "term", F.round(F.log(1 + (F.col("n") + 1) / (1 + F.coalesce("df", F.lit(0)))), 6).alias("weight"))


def uncovered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question terms of more than three letters that its three best documents lack."""
    asked, has = _pool_terms(spark, sf_dir, 3)
    return asked.where(F.length("term") > 3).join(has.select("item_id", "term").distinct(), ["item_id", "term"], "left_anti")


def expand_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the sources of each question's three best: six of each by id, without those
    already found, 15 in all."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    found = rrf_fuse(spark, sf_dir).select("item_id", "doc_id", "rank")
    seeds = found.where("rank <= 3").join(docs, "doc_id").groupBy("item_id", "source").agg(F.min("rank").alias("seed"))
    # of every source only what a seed may take with all that may already be found
    near = R.ranked(docs, ["source"], F.col("doc_id"), out="i").where("i <= 66")
    more = seeds.join(near, "source").join(found.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    six = R.ranked(more, ["item_id", "source"], F.col("doc_id"), out="k").where("k <= 6")
    return R.ranked(six, ["item_id"], F.col("seed"), F.col("k"), out="place").where("place <= 15").select("item_id", "doc_id", "seed", "place")


def short_doc_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of questions' five best documents those that are short, with their words."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.size(T.terms(T.text_or_empty("text"))).cast("long").alias("terms"))
    return bm25_topk(spark, sf_dir, 5).join(d, "doc_id").where("terms <= 120").select("item_id", "doc_id", "terms", "rank")


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval measures against what they must reach."""
    m = retrieval_eval(spark, sf_dir).withColumn("hit_rate", F.round(F.col("hits") / F.col("questions"), 6))
    measures = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value"), F.lit(b).alias("base"), F.lit(t).alias("tolerance")) for n, b, t in GATE])
    g = m.select(F.explode(measures).alias("g")).select("g.*")
    return g.select("measure", "value", (F.col("value") >= F.col("base") - F.col("tolerance")).alias("holds"))


QUERIES = {
    f.__name__: f
    for f in (
        entities_by_kind, value_classify, dates_found, evidence_date, standing, recency_rank, explicit_dates, relative_windows, dated_sweep, ranged_timeline, amount_conflicts,
        band_join, letter_swap_repair, key_terms, canonical_names, synonym_expand, ambiguous_words, locator_labels, pool_term_weights, uncovered_terms,
        expand_sections, short_doc_complete, regression_gate,
    )
}

_N = """n0 AS (SELECT *, o_orderdate::DATE AS day, CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'O' THEN 'in force' ELSE 'open' END AS st FROM orders),
n AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, day, CASE st WHEN 'in force' THEN 'current' WHEN 'open' THEN 'unknown' ELSE st END AS s,
  'Order ' || o_orderkey || ' dated ' || strftime(day, '%d/%m/%Y') || ', total ' || format('{:,.2f}', o_totalprice) || ' AED, due in ' || (o_orderkey % 60 + 1) || ' days, then '
  || strftime(day + (o_orderkey % 60 + 1)::INTEGER, '%d/%m/%Y') || '; status ' || st || ', ref PO-' || lpad(o_orderkey::VARCHAR, 8, '0') || ', share ' || o_custkey % 100 || '%.' AS note FROM n0)"""
_F = f"WITH {_N}, f AS (" + " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(note, '{p}'))) AS value FROM n" for k, p in X.KINDS) + ")"
_CLASS = "CASE " + " ".join(f"WHEN regexp_full_match(value, '{p}') THEN '{k}'" for k, p in X.KINDS) + " ELSE 'attribute' END"
_D = f"WITH {_N}, d AS (SELECT o_orderkey, day, list_transform(regexp_extract_all(note, '{X.KINDS[0][1]}'), lambda x: strptime(x, '%d/%m/%Y')::DATE) AS ds FROM n)"
_HAS = """, asked AS (SELECT * FROM q), has AS (SELECT top.item_id, top.doc_id, post.term, top.rank FROM top JOIN post USING (doc_id) JOIN q ON q.item_id = top.item_id AND q.term = post.term)"""
_SYN = ", ".join(f"({i}, '{w}')" for i, g in enumerate(SYNONYMS) for w in g)
_CANON = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CANONICAL.items()) + " ELSE w END"

SQL = {
    "entities_by_kind": f"{_F} SELECT * FROM f",
    "value_classify": f"{_F} SELECT kind, {_CLASS} AS class, count(*) AS n FROM f GROUP BY ALL",
    "dates_found": f"{_D} SELECT o_orderkey, len(ds)::BIGINT AS n, list_min(ds)::VARCHAR AS first, list_max(ds)::VARCHAR AS last FROM d",
    "evidence_date": f"{_D}, m AS (SELECT max(day) AS today FROM d) SELECT o_orderkey, list_max(list_filter(ds, lambda x: x <= today))::VARCHAR AS day FROM d, m",
    "standing": f"WITH {_N} SELECT s AS standing, count(*) AS n, min(o_orderkey) AS first_order FROM n GROUP BY s",
    "recency_rank": f"""WITH {_N}, w AS (SELECT o_custkey, o_orderkey, round(pow(0.5::DOUBLE, (max(day) OVER (PARTITION BY o_custkey) - day) / 45.0::DOUBLE), 6) AS weight FROM n)
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, o_orderkey)::INTEGER AS rank FROM w""",
    "explicit_dates": f"WITH {_N} SELECT o_orderkey, day::VARCHAR AS day FROM n WHERE day IN (SELECT max(day) FROM n GROUP BY date_trunc('month', day))",
    "relative_windows": f"""WITH {_N}, d AS (SELECT max(day) AS d, date_trunc('month', max(day))::DATE AS m, date_trunc('week', max(day))::DATE AS w FROM n),
        p AS (SELECT 'past 10 days' AS period, d - 10 AS a, d AS b FROM d UNION ALL SELECT 'this week', w, w + 6 FROM d UNION ALL SELECT 'last week', w - 7, w - 1 FROM d
          UNION ALL SELECT 'this month', m, last_day(d) FROM d UNION ALL SELECT 'last month', (m - INTERVAL 1 MONTH)::DATE, m - 1 FROM d)
        SELECT period, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM n JOIN p ON day BETWEEN a AND b GROUP BY period""",
    "dated_sweep": f"WITH {_N} SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey)::INTEGER AS timeline_rank FROM n QUALIFY timeline_rank <= 14",
    "ranged_timeline": f"""WITH {_N}, e AS (SELECT o_custkey, min(day) FILTER (s = 'superseded') AS a, max(day) FILTER (s = 'current') AS b FROM n GROUP BY o_custkey)
        SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey)::INTEGER AS place FROM n JOIN e USING (o_custkey) WHERE day BETWEEN a AND b QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 2""",
    "amount_conflicts": f'WITH {_N} SELECT o_custkey, day::VARCHAR AS day, count(DISTINCT o_totalprice) AS "values", min(o_totalprice) AS low, max(o_totalprice) AS high FROM n GROUP BY o_custkey, day HAVING count(DISTINCT o_totalprice) > 1',
    "band_join": "SELECT c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 2) AS apart FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) <= 5",
    "letter_swap_repair": """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), v AS (SELECT word, count(*) AS n FROM w GROUP BY word),
        b AS (SELECT DISTINCT substring(word, 2, 1) || substring(word, 1, 1) || substring(word, 3) AS word FROM w WHERE p_partkey % 3 = 0),
        t AS (SELECT word, substring(word, 1, i - 1) || substring(word, i + 1, 1) || substring(word, i, 1) || substring(word, i + 2) AS t FROM b, unnest(range(1, length(word))) AS r(i) WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM v))
        SELECT t.word, arg_min(v.word, (-n, v.word)) AS fixed FROM t JOIN v ON v.word = t.t GROUP BY t.word""",
    "key_terms": r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda t: length(t) >= 4)) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term)::INTEGER AS rank FROM c QUALIFY rank <= 5""",
    "canonical_names": f"SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_CANON}), ' ') AS name, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1",
    "synonym_expand": f"""WITH g(g, word) AS (VALUES {_SYN}), w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part)
        SELECT DISTINCT w.p_partkey, b.word FROM w JOIN g a ON a.word = w.word JOIN g b ON b.g = a.g AND b.word <> a.word WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.p_partkey = w.p_partkey AND x.word = b.word)""",
    "ambiguous_words": "WITH w AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, count(DISTINCT p_name) AS names FROM w WHERE length(word) > 1 GROUP BY word HAVING count(DISTINCT p_name) >= 2",
    "locator_labels": """SELECT l_orderkey, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN 'order ' || l_orderkey || ', line ' || min(l_linenumber)
        ELSE 'order ' || l_orderkey || ', lines ' || min(l_linenumber) || '-' || max(l_linenumber) END AS label FROM lineitem GROUP BY l_orderkey""",
    "pool_term_weights": _BASE + _HAS + """, n AS (SELECT item_id, count(*) AS n FROM top GROUP BY item_id), d AS (SELECT item_id, term, count(*) AS df FROM has GROUP BY ALL)
        SELECT item_id, term, round(ln(1 + (n + 1) / (1 + coalesce(df, 0))::DOUBLE), 6) AS weight FROM asked JOIN n USING (item_id) LEFT JOIN d USING (item_id, term)""",
    "uncovered_terms": _BASE + _HAS + " SELECT item_id, term FROM asked WHERE length(term) > 3 AND NOT EXISTS (SELECT 1 FROM has h WHERE h.item_id = asked.item_id AND h.term = asked.term AND h.rank <= 3)",
    "expand_sections": _BASE + """, s AS (SELECT item_id, source, min(rank) AS seed FROM fused JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY ALL),
        m AS (SELECT s.item_id, d.doc_id, s.source, s.seed, row_number() OVER (PARTITION BY s.item_id, s.source ORDER BY d.doc_id) AS k FROM s JOIN documents d ON d.source = s.source
          WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.item_id = s.item_id AND f.doc_id = d.doc_id) QUALIFY k <= 6)
        SELECT item_id, doc_id, seed::INTEGER AS seed, row_number() OVER (PARTITION BY item_id ORDER BY seed, k)::INTEGER AS place FROM m QUALIFY place <= 15""",
    "short_doc_complete": _BASE + " SELECT item_id, doc_id, dl::BIGINT AS terms, rank FROM top JOIN stats USING (doc_id) WHERE rank <= 5 AND dl <= 120",
    "regression_gate": _BASE + """, h AS (SELECT item_id, min(rank) AS first FROM top JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE contains(d.text, b.text) GROUP BY item_id),
        m AS (SELECT count(*)::DOUBLE AS questions, round(count(first) / count(*)::DOUBLE, 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM (SELECT item_id FROM benchmark) LEFT JOIN h USING (item_id))
        """ + " UNION ALL ".join(f"SELECT '{n}' AS measure, {n} AS value, {n} >= {b}::DOUBLE - {t}::DOUBLE AS holds FROM m" for n, b, t in GATE),
}
