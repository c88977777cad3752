"""Evidence checks over tables (lineitem, part), and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import evidence as V
from docloom.operators import filing as G
from docloom.operators import retrieval as R
from docloom.plans.retrieval import read


def _text() -> Column:
    return T.text_or_empty("text")
#: Words that open a question that leans on the one before. What ends a word is spelled
#: out, as engines disagree whether letters beyond ASCII are part of one ("été" is not "et").
FOLLOW_UP = r"(?i)^(?:and|et|und|y|but|aber|mais|pero)(?:[^\p{L}\p{M}\p{N}_]|$)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as the cells of a column: an order is a table, its lines are rows in order of
    line and part."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return R.ranked(l, ["l_orderkey"], *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], out="row")


def column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.column_sums(_cells(spark, sf_dir), "l_orderkey", "row", "l_quantity")


def column_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.column_differences(_cells(spark, sf_dir), "l_orderkey", "row", "l_quantity")


def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order within a budget of 100 units, in order, the first always."""
    return R.within_budget(_cells(spark, sf_dir), ["l_orderkey"], [F.col("row")], F.col("l_quantity"), 100).select("l_orderkey", "row", "used")


def running_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers are a running index, which is never summed."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d"))
    return l.select("l_orderkey", ((F.col("b") - F.col("a") == F.col("n") - 1) & (F.col("d") == F.col("n")) & (F.col("n") >= 2)).alias("is_index"))


def parse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances written as statement cells (brackets, thousands, a dash for small ones) and read."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("b"))
    digits = F.format_number(F.abs("b"), 2)
    cell = F.when(F.abs("b") < 100, "-").when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("("), digits, F.lit(")"))).when(F.col("c_custkey") % 11 == 0, F.concat(digits, F.lit(" AED"))).otherwise(digits)
    return c.select("c_custkey", cell.alias("cell")).select("c_custkey", "cell", T.parse_number(F.col("cell")).cast("double").alias("value"))


def multi_version_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one brand that stand for several sizes."""
    p = read(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.countDistinct("p_size").alias("sizes"), F.min("p_partkey").alias("first_part"))
    return p.where("sizes > 1")


def authority_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the parts of a name the one that prevails, and why: rank, then size, then key."""
    p = read(spark, sf_dir, "part")
    rank = F.when(F.col("p_type") == "PROMO", 2).when(F.col("p_type") == "STANDARD", 1).otherwise(0)
    rows = p.select("p_name", F.struct(rank.alias("rank"), F.col("p_size").alias("size"), (-F.col("p_partkey")).alias("key")).alias("s"))
    # the two best by aggregation: what has most, and the best without it
    top = rows.groupBy("p_name").agg(F.max("s").alias("a"), F.count("*").alias("n"))
    second = rows.join(top.select("p_name", "a"), "p_name").where("s <> a").groupBy("p_name").agg(F.max("s").alias("b"))
    basis = F.when(F.col("b").isNull(), "only").when(F.col("a.rank") > F.col("b.rank"), "authority").when(F.col("a.size") > F.col("b.size"), "version").otherwise("order")
    return top.join(second, "p_name", "left").select("p_name", (-F.col("a.key")).alias("winner"), basis.alias("basis"), "n")


def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each brand; versions are compared number by number."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat(F.lit("v"), "p_size", F.lit("."), F.col("p_partkey") % 12).alias("version"))
    keyed = p.withColumn("key", T.version_key(F.col("version")))
    best = R.first_of(keyed, ["p_brand"], F.desc("key"), F.col("p_partkey"))
    return best.select("p_brand", "p_partkey", "version")


def name_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that share 0.6 of the smaller one's words; each looks for its rarest words alone."""
    n = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("id")).distinct().withColumn("ts", F.array_distinct(T.terms(F.col("id"))))
    both = G.overlap_pairs(n, n, 0.6).where("l < r")
    return both.select(F.col("l").alias("p_name"), F.col("r").alias("other"), F.round("overlap", 6).alias("overlap"))


def supplier_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each nation in order of priority: balances, highest first, three each."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return R.ranked(s, ["n_name"], F.desc("s_acctbal"), F.col("s_suppkey"), out="place").where("place <= 3").select("n_name", "s_suppkey", "place", "s_acctbal")


# --- conversations -----------------------------------------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", _text().alias("text"))


def turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.size(T.terms(F.col("text")))).alias("terms"), F.max("turn").alias("last_turn")
    )
    return t


def previous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every answer the question before it, by hash, and the share of its terms that it repeats."""
    t = V.previous(_turns(spark, sf_dir), "conv_id", "turn", "user", "text", "asked").where("role = 'assistant'")
    return t.select("conv_id", "turn", F.coalesce(F.sha2("asked", 256), F.lit("")).alias("asked_hash"), F.round(V.overlap(T.terms(F.coalesce("asked", F.lit(""))), T.terms(F.col("text"))), 6).alias("overlap"))


def recent_gist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two turns of each conversation on one line, figures masked, 400 characters."""
    last = R.ranked(_turns(spark, sf_dir), ["conv_id"], F.desc("turn"), F.col("role"), out="back").where("back <= 2")
    clean = F.regexp_replace(F.regexp_replace("text", r"\d+", "#"), r"\s+", " ")
    per = last.select("conv_id", "turn", F.concat(F.col("role"), F.lit(": "), clean).alias("said"))
    both = per.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "said"))).alias("s"))
    return both.select("conv_id", F.substring(F.array_join(F.transform("s", lambda x: x["said"]), " / "), 1, 400).alias("gist"))


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short questions, or such that open with a joining word, and the turn whose subject they
    inherit: the last user turn before that is neither."""
    u = _turns(spark, sf_dir).where("role = 'user'")
    leans = (F.size(T.terms(F.col("text"))) < 8) | F.col("text").rlike(FOLLOW_UP)
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("leans", leans).withColumn("subject", F.max(F.when(~F.col("leans"), F.col("turn"))).over(w))
    return u.select("conv_id", "turn", "leans", F.when(F.col("leans"), F.coalesce("subject", F.lit(-1))).otherwise(F.col("turn")).alias("subject_turn"))


def resolved_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns whose next one shares at least 34 % of the smaller one's words."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = _turns(spark, sf_dir).where("role = 'user'").withColumn("next_turn", F.lead("turn").over(w)).withColumn("next_text", F.lead("text").over(w))
    share = F.round(V.overlap(T.terms(F.col("text")), T.terms(F.coalesce("next_text", F.lit("")))), 6)
    return u.where("next_turn is not null").withColumn("share", share).where("share >= 0.34").select("conv_id", "turn", "next_turn", "share")


def answer_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked before, in an earlier conversation, and the last one that asked them. The window sees
    a row for each question and conversation, not the question's repeats."""
    u = _turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", F.sha2(T.normalize(F.col("text")), 256).alias("h"))
    w = Window.partitionBy("h").orderBy("conv_id")
    before = u.select("h", "conv_id").distinct().withColumn("recalled", F.lag("conv_id").over(w)).where("recalled is not null")
    return u.join(before, ["h", "conv_id"]).select("conv_id", "turn", "recalled")


def unsupported_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in answers that the question before them doesn't have."""
    t = V.previous(_turns(spark, sf_dir), "conv_id", "turn", "user", "text", "asked").where("role = 'assistant'")
    t = t.select("conv_id", "turn", F.explode(V.unsupported(F.col("text"), F.coalesce("asked", F.lit("")))).alias("number"))
    return t


def question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns split into their parts of more than six characters."""
    u = _turns(spark, sf_dir).where("role = 'user'")
    parts = F.filter(F.transform(F.split("text", r"[?!.;\n]+"), lambda p: F.trim(p)), lambda p: F.length(p) > 6)
    p = u.select("conv_id", "turn", F.posexplode(parts).alias("part", "body"))
    return p.select("conv_id", "turn", "part", "body")


def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer of each conversation and how long it waited in turns."""
    a = _turns(spark, sf_dir).where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("first_answer"))
    q = _turns(spark, sf_dir).where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("first_question"))
    return q.join(a, "conv_id").select("conv_id", "first_question", "first_answer", (F.col("first_answer") - F.col("first_question")).alias("waited"))


QUERIES = {
    f.__name__: f
    for f in (
        column_sums, column_diffs, running_budget, running_index, parse_cells, multi_version_parts, authority_resolve, version_compare, name_overlap, supplier_rank, turn_stats,
        previous_turn, recent_gist, follow_ups, resolved_by, answer_recall, unsupported_values, question_parts, first_answers,
    )
}

_CELLS = "c AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INTEGER AS row FROM lineitem)"
_T = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1)"
_TERMS = _T.format("text")


def _overlap_sql(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect(list_distinct({a}), list_distinct({b}))) / nullif(least(len(list_distinct({a})), len(list_distinct({b}))), 0)::DOUBLE, 0)"


_U = "u AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')"
_PREV = "p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN coalesce(text, '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations)"
_NORMAL = f"lower(trim(regexp_replace(regexp_replace(translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '{T.MARKS}', '', 'g'), '\\s+', ' ', 'g')))"
_NUMBERS = r"list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\d[\d.,]*'), lambda x: regexp_replace(x, '[.,]+$', '')))"

SQL = {
    "column_sums": f"""WITH {_CELLS}, s AS (SELECT b.l_orderkey, b.row, b.l_quantity AS total, b.row - a.row AS operands FROM c b JOIN c a ON a.l_orderkey = b.l_orderkey AND a.row < b.row - 1 AND a.row >= b.row - 20
          WHERE abs((SELECT sum(l_quantity) FROM c x WHERE x.l_orderkey = b.l_orderkey AND x.row >= a.row AND x.row < b.row) - b.l_quantity) <= 0.5)
        SELECT l_orderkey, row, max(operands)::INTEGER AS operands, any_value(total) AS total FROM s GROUP BY l_orderkey, row""",
    "column_diffs": f"""WITH {_CELLS} SELECT v.l_orderkey, v.row, a.row AS minuend, b.row AS subtrahend FROM c v JOIN c b ON b.l_orderkey = v.l_orderkey AND b.row BETWEEN v.row - 8 AND v.row - 1
        JOIN c a ON a.l_orderkey = v.l_orderkey AND a.row BETWEEN v.row - 8 AND b.row - 1 WHERE abs(a.l_quantity - b.l_quantity - v.l_quantity) <= 0.5
        QUALIFY row_number() OVER (PARTITION BY v.l_orderkey, v.row ORDER BY b.row DESC, a.row DESC) = 1""",
    "running_budget": f"WITH {_CELLS}, u AS (SELECT l_orderkey, row, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY row) AS used FROM c) SELECT * FROM u WHERE used <= 100 OR row = 1",
    "running_index": "SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) = count(*) - 1 AND count(DISTINCT l_linenumber) = count(*) AND count(*) >= 2 AS is_index FROM lineitem GROUP BY l_orderkey",
    "parse_cells": r"""WITH b AS (SELECT c_custkey, c_acctbal::DECIMAL(18,2) AS b FROM customer), d AS (SELECT c_custkey, b, format('{:,.2f}', abs(b)::DOUBLE) AS s FROM b),
        k AS (SELECT c_custkey, CASE WHEN abs(b) < 100 THEN '-' WHEN c_custkey % 7 = 0 THEN '(' || s || ')' WHEN c_custkey % 11 = 0 THEN s || ' AED' ELSE s END AS cell FROM d)
        SELECT c_custkey, cell, CASE WHEN cell = '-' THEN 0 WHEN ends_with(cell, 'AED') THEN NULL WHEN starts_with(cell, '(') THEN -replace(trim(cell, '()'), ',', '')::DOUBLE ELSE replace(cell, ',', '')::DOUBLE END AS value FROM k""",
    "multi_version_parts": "SELECT p_name, p_brand, count(DISTINCT p_size) AS sizes, min(p_partkey) AS first_part FROM part GROUP BY ALL HAVING count(DISTINCT p_size) > 1",
    "authority_resolve": """WITH r AS (SELECT p_name, p_partkey, p_size, CASE p_type WHEN 'PROMO' THEN 2 WHEN 'STANDARD' THEN 1 ELSE 0 END AS rank FROM part),
        o AS (SELECT *, lead(rank) OVER w AS r2, lead(p_size) OVER w AS s2, row_number() OVER w AS i, count(*) OVER (PARTITION BY p_name) AS n FROM r WINDOW w AS (PARTITION BY p_name ORDER BY rank DESC, p_size DESC, p_partkey))
        SELECT p_name, p_partkey AS winner, CASE WHEN r2 IS NULL THEN 'only' WHEN rank > r2 THEN 'authority' WHEN p_size > s2 THEN 'version' ELSE 'order' END AS basis, n FROM o WHERE i = 1""",
    "version_compare": """SELECT p_brand, p_partkey, 'v' || p_size || '.' || p_partkey % 12 AS version FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey % 12 DESC, p_partkey) = 1""",
    "name_overlap": f"""WITH n AS (SELECT DISTINCT p_name || ' ' || p_brand AS id FROM part), m AS (SELECT id, list_distinct({_T.format('id')}) AS ts FROM n)
        SELECT a.id AS p_name, b.id AS other, round({_overlap_sql('a.ts', 'b.ts')}, 6) AS overlap FROM m a JOIN m b ON a.id < b.id WHERE {_overlap_sql('a.ts', 'b.ts')} >= 0.6::DOUBLE""",
    "supplier_rank": """SELECT n_name, s_suppkey, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey)::INTEGER AS place, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY place <= 3""",
    "turn_stats": f"SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, sum(len({_TERMS}))::BIGINT AS terms, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "previous_turn": f"WITH {_PREV} SELECT conv_id, turn, coalesce(sha256(asked), '') AS asked_hash, round({_overlap_sql(_T.format('asked'), _TERMS)}, 6) AS overlap FROM p WHERE role = 'assistant'",
    "recent_gist": r"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS back FROM conversations QUALIFY back <= 2)
        SELECT conv_id, substring(string_agg(role || ': ' || regexp_replace(regexp_replace(coalesce(text, ''), '\d+', '#', 'g'), '\s+', ' ', 'g'), ' / ' ORDER BY turn), 1, 400) AS gist FROM l GROUP BY conv_id""",
    "follow_ups": rf"""WITH {_U}, x AS (SELECT conv_id, turn, len({_TERMS}) < 8 OR regexp_matches(text, '{FOLLOW_UP}') AS leans FROM u)
        SELECT conv_id, turn, leans, CASE WHEN leans THEN coalesce(max(CASE WHEN NOT leans THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) ELSE turn END AS subject_turn FROM x""",
    "resolved_by": f"""WITH {_U}, n AS (SELECT *, lead(turn) OVER w AS next_turn, lead(text) OVER w AS nt FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        s AS (SELECT conv_id, turn, next_turn, round({_overlap_sql(_TERMS, _T.format('nt'))}, 6) AS share FROM n WHERE next_turn IS NOT NULL) SELECT * FROM s WHERE share >= 0.34""",
    "answer_recall": f"""WITH {_U}, h AS (SELECT conv_id, turn, sha256({_NORMAL}) AS h FROM u), m AS (SELECT a.conv_id, a.turn, max(b.conv_id) AS recalled FROM h a JOIN h b ON a.h = b.h AND b.conv_id < a.conv_id GROUP BY ALL) SELECT * FROM m""",
    "unsupported_values": f"""WITH {_PREV}, n AS (SELECT conv_id, turn, asked, unnest({_NUMBERS}) AS number FROM p WHERE role = 'assistant')
        SELECT conv_id, turn, number FROM n WHERE length(number) >= 3 AND NOT contains(replace(coalesce(asked, ''), ',', ''), replace(number, ',', ''))""",
    "question_parts": r"""WITH u AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '[?!.;\n]+'), lambda x: length(trim(x)) > 6) AS ps FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, (i - 1)::INTEGER AS part, trim(ps[i]) AS body FROM u, unnest(range(1, len(ps) + 1)) AS r(i)""",
    "first_answers": """SELECT conv_id, min(turn) FILTER (role = 'user') AS first_question, min(turn) FILTER (role = 'assistant') AS first_answer,
        min(turn) FILTER (role = 'assistant') - min(turn) FILTER (role = 'user') AS waited FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')""",
}
