"""Retrieval queries: benchmark texts ask, documents answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import retrieval as R


#: Tables whose rows are work by themselves (papers, questions and names are written from them).
DEALT = ("customer", "orders", "part", "supplier")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of few files dealt out to all cores: a file of one row group would be read, and what is made of
    its rows be worked out, by one task."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks) if len(df.inputFiles()) < tasks else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(df) if name in DEALT else df


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.question_terms(read(spark, sf_dir, "benchmark"), "item_id", "text")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk_stats(read(spark, sf_dir, "documents"), "doc_id", "text")


def _best(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int) -> DataFrame:
    found = R.arms(asked, "item_id", read(spark, sf_dir, "documents"), "doc_id", "text", k).select("item_id", "doc_id", F.col("value").alias("score"))
    return R.ranked(found, ["item_id"], F.desc("score"), F.col("doc_id")).where(F.col("rank") <= k)


def bm25_topk(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The 20 best documents of every question."""
    return _best(spark, sf_dir, _asked(spark, sf_dir), k)


def bm25_weighted(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """As bm25_topk, with terms that hold digits weighing half, as expansions do."""
    weight = F.when(F.col("term").rlike(r"\d"), 0.5).otherwise(1.0)
    return _best(spark, sf_dir, _asked(spark, sf_dir).withColumn("weight", weight), k)


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and count of every term."""
    stats = _stats(spark, sf_dir)
    return R.postings(stats, "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def chunk_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _stats(spark, sf_dir).where("len > 0")
    return stats.select("doc_id", F.col("len").cast("long").alias("len"), F.size(F.array_distinct("terms")).cast("long").alias("distinct_terms"))


def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two rarest known terms without digits of each question, if in at most 3 % of documents."""
    asked, stats = _asked(spark, sf_dir), _stats(spark, sf_dir)
    df = R.postings(stats, "doc_id", asked).groupBy("term").agg(F.count("*").alias("df"))
    rare = asked.join(df, "term").where((F.col("df") <= R.RARE_SHARE * R.totals(stats)[0]) & ~F.col("term").rlike(r"\d"))
    return R.ranked(rare, ["item_id"], F.col("df"), F.col("term")).where("rank <= 2").select("item_id", "term", "df", "rank")


def unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of conversation turns that no document has."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", "turn", F.explode(F.array_distinct(T.terms(T.text_or_empty("text")))).alias("term"))
    known = _stats(spark, sf_dir).select(F.explode("terms").alias("term")).distinct()
    return asked.join(known, "term", "left_anti").groupBy("conv_id", "turn").agg(F.sort_array(F.collect_set("term")).alias("ts")).select(
        "conv_id", "turn", F.array_join("ts", " ").alias("unknown"), F.size("ts").cast("long").alias("n")
    )


def _arms(spark: SparkSession, sf_dir: str, pool: int = 30) -> DataFrame:
    """Both arms' pools: ``item_id, doc_id, arm, rank, value``."""
    found = R.arms(_asked(spark, sf_dir), "item_id", read(spark, sf_dir, "documents"), "doc_id", "text", pool, (R.KEYWORD, R.COVERAGE))
    return R.ranked(found, ["item_id", "arm"], F.desc("value"), F.col("doc_id")).where(F.col("rank") <= pool)


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the keyword and coverage arms' pools of 30."""
    fused = R.fuse(_arms(spark, sf_dir), "item_id", "doc_id")
    return R.ranked(fused, ["item_id"], F.desc("fused"), F.col("doc_id")).withColumn("origins", F.array_join("origins", "+"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_arm = _arms(spark, sf_dir)
    value = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("value")))
    return per_arm.groupBy("item_id", "doc_id").agg(
        F.round(F.sum(F.lit(R.RRF) / (F.lit(R.RRF) + F.col("rank"))), 6).alias("fused"),
        F.coalesce(value("keyword"), F.lit(0.0)).alias("keyword"),
        F.coalesce(value("coverage"), F.lit(0.0)).alias("coverage"),
    )


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question passes if one of its eight best fused documents covers enough of its terms."""
    pool = R.ranked(_pool(spark, sf_dir), ["item_id"], F.desc("fused"), F.col("doc_id")).where("rank <= 8")
    best = pool.groupBy("item_id").agg(F.max("coverage").alias("best"))
    items = read(spark, sf_dir, "benchmark").select("item_id")
    return items.join(best, "item_id", "left").select("item_id", F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("best", F.lit(0.0)) >= R.COVERAGE_FLOOR).alias("passes"))


def reserved_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten places for each question, the three best-covering documents first."""
    pool = R.ranked(_pool(spark, sf_dir), ["item_id"], F.desc("coverage"), F.col("doc_id"), out="by_coverage")
    out = R.reserve(pool, ["item_id"], F.col("by_coverage") <= 3, [F.desc("fused"), F.col("doc_id")], 3, 10)
    return out.select("item_id", "doc_id", "place", (F.col("lead") == 0).alias("reserved"))


def context_budget(spark: SparkSession, sf_dir: str, budget: int = 12_000) -> DataFrame:
    """The fused documents of each question that fit the context, in order, the first always."""
    ranked = rrf_fuse(spark, sf_dir).select("item_id", "doc_id", "rank")
    sized = ranked.join(read(spark, sf_dir, "documents").select("doc_id", F.length(T.text_or_empty("text")).cast("long").alias("chars")), "doc_id")
    return R.within_budget(sized, ["item_id"], [F.col("rank")], F.col("chars"), budget).select("item_id", "doc_id", "position", "used")


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three found by both arms are primary, other finds of the keyword arm supporting, the
    rest related; places by tier."""
    fused = rrf_fuse(spark, sf_dir).withColumn("direct", F.col("origins").contains("+"))
    nth = F.row_number().over(Window.partitionBy("item_id", "direct").orderBy("rank"))
    tier = F.when(F.col("direct") & (nth <= 3), 0).when(F.col("origins").contains("keyword"), 1).otherwise(2)
    return R.ranked(fused.withColumn("tier", tier), ["item_id"], F.col("tier"), F.col("rank"), out="place").select("item_id", "doc_id", "tier", "place")


def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin by language: each language's best document, then each second one, and so on."""
    docs = read(spark, sf_dir, "documents")
    found = R.arms(_asked(spark, sf_dir), "item_id", docs, "doc_id", "text", 5, group="lang")
    found = found.select("item_id", "doc_id", F.col("part").alias("lang"), F.col("value").alias("score"))
    turn = R.ranked(found, ["item_id", "lang"], F.desc("score"), F.col("doc_id"), out="turn").where("turn <= 5")
    return R.ranked(turn, ["item_id"], F.col("turn"), F.col("lang"), F.col("doc_id"), out="place").select("item_id", "doc_id", "lang", "turn", "place")


def which_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose six best documents are of several sources, with the first three sources."""
    top = bm25_topk(spark, sf_dir, 6).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    first = top.groupBy("item_id", "source").agg(F.min("rank").alias("rank"))
    n = F.count("*").over(Window.partitionBy("item_id"))
    out = R.ranked(first.withColumn("n_sources", n), ["item_id"], F.col("rank"), out="choice").where("n_sources >= 2 and choice <= 3")
    return out.select("item_id", "source", "choice", "n_sources")


def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every twentieth vector, by cosine, from 0.25 on."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", T.cosine_ready(F.col("embedding")).alias("unit")).where("unit is not null")
    return R.top_vectors(v, 20, 10)


def vector_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that most neighbours of each queried vector have (ties to the smaller label)."""
    labels = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    votes = vector_knn(spark, sf_dir).join(labels, "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    return R.first_of(votes, ["query_id"], F.desc("votes"), F.col("label"))


def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a document that holds the question's text whole is found, and how high."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.text_or_empty("text").alias("body"))
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    top = bm25_topk(spark, sf_dir).join(docs, "doc_id").join(items, "item_id")
    hit = top.where(F.col("body").contains(F.col("text"))).groupBy("item_id").agg(F.min("rank").alias("first"))
    per = items.select("item_id").join(hit, "item_id", "left")
    return per.agg(
        F.count("*").alias("questions"),
        F.count("first").alias("hits"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_weighted, term_stats, chunk_lengths, rare_terms, unknown_terms, rrf_fuse, coverage_gate, reserved_slots,
        context_budget, tiers, side_by_side, which_source, vector_knn, vector_label_vote, retrieval_eval,
    )
}

_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda t: length(t) > 1)"
_STATS = f"""
st AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
stats AS (SELECT doc_id, ts, len(ts)::DOUBLE AS dl FROM st WHERE len(ts) > 0),
tok AS (SELECT doc_id, dl, unnest(ts) AS term FROM stats),
post AS (SELECT doc_id, term, any_value(dl) AS dl, count(*)::DOUBLE AS tf FROM tok GROUP BY doc_id, term),
tstat AS (SELECT term, count(*)::DOUBLE AS df, sum(tf) AS cf FROM post GROUP BY term),
g AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM stats),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark)"""


def _score_sql(weight: str = "1.0::DOUBLE") -> str:
    return f"""
sc AS (SELECT q.item_id, p.doc_id, round(sum(
  ln(1 + (g.n - t.df + 0.5::DOUBLE) / (t.df + 0.5::DOUBLE)) * {weight} * p.tf * 2.4::DOUBLE / (p.tf + 1.4::DOUBLE * (0.28::DOUBLE + 0.72::DOUBLE * p.dl / g.a))), 6) AS score
  FROM q JOIN post p USING (term) JOIN tstat t USING (term), g GROUP BY q.item_id, p.doc_id)"""


_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc QUALIFY rank <= 20)"
_COVER = """
cov AS (SELECT item_id, doc_id, round(count(*) / any_value(a.asked)::DOUBLE, 6) AS covered
  FROM post JOIN q USING (term) JOIN (SELECT item_id, count(*) AS asked FROM q GROUP BY item_id) a USING (item_id) GROUP BY item_id, doc_id),
arms AS (SELECT *, row_number() OVER (PARTITION BY item_id, arm ORDER BY value DESC, doc_id)::INTEGER AS rank FROM (
    SELECT item_id, doc_id, score AS value, 'keyword' AS arm FROM sc UNION ALL SELECT item_id, doc_id, covered, 'coverage' FROM cov) QUALIFY rank <= 30),
pool AS (SELECT item_id, doc_id, round(sum(60::DOUBLE / (60 + rank)), 6) AS fused, coalesce(max(value) FILTER (arm = 'keyword'), 0) AS keyword,
    coalesce(max(value) FILTER (arm = 'coverage'), 0) AS coverage, array_to_string(list_sort(list_distinct(list(arm))), '+') AS origins FROM arms GROUP BY item_id, doc_id),
fused AS (SELECT item_id, doc_id, fused, origins, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id)::INTEGER AS rank FROM pool)"""
_BASE = f"WITH {_STATS}, {_score_sql()}, {_TOP}, {_COVER}\n"
_KNN = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
knn AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, round(list_cosine_similarity(q.e, c.e), 6) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, c.e), 6) DESC, c.vec_id)::INTEGER AS rank
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id WHERE round(list_cosine_similarity(q.e, c.e), 6) >= 0.25 QUALIFY rank <= 10)
"""

SQL = {
    "bm25_topk": _BASE + "SELECT * FROM top",
    "bm25_weighted": f"WITH {_STATS}, {_score_sql(chr(40) + 'CASE WHEN regexp_matches(q.term, ' + chr(39) + '[0-9]' + chr(39) + ') THEN 0.5::DOUBLE ELSE 1 END' + chr(41))}, {_TOP} SELECT * FROM top",
    "term_stats": f"WITH {_STATS} SELECT term, df::BIGINT AS df, cf::BIGINT AS cf FROM tstat",
    "chunk_lengths": f"WITH {_STATS} SELECT doc_id, dl::BIGINT AS len, len(list_distinct(ts))::BIGINT AS distinct_terms FROM stats",
    "rare_terms": f"""WITH {_STATS} SELECT item_id, term, df::BIGINT AS df, row_number() OVER (PARTITION BY item_id ORDER BY df, term)::INTEGER AS rank
        FROM q JOIN tstat USING (term), g WHERE df <= 0.03 * n AND NOT regexp_matches(term, '[0-9]') QUALIFY rank <= 2""",
    "unknown_terms": f"""WITH {_STATS}, c AS (SELECT DISTINCT conv_id, turn, unnest({_TERMS}) AS term FROM conversations)
        SELECT conv_id, turn, string_agg(term, ' ' ORDER BY term) AS unknown, count(*) AS n FROM c ANTI JOIN tstat USING (term) GROUP BY conv_id, turn""",
    "rrf_fuse": _BASE + "SELECT * FROM fused",
    "coverage_gate": _BASE + """SELECT item_id, coalesce(best, 0) AS best, coalesce(best, 0) >= 0.35 AS passes FROM (SELECT item_id FROM benchmark) LEFT JOIN (
        SELECT item_id, max(coverage) AS best FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS r FROM pool QUALIFY r <= 8) GROUP BY item_id) USING (item_id)""",
    "reserved_slots": _BASE + """, b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, doc_id) <= 3 AS reserved FROM pool)
        SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY reserved DESC, fused DESC, doc_id)::INTEGER AS place, reserved FROM b QUALIFY place <= 10""",
    "context_budget": _BASE + """, u AS (SELECT item_id, doc_id, rank AS position, (sum(length(coalesce(text, ''))) OVER (PARTITION BY item_id ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT AS used
          FROM fused JOIN documents USING (doc_id)) SELECT * FROM u WHERE used <= 12000 OR position = 1""",
    "tiers": _BASE + """, d AS (SELECT *, contains(origins, '+') AS direct FROM fused),
        t AS (SELECT *, CASE WHEN direct AND row_number() OVER (PARTITION BY item_id, direct ORDER BY rank) <= 3 THEN 0 WHEN contains(origins, 'keyword') THEN 1 ELSE 2 END AS tier FROM d)
        SELECT item_id, doc_id, tier, row_number() OVER (PARTITION BY item_id ORDER BY tier, rank)::INTEGER AS place FROM t""",
    "side_by_side": _BASE + """, t AS (SELECT item_id, doc_id, lang, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id)::INTEGER AS turn FROM sc JOIN documents USING (doc_id) QUALIFY turn <= 5)
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY turn, lang, doc_id)::INTEGER AS place FROM t""",
    "which_source": _BASE + """, f AS (SELECT item_id, source, min(rank) AS r FROM top JOIN documents USING (doc_id) WHERE rank <= 6 GROUP BY item_id, source)
        SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY r)::INTEGER AS choice, count(*) OVER (PARTITION BY item_id) AS n_sources FROM f QUALIFY n_sources >= 2 AND choice <= 3""",
    "vector_knn": _KNN + "SELECT query_id, vec_id, similarity, rank FROM knn",
    "vector_label_vote": _KNN + "SELECT query_id, label, count(*) AS votes FROM knn GROUP BY query_id, label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1",
    "retrieval_eval": _BASE + """, h AS (SELECT item_id, min(rank) AS first FROM top JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE contains(d.text, b.text) GROUP BY item_id)
        SELECT count(*) AS questions, count(first) AS hits, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM (SELECT item_id FROM benchmark) LEFT JOIN h USING (item_id)""",
}
