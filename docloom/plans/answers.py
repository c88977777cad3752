"""Question plans, answer checks, and the workflow around documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vocabulary as W
from docloom.operators import evidence as V
from docloom.operators import language as L
from docloom.operators import retrieval as R
from docloom.operators import structure as S
from docloom.plans.analysis import _plain
from docloom.plans.language import _asked, _questions, has, normal, quoted
from docloom.plans.retrieval import _BASE, bm25_topk, read, rrf_fuse

#: Topic keywords weighed by where a page has them.
TOPICS = (("grammar", ("the", "and")), ("french", ("les", "des")), ("german", ("der", "und")), ("spanish", ("los", "que")))
LEAST_SHARE, LEAST_BOUND = 0.34, 0.2
#: What parts a question.
PARTED = r"[?!.;؟،\n]+"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.text_or_empty("text").alias("text"))


def question_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, size and figures of every user turn in one projection."""
    u = _turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", "text", T.terms(F.col("text")).alias("ts"))
    return u.select("conv_id", "turn", L.intent(T.normalize(F.col("text"))).alias("intent"), F.size("ts").cast("long").alias("terms"), F.size(T.numeric_tokens(F.col("text"))).cast("long").alias("numbers"), T.language(F.col("text")).alias("script"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of user turns with the answer that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _turns(spark, sf_dir).withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w)).where("role = 'user' and next = 'assistant'")
    pieces = F.filter(F.split("text", r"[?!.;\n]+"), lambda p: F.length(F.trim(p)) > 6)
    return t.select("conv_id", "turn", "answer", F.posexplode(pieces).alias("part", "body"))


def part_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each part's distinct terms that the answer has, and whether that is enough."""
    p = _parts(spark, sf_dir).select("conv_id", "turn", "part", F.array_distinct(T.terms(F.col("body"))).alias("ts"), F.array_distinct(T.terms(F.col("answer"))).alias("as"))
    share = F.when(F.size("ts") > 0, F.round(F.size(F.array_intersect("ts", "as")) / F.size("ts"), 6)).otherwise(0.0)
    return p.select("conv_id", "turn", "part", share.alias("share"), (share >= LEAST_SHARE).alias("covered"))


def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered parts of every answered turn."""
    c = part_coverage(spark, sf_dir)
    return c.groupBy("conv_id", "turn").agg(F.count("*").alias("checked"), F.count_if("covered").alias("satisfied"), F.round(F.avg(F.col("covered").cast("int")), 3).alias("score"), F.every("covered").alias("complete"))


def answer_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part of a question asks for: two kinds at most, by the whole lists of cues in their order; six for a
    question. A date that the question names is no cue."""
    parts = F.filter(F.split("q", PARTED), lambda p: F.length(F.trim(p)) > 6)
    p = _questions(spark, sf_dir).select("o_orderkey", F.posexplode(parts).alias("part", "body"))
    p = p.withColumn("n", F.regexp_replace(T.normalize(F.col("body")), L.GIVEN_DATE, " "))
    kinds = F.array_compact(F.array(*[F.when(F.col("n").rlike(T.cues(words)), name) for name, words in W.INTENTS.items()]))
    fired = p.select("o_orderkey", "part", F.posexplode(F.slice(kinds, 1, 2)).alias("nth", "kind"))
    return R.ranked(fired, ["o_orderkey"], F.col("part"), F.col("nth"), out="place").where("place <= 6").drop("nth")


def bind_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sentences of the answer that share most terms with each part, from a fifth on."""
    p = _parts(spark, sf_dir).select("conv_id", "turn", "part", F.array_distinct(T.terms(F.col("body"))).alias("ts"), F.posexplode(F.split("answer", r"[.!?]+\s+")).alias("sentence", "s"))
    p = p.withColumn("overlap", F.round(V.overlap(F.col("ts"), T.terms(F.col("s"))), 6)).where(F.col("overlap") >= LEAST_BOUND)
    return R.ranked(p, ["conv_id", "turn", "part"], F.desc("overlap"), F.col("sentence"), out="place").where("place <= 3").select("conv_id", "turn", "part", "sentence", "overlap", "place")


def contained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a question's text whole."""
    return R.holding(read(spark, sf_dir, "benchmark"), "item_id", read(spark, sf_dir, "documents"), "doc_id", "text")


def looked_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five sources among each question's best documents, in order, as one text."""
    top = bm25_topk(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    first = R.ranked(top.groupBy("item_id", "source").agg(F.min("rank").alias("rank")), ["item_id"], F.col("rank"), out="n").where("n <= 5")
    s = first.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("n", "source"))).alias("s"))
    return s.select("item_id", F.array_join(F.transform("s", lambda x: x["source"]), " > ").alias("sources"))


def source_first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused documents with those of the best one's source first."""
    f = rrf_fuse(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    best = f.where("rank = 1").select("item_id", F.col("source").alias("named"))
    f = f.join(best, "item_id").withColumn("own", F.coalesce(F.col("source") == F.col("named"), F.lit(False)))
    return R.ranked(f, ["item_id"], F.desc("own"), F.col("rank"), out="place").select("item_id", "doc_id", "own", "place")


def rare_term_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a question's rarest term that fusion has missed, four at most, after the
    first three."""
    asked = R.question_terms(read(spark, sf_dir, "benchmark"), "item_id", "text")
    post = R.postings(R.chunk_stats(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", asked)
    rarest = R.first_of(asked.join(post.groupBy("term").agg(F.count("*").alias("df")), "term"), ["item_id"], F.col("df"), F.col("term"))
    fused = rrf_fuse(spark, sf_dir).select("item_id", "doc_id", "rank")
    fresh = rarest.join(post, "term").select("item_id", "doc_id", "tf").join(fused, ["item_id", "doc_id"], "left_anti")
    fresh = R.ranked(fresh, ["item_id"], F.desc("tf"), F.col("doc_id"), out="i").where("i <= 4").select("item_id", "doc_id", (F.lit(3) + F.col("i") / 10).alias("at"), F.lit(True).alias("spliced"))
    both = fused.select("item_id", "doc_id", F.col("rank").cast("double").alias("at"), F.lit(False).alias("spliced")).unionByName(fresh)
    return R.ranked(both, ["item_id"], F.col("at"), out="place").select("item_id", "doc_id", "spliced", "place")


# --- documents and pages -----------------------------------------------------------------------


def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, address and body of each page as one text to embed, by hash."""
    html = T.text_or_empty("html")
    p = read(spark, sf_dir, "pages").select("page_id", S.plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), S.host(T.text_or_empty("url")).alias("host"), S.plain(html).alias("body"))
    return p.select("page_id", F.sha2(F.trim(F.concat_ws("\n", "title", "host", "body")), 256).alias("hash"))


def topic_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic by keywords: three points in the title, two in the first 200 characters, one after;
    two points are needed, of equal topics the first listed wins."""
    html = T.text_or_empty("html")
    p = read(spark, sf_dir, "pages").select("page_id", S.plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), S.plain(html).alias("body"))
    p = p.select("page_id", T.terms(F.col("title")).alias("a"), T.terms(F.substring("body", 1, 200)).alias("b"), T.terms(F.col("body")).alias("c"))
    points = lambda w: F.when(F.array_contains("a", w), 3).when(F.array_contains("b", w), 2).when(F.array_contains("c", w), 1).otherwise(0)
    scores = F.array(*[F.struct((points(w) + points(x)).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, (w, x)) in enumerate(TOPICS)])
    best = p.select("page_id", F.array_max(scores).alias("m"))
    return best.select("page_id", F.when(F.col("m.n") >= 2, F.col("m.t")).otherwise("none").alias("topic"), F.col("m.n").alias("points"))


def rebuilt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together again from their lines, by hash."""
    l = S.lines(read(spark, sf_dir, "documents"), "doc_id", T.text_or_empty("text"))
    per = l.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "content"))).alias("ls"))
    return per.select("doc_id", F.sha2(F.array_join(F.transform("ls", lambda x: x["content"]), "\n"), 256).alias("hash"))


def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry after an upload in which pages replace the documents of their ids."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.text_or_empty("text").alias("body"), F.lit("document").alias("kind"))
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.text_or_empty("html").alias("body"), F.lit("page").alias("kind"))
    now = d.join(p, "id", "left_anti").unionByName(p)
    return now.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("body").cast("long")).alias("chars"))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left by language once those marked toxic are deleted."""
    gone = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return read(spark, sf_dir, "documents").join(gone, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


def upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest wins: a second load relabels every third vector; counts by final label."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(0).alias("load"))
    again = v.where(F.col("vec_id") % 3 == 0).select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("load"))
    last = v.unionByName(again).groupBy("vec_id").agg(F.max(F.struct("load", "label"))["label"].alias("label"))
    return last.groupBy("label").agg(F.count("*").alias("n"))


def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name has one of the asked words, the first 40 in order."""
    hit = F.exists(F.array(*[F.lit(w) for w in ("ring", "red", "bolt")]), lambda w: F.contains("p_name", w))
    p = read(spark, sf_dir, "part").where(hit & F.col("p_type").isin("ECONOMY", "PROMO"))
    return p.orderBy("p_name", "p_partkey").limit(40).select("p_partkey", "p_name", "p_type")


def open_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer that are offered: the three oldest open ones."""
    o = R.ranked(read(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"), out="nth")
    return o.where("nth <= 3").select("o_custkey", "o_orderkey", "nth")


QUERIES = {
    f.__name__: f
    for f in (
        question_plan, part_coverage, coverage_score, answer_contract, bind_evidence, contained_passages, looked_at, source_first_merge, rare_term_splice, embed_text,
        topic_of_page, rebuilt_text, replaced_documents, tombstones, upsert_vectors, entity_lookup, open_cap,
    )
}

_T = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1)"
_U = "u AS (SELECT *, lead(coalesce(text, '')) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
_P = rf"""{_U}, a0 AS (SELECT conv_id, turn, answer, list_filter(regexp_split_to_array(coalesce(text, ''), '[?!.;\n]+'), lambda x: length(trim(x)) > 6) AS ps FROM u WHERE role = 'user' AND next = 'assistant'),
p AS (SELECT conv_id, turn, answer, (i - 1)::INTEGER AS part, list_distinct({_T.format('ps[i]')}) AS ts, {_T.format('ps[i]')} AS all_ts FROM a0, unnest(range(1, len(ps) + 1)) AS r(i)),
pc AS (SELECT conv_id, turn, part, CASE WHEN len(ts) > 0 THEN round(len(list_intersect(ts, {_T.format('answer')})) / len(ts)::DOUBLE, 6) ELSE 0 END AS share FROM p),
c AS (SELECT *, share >= 0.34 AS covered FROM pc)"""
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_NORMAL = normal("coalesce(text, '')")
_ASKED = f"regexp_replace({_NORMAL}, {quoted(L.GIVEN_DATE)}, ' ', 'g')"
_INTENT = f"CASE WHEN {has(_NORMAL, ('متى', 'when'))} AND {has(_NORMAL, W.INTENTS['aggregation'])} THEN 'timeline' " + " ".join(f"WHEN {has(_ASKED, ws)} THEN '{name}'" for name, ws in W.INTENTS.items()) + " ELSE 'fact' END"


def _over(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect(list_distinct({a}), list_distinct({b}))) / nullif(least(len(list_distinct({a})), len(list_distinct({b}))), 0)::DOUBLE, 0)"


_TITLE = _plain("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")
_BODY = _plain("coalesce(html, '')")
_HOST = "lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/:?#]+)', 1))"
_RAREST = "rr AS (SELECT item_id, term FROM q JOIN tstat USING (term) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY df, term) = 1)"
_POINTS = lambda w: f"(CASE WHEN list_contains(a, '{w}') THEN 3 WHEN list_contains(b, '{w}') THEN 2 WHEN list_contains(c, '{w}') THEN 1 ELSE 0 END)"
_TOPICS = ", ".join(f"{{'n': {_POINTS(w)} + {_POINTS(x)}, 'o': {-i}, 't': '{t}'}}" for i, (t, (w, x)) in enumerate(TOPICS))

SQL = {
    "question_plan": rf"""WITH t AS (SELECT conv_id, turn, text, {_T.format('text')} AS ts, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '{T.LATIN}', '', 'g')) AS la,
          length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '{T.ARABIC}', '', 'g')) AS ar FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, {_INTENT} AS intent, len(ts)::BIGINT AS terms, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\d[\d.,]*'), lambda x: regexp_replace(x, '[.,]+$', ''))))::BIGINT AS numbers,
          CASE WHEN la + ar = 0 THEN 'none' WHEN ar / (la + ar) >= 0.6 THEN 'ar' WHEN ar / (la + ar) <= 0.15 THEN 'en' ELSE 'mixed' END AS script FROM t""",
    "part_coverage": f"WITH {_P} SELECT * FROM c",
    "coverage_score": f"WITH {_P} SELECT conv_id, turn, count(*) AS checked, count(*) FILTER (covered) AS satisfied, round(avg(covered::INTEGER), 3) AS score, bool_and(covered) AS complete FROM c GROUP BY conv_id, turn",
    "answer_contract": f"""WITH {_asked()}, p AS (SELECT o_orderkey, list_filter(regexp_split_to_array(q, '{PARTED}'), lambda p: length(trim(p)) > 6) AS ps FROM q),
        x AS (SELECT o_orderkey, (i - 1)::INTEGER AS part, regexp_replace({normal('ps[i]')}, {quoted(L.GIVEN_DATE)}, ' ', 'g') AS n FROM p, unnest(range(1, len(ps) + 1)) AS r(i)),
        k AS (SELECT o_orderkey, part, list_filter([{', '.join(f"CASE WHEN {has('n', ws)} THEN '{k}' END" for k, ws in W.INTENTS.items())}], lambda k: k IS NOT NULL)[1:2] AS ks FROM x),
        f AS (SELECT o_orderkey, part, unnest(ks) AS kind, unnest(range(len(ks))) AS nth FROM k)
        SELECT o_orderkey, part, kind, row_number() OVER (PARTITION BY o_orderkey ORDER BY part, nth)::INTEGER AS place FROM f QUALIFY place <= 6""",
    "bind_evidence": rf"""WITH {_P}, s AS (SELECT conv_id, turn, part, ts, (j - 1)::INTEGER AS sentence, ss[j] AS s FROM (SELECT *, regexp_split_to_array(answer, '[.!?]+\s+') AS ss FROM p), unnest(range(1, len(ss) + 1)) AS r(j)),
        o AS (SELECT conv_id, turn, part, sentence, round({_over('ts', _T.format('s'))}, 6) AS overlap FROM s)
        SELECT *, row_number() OVER (PARTITION BY conv_id, turn, part ORDER BY overlap DESC, sentence)::INTEGER AS place FROM o WHERE overlap >= 0.2 QUALIFY place <= 3""",
    "contained_passages": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "looked_at": _BASE + """, f AS (SELECT item_id, source, min(rank) AS r FROM top JOIN documents USING (doc_id) GROUP BY ALL), gg AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY r) AS n FROM f QUALIFY n <= 5)
        SELECT item_id, string_agg(source, ' > ' ORDER BY n) AS sources FROM gg GROUP BY item_id""",
    "source_first_merge": _BASE + """, f AS (SELECT fused.*, source, first_value(source) OVER (PARTITION BY item_id ORDER BY rank) AS named FROM fused JOIN documents USING (doc_id)),
        gg AS (SELECT item_id, doc_id, rank, coalesce(source = named, false) AS own FROM f) SELECT item_id, doc_id, own, row_number() OVER (PARTITION BY item_id ORDER BY own DESC, rank)::INTEGER AS place FROM gg""",
    "rare_term_splice": _BASE + f""", {_RAREST}, m AS (SELECT rr.item_id, post.doc_id, tf FROM rr JOIN post USING (term) WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.item_id = rr.item_id AND f.doc_id = post.doc_id)),
        s AS (SELECT item_id, doc_id, 3 + row_number() OVER (PARTITION BY item_id ORDER BY tf DESC, doc_id) / 10.0::DOUBLE AS pos, true AS spliced FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY tf DESC, doc_id) <= 4),
        b AS (SELECT item_id, doc_id, rank::DOUBLE AS pos, false AS spliced FROM fused UNION ALL SELECT * FROM s)
        SELECT item_id, doc_id, spliced, row_number() OVER (PARTITION BY item_id ORDER BY pos)::INTEGER AS place FROM b""",
    "embed_text": f"SELECT page_id, sha256(trim({_TITLE} || chr(10) || {_HOST} || chr(10) || {_BODY})) AS hash FROM pages",
    "topic_of_page": f"""WITH t AS (SELECT page_id, {_TITLE} AS title, {_BODY} AS body FROM pages), w AS (SELECT page_id, {_T.format('title')} AS a, {_T.format('substring(body, 1, 200)')} AS b, {_T.format('body')} AS c FROM t),
        m AS (SELECT page_id, list_max([{_TOPICS}]) AS m FROM w) SELECT page_id, CASE WHEN m.n >= 2 THEN m.t ELSE 'none' END AS topic, m.n::INTEGER AS points FROM m""",
    "rebuilt_text": "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents",
    "replaced_documents": """WITH r AS (SELECT 'document' AS kind, length(coalesce(text, '')) AS c FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages) UNION ALL SELECT 'page', length(coalesce(html, '')) FROM pages)
        SELECT kind, count(*) AS n, sum(c)::BIGINT AS chars FROM r GROUP BY kind""",
    "tombstones": "SELECT lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) GROUP BY lang",
    "upsert_vectors": "SELECT CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, count(*) AS n FROM embeddings GROUP BY 1",
    "entity_lookup": "SELECT p_partkey, p_name, p_type FROM part WHERE (contains(p_name, 'ring') OR contains(p_name, 'red') OR contains(p_name, 'bolt')) AND p_type IN ('ECONOMY', 'PROMO') ORDER BY p_name, p_partkey LIMIT 40",
    "open_cap": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS nth FROM orders WHERE o_orderstatus = 'O' QUALIFY nth <= 3",
}
