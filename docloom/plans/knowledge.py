"""Taught knowledge and its workflow: parts are items, customers are users, lines are versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import knowledge as K
from docloom.operators import retrieval as R
from docloom.operators.store import stored
from docloom.plans.analytics import _E, _events
from docloom.plans.language import content_list, listed
from docloom.plans.retrieval import read

TYPES = ("fact", "rule", "preference", "correction", "terminology", "procedure")
SCOPES = ("global", "department", "team", "user")
STATUSES = ("draft", "pending", "in_review", "approved", "active", "active", "active", "rejected", "archived")
FACTUAL = ("fact", "correction", "terminology")


def _pick(xs: tuple[str, ...], k) -> F.Column:
    return F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    content = F.concat(F.lit("The "), F.col("p_name"), F.lit(" has size "), F.col("p_size"), F.lit(" and ships by "), F.col("p_brand"))
    return read(spark, sf_dir, "part").select(
        k.alias("item"), _pick(TYPES, k % 6).alias("type"), _pick(SCOPES, F.floor(k / 6) % 4).alias("scope"), _pick(STATUSES, k % 9).alias("status"), (k % 50 + 1).alias("owner_user"), (k % 7).alias("owner_team"),
        content.alias("content"), F.col("p_brand").alias("tag"), (k % 10 / 10).alias("confidence"), F.when(k % 3 == 0, F.concat(F.lit("memo "), k)).alias("source"),
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("user"), _pick(tuple(K.ROLES), k % 5).alias("role"), (k % 7).alias("team"), F.col("c_name").alias("name"))


def scope_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many active items each user sees."""
    return K.visible_counts(_users(spark, sf_dir), _items(spark, sf_dir))


def role_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of every permission."""
    rows = F.broadcast(spark.createDataFrame([(r, p) for r, ps in K.ROLES.items() for p in ps], "role string, permission string"))
    return _users(spark, sf_dir).join(rows, "role").groupBy("permission").agg(F.count("*").alias("users"))


def approval_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may approve, edit and read the items that they have ordered, by role and scope."""
    o = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("item"), F.col("o_custkey").alias("user"))
    m = o.join(_items(spark, sf_dir), "item").join(_users(spark, sf_dir), "user")
    own = F.col("user") == F.col("owner_user")
    role, scope = F.col("role"), F.col("scope")
    n = lambda c: F.count_if(c)
    return m.groupBy("role", "scope").agg(
        F.count("*").alias("n"), n(K.may_approve(role, scope, F.col("team") == F.col("owner_team"))).alias("approve"), n(K.may_edit(role, own, F.col("status"))).alias("edit"), n(K.may_read(role, scope, own)).alias("read")
    )


def knowledge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of items by type, status, words and tag that a reader (user 8, no administrator) may see; the
    tag counts before the page is cut, so the total agrees."""
    i = _items(spark, sf_dir)
    i = i.where(F.col("type").isin("fact", "correction") & F.col("status").isin("active", "approved") & F.col("content").ilike("%widget%") & ((F.col("scope") != "user") | (F.col("owner_user") == 8)))
    i = i.where(F.col("tag").like("Brand#1%"))
    total = i.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    page = i.orderBy(F.desc("confidence"), "item").limit(20).withColumn("one", F.lit(1))
    return page.join(total, "one").select("item", "type", "scope", "confidence", "total")


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of every item in order: lines by day. What gives no source of its own keeps the last one
    that did; the active version is the last that came with one."""
    l = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("day"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", F.when(F.col("l_returnflag") != "N", F.col("l_orderkey")).alias("given"))
    order = ["day", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    w = Window.partitionBy("l_partkey").orderBy(*order)
    v = l.withColumn("version", F.row_number().over(w)).withColumn("source", F.last("given", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    active = F.max(F.when(F.col("given").isNotNull(), F.col("version"))).over(Window.partitionBy("l_partkey"))
    return v.select("l_partkey", "version", "l_orderkey", F.coalesce("source", F.lit(-1)).alias("source"), F.coalesce(F.col("version") == active, F.lit(False)).alias("active"))


def edited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of items after an edit of every fifth one, by scope."""
    i = _items(spark, sf_dir).withColumn("after", F.when(F.col("item") % 5 == 0, K.status_after_edit(F.col("status"), F.col("scope"))).otherwise(F.col("status")))
    return i.groupBy("scope", "status", "after").agg(F.count("*").alias("n"))


def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index of active factual items lacks or has too much; it holds two thirds of all items."""
    i = _items(spark, sf_dir)
    want = i.where((F.col("status") == "active") & F.col("type").isin(*FACTUAL)).select("item", F.lit(1).alias("w"))
    have = i.where(F.col("item") % 3 > 0).select("item", F.lit(1).alias("h"))
    action = F.when(F.col("h").isNull(), "add").when(F.col("w").isNull(), "remove").otherwise("keep")
    return want.join(have, "item", "full").groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.min("item").alias("first_item"))


def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of a query's own category among the documents allowed, from 0.25 on: both filters
    come before the ranking."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", T.cosine_ready(F.col("embedding")).alias("unit"), F.col("label").cast("string").alias("by")).where("unit is not null")
    return R.top_vectors(v.where(F.col("vec_id") % 4 != 1), 20, 5)


def knowledge_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest active items that each asking user may see (shared, the team's, their own), from 0.45
    on; the query's scopes are part of the search. A collection of its own, never mixed with documents."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", T.cosine_ready(F.col("embedding")).alias("unit")).where("unit is not null")
    k = F.col("vec_id")
    scope = F.when(k % 4 < 2, "shared").when(k % 4 == 2, F.concat(F.lit("team "), k % 7)).otherwise(F.concat(F.lit("user "), k % 50))
    rows = e.where("label % 2 = 0").select("vec_id", "unit", scope.alias("by"))
    asked = e.select("vec_id", "unit", F.explode(F.array(F.lit("shared"), F.concat(F.lit("team "), k % 7), F.concat(F.lit("user "), k % 50))).alias("by"))
    return R.top_vectors(rows, 20, 5, K.SIMILAR, asked=asked)


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").where(F.col("p_partkey") % 20 == 0)
    q = F.concat(F.lit("what size and brand has the "), F.col("p_name"), F.lit(" of "), F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("q"), (F.col("p_partkey") % 50 + 1).alias("asker"), (F.col("p_partkey") % 7).alias("asker_team"), T.content(q).alias("ts"))


def knowledge_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question takes from active items that its user sees: facts that have a third of its terms or
    lie near it, best and most confident first, eight at most."""
    i = _items(spark, sf_dir).where((F.col("status") == "active") & F.col("type").isin(*FACTUAL)).withColumn("terms", T.content(F.concat_ws(" ", "content", "source", "tag")))
    asks = stored(_asks(spark, sf_dir))
    near = knowledge_knn(spark, sf_dir).select(F.col("query_id").alias("q"), F.col("vec_id").alias("item"), F.col("similarity").alias("semantic"))
    by = F.when(F.col("scope").isin("global", "department"), "shared").when(F.col("scope") == "team", F.concat(F.lit("team "), "owner_team")).otherwise(F.concat(F.lit("user "), "owner_user"))
    sees = F.array(F.lit("shared"), F.concat(F.lit("team "), "asker_team"), F.concat(F.lit("user "), "asker"))
    lexical = K.best_covering(asks.select("q", "ts", sees.alias("sees")), i.select("item", "terms", by.alias("by"), "confidence"), K.RELEVANT, K.FACTS)
    both = lexical.join(near.join(asks.select("q"), "q"), ["q", "item"], "full").join(i.select("item", "scope", "owner_user", "owner_team", "confidence"), "item").join(asks.drop("ts"), "q")
    seen = F.col("scope").isin("global", "department") | ((F.col("scope") == "team") & (F.col("owner_team") == F.col("asker_team"))) | ((F.col("scope") == "user") & (F.col("owner_user") == F.col("asker")))
    score = F.round(F.greatest(F.coalesce("semantic", F.lit(0.0)), F.coalesce("share", F.lit(0.0))), 4)
    both = both.where(seen).select("q", "item", score.alias("score"), F.when(F.col("semantic").isNotNull(), "semantic").otherwise("lexical").alias("retrieval"), "confidence")
    return R.ranked(both, ["q"], F.desc("score"), F.desc("confidence"), F.col("item")).where(F.col("rank") <= K.FACTS).drop("confidence")


def knowledge_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that taught facts answer alone: the best is a 0.62 match and names its source, and no second
    fact of the question has another size."""
    arm = knowledge_arm(spark, sf_dir)
    facts = arm.join(_items(spark, sf_dir).select("item", "source", F.regexp_extract("content", r"size (\d+)", 1).alias("size")), "item")
    per = facts.where("score >= 0.62").groupBy("q").agg(F.min_by("item", "rank").alias("item"), F.min_by("source", "rank").alias("source"), F.countDistinct("size").alias("sizes"))
    return per.where("source is not null and sizes = 1").select("q", "item")


def usage_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an answer used each fact that it was offered: stated (60 % of the fact's terms), applied (a
    directive) or offered, and whether the fact was in conflict. The answer of a question repeats its best
    fact with every other one's size."""
    arm = stored(knowledge_arm(spark, sf_dir))
    i = _items(spark, sf_dir).select("item", "content", T.content(F.col("content")).alias("terms"))
    top = arm.where("rank = 1").join(i.select("item", "content"), "item").select("q", T.normalize(F.when(F.col("q") % 40 == 0, F.col("content")).otherwise("It depends.")).alias("answer"))
    used = arm.join(i.select("item", "terms"), "item").join(top, "q")
    share = F.size(F.filter("terms", lambda t: F.contains(F.col("answer"), t))) / F.size("terms")
    return used.groupBy(F.when(share >= 0.6, "stated").otherwise("offered").alias("usage"), (F.col("item") % 2 == 1).alias("conflicted")).agg(F.count("*").alias("n"))


# --- requests and users --------------------------------------------------------------------------


def user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of users by name or address and role, newest first, with the total."""
    u = _users(spark, sf_dir).withColumn("mail", F.concat(F.lit("u"), "user", F.lit("@example.com"))).where((F.col("name").ilike("%11%") | F.col("mail").ilike("%u2%")) & F.col("role").isin("viewer", "admin"))
    total = u.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return u.orderBy(F.desc("user")).limit(15).withColumn("one", F.lit(1)).join(total, "one").select("user", "mail", "role", "total")


def unanswered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 25 requests of the last 20 days that were not answered, with their user if known."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    last = _events(spark, sf_dir).agg(F.max("day").alias("last")).withColumn("one", F.lit(1))
    e = e.withColumn("one", F.lit(1)).join(last, "one").where(F.datediff("last", "day") < 20)
    e = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(25)
    return e.join(_users(spark, sf_dir), F.col("user_id") == F.col("user"), "left").select("event_id", "event_type", F.coalesce("name", F.lit("")).alias("name"))


def web_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the web may be asked: the request, its credential and the instance all allow it, and no facts of
    a business system came with it."""
    e = _events(spark, sf_dir).select("k", "user_id", "event_type")
    asked, credential, instance, facts = F.col("k") % 2 == 0, F.col("user_id") % 3 > 0, F.col("event_type") != "error", F.col("k") % 10 == 4
    state = F.when(asked & facts, "refused").when(asked & credential & instance, "web").otherwise("internal")
    return e.groupBy(state.alias("decision")).agg(F.count("*").alias("n"))


def scope_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose scopes the client and the phase allow, of the client's own tenant: else what is wrong."""
    e = _events(spark, sf_dir).groupBy("user_id", "day").agg(F.sort_array(F.collect_set("event_type")).alias("asked"), F.min("k").alias("k"))
    client = F.when(F.col("user_id") % 2 == 0, F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup")])).otherwise(F.array(*[F.lit(x) for x in ("view", "click")]))
    allowed = F.array_intersect(client, F.array(*[F.lit(x) for x in ("view", "click", "purchase", "error")]))
    state = F.when(F.col("k") % 7 != F.col("user_id") % 7, "other tenant").when(F.size(F.array_except("asked", allowed)) > 0, "not allowed").otherwise("allowed")
    return e.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each call without any content: counts of the four lists of sources, status and latency."""
    e = _events(spark, sf_dir)
    n = lambda m: (F.col("k") % m).cast("long")
    counts = F.create_map(F.lit("documents"), n(5), F.lit("knowledge"), n(3), F.lit("facts"), n(4), F.lit("web"), n(2))
    status = F.when(F.col("event_type") == "error", 500).when(F.col("k") % 9 == 0, 429).otherwise(200)
    rows = e.select("event_id", counts.alias("c"), status.alias("status"), F.round(F.col("value") * 10).cast("long").alias("ms"))
    return rows.select("event_id", "status", "ms", F.array_join(F.transform(F.array_sort(F.map_entries("c")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), " ").alias("sources"))


def explained_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace of every answer that its reader may see: evidence, facts and policies apart, and how many of its
    conflicts no rule has settled."""
    l = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    l = l.join(_users(spark, sf_dir), F.col("o_custkey") == F.col("user")).where(K.may(F.col("role"), "document.read_all") | (F.col("o_custkey") == F.col("user")) & (F.col("o_orderkey") % 2 == 0))
    kind = F.when(F.col("l_returnflag") == "R", "policy").when(F.col("l_returnflag") == "A", "fact").otherwise("evidence")
    some = lambda k: F.count_if(kind == k)
    listed_ = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kind == "fact", F.col("l_partkey")))), lambda x: x.cast("string")), ",")
    return l.groupBy("o_orderkey").agg(some("evidence").alias("evidence"), some("fact").alias("facts"), some("policy").alias("policies"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 2 == 0)).alias("unresolved"), listed_.alias("fact_items"))


def kept_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents are filed: what the uploader gave stays, the rest is the model's kind if it is a listed
    one, else the kind by words."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("given"), "lang")
    given = F.when(F.col("doc_id") % 3 == 0, F.col("given")).otherwise("")
    model = F.when(F.col("doc_id") % 4 == 0, "invoice").when(F.col("doc_id") % 4 == 1, "nonsense").otherwise("")
    by_words = F.when(F.col("lang") == "en", "letter").otherwise("report")
    kind = F.coalesce(F.nullif(given, F.lit("")), F.when(model.isin("invoice", "letter", "report"), model), by_words)
    return d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of answers: only the asker's own; a restricted reader's is theirs at once, a wide reader's
    is proposed to all."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'P' or o_orderkey % 11 = 0").join(_users(spark, sf_dir), F.col("o_custkey") == F.col("user"))
    wide = K.may(F.col("role"), "document.read_all")
    state = F.when(F.col("o_orderkey") % 5 == 0, "refused").when(~K.may(F.col("role"), "knowledge.propose"), "refused").when(wide, "pending global").otherwise("active user")
    return o.groupBy("role", state.alias("state")).agg(F.count("*").alias("n"))


def learning_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is offered for learning after an answer: a term from a rephrasing, else a lesson in the message,
    else what a clarification offered; a user's first three that are open."""
    e = _events(spark, sf_dir)
    rephrased = F.when(F.col("k") % 6 == 0, F.concat(F.lit("term "), F.col("k")))
    taught = F.when(F.col("k") % 4 == 0, F.concat(F.lit("lesson "), F.col("k")))
    clarified = F.when((F.col("event_type") == "signup") & (F.col("k") % 3 > 0), F.concat(F.lit("meaning "), F.col("k")))
    offer = F.coalesce(rephrased, taught, clarified)
    o = e.withColumn("offer", offer).where("offer is not null")
    return R.ranked(o, ["user_id"], F.col("ts"), F.col("event_id"), out="nth").where("nth <= 3").select("user_id", "event_id", "offer", "nth")


def answer_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are answered from memory: the same user's same question was answered within a day, has
    not been disliked (an error) since, and the corpus (a signup) has not changed for them since."""
    w = Window.partitionBy("user_id", "k").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    when = lambda t: F.max(F.when(F.col("event_type").isin(*t), F.col("at"))).over(w)
    e = _events(spark, sf_dir).withColumns({"answered": when(("view", "click")), "gone": when(("error", "signup"))})
    ok = (F.col("at") - F.col("answered") <= 86_400) & (F.col("gone").isNull() | (F.col("gone") < F.col("answered")))
    return e.where(F.col("event_type").isin("view", "click") & ok).select("event_id", F.round(F.col("at") - F.col("answered"), 3).alias("age"))


def feedback_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes reach all rows of an answer (k): its last vote, for every question (user) that it answered."""
    e = _events(spark, sf_dir)
    vote = e.where(F.col("event_type").isin("error", "purchase")).groupBy("k").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("last"))
    return e.select("k", "user_id").distinct().join(vote, "k").select("k", "user_id", F.when(F.col("last") == "error", "down").otherwise("up").alias("vote"))


QUERIES = {
    f.__name__: f
    for f in (
        scope_visible, role_permissions, approval_rights, knowledge_search, version_history, edited_items, index_sync, vector_filtered, knowledge_knn, knowledge_arm, knowledge_alone, usage_influence,
        user_list, unanswered_questions, web_permission, scope_subset, audit_rows, explained_answers, kept_placement, corrections, learning_offers, answer_memory, feedback_spread,
    )
}

_I = f"""i AS (SELECT p_partkey AS item, {listed(TYPES)}[p_partkey % 6 + 1] AS type, {listed(SCOPES)}[(p_partkey // 6) % 4 + 1] AS scope, {listed(STATUSES)}[p_partkey % 9 + 1] AS status, p_partkey % 50 + 1 AS owner_user, p_partkey % 7 AS owner_team,
  'The ' || p_name || ' has size ' || p_size || ' and ships by ' || p_brand AS content, p_brand AS tag, (p_partkey % 10) / 10::DOUBLE AS confidence, CASE WHEN p_partkey % 3 = 0 THEN 'memo ' || p_partkey END AS source, p_name, p_size FROM part)"""
_U = f'u AS (SELECT c_custkey AS "user", {listed(K.ROLES)}[c_custkey % 5 + 1] AS role, c_custkey % 7 AS team, c_name AS name FROM customer)'
_MAY = lambda p: f"role IN ({', '.join(repr(r) for r, ps in K.ROLES.items() if p in ps)})"
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL)"
_KNN = f"""{_V}, kn AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 6) AS similarity FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND c.label % 2 = 0
  AND (c.vec_id % 4 < 2 OR (c.vec_id % 4 = 2 AND c.vec_id % 7 = q.vec_id % 7) OR (c.vec_id % 4 = 3 AND c.vec_id % 50 = q.vec_id % 50)) WHERE round(list_cosine_similarity(q.e, c.e), 6) >= 0.45),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INTEGER AS rank FROM kn QUALIFY rank <= 5)"""
_ARM = f"""{_I}, {_KNN}, f AS (SELECT *, {content_list("concat_ws(' ', content, source, tag)")} AS terms FROM i WHERE status = 'active' AND type IN ('fact', 'correction', 'terminology')),
q AS (SELECT p_partkey AS q, p_partkey % 50 + 1 AS asker, p_partkey % 7 AS asker_team, {content_list("'what size and brand has the ' || p_name || ' of ' || p_brand")} AS ts FROM part WHERE p_partkey % 20 = 0),
m AS (SELECT q.q, f.item, f.confidence, len(list_intersect(q.ts, f.terms)) / len(q.ts)::DOUBLE AS share, knn.similarity AS semantic FROM q JOIN f ON scope IN ('global', 'department') OR (scope = 'team' AND owner_team = asker_team) OR (scope = 'user' AND owner_user = asker) LEFT JOIN knn ON query_id = q.q AND vec_id = f.item),
arm AS (SELECT q, item, round(greatest(coalesce(semantic, 0), CASE WHEN share >= 0.34::DOUBLE THEN share ELSE 0 END), 4) AS score, CASE WHEN semantic IS NOT NULL THEN 'semantic' ELSE 'lexical' END AS retrieval,
  row_number() OVER (PARTITION BY q ORDER BY round(greatest(coalesce(semantic, 0), CASE WHEN share >= 0.34::DOUBLE THEN share ELSE 0 END), 4) DESC, confidence DESC, item)::INTEGER AS rank FROM m WHERE semantic IS NOT NULL OR share >= 0.34::DOUBLE QUALIFY rank <= 8)"""

SQL = {
    "scope_visible": f"""WITH {_I}, {_U}, a AS (SELECT * FROM i WHERE status = 'active') SELECT "user", team, (SELECT count(*) FROM a WHERE scope IN ('global', 'department') OR (scope = 'team' AND owner_team = u.team) OR (scope = 'user' AND owner_user = u."user")) AS n FROM u""",
    "role_permissions": f"""WITH {_U}, p(role, permission) AS (VALUES {', '.join(f"('{r}', '{p}')" for r, ps in K.ROLES.items() for p in ps)}) SELECT permission, count(*) AS users FROM u JOIN p USING (role) GROUP BY permission""",
    "approval_rights": f"""WITH {_I}, {_U}, m AS (SELECT i.*, u.*, "user" = owner_user AS own FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN i ON item = l_partkey JOIN u ON "user" = o_custkey)
        SELECT role, scope, count(*) AS n, count(*) FILTER ({_MAY('knowledge.approve')} AND CASE WHEN scope IN ('global', 'department') THEN {_MAY('user.manage')} WHEN scope = 'team' THEN {_MAY('user.manage')} OR team = owner_team ELSE true END) AS approve,
          count(*) FILTER ({_MAY('knowledge.edit')} OR ({_MAY('knowledge.edit_own')} AND own AND status <> 'archived')) AS edit, count(*) FILTER (scope <> 'user' OR own OR {_MAY('user.manage')}) AS read FROM m GROUP BY role, scope""",
    "knowledge_search": f"""WITH {_I}, s AS (SELECT *, count(*) OVER () AS total FROM i WHERE type IN ('fact', 'correction') AND status IN ('active', 'approved') AND content ILIKE '%widget%' AND (scope <> 'user' OR owner_user = 8) AND tag LIKE 'Brand#1%')
        SELECT item, type, scope, confidence, total FROM s ORDER BY confidence DESC, item LIMIT 20""",
    "version_history": """WITH v AS (SELECT l_partkey, l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_orderkey END AS given, row_number() OVER w AS version, last_value(CASE WHEN l_returnflag <> 'N' THEN l_orderkey END IGNORE NULLS) OVER (PARTITION BY l_partkey ORDER BY l_shipdate::DATE, l_orderkey, l_linenumber, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS source
          FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate::DATE, l_orderkey, l_linenumber, l_suppkey, l_quantity))
        SELECT l_partkey, version::INTEGER AS version, l_orderkey, coalesce(source, -1) AS source, coalesce(version = max(CASE WHEN given IS NOT NULL THEN version END) OVER (PARTITION BY l_partkey), false) AS active FROM v""",
    "edited_items": f"""WITH {_I} SELECT scope, status, CASE WHEN item % 5 = 0 THEN CASE WHEN scope = 'user' THEN 'active' WHEN status IN ('approved', 'active') THEN 'pending' ELSE status END ELSE status END AS after, count(*) AS n FROM i GROUP BY ALL""",
    "index_sync": f"""WITH {_I}, s AS (SELECT item, status = 'active' AND type IN ('fact', 'correction', 'terminology') AS w, item % 3 > 0 AS h FROM i) SELECT CASE WHEN NOT h THEN 'add' WHEN NOT w THEN 'remove' ELSE 'keep' END AS action, count(*) AS n, min(item) AS first_item FROM s WHERE w OR h GROUP BY 1""",
    "vector_filtered": f"""WITH {_V}, s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 6) AS similarity FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND q.label = c.label AND c.vec_id % 4 <> 1 WHERE round(list_cosine_similarity(q.e, c.e), 6) >= 0.25)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 5""",
    "knowledge_knn": f"WITH {_KNN} SELECT * FROM knn",
    "knowledge_arm": f"WITH {_ARM} SELECT q, item, score, retrieval, rank FROM arm",
    "knowledge_alone": f"""WITH {_ARM}, s AS (SELECT arm.q, arm.item, arm.rank, i.source, i.p_size FROM arm JOIN i USING (item) WHERE score >= 0.62), g AS (SELECT q, arg_min(item, rank) AS item, bool_or(source IS NOT NULL AND rank = r) AS named, count(DISTINCT p_size) AS sizes FROM (SELECT *, min(rank) OVER (PARTITION BY q) AS r FROM s) GROUP BY q)
        SELECT q, item FROM g WHERE named AND sizes = 1""",
    "usage_influence": f"""WITH {_ARM}, c AS (SELECT item, content, {content_list('content')} AS ct FROM i), t AS (SELECT q, lower(CASE WHEN q % 40 = 0 THEN content ELSE 'It depends.' END) AS answer FROM arm JOIN c USING (item) WHERE rank = 1)
        SELECT CASE WHEN len(list_filter(ct, lambda x: contains(answer, x))) / len(ct)::DOUBLE >= 0.6::DOUBLE THEN 'stated' ELSE 'offered' END AS usage, arm.item % 2 = 1 AS conflicted, count(*) AS n FROM arm JOIN c USING (item) JOIN t USING (q) GROUP BY ALL""",
    "user_list": f"""WITH {_U}, m AS (SELECT *, 'u' || "user" || '@example.com' AS mail FROM u), s AS (SELECT *, count(*) OVER () AS total FROM m WHERE (name ILIKE '%11%' OR mail ILIKE '%u2%') AND role IN ('viewer', 'admin')) SELECT "user", mail, role, total FROM s ORDER BY "user" DESC LIMIT 15""",
    "unanswered_questions": f"""WITH {_E}, {_U}, s AS (SELECT * FROM e WHERE event_type IN ('error', 'signup') AND (SELECT max(day) FROM e) - day < 20 ORDER BY ts DESC, event_id DESC LIMIT 25) SELECT event_id, event_type, coalesce(name, '') AS name FROM s LEFT JOIN u ON user_id = "user\"""",
    "web_permission": f"""WITH {_E} SELECT CASE WHEN k % 2 = 0 AND k % 10 = 4 THEN 'refused' WHEN k % 2 = 0 AND user_id % 3 > 0 AND event_type <> 'error' THEN 'web' ELSE 'internal' END AS decision, count(*) AS n FROM e GROUP BY 1""",
    "scope_subset": f"""WITH {_E}, s AS (SELECT user_id, day, min(k) AS k, bool_and(event_type IN ('view', 'click') OR (event_type = 'purchase' AND user_id % 2 = 0)) AS ok FROM e GROUP BY user_id, day)
        SELECT CASE WHEN k % 7 <> user_id % 7 THEN 'other tenant' WHEN NOT ok THEN 'not allowed' ELSE 'allowed' END AS state, count(*) AS n FROM s GROUP BY 1""",
    "audit_rows": f"""WITH {_E} SELECT event_id, CASE WHEN event_type = 'error' THEN 500 WHEN k % 9 = 0 THEN 429 ELSE 200 END AS status, round(value * 10)::BIGINT AS ms, 'documents=' || k % 5 || ' facts=' || k % 4 || ' knowledge=' || k % 3 || ' web=' || k % 2 AS sources FROM e""",
    "explained_answers": f"""WITH {_U} SELECT o_orderkey, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS evidence, count(*) FILTER (l_returnflag = 'A') AS facts, count(*) FILTER (l_returnflag = 'R') AS policies, count(*) FILTER (l_linestatus = 'O' AND l_suppkey % 2 = 0) AS unresolved,
          coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) FILTER (l_returnflag = 'A'), '') AS fact_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN u ON o_custkey = "user" WHERE {_MAY('document.read_all')} OR o_orderkey % 2 = 0 GROUP BY o_orderkey""",
    "kept_placement": """SELECT coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END, ''), CASE WHEN doc_id % 4 = 0 THEN 'invoice' END, CASE WHEN lang = 'en' THEN 'letter' ELSE 'report' END) AS kind, count(*) AS n FROM documents GROUP BY 1""",
    "corrections": f"""WITH {_U} SELECT role, CASE WHEN o_orderkey % 5 = 0 OR NOT {_MAY('knowledge.propose')} THEN 'refused' WHEN {_MAY('document.read_all')} THEN 'pending global' ELSE 'active user' END AS state, count(*) AS n FROM orders JOIN u ON o_custkey = "user" WHERE o_orderstatus = 'P' OR o_orderkey % 11 = 0 GROUP BY 1, 2""",
    "learning_offers": f"""WITH {_E}, o AS (SELECT *, CASE WHEN k % 6 = 0 THEN 'term ' || k WHEN k % 4 = 0 THEN 'lesson ' || k WHEN event_type = 'signup' AND k % 3 > 0 THEN 'meaning ' || k END AS offer FROM e)
        SELECT user_id, event_id, offer, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS nth FROM o WHERE offer IS NOT NULL QUALIFY nth <= 3""",
    "answer_memory": f"""WITH {_E}, m AS (SELECT *, max(CASE WHEN event_type IN ('view', 'click') THEN sec END) OVER w AS answered, max(CASE WHEN event_type IN ('error', 'signup') THEN sec END) OVER w AS gone FROM e WINDOW w AS (PARTITION BY user_id, k ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT event_id, round(sec - answered, 3) AS age FROM m WHERE event_type IN ('view', 'click') AND sec - answered <= 86400 AND (gone IS NULL OR gone < answered)""",
    "feedback_spread": f"""WITH {_E}, v AS (SELECT k, arg_max(event_type, (ts, event_id)) AS last FROM e WHERE event_type IN ('error', 'purchase') GROUP BY k) SELECT DISTINCT k, user_id, CASE WHEN last = 'error' THEN 'down' ELSE 'up' END AS vote FROM e JOIN v USING (k)""",
}
