"""Analytics over logs (events), the registry (orders, customers) and index health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import analytics as A
from docloom.operators import retrieval as R
from docloom.operators.store import stored
from docloom.plans.retrieval import read

#: Latency bounds in seconds, and which states may follow each other.
BOUNDS = (1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0, 90.0, 120.0, 180.0, 300.0, 600.0)
ALLOWED = (("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("signup", "view"), ("error", "view"))
WINDOW_S, BURST, GAP_S, NONCE_S = 86_400, 3, 1800, 600
#: How an event stands for a request's end, and thresholds of alerts.
OUTCOMES = {"view": "answered", "click": "answered", "purchase": "clarified", "signup": "refused", "error": "error"}
ERROR_RATE, REFUSAL_RATE, P95, LEAST = 0.05, 0.40, 240.0, 10
SHARES = {"p50": 0.5, "p95": 0.95}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.withColumns({"day": F.to_date("ts"), "k": k, "at": F.unix_micros("ts") / 1e6})


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.sum("k").alias("k")
    )


def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nearest_rank(_events(spark, sf_dir), ["event_type"], "value", {"p05": 0.05, **SHARES, "p99": 0.99})


def daily_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and 95th percentiles by day, errors left out."""
    out = A.nearest_rank(_events(spark, sf_dir).where("event_type <> 'error'"), ["day"], "value", SHARES)
    return out.withColumn("day", F.col("day").cast("string"))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("bucket", T.bucket(F.col("value"), BOUNDS))
    return e.groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative histogram lines for each event type and bound."""
    n = latency_histogram(spark, sf_dir)
    grid = n.select("event_type").distinct().select("event_type", F.posexplode(F.array(*[F.lit(f"{b:g}") for b in BOUNDS], F.lit("+Inf"))).alias("bucket", "le"))
    full = grid.join(n, ["event_type", "bucket"], "left")
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("event_type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return full.select(F.format_string('latency_bucket{outcome="%s",le="%s"} %d', "event_type", "le", upto).alias("line"))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every calendar day; rates are null on days without events."""
    e = _events(spark, sf_dir)
    per = e.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    out = A.calendar(per, "day").join(per, "day", "left")
    return out.select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("errors", F.lit(0)).alias("errors"), F.round(F.col("errors") / F.nullif("n", F.lit(0)), 6).alias("error_rate"))


def user_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar-complete counts of each user's days from their first to their last."""
    per = _events(spark, sf_dir).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    days = per.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(per, ["user_id", "day"], "left").select("user_id", F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def week_over_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days of the log against the seven before."""
    e = _events(spark, sf_dir)
    last = e.agg(F.max("day").alias("d")).first().d
    age = F.datediff(F.lit(last), F.col("day"))
    period = F.when(age < 7, "this week").when(age < 14, "last week")
    return e.withColumn("period", period).where("period is not null").groupBy("period").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total")
    )


def error_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with most errors, and when each had the first."""
    e = _events(spark, sf_dir).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return e.orderBy(F.desc("n"), "user_id").limit(8)


def slowest10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "event_type", "value")
    return e.orderBy(F.desc("value"), "event_id").limit(10)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    return _events(spark, sf_dir).withColumn("outcome", F.try_element_at(names, F.col("event_type")))


def monitoring_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by channel (k) and how they ended: rates, spreads of latency without errors, means."""
    e = _outcomes(spark, sf_dir).withColumn("channel", F.col("k") % 3)
    served = A.nearest_rank(e.where("outcome <> 'error'"), ["channel"], "value", {"p50": 0.5, "p95": 0.95})
    rate = lambda o: F.round(F.count_if(F.col("outcome") == o) / F.count("*"), 3).alias(f"{o}_rate")
    whole = e.groupBy("channel").agg(F.count("*").alias("total"), *[rate(o) for o in ("answered", "refused", "clarified", "error")], F.round(F.avg(F.when(F.col("outcome") != "error", F.col("k"))), 1).alias("mean_retrieved"))
    return whole.join(served.select("channel", "p50", "p95"), "channel")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of ten requests or more with over 5 % errors, over 40 % refusals or a slow 95th percentile."""
    e = _outcomes(spark, sf_dir)
    share = lambda o: F.count_if(F.col("outcome") == o) / F.count("*")
    rate = e.groupBy("day").agg(F.count("*").alias("n"), share("error").alias("error"), share("refused").alias("refused")).where(F.col("n") >= LEAST)
    slow = A.nearest_rank(e.where("outcome <> 'error'"), ["day"], "value", {"p95": 0.95}).join(rate.select("day"), "day").where(F.col("p95") > P95)
    one = lambda d, name, c: d.select("day", F.lit(name).alias("alert"), F.round(c, 6).alias("measure"))
    every = one(rate.where(F.col("error") > ERROR_RATE), "error_rate", F.col("error")).unionByName(one(rate.where(F.col("refused") > REFUSAL_RATE), "refusal_rate", F.col("refused"))).unionByName(one(slow, "latency", F.col("p95")))
    return every.withColumn("day", F.col("day").cast("string"))


def quality_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole period, this week and the one before: questions, share answered, verified (an even k), liked
    (k below 50), remembered (k of 7), median seconds of those not remembered, users."""
    e = _outcomes(spark, sf_dir)
    last = F.broadcast(e.agg(F.max("day").alias("last")))  # one row
    e = e.crossJoin(last).withColumn("age", F.datediff("last", "day"))
    spans = F.array(F.when(F.col("age") < 30, "period"), F.when(F.col("age") < 7, "this week"), F.when(F.col("age").between(7, 13), "last week"))
    w = e.withColumn("span", F.explode(F.array_compact(spans)))
    good, remembered = F.col("outcome") == "answered", F.col("k") % 7 == 0
    rate = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 3)
    up, down = F.count_if(F.col("k") < 20), F.count_if(F.col("k") >= 80)
    seconds = A.medians(w.where(good & ~remembered), ["span"], "value").select("span", F.round("median", 1).alias("median_seconds"))
    per = w.groupBy("span").agg(
        F.count("*").alias("questions"), rate(F.count_if(good), F.count("*")).alias("answer_rate"), rate(F.count_if(good & (F.col("k") % 2 == 0)), F.count_if(good)).alias("verified_rate"), rate(up, up + down).alias("satisfaction"),
        F.count_if(remembered).alias("remembered"), F.countDistinct("user_id").alias("users"),
    )
    return per.join(seconds, "span", "left")


def nightly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's lines: outcomes with whole percents, the median, the most frequent reasons for a refusal."""
    e = _outcomes(spark, sf_dir)
    last = F.broadcast(e.agg(F.max("at").alias("last")))  # one row
    day = stored(e.crossJoin(last).where(F.col("last") - F.col("at") < 86_400).select("outcome", "k", "value"))
    total = F.broadcast(day.agg(F.count("*").alias("total")))  # one row
    per = day.groupBy("outcome").agg(F.count("*").alias("n")).crossJoin(total)
    lines = per.select(F.concat(F.lit("outcome "), "outcome").alias("line"), "n", F.floor(F.col("n") * 100 / F.col("total")).alias("percent"))
    reasons = day.where("outcome = 'refused'").groupBy((F.col("k") % 4).alias("reason")).agg(F.count("*").alias("n"))
    reasons = reasons.orderBy(F.desc("n"), "reason").limit(5).select(F.concat(F.lit("reason "), "reason").alias("line"), "n", F.lit(None).cast("long").alias("percent"))
    middle = A.medians(day, [], "value").select(F.lit("median seconds").alias("line"), F.round("median").cast("long").alias("n"), F.lit(None).cast("long").alias("percent"))
    return lines.unionByName(reasons).unionByName(middle)


def quota_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of each user since midnight of the log's last day."""
    e = _events(spark, sf_dir)
    today = e.agg(F.max("day").alias("d")).first().d
    return e.where((F.col("day") == F.lit(today)) & (F.col("event_type") == "purchase")).groupBy("user_id").agg(F.count("*").alias("used"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, parted by half an hour without an event."""
    s = A.sessions(_events(spark, sf_dir), "user_id", F.col("at"), GAP_S)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.max("at") - F.min("at"), 3).alias("seconds"), F.round(F.sum("value"), 2).alias("total"))


def concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most requests each user had open at once, each lasting ``value`` minutes."""
    return A.most_at_once(_events(spark, sf_dir), "user_id", F.col("at"), F.col("at") + F.col("value") * 60)


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests stay within three others of the same user in the day before."""
    return A.over_limit(_events(spark, sf_dir), "user_id", "at", WINDOW_S, BURST, "event_id")


def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By (user, k) the first event wins; a later one of another type conflicts, else it repeats."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "k", "event_type", "ts")
    first = e.groupBy("user_id", "k").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("f"))
    state = F.when(F.col("event_id") == F.col("f.event_id"), "first").when(F.col("event_type") == F.col("f.event_type"), "replay").otherwise("conflict")
    return e.join(first, ["user_id", "k"]).select("event_id", state.alias("state"))


def nonce_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which the user or one with the same k claimed this nonce (k) within 600 seconds before."""
    # a claim within reach lies in the same span of that length or in the one before: each row is in both, its
    # own once, so that a nonce that all use is split by time
    span = F.floor(F.col("at") / NONCE_S).cast("long")
    e = _events(spark, sf_dir).select("k", "event_id", "at", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own")))).alias("s"))
    e = e.withColumn("age", F.col("at") - F.lag("at").over(Window.partitionBy("k", "s.span").orderBy("at", "event_id")))
    return e.where(F.col("s.own") & (F.col("age") <= NONCE_S)).select("event_id", F.round("age", 3).alias("age"))


def stage_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type for each user, in order."""
    first = R.first_of(_events(spark, sf_dir), ["user_id", "event_type"], F.col("ts"), F.col("event_id"))
    return R.ranked(first, ["user_id"], F.col("ts"), F.col("event_id"), out="stage").select("user_id", "event_type", "event_id", "stage")


def last_view_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the view that came last before each purchase of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    view = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return _events(spark, sf_dir).withColumn("view_id", view).where("event_type = 'purchase'").select("event_id", "user_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


def rephrase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors whose user's next event, within a day, is not an error."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nxt = {n: F.lead(c).over(w) for n, c in (("next_id", "event_id"), ("next_type", "event_type"), ("next_at", "at"))}
    e = _events(spark, sf_dir).withColumns(nxt)
    return e.where("event_type = 'error' and next_type <> 'error' and next_at - at <= 86400").select("event_id", "next_id", F.round(F.col("next_at") - F.col("at"), 3).alias("seconds"))


def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one user's neighbouring events that the table of transitions does not allow."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = _events(spark, sf_dir).withColumn("before", F.lag("event_type").over(w)).where("before is not null")
    edges = spark.createDataFrame(ALLOWED, "before string, event_type string")
    return pairs.join(F.broadcast(edges), ["before", "event_type"], "left_anti").groupBy("before", "event_type").agg(F.count("*").alias("n"))


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event type, and how many they had."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("state"), F.count("*").alias("n"))


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the log to keep: seven newest, then the newest other one of two weeks."""
    out = A.retention(_events(spark, sf_dir), "day", 7, 2)
    return out.select(F.col("day").cast("string").alias("day"), "kept")


def latency_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the middle of each type's last 20 events."""
    last = R.ranked(_events(spark, sf_dir), ["event_type"], F.desc("ts"), F.desc("event_id"), out="nth").where("nth <= 20")
    return last.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("typical"))


# --- registry ----------------------------------------------------------------------------------


def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status as columns, sums and last dates, by priority."""
    o = read(spark, sf_dir, "orders")
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return o.groupBy("o_orderpriority").agg(n("F").alias("done"), n("O").alias("open"), n("P").alias("waiting"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").cast("date").cast("string").alias("last_day"))


def tallies_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies by status, by priority, by both and in all, in one pass."""
    o = read(spark, sf_dir, "orders")
    return o.groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and language, with roll-ups."""
    d = read(spark, sf_dir, "documents")
    return d.rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


def distinct_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_type <> ''").select(F.col("p_type").alias("category")).distinct()


def registry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the registry: filters, newest first, the second 25."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.where(F.col("c_name").ilike("%00%") & F.col("o_orderstatus").isin("F", "O"))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(25).limit(25).select("o_orderkey", "c_name", "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("day"))


def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders visible to each region: those of customers of its nations."""
    owner = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    o = read(spark, sf_dir, "orders").join(owner, F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("r_name").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("owners"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def scd_active_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer: numbered by date; the active one is the last done."""
    v = R.ranked(read(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"), out="version_no")
    active = v.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("version_no").alias("active"))
    return v.join(active, "o_custkey").where("version_no = active").select("o_custkey", "o_orderkey", "version_no")


def latest_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of orders of one customer and priority the newest replaces the others."""
    o = R.first_of(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return o.select("o_custkey", "o_orderpriority", "o_orderkey")


def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against labels and vectors: what is missing where."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("d"))
    l = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("l")).distinct()
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("v")).distinct()
    both = d.join(l, "id", "full").join(v, "id", "full")
    state = F.when(F.col("d").isNull(), "orphan").when(F.col("l").isNull() & F.col("v").isNull(), "bare").when(F.col("l").isNull(), "unlabelled").when(F.col("v").isNull(), "no vector").otherwise("complete")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and labels of documents that aren't there."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    gone = lambda name, key: read(spark, sf_dir, name).select(F.col(key).alias("id")).join(d, "id", "left_anti").select("id", F.lit(name).alias("what"))
    return gone("embeddings", "vec_id").unionByName(gone("labels", "doc_id"))


def metric_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every segment; events of unknown users stay, without one."""
    e = _events(spark, sf_dir).join(read(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    return e.groupBy("c_mktsegment", "event_type").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        metrics_summary, nearest_rank_percentiles, daily_percentiles, latency_histogram, prometheus_lines, daily_series, user_daily_series, week_over_week, error_top8, slowest10, monitoring_rates, alerts, quality_windows, nightly_report,
        quota_today, user_sessions, concurrency, rate_limit, idempotent_replay, nonce_replay, stage_first, last_view_asof, rephrase_pairs, illegal_transitions, current_state, retention_prune,
        latency_estimate, library_stats, tallies_grouping_sets, folder_tree, distinct_categories, registry_list, access_filter, scd_active_version, latest_replace, index_health,
        orphans, metric_users,
    )
}

_E = "e AS (SELECT *, ts::DATE AS day, json_extract_string(props, '$.k')::BIGINT AS k, epoch_us(ts) / 1e6 AS sec FROM events)"


def _rank_sql(group: str, value: str, shares: dict[str, float], where: str = "true") -> str:
    picks = ", ".join(f"vs[(round_even({p} * (len(vs) - 1), 0))::BIGINT + 1] AS {n}" for n, p in shares.items())
    return f"SELECT {group}, {picks}, len(vs)::BIGINT AS n FROM (SELECT {group}, list_sort(list({value})) AS vs FROM e WHERE {where} GROUP BY {group})"


_O = "o AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'clarified' WHEN 'signup' THEN 'refused' WHEN 'error' THEN 'error' ELSE 'answered' END AS outcome FROM e)"
_BUCKETS = "[" + ", ".join(f"{b}::DOUBLE" for b in BOUNDS) + "]"
_LES = "[" + ", ".join(f"'{b:g}'" for b in BOUNDS) + ", '+Inf']"
_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED)

SQL = {
    "metrics_summary": f"WITH {_E} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, sum(k)::BIGINT AS k FROM e GROUP BY event_type",
    "nearest_rank_percentiles": f"WITH {_E} " + _rank_sql("event_type", "value", {"p05": 0.05, **SHARES, "p99": 0.99}),
    "daily_percentiles": f"WITH {_E}, p AS ({_rank_sql('day', 'value', SHARES, chr(34) + 'event_type' + chr(34) + ' <> ' + chr(39) + 'error' + chr(39))}) SELECT day::VARCHAR AS day, p50, p95, n FROM p",
    "latency_histogram": f"SELECT event_type, len(list_filter({_BUCKETS}, lambda b: b < value))::INTEGER AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "prometheus_lines": f"""WITH h AS (SELECT event_type, len(list_filter({_BUCKETS}, lambda b: b < value)) AS b, count(*) AS n FROM events GROUP BY ALL),
        g AS (SELECT event_type, i AS b, {_LES}[i + 1] AS le FROM (SELECT DISTINCT event_type FROM events), unnest(range(0, 13)) AS r(i)),
        c AS (SELECT event_type, le, sum(coalesce(n, 0)) OVER (PARTITION BY event_type ORDER BY b)::BIGINT AS n FROM g LEFT JOIN h USING (event_type, b))
        SELECT 'latency_bucket{{outcome="' || event_type || '",le="' || le || '"}} ' || n AS line FROM c""",
    "daily_series": f"""WITH {_E}, p AS (SELECT day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM e GROUP BY day),
        c AS (SELECT unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM p)
        SELECT day::VARCHAR AS day, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors, round(errors / nullif(n, 0)::DOUBLE, 6) AS error_rate FROM c LEFT JOIN p USING (day)""",
    "user_daily_series": f"""WITH {_E}, p AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY ALL),
        c AS (SELECT user_id, unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM p GROUP BY user_id)
        SELECT user_id, day::VARCHAR AS day, coalesce(n, 0) AS n FROM c LEFT JOIN p USING (user_id, day)""",
    "week_over_week": f"""WITH {_E}, a AS (SELECT *, (SELECT max(day) FROM e) - day AS age FROM e)
        SELECT CASE WHEN age < 7 THEN 'this week' ELSE 'last week' END AS period, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM a WHERE age < 14 GROUP BY 1""",
    "error_top8": "SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 8",
    "slowest10": "SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 10",
    "alerts": f"""WITH {_E}, {_O}, r AS (SELECT day, count(*) AS n, count(*) FILTER (outcome = 'error') / count(*)::DOUBLE AS er, count(*) FILTER (outcome = 'refused') / count(*)::DOUBLE AS rf FROM o GROUP BY day HAVING count(*) >= 10), p AS ({_rank_sql('day', 'value', {'p95': 0.95}, "event_type <> 'error'")})
        SELECT day::VARCHAR AS day, 'error_rate' AS alert, round(er, 6) AS measure FROM r WHERE er > 0.05 UNION ALL SELECT day::VARCHAR, 'refusal_rate', round(rf, 6) FROM r WHERE rf > 0.4 UNION ALL SELECT day::VARCHAR, 'latency', round(p95, 6) FROM p JOIN r USING (day) WHERE p95 > 240""",
    "monitoring_rates": f"""WITH {_E}, {_O}, p AS (SELECT channel, vs[(round_even(0.5 * (len(vs) - 1), 0))::BIGINT + 1] AS p50, vs[(round_even(0.95 * (len(vs) - 1), 0))::BIGINT + 1] AS p95 FROM (SELECT k % 3 AS channel, list_sort(list(value)) AS vs FROM o WHERE outcome <> 'error' GROUP BY 1)),
        w AS (SELECT k % 3 AS channel, count(*) AS total, round(count(*) FILTER (outcome = 'answered') / count(*)::DOUBLE, 3) AS answered_rate, round(count(*) FILTER (outcome = 'refused') / count(*)::DOUBLE, 3) AS refused_rate, round(count(*) FILTER (outcome = 'clarified') / count(*)::DOUBLE, 3) AS clarified_rate,
          round(count(*) FILTER (outcome = 'error') / count(*)::DOUBLE, 3) AS error_rate, round(avg(k) FILTER (outcome <> 'error'), 1) AS mean_retrieved FROM o GROUP BY 1) SELECT * FROM w JOIN p USING (channel)""",
    "quality_windows": f"""WITH {_E}, {_O}, a AS (SELECT *, (SELECT max(day) FROM e) - day AS age FROM o), w AS (SELECT *, unnest(list_filter([CASE WHEN age < 30 THEN 'period' END, CASE WHEN age < 7 THEN 'this week' END, CASE WHEN age BETWEEN 7 AND 13 THEN 'last week' END], lambda x: x IS NOT NULL)) AS span FROM a)
        SELECT span, count(*) AS questions, round(count(*) FILTER (outcome = 'answered') / count(*)::DOUBLE, 3) AS answer_rate, round(count(*) FILTER (outcome = 'answered' AND k % 2 = 0) / nullif(count(*) FILTER (outcome = 'answered'), 0)::DOUBLE, 3) AS verified_rate,
          round(count(*) FILTER (k < 20) / nullif(count(*) FILTER (k < 20 OR k >= 80), 0)::DOUBLE, 3) AS satisfaction, count(*) FILTER (k % 7 = 0) AS remembered, round(median(value) FILTER (outcome = 'answered' AND k % 7 <> 0), 1) AS median_seconds, count(DISTINCT user_id) AS users FROM w GROUP BY span""",
    "nightly_report": f"""WITH {_E}, {_O}, d AS (SELECT * FROM o WHERE (SELECT max(sec) FROM e) - sec < 86400), r AS (SELECT 'reason ' || k % 4 AS line, count(*) AS n, NULL::BIGINT AS percent FROM d WHERE outcome = 'refused' GROUP BY k % 4 ORDER BY n DESC, k % 4 LIMIT 5)
        SELECT 'outcome ' || outcome AS line, count(*) AS n, (count(*) * 100 // (SELECT count(*) FROM d))::BIGINT AS percent FROM d GROUP BY outcome UNION ALL SELECT * FROM r UNION ALL SELECT 'median seconds', round(median(value))::BIGINT, NULL FROM d""",
    "quota_today": f"WITH {_E} SELECT user_id, count(*) AS used FROM e WHERE day = (SELECT max(day) FROM e) AND event_type = 'purchase' GROUP BY user_id",
    "user_sessions": f"""WITH {_E}, l AS (SELECT *, coalesce((sec - lag(sec) OVER w > 1800)::INTEGER, 0) AS starts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
        s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM l)
        SELECT user_id, session, count(*) AS n, round(max(sec) - min(sec), 3) AS seconds, round(sum(value), 2) AS total FROM s GROUP BY user_id, session""",
    "concurrency": f"""WITH {_E}, m AS (SELECT user_id, sec, 1 AS step FROM e UNION ALL SELECT user_id, sec + value * 60, -1 FROM e),
        o AS (SELECT user_id, sum(step) OVER (PARTITION BY user_id ORDER BY sec, step ROWS UNBOUNDED PRECEDING)::BIGINT AS open FROM m) SELECT user_id, max(open) AS most FROM o GROUP BY user_id""",
    "rate_limit": f"""WITH {_E} SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(sec * 1000)::BIGINT RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) - 1 < 3 AS allowed FROM e""",
    "idempotent_replay": f"""WITH {_E} SELECT event_id, CASE WHEN event_id = first_value(event_id) OVER w THEN 'first' WHEN event_type = first_value(event_type) OVER w THEN 'replay' ELSE 'conflict' END AS state
        FROM e WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id)""",
    "nonce_replay": f"WITH {_E}, a AS (SELECT event_id, sec - lag(sec) OVER (PARTITION BY k ORDER BY sec, event_id) AS age FROM e) SELECT event_id, round(age, 3) AS age FROM a WHERE age <= 600",
    "stage_first": """WITH f AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)
        SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS stage FROM f""",
    "last_view_asof": """WITH v AS (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events)
        SELECT event_id, user_id, coalesce(view_id, -1) AS view_id FROM v WHERE event_type = 'purchase'""",
    "rephrase_pairs": f"""WITH {_E}, n AS (SELECT event_id, event_type, sec, lead(event_id) OVER w AS next_id, lead(event_type) OVER w AS nt, lead(sec) OVER w AS na FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, next_id, round(na - sec, 3) AS seconds FROM n WHERE event_type = 'error' AND nt <> 'error' AND na - sec <= 86400""",
    "illegal_transitions": f"""WITH p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type FROM events)
        SELECT before, event_type, count(*) AS n FROM p WHERE before IS NOT NULL AND (before, event_type) NOT IN ({_EDGES}) GROUP BY ALL""",
    "current_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY user_id",
    "retention_prune": f"""WITH {_E}, d AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS nth, date_trunc('week', day) AS week FROM (SELECT DISTINCT day FROM e)),
        w AS (SELECT day, dense_rank() OVER (ORDER BY week DESC) AS week_no FROM d WHERE nth > 7 QUALIFY row_number() OVER (PARTITION BY week ORDER BY day DESC) = 1)
        SELECT day::VARCHAR AS day, CASE WHEN nth <= 7 THEN 'daily' WHEN week_no <= 2 THEN 'weekly' ELSE 'dropped' END AS kept FROM d LEFT JOIN w USING (day)""",
    "latency_estimate": "SELECT event_type, round(median(value), 6) AS typical FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20) GROUP BY event_type",
    "library_stats": """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS waiting, round(sum(o_totalprice), 2) AS total,
        max(o_orderdate)::DATE::VARCHAR AS last_day FROM orders GROUP BY o_orderpriority""",
    "tallies_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())",
    "folder_tree": "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(source, lang)::BIGINT AS level FROM documents GROUP BY ROLLUP (source, lang)",
    "distinct_categories": "SELECT DISTINCT p_type AS category FROM part WHERE p_type <> ''",
    "registry_list": """SELECT o_orderkey, c_name, o_orderstatus, o_orderdate::DATE::VARCHAR AS day FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%00%' AND o_orderstatus IN ('F', 'O')
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25""",
    "access_filter": """SELECT r_name, count(*) AS orders, count(DISTINCT o_custkey) AS owners, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "scd_active_version": """WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS version_no FROM orders)
        SELECT o_custkey, o_orderkey, version_no FROM v WHERE o_orderstatus = 'F' QUALIFY version_no = max(version_no) OVER (PARTITION BY o_custkey)""",
    "latest_replace": "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "index_health": """WITH b AS (SELECT coalesce(d.doc_id, l.doc_id, v.vec_id) AS id, d.doc_id AS d, l.doc_id AS l, v.vec_id AS v FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
          FULL JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON coalesce(d.doc_id, l.doc_id) = v.vec_id)
        SELECT CASE WHEN d IS NULL THEN 'orphan' WHEN l IS NULL AND v IS NULL THEN 'bare' WHEN l IS NULL THEN 'unlabelled' WHEN v IS NULL THEN 'no vector' ELSE 'complete' END AS state, count(*) AS n, min(id) AS first_id FROM b GROUP BY 1""",
    "orphans": """SELECT vec_id AS id, 'embeddings' AS what FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = vec_id)
        UNION ALL SELECT doc_id, 'labels' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""",
    "metric_users": "SELECT c_mktsegment, event_type, count(*) AS n FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY ALL",
}
