"""Streaming queries over events, drained, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.store import stored
from docloom.plans.analytics import BOUNDS, SQL as BATCH
from docloom.plans.retrieval import read
from docloom.streaming import conversations as C
from docloom.streaming import events as E


OPEN_AT_ONCE = 6


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.events(spark, f"{sf_dir}/events.parquet")


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drained(E.counters(_stream(spark, sf_dir), BOUNDS), "update", ["event_type", "bucket"])


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drained(E.windows(_stream(spark, sf_dir), "1 hour"), "update", ["start_s", "event_type"])


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drained(E.windows(_stream(spark, sf_dir), "6 hours", "3 hours"), "update", ["start_s", "event_type"])


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drained(E.closed_sessions(_stream(spark, sf_dir)), "append", ["user_id", "start_us"])


def stream_first_sights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drained(E.first_sights(_stream(spark, sf_dir)), "append", ["user_id", "event_type"])


def stream_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question is about, by the state of its conversation; every second pair of turns comes an hour
    after the one before. A reply of more than 40 words is an answer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.text_or_empty("text").alias("text"))
    words = lambda t: F.size(T.terms(t))
    c = c.withColumn("answered", words(F.coalesce(F.lead("text").over(w), F.lit(""))) > 40).where("role = 'user'")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("conv_id", F.lit(97)) * 60 + F.col("turn") * 480 + F.floor(F.col("turn") / 4) * 2400)
    turns = stored(c.select("conv_id", "turn", at.alias("ts"), C.follows(F.col("text"), words(F.col("text"))).alias("follows"), C.tells(F.col("text")).alias("tells"), "answered"))
    path = turns.inputFiles()[0].rsplit("/", 1)[0] if turns.inputFiles() else None
    stream = spark.readStream.schema(turns.schema).parquet(path)
    with E.rocksdb(spark):
        return E.drained(C.understood(stream), "append", ["conv_id", "turn", "kind", "subject"])


def stream_not_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as steps of a work, their errors as its cancellation: steps that no error of the hour before
    has called off."""
    steps = _stream(spark, sf_dir).where("event_type <> 'error'").select(F.col("user_id").alias("doc"), F.col("event_id").alias("step"), "ts")
    cancels = _stream(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("doc"), "ts")
    out = E.drained(C.not_cancelled(steps, cancels), "append", ["doc", "step"])
    return out.select("doc", "step", F.unix_micros("ts").alias("us"))


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' views and signups as offers; purchases accept their last one, errors dismiss that before it, clicks
    are a neighbour's try to accept the last one, which every tenth user may."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("event"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    w = Window.partitionBy("owner").orderBy("ts", "event").rowsBetween(Window.unboundedPreceding, -1)
    offer = F.col("event_type").isin("view", "signup")
    last = F.last(F.when(offer, F.col("event")), ignorenulls=True).over(w)
    e = e.withColumn("last", last).withColumn("before", F.lag("last").over(Window.partitionBy("owner").orderBy("ts", "event")))
    act = F.when(offer, "offer").when(F.col("event_type") == "error", "dismiss").otherwise("accept")
    candidate = F.when(offer, F.col("event")).when(F.col("event_type") == "error", F.col("before")).otherwise(F.col("last"))
    actor = F.when(F.col("event_type") == "click", F.col("owner") + 1).otherwise(F.col("owner"))
    return e.select("owner", "event", "ts", act.alias("act"), F.coalesce(candidate, F.lit(-1)).alias("candidate"), actor.alias("actor"), (actor % 10 == 0).alias("manages"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(_suggestions(spark, sf_dir))
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    with E.rocksdb(spark):
        return E.drained(C.resolved(stream, OPEN_AT_ONCE), "append", ["event"])


def stream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each offer, acceptance and dismissal of a suggestion comes to, with six open ones a user at most."""
    return _resolved(spark, sf_dir).select("owner", "event", "candidate", "outcome")


def candidate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions by user and state, with the newest of each."""
    found = C.states(_resolved(spark, sf_dir))
    return found.groupBy("owner", "state").agg(F.count("*").alias("n"), F.max("candidate").alias("newest"))


QUERIES = {f.__name__: f for f in (stream_candidates, candidate_search, stream_counters, stream_tumbling, stream_sliding, stream_sessions, stream_first_sights, stream_conversations, stream_not_cancelled)}

_TERMS = r"len(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1))"
#: A user's events one by one, with the suggestions that are open after each.
_FOLD = f"""e AS (SELECT user_id AS owner, event_id AS event, ts, event_type AS k, event_type IN ('view', 'signup') AS offer FROM events),
  l AS (SELECT *, last_value(CASE WHEN offer THEN event END IGNORE NULLS) OVER (PARTITION BY owner ORDER BY ts, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e),
  o AS (SELECT owner, event, epoch_us(ts) AS us, ((SELECT epoch_us(max(ts)) FROM events) // 1000) * 1000 - 600000000 AS mark, CASE WHEN offer THEN 'offer' WHEN k = 'error' THEN 'dismissed' ELSE 'accepted' END AS act,
    coalesce(CASE WHEN offer THEN event WHEN k = 'error' THEN lag(last) OVER w ELSE last END, -1) AS candidate, CASE WHEN k = 'click' THEN owner + 1 ELSE owner END AS actor, row_number() OVER w AS seq FROM l WINDOW w AS (PARTITION BY owner ORDER BY ts, event)),
  f AS (SELECT DISTINCT owner, 0::BIGINT AS event, 0::BIGINT AS us, 0::BIGINT AS mark, 0::BIGINT AS candidate, '' AS outcome, []::BIGINT[] AS held, 0::BIGINT AS seq FROM o
    UNION ALL SELECT owner, event, us, mark, candidate, outcome, CASE outcome WHEN 'offered' THEN list_append(held, candidate) WHEN act THEN list_filter(held, lambda c: c <> candidate) ELSE held END, seq FROM (
      SELECT o.owner, o.event, o.us, o.mark, o.candidate, o.act, f.held, o.seq,
        CASE WHEN act = 'offer' THEN CASE WHEN len(held) >= {OPEN_AT_ONCE} THEN 'full' ELSE 'offered' END WHEN actor <> o.owner AND actor % 10 > 0 THEN 'not theirs' WHEN NOT list_contains(held, o.candidate) THEN 'closed' ELSE act END AS outcome
      FROM f JOIN o ON o.owner = f.owner AND o.seq = f.seq + 1))"""

SQL = {
    "stream_counters": BATCH["latency_histogram"],
    "stream_tumbling": "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_sliding": """WITH w AS (SELECT epoch(time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT - back * 10800 AS start_s, event_type, value FROM events, (VALUES (0), (1)) AS b(back))
        SELECT start_s, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY ALL""",
    "stream_sessions": """WITH l AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000)::INTEGER, 0) AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM l),
        g AS (SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, session)
        SELECT * FROM g WHERE end_us <= (SELECT (epoch_us(max(ts)) // 1000) * 1000 FROM events) - 600000000""",
    "stream_first_sights": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_conversations": rf"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce({_TERMS.format("lead(text) OVER (PARTITION BY conv_id ORDER BY turn)")}, 0) > 40 AS answered FROM conversations),
        u AS (SELECT conv_id, turn, answered, 60 * (conv_id % 97) + 480 * turn + 2400 * (turn // 4) AS s, regexp_matches(text, '{C.FOLLOWS}') OR {_TERMS.format("text")} <= 1 AS follows, NOT regexp_matches(text, '{C.ASKS}') AS tells FROM c WHERE role = 'user'),
        g AS (SELECT *, lag(s) OVER w AS before, lag(answered) OVER w AS answered_before FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY s, turn)),
        p AS (SELECT *, sum((before IS NULL OR s > before + 1800)::INTEGER) OVER (PARTITION BY conv_id ORDER BY s, turn ROWS UNBOUNDED PRECEDING) AS part, before IS NULL OR s > before + 1800 OR NOT (follows OR tells) AS fresh FROM g),
        o AS (SELECT *, last_value(CASE WHEN fresh THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY s, turn ROWS UNBOUNDED PRECEDING) AS subject, lead(s) OVER (PARTITION BY conv_id, part ORDER BY s, turn) AS later,
          (SELECT max(s) FROM u) - 600 AS mark FROM p)
        SELECT conv_id, turn, CASE WHEN fresh THEN 'fresh' WHEN tells THEN 'told' ELSE 'follow_up' END AS kind, subject, NOT fresh AND tells AND NOT answered_before AS clarifies FROM o WHERE s <= mark
        UNION ALL SELECT conv_id, NULL, 'left_open', subject, false FROM o WHERE later IS NULL AND NOT answered AND s + 1800 < mark""",
    "stream_not_cancelled": """WITH m AS (SELECT least(max(ts) FILTER (event_type = 'error'), max(ts) FILTER (event_type <> 'error')) AS t FROM events)
        SELECT user_id AS doc, event_id AS step, epoch_us(ts) AS us FROM events e WHERE event_type <> 'error' AND epoch_us(ts) < (epoch_us((SELECT t FROM m)) // 1000) * 1000 - 600000000
        AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'error' AND c.user_id = e.user_id AND c.ts <= e.ts AND c.ts >= e.ts - INTERVAL 1 HOUR)""",
    "stream_candidates": f"WITH RECURSIVE {_FOLD} SELECT owner, event, candidate, outcome FROM f WHERE seq > 0 AND us <= mark",
    "candidate_search": f"""WITH RECURSIVE {_FOLD}, s AS (SELECT owner, candidate, coalesce(max(outcome) FILTER (outcome <> 'offered'), 'offered') AS state FROM f WHERE seq > 0 AND us <= mark AND outcome IN ('offered', 'accepted', 'dismissed') GROUP BY ALL)
        SELECT owner, state, count(*) AS n, max(candidate) AS newest FROM s GROUP BY owner, state""",
}
