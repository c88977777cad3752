"""Streams with state over several batches: however rows are cut, the result is that of one batch."""

import random
import time
from datetime import datetime, timedelta

import pytest

from docloom.streaming import conversations as C
from docloom.streaming import events as E

START = datetime(2024, 1, 1)
TURNS = "conv_id long, turn long, ts timestamp, follows boolean, tells boolean, answered boolean"


def batches(spark, folder, parts, schema):
    """A stream whose n-th batch has the n-th part's rows."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05 if i else 0)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def brute(turns, mark):
    """Turns up to the mark, in the order of their times."""
    out = []
    for conv in sorted({t[0] for t in turns}):
        state = None
        for _, turn, ts, follows, tells, answered in sorted((t for t in turns if t[0] == conv and t[2] <= mark), key=lambda t: (t[2], t[1])):
            if state and ts > state[1] + timedelta(minutes=30):
                out += [(conv, None, "left_open", state[0], False)] if state[2] else []
                state = None
            on = state is not None and (follows or tells)
            subject = state[0] if on else turn
            out.append((conv, turn, "told" if on and tells else "follow_up" if on else "fresh", subject, on and tells and state[2]))
            state = (subject, ts, not answered)
        if state and state[2] and state[1] + timedelta(minutes=30) < mark:
            out.append((conv, None, "left_open", state[0], False))
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [1, 4])
def test_conversations_don_t_depend_on_batches(spark, tmp_path, cuts):
    rng = random.Random(8)
    turns, micro = [], timedelta(microseconds=137)
    for conv in range(12):
        at = START + timedelta(minutes=rng.randrange(60))
        for turn in range(rng.randrange(1, 9)):
            at += timedelta(minutes=rng.choice((0, 1, 5, 29, 30, 31, 45))) + micro * rng.randrange(5)
            turns.append((conv, turn, at, rng.random() < 0.4, rng.random() < 0.3, rng.random() < 0.5))
    last = max(t[2] for t in turns)
    turns.append((99, 0, last + timedelta(hours=2), False, False, False))
    # rows come up to nine minutes late, a pair of turns in the wrong order too
    shuffled = sorted(turns, key=lambda t: t[2] + timedelta(minutes=9 * rng.random()))
    n = -(-len(shuffled) // cuts)
    stream = batches(spark, tmp_path / "in", [shuffled[i : i + n] for i in range(0, len(shuffled), n)], TURNS)
    with E.rocksdb(spark):
        got = [tuple(r) for r in E.drained(C.understood(stream), "append", ["conv_id", "turn", "kind", "subject"]).collect()]
    want = brute(turns, last + timedelta(hours=1, minutes=50))
    assert sorted(got, key=str) == want
    assert {k for _, _, k, _, _ in want} == {"fresh", "told", "follow_up", "left_open"}


def test_what_is_told_and_what_follows(spark):
    from pyspark.sql import functions as F

    texts = ["and the fee?", "What about tax", "andante con moto", "The first item is in total added", "show the total", "is it paid", "issue 7 was settled", "وكم مدته؟", "هات الملف", "hm?"]
    rows = spark.createDataFrame([(t, 5) for t in texts], "t string, n int").select("t", C.follows(F.col("t"), F.col("n")).alias("f"), C.tells(F.col("t")).alias("s")).collect()
    assert [r.t for r in rows if r.f] == ["and the fee?", "What about tax", "وكم مدته؟"]
    assert [r.t for r in rows if r.s] == ["andante con moto", "The first item is in total added", "issue 7 was settled"]


def test_cancelled_steps_are_dropped(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    steps = [[(1, 0, at(0)), (1, 1, at(10)), (2, 0, at(12)), (3, 0, at(15))], [(1, 2, at(40)), (1, 3, at(69)), (2, 1, at(41)), (3, 1, at(70))], [(1, 4, at(71)), (4, 0, at(200))], [(4, 1, at(400))]]
    # the last cancellation comes when the watermark is far past it: its step stays
    cancels = [[(1, at(10))], [(2, at(42)), (9, at(42))], [(9, at(190)), (9, at(191))], [(3, at(14)), (9, at(390))]]
    s = batches(spark, tmp_path / "steps", steps, "doc long, step long, ts timestamp")
    c = batches(spark, tmp_path / "cancels", cancels, "doc long, ts timestamp")
    got = sorted((r.doc, r.step) for r in E.drained(C.not_cancelled(s, c), "append", ["doc", "step"]).collect())
    # of document 1 the steps from minute 10 to 70 are called off, and not that before nor that after
    assert got == [(1, 0), (1, 4), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0)]


def brute_candidates(events, most, mark):
    out = []
    for owner in sorted({e[0] for e in events}):
        held = set()
        for _, event, ts, act, candidate, actor, manages in sorted((e for e in events if e[0] == owner and e[2] <= mark), key=lambda e: (e[2], e[1])):
            if act == "offer":
                said = "full" if len(held) >= most else "offered"
                held |= {candidate} if said == "offered" else set()
            elif actor != owner and not manages:
                said = "not theirs"
            else:
                said = {"accept": "accepted", "dismiss": "dismissed", "reject": "rejected"}[act] if candidate in held else "closed"
                held -= {candidate}
            out.append((owner, event, candidate, said))
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 4])
def test_candidates_don_t_depend_on_batches(spark, tmp_path, cuts):
    rng = random.Random(9)
    events, offered = [], {1: [], 2: [], 3: []}
    for i in range(240):
        # one person has two thirds of the events
        owner, at = rng.choice((1, 1, 1, 1, 2, 3)), START + timedelta(minutes=i, microseconds=i * 7)
        act = rng.choice(("offer", "offer", "accept", "dismiss", "reject"))
        candidate = i if act == "offer" else rng.choice(offered[owner][-4:] or [-1])
        offered[owner] += [i] if act == "offer" else []
        actor = rng.choice((owner, owner, owner, 9, 7))
        events.append((owner, i, at, act, candidate, actor, actor == 9))
    last = max(e[2] for e in events)
    events.append((99, 999, last + timedelta(hours=1), "offer", 999, 99, False))
    shuffled = sorted(events, key=lambda e: e[2] + timedelta(minutes=8 * rng.random()))
    n = -(-len(shuffled) // cuts)
    stream = batches(spark, tmp_path / "in", [shuffled[i : i + n] for i in range(0, len(shuffled), n)], "owner long, event long, ts timestamp, act string, candidate long, actor long, manages boolean")
    with E.rocksdb(spark):
        out = E.drained(C.resolved(stream, 5), "append", ["event"])
    got = sorted((r.owner, r.event, r.candidate, r.outcome) for r in out.collect())
    assert got == brute_candidates(events, 5, last)
    assert {o for *_, o in got} == {"offered", "accepted", "dismissed", "rejected", "full", "not theirs", "closed"}
    found = C.states(out)
    mine = C.search(found, 2, False, ("offered", "accepted"), mine_only=False, limit=3, offset=1).collect()
    want = sorted(((o, c) for o, _, c, s in got if o == 2 and s == "offered" and not any(x[2] == c and x[3] in ("dismissed", "rejected") for x in got)), key=lambda x: -x[1])[1:4]
    assert [(r.owner, r.candidate) for r in mine] == want
    assert C.search(found, 9, True, ("offered",), mine_only=False, limit=1000).select("owner").distinct().count() > 1
