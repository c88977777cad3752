"""Small cases of findings: each failed before its change."""

from types import SimpleNamespace

import duckdb
import pandas as pd

from docloom.operators import expansion, knowledge, layout
from docloom.plans import evidence, measures
from docloom.streaming import conversations


def test_a_word_goes_on_in_any_letter_and_equal_turns_have_no_order(spark, tmp_path):
    """"Été" and "Yé" open with no joining word, in the SQL as in the query."""
    nine = " two three four five six seven eight nine"
    rows = [(1, 0, "user", "ten" + nine), (1, 1, "user", "Eté" + nine), (1, 2, "user", "Yé" + nine), (1, 3, "user", "et" + nine), (1, 3, "user", "zehn" + nine), (1, 4, "user", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, evidence.follow_ups(spark, str(tmp_path)).collect()))
    assert got == [(1, 0, False, 0), (1, 1, False, 1), (1, 2, False, 2), (1, 3, False, 3), (1, 3, True, 2), (1, 4, True, 3)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(evidence.SQL["follow_ups"]).fetchall()) == got


def test_first_hits_of_a_word_are_found_before_its_questions(spark):
    """hits are cut to the first forty for each word and kind, then meet the questions."""
    questions = spark.range(300).selectExpr("id as q", "'red' as term", "'LARGE' as kind")
    entities = spark.range(600).selectExpr("id % 7 as document", "id as section", "id * 100 as id", "'red' as term", "'LARGE' as kind")
    found = expansion.entity_hits(questions, entities.unionByName(entities))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("dense_rank")
    got = {(r.document, r.section) for r in found.where("q = 7").collect()}
    assert got == {(0, 7 * i) for i in range(8)}


class Kept:
    """A state of one key."""

    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def clear(self):
        self.v = None

    def update(self, v):
        self.v = v

    put = update

    def appendList(self, v):
        self.v = (self.v or []) + v


def test_a_person_has_one_timer_a_batch(spark):
    """what waits has one timer for its earliest row, and all that is due has its turn at once."""
    timers = []
    handle = SimpleNamespace(getValueState=lambda *_: Kept(), getListState=lambda *_: Kept(), registerTimer=timers.append)
    c = conversations.Candidates(2)
    c.init(handle)
    acts = ["offer", "offer", "offer", "accept", "offer"]
    rows = pd.DataFrame({"event": range(5), "us": [1_000_000 * (i + 1) for i in range(5)], "act": acts, "candidate": [0, 1, 2, 1, 4], "actor": 9, "manages": False})
    list(c.handleInputRows((9,), iter([rows.iloc[::-1]]), None))
    assert timers == [1000]
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 4500)
    out = next(iter(c.handleExpiredTimer((9,), at, SimpleNamespace(getExpiryTimeInMs=lambda: 1000))))
    assert list(out.outcome) == ["offered", "offered", "full", "accepted"] and timers == [1000, 5000]
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 4500)
    out = next(iter(c.handleExpiredTimer((9,), at, SimpleNamespace(getExpiryTimeInMs=lambda: 5000))))
    assert list(out.outcome) == ["offered"] and c.open.get() == ([0, 4],)


def test_lanes_are_found_by_edges_not_by_points(spark):
    """A page may be as wide as it likes."""
    wide = 2e9
    rows = [(1, 0, r, x, x + 40.0) for r in range(3) for x in (0.0, 20.0, wide - 40)] + [(1, 0, 3, 0.0, wide)]
    words = spark.createDataFrame(rows, "page int, band int, row int, x0 double, x1 double")
    assert [r.cut for r in layout._lanes(words, ["page", "band"], 0.7).collect()] == [(60 + wide - 40 + 1) / 2]
    assert layout._lanes(words, ["page", "band"], 0.9).count() == 0


def test_readings_of_small_files_are_not_sent_to_all(spark, data):
    """texts written from a small file are many; F10: they are work for more than one task."""
    plan = measures.conflicts(spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert measures.measurements(spark, data).rdd.getNumPartitions() > 1


def test_items_that_are_alike_are_looked_at_once(spark):
    """the best items of a question among many of the same terms, by what its user sees."""
    items = spark.range(100).selectExpr("id as item", "array('red', 'ring', 'x' || id) as terms", "if(id % 2 = 0, 'shared', 'team 1') as by", "id % 10 / 10D as confidence")
    asked = spark.createDataFrame([(1, ["red", "size", "ring"], ["shared"]), (2, ["ring", "red", "size"], ["shared", "team 1"]), (3, ["blue"], ["shared"])], "q long, ts array<string>, sees array<string>")
    got = sorted((r.q, r.item, round(r.share, 3)) for r in knowledge.best_covering(asked, items, 0.34, 3).collect())
    shared, team = [8, 18, 28], [9, 19, 29]
    assert got == [(1, i, 0.667) for i in shared] + [(2, i, 0.667) for i in sorted(shared + team)]
