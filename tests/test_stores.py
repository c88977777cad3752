"""Tables in versions, and backups: conflicts, pages, damage and repair."""

import os
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from docloom.operators import backups
from docloom.sources.snapshots import Conflict, Table


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions_are_whole(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        t.read()
    assert t.append(frame(spark, [(1, "a"), (1, "a"), (2, "b"), (None, "n")])) == 0
    early = t.read()
    assert t.replace(frame(spark, [(1, "x"), (None, "m"), (9, "new"), (9, "new")]), ["k"]) == 1
    assert rows(t.read()) == rows(frame(spark, [(1, "x"), (None, "m"), (9, "new"), (9, "new"), (2, "b")]))
    assert t.delete(frame(spark, [(9, "")]), ["k"]) == 2 and t.count() == 3 and t.count(where="k = 1") == 1
    # what was read before stays what it was; so does every version
    assert rows(early) == rows(t.read(0)) == rows(frame(spark, [(1, "a"), (1, "a"), (2, "b"), (None, "n")]))
    assert t.count(1) == 5 and t.back_to(0) == 3 and rows(t.read()) == rows(early)
    assert t.replace(frame(spark, []), ["k"]) == 4 and t.count() == 4
    before = rows(t.read())
    assert t.compact() == 5 and rows(t.read()) == before and t.manifest()["gone"] == []


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.append(frame(spark, [(1, "a")]))
    bad = frame(spark, [(1, "b")]).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        t.replace(bad, ["k"])
    assert rows(t.read()) == [(1, "a")] and t.versions() == [0]


def test_writers_meet(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.append(frame(spark, [(i, "a") for i in range(10)]))
    base = t.manifest()
    t.delete(frame(spark, [(3, "")]), ["k"])
    # a writer that read version 0 can't replace any more; one that only adds goes behind
    with pytest.raises(Conflict):
        t._commit(base, "replace", base["data"], [], base["schema"])
    assert t._commit(base, "append", [*base["data"], t._folder(frame(spark, [(50, "z")]), "data")], base["gone"], base["schema"]) == 2
    assert {r.k for r in t.read().collect()} == {0, 1, 2, 4, 5, 6, 7, 8, 9, 50}
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda i: t.append(frame(spark, [(100 + i, "t")])), range(6)))
    assert sorted(done) == [3, 4, 5, 6, 7, 8] and t.count(where="k >= 100") == 6
    assert not [n for n in os.listdir(tmp_path / "t" / "versions") if n.startswith(".") and not n.endswith(".crc")]


def test_scrolling_has_every_row_once(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.append(spark.createDataFrame([(i % 7, i, f"v{i}") for i in range(100)], "g int, k long, v string").repartition(4))
    t.delete(spark.createDataFrame([(3,)], "g int"), ["g"])
    seen = []
    for i, page in enumerate(t.pages(["g", "k"], 9)):
        got = [(r.g, r.k) for r in page.collect()]
        assert len(got) == 9 or i == 9
        seen += got
        t.append(spark.createDataFrame([(0, 1000 + i, "later")], "g int, k long, v string"))
    assert seen == sorted((i % 7, i) for i in range(100) if i % 7 != 3)
    assert [r.k for r in t.scroll(["g", "k"], 2, after=(2, 93), where="k < 1000").collect()] == [4, 11]
    plan = t.scroll(["g", "k"], 2, after=(2, 93))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(g,2)" in plan


def sample(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), F.col("id"))).alias("v"), (F.col("id") / 3).alias("x"))


def test_digests_depend_on_rows_alone(spark):
    df, part = sample(spark), backups.part_of(F.col("k"))
    one = backups.tree(df, part)
    assert backups.differing(one, backups.tree(df.repartition(7).orderBy(F.desc("k")).select("x", "v", "k"), part)).count() == 0
    changes = {"lost": df.where("k <> 77"), "twice": df.union(df.where("k = 77")), "null": df.withColumn("v", F.when(F.col("k") == 77, None).otherwise(F.col("v"))), "swapped": df.withColumn("k", F.when(F.col("k") == 77, 77 + 2560).otherwise(F.col("k")))}
    for name, other in changes.items():
        assert [r.part for r in backups.differing(one, backups.tree(other, part)).collect()] == [77], name
    # two columns that trade a value and a null
    a = spark.createDataFrame([(1, "s", None)], "k long, a string, b string")
    b = spark.createDataFrame([(1, None, "s")], "k long, a string, b string")
    assert backups.differing(backups.tree(a, part), backups.tree(b, part)).count() == 1
    levels = {r.level: r.n for r in one.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels == {0: 1, 1: 16, 2: 256} and one.where("level = 0").first().rows == 2000
    none = df.limit(0)
    assert backups.tree(none, part).count() == 0 and backups.differing(one, backups.tree(none, part)).count() == 256


def test_damage_is_named_and_repaired(spark, tmp_path):
    df, part, path = sample(spark), backups.part_of(F.col("k")), str(tmp_path / "b")
    backups.backup(df, part, path)
    assert backups.drill(spark, path).count() == 0
    live = df.where("k % 256 <> 9").union(spark.createDataFrame([(256 * 50 + 4, "new", 0.0)], "k long, v string, x double"))
    found = backups.differing(backups.tree(live, part), backups.saved(spark, path)[1])
    assert {(r.part, r.ours - r.theirs) for r in found.collect()} == {(9, -8), (4, 1)}
    again = backups.restored(live, part, path, found)
    assert rows(again) == rows(df)
    # the backup itself: one part lost, one file overwritten
    shutil.rmtree(f"{path}/rows/__part=200")
    bad = next(f for f in sorted(os.listdir(f"{path}/rows/__part=33")) if f.endswith(".parquet"))
    with open(f"{path}/rows/__part=33/{bad}", "r+b") as f:
        f.seek(8)
        f.write(b"\xff" * 200)
    os.remove(f"{path}/rows/__part=33/.{bad}.crc")
    assert {(r.part, r.ours) for r in backups.drill(spark, path).collect()} == {(200, 0), (33, 0)}
