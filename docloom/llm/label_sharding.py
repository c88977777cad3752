"""Sharding by balanced label propagation: equal texts move together, shards stay even.

Every document starts in a shard by hash. Documents with equal texts are linked; round by round
each group's documents move towards the shard where most of the group is, as far as quotas allow,
which cuts fewer links. Then every shard is brought to its exact number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import numbered, stored, table, text_or_empty

SHARDS = 24
#: Rounds at most; they end when nobody may move.
ROUNDS = 8
SEED = 97
#: Moves are allowed by a hash of this many values, so quotas hold in parts of a million.
GRAIN = 1_000_000


def _hash(*parts) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, text_key, row``: ``text_key`` is a 128-bit digest that stands
    for the text, ``row`` a hash that orders rows. A null text counts as an empty one."""
    text = text_or_empty()
    raw = F.encode(text, "UTF-8")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("text_key"),
    ).withColumn("row", _hash("doc_id", "text_key"))


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def allowed(load: np.ndarray, wishes: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Share of the wished moves from shard to shard that keeps every load within its quota.

    Moves that are matched by moves the other way always go; the rest of a shard's wishers share
    the room that is left there, what the shard surely loses by exchange not counted twice."""
    swap = np.minimum(wishes, wishes.T)
    extra = wishes - swap
    room = np.maximum(quota - load, 0)
    into = extra.sum(axis=0)
    share = np.where(into > 0, np.minimum(1.0, room / np.maximum(into, 1)), 0.0)
    moved = swap + extra * share
    return np.where(wishes > 0, moved / np.maximum(wishes, 1), 0.0)


def propagate(linked: DataFrame, quota: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """Labels of the linked documents (``text_key, row, tie, shard``) after some rounds.

    Documents without links never want to move and give way later, so a shard has room for
    linked documents up to its whole quota. Votes are
    counted by group and shard before they are shuffled, so a group with a third of all rows is
    as many rows as there are shards; only the wishes' 24 by 24 counts come to the driver."""
    shards = len(quota)
    now = linked
    for n in range(rounds):
        votes = now.groupBy("text_key", "shard").agg(F.count("*").alias("n"))
        best = votes.groupBy("text_key").agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("best"))
        # stored, so the join below has a shuffle of its own that can split a large group
        best = stored(best.select(F.col("text_key").alias("group"), (-F.col("best.s")).alias("to")))
        wish = votes.join(best, F.col("text_key") == F.col("group")).groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()
        wishes, load = np.zeros((shards, shards)), np.zeros(shards)
        for w in wish:
            load[w.shard] += w.n
            if w.shard != w.to:
                wishes[w.shard, w.to] += w.n
        rate = np.floor(allowed(load, wishes, quota) * GRAIN).astype(int)
        if not (rate * wishes).any():
            break
        rates = F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in rate])
        go = F.pmod(_hash("row", F.lit(n)), GRAIN) < F.get(F.get(rates, F.col("shard")), F.col("to"))
        now = now.join(best, F.col("text_key") == F.col("group"))
        now = stored(now.select("text_key", "row", "tie", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard")))
    return now


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, text_key, shard, slot`` for every row.

    Law ``rows``: counts at most one apart, slots gapless from 0. Rows beyond a shard's quota
    (those without links first) go, group by group, to the shards that lack some. Rows with equal
    texts are links whatever their ids; repeated rows count as two and are told apart; null texts are empty texts. An
    empty table gives no rows; extra columns are left out."""
    # stored with a number of its own, which tells rows apart that repeat or whose hashes meet
    rows = stored(documents(docs).withColumn("tie", F.monotonically_increasing_id()))
    groups = stored(rows.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("text_key").alias("g")))
    start = F.pmod("row", F.lit(shards)).cast("int")
    rows = rows.join(groups, F.col("text_key") == F.col("g"), "left")
    rows = stored(rows.select("doc_id", "size", "text_crc32", "text_key", "row", "tie", start.alias("shard"), F.col("g").isNotNull().alias("linked")))
    quota = np.array(quotas(rows.count(), shards))

    moved = propagate(rows.where("linked").select("text_key", "row", "tie", "shard"), quota, rounds)
    moved = moved.select(F.col("tie").alias("r"), F.col("shard").alias("to"))
    rows = rows.join(moved, F.col("tie") == F.col("r"), "left")
    rows = rows.withColumn("shard", F.coalesce("to", "shard")).drop("r", "to")

    placed = numbered(rows.withColumn("free", ~F.col("linked")), ["shard"], ["free", "text_key", "row", "tie"], "slot")
    quota_of = F.get(F.array(*[F.lit(int(q)) for q in quota]), F.col("shard"))
    loads = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    stay = placed.where(F.col("slot") < quota_of)
    spare = numbered(placed.where(F.col("slot") >= quota_of).drop("slot"), [], ["text_key", "row", "tie"], "nth")
    have = [min(loads.get(s, 0), int(q)) for s, q in enumerate(quota)]
    upto = np.cumsum([int(q) - h for q, h in zip(quota, have)])
    hole = F.array(*[F.lit(int(x)) for x in upto])
    to = F.size(F.filter(hole, lambda x: x <= F.col("nth"))).cast("int")
    first = F.array(*[F.lit(int(h - (u - (q - h)))) for h, u, q in zip(have, upto, quota)])
    filled = spare.withColumn("shard", to).withColumn("slot", F.col("nth") + F.get(first, F.col("shard")))
    columns = ["doc_id", "size", "text_crc32", "text_key", "shard", "slot"]
    return stay.select(columns).unionByName(filled.select(columns))


def cut_links(sharded: DataFrame) -> DataFrame:
    """``groups, copies, cut``: links are those of each text's copies to the shard where most of
    them are; ``cut`` counts those in another one."""
    cells = sharded.groupBy("text_key", "shard").agg(F.count("*").alias("n"))
    per = cells.groupBy("text_key").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    return per.agg(F.count("*").alias("groups"), F.sum("n").alias("copies"), F.sum(F.col("n") - F.col("most")).alias("cut"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
