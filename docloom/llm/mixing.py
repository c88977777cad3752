"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by hash. Targets say how many words a source gives,
so how often each block is drawn: whole passes, and one pass over a part of the permuted blocks.
The draws of all sources are then divided exactly among output shards: a binary tree over the
shards splits the sources' quotas, each split a multivariate-hypergeometric draw, and a shard
takes the next blocks of each source's permuted order, so shards are disjoint.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import numbered, running, stored, table, text_or_empty, words_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK_DOCS = 1024
SHARDS = 16
#: Groups of sources whose quotas the tree splits; a group's are then dealt among its sources.
SOURCE_GROUPS = 256
#: Documents that are shuffled among each other in one task, about.
SLICE_DOCS = 4096
SEED = 20240229


def _key() -> Column:
    """The source as a key that is never null; null sorts last."""
    return F.when(F.col("source").isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col("source").cast("string")))


def _hash() -> Column:
    return F.xxhash64(F.lit(SEED), F.col("doc_id"), text_or_empty())


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``key, source_size, docs, target`` from ``key, size`` rows.

    A source's target is its weight times a common level, but at most ``most`` times its size;
    the level is the one at which the targets sum to ``share`` of all sizes, which is what
    sharing the excess again and again comes to. Sources are sorted by the ratio of cap to
    weight; the level follows from running sums over them, which are taken by ranges, so any
    number of sources does."""
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    per = numbered(per, [], ["key"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), len(weights)).cast("int") + 1)
    per = per.withColumn("w", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    per = per.withColumn("ratio", F.col("cap") / F.col("w"))
    per = running(per, [], ["ratio", "key"], {"cap": "caps_before", "w": "w_before"})
    total = per.agg(F.sum("source_size"), F.sum("w")).first()
    words, all_w = float(total[0] or 0), float(total[1] or 0)
    level = (F.lit(share * words) - F.col("caps_before")) / (F.lit(all_w) - F.col("w_before"))
    per = stored(per.withColumn("level", level).withColumn("capped", F.col("cap") <= level * F.col("w")))
    common = per.agg(F.max(F.when(~F.col("capped"), F.col("level")))).first()[0] or 0.0
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.lit(common) * F.col("w")))
    return per.select("key", "source_size", "docs", target.alias("target"))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items out of good + bad are good, for any numbers: the odds of each
    outcome follow from the mode by ratios of neighbours, out to where they no longer count, and
    one uniform number picks among their sums."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    all_ = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (all_ + 2)))
    spread = np.sqrt(draws * (good / all_) * (bad / all_) * ((all_ - draws) / max(1, all_ - 1)))
    reach = int(12 * spread) + 40
    up = np.arange(mode, min(high, mode + reach), dtype=float)  # log odds of k + 1 against k
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)  # of k - 1 against k
    ups = np.log(good - up) + np.log(draws - up) - np.log(up + 1) - np.log(bad - draws + up + 1)
    downs = np.log(down) + np.log(bad - draws + down) - np.log(good - down + 1) - np.log(draws - down + 1)
    odds = np.exp(np.concatenate([np.cumsum(downs)[::-1], [0.0], np.cumsum(ups)]))
    sums = np.cumsum(odds)
    return mode - len(down) + int(np.searchsorted(sums, rng.random() * sums[-1], side="right").clip(0, len(odds) - 1))


def split_draw(rng: np.random.Generator, have: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate-hypergeometric draw of so many items, kind by kind."""
    out, left = np.zeros(len(have), dtype=np.int64), int(have.sum())
    for k, n in enumerate(have.tolist()):
        left -= n
        out[k] = hypergeometric(rng, n, left, draws)
        draws -= int(out[k])
    return out


def split_quotas(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact quotas, shards by kinds, that sum to ``counts``; shards' totals differ by at most
    one for each level of the tree."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        take = split_draw(np.random.default_rng([seed, lo, hi]), have, int(have.sum()) * (mid - lo) // (hi - lo))
        split(lo, mid, take)
        split(mid, hi, have - take)

    split(0, shards, counts.astype(np.int64))
    return out


def shard_bounds(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``k, bounds``: for each source how many of its draws the shards up to each one take, from
    ``key, draws``. The tree splits the quotas of at most SOURCE_GROUPS groups of sources; within a
    group each source draws its share of what is left of the group's quotas."""
    group = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(SOURCE_GROUPS)).cast("int")
    counts = stored(counts.withColumn("group", group))
    totals = {r["group"]: r.n for r in counts.groupBy("group").agg(F.sum("draws").alias("n")).collect()}
    ids = sorted(totals)
    quotas = split_quotas(np.array([totals[g] for g in ids], dtype=np.int64), shards, seed)
    of = {g: quotas[:, i] for i, g in enumerate(ids)}

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        g = int(rows["group"].iloc[0])
        rng, left, bounds = np.random.default_rng([seed, 1, g]), of[g].copy(), []
        for n in rows["draws"]:
            mine = split_draw(rng, left, int(n))
            left -= mine
            bounds.append(np.cumsum(mine))
        return pd.DataFrame({"k": rows["key"].to_numpy(), "bounds": bounds})

    return counts.groupBy("group").applyInPandas(deal, "k string, bounds array<long>")


def _filled(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block, in their permuted order, that fit into the room left, and the
    smallest other one if that comes nearer."""
    rows = rows.sort_values("at")
    room, taken, left = float(rows["room"].iloc[0]), [], []
    for at, n in zip(rows["at"], rows["words"]):
        if n <= room:
            taken.append(at)
            room -= n
        elif n:
            left.append((n, at))
    if left and (least := min(left))[0] < 2 * room:
        taken.append(least[1])
    return pd.DataFrame({"ck": [rows["k"].iloc[0]], "cb": [rows["b"].iloc[0]], "cut": [sorted(taken)]})


def plan(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, **shares) -> tuple[DataFrame, DataFrame]:
    """Sources and drawn blocks, both stored, from ``key, size, hash`` rows.

    Sources: ``key, source_size, docs, target, n_blocks``. Blocks: ``k, b, whole`` (shards of the
    block's whole draws), ``cut, cut_shard``: of the one block that a source's last pass takes in
    part, the places (``at``) of the documents that are taken once more. A source's blocks are
    summed and numbered by ranges of their permuted order, never in one task."""
    sources = targets(rows, **shares).withColumn("n_blocks", F.ceil(F.col("docs") / BLOCK_DOCS).cast("long"))
    sources = stored(sources)
    placed = with_blocks(rows, sources)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    blocks = placed.groupBy("key", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    blocks = blocks.withColumn("passes", full).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    order = lambda p: F.xxhash64(F.lit(seed), p, F.col("key"), F.col("block"))
    blocks = stored(running(blocks.withColumn("place", order(F.col("passes"))), ["key"], ["place", "block"], {"words": "before"}).drop("place"))
    room = F.col("rest") - F.col("before")
    cut = blocks.where((room > 0) & (room < F.col("words"))).select(F.col("key").alias("k"), F.col("block").alias("b"), room.alias("room"))

    by_at = placed.join(cut, (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")))
    by_at = by_at.groupBy("k", "b", "at").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    cuts = by_at.groupBy("k", "b").applyInPandas(_filled, "ck string, cb long, cut array<long>")

    passes = F.sequence(F.lit(0), F.col("passes"))
    draws = blocks.join(cuts, (F.col("key") == F.col("ck")) & (F.col("block") == F.col("cb")), "left")
    draws = draws.select("key", "block", "passes", "cut", "words", "before", "rest", F.explode(passes).alias("pass"))
    last = F.col("pass") == F.col("passes")
    draws = draws.where(~last | F.col("cut").isNotNull() | ((F.col("words") > 0) & (F.col("before") + F.col("words") <= F.col("rest"))))
    draws = draws.select("key", "block", "pass", order(F.col("pass")).alias("place"), last.alias("last"), "cut")
    draws = numbered(draws, ["key"], ["pass", "place", "block"], "number")
    bounds = shard_bounds(draws.groupBy("key").agg(F.count("*").alias("draws")), shards, seed)
    draws = draws.join(bounds, F.col("key") == F.col("k"))
    shard = F.size(F.filter("bounds", lambda x: x <= F.col("number")))
    draws = draws.select("key", "block", "pass", shard.alias("shard"), F.when(F.col("last"), F.col("cut")).alias("cut"))
    whole = F.transform(F.sort_array(F.collect_list(F.when(F.col("cut").isNull(), F.struct("pass", "shard")))), lambda x: x["shard"])
    drawn = draws.groupBy("key", "block").agg(whole.alias("whole"), F.first("cut", ignorenulls=True).alias("cut"), F.max(F.when(F.col("cut").isNotNull(), F.col("shard"))).alias("cut_shard"))
    return sources, stored(drawn.select(F.col("key").alias("k"), F.col("block").alias("b"), "whole", "cut", "cut_shard"))


def with_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row's source, block and place in the block. The stored table of sources says its own
    size, so Spark broadcasts it only while that is small and else splits the hot source."""
    s = sources.withColumnRenamed("key", "source_key")
    joined = rows.join(s, F.col("key") == F.col("source_key")).drop("source_key", "docs")
    return joined.withColumns({"block": F.pmod("hash", "n_blocks"), "at": F.xxhash64("hash", F.lit(SEED))}).drop("n_blocks")


def drawn(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``shards``: the output shards that take the row, one entry for each time."""
    out = placed.join(blocks, (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")), "left").drop("k", "b")
    none = F.array().cast("array<int>")
    partly = F.when(F.array_contains("cut", F.col("at")), F.array("cut_shard")).otherwise(none)
    return out.withColumn("shards", F.concat(F.coalesce("whole", none), partly)).drop("whole", "cut", "cut_shard")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, key, size, hash``: null texts have size 0, null sources are one source."""
    return docs.select("doc_id", _key().alias("key"), F.size(words_of(text_or_empty())).cast("long").alias("size"), _hash().alias("hash"))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` that the mix takes, once for each time, dealt to shards and in a
    random order within each. Columns are those of ``docs``.

    Everything is drawn by hashes of id and text, so reruns agree. A source's taken words come
    within half a document of its target. Rows that repeat an id and its text fall into one block
    and are taken all or none, so where the last pass meets such rows the target is met within
    half of their words together. An empty table, or one without words, gives no rows; columns of
    any name pass through untouched."""
    _, sources, blocks = _planned(docs, shards, seed)
    rows = docs.select(F.struct("*").alias("row"), _key().alias("key"), _hash().alias("hash"))
    rows = drawn(with_blocks(rows, sources), blocks).select("row", "hash", F.posexplode("shards").alias("copy", "shard"))
    rows = rows.withColumn("order", F.xxhash64("hash", "copy", F.lit(seed)))
    # a shard is shuffled in slices of a few thousand documents, whatever its size
    docs_a_shard = (sources.agg(F.sum("docs")).first()[0] or 0) * SHARE / shards
    slices = F.pmod("order", F.lit(1 + int(docs_a_shard / SLICE_DOCS)))
    return rows.repartition("shard", slices).sortWithinPartitions("shard", "order").select("row.*")


def _planned(docs: DataFrame, shards: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = stored(sized(docs))
    return rows, *plan(rows.drop("doc_id"), shards, seed)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows, sources, blocks = _planned(docs, SHARDS, SEED)
    out = drawn(with_blocks(rows, sources), blocks)
    return out.select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"), "shards")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of the mix, shard by shard."""
    return mix(docs)
