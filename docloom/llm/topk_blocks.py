"""Exact top-k search over vectors with block-at-a-time pruning.

Rows are sorted by id and cut into blocks of a document range. A block keeps each term's (each
component's) largest and smallest value and a forward index of its rows. For a query the blocks
are ordered by the sum over its terms of the best that a block's extremes allow, and scored one
by one until no bound reaches the query's k-th score.

Blocks lie in pieces. Every query first scores the piece of the best bound, which gives a k-th score;
pieces whose bounds all lie below it are never shipped to the query, and within the others it is
where the scoring of blocks starts from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import stored, table

K = 10
BLOCK_ROWS = 256
#: Queries that go together, blocks of a piece, and pieces whose extremes are compared at once.
QUERY_GROUP, PIECE_BLOCKS, SPAN_PIECES = 1024, 16, 256
SCALE = 1024.0
EXACT = float(1 << 53)
BLOCKS = "block long, piece long, n int, dim int, ids binary, forward binary, low binary, high binary"


def terms(embedding: str = "embedding") -> Column:
    """floor(1024 * x) of every component as double; null where a component is null, infinite or
    not a number, or there is no vector."""
    x = F.col(embedding).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * SCALE).cast("double")))


def vectors(df: DataFrame) -> DataFrame:
    """``vec_id, terms`` of the rows that take part: those with an id and a sound vector."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), terms().alias("terms"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("terms").isNotNull())


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of terms, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of a range of ids each, stored: a number, how many rows, their ids, the forward index
    and each term's extremes. Every row is in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, count = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            ids, all_terms = b.column(0).to_numpy(), b.column(1)
            for at in range(0, b.num_rows, BLOCK_ROWS):
                x = _matrix(all_terms.slice(at, BLOCK_ROWS))
                values = (first + count, first + count // PIECE_BLOCKS, *x.shape, ids[at : at + BLOCK_ROWS].tobytes(), x.tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes())
                count += 1
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in BLOCKS.split(", ")])

    return stored(rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(run, BLOCKS))


def queries(rows: DataFrame, every: int = 100) -> DataFrame:
    """One query for each id that ``every`` divides (of repeated ids the smallest vector)."""
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("terms").alias("terms"))


def _numbers(below: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(below - 1)))


def best_of(query: np.ndarray, own: int, pieces: list[tuple], bounds: np.ndarray, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
    """The k best (-score, id) of the blocks that reach the floor, ordered. Equal scores go to
    smaller ids, so a block is left out only if its bound is below the k-th score, not equal to it."""
    ids, scores = np.empty(0, dtype=np.int64), np.empty(0)
    for b in np.argsort(-bounds, kind="stable"):
        if bounds[b] < floor:
            break
        block_ids, forward = pieces[b]
        d = min(forward.shape[1], len(query))
        s = forward[:, :d] @ query[:d]
        take = (s >= floor) & (block_ids != own)
        ids, scores = np.concatenate([ids, block_ids[take]]), np.concatenate([scores, s[take]])
        if len(ids) > k:
            order = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]
        if len(ids) >= k:
            floor = max(floor, scores.min())
    order = np.lexsort((ids, -scores))
    return [(int(-scores[i]), int(ids[i])) for i in order]


class Extremes:
    """Extremes of some blocks. A bound is infinite where doubles can't hold the sums of products
    of integers exactly, which they do up to 2**53; such a query scores by Python's integers."""

    def __init__(self, b: pd.DataFrame):
        dims = int(b["dim"].max()) if len(b) else 0
        self.low, self.high = np.zeros((len(b), dims)), np.zeros((len(b), dims))
        for i, (low, high) in enumerate(zip(b["low"], b["high"])):
            low, high = np.frombuffer(low), np.frombuffer(high)
            self.low[i, : len(low)], self.high[i, : len(high)] = low, high
        self.peak = max((abs(x) for x in (self.low.min(initial=0), self.high.max(initial=0))), default=0)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        if not self.peak * np.abs(x).sum() < EXACT:
            return np.full(len(self.low), np.inf)
        d = min(self.low.shape[1], len(x))
        return self.high[:, :d] @ np.maximum(x[:d], 0) + self.low[:, :d] @ np.minimum(x[:d], 0)


def _bounds_of_pieces(asked: pd.DataFrame, b: pd.DataFrame):
    """The numbers of the pieces, and for each asked query its entry and their bounds."""
    b = b.sort_values("piece")
    extremes = Extremes(b)
    pieces, starts = np.unique(b["piece"].to_numpy(), return_index=True)
    for group in asked["queries"] if len(b) else []:
        for entry in group:
            yield entry, pieces, np.maximum.reduceat(extremes.bounds(np.asarray(entry["terms"], dtype=float)), starts)


def _nearest(asked: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    out = [(e["vec_id"], int(pieces[x.argmax()]), float(x.max())) for e, pieces, x in _bounds_of_pieces(asked, b)]
    return pd.DataFrame(out, columns=["query_id", "piece", "bound"])


def _wanted(asked: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    out = []
    for e, pieces, x in _bounds_of_pieces(asked, b):
        out += [(e["vec_id"], int(p)) for p in pieces[(x >= e["floor"]) & (pieces != e["seed"])]]
    return pd.DataFrame(out, columns=["query_id", "piece"])


def _search(k: int):
    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, extremes = [], Extremes(b)
        pieces = [(np.frombuffer(r.ids, np.int64), np.frombuffer(r.forward).reshape(r.n, r.dim)) for r in b.itertuples()]
        for group in q["queries"] if len(b) else []:
            for entry in group:
                own, x = entry["vec_id"], np.asarray(entry["terms"], dtype=float)
                bounds = extremes.bounds(x)
                best = _exact(x, own, pieces, k) if np.isinf(bounds).any() else best_of(x, own, pieces, bounds, k, entry["floor"])
                out += [(own, s, v) for s, v in best]
        return pd.DataFrame(out, columns=["query_id", "minus", "vec_id"])

    return run


def _exact(query: np.ndarray, own: int, pieces: list[tuple], k: int) -> list[tuple[int, int]]:
    q = [int(v) for v in query]
    scored = ((max(-(1 << 63) + 1, min((1 << 63) - 1, -sum(int(a) * c for a, c in zip(row, q)))), int(i)) for ids, f in pieces for i, row in zip(ids, f) if i != own)
    return sorted(scored)[:k]


FOUND = "query_id long, minus long, vec_id long"


def _together(asked: DataFrame, *keys: str) -> DataFrame:
    """Queries packed by their group and the keys, which repeat for each of them."""
    n = max(1, -(-asked.count() // QUERY_GROUP)) if not keys else None
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int") if n else F.col("part")
    entry = F.struct("vec_id", "terms", "floor", "seed")
    return asked.withColumn("part", part).groupBy("part", *keys).agg(F.sort_array(F.collect_list(entry)).alias("queries"))


def _meet(asked: DataFrame, index: DataFrame, n_pieces: int, run, schema: str) -> DataFrame:
    """Every group of queries with the extremes of every span of pieces, by an equi-join on numbers."""
    spans = max(1, -(-n_pieces // SPAN_PIECES))
    q = _together(asked).select("part", "queries", _numbers(spans).alias("span"))
    parts = max(1, -(-asked.count() // QUERY_GROUP))
    span = F.pmod(F.xxhash64("piece"), F.lit(spans)).cast("int")
    b = index.select("piece", "dim", "low", "high", span.alias("span"), _numbers(parts).alias("part"))
    return q.groupBy("part", "span").cogroup(b.groupBy("part", "span")).applyInPandas(run, schema)


def _score(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each piece that it is asked of: ``asked`` has a row for each of
    both, and meets a piece in groups of queries."""
    # stored, so that the join has a shuffle of its own that can split a piece that all queries want
    groups = stored(asked.groupBy("piece").agg(F.ceil(F.count("*") / QUERY_GROUP).cast("long").alias("groups")))
    part = F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int")
    q = _together(asked.join(groups, "piece").withColumn("part", part), "piece")
    b = index.join(stored(q.select("piece", "part")), "piece")
    return q.groupBy("piece", "part").cogroup(b.groupBy("piece", "part")).applyInPandas(_search(k), FOUND)


def _asked_of(df: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The index, what each query's first piece gave, and the pairs of queries and pieces that are
    to be scored first and after that."""
    rows = stored(vectors(df))
    index, asked = blocks(rows), queries(rows, every).withColumns({"floor": F.lit(float("-inf")), "seed": F.lit(-1).cast("long")})
    asked = stored(asked)
    n_pieces = index.select("piece").distinct().count()
    nearest = _meet(asked, index, n_pieces, _nearest, "query_id long, piece long, bound double")
    best = nearest.groupBy("query_id").agg(F.max(F.struct("bound", F.col("piece").alias("p"))).alias("b"))
    first = stored(asked.join(best, F.col("vec_id") == F.col("query_id")).select("vec_id", "terms", "floor", F.col("b.p").alias("seed"), F.col("b.p").alias("piece")))
    seeded = stored(_score(first, index, k))
    # scores that doubles may not hold give no floor: their queries are asked of every piece
    kth = seeded.groupBy("query_id").agg(F.max("minus").alias("m"), F.count("*").alias("n")).where((F.col("n") >= k) & (F.abs("m") < EXACT))
    floor = F.coalesce(-F.col("m").cast("double"), F.lit(float("-inf")))
    again = stored(first.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "terms", floor.alias("floor"), "seed"))
    wanted = _meet(again, index, n_pieces, _wanted, "query_id long, piece long")
    more = stored(again.join(wanted, F.col("vec_id") == F.col("query_id")).select("vec_id", "terms", "floor", "seed", "piece"))
    return index, seeded, first, more


def top_k(df: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k highest integer inner products.

    A query meets the pieces that its bounds leave over by an equi-join on their numbers; a piece
    yields at most k rows a query, and none below the k-th score of the query's first piece. Missing
    components of shorter vectors count as 0, an empty vector scores 0 everywhere. Rows without an
    id or with an unsound vector take no part; rows that share an id are candidates each, though
    none for that id's query. Without rows, or with a single id, there is no result; extra columns
    are left out."""
    index, seeded, _, more = _asked_of(df, k, every)
    found = seeded.unionByName(_score(more, index, k))
    order = Window.partitionBy("query_id").orderBy("minus", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", (-F.col("minus")).alias("score"))


def pruning(df: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """``queries, pieces, scored, skipped``: how many pairs of a query and a piece of blocks are
    scored, and how many bounds leave out."""
    index, _, first, more = _asked_of(df, k, every)
    asked, pieces = first.count(), index.select("piece").distinct().count()
    scored = asked + more.count()
    counts = {"queries": asked, "pieces": pieces, "scored": scored, "skipped": asked * pieces - scored}
    return df.sparkSession.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in counts.items()])


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS t FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
