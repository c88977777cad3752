"""Hard negatives by Kronecker-packed products.

Rows lie in blocks. A block's candidates are biased to be non-negative and several of them are packed
into separated fields of one wide integer for each component, so that one multiplication by an
anchor's component advances all of their inner products; the fields are then unpacked and the bias
taken off, which gives exact scores. Wide integers of up to 53 bits are held in doubles, where products
and sums of integers are exact and a matrix product does the multiplications; vectors whose products need
more are packed into Python's integers of any width.

Two passes over the blocks: the first finds each anchor's positives, the second the negatives below each of them.
Anchors in groups meet spans of blocks by an equi-join on their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import stored, table

POSITIVES, NEGATIVES, EVERY = 5, 3, 50
#: A negative scores from LOW to HIGH hundredths of the positive.
LOW, HIGH = 50, 95
SCALE = 256.0
BLOCK_ROWS = 2048
#: Anchors that go together, blocks that meet a group at once, and anchors scored at once.
ANCHOR_GROUP, SPAN_BLOCKS, ANCHORS_AT_ONCE = 4096, 16, 128
#: Integers that a double holds exactly, and fields of a wider integer.
EXACT_BITS, WIDE_FIELDS = 53, 64
LONG = (1 << 63) - 1
BLOCKS = "block long, n int, dim int, ids binary, labels binary, forward binary"


def terms(embedding: str = "embedding") -> Column:
    """floor(256 * x) of every component as double; null where a component is null, infinite or not
    a number, or there is no vector."""
    x = F.col(embedding).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    floor = lambda v: F.when(F.abs(v * SCALE) < 2.0**62, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE)
    return F.when(x.isNotNull() & ~bad, F.transform(x, floor))


def vectors(df: DataFrame) -> DataFrame:
    """``vec_id, label, terms`` of the rows that take part, labels of every seventh id shifted by one."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), terms().alias("terms"))
    return rows.where("vec_id is not null and label is not null and terms is not null")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of terms, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of a range of ids each, stored: ids, labels and terms of their rows. Every row is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                x = _matrix(part.column(2), int(np.diff(part.column(2).offsets.to_numpy()).max(initial=0)))
                values = (number, *x.shape, part.column(0).to_numpy().tobytes(), part.column(1).to_numpy().tobytes(), x.tobytes())
                number += 1
                types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in BLOCKS.split(", ")])

    return stored(rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(run, BLOCKS))


def anchors(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """One anchor for each id that ``every`` divides (of repeated ids the smallest vector and label)."""
    first = F.min(F.struct("terms", "label")).alias("a")
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(first).select("vec_id", "a.label", "a.terms")


class Packed:
    """Candidates (rows of integer terms) packed for anchors whose terms lie within ``peak``."""

    def __init__(self, candidates: np.ndarray, peak: float):
        n, dims = candidates.shape
        own = float(np.abs(candidates).max(initial=0))
        self.a, self.c, self.n, self.dims = int(peak), int(own), n, dims
        # a field holds the largest sum of products of biased terms
        self.bits = max(1, (max(1, dims) * 2 * self.a * 2 * self.c).bit_length())
        self.fields = min(EXACT_BITS // self.bits, 8)
        if self.fields:
            self.of, kind = np.float64, np.float64
            candidates = candidates + self.c
        else:
            self.of, self.fields, kind = object, WIDE_FIELDS, object
            candidates = candidates.astype(object)
            candidates = np.array([[int(v) + self.c for v in row] for row in candidates], dtype=object).reshape(n, dims)
        self.total = candidates.sum(axis=1) if dims else np.zeros(n, dtype=kind)
        groups = -(-n // self.fields) if n else 0
        padded = np.zeros((groups * self.fields, dims), dtype=kind)
        padded[:n] = candidates
        shift = [self.of(1 << self.bits * f) if self.of is np.float64 else 1 << self.bits * f for f in range(self.fields)]
        fields = padded.reshape(groups, self.fields, dims)
        self.packed = sum((fields[:, f] * shift[f] for f in range(self.fields)), np.zeros((groups, dims), dtype=kind))

    def scores(self, asked: np.ndarray) -> np.ndarray:
        """Exact inner products, a row for each anchor: int64, or Python's integers where wide."""
        wide = self.of is object
        x = np.zeros((len(asked), self.dims), dtype=self.of)
        d = min(self.dims, asked.shape[1])
        x[:, :d] = np.array([[int(v) for v in row[:d]] for row in asked], dtype=object).reshape(len(asked), d) if wide else asked[:, :d]
        x = x + self.a
        product = x @ self.packed.T if self.dims else np.zeros((len(asked), len(self.packed)), dtype=self.of)
        product = product if wide else product.astype(np.int64)
        mask = (1 << self.bits) - 1
        out = np.stack([(product >> self.bits * f) & mask for f in range(self.fields)], axis=2).reshape(len(asked), -1)[:, : self.n]
        # sum (q+a)(c+b) = sum qc + b sum(q+a) + a sum(c+b) - dims a b
        whole = (lambda v: v) if wide else (lambda v: v.astype(np.int64))
        out = out - self.c * whole(x.sum(axis=1))[:, None] - self.a * whole(self.total)[None, :] + self.dims * self.a * self.c
        return np.clip(out, -LONG - 1, LONG) if wide else out


def _together(asked: DataFrame, *more: str) -> DataFrame:
    """Anchors packed by their group."""
    groups = max(1, -(-asked.count() // ANCHOR_GROUP))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    return asked.groupBy(part.alias("part")).agg(F.collect_list(F.struct("vec_id", "label", "terms", *more)).alias("asked"))


def _scored(asked: DataFrame, index: DataFrame, choose, schema: str, *more: str) -> DataFrame:
    """What ``choose`` takes of each anchor's scores in each block: groups of anchors meet spans of blocks."""
    groups, n_blocks = max(1, -(-asked.count() // ANCHOR_GROUP)), index.count()
    spans = max(1, -(-n_blocks // SPAN_BLOCKS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = _together(asked, *more).select("part", "asked", each(spans).alias("span"))
    b = index.withColumn("span", F.pmod(F.xxhash64("block"), F.lit(spans)).cast("int")).withColumn("part", each(groups))

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        entries = [e for group in q["asked"] for e in group] if len(b) else []
        dims = max((len(e["terms"]) for e in entries), default=0)
        x = np.zeros((len(entries), dims))
        for i, e in enumerate(entries):
            x[i, : len(e["terms"])] = e["terms"]
        for r in b.itertuples() if entries else []:
            packed = Packed(np.frombuffer(r.forward).reshape(r.n, r.dim), float(np.abs(x).max(initial=0)))
            ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
            for at in range(0, len(entries), ANCHORS_AT_ONCE):
                for e, s in zip(entries[at : at + ANCHORS_AT_ONCE], packed.scores(x[at : at + ANCHORS_AT_ONCE])):
                    out += choose(e, ids, labels, s)
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return q.groupBy("part", "span").cogroup(b.groupBy("part", "span")).applyInPandas(run, schema)


def first(k: int, ids: np.ndarray, scores: np.ndarray, take: np.ndarray) -> list[tuple[int, int]]:
    """The k first (-score, id) of the rows that ``take`` marks, higher scores first, ties to smaller ids."""
    at = np.flatnonzero(take)
    if len(at) > 4 * k and scores.dtype != object:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    return sorted((-int(scores[i]), int(ids[i])) for i in at)[:k]


def _positives(k: int):
    def choose(e, ids, labels, scores):
        take = (labels == e["label"]) & (ids != e["vec_id"])
        return [(e["vec_id"], -s, v) for s, v in first(k, ids, scores, take)]

    return choose


def _negatives(k: int, low: int, high: int):
    """The k first within the bounds of each positive score."""

    def choose(e, ids, labels, scores):
        out, other = [], labels != e["label"]
        for p in sorted({int(p) for p in e["positives"]}):
            floor, top = -(-low * p // 100), high * p // 100
            if floor <= top:
                take = other & (scores >= floor) & (scores <= top)
                out += [(e["vec_id"], p, -s, v) for s, v in first(k, ids, scores, take)]
        return out

    return choose


def hard_negatives(df: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vec_id,
    embedding, label``.

    Scores are exact; one that a long can't hold counts as the largest or smallest long. Missing
    components of shorter vectors count as 0. Rows without an id or a label, or with an unsound vector, take
    no part. Rows that share an id are candidates each, though none for that id's anchor, which is
    the smallest of them. Ties go to smaller ids; a positive whose score is negative has no
    negatives, as no number lies in its bounds. Without rows, or without rows of another label,
    there is no result; extra columns are left out."""
    rows = stored(vectors(df))
    index, asked = blocks(rows), stored(anchors(rows, every))
    found = _scored(asked, index, _positives(positives), "anchor_id long, positive_score long, positive_id long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = stored(found.withColumn("place", place).where(F.col("place") <= positives).drop("place"))
    wanted = chosen.groupBy(F.col("anchor_id").alias("a")).agg(F.collect_set("positive_score").alias("positives"))
    again = stored(asked.join(wanted, F.col("vec_id") == F.col("a")).drop("a"))
    below = _scored(again, index, _negatives(negatives, low, high), "a long, p long, negative_score long, negative_id long", "positives")
    rank = F.row_number().over(Window.partitionBy("a", "p").orderBy(F.desc("negative_score"), "negative_id"))
    below = below.withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = chosen.join(below, (F.col("anchor_id") == F.col("a")) & (F.col("positive_score") == F.col("p")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS t FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_sum(list_transform(list_zip(a.t, c.t), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
