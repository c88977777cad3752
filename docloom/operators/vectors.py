"""Exact nearest vectors through pivot cells: a query meets only cells that its bounds leave over.

Rows lie in the cell of their nearest pivot, with their distance to it. By the triangle inequality no row of a
cell is nearer to a query than the query's distance to the pivot, less the cell's furthest row, or its
nearest row's less that distance. A query first meets its own cells; what it finds there says which others can still matter.
Pivots come from a bounded sample of rows, which decides how much is left out, never what is found.

Rows are shuffled to their cells once; only queries are copied, to the cells that they visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.store import stored

#: Rows that pivots are fitted on, pivots at most, passes of k-means, rows of a piece, queries scored and queries
#: dealt to their cells at once.
SAMPLE, PIVOTS, PASSES, PIECE, AT_ONCE, SOME = 20_000, 1024, 6, 8192, 512, 64
#: What rounding to six places and floating sums may add to a similarity.
SLACK = 2e-6


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def pivots(rows: DataFrame) -> np.ndarray:
    """k-means over the sample: about the root of the number of rows of them."""
    n = rows.count()
    some = rows.select("unit").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column(0).combine_chunks()
    x = _matrix(some)
    if not len(x):
        return np.zeros((0, 0))
    k = int(min(PIVOTS, len(x), max(1, np.ceil(np.sqrt(n)))))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(PASSES):
        nearest = _distances(x, centres).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


CELLED = "vec_id long, unit array<double>, by string, cell int, off double"
#: A query, what it must reach, and a cell that it visits.
VISIT = "vec_id long, unit array<double>, by string, cell int, first boolean"
SIDES = "by string, cell int, salt int, side int, vec_id long, unit array<double>"


def _celled(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_matrix(b.column(1)), centres)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "unit", "by", "cell", "off"])

    return rows.select("vec_id", "unit", "by").mapInArrow(run, CELLED)


def _visits(asked: DataFrame, cells: DataFrame, centres: np.ndarray, k: int) -> DataFrame:
    """Each query with the cells whose bound reaches its ``floor``. Cells ``first`` are the nearest ones that
    hold more than k rows together; without floors, they are all. A task has the cells of a ``by`` once, ahead of
    its queries."""
    spark = asked.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    none = F.lit(None)
    q = asked.select("by", F.pmod(F.xxhash64("vec_id"), F.lit(tasks)).cast("int").alias("salt"), F.lit(1).alias("side"), "vec_id", "unit", "floor", none.cast(cells.schema["cells"].dataType).alias("cells"))
    c = cells.select("by", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("salt"), F.lit(0).alias("side"), none.cast("long").alias("vec_id"), none.cast("array<double>").alias("unit"), none.cast("double").alias("floor"), "cells")
    sides = q.where("by is not null").unionByName(c).repartition("by", "salt").sortWithinPartitions("by", "salt", "side")
    return sides.mapInArrow(lambda b: _reaching(b, centres, k), VISIT)


def _reaching(batches: Iterator[pa.RecordBatch], centres: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """VISIT, from rows of ``by, salt, side, vec_id, unit, floor, cells`` sorted by the first three."""
    key: tuple | None = None
    cells: list[np.ndarray] = []
    for part in (b.slice(at, SOME) for b in batches for at in range(0, b.num_rows, SOME)):
        asks = part.filter(pc.equal(part.column(2), 1))
        d = _distances(_matrix(asks.column(4)), centres) if asks.num_rows else np.zeros((0, len(centres)))
        floors = asks.column(5).to_pylist()
        i, row, at, first = 0, [], [], []
        for r, (by, salt, side) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)))):
            if side == 0:
                key, given = (by, salt), part.column(6)[r].values
                cells = [given.field(name).to_numpy() for name in ("cell", "n", "low", "high")]
                continue
            if key == (by, salt):
                cell, n, low, high = cells
                far = d[i][cell]
                order = np.lexsort((cell, far))
                before = np.r_[0, np.cumsum(n[order])[:-1]]
                near = np.zeros(len(cell), dtype=bool)
                near[order[before <= k]] = True
                reach = near if floors[i] is None else 1 - np.maximum(0, np.maximum(far - high, low - far)) ** 2 / 2 >= floors[i] - SLACK
                row.append(np.full(int(reach.sum()), i))
                at.append(cell[reach])
                first.append(near[reach])
            i += 1
        if row:
            took = asks.take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([took.column(3), took.column(4), took.column(0), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(first))], ["vec_id", "unit", "by", "cell", "first"])


def _scored(rows: DataFrame, visits: DataFrame, large: DataFrame, k: int, floor: float) -> DataFrame:
    """``query_id, vec_id, similarity``: of each visit the k most similar rows, from ``floor`` on, but the query's own."""
    sides = rows.select("by", "cell", F.lit(0).alias("side"), "vec_id", "unit").unionByName(visits.select("by", "cell", F.lit(1).alias("side"), "vec_id", "unit"))
    sides = sides.join(large, ["by", "cell"], "left")
    salts = F.coalesce("salts", F.lit(1))
    own = F.array(F.pmod(F.xxhash64("vec_id"), salts).cast("int"))
    sides = sides.withColumn("salt", F.explode(F.when(F.col("side") == 0, own).otherwise(F.sequence(F.lit(0), salts - 1))))
    piece = ["by", "cell", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list = []
        index: tuple[np.ndarray, np.ndarray] | None = None
        for b in batches:
            keys = b.select(["by", "cell", "salt", "side"]).to_pandas()
            change = (keys != keys.shift()).any(axis=1).to_numpy()
            starts = np.r_[np.flatnonzero(change), len(keys)] if len(keys) else np.zeros(1, dtype=int)
            for a, z in zip(starts[:-1], starts[1:]):
                by, cell, salt, side = keys.iloc[a]
                part = b.slice(a, z - a)
                ids, x = part.column(4).to_numpy(), _matrix(part.column(5))
                if key != (by, cell, salt):
                    key, held, index = (by, cell, salt), [], None
                if side == 0:
                    held.append((ids, x))
                elif held:
                    if index is None:
                        index = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    for at in range(0, len(ids), AT_ONCE):
                        yield from _best(ids[at : at + AT_ONCE], x[at : at + AT_ONCE], *index, k, floor)

    sides = sides.select(*[c.split()[0] for c in SIDES.split(", ")]).repartition(*piece).sortWithinPartitions(*piece, "side")
    return sides.mapInArrow(run, "query_id long, vec_id long, similarity double")


def _best(own: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, floor: float) -> Iterator[pa.RecordBatch]:
    found = []
    for q, row in zip(own, np.round(x @ rows.T, 6)):
        keep = np.flatnonzero((row >= floor) & (ids != q))
        best = keep[np.lexsort((ids[keep], -row[keep]))[:k]]
        found.append((np.full(len(best), q), ids[best], row[best]))
    columns = [np.concatenate([f[i] for f in found]) for i in range(3)]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "similarity"])


def nearest(rows: DataFrame, asked: DataFrame, k: int, floor: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is found, the visits, and the cells: ``rows`` and ``asked`` have ``vec_id, unit, by``; a query meets
    only rows of its own ``by`` (none where that is null), and may ask once for each that it sees. Units have
    one length each."""
    spark = rows.sparkSession
    rows = rows.where("by is not null")
    centres = pivots(rows)
    if not len(centres):
        none = spark.createDataFrame([], "query_id long, vec_id long, similarity double")
        return none, spark.createDataFrame([], VISIT), spark.createDataFrame([], "by string, cell int, n long")
    rows = stored(_celled(rows, centres))
    sizes = stored(rows.groupBy("by", "cell").agg(F.count("*").alias("n"), F.min("off").alias("low"), F.max("off").alias("high")))
    cells = sizes.groupBy("by").agg(F.collect_list(F.struct("cell", "n", "low", "high")).alias("cells"))
    large = stored(sizes.where(F.col("n") > PIECE).select("by", "cell", F.ceil(F.col("n") / PIECE).cast("int").alias("salts")))
    first = stored(_visits(asked.withColumn("floor", F.lit(None).cast("double")), cells, centres, k))
    seen = stored(_scored(rows, first, large, k, floor))
    kth = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    kth = seen.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("similarity").alias("reached"))
    again = asked.join(kth, "vec_id", "left").withColumn("floor", F.greatest(F.lit(floor), F.coalesce("reached", F.lit(floor))))
    more = stored(_visits(again, cells, centres, k).where("not first"))
    found = seen.unionByName(_scored(rows, more, large, k, floor))
    return found, first.unionByName(more), sizes


def scored_share(rows: DataFrame, asked: DataFrame, k: int, floor: float) -> float:
    """The share of all pairs of a query and a row of its ``by`` that are scored."""
    _, visits, sizes = nearest(rows, asked, k, floor)
    scored = visits.join(sizes, ["by", "cell"]).agg(F.sum("n")).first()[0] or 0
    every = asked.groupBy("by").agg(F.count("*").alias("q")).join(sizes.groupBy("by").agg(F.sum("n").alias("n")), "by").agg(F.sum(F.col("q") * F.col("n"))).first()[0]
    return scored / every if every else 0.0
