"""Nearest vectors through pivot cells: the rows of brute force, from fewer pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval, vectors


def units(n, dims, centres, spread, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    x = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))
    x[n // 2] = x[n // 3]  # ties
    return x / np.linalg.norm(x, axis=1)[:, None]


def brute(rows, asked, k, floor):
    out = []
    for q in {q for q, _, _ in asked}:
        seen = [(-round(float(np.dot(u, r)), 6), i) for i_q, u, by in asked if i_q == q for i, r, b in rows if b == by and b is not None and i != q]
        out += [(q, i, -s) for s, i in sorted(x for x in seen if -x[0] >= floor)[:k]]
    return sorted(out)


@pytest.mark.parametrize("piece", [8192, 25])
def test_pivot_cells_match_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(vectors, "PIECE", piece)
    rng = random.Random(1)
    x = units(900, 12, 9, 0.15, 3)
    # a third of the rows in one group
    rows = [(i, u.tolist(), rng.choice(("a", "a", "b", "c", None))) for i, u in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, unit array<double>, by string").repartition(3)
    asked = [(i, u, by) for i, u, own in rows if i % 10 == 0 for by in {"a", own}]
    q = spark.createDataFrame(asked, df.schema)
    got = sorted((r.query_id, r.vec_id, r.similarity) for r in retrieval.top_vectors(df, 10, 7, 0.3, asked=q).collect())
    want = brute(rows, asked, 7, 0.3)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_most_pairs_are_left_out(spark):
    x = units(4000, 16, 40, 0.05, 5)
    df = spark.createDataFrame([(i, u.tolist(), "") for i, u in enumerate(x)], "vec_id long, unit array<double>, by string")
    share = vectors.scored_share(df, df.where("vec_id % 50 = 0"), 10, 0.25)
    assert 0 < share < 0.15


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, unit array<double>")
    assert [(r.query_id, r.vec_id, r.rank) for r in retrieval.top_vectors(df, 2, 5).orderBy("query_id").collect()] == [(0, 2, 1), (2, 0, 1)]
    assert retrieval.top_vectors(df.limit(0), 2, 5).count() == 0
    assert retrieval.top_vectors(df.where("vec_id = 1"), 1, 5).count() == 0
    assert vectors.nearest(df.withColumn("by", F.lit(None).cast("string")), df.withColumn("by", F.lit("x")), 3, 0.0)[0].count() == 0
