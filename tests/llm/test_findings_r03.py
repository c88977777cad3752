"""Findings of round 3 on the training-data operators: each test failed before its change."""

from __future__ import annotations

import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import simhash_pigeonhole, toxicity_cnn


def test_f15_all_labelled_texts_are_fitted_on_in_shards(spark, monkeypatch):
    """No bound on rows; shards that are trained apart and averaged know what only one of them has seen."""
    monkeypatch.setattr(toxicity_cnn, "SHARD", 2_000)
    ids = spark.range(12_000)
    bad = F.when(F.col("id") % 3 == 0, F.element_at(F.array(F.lit("vilest"), F.lit("wretchy")), (F.col("id") % 2 + 1).cast("int"))).otherwise(F.lit("kindly"))
    text = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(50))) for k in range(5)], bad)
    docs = ids.select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), text.alias("text"))
    labels = ids.select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    mine = [i for i in range(12_000) if crc32(str(i).encode()) % 5]
    assert toxicity_cnn.sample(docs, labels, 4).count() == len(mine) > 9_000
    first, again = toxicity_cnn.fit(docs, labels), toxicity_cnn.fit(docs.repartition(7), labels)
    assert np.array_equal(first.network.embed, again.network.embed) and first.thresholds == again.thresholds == {"en": 0.5}
    scorer = toxicity_cnn.Scorer(first.network)
    for word, toxic in (("vilest", True), ("wretchy", True), ("kindly", False)):
        assert (scorer.score(f"w0x1 w1x3 {word} w4x7") >= 0.5) == toxic


def test_f16_all_pairs_within_the_accepted_bits_link(spark, monkeypatch):
    """Also those that no group of bits brings together: of 600 pairs at 41 to 46 bits a few dozen. Chains go over blocks."""
    monkeypatch.setattr(simhash_pigeonhole, "FEW", 500, raising=False)
    rng = random.Random(5)
    fps = [rng.getrandbits(256) for _ in range(1_200)]
    for i in range(600):
        f = fps[rng.randrange(i, len(fps))]
        for b in rng.sample(range(256), rng.randrange(41, 47)):
            f ^= 1 << b
        fps.append(f)
    df = spark.createDataFrame([(i, str(i), bytearray(f.to_bytes(32, "little"))) for i, f in enumerate(fps)], "doc_id long, row_key string, fp binary")
    monkeypatch.setattr(simhash_pigeonhole, "fingerprints", lambda docs, kind: docs)
    got = {r.doc_id: r.component_id for r in simhash_pigeonhole.components(df, simhash_pigeonhole.NEAR_COPIES).collect()}
    raw = np.frombuffer(b"".join(f.to_bytes(32, "little") for f in fps), "<u8").reshape(-1, 4)
    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(raw[:i] ^ raw[i]).sum(axis=1) <= 46):
            a, b = sorted((want[i], want[j]))
            want = [a if w == b else w for w in want]
    assert got == dict(enumerate(want)) and len(set(want)) < 1_250
