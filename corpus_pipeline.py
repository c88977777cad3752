"""The corpus pipeline: five stages of ``docloom.llm`` over ``documents``.

Each stage reads what the one before has kept, written as Parquet to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import mixing, packing, quality_ledger, simhash_pigeonhole, toxicity_cnn
from docloom.llm.common import scratch, stored

STAGES = (
    ("quality rules", quality_ledger.accepted),
    ("toxicity", toxicity_cnn.not_toxic),
    ("near-duplicates", simhash_pigeonhole.one_of_each),
    ("mixing", mixing.mixed),
    ("packing", packing.packed),
)

#: Trained scores, fingerprints, hashed draws and token ids have no SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs, as ``packing.pack`` describes them.

    A null text is an empty one, which the quality rules reject; an empty table gives no rows; rows
    that repeat are near-duplicates of each other; columns of any name pass through all stages but
    the last. What a stage has stored is deleted when the next one has read it: nothing but what
    the result is read from stays behind."""
    docs, had = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark) as made:
            made += had
            docs = stored(stage(spark, docs, sf_dir))
            had = [made.pop()]
    return STAGES[-1][1](spark, docs, sf_dir)
