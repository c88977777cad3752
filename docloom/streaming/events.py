"""Event logs as streams: counters, windows, sessions and first sights, with late rows handled.

Each query is drained to Parquet through ``foreachBatch``; a key that is updated in several
batches keeps its last state. Checkpoints are in the shared folder.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docloom.functions import text as T
from docloom.operators import retrieval as R
from docloom.operators.store import shared

WATERMARK = "10 minutes"
SESSION_GAP = "30 minutes"


def events(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files: the file source takes a
    single file only as a pattern. ``files_a_batch`` bounds what one batch takes in."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else source
    return source.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Runs the stream over all that is there now; the last state of each key."""
    spark = stream.sparkSession
    folder = shared(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").schema(StructType([*stream.schema, StructField("__batch", IntegerType())])).parquet(f"{folder}/out")
    return R.first_of(out, keys, F.desc("__batch")).drop("__batch")


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which typed state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def counters(stream: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """Running counts by type and latency bucket."""
    return stream.groupBy("event_type", T.bucket(F.col("value"), bounds).alias("bucket")).agg(F.count("*").alias("n"))


def windows(stream: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by type in tumbling or sliding windows; rows later than the watermark are left."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", WATERMARK).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", "total")


def closed_sessions(stream: DataFrame) -> DataFrame:
    """Sessions of each user that the watermark has passed."""
    out = stream.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", SESSION_GAP).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def first_sights(stream: DataFrame) -> DataFrame:
    """Pairs of user and type, each once within the watermark's reach."""
    return stream.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
