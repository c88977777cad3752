"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of characters other than these six; lines end at "\n".
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One of fewer files than there are cores is dealt out first, so that a single
    file does not run on one core. No operator's rows depend on it but for op2's sequences and
    op3's archives, which are those of a partition; a table of many files is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder, not yet made, under ``spark.checkpoint.dir``.

    Where that is unset a local master gets a temporary folder; on a cluster it must be set,
    as a machine-local folder would not be seen by the other executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + _local_folder()
    path = f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"
    for made in _open_scratches:
        made.append(path)
    return path


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    """One for each driver process, for a local master without a shared folder."""
    return tempfile.mkdtemp(prefix="docloom-")


_open_scratches: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Lists the shared folders that are made inside; what is still listed at the end is deleted.
    Take a folder off the list to keep it."""
    made: list[str] = []
    _open_scratches.append(made)
    try:
        yield made
    finally:
        _open_scratches.remove(made)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and reread: it cuts the lineage, survives
    lost executors, and gives the optimizer true sizes."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    return spark.read.schema(schema).parquet(path)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose worker gives freed memory back to the system at the end of a task: workers
    live on beside those of the next stage."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return freed


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def _by_range(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` sorted by range over all partitions and stored, with the number of each row's partition:
    no group is brought into one task. The order must be total enough that a group can be split."""
    placed = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__part", F.spark_partition_id())
    return stored(placed.withColumn("__row", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)))


def _with_offsets(placed: DataFrame, group: list[str], offsets: DataFrame) -> DataFrame:
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return placed.join(offsets, same).drop("__p", *[f"__g{i}" for i in range(len(group))])


def _named(group: list[str]) -> list[Column]:
    return [F.col(g).alias(f"__g{i}") for i, g in enumerate(group)] + [F.col("__part").alias("__p")]


def _before(group: list[str]) -> WindowSpec:
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str = "slot") -> DataFrame:
    """Adds ``out``: gapless numbers from 0 within each group, in the given order.

    Each range of the sorted rows counts its own rows of each group, and the running totals of
    these counts (a row for each range and group in it) give the offsets. The sorted rows are
    stored, so the numbers hold."""
    placed = _by_range(df, group, order)
    counts = placed.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    offsets = counts.select(*_named(group), (F.coalesce(F.sum("__n").over(_before(group)), F.lit(0)) - F.col("__first")).alias("__shift"))
    return _with_offsets(placed, group, offsets).withColumn(out, F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds for each column of ``sums`` the sum of all rows of the group that come before, under the
    name it maps to. Ranges of the sorted rows are summed each on its own, as in ``numbered``."""
    placed = _by_range(df, group, order)
    totals = placed.groupBy(*group, "__part").agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(sums)])
    offsets = totals.select(*_named(group), *[F.coalesce(F.sum(f"__s{i}").over(_before(group)), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    inside = Window.partitionBy("__part", *group).orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    out = _with_offsets(placed, group, offsets)
    out = out.withColumns({name: F.col(f"__b{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for i, (c, name) in enumerate(sums.items())})
    return out.drop("__part", "__row", *[f"__b{i}" for i in range(len(sums))])
