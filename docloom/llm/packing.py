"""Sum-of-squares online packing of documents into training windows.

Every partition packs its own documents. What it leaves in partially filled windows goes on to a
packer for a group of neighbouring partitions, which places it by the same rule, and so on until one
group is left. Only what that last one leaves, as many windows as one packer holds open whatever the
input's size, is cut up to fill windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import stored, table, text_or_empty
from docloom.llm.word_ids import word_ids

CAPACITY = 2048
#: Groups of windows that are merged by one packer.
FAN = 32
END = np.array([1], dtype="<u4").tobytes()
SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, filled_by string, part long"
#: Who has filled a window: one long document alone, the rule, or the cutting of the last rest.
DOCUMENT, RULE, REST = "document", "rule", "rest"
ROWS_A_BATCH = 2_000


class SumOfSquares:
    """Open windows by fill level. ``count[h]`` is the number of windows filled to ``h``; an item
    goes where the sum of squared counts comes out smallest, full windows not counted."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity)]

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) for an item of 1 to capacity - 1 tokens; of equal
        sums the fullest level wins."""
        c, n = self.capacity, self.count
        best, level = 2 * n[size] + 1, 0
        if c - size > 1:
            change = np.where(n[1 : c - size] > 0, 2 * (n[size + 1 : c] - n[1 : c - size]) + 2, np.iinfo(np.int64).max)
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                best, level = change[k], k + 1
        if n[c - size] > 0 and 1 - 2 * n[c - size] <= best:
            level = c - size
        return level

    def place(self, pieces: list, size: int) -> list | None:
        """Puts the pieces, together, into a window; returns its pieces if that has filled it."""
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        window.extend(pieces)
        self.count[level] -= level > 0
        if level + size == self.capacity:
            return window
        self.count[level + size] += 1
        self.open[level + size].append(window)
        return None

    def rest(self) -> Iterator[list]:
        """All open windows, fullest first."""
        for windows in reversed(self.open):
            yield from windows


def cut(pieces: Iterator[tuple], capacity: int) -> Iterator[list]:
    """Cuts pieces one after another into full windows; what is left at the end into windows of
    falling powers of two, which need no padding."""
    window, room = [], capacity
    for doc, start, ids, total in pieces:
        while ids:
            head, ids = ids[: 4 * room], ids[4 * room :]
            window.append((doc, start, head, total))
            start, room = start + len(head) // 4, room - len(head) // 4
            if not room:
                yield window
                window, room = [], capacity
    left = capacity - room
    while left:
        take = 1 << (left.bit_length() - 1)
        out, need = [], take
        while need:
            doc, start, ids, total = window.pop(0)
            head, tail = ids[: 4 * need], ids[4 * need :]
            out.append((doc, start, head, total))
            need -= len(head) // 4
            if tail:
                window.insert(0, (doc, start + len(head) // 4, tail, total))
        left -= take
        yield out


def windows(docs: Iterator[tuple], encode, capacity: int) -> Iterator[tuple[str | None, list]]:
    """(who filled it, pieces) for each window of (document, text) pairs; nobody (None) has filled
    those that come last, the open ones. A document's full windows are cut off first."""
    packer = SumOfSquares(capacity)
    for doc, text in docs:
        ids = encode(text) + END
        total = len(ids) // 4
        whole = total - total % capacity
        for start in range(0, whole, capacity):
            yield DOCUMENT, [(doc, start, ids[4 * start : 4 * (start + capacity)], total)]
        if total > whole and (full := packer.place([(doc, whole, ids[4 * whole :], total)], total - whole)):
            yield RULE, full
    for window in packer.rest():
        yield None, window


def merged(held: list[list], capacity: int, last: bool) -> Iterator[tuple[str | None, list]]:
    """As ``windows``, from the pieces of open windows, which are placed one by one again: windows
    that are over half full would not fit each other. The last packer cuts up its rest."""
    packer = SumOfSquares(capacity)
    for window in held:
        for piece in window:
            if full := packer.place([piece], len(piece[2]) // 4):
                yield RULE, full
    if last:
        for window in cut((p for w in packer.rest() for p in w), capacity):
            yield REST, window
    else:
        for window in packer.rest():
            yield None, window


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of ``doc_id, text`` rows: a row for each run of a document's ids in one window, with
    the ids themselves (little-endian unsigned 32-bit; null unless ``with_ids``) and their CRC-32.

    The rows that a pass has finished are stored and never move; only open windows are shuffled,
    a few hundred for each partition, so every later pass is smaller by the factor FAN. A null or
    empty text is the end id alone; a null doc_id stays null; repeated rows are documents of their
    own; an empty table gives no rows; extra columns are left out. Sequence ids are unique: the
    pass, the partition or group, and a number within it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pairs = ((d.as_py(), t.as_py()) for b in batches for d, t in zip(b.column(0), b.column(1)))
        yield from _batches(windows(pairs, word_ids(tokenizer).encode, capacity), 0, part, with_ids)

    def later(number: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ("part", "sequence_id", "doc_id", "start", "ids", "doc_tokens")
            given = (r for b in batches for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names)))
            for part, mine in groupby(given, key=lambda r: r[0]):
                held = [[r[2:] for r in window] for _, window in groupby(mine, key=lambda r: r[1])]
                yield from _batches(merged(held, capacity, last), number, part, with_ids)

        return run

    now, number, out = stored(rows.mapInArrow(first, SCHEMA)), 0, []
    while True:
        out.append(now.where("filled_by is not null"))
        rest = now.where("filled_by is null").withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        most = rest.agg(F.max("part")).first()[0]
        if most is None:
            break
        number += 1
        order = ["part", "sequence_id", "offset"]
        now = stored(rest.repartition("part").sortWithinPartitions(*order).mapInArrow(later(number, most == 0), SCHEMA))
    pieces = out[0]
    for more in out[1:]:
        pieces = pieces.unionByName(more)
    return pieces.drop("part")


def _batches(found: Iterator[tuple[str | None, list]], number: int, part: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA; open windows keep their ids for the next pass."""
    out: list[tuple] = []
    for k, (by, window) in enumerate(found):
        sequence, at = number << 56 | part << 32 | k, 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            out.append((doc, start, n, ids if with_ids or by is None else None, crc32(ids), total, sequence, at, by, part))
            at += n
        if len(out) >= ROWS_A_BATCH:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in SCHEMA.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def filled(pieces: DataFrame) -> DataFrame:
    """``filled_by, windows, tokens``: how many windows a document alone, the rule and the cutting
    of the last rest have filled."""
    return pieces.groupBy("filled_by").agg(F.countDistinct("sequence_id").alias("windows"), F.sum("length").alias("tokens"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"), sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents, with their ids' checksums."""
    return pack(docs.select("doc_id", "text"), _tokenizer(), with_ids=False).drop("ids")
