"""Brown class-based language model, trained and applied by Spark.

P(w | before) = P(class of w | class of before) * P(w | class of w). Exchange clustering assigns
words to classes: each word in turn goes to the class that raises the likelihood of the training
text's class bigrams most. The most frequent words are exchanged against each other; every other
word of the training text then goes to the class under which its own neighbours' classes are
likeliest, which is the same gain to first order. Words that training never saw take the class that
most of the rare words with their ending have. Counts are of the whole training text.

Texts are coded once, each word by its place in a bounded lookup of the most frequent words; what
follows works on these numbers. Words outside the lookup are rows of a table: their counts and classes
are aggregated and joined by Spark, never held by a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import stored, table, text_or_empty

CLASSES = 64
#: The last class is the end's alone; the one before it holds words until they have a class, and in
#: the end those of which no neighbour has one.
END_CLASS, OPEN_CLASS = CLASSES - 1, CLASSES - 2
#: Words that are exchanged with each other, and endings that unseen words are classed by.
FREQUENT, ENDINGS = 4096, 1024
#: Words that every task knows: the most frequent ones of LOOKUP_BYTES bytes at most, which bounds
#: what is broadcast. All other words' counts and classes come by a join.
LOOKUP, LOOKUP_BYTES = 120_000, 64
#: Passes over all units at most, each in so many turns: what moves in one turn moves at once. They end
#: when a pass adds less than a thousandth of the gain so far.
ROUNDS, TURNS = 3, 8
DELTA = 0.1
#: A task's counts are handed on when it holds this many.
FLUSH = 400_000
#: Texts whose tokens are held as arrays at once, and their bytes or words.
SLICE, SLICE_SIZE = 500, 1 << 22
#: Tokens whose bigrams are sorted at once.
CHUNK = 1 << 22


_LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str) -> list[str]:
    """A-Z lower-cased, split at ASCII white space."""
    found = text.encode().translate(_LOWER).decode().split(" ")
    return [w for w in found if w] if "" in found else found


def held_out() -> Column:
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` of all texts, ends not among them; counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(t.as_py().encode().lower().split())
                if len(seen) > FLUSH:
                    yield _counts(seen)
                    seen = Counter()
        yield _counts(seen)

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


# --- the lookup, and texts as its numbers --------------------------------------------------------


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of the highest counts ``n``, of equal counts those of the smaller words.

    Whole steps of a sixteenth of a power of two are taken, of which there are about a thousand, as
    many as fit, and the room left is filled from the next one by a sorted limit. Tasks thus send
    what is kept and a step, where a limit alone would have each of them send ``most`` rows."""
    step = F.floor(16 * F.log2("n"))
    room, least, next_step = most, None, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.step):
        if r.rows > room:
            next_step = r.step
            break
        room, least = room - r.rows, r.step
    whole = counts.where(step >= least) if least is not None else counts.where("false")
    if next_step is None or not room:
        return whole
    return whole.unionByName(counts.where(step == next_step).orderBy(F.desc("n"), counts.columns[0]).limit(room))


class Places(dict):
    """Word to its place; -1 for all others."""

    def __missing__(self, word: str) -> int:
        return -1


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts in parts of at most SLICE rows and, but for a text that is longer by itself, SLICE_SIZE
    bytes or words: arrays over all their tokens are held several times."""
    for b in batches:
        column = b.column(b.schema.names.index("ids" if "ids" in b.schema.names else "text"))
        size = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
        upto = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_SIZE, side="right"))
            to = max(at + 1, min(fits, at + SLICE))
            yield b.slice(at, to - at)
            at = to


CODED = "row long, doc_id long, held_out boolean, ids array<int>, rare array<string>"


def coded(docs: DataFrame, places: Places) -> DataFrame:
    """A row for each text: the places of its words, and those words that have none, in order."""
    given = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, place = TaskContext.get().partitionId() << 33, given.value.__getitem__
        for b in slices(batches):
            ids, rare = [], []
            for t in b.column(2):
                ws = words(t.as_py())
                at = np.fromiter(map(place, ws), dtype=np.int32, count=len(ws))
                ids.append(at)
                rare.append([ws[i] for i in np.flatnonzero(at < 0).tolist()])
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            arrays = [pa.array(range(row, row + len(ids)), pa.int64()), b.column(0), b.column(1), lists, pa.array(rare, pa.list_(pa.string()))]
            row += len(ids)
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in CODED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text")).mapInArrow(run, CODED)


def sequence(ids: pa.ListArray, n: int) -> np.ndarray:
    """The texts one after another: places, n for the end that stands before, between and after
    them, n + 1 for a word without a place."""
    offsets = ids.offsets.to_numpy().astype(np.int64)
    seq = np.full(offsets[-1] - offsets[0] + len(ids) + 1, n, dtype=np.int64)
    words = np.ones(len(seq), dtype=bool)
    words[offsets - offsets[0] + np.arange(len(offsets))] = False
    seq[words] = ids.flatten().to_numpy()
    seq[seq < 0] = n + 1
    return seq


def _tally(batches: Iterator[pa.RecordBatch], codes) -> Iterator[pa.RecordBatch]:
    """``code, n`` of the numbers that ``codes`` makes of each batch, counted in the task."""
    held, n = [], 0
    for b in slices(batches):
        held.append(codes(b))
        n += len(held[-1])
        if n > CHUNK:
            yield _counted(held)
            held, n = [], 0
    if n:
        yield _counted(held)


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    code, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])


def unit_bigrams(ids: DataFrame, units: np.ndarray, size: int) -> DataFrame:
    """``a, b, n``: how often unit b follows unit a. ``units`` maps places, the end and words without
    a place to units."""
    given, n = ids.sparkSession.sparkContext.broadcast(units), len(units) - 2

    def codes(b: pa.RecordBatch) -> np.ndarray:
        u = given.value[sequence(b.column(0), n)]
        return u[:-1] * size + u[1:]

    rows = ids.mapInArrow(lambda batches: _tally(batches, codes), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return rows.select(F.floor(F.col("code") / size).cast("int").alias("a"), (F.col("code") % size).cast("int").alias("b"), "n")


# --- exchange clustering -----------------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def gains(now: int, before: np.ndarray, after: np.ndarray, self_n: float, table: np.ndarray) -> np.ndarray:
    """Change of the class bigrams' log likelihood if one unit moves from class ``now`` to each
    class. ``before`` and ``after`` count the classes on its left and right, the unit itself not
    among them; ``self_n`` counts it next to itself; ``table`` counts all class bigrams."""
    g = table.astype(float).copy()
    g[:, now] -= before
    g[now] -= after
    g[now, now] -= self_n
    # whatever the unit's class, its neighbours' classes keep their counts before and after it
    rows, cols = g.sum(axis=1) + before, g.sum(axis=0) + after
    right, left = after.sum() + self_n, before.sum() + self_n
    f = _xlogx
    gain = (f(g + after) - f(g)).sum(axis=1) + (f(g + before[:, None]) - f(g)).sum(axis=0)
    d = np.diag(g)
    gain += f(d + before + after + self_n) - f(d + after) - f(d + before) + f(d)
    gain -= f(rows + right) - f(rows) + f(cols + left) - f(cols)
    return gain - gain[now]


def _sides(bigrams: DataFrame) -> DataFrame:
    """A row for each unit with all that its move depends on: each bigram under both of its units
    (itself once). A row has two entries for each unit at most, so its size is bounded by the
    number of units, not by the corpus."""
    left = bigrams.select(F.col("b").alias("unit"), F.struct(F.col("a").alias("other"), F.lit(0).alias("side"), "n").alias("e"))
    right = bigrams.where("a <> b").select(F.col("a").alias("unit"), F.struct(F.col("b").alias("other"), F.lit(1).alias("side"), "n").alias("e"))
    return left.unionByName(right).groupBy("unit").agg(F.collect_list("e").alias("e"))


def class_table(bigrams: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class bigrams: each task sums its rows to k by k numbers."""
    given = bigrams.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * k, dtype=np.int64)
        for b in batches:
            c = given.value
            np.add.at(out, c[b.column(0).to_numpy()] * k + c[b.column(1).to_numpy()], b.column(2).to_numpy())
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["cell", "n"])

    rows = bigrams.select("a", "b", "n").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(k * k, dtype=np.int64)
    for r in rows.collect():
        out[r.cell] = r.n
    return out.reshape(k, k)


def likelihood(counts: np.ndarray) -> float:
    """Of class bigrams: what exchange raises."""
    return float(_xlogx(counts.astype(float)).sum() - _xlogx(counts.sum(axis=0).astype(float)).sum() - _xlogx(counts.sum(axis=1).astype(float)).sum())


def exchange(bigrams: DataFrame, size: int, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """The class of each of ``size`` units, and the likelihood before every turn. Units are numbered by
    frequency; the last one, the end of a text, is alone in the last class, and the one before it, all
    words that aren't exchanged, stays in the class before that. Units start in turn; in every turn the
    tasks move one eighth of them, another each time, to their best classes given those before the
    turn: were all to move at once, they would crowd into the same few classes."""
    classes = np.arange(size, dtype=np.int64) % (k - 2)
    classes[size - 2 :] = k - 2, k - 1
    sides = stored(_sides(bigrams))
    sc = bigrams.sparkSession.sparkContext
    history: list[float] = []
    for n in range(TURNS * rounds):
        counts = class_table(bigrams, classes, k)
        history.append(likelihood(counts))
        if n % TURNS == 0 and n and history[-1] - history[-1 - TURNS] <= 1e-3 * (history[-1] - history[0]):
            break
        given = sc.broadcast((classes, counts))

        def run(batches: Iterator[pa.RecordBatch], turn: int = n % TURNS, given=given) -> Iterator[pa.RecordBatch]:
            c, counts = given.value
            for b in batches:
                moved = []
                entries, at = b.column(1).values, b.column(1).offsets.to_numpy()
                fields = [entries.field(f).to_numpy() for f in ("other", "side", "n")]
                for unit, s, e in zip(b.column(0).to_pylist(), at, at[1:]):
                    if unit < len(c) - 2 and (unit * 2654435761 >> 7) % TURNS == turn:
                        to = _best(unit, *(f[s:e] for f in fields), c, counts, k)
                        if to != c[unit]:
                            moved.append((unit, to))
                i, j = (np.array(x, dtype=np.int64) for x in (zip(*moved) if moved else ([], [])))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], ["unit", "c"])

        classes = classes.copy()
        for r in sides.mapInArrow(run, "unit long, c long").collect():
            classes[r.unit] = r.c
    return classes, history


def _best(unit: int, other: np.ndarray, side: np.ndarray, n: np.ndarray, classes: np.ndarray, counts: np.ndarray, k: int) -> int:
    own, c = other == unit, classes[other]
    before = np.bincount(c[~own & (side == 0)], n[~own & (side == 0)], k)
    after = np.bincount(c[~own & (side == 1)], n[~own & (side == 1)], k)
    gain = gains(int(classes[unit]), before, after, float(n[own].sum()), counts)[: k - 2]
    return int(gain.argmax()) if gain.max() > 1e-6 else int(classes[unit])


# --- classes of all other words ------------------------------------------------------------------


def best_classes(before: np.ndarray, after: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For rows of words with counts of the classes before and after them the class under which these
    are likeliest: sum of log P(class | before), of log P(after | class), and of log P(word | class).
    A word whose neighbours have no class stays in the open class."""
    log_p = np.log(counts + DELTA) - np.log(counts.sum(axis=1, keepdims=True) + DELTA * len(counts))
    size = np.log(counts.sum(axis=0) + 1.0)
    score = before @ log_p + after @ log_p.T - n[:, None] * size
    best = score[:, :OPEN_CLASS].argmax(axis=1)
    return np.where((before + after).sum(axis=1) > 0, best, OPEN_CLASS)


def _context(entries: pa.Array, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of class counts before and after each word, from lists of (class before, class after, n)
    where a class of -1 is none."""
    at, values = entries.offsets.to_numpy(), entries.values
    row = np.repeat(np.arange(len(entries)), np.diff(at))
    first = at[0] if len(at) else 0
    out = []
    for name in (a, b):
        c, n = (values.field(f).to_numpy()[first : first + len(row)] for f in (name, "n"))
        x = np.zeros((len(entries), CLASSES))
        has = (c >= 0) & (c != OPEN_CLASS)
        np.add.at(x, (row[has], c[has]), n[has])
        out.append(x)
    return out[0], out[1]


def classed(contexts: DataFrame, key: str, kind: str, counts: np.ndarray, rows: int = 1) -> DataFrame:
    """``key, n, c, e`` from ``key, before, after, n``, which counts each token in so many rows: every
    word's count, class and contexts, of which it has as many as there are pairs of classes at most."""
    given = contexts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, after = _context(b.column(2), "before", "after")
            c = best_classes(before, after, b.column(1).to_numpy().astype(float), given.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.astype(np.int32)), b.column(2)], [key, "n", "c", "e"])

    entry = "array<struct<before:int,after:int,n:bigint>>"
    words = contexts.groupBy(key, "before", "after").agg(F.sum("n").alias("n"))
    words = words.groupBy(key).agg((F.sum("n") / rows).cast("long").alias("total"), F.collect_list(F.struct("before", "after", "n")).alias("e"))
    return words.mapInArrow(run, f"{key} {kind}, n long, c int, e {entry}")


def place_contexts(ids: DataFrame, classes: np.ndarray) -> DataFrame:
    """``place, before, after, n`` of the words in the lookup that have no class yet: each side of a
    token is counted on its own, with -1 for the other one."""
    given, n = ids.sparkSession.sparkContext.broadcast(classes), len(classes) - 2

    def codes(b: pa.RecordBatch) -> np.ndarray:
        seq = sequence(b.column(0), n)
        c = given.value[seq]
        at = np.flatnonzero((c == OPEN_CLASS) & (seq < n))
        place = 2 * seq[at]
        return np.concatenate([place * CLASSES + c[at - 1], (place + 1) * CLASSES + c[at + 1]])

    rows = ids.mapInArrow(lambda batches: _tally(batches, codes), "code long, n long")
    side, c = F.floor(F.col("code") / CLASSES) % 2, (F.col("code") % CLASSES).cast("int")
    return rows.select(F.floor(F.col("code") / (2 * CLASSES)).cast("int").alias("place"), F.when(side == 0, c).otherwise(-1).alias("before"), F.when(side == 1, c).otherwise(-1).alias("after"), "n")


def class_bigrams(ids: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class bigrams of which both words are in the lookup (or ends)."""
    given, n = ids.sparkSession.sparkContext.broadcast(classes), len(classes) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES**2, dtype=np.int64)
        for b in slices(batches):
            seq = sequence(b.column(0), n)
            c, has = given.value[seq], (seq[:-1] <= n) & (seq[1:] <= n)
            out += np.bincount((c[:-1] * CLASSES + c[1:])[has], minlength=CLASSES**2)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["cell", "n"])

    return _cells(ids.mapInArrow(run, "cell long, n long"))


def _cells(rows: DataFrame) -> np.ndarray:
    out = np.zeros(CLASSES**2, dtype=np.int64)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(CLASSES, CLASSES)


RARE = "row long, held_out boolean, word string, before int, after int, next string"


def rare_tokens(texts: DataFrame, classes: np.ndarray) -> DataFrame:
    """A row for each token outside the lookup: the classes of its neighbours, -1 where these are
    outside too, and in ``next`` the word after it if that is."""
    given, n = texts.sparkSession.sparkContext.broadcast(classes), len(classes) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seq = sequence(b.column(3), n)
            at = np.flatnonzero(seq > n)
            c = np.where(seq > n, -1, given.value[seq]).astype(np.int32)
            lists = b.column(4)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            word = lists.flatten()
            follows = seq[at + 1] > n if len(at) else np.zeros(0, dtype=bool)
            follow = word.take(pa.array(np.arange(1, len(at) + 1).clip(max=max(0, len(at) - 1)), mask=~follows))
            pick = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(2).take(pick), word, pa.array(c[at - 1]), pa.array(c[at + 1]), follow], [x.split()[0] for x in RARE.split(", ")])

    return texts.mapInArrow(run, RARE)


def matched(rare: DataFrame, known: DataFrame, ends: DataFrame) -> DataFrame:
    """Every token outside the lookup with its word's count and class, and the class of a word after it
    that is outside too: ``row, held_out, n, c, before, after, following``, stored. Both sides of each
    join are stored tables, so a word that is frequent and yet too long for the lookup is a key that a
    join can split. Words that training never saw have count 0 and their ending's class."""
    # the stored table of endings has a fixed number of rows at most
    ends, words = F.broadcast(ends), known.select(F.col("word").alias("w"), "n", "c")
    got = rare.join(words, F.col("word") == F.col("w"), "left").join(ends, F.right("word", F.lit(2)) == F.col("ending"), "left")
    own = F.coalesce("c", "ec", F.lit(OPEN_CLASS))
    got = stored(got.select("row", "held_out", F.coalesce("n", F.lit(0)).alias("n"), own.alias("c"), "before", "after", "next"))
    alone = got.where("next is null").drop("next").withColumn("following", F.lit(-1))
    pairs = got.where("next is not null").join(words.select("w", F.col("c").alias("c2")), F.col("next") == F.col("w"), "left").join(ends, F.right("next", F.lit(2)) == F.col("ending"), "left")
    pairs = stored(pairs.select("row", "held_out", "n", "c", "before", "after", F.coalesce("c2", "ec", F.lit(OPEN_CLASS)).alias("following")))
    return alone.unionByName(pairs)


def rare_bigrams(tokens: DataFrame) -> np.ndarray:
    """Counts of class bigrams of which at least one word is outside the lookup, in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES**2, dtype=np.int64)
        for b in batches:
            c, before, after, following = (x.to_numpy().astype(np.int64) for x in b.columns)
            for cells, has in ((before * CLASSES + c, before >= 0), (c * CLASSES + after, after >= 0), (c * CLASSES + following, following >= 0)):
                out += np.bincount(cells[has], minlength=CLASSES**2)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["cell", "n"])

    return _cells(tokens.where("not held_out").select("c", "before", "after", "following").mapInArrow(run, "cell long, n long"))


# --- the model and its scores ------------------------------------------------------------------


@dataclass
class Model:
    """What a task needs to score texts: counts and classes of the words in the lookup, whose places
    are followed by the end's, class bigrams and classes' sizes."""

    log_count: np.ndarray
    classes: np.ndarray
    transition: np.ndarray
    class_norm: np.ndarray
    base_norm: float
    ends: int
    train_tokens: int
    history: list[float] = field(default_factory=list)


@dataclass
class Fitted:
    """The model, the words of its lookup by place, and stored tables: all texts as numbers, tokens
    outside the lookup (as ``matched`` has them), the counts and classes of the words among them
    (``word, n, c``), and endings' classes (``ending, ec``)."""

    model: Model
    listed: list[str]
    texts: DataFrame
    rare: DataFrame
    known: DataFrame
    endings: DataFrame


def fit(docs: DataFrame) -> Fitted:
    """From ``doc_id, text`` rows: the model of those that aren't held out."""
    train = docs.where(~held_out()).select(text_or_empty().alias("text"))
    counts = stored(word_counts(train))
    top = most_frequent(counts.where(F.octet_length("word") <= LOOKUP_BYTES), LOOKUP).toPandas().sort_values(["n", "word"], ascending=[False, True])
    listed, n_listed = top["word"].tolist(), top["n"].to_numpy(dtype=np.int64)
    size, frequent = len(listed), min(FREQUENT, len(listed))
    texts = stored(coded(docs, Places((w, i) for i, w in enumerate(listed))))
    ids = texts.where("not held_out").select("ids")
    n_docs = ids.count()

    units = np.full(size + 2, frequent, dtype=np.int64)
    units[:frequent], units[size] = np.arange(frequent), frequent + 1
    found, history = exchange(stored(unit_bigrams(ids, units, frequent + 2)), frequent + 2)
    classes = found[units]
    classes[size + 1] = OPEN_CLASS
    if size > frequent:
        more = classed(place_contexts(ids, classes), "place", "int", class_bigrams(ids, classes), 2).select("place", "c").toPandas()
        classes[more["place"].to_numpy()] = more["c"].to_numpy()

    rare = stored(rare_tokens(texts, classes))
    pairs = class_bigrams(ids, classes)
    contexts = rare.where("not held_out").select("word", "before", "after", F.lit(1).cast("long").alias("n"))
    known = stored(classed(contexts, "word", "string", pairs).drop("e"))
    ends = endings(known)
    tokens_outside = matched(rare, known, ends)
    pairs = pairs + rare_bigrams(tokens_outside)
    tokens = np.bincount(classes[:size], n_listed, CLASSES) if size else np.zeros(CLASSES)
    kinds = np.bincount(classes[:size], minlength=CLASSES).astype(float)
    for r in known.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        tokens[r.c] += r.n
        kinds[r.c] += r.kinds
    tokens[END_CLASS], kinds[END_CLASS] = n_docs, n_docs > 0
    n, v = int(tokens.sum()), int(kinds.sum())
    transition = np.log10(pairs + DELTA) - np.log10(pairs.sum(axis=1, keepdims=True) + DELTA * CLASSES)
    model = Model(
        np.log10(np.append(n_listed, n_docs) + DELTA), classes, transition, np.log10(tokens + DELTA * (kinds + 1)), math.log10(n + DELTA * (v + 1)), n_docs, n, history,
    )
    return Fitted(model, listed, texts, tokens_outside, known, ends)


def endings(known: DataFrame) -> DataFrame:
    """``ending, ec``: of the most frequent last two characters of words outside the lookup the class
    of most of their tokens; a stored table of ENDINGS rows at most."""
    per = known.groupBy(F.right("word", F.lit(2)).alias("ending"), "c").agg(F.sum("n").alias("n"))
    per = stored(per.groupBy("ending").agg(F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("best")))
    return stored(most_frequent(per.select("ending", "n", (-F.col("best.c")).alias("ec")), ENDINGS).select("ending", "ec"))


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _listed_scores(m: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the words in the lookup and the ends give: counts, emissions, and transitions between them."""
    n = len(m.log_count) - 1
    for b in slices(batches):
        seq, sizes = sequence(b.column(3), n), np.diff(b.column(3).offsets.to_numpy())
        at, row = seq[1:], np.repeat(np.arange(b.num_rows), sizes + 1)  # each text's words and its end
        per = lambda x: np.bincount(row, x, b.num_rows)  # noqa: B023, E731
        has = at <= n
        counts = np.where(has, m.log_count[np.minimum(at, n)], 0.0)
        score = counts - np.where(has, m.class_norm[m.classes[at]], 0.0)
        both = has & (seq[:-1] <= n)
        score += np.where(both, m.transition[m.classes[seq[:-1]], m.classes[at]], 0.0)
        known = per(has).astype(np.int64) - (m.ends == 0)
        columns = [pa.array((sizes + 1).astype(np.int64)), pa.array(known), pa.array(per(counts) - (sizes + 1) * m.base_norm), pa.array(per(score))]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), *columns], [c.split()[0] for c in SCORED.split(", ")])


def _rare_scores(m: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each other token adds: its count, its emission, and the transitions on both of its sides."""
    for b in batches:
        n, c, before, after, following = (b.column(k).to_numpy() for k in range(1, 6))
        counts = np.log10(n + DELTA)
        score = counts - m.class_norm[c] + np.where(before >= 0, m.transition[before, c], 0) + np.where(after >= 0, m.transition[c, after], 0)
        score += np.where(following >= 0, m.transition[c, following], 0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array((n > 0).astype(np.int64)), pa.array(counts), pa.array(score)], ["r", "known", "base_more", "score_more"])


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model is fitted on the rows that aren't held out. Null texts are empty texts: one token, the
    end. A null doc_id hashes as an empty string. Without training rows all counts are 0
    and scores are finite. Repeated rows are scored each; extra columns are left out."""
    fitted = fit(docs)
    model = docs.sparkSession.sparkContext.broadcast(fitted.model)
    own = fitted.texts.select("row", "doc_id", "held_out", "ids").mapInArrow(lambda b: _listed_scores(model.value, b), SCORED)

    outside = fitted.rare.select("row", "n", "c", "before", "after", "following")
    added = outside.mapInArrow(lambda b: _rare_scores(model.value, b), "r long, known long, base_more double, score_more double")
    added = added.groupBy("r").agg(*[F.sum(c).alias(c) for c in ("known", "base_more", "score_more")])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return own.join(added, F.col("row") == F.col("r"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("known")).alias("n_known"),
        F.lit(fitted.model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more")).alias("base_score"),
        (F.col("score") + zero("score_more")).alias("score"),
    )


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
