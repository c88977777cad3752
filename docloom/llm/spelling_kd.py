"""Spelling variants found by k-d trees over letter-count vectors.

A word is a point: how often it has each letter. One edit moves that point little: a replaced letter takes
one from one count and gives one to another (an L1 distance of two), an inserted one gives one. So for
each pair of lengths, equal or one apart, range searches over the points prune whole boxes of a tree, and only
what they leave is compared letter by letter.

The upper part of each length's tree deals its words out to cells; a word goes to those cells alone whose
boxes its range reaches. Within a cell, in a task of its own, the lower part is built and searched by many words at
once. The upper splits come from a bounded sample of words, which decides how even cells are,
never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import stored, table

SHORTEST, SEEN, TIMES = 6, 5, 5
#: Every how many-th hash deletes a letter.
DELETES = 199
#: The letters, À to ÿ after a to z (A to Z are lower-cased).
RUNS = rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"
LETTERS = 26 + 64
#: Words aimed at in a cell and most in a piece of it, words of a leaf, words that the upper splits are fitted on, and searches and pairs at once.
CELL_WORDS, PIECE_WORDS, LEAF_WORDS, SAMPLE, AT_ONCE, PAIRS = 8192, 32768, 96, 100_000, 4096, 1 << 21
#: Rounds of doubling that reach the end of any chain: each form has five times the occurrences of the last.
DOUBLINGS = 6


def words(docs: DataFrame) -> DataFrame:
    """``word, n``: maximal runs of letters in whole texts, now and then with a letter deleted, that have
    at least six letters and five occurrences. Runs of fewer letters can't become words."""
    text = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = F.pmod(h, F.length("run")).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    found = found.withColumns({"h": h, "at": at}).select(F.when(F.col("h") % DELETES == 0, shorter).otherwise(F.col("run")).alias("word"))
    return found.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)


def codes(words: list[str], length: int) -> np.ndarray:
    """Numbers of the letters, a row for each word; their order is that of the code points."""
    raw = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), length)
    return np.where(raw < 128, raw - 97, raw - (192 - 26)).astype(np.uint8)


def counts(codes: np.ndarray) -> np.ndarray:
    """The letter-count vectors of words of one length."""
    n, length = codes.shape
    kind = np.int16 if length < 1 << 15 else np.int64
    out = np.zeros((n, LETTERS), dtype=kind)
    if length <= 64:
        rows = np.arange(n)
        for i in range(length):
            out[rows, codes[:, i]] += 1
    else:
        for i in range(n):
            out[i] = np.bincount(codes[i], minlength=LETTERS)
    return out


class Tree:
    """A k-d tree whose nodes are boxes: ``low`` and ``high`` counts of each letter, and where a search goes on.

    ``tight`` boxes are those of the points; others are what the splits alone leave, which hold for
    points that the tree was not built from."""

    def __init__(self, points: np.ndarray, most: int, tight: bool):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.splits: list[tuple[int, int] | None] = []
        self.leaves: dict[int, np.ndarray] = {}
        open_ends = np.full(LETTERS, -1, dtype=np.int64), np.full(LETTERS, np.iinfo(np.int32).max, dtype=np.int64)
        todo = [(self._add(*open_ends), np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            mine = points[rows]
            if tight and len(rows):
                self.low[node], self.high[node] = mine.min(axis=0), mine.max(axis=0)
            split = _split(mine) if len(rows) > most else None
            if split is None:
                self.leaves[node] = rows
                continue
            letter, at = self.splits[node] = split
            left, right = self.high[node].copy(), self.low[node].copy()
            left[letter], right[letter] = at, at + 1
            pair = self._add(self.low[node], left), self._add(right, self.high[node])
            self.children[node] = pair
            below = mine[:, letter] <= at
            todo += [(pair[0], rows[below]), (pair[1], rows[~below])]
        self.number = {node: i for i, node in enumerate(sorted(self.leaves))}

    def _add(self, low: np.ndarray, high: np.ndarray) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.splits.append(None)
        return len(self.low) - 1

    def search(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf that some points reach, with the rows of these: where ``up`` more and ``down`` fewer
        letters lead into its box."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            mine = points[rows]
            more = np.maximum(self.low[node] - mine, 0).sum(axis=1)
            fewer = np.maximum(mine - self.high[node], 0).sum(axis=1)
            rows = rows[(more <= up) & (fewer <= down)]
            if len(rows):
                if self.children[node] is None:
                    yield node, rows
                else:
                    todo += [(c, rows) for c in self.children[node]]

    def cell(self, points: np.ndarray) -> np.ndarray:
        """The number of the leaf that each point lies in."""
        out, todo = np.zeros(len(points), dtype=np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                out[rows] = self.number[node]
            elif len(rows):
                letter, at = self.splits[node]
                below = points[rows, letter] <= at
                todo += list(zip(self.children[node], (rows[below], rows[~below])))
        return out


def _split(points: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that part the points most evenly, None if they are all the same point."""
    spread = points.astype(np.float32).var(axis=0)
    best = None
    for letter in np.argsort(-spread, kind="stable")[:4]:
        if spread[letter] > 0:
            tally = np.bincount(points[:, letter])
            below = np.cumsum(tally)[:-1]
            at = int(np.abs(below - len(points) / 2).argmin())
            lopsided = abs(int(below[at]) - len(points) / 2)
            if 0 < below[at] < len(points) and (best is None or lopsided < best[0]):
                best = lopsided, int(letter), at
    return best and best[1:]


def fitted(found: DataFrame, total: int) -> dict[int, Tree]:
    """The upper trees by length, from at most about SAMPLE words chosen by hash. A length that the
    sample lacks is one cell."""
    rate = min(1.0, SAMPLE / max(1, total))
    chosen = found if rate == 1.0 else found.where(F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < int(rate * (1 << 32)))
    by: dict[int, list[str]] = {}
    for (w,) in chosen.select("word").limit(2 * SAMPLE).collect():
        by.setdefault(len(w), []).append(w)
    return {length: Tree(counts(codes(sorted(ws), length)), max(1, int(CELL_WORDS * rate)), tight=False) for length, ws in by.items() if len(ws) > CELL_WORDS * rate}


PLACED = "word string, n long, length int, cell int"
SENT = "length int, cell int, side int, own int, word string, n long"


def _batches(batches: Iterator[pa.RecordBatch], place: Callable) -> Iterator[pa.RecordBatch]:
    for b in batches:
        df = b.to_pandas()
        for length, part in df.groupby(df["word"].str.len()):
            yield from place(int(length), part)


def placed(found: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Every word with its cell."""

    def place(length: int, part: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        points = counts(codes(part["word"].tolist(), length))
        cell = trees[length].cell(points) if length in trees else np.zeros(len(part), dtype=np.int64)
        yield pa.RecordBatch.from_pandas(part.assign(length=np.int32(length), cell=cell.astype(np.int32)), preserve_index=False)

    return found.mapInArrow(lambda b: _batches(b, place), PLACED)


def sent(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Every word with each cell that it is to be looked for in: those of its own length from its own on
    (so a pair of cells meets once), with one letter less here and more there; those of the next
    length with one letter more."""

    def place(length: int, part: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        points, own = counts(codes(part["word"].tolist(), length)), part["cell"].to_numpy()
        for to, up, down in ((length, 1, 1), (length + 1, 1, 0)):
            tree = trees.get(to)
            for node, rows in tree.search(points, up, down) if tree else [(None, np.arange(len(part)))]:
                cell = tree.number[node] if tree else 0
                rows = rows[own[rows] <= cell] if to == length else rows
                if len(rows):
                    some = part.iloc[rows]
                    same = (own[rows] == cell).astype(np.int32) if to == length else np.zeros(len(rows), dtype=np.int32)
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({"length": np.int32(to), "cell": np.int32(cell), "side": np.int32(1), "own": same, "word": some["word"].to_numpy(), "n": some["n"].to_numpy()}), preserve_index=False)

    return words.mapInArrow(lambda b: _batches(b, place), SENT)


class Piece:
    """Words of one cell, searched by others; what each side has near is tallied, never listed."""

    def __init__(self, words: list[str], n: list[int]):
        self.length = len(words[0])
        self.words, self.n = words, np.asarray(n, dtype=np.int64)
        self.codes = codes(words, self.length)
        self.points = counts(self.codes)
        self.tree = Tree(self.points, LEAF_WORDS, tight=True)
        # of words that are compared: the order of n downwards, then of code points
        self.near = Tally(words, self.n)

    def search(self, words: list[str], n: list[int], own: np.ndarray) -> Tally:
        length = len(words[0])
        asked, mine = codes(words, length), Tally(words, np.asarray(n, dtype=np.int64))
        points = counts(asked)
        same = length == self.length
        wanted = 2 if same else 1
        # what holds the square of a length exactly
        exact = np.float32 if self.length < 1 << 11 else np.float64 if self.length < 1 << 25 else np.int64
        for node, rows in self.tree.search(points, 1, int(same)):
            leaf = self.tree.leaves[node]
            step = max(1, PAIRS // max(1, len(leaf)))
            for at in range(0, len(rows), step):
                q = rows[at : at + step]
                a, b = points[q].astype(exact), self.points[leaf].astype(exact)
                # squared distances of integers: 2 if one letter became another, 1 if one is added
                far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
                i, j = np.nonzero(far == wanted)
                i, j = q[i], leaf[j]
                if same and own.any():
                    # within a cell every pair comes up twice: it counts where the asked word is the smaller
                    twice = own[i] == 1
                    keep = ~twice | _smaller(asked[i], self.codes[j])
                    i, j = i[keep], j[keep]
                edit = _one_edit(asked[i], self.codes[j])
                i, j = i[edit], j[edit]
                mine.add(i, self.words, self.n, j)
                self.near.add(j, words, mine.n, i)
        return mine


def _smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    at = differ.argmax(axis=1)
    rows = np.arange(len(a))
    return differ.any(axis=1) & (a[rows, at] < b[rows, at])


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether b is a with one letter replaced or, where it is longer, one inserted."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.cumprod(a == b[:, :-1], axis=1, dtype=np.int64).sum(axis=1) if a.shape[1] else np.zeros(len(a))
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int64).sum(axis=1) if a.shape[1] else np.zeros(len(a))
    return head + tail >= a.shape[1]


class Tally:
    """How many near words each word has met, and the best of them."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.met, self.best_n = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        self.best: list[str | None] = [None] * len(words)

    def add(self, rows: np.ndarray, others: list[str], n: np.ndarray, at: np.ndarray) -> None:
        np.add.at(self.met, rows, 1)
        # of a word's near words only the largest n can win
        largest = self.best_n.copy()
        np.maximum.at(largest, rows, n[at])
        for i in np.flatnonzero(n[at] == largest[rows]):
            r, other, k = rows[i], others[at[i]], int(n[at[i]])
            if k > self.best_n[r] or self.best[r] is None or other < self.best[r]:
                self.best_n[r], self.best[r] = k, other

    def rows(self) -> pa.RecordBatch | None:
        some = np.flatnonzero(self.met)
        if not len(some):
            return None
        columns = [pa.array([self.words[i] for i in some]), pa.array(self.met[some]), pa.array(-self.best_n[some]), pa.array([self.best[i] for i in some])]
        return pa.RecordBatch.from_arrays(columns, ["word", "met", "minus", "best"])


NEAR = "word string, met long, minus long, best string"


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows come sorted by piece, the words of a piece before those that are looked for in it."""
    key: tuple | None = None
    held: tuple[list, list] = ([], [])
    piece: Piece | None = None

    def done() -> Iterator[pa.RecordBatch]:
        if piece and (rows := piece.near.rows()):
            yield rows

    for b in batches:
        df = b.to_pandas()
        df["asked"] = df["word"].str.len()
        for (length, cell, salt, side, _), part in df.groupby(["length", "cell", "salt", "side", "asked"], sort=True):
            if key != (length, cell, salt):
                yield from done()
                key, held, piece = (length, cell, salt), ([], []), None
            if side == 0:
                held[0].extend(part["word"])
                held[1].extend(part["n"])
                continue
            if piece is None and held[0]:
                piece = Piece(*held)
            if piece:
                for at in range(0, len(part), AT_ONCE):
                    some = part.iloc[at : at + AT_ONCE]
                    found = piece.search(some["word"].tolist(), some["n"].tolist(), some["own"].to_numpy()).rows()
                    if found:
                        yield found
    yield from done()


def near(found: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of the words that have near ones. A cell of more words than
    a piece holds is dealt to several pieces, which each search is sent to."""
    trees = fitted(found, found.count())
    words = stored(placed(found, trees))
    sizes = words.groupBy("length", "cell").agg(F.ceil(F.count("*") / PIECE_WORDS).cast("int").alias("salts"))
    large = stored(sizes.where("salts > 1").select(F.col("length").alias("l"), F.col("cell").alias("c"), "salts"))
    points = words.select("length", "cell", F.lit(0).alias("side"), F.lit(0).alias("own"), "word", "n")
    rows = points.unionByName(sent(words, trees)).join(large, (F.col("length") == F.col("l")) & (F.col("cell") == F.col("c")), "left")
    salts = F.coalesce("salts", F.lit(1))
    mine = F.array(F.pmod(F.xxhash64("word"), salts).cast("int"))
    rows = rows.withColumn("salt", F.explode(F.when(F.col("side") == 0, mine).otherwise(F.sequence(F.lit(0), salts - 1))))
    piece = ["length", "cell", "salt"]
    rows = rows.select(*piece, "side", "own", "word", "n").repartition(*piece).sortWithinPartitions(*piece, "side", F.length("word"))
    tallied = rows.mapInArrow(meet, NEAR).groupBy("word").agg(F.sum("met").alias("n_near"), F.min(F.struct("minus", "best")).alias("b"))
    return tallied.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus")).alias("best_n"))


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``doc_id, text``.

    A null text has no runs, a null doc_id hashes as an empty one, rows that repeat count each
    time. Texts and words of any length take part whole. Of near words with equal n the first by
    code point is the form. Without words there are no rows; extra columns are left out."""
    found = stored(words(docs))
    close = stored(near(found)).withColumnRenamed("word", "w")
    out = found.join(close, F.col("word") == F.col("w"), "left")
    form = F.when(F.col("best_n") >= TIMES * F.col("n"), F.col("best"))
    out = stored(out.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")))
    chain = stored(out.where("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to")))
    for _ in range(DOUBLINGS):
        # every chain's links double in length; their ends stay where they are
        further = chain.select(F.col("from").alias("f"), F.col("to").alias("further"))
        longer = chain.join(further, F.col("to") == F.col("f"), "left")
        if longer.where("f is not null").limit(1).count() == 0:
            break
        chain = stored(longer.select("from", F.coalesce("further", "to").alias("to")))
    ended = out.join(chain, F.col("word") == F.col("from"), "left")
    return ended.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: CRC-32 bit by bit: its table by rule, then a fold over the bytes. Near words share a deletion.
ORACLE = r"""
WITH RECURSIVE bits(i, v, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents) GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, k, list_transform(range(octet_length(raw)), lambda j: ('0x' || substr(hex(raw), 2 * j::INTEGER + 1, 2))::BIGINT) AS b
  FROM (SELECT *, encode(concat(doc_id, ':', run)) AS raw FROM runs)),
hashed AS (
  SELECT run, k, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS h, length(run) AS l FROM bytes, crc),
w AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, (h % l)::INTEGER), substr(run, (h % l)::INTEGER + 2)) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING n >= 5),
d AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.less = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, other)) AS form FROM near GROUP BY word),
o AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word),
up AS (SELECT word, form AS root FROM o WHERE form IS NOT NULL UNION ALL SELECT up.word, o.form FROM up JOIN o ON o.word = up.root WHERE o.form IS NOT NULL),
ends AS (SELECT up.word, root FROM up JOIN o ON o.word = root WHERE o.form IS NULL)
SELECT o.word, form, coalesce(root, o.word) AS root, n, n_near, form_n FROM o LEFT JOIN ends ON ends.word = o.word
"""
