"""Keyword and vector arms, their fusion, gating and reranking, for batches of questions.

Every ranking has a total order, scores are rounded before they are ranked, and each operator is a
function of DataFrames, so Catalyst sees one plan for a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.store import stored
from docloom.operators.vectors import nearest

#: Fixed values of the ranking functions.
K1, B = 1.4, 0.72
RRF = 60.0
VECTOR_FLOOR, COVERAGE_FLOOR = 0.25, 0.35
RARE_SHARE = 0.03
HALF_LIFE_DAYS = 45.0


def ranked(df: DataFrame, group: list[str], *order: Column, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def question_terms(questions: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term`` distinct."""
    return questions.select(key, F.explode(F.array_distinct(T.terms(T.text_or_empty(text)))).alias("term"))


def chunk_stats(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """``key, terms, len``: one pass, no shuffle. Chunks without terms stay, with ``len`` 0: a
    filter on it would be pushed to the scan and split every text twice."""
    t = chunks.select(key, T.terms(T.text_or_empty(text)).alias("terms"))
    return t.select(key, "terms", F.size("terms").alias("len"))


def totals(stats: DataFrame) -> tuple[int, float]:
    """Chunks that have terms, and their mean length."""
    r = stats.agg(F.count_if(F.col("len") > 0).alias("n"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("a")).first()
    return r.n, r.a or 1.0


def postings(stats: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """``key, term, tf, len``. With ``wanted`` (a ``term`` column) only those terms' postings are
    kept, before anything is shuffled by chunk and term."""
    rows = stats.select(key, "len", F.explode("terms").alias("term"))
    if wanted is not None:
        rows = rows.join(wanted.select("term").distinct(), "term", "left_semi")
    return rows.groupBy(key, "term", "len").agg(F.count("*").alias("tf"))


#: Rows of question terms that are asked at once, and documents that are scored at once.
ASKED_AT_ONCE, DOCS_AT_ONCE = 1_000_000, 8192
KEYWORD, COVERAGE = "keyword", "coverage"


class _Asked:
    """Some questions: their terms by number, and of each the terms' numbers and weights."""

    def __init__(self, rows: list):
        self.number: dict[str, int] = {}
        self.terms = [(r["q"], np.array([self.number.setdefault(e["term"], len(self.number)) for e in r["ts"]], dtype=np.int64), np.array([e["weight"] for e in r["ts"]])) for r in rows]


def index(docs: DataFrame, key: str, text: str, number: dict[str, int], group: str | None = None) -> DataFrame:
    """``key, part, len, ids, tfs``, stored: of every document that has terms how many, and the asked
    ones among them with their counts. Every text is split once, and nothing is shuffled."""
    given = docs.sparkSession.sparkContext.broadcast(number)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = given.value.get
        for b in batches:
            sizes, ids, tfs = [], [], []
            for line in b.column(2).to_pylist():
                words = line.split(" ")
                at, n = np.unique([i for i in map(place, words) if i is not None], return_counts=True)
                sizes.append(len(words))
                ids.append(at.astype("<i4").tobytes())
                tfs.append(n.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], ["key", "part", "len", "ids", "tfs"])

    part = F.col(group).cast("string") if group else F.lit("")
    lines = docs.select(F.col(key).alias("key"), part.alias("part"), F.array_join(T.terms(T.text_or_empty(text)), " ").alias("line"))
    return stored(lines.where("line <> ''").mapInArrow(run, f"key {kind}, part string, len int, ids binary, tfs binary"))


def _frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """Documents of each asked term: a sum of each task, of as many numbers as there are asked terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, dtype=np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["id", "df"])

    out = np.zeros(terms, dtype=np.int64)
    for r in found.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        out[r["id"]] = r["df"]
    return out


def _best(value: np.ndarray, keys: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of the places ``at`` with the highest values, of equal ones those of the smaller keys."""
    if len(at) > k:
        floor = np.partition(value[at], len(at) - k)[len(at) - k]
        at = at[value[at] >= floor]
    return at[np.lexsort((keys[at], -value[at]))[:k]]


def arms(questions: DataFrame, q: str, docs: DataFrame, key: str, text: str, k: int, kinds: tuple[str, ...] = (KEYWORD,), group: str | None = None) -> DataFrame:
    """``q, key, arm, value``, and ``part`` if there is a group: each arm's k best documents of every
    question (of every group of documents), and as many of each task that have not been merged yet.

    ``questions`` has ``q, term`` and may have ``weight``. Arm keyword is BM25 over all documents that
    have terms, arm coverage the share of the question's terms that a document has. Questions are
    broadcast ASKED_AT_ONCE terms at a time; a task scores its own documents against all of them and
    hands on k rows a question, so no row for each question and document is ever made. A block of
    documents is left out for a question where the largest weights of its terms in the block together
    stay below the k-th score that the task has."""
    spark = questions.sparkSession
    weight = F.col("weight").cast("double") if "weight" in questions.columns else F.lit(1.0)
    asked = questions.select(F.col(q).alias("q"), "term", weight.alias("weight"))
    groups = max(1, -(-asked.count() // ASKED_AT_ONCE))
    out = None
    for n in range(groups):
        mine = asked.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == n).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("ts"))
        now = _Asked(mine.collect())
        found = index(docs, key, text, now.number, group)
        total = found.agg(F.count("*").alias("n"), F.avg("len").alias("a")).first()
        df = _frequencies(found, len(now.number))
        given = spark.sparkContext.broadcast((now.terms, df, total["n"], total["a"] or 1.0))
        rows = found.mapInArrow(lambda b, given=given: _score(b, *given.value, k, kinds), f"{q} {questions.schema[q].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}, part string, arm string, value double")
        out = rows if out is None else out.unionByName(rows)
    return out if group else out.drop("part")


def _score(batches: Iterator[pa.RecordBatch], questions: list, df: np.ndarray, n: int, mean: float, k: int, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    floors: dict[tuple, float] = {}
    held: list[pa.RecordBatch] = []

    def block() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        keys, parts = t.column(0).to_numpy(), np.array(t.column(1).to_pylist())
        sizes = t.column(2).to_numpy().astype(float)
        lists = t.column(3).to_pylist()
        ids = np.frombuffer(b"".join(lists), "<i4")
        tf = np.frombuffer(b"".join(t.column(4).to_pylist()), "<i4").astype(float)
        doc = np.repeat(np.arange(len(keys)), [len(x) // 4 for x in lists])
        order = np.argsort(ids, kind="stable")
        ids, tf, doc = ids[order], tf[order], doc[order]
        w = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        starts = np.searchsorted(ids, np.arange(len(df) + 1))
        most = np.zeros(len(df))
        np.maximum.at(most, ids, w)
        places = {p: np.flatnonzero(parts == p) for p in np.unique(parts)}
        out = []
        for q, terms, weights in questions:
            for arm in kinds:
                gain = idf[terms] * weights if arm == KEYWORD else np.full(len(terms), 1.0 / len(terms))
                bound = float((gain * (most[terms] if arm == KEYWORD else most[terms] > 0)).sum()) + 1e-6
                wanted = [p for p in places if bound > floors.get((q, arm, p), 0.0)]
                if not wanted:
                    continue
                value = np.zeros(len(keys))
                for term, g in zip(terms, gain):
                    at = slice(starts[term], starts[term + 1])
                    value[doc[at]] += g * w[at] if arm == KEYWORD else 1.0
                value = np.round(value if arm == KEYWORD else value / len(terms), 6)
                for p in wanted:
                    at = places[p]
                    at = _best(value, keys, at[value[at] > 0], k)
                    out += [(q, keys[i], p, arm, value[i]) for i in at]
                    if len(at) == k:
                        floors[q, arm, p] = max(floors.get((q, arm, p), 0.0), float(value[at[-1]]) - 1e-6)
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) if out else pa.array([], x) for c, x in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()))], ["q", "key", "part", "arm", "value"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= DOCS_AT_ONCE:
            yield from block()
            held.clear()
    if held and sum(x.num_rows for x in held):
        yield from block()


def fuse(arms: DataFrame, q: str, key: str) -> DataFrame:
    """Reciprocal rank fusion of ``q, key, arm, rank`` (ranks from 1): one grouping merges all
    arms, instead of an outer join for each."""
    return arms.groupBy(q, key).agg(
        F.round(F.sum(F.lit(RRF) / (F.lit(RRF) + F.col("rank"))), 6).alias("fused"),
        F.sort_array(F.collect_set("arm")).alias("origins"),
    )


def top_vectors(vectors: DataFrame, every: int, k: int, floor: float = VECTOR_FLOOR, asked: DataFrame | None = None) -> DataFrame:
    """``query_id, vec_id, similarity, rank``: cosine neighbours of the rows whose id ``every``
    divides among all others of ``vec_id, unit``, exact, through pivot cells.

    Where the rows have a column ``by``, a query meets only rows of its own ``by``, before any is
    scored; ``asked`` (``vec_id, unit, by``) then says who asks, once for each ``by`` that it may see."""
    rows = vectors if "by" in vectors.columns else vectors.withColumn("by", F.lit(""))
    queries = (rows if asked is None else asked).where(F.col("vec_id") % every == 0)
    found, _, _ = nearest(rows, queries, k, floor)
    return ranked(found, ["query_id"], F.desc("similarity"), F.col("vec_id")).where(F.col("rank") <= k)


def recency(day: Column, newest: Column) -> Column:
    """1 at the newest day of the pool, half of it every 45 days before; 0 without a date."""
    gap = F.datediff(newest, day)
    return F.when(day.isNull(), 0.0).when(gap <= 0, 1.0).otherwise(F.pow(F.lit(0.5), gap / F.lit(HALF_LIFE_DAYS)))


def within_budget(df: DataFrame, group: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The rows before the first that overflows the budget; the first row of a group always stays."""
    w = Window.partitionBy(*group).orderBy(*order)
    used = df.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(w))
    return used.where((F.col("used") <= budget) | (F.col("position") == 1))


def reserve(df: DataFrame, group: list[str], first: Column, order: list[Column], slots: int, limit: int) -> DataFrame:
    """Up to ``slots`` rows that ``first`` marks lead, the others follow in order; ``limit`` in all."""
    inside = F.row_number().over(Window.partitionBy(*group, first).orderBy(*order))
    lead = F.when(first & (inside <= slots), 0).otherwise(1)
    out = df.withColumn("lead", lead)
    return ranked(out, group, F.col("lead"), *order, out="place").where(F.col("place") <= limit)


def first_of(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of each group by a total order."""
    return ranked(df, group, *order, out="__n").where("__n = 1").drop("__n")


#: Texts without an inner word that are looked for in one row at once.
LOOKED_FOR = 1024


def holding(asked: DataFrame, q: str, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``q, key`` of the rows of ``docs`` whose text holds an asked one whole, as it stands.

    The words of an asked text but its first and last are whole words of whatever holds it: candidates share
    the rarest of these, by an equi-join. The words at both ends may be parts of longer ones there, so they
    are no keys; texts without an inner word are compared with every row, a block of them at once. Null
    texts hold nothing and are held by nothing; an empty text is held by all others."""
    asked = asked.select(q, F.col(text).alias("__asked")).where("__asked is not null")
    rows = docs.select(key, F.col(text).alias("__body")).where("__body is not null")
    ends = r"(?s)\A[\p{L}\p{N}_]*|[\p{L}\p{N}_]*\z"
    inner = asked.select(q, F.explode(F.array_distinct(T.terms(F.regexp_replace("__asked", ends, "")))).alias("term"))
    wanted = stored(inner)
    found = rows.select(key, F.explode(F.array_distinct(T.terms(F.col("__body")))).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    found = stored(found)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    # a word that no row has means that no row holds the text
    rarest = first_of(wanted.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))), [q], F.col("df"), F.col("term"))
    near = rarest.select(q, "term").join(found, "term").join(asked, q).join(rows, key)
    by_word = near.where(F.contains("__body", F.col("__asked"))).select(q, key)
    short = stored(asked.join(wanted.select(q).distinct(), q, "left_anti"))
    blocks = max(1, -(-short.count() // LOOKED_FOR))
    packed = short.groupBy(F.pmod(F.xxhash64(q), F.lit(blocks)).cast("int").alias("__block")).agg(F.collect_list(F.struct(q, "__asked")).alias("__all"))
    every = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "__block")
    held = every.select(key, F.explode(F.filter("__all", lambda x: F.contains(F.col("__body"), x["__asked"]))).alias("x"))
    return by_word.unionByName(held.select(f"x.{q}", key))
