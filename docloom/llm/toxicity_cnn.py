"""Toxicity by a small convolutional text classifier, trained and applied by Spark.

A word is the sum of hashed embeddings of itself and of its beginnings. Filters of several widths
slide over the words; each keeps its strongest response in the whole text (max pooling), and a
logistic layer weighs these. It is fitted on every labelled text, whole: shards of them are trained
apart in tasks, and their steps are averaged after each round. Decision thresholds are calibrated by
language; the score itself sees nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import returning, scratch, stored, table, text_or_empty

BUCKETS, DIM = 1 << 15, 16
WIDTHS, FILTERS = (1, 2, 3), 16
BEGINNINGS = (3, 4, 5, 6)
#: Words that ``spread`` takes of a text at most, in stretches of so many; fitting reads whole texts.
SAMPLE_WORDS, STRETCH = 4_096, 64
#: A shard, which one task trains on by itself in a round, has about so many texts or characters; its words
#: are coded in pieces.
SHARD, SHARD_CHARS, PIECE = 4_096, 1 << 25, 1 << 18
#: Steps are averaged as whole multiples of this, so that sums do not depend on their order.
UNIT = 2.0**-32
#: Bits of the bitmap of labelled ids.
BITS = 1 << 26
#: Rows of the embedding whose steps are summed together.
BAND = 1_024
EPOCHS, BATCH, RATE = 6, 32, 0.1
SEED = 11
CACHE = 200_000
#: Positions scored at once.
BLOCK = 1 << 12
#: Thresholds that a language may have.
GRID = np.round(np.arange(0.3, 0.71, 0.05), 2)


def _remainder(by: int) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % by


def word_features(word: str) -> list[int]:
    """Bucket of the word, and of each of its beginnings (the whole word where it is shorter)."""
    raw = word.encode()
    if len(raw) == len(word):  # bytes are characters
        return [crc32(raw) % BUCKETS] + [crc32(raw[:n], n) % BUCKETS for n in BEGINNINGS]
    return [crc32(raw) % BUCKETS] + [crc32(word[:n].encode(), n) % BUCKETS for n in BEGINNINGS]


def words(text: str) -> list[str]:
    return text.lower().split()


def spread(ws: list[str], most: int = SAMPLE_WORDS, stretch: int = STRETCH) -> list[str]:
    """All words of a text, or stretches of it that are evenly spread from its first to its last
    word and ``most`` words together."""
    if len(ws) <= most:
        return ws
    n = most // stretch
    starts = [k * (len(ws) - stretch) // (n - 1) for k in range(n)]
    return [w for at in starts for w in ws[at : at + stretch]]


@dataclass
class Network:
    embed: np.ndarray  # buckets x dim
    filters: list[np.ndarray]  # one for each width: width x dim x filters
    bias: np.ndarray  # of all filters, widths one after another
    weight: np.ndarray
    offset: float

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strongest responses over one text's word vectors, and where they are. Texts end in
        zero vectors, one less than the widest filter, so short ones have a response too."""
        x = np.concatenate([x, np.zeros((max(WIDTHS), DIM), dtype=np.float32)])
        best, where = [], []
        for w, f in zip(WIDTHS, self.filters):
            n = len(x) - w + 1
            y = sum(x[k : k + n] @ f[k] for k in range(w))
            at = y.argmax(axis=0)
            best.append(y[at, np.arange(FILTERS)])
            where.append(at)
        return np.maximum(np.concatenate(best) + self.bias, 0), np.concatenate(where)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.weight + self.offset, -30, 30)))


def fresh() -> Network:
    rng = np.random.default_rng(SEED)
    draw = lambda sd, *shape: rng.normal(0, sd, shape).astype(np.float32)
    n = len(WIDTHS) * FILTERS
    # words start near zero, so one that training never saw says next to nothing
    return Network(draw(0.03, BUCKETS, DIM), [draw(0.3, w, DIM, FILTERS) for w in WIDTHS], np.zeros(n, np.float32), draw(0.3, n), 0.0)


def product(filters: list[np.ndarray]) -> np.ndarray:
    """All positions of all filters under each other: their responses are one matrix product."""
    return np.ascontiguousarray(np.concatenate([f[k] for f in filters for k in range(len(f))], axis=1).T)


def responses(y: np.ndarray) -> list[np.ndarray]:
    """For each width the filters' responses at every position, from the product with the words."""
    row, out = 0, []
    for w in WIDTHS:
        n, s = y.shape[1] - w + 1, y[row : row + FILTERS, : y.shape[1] - w + 1]
        for k in range(1, w):
            s = s + y[row + k * FILTERS : row + (k + 1) * FILTERS, k : k + n]
        row += w * FILTERS
        out.append(s)
    return out


@dataclass
class State:
    """A network and Adagrad's sums of squares, as two lists of the same arrays: the embedding (its sums
    are one for each row), then the filters, bias, weight and offset."""

    params: list[np.ndarray]
    past: list[np.ndarray]

    @staticmethod
    def first() -> State:
        net = fresh()
        params = [net.embed, *net.filters, net.bias, net.weight, np.zeros(1)]
        return State([p.astype(np.float64) for p in params], [np.full(len(p) if k == 0 else p.shape, 1e-6) for k, p in enumerate(params)])

    def network(self) -> Network:
        embed, *filters, bias, weight, offset = (p.astype(np.float32) for p in self.params)
        return Network(embed, filters, bias, weight, float(offset[0]))

    def copy(self) -> State:
        return State([p.copy() for p in self.params], [p.copy() for p in self.past])

    def step(self, k: int, gradient: np.ndarray) -> None:
        self.past[k] += gradient**2
        self.params[k] -= RATE * gradient / np.sqrt(self.past[k])


def epoch(state: State, features: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, share: np.ndarray, order: np.ndarray) -> None:
    """One pass of Adagrad on the log loss over a piece: ``texts`` are places in ``features``, the rows of
    the embedding that make up a word; ``share`` is the weight of each label. The gradient reaches only the
    words under the strongest responses."""
    gap = max(WIDTHS)
    for at in range(0, len(order), BATCH):
        batch = order[at : at + BATCH]
        sizes = np.array([len(texts[i]) for i in batch])
        starts = np.cumsum(sizes + gap) - sizes - gap
        # every text is followed by zero vectors, under the place after the last word's
        place = np.full(sizes.sum() + gap * len(batch), len(features), dtype=np.int64)
        for a, i in zip(starts, batch):
            place[a : a + len(texts[i])] = texts[i]
        used, place = np.unique(place, return_inverse=True)
        rows = features[used[:-1]]
        vectors = np.concatenate([state.params[0][rows].sum(axis=1), np.zeros((1, DIM))]).astype(np.float32)
        *filters, bias, weight, offset = state.params[1:]
        best, where = _strongest(vectors, place, starts, sizes, product(filters).astype(np.float32))
        pooled = np.maximum(best + bias, 0)
        y = labels[batch]
        error = (1 / (1 + np.exp(-np.clip(pooled @ weight + offset, -30, 30))) - y) * share[y] / BATCH
        back = np.where(pooled > 0, error[:, None] * weight, 0)
        words_g, by_filter = np.zeros((len(used), DIM)), []
        for k, (w, f) in enumerate(zip(WIDTHS, filters)):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            g_f = np.zeros_like(f)
            for j in range(w):
                under = place[where[:, k * FILTERS : (k + 1) * FILTERS] + j]
                g_f[j] = np.einsum("bfd,bf->df", vectors[under], d)
                words_g += _summed(under.ravel(), (d[:, :, None] * f[j].T).reshape(-1, DIM), len(used))
            by_filter.append(g_f)
        touched = np.flatnonzero(words_g[:-1].any(axis=1))
        for k, g in enumerate([*by_filter, back.sum(axis=0), error @ pooled, np.array([error.sum()])], 1):
            state.step(k, g)
        if len(touched):
            hit, to = np.unique(rows[touched].ravel(), return_inverse=True)
            total = _summed(to, np.repeat(words_g[touched], rows.shape[1], axis=0), len(hit))
            state.past[0][hit] += (total**2).mean(axis=1)
            state.params[0][hit] -= RATE * total / np.sqrt(state.past[0][hit])[:, None]


def _strongest(vectors: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest responses of each text, and where in ``place`` they are; BLOCK words of a text at once."""
    gap, n = max(WIDTHS), len(WIDTHS) * FILTERS
    best, where = np.full((len(sizes), n), -np.inf), np.zeros((len(sizes), n), dtype=np.int64)
    for row, (start, size) in enumerate(zip(starts, sizes)):
        for at in range(0, max(1, size), BLOCK):
            here = place[start + at : start + min(at + BLOCK, size) + gap]
            found = responses(by @ np.ascontiguousarray(vectors[here].T))
            pos = np.concatenate([s.argmax(axis=1) for s in found])
            value = np.concatenate([s.max(axis=1) for s in found])
            more = value > best[row]
            best[row, more], where[row, more] = value[more], start + at + pos[more]
    return best, where


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``values``, rows of DIM, summed by their number ``at``."""
    return np.bincount((at[:, None] * DIM + np.arange(DIM)).ravel(), values.ravel(), n * DIM).reshape(n, DIM)


@dataclass
class Classifier:
    network: Network
    thresholds: dict[str, float]


class Scorer:
    """A task's scorer: word vectors are cached, and all widths are one matrix product."""

    def __init__(self, net: Network):
        self.net = net
        self.product = product(net.filters)
        self.place = Places()
        self.vectors = np.zeros((1024, DIM), dtype=np.float32)

    def _index(self, ws: list[str]) -> np.ndarray:
        had = len(self.place)
        idx = np.fromiter(map(self.place.__getitem__, ws), dtype=np.int64, count=len(ws))
        if len(self.place) > had:
            new = list(islice(reversed(self.place), len(self.place) - had))[::-1]
            if len(self.place) > len(self.vectors):
                grown = np.zeros((2 * len(self.place), DIM), dtype=np.float32)
                grown[:had] = self.vectors[:had]
                self.vectors = grown
            self.vectors[had : len(self.place)] = self.net.embed[np.array([word_features(w) for w in new])].sum(axis=1)
        return idx

    def score(self, text: str) -> float:
        ws = words(text)
        best = None
        for at in range(0, max(1, len(ws)), BLOCK):  # blocks overlap by the widest filter
            if len(self.place) > CACHE:
                self.place = Places()
            idx = self._index(ws[at : at + BLOCK + max(WIDTHS) - 1])
            out = self.strongest(self.vectors[idx])
            best = out if best is None else np.maximum(best, out)
        return float(self.net.score(np.maximum(best + self.net.bias, 0)))

    def strongest(self, vectors: np.ndarray) -> np.ndarray:
        """Of all filters over these words, which zero vectors follow."""
        x = np.zeros((DIM, len(vectors) + max(WIDTHS)), dtype=np.float32)
        x[:, : len(vectors)] = vectors.T
        return np.concatenate([s.max(axis=1) for s in responses(self.product @ x)])


class Places(dict):
    """Word to its number; a word that is new takes the next one."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


# --- fitting ---------------------------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, shards: int = 1) -> DataFrame:
    """``shard, doc_id, lang, toxic, text`` of all documents to learn from: labelled rows whose crc32(doc_id)
    mod 5 is not 0. A document with several labels counts as toxic if one says so; null labels are left out;
    of a document whose id repeats the row with the smallest hash is the labelled one. Rows are dealt to
    ``shards`` shards by their ids, and lie by shard and id."""
    shard = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(shards)).cast("int").alias("shard")
    lang, text = F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text")
    row = F.struct(F.xxhash64(F.lit(SEED), text, lang).alias("h"), lang, text)
    texts = _likely(docs, labels).select(shard, "doc_id", F.lit(None).cast("int").alias("toxic"), row.alias("r"))
    marks = _marks(labels).select(shard, "doc_id", F.col("toxic").cast("int").alias("toxic"), F.lit(None).cast(texts.schema["r"].dataType).alias("r"))
    # labels and texts meet in one shuffle
    met = texts.unionByName(marks).repartition(shards, "shard").groupBy("shard", "doc_id").agg(F.max("toxic").alias("toxic"), F.min("r").alias("r"))
    met = met.where("toxic is not null and r is not null")
    return met.select("shard", "doc_id", "r.lang", "toxic", "r.text").sortWithinPartitions("shard", "doc_id")


def _marks(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (_remainder(5) != 0)).select("doc_id", "toxic")


def _likely(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents to learn from and few others, so that unlabelled texts are not shuffled: those whose
    hashed id is set in a bitmap of BITS bits, in rows of 32,768, which is broadcast."""
    h = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(BITS))
    bits = _marks(labels).select(h.alias("h")).groupBy(F.expr("h div 32768").alias("page")).agg(F.expr("bitmap_construct_agg(h % 32768)").alias("bits"))
    here = docs.where(F.col("doc_id").isNotNull() & (_remainder(5) != 0)).select("doc_id", "lang", "text", h.alias("h")).join(F.broadcast(bits), F.expr("h div 32768") == F.col("page"))
    return here.where("getbit(cast(conv(hex(substring(bits, cast(h % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast(h % 8 as int)) = 1").select("doc_id", "lang", "text")


#: A row for each piece: the embedding's rows of each of its words, its texts as numbers of words, one
#: after another, with their sizes and labels; ``last`` tells the fifth that is for thresholds.
CODED = "shard int, last boolean, words binary, ids binary, sizes binary, toxic binary, langs array<string>"


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CODED, from rows of ``sample`` sorted by shard; the pieces of a shard lie together."""
    now, open_pieces = None, {}

    def close(last: bool) -> pa.RecordBatch:
        place, ids, toxic, langs = open_pieces.pop(last)
        rows = np.array([word_features(w) for w in place], dtype=np.uint16)
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        raw = [x.tobytes() for x in (rows, np.concatenate(ids), sizes, np.array(toxic, np.int8))]
        arrays = [pa.array([now], pa.int32()), pa.array([last]), *(pa.array([x], pa.binary()) for x in raw), pa.array([langs], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in CODED.split(", ")])

    for b in batches:
        for k, doc_id, lang, toxic, text in (row for at in range(0, b.num_rows, STRETCH) for row in zip(*(c.to_pylist() for c in b.slice(at, STRETCH).columns))):
            if k != now:
                yield from map(close, sorted(open_pieces))
            now, last = k, crc32(f"part {doc_id}".encode()) % 5 == 0
            place, ids, marks, langs = open_pieces.setdefault(last, (Places(), [], [], []))
            ws = words(text)
            ids.append(np.fromiter(map(place.__getitem__, ws), dtype=np.int32, count=len(ws)))
            marks.append(toxic)
            langs.append(lang)
            if len(ws) > PIECE or len(ids) % 64 == 0 and sum(map(len, ids)) > PIECE:
                yield close(last)
    yield from map(close, sorted(open_pieces))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray, pa.Array]]:
    """``shard, features, texts, labels, langs`` of each piece."""
    for b in batches:
        for row in range(b.num_rows):
            words, ids, sizes, toxic = (np.frombuffer(b.column(c)[row].as_buffer(), t) for c, t in ((2, np.uint16), (3, np.int32), (4, np.int64), (5, np.int8)))
            yield b.column(0)[row].as_py(), words.reshape(-1, 1 + len(BEGINNINGS)), np.split(ids, np.cumsum(sizes)[:-1]), toxic.astype(int), b.column(6)[row].values


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fitted on four fifths of all labelled texts, in rounds that each see every one; the thresholds by
    language on the last fifth. Without labels of both kinds every score is the fresh network's, without
    meaning but defined."""
    n = _likely(docs, labels).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length(text_or_empty())), F.lit(0)).alias("chars")).first()
    shards = max(1, -(-n.rows // SHARD), -(-n.chars // SHARD_CHARS))
    with scratch(docs.sparkSession):
        given = stored(sample(docs, labels, shards).mapInArrow(returning(coded), CODED))
        mine = given.where("not last")
        counts = mine.mapInArrow(_label_counts, "toxic int, n long").groupBy("toxic").agg(F.sum("n").alias("n")).collect()
        found = {r.toxic: r.n for r in counts}
        if len(found) < 2:
            return Classifier(fresh(), {})
        share = np.array([sum(found.values()) / found[k] / 2 for k in (0, 1)])
        state = State.first()
        for r in range(EPOCHS):
            state = averaged(mine, state, share, r)
        return Classifier(state.network(), thresholds(given.where("last"), state.network()))


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, y, _ in _pieces(batches):
        k, n = np.unique(y, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64))], ["toxic", "n"])


def averaged(given: DataFrame, state: State, share: np.ndarray, r: int) -> State:
    """The state after one round: each shard starts from the given one and passes over its texts; what
    they add is averaged, a row of the embedding over the shards that moved it. A task sums its own
    shards, and bands of the sums are added up as they stream in."""
    start = given.sparkSession.sparkContext.broadcast(state)
    bands = -(-BUCKETS // BAND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, now, local = np.zeros(0, np.int64), None, None
        for shard, features, texts, y, _ in _pieces(batches):
            if shard != now:
                sums = _steps(sums, start.value, local)
                now, local, rng = shard, start.value.copy(), np.random.default_rng((SEED, r, shard))
            epoch(local, features, texts, y, share, rng.permutation(len(texts)))
        sums = _steps(sums, start.value, local)
        wide = BAND * (DIM + 2)
        parts = [sums[k : k + wide] for k in range(0, bands * wide, wide)] + [sums[bands * wide :]] if len(sums) else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["band", "sums"])

    rows = given.mapInArrow(returning(run), "band int, sums binary").repartition(bands + 1, "band").mapInArrow(_added, "band int, sums binary").collect()
    by = {row.band: np.frombuffer(row.sums, np.int64) for row in rows}
    embed = np.concatenate([by[k].reshape(-1, DIM + 2) for k in range(bands)])
    moved, rest = np.maximum(embed[:, -1], 1), by[bands]
    out = State([state.params[0] + embed[:, :DIM] * UNIT / moved[:, None]], [state.past[0] + embed[:, DIM] * UNIT / moved])
    at, mean = 1, rest[1:] * UNIT / rest[0]
    for old, new in ((state.params, out.params), (state.past, out.past)):
        for p in old[1:]:
            new.append(p + mean[at - 1 : at - 1 + p.size].reshape(p.shape))
            at += p.size
    return out


def _steps(sums: np.ndarray, start: State, now: State | None) -> np.ndarray:
    """``sums`` and what one shard adds: for each row of the embedding its step, that of its squares, and
    whether it moved; then one for the shard and the steps of all else."""
    if now is None:
        return sums
    moved = now.past[0] != start.past[0]
    embed = np.column_stack([(now.params[0] - start.params[0]) / UNIT, (now.past[0] - start.past[0]) / UNIT, moved])
    rest = [((b - a) / UNIT).ravel() for old, new in ((start.params, now.params), (start.past, now.past)) for a, b in zip(old[1:], new[1:])]
    step = np.rint(np.concatenate([embed.ravel(), [1.0], *rest])).astype(np.int64)
    return sums + step if len(sums) else step


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for band, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[band] = total.get(band, 0) + np.frombuffer(sums, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["band", "sums"])


def thresholds(given: DataFrame, net: Network) -> dict[str, float]:
    """For each language with ten rows of either label in the last fifth the threshold of GRID of the best
    F1; of equal ones that nearest to 0.5, which is also that of all other languages."""
    known = given.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = known.value
        scorer = Scorer(net)
        for _, features, texts, y, langs in _pieces(batches):
            vectors = net.embed[features].sum(axis=1)
            pooled = np.array([np.maximum(scorer.strongest(vectors[t]) + net.bias, 0) for t in texts])
            passed = np.searchsorted(GRID, net.score(pooled), side="right")
            yield pa.RecordBatch.from_arrays([langs, pa.array(y.astype(np.int32)), pa.array(passed.astype(np.int32))], ["lang", "toxic", "passed"])

    rows = given.mapInArrow(returning(run), "lang string, toxic int, passed int").where("lang is not null")
    tally: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang", "toxic", "passed").count().collect():
        tally.setdefault(r.lang, np.zeros((2, len(GRID) + 1), np.int64))[r.toxic, r.passed] = r["count"]
    out = {}
    for lang, n in sorted(tally.items()):
        above = n[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # rows that reach each threshold
        if n.sum(axis=1).min() >= 10:
            f1 = 2 * above[1] / np.maximum(1, above.sum(axis=0) + n[1].sum())
            out[lang] = float(max(zip(f1, -np.abs(GRID - 0.5), GRID))[2])
    return out


def with_scores(docs: DataFrame, model: Classifier, columns: list[Column]) -> DataFrame:
    """The given columns and ``score, flagged`` for every row; ``flagged`` compares the score
    with its language's threshold. Null texts count as empty, which have a score too."""
    given = docs.sparkSession.sparkContext.broadcast(model.network)
    rows = docs.select(text_or_empty().alias("__text"), F.col("lang").cast("string").alias("__lang"), F.struct(*columns).alias("__row"))
    schema = f"__row {rows.schema['__row'].dataType.simpleString()}, __lang string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(given.value)
        for b in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in b.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), scores], ["__row", "__lang", "score"])

    limit = F.lit(0.5)
    for lang, t in model.thresholds.items():
        limit = F.when(F.col("__lang") == lang, F.lit(t)).otherwise(limit)
    return rows.mapInArrow(returning(run), schema).select("__row", "score", (F.col("score") >= limit).alias("flagged"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(docs, model, [F.col("doc_id"), (_remainder(5) == 0).alias("held_out")]).select(
        "__row.doc_id", "__row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged"
    )


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that their language's threshold does not flag."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(docs, model, [F.col(f"`{c}`") for c in docs.columns]).where(~F.col("flagged")).select("__row.*")
