"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within R bits of each other, cut into m groups of bits with thresholds t_i that sum
to R - m + 1, agree within t_i on at least one group. Correlated bits share a group, and dynamic
programming allots the thresholds (-1: the group is never probed) so that probes and expected
candidates cost least. Candidates meet by equal probed keys and are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import returning, stored, table, text_or_empty
from docloom.llm.components import roots

SEED = 42
#: A bucket of more fingerprints is compared chunk against chunk in several tasks.
CHUNK = 4096
#: Shingles whose bits are counted at once.
BLOCK = 4096
#: Buckets up to this size are compared pair by pair, many at once; PAIRS of them at a time.
SMALL_RUN, PAIRS = 256, 1 << 20
#: Rows of the bit counts that are summed together.
BAND = 16
#: Fingerprints of a block at most, blocks that there are at least if they hold FEW each, and those compared at once.
TILE, TILES, FEW, WIDE = 1 << 16, 12, 1 << 12, 1 << 15


@dataclass(frozen=True)
class Kind:
    """What a fingerprint is and which ones link: ``bits`` wide (a multiple of 64) over shingles of
    so many words. Pairs within ``accept`` bits link: those within ``radius`` bits are sure to meet
    under a key, the others meet by chance or in ``across``."""

    shingle: int
    bits: int
    radius: int
    accept: int

    @property
    def lanes(self) -> int:
        return self.bits // 64

    @property
    def type(self) -> str:
        return "long" if self.lanes == 1 else "binary"


#: op7's contract.
CONTRACT = Kind(shingle=3, bits=64, radius=3, accept=3)
#: The pipeline's near copies: a Jaccard similarity of J in five-word shingles is a cosine of
#: 2J / (1 + J), so at 0.8 a bit differs with probability acos(0.889) / pi = 0.151. Of 256 bits these
#: are 39 with a deviation of 5.7; 46 takes nine of ten such pairs and a pair of J = 0.5 (68 bits,
#: deviation 7) in one of a thousand. Nearly all links meet under keys; ``across`` finds the rest.
NEAR_COPIES = Kind(shingle=5, bits=256, radius=23, accept=46)


def fingerprint(text: str, kind: Kind = CONTRACT) -> int:
    """SimHash as an unsigned integer: A-Z lower-cased, words between ASCII white space,
    shingles with repeats, XXH64 with seed 42; a bit is set if it is in over half of them. Lanes
    after the first 64 bits take their bits from the same hash, mixed anew for each."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= kind.shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(kind.shingle))))
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(kind.bits, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        wide = np.stack([part, *(mixed(part, k) for k in range(1, kind.lanes))], axis=1)
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits of each hash: the finaliser of SplitMix64 after a step of its own a lane."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def column(fps: np.ndarray) -> pa.Array:
    """Fingerprints, rows of unsigned lanes, as a column: a long, or binary of several lanes."""
    fps = np.ascontiguousarray(fps)
    if fps.shape[1] == 1:
        return pa.array(fps[:, 0].view(np.int64))
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * fps.shape[1]), len(fps), [None, pa.py_buffer(fps)])
    return raw.cast(pa.binary())


def lanes(values: pa.Array, n: int) -> np.ndarray:
    """The rows of unsigned lanes that ``column`` has packed."""
    if n == 1:
        return values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(values.to_pylist()), dtype="<u8").reshape(-1, n)


def fingerprints(docs: DataFrame, kind: Kind = CONTRACT) -> DataFrame:
    """``doc_id, row_key, fp`` for every row; a null text counts as empty. ``row_key`` names the
    row by its id and a hash of its text, for joining back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(fingerprint(t.as_py(), kind).to_bytes(kind.bits // 8, "little") for t in b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), column(np.frombuffer(raw, "<u8").reshape(-1, kind.lanes))], ["doc_id", "row_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text_or_empty().alias("text"))
    return rows.mapInArrow(returning(run), f"doc_id long, row_key string, fp {kind.type}")


def row_key():
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64(text_or_empty())))


# --- the plan: groups of bits and thresholds ---------------------------------------------------


@dataclass(frozen=True)
class Group:
    bits: tuple[int, ...]
    threshold: int

    def weights(self) -> np.ndarray:
        """What each bit adds to the group's key: its place, or in a group too wide for that a
        number of its own. Keys that meet by chance cost a comparison, no more."""
        if len(self.bits) <= 62:
            return np.uint64(1) << np.arange(len(self.bits), dtype=np.uint64)
        return np.random.default_rng(SEED).integers(1, 2**63, len(self.bits), dtype=np.uint64)


def bit_counts(fps: DataFrame, kind: Kind = CONTRACT) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits the number that set both: a sum over
    all of them. Each task sums its own; bands of the sums are then added up as they stream in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((kind.bits, kind.bits)), 0
        for b in batches:
            x = _bits(lanes(b.column(0), kind.lanes)).astype(np.float32)
            for at in range(0, len(x), BLOCK):
                both += x[at : at + BLOCK].T @ x[at : at + BLOCK]
            n += len(x)
        parts = [np.array([float(n)]), *(both[k : k + BAND].ravel() for k in range(0, kind.bits, BAND))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["band", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for band, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[band] = total.get(band, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["band", "sums"])

    n_bands = kind.bits // BAND + 1
    rows = fps.select("fp").mapInArrow(count, "band int, sums binary").repartition(n_bands, "band").mapInArrow(add, "band int, sums binary").collect()
    found = {r.band: np.frombuffer(r.sums) for r in rows}
    if not found:
        return 0, np.zeros((kind.bits, kind.bits))
    return int(found[0][0]), np.concatenate([found[k] for k in range(1, n_bands)]).reshape(kind.bits, kind.bits)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def grouped(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of almost equal width; each takes in turn the free bit most correlated with
    those it has."""
    n, bits = max(n, 1), len(both)
    p = np.diag(both) / n
    cov = both / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(link, 0)
    free, groups = np.ones(bits, dtype=bool), []
    for g in range(m):
        width = bits // m + (g < bits % m)
        near, group = link[:, free].sum(axis=1), []
        while len(group) < width:
            best = int(np.where(free, near, -1).argmax())
            near = link[:, best] + (near if group else 0)
            group.append(best)
            free[best] = False
        groups.append(group)
    return groups


def distance_odds(n: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """P(two random fingerprints differ in exactly d of the bits), d up to ``most``, taking each
    bit's agreement to depend on that of the bit before it."""
    n = max(n, 1)
    p = np.diag(both) / n

    def agree(i: int) -> float:
        return p[i] ** 2 + (1 - p[i]) ** 2

    def agree_both(i: int, j: int) -> float:
        x = both[i, j] / n
        return x**2 + (p[i] - x) ** 2 + (p[j] - x) ** 2 + (1 - p[i] - p[j] + x) ** 2

    odds = np.zeros((2, most + 1))  # by whether the last bit agreed
    odds[1, 0] = agree(bits[0])
    if most:
        odds[0, 1] = 1 - agree(bits[0])
    for i, j in zip(bits, bits[1:]):
        yes, same = agree(i), agree_both(i, j)
        given_yes = same / yes if yes > 0 else 0.0
        given_no = (agree(j) - same) / (1 - yes) if yes < 1 else 0.0
        step = np.zeros_like(odds)
        step[1] = odds[1] * given_yes + odds[0] * given_no
        step[0, 1:] = odds[1, :-1] * (1 - given_yes) + odds[0, :-1] * (1 - given_no)
        odds = step
    return odds.sum(axis=0)


#: Costs of a key that is shuffled and of a pair that is verified, in one unit.
KEY_COST, PAIR_COST = 20.0, 1.0


def allotted(n: int, both: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[Group]]:
    """The cheapest thresholds, -1 or more, that sum to radius - m + 1, by dynamic programming
    over the groups."""
    m, n = len(groups), max(n, 1)  # without fingerprints, too, few keys are the cheapest
    costs = []
    for bits in groups:
        odds = np.cumsum(distance_odds(n, both, bits, radius))
        costs.append({-1: 0.0} | {t: KEY_COST * n * (1 + sum(comb(len(bits), d) for d in range(1, t + 1)) / 2) + PAIR_COST * n * (n - 1) / 2 * odds[t] for t in range(radius + 1)})
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for t, c in cost.items():
                if spent + t not in step or total + c < step[spent + t][0]:
                    step[spent + t] = (total + c, [*chosen, t])
        best = step
    total, chosen = best[radius - m + 1]
    return total, [Group(tuple(b), t) for b, t in zip(groups, chosen)]


def plan(n: int, both: np.ndarray, radius: int) -> list[Group]:
    """The cheapest of two to radius + 2 groups; more fingerprints make for wider groups."""
    return min((allotted(n, both, grouped(n, both, m), radius) for m in range(2, radius + 3)), key=lambda x: x[0])[1]


# --- probing and verifying ---------------------------------------------------------------------


def keys(fps: DataFrame, groups: list[Group], kind: Kind = CONTRACT) -> DataFrame:
    """``part, key, probe, fp``: the group's bits as they are (probe 0), and with every 1 to
    threshold of them flipped (probe 1). Of two fingerprints the one whose highest differing bit is
    set does the flipping, so only flips whose highest bit is set in the fingerprint are emitted,
    and one of the two meets the other under that one's own key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = lanes(b.column(0), kind.lanes)
            bits = _bits(fps)
            for part, g in enumerate(groups):
                if g.threshold < 0:
                    continue
                mine, w = bits[:, list(g.bits)], g.weights()
                own = mine.astype(np.uint64) @ w
                at, key = [np.arange(len(fps))], [own]
                for d in range(1, g.threshold + 1):
                    for flip in combinations(range(len(g.bits)), d):
                        rows = np.flatnonzero(mine[:, flip[-1]])
                        change = np.where(mine[rows][:, flip], np.uint64(0) - w[list(flip)], w[list(flip)]).sum(axis=1, dtype=np.uint64)
                        at.append(rows)
                        key.append(own[rows] + change)
                probe = np.repeat([0, 1], [len(own), sum(map(len, at)) - len(own)]).astype(np.int32)
                at = np.concatenate(at)
                columns = [np.full(len(at), part, np.int32), np.concatenate(key).view(np.int64), probe]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), column(fps[at])], ["part", "key", "probe", "fp"])

    return fps.select("fp").mapInArrow(run, f"part int, key long, probe int, fp {kind.type}")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(run: np.ndarray, split: int, accept: int) -> Iterator[tuple[int, int]]:
    """Positions of a spanning forest of the run's links. With ``split`` only links between the
    first ``split`` and the rest count."""
    n = len(run)
    side = np.arange(n) < split
    left = np.arange(n)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = _distance(run[left], run[i]) <= accept
            if split:
                near &= side[left] != side[i]
            for j in left[near]:
                yield i, j
                front.append(j)
            left = left[~near]


def links(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of each bucket, from rows sorted by part, key, pair, rank. A
    bucket may go on over batches; it has about 2 * CHUNK rows at most."""
    rest = None
    for b in batches:
        part = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
        fp = lanes(b.column(4), kind.lanes)
        if rest:
            part, fp = np.concatenate([rest[0], part]), np.concatenate([rest[1], fp])
        last = np.flatnonzero((part[:, :3] != part[-1, :3]).any(axis=1))
        at = last[-1] + 1 if len(last) else 0
        yield _linked(part[:at], fp[:at], kind)
        rest = part[at:], fp[at:]
    if rest:
        yield _linked(*rest, kind)


def _linked(part: np.ndarray, fp: np.ndarray, kind: Kind) -> pa.RecordBatch:
    out: list[tuple[int, int]] = []
    if len(fp) > 1:
        starts = np.flatnonzero(np.r_[True, (part[1:, :3] != part[:-1, :3]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(fp)])
        own = np.add.reduceat((part[:, 3] == 0).astype(np.int64), starts)
        small = (sizes <= SMALL_RUN) & (part[starts, 2] == 0)
        out = _spanning(_small_links(fp, starts[small], sizes[small], own[small], kind.accept))
        for s in np.flatnonzero(~small & (sizes > 1)):
            a, n = starts[s], sizes[s]
            one, other = divmod(int(part[a, 2]), 1 << 32)  # the same chunk twice: all its rows meet
            split = int((part[a : a + n, 3] < 2).sum()) if one != other else 0
            out += [(a + i, a + j) for i, j in _forest(fp[a : a + n], split, kind.accept)]
    i, j = (np.array(x, dtype=np.int64) for x in (zip(*out) if out else ([], [])))
    return pa.RecordBatch.from_arrays([column(fp[i]), column(fp[j])], ["a", "b"])


def _small_links(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, accept: int) -> Iterator[tuple[int, int]]:
    """Links of the first ``own`` rows of each bucket with those after them."""
    if not len(starts):
        return
    of = np.repeat(np.arange(len(starts)), own)
    row = starts[of] + np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(own)[:-1]], own)  # each row under its own key
    after = starts[of] + sizes[of] - row - 1
    ends = np.cumsum(after)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = after[at:to]
        i = np.repeat(row[at:to], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        near = np.flatnonzero(_distance(fp[i], fp[j]) <= accept)
        yield from zip(i[near].tolist(), j[near].tolist())
        at = to


def _spanning(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    for i, j in pairs:
        if (a := top(i)) != (b := top(j)):
            above[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def linked(fps: DataFrame, groups: list[Group], kind: Kind = CONTRACT) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints that span the same components as all links.

    Buckets larger than CHUNK are dealt out: each fingerprint goes to one of the bucket's chunks,
    and each pair of chunks, a chunk with itself included, is a bucket of its own. A bucket of n
    fingerprints is thus copied n / CHUNK times, which grows with the square of n; that a key has
    so many is what the plan's wider groups for more fingerprints prevent but for very dense ones."""
    probed = keys(fps, groups, kind)
    large = probed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    # stored, so that its size is known: the join then broadcasts the few large buckets there are
    large = stored(large.select(F.col("part").alias("p"), F.col("key").alias("k"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    dealt = probed.join(large, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")), "left")
    mine = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("chunks").cast("long")), F.lit(0))
    dealt = dealt.select("part", "key", "probe", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)).cast("long") - 1)).alias("other"), "fp")
    pair = F.shiftleft(F.least("mine", "other"), 32).bitwiseOR(F.greatest("mine", "other"))
    rank = F.col("probe") + F.when(F.col("mine") > F.col("other"), 2).otherwise(0)
    dealt = dealt.select("part", "key", pair.alias("pair"), rank.alias("rank"), "fp")
    bucket = ["part", "key", "pair"]
    return dealt.repartition(*bucket).sortWithinPartitions(*bucket, "rank").mapInArrow(lambda b: links(b, kind), f"a {kind.type}, b {kind.type}")


def across(named: DataFrame, kind: Kind) -> DataFrame:
    """Links ``a, b`` of roots: every pair of ``fp, root`` of two roots that differs in ``accept`` bits or fewer
    joins them. It is the exact way for pairs that no key brings together, for which every block of
    fingerprints meets every other: the square of their number in time, two blocks at once in memory."""
    n = named.count()
    blocks = max(1, min(-(-n // FEW), max(TILES, -(-n // TILE))))
    mine = F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int")
    rows = named.select(mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"), "fp", F.when(F.col("root") != F.col("fp"), F.col("root")).alias("root"))
    pair = F.least("mine", "other") * F.lit(blocks).cast("long") + F.greatest("mine", "other")
    rows = rows.select(pair.alias("pair"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp", "root")
    rows = rows.repartition(blocks * (blocks + 1) // 2, "pair").sortWithinPartitions("pair", "side")
    return rows.mapInArrow(lambda b: _met(b, kind), f"a {kind.type}, b {kind.type}")


def _met(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    now, held = None, []

    def close() -> pa.RecordBatch:
        fp, root = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        i, j = np.array(list(_joining(fp, root, int(sum((h[0] == 0).sum() for h in held)), kind.accept)), dtype=np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([column(root[i]), column(root[j])], ["a", "b"])

    for b in batches:
        pair, side = b.column(0).to_numpy(), b.column(1).to_numpy()
        fp = lanes(b.column(2), kind.lanes)
        root = lanes(pc.coalesce(b.column(3), b.column(2)), kind.lanes)
        cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1), len(pair)]
        for a, z in zip(cuts, cuts[1:]):
            if a < z:
                if held and pair[a] != now:
                    yield close()
                    held = []
                now = pair[a]
                held.append((side[a:z], fp[a:z], root[a:z]))
    if held:
        yield close()


def _joining(fp: np.ndarray, root: np.ndarray, split: int, accept: int) -> Iterator[tuple[int, int]]:
    """Positions that span what the links between the first ``split`` rows and the rest join, or among all rows
    if there is no rest. Half of the lanes leave few pairs to count all bits of."""
    n, whole = len(fp), split == len(fp)
    label = np.unique(root.view(f"V{8 * root.shape[1]}").ravel(), return_inverse=True)[1].astype(np.int32)
    by = np.ascontiguousarray(fp[:, : (fp.shape[1] + 1) // 2].T)
    for i in range(split):
        for at in range(i + 1 if whole else split, n, WIDE):
            apart = sum(np.bitwise_count(lane[at : at + WIDE] ^ lane[i]) for lane in by)
            near = np.flatnonzero(apart <= accept) + at
            near = near[label[near] != label[i]]
            for j in near[_distance(fp[near], fp[i]) <= accept]:
                if label[j] != label[i]:
                    yield i, j
                    label[label == label[j]] = label[i]


def components(docs: DataFrame, kind: Kind = CONTRACT) -> DataFrame:
    """``doc_id, row_key, fp, root, component_id`` for every row of ``doc_id, text``.

    Copies fall together by fingerprint before anything is compared. ``component_id`` is the
    smallest doc_id of the rows reached, null if they have none. Null and empty texts have
    fingerprint zero and are linked like any other; repeated rows are rows of their own; an empty
    table gives no rows; extra columns are left out."""
    rows = stored(fingerprints(docs, kind))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = stored(roots(linked(distinct, plan(*bit_counts(distinct, kind), kind.radius), kind)))
    root = distinct.join(found, F.col("fp") == F.col("id"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    if kind.accept > kind.radius:
        root = stored(root)
        wider = stored(roots(across(root.select("fp", "root"), kind))).select(F.col("id").alias("i"), F.col("root").alias("wider"))
        root = root.join(wider, F.col("root") == F.col("i"), "left").select("fp", "first", F.coalesce("wider", "root").alias("root"))
    # stored, so the join below has a shuffle of its own that can split a large component
    least = stored(root.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r"))
    named = root.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return rows.join(named, F.col("fp") == F.col("f")).drop("f")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies (five-word shingles, an estimated Jaccard
    similarity of 0.8 or more) the row with the smallest doc_id stays. Texts without words are
    copies of each other; of rows that repeat one stays; columns of any name pass through."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    stays = components(docs, NEAR_COPIES).groupBy("root").agg(first).select(F.col("first.row_key").alias("__stays"))
    rows = docs.select(F.struct("*").alias("__row"), row_key().alias("__key"))
    rows = rows.join(stays, F.col("__key") == F.col("__stays"), "left_semi")
    again = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return rows.withColumn("__n", again).where("__n = 1").select("__row.*")
