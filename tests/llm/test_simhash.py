import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from docloom.llm import simhash_pigeonhole as s
from docloom.llm.components import roots


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, alike):
    ids = sorted(ids)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and alike(i, j):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def within(fps, bits):
    return brute_components(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= bits)


TEXTS = [None, "", " \t\n", "one", "One two", "a b c", "a b c d e f g", "A B C D E F G", "É é É ü", "x " * 500, "y z " * 3000, "a b c\x85d e f", "word " + "long" * 5000]


def test_fingerprints_match_brute_force():
    for t in TEXTS:
        assert s.fingerprint(t or "") == brute_fingerprint(t)
        wide = s.fingerprint((t or "") + " and two more words", s.NEAR_COPIES)
        assert wide.bit_length() > 128 and s.fingerprint("", s.NEAR_COPIES) == 0


@pytest.mark.parametrize("kind", [s.CONTRACT, s.Kind(3, 128, 5, 5)])
def test_components_match_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(s, "CHUNK", 7)
    monkeypatch.setattr(s, "SMALL_RUN", 12)
    monkeypatch.setattr(s, "PAIRS", 50)
    rng = random.Random(1)
    fps = [rng.getrandbits(kind.bits) for _ in range(60)]
    for _ in range(150):  # chains and dense balls
        f = rng.choice(fps[:60]) if rng.random() < 0.5 else fps[-1]
        for b in rng.sample(range(kind.bits), rng.randrange(kind.radius + 2)):
            f ^= 1 << b
        fps.append(f)
    fps = dict(enumerate(dict.fromkeys(fps)))
    raw = np.frombuffer(b"".join(f.to_bytes(kind.bits // 8, "little") for f in fps.values()), "<u8").reshape(-1, kind.lanes)
    values = s.column(raw).to_pylist()
    df = spark.createDataFrame([(v,) for v in values], f"fp {kind.type}")
    n, both = s.bit_counts(df, kind)
    assert n == len(fps) and both[3, 9] == sum(f >> 3 & f >> 9 & 1 for f in fps.values())
    want = within(fps, kind.accept)
    for groups in (s.plan(n, both, kind.radius), s.allotted(n, both, s.grouped(n, both, 3), kind.radius)[1], s.allotted(n, both, s.grouped(n, both, 1), 1)[1]):
        assert sorted(b for g in groups for b in g.bits) == list(range(kind.bits))
        assert len(groups) == 1 or sum(g.threshold for g in groups) == kind.radius - len(groups) + 1
        root = {bytes(r.id) if isinstance(r.id, bytearray) else r.id: r.root for r in roots(s.linked(df, groups, kind)).collect()}
        got = {}
        for i, v in zip(fps, values):
            r = root.get(v, v)
            got.setdefault(bytes(r) if isinstance(r, bytearray) else r, []).append(i)
        if len(groups) > 1:
            assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in want if want[i] == r) for r in set(want.values()))


def test_rows_nulls_and_stage(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b c d e f g", 2), (6, TEXTS[6], 3), (None, None, 4), (99, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = s.components(df.select("doc_id", "text", "fp"))
    assert got.count() == len(rows)
    by = {(r.doc_id, r.fp): r.component_id for r in got.collect()}
    signed = int(np.uint64(brute_fingerprint(TEXTS[6])).view(np.int64))
    assert by[(99, 0)] == 0 and by[(1, 0)] == 0 and by[(7, signed)] == 6
    kept = s.one_of_each(spark, df, "")
    assert kept.columns == df.columns
    assert kept.count() == s.components(df, s.NEAR_COPIES).select("root").distinct().count()
    assert s.components(df.limit(0)).count() == 0 and s.one_of_each(spark, df.limit(0), "").count() == 0


def test_query_against_brute_force(spark, data):
    docs = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = within(docs, 3)
    got = s.op7_simhash(spark, data).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in docs.items()}


# --- near copies of the pipeline: against sets of five-word shingles


def shingles(text):
    ws = text.lower().split()
    return frozenset(" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, changes):
    words = list(words)
    for k in rng.sample(range(len(words)), changes):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_are_found_and_others_stay(spark):
    """Pairs at a Jaccard similarity of 0.8 or more: nine of ten meet. Below 0.5 none does, and what
    links is what brute force over all 256 bits links but for pairs that no group of bits brings near."""
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 250))]
        texts += [" ".join(words), edited(rng, words, max(1, len(words) // rng.choice([45, 60, 90, 12])))]
    passage = [f"p{k}" for k in range(55)]
    for _ in range(40):  # a shared passage is no near copy
        texts.append(" ".join([f"w{rng.randrange(3000)}" for _ in range(50)] + passage))
    sets = [shingles(t) for t in texts]
    fps = {i: s.fingerprint(t, s.NEAR_COPIES) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in s.components(df, s.NEAR_COPIES).collect()}
    near = [(i, j) for i in fps for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    found = sum(got[i] == got[j] for i, j in near)
    assert len(near) > 60 and found >= 0.9 * len(near)
    assert all(jaccard(sets[i], sets[j]) >= 0.5 for i in fps for j in range(i) if got[i] == got[j])
    want = within(fps, s.NEAR_COPIES.accept)
    assert all(want[i] == want[j] for i in fps for j in range(i) if got[i] == got[j])
    sure = within(fps, s.NEAR_COPIES.radius)
    assert all(got[i] == got[j] for i in fps for j in range(i) if sure[i] == sure[j])
    kept = {r.doc_id for r in s.one_of_each(spark, df, "").collect()}
    assert kept == set(got.values())
