"""Mixing, trained models and the pipeline: brute force, properties and held-out accuracy."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import brown_lm, mixing, packing, quality_ledger, simhash_pigeonhole, toxicity_cnn
from tests.llm.test_exact import ODD, check_pieces, rows

# --- mixing


def brute_targets(sizes):
    """Shares by weight; what is above twice a source's size is shared again, until nothing is."""
    keys = sorted(sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    target, excess, open_ = dict.fromkeys(keys, 0.0), 1.5 * sum(sizes.values()), set(keys)
    while excess > 1e-7 and open_:
        total = sum(weight[k] for k in open_)
        for k in open_:
            target[k] += excess * weight[k] / total
        excess = sum(max(0.0, target[k] - 2 * sizes[k]) for k in keys)
        for k in keys:
            target[k] = min(target[k], 2.0 * sizes[k])
        open_ = {k for k in open_ if target[k] < 2 * sizes[k] - 1e-9}
    return target


@pytest.mark.parametrize("block", [1024, 3])
def test_mix_reaches_targets(spark, data, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in mixing.op8_mixing(spark, data).collect()}
    assert set(got) == set(docs)
    sizes, taken, largest = {}, {}, {}
    for i, d in docs.items():
        n = len(d.text.split())
        assert got[i].size == n and got[i].taken % max(n, 1) == 0 and got[i].taken <= 2 * n and len(got[i].shards) * n == got[i].taken
        sizes[d.source] = sizes.get(d.source, 0) + n
        taken[d.source] = taken.get(d.source, 0) + got[i].taken
        largest[d.source] = max(largest.get(d.source, 0), n)
    want = brute_targets(sizes)
    for i, d in docs.items():
        assert got[i].source_size == sizes[d.source] and abs(got[i].target - want[d.source]) < 1e-3
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2, s
    if block == 1024:
        again = {r.doc_id: r.taken for r in mixing.op8_mixing(spark, data).collect()}
        assert again == {i: r.taken for i, r in got.items()}


def test_quotas_are_exact():
    counts = np.array([1000, 3, 0, 77, 1])
    q = mixing.split_quotas(counts, 16, 1)
    assert (q.sum(axis=0) == counts).all() and (q >= 0).all() and np.ptp(q.sum(axis=1)) <= 4
    huge = mixing.split_quotas(np.array([3 * 10**9, 5 * 10**8 + 1]), 8, 1)
    assert huge.sum(axis=0).tolist() == [3 * 10**9, 5 * 10**8 + 1] and (huge >= 0).all()


def test_draws_are_hypergeometric():
    """Counts of every outcome against the exact odds; large populations against mean and spread."""
    from math import comb

    rng = np.random.default_rng(0)
    for good, bad, draws in ((7, 5, 4), (3, 40, 20), (1, 1, 1), (0, 9, 4), (6, 0, 3)):
        seen = np.bincount([mixing.hypergeometric(rng, good, bad, draws) for _ in range(4000)], minlength=draws + 1)
        for k, n in enumerate(seen):
            odds = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) if k <= good and draws - k <= bad else 0
            assert abs(n / 4000 - odds) < 0.035 and (odds > 0 or n == 0)
    for scale in (10**6, 10**10):
        good, bad, draws = 3 * scale, 5 * scale, 2 * scale
        got = np.array([mixing.hypergeometric(rng, good, bad, draws) for _ in range(300)], dtype=float)
        sd = (draws * 3 / 8 * 5 / 8 * (good + bad - draws) / (good + bad - 1)) ** 0.5
        assert abs(got.mean() - draws * 3 / 8) < sd / 3 and 0.85 < got.std() / sd < 1.15


def test_many_sources_share_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCE_GROUPS", 3)
    counts = {f"k{i}": (i * 7) % 23 for i in range(40)}
    df = spark.createDataFrame(list(counts.items()), "key string, draws long")
    got = {r.k: np.diff([0, *r.bounds]) for r in mixing.shard_bounds(df, 8, 5).collect()}
    assert {k: int(b.sum()) for k, b in got.items()} == counts and all((b >= 0).all() for b in got.values())
    assert np.ptp(sum(got.values())) <= 3


def test_mix_odd_rows(spark):
    data = [(i, t, "de", s, i) for i, (t, s) in enumerate(zip(ODD, [None, None, "a", "b", "b", "b", None, "a", "a", "c", "", "c"]))]
    df = spark.createDataFrame([*data, (3, "one", "de", "b", 1), (None, "null id", None, None, 0)], "doc_id long, text string, size string, source string, shards int")
    out = mixing.mix(df)
    assert out.columns == df.columns
    words = lambda d: d.select(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).first().n
    assert words(out) > words(df.where("trim(text) <> ''"))
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text = ''")).count() == 0


# --- toxicity


def labelled(spark, n=700):
    rng = np.random.default_rng(4)
    plain, bad = [f"word{k}" for k in range(300)], ["vilest", "wretchy", "scumlike"]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(plain, int(rng.integers(3, 60))))
        toxic = int(i % 3 == 0)
        if toxic:
            text[int(rng.integers(len(text)))] = str(rng.choice(bad))
        docs.append((i, " ".join(text), "en" if i % 2 else "xx", "s", 0.5))
        labels.append((i, 1, toxic))
    odd = [(n + k, t, None, None, None) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([*docs, *odd, (None, "vilest", None, None, None)], "doc_id long, text string, lang string, source string, score double")
    return df, spark.createDataFrame([*labels, (5, 1, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_toxicity_learns_and_handles_odd_rows(spark):
    df, labels, truth = labelled(spark)
    model = toxicity_cnn.fit(df, labels)
    assert set(model.thresholds) == {"en", "xx"}
    out = toxicity_cnn.with_scores(df, model, [F.col("doc_id"), F.col("text")]).collect()
    assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
    held = [i for i in truth if crc32(str(i).encode()) % 5 == 0]
    by = {r["__row"].doc_id: r.score for r in out}
    assert np.mean([(by[i] >= 0.5) == truth[i] for i in held]) > 0.97
    scorer = toxicity_cnn.Scorer(model.network)
    text = next(r["__row"].text for r in out if r["__row"].doc_id == 0)
    slow = model.network.pooled(model.network.embed[np.array([toxicity_cnn.word_features(w) for w in text.split()])].sum(axis=1))[0]
    assert abs(scorer.score(text) - float(model.network.score(slow))) < 1e-4
    long = " ".join(["word1"] * (toxicity_cnn.BLOCK + 5)) + " vilest"
    assert scorer.score(long) > 0.5 > scorer.score(long.removesuffix(" vilest"))
    none = toxicity_cnn.fit(df, labels.limit(0))
    assert none.thresholds == {} and toxicity_cnn.with_scores(df.limit(0), none, [F.col("doc_id")]).count() == 0


def test_toxicity_query_and_stage(spark, data):
    """op6's columns by their rules; what the stage keeps by each row's own threshold."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = toxicity_cnn.op6_toxicity(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    model = toxicity_cnn.fit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    scorer = toxicity_cnn.Scorer(model.network)
    for r in got[:50]:
        score = scorer.score(docs[r.doc_id].text)
        limit = model.thresholds.get(docs[r.doc_id].lang, 0.5)
        assert abs(score - r.score) < 1e-5 and (r.flagged == (score >= limit) or abs(score - limit) < 1e-5)
    odd = spark.createDataFrame([(i, t, None, 1, "x") for i, t in enumerate(ODD)] + [(None, None, "en", 2, "y"), (3, "one", "en", 1, "z"), (3, "one", "en", 1, "z")], "doc_id long, text string, lang string, score int, flagged string")
    stage = toxicity_cnn.not_toxic(spark, odd, data)
    assert stage.columns == odd.columns
    model = toxicity_cnn.fit(odd, spark.read.parquet(f"{data}/labels.parquet"))  # a stage learns from its own input
    scorer = toxicity_cnn.Scorer(model.network)
    want = sorted(str(tuple(r)) for r in odd.collect() if scorer.score(r.text or "") < model.thresholds.get(r.lang, 0.5))
    assert sorted(str(tuple(r)) for r in stage.collect()) == want and toxicity_cnn.not_toxic(spark, odd.limit(0), data).count() == 0


def test_long_texts_are_sampled_over_their_length():
    ws = [str(k) for k in range(50_000)]
    got = toxicity_cnn.spread(ws)
    assert len(got) == toxicity_cnn.SAMPLE_WORDS and got[0] == "0" and got[-1] == "49999" and toxicity_cnn.spread(ws[:100]) == ws[:100]
    assert max(int(b) - int(a) for a, b in zip(got, got[1:])) < 1000


# --- language model


def test_gains_are_the_change_of_likelihood():
    rng = np.random.default_rng(6)
    n, k = 12, 4
    counts, classes = rng.integers(0, 5, (n, n)), rng.integers(0, k, n)

    def likelihood(c):
        t = np.zeros((k, k))
        np.add.at(t, (c[:, None].repeat(n, 1), c[None].repeat(n, 0)), counts)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1)), t

    now, table = likelihood(classes)
    for u in range(n):
        others = np.arange(n) != u
        before = np.bincount(classes[others], counts[others, u], k)
        after = np.bincount(classes[others], counts[u, others], k)
        got = brown_lm.gains(classes[u], before, after, counts[u, u], table)
        for c in range(k):
            moved = classes.copy()
            moved[u] = c
            assert abs(got[c] - (likelihood(moved)[0] - now)) < 1e-8


def test_most_frequent_cuts_ties_by_word(spark):
    """Equal counts: as many words as asked for, the smaller ones."""
    df = spark.createDataFrame([(f"w{k:03}", 7) for k in range(300)] + [("top", 90), ("low", 1)], "word string, n long")
    got = sorted(r.word for r in brown_lm.most_frequent(df, 50).collect())
    assert got == sorted(["top", *(f"w{k:03}" for k in range(49))])
    assert brown_lm.most_frequent(df, 1000).count() == 302 and brown_lm.most_frequent(df.limit(0), 5).count() == 0


def test_exchange_raises_likelihood(spark):
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 3, 40)  # words of three kinds that follow each other in turn
    pairs = {(int(a), int(b)): int(rng.integers(20, 40)) for a in range(40) for b in range(40) if kinds[b] == (kinds[a] + 1) % 3}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a int, b int, n long")
    classes, history = brown_lm.exchange(df, 42, k=6, rounds=8)
    assert history[-1] > history[0] and classes[40] == 4 and classes[41] == 5
    assert all(len({int(kinds[u]) for u in range(40) if classes[u] == c}) <= 1 for c in range(4))


def test_best_class_is_the_likeliest():
    rng = np.random.default_rng(5)
    k = brown_lm.CLASSES
    counts = rng.integers(0, 50, (k, k))
    before, after = rng.integers(0, 3, (20, k)), rng.integers(0, 3, (20, k))
    before[:, brown_lm.OPEN_CLASS] = after[:, brown_lm.OPEN_CLASS] = 0
    before[3] = after[3] = 0
    n = rng.integers(1, 9, 20).astype(float)
    got = brown_lm.best_classes(before, after, n, counts)
    for i in range(20):
        def odds(c, i=i):
            p = lambda a, b: np.log((counts[a, b] + 0.1) / (counts[a].sum() + 0.1 * k))
            return sum(before[i, j] * p(j, c) + after[i, j] * p(c, j) for j in range(k)) - n[i] * np.log(counts[:, c].sum() + 1)

        assert got[i] == (brown_lm.OPEN_CLASS if i == 3 else max(range(k - 2), key=odds))


@pytest.mark.parametrize("lookup", [100_000, 30, 0])
def test_scores_match_brute_force(spark, monkeypatch, lookup):
    """Counts, base and model scores of all texts, from the classes that each word got."""
    monkeypatch.setattr(brown_lm, "LOOKUP", lookup)
    monkeypatch.setattr(brown_lm, "FREQUENT", 20)
    monkeypatch.setattr(brown_lm, "ENDINGS", 6)
    monkeypatch.setattr(brown_lm, "ROUNDS", 2)
    rng = np.random.default_rng(8)
    a, b = [f"a{k}x" for k in range(40)], [f"b{k}y" for k in range(40)]
    texts = [" ".join(rng.choice(a if i % 2 else b, 30)) for i in range(60)]
    texts[10] = "neverx seeny " + texts[10] + " twice " + "long" * 40 + " twice"
    df = rows(spark, texts + ODD)
    got = brown_lm.scores(df).collect()
    assert len(got) == df.count()
    data = df.select("doc_id", "text").collect()
    key = lambda d: "" if d is None else str(d)
    split = lambda t: [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    end = "\0end"
    train = [split(r.text) for r in data if crc32(key(r.doc_id).encode()) % 10]
    counts = {}
    for ws in train:
        for w in [*ws, end]:
            counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)

    fitted = brown_lm.fit(df)
    of = dict(zip(fitted.listed, fitted.model.classes.tolist())) | {r.word: r.c for r in fitted.known.collect()} | {end: brown_lm.END_CLASS}
    assert set(of) == set(counts) and {r.word: r.n for r in fitted.known.collect()} == {w: n for w, n in counts.items() if w not in fitted.listed and w != end}
    ending = {r.ending: r.ec for r in fitted.endings.collect()}
    k, delta = brown_lm.CLASSES, brown_lm.DELTA
    cls = lambda w: of.get(w, ending.get(w[-2:], brown_lm.OPEN_CLASS))
    table, tokens, members = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for w, n in counts.items():
        tokens[cls(w)] += n
        members[cls(w)] += 1
    for ws in train:
        for x, y in zip([end, *ws], [*ws, end]):
            table[cls(x), cls(y)] += 1

    def model_score(ws):
        p = lambda x, y: (table[x, y] + delta) / (table[x].sum() + delta * k) * (counts.get(w, 0) + delta) / (tokens[y] + delta * (members[y] + 1))
        at, out = brown_lm.END_CLASS, 0.0
        for w in [*ws, end]:
            out += np.log10(p(at, cls(w)))
            at = cls(w)
        return out

    want = sorted(
        (r.doc_id is None, r.doc_id or 0, len(split(r.text)) + 1, sum(w in counts for w in [*split(r.text), end]),
         round(sum(np.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*split(r.text), end]), 5), round(model_score(split(r.text)), 5)) for r in data
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 60 and r.doc_id != 10]
    if lookup:
        assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_a_distribution(spark):
    df = spark.createDataFrame([(i, "red green blue red blue green up down " * 3) for i in range(30)], "doc_id long, text string")
    fitted = brown_lm.fit(df)
    m = fitted.model
    assert np.allclose((10**m.transition).sum(axis=1), 1)
    for c in range(brown_lm.CLASSES):
        ws = np.flatnonzero(m.classes[:-1] == c)
        mass = (10 ** m.log_count[ws]).sum() + brown_lm.DELTA
        assert np.isclose(mass / 10 ** m.class_norm[c], 1)
    assert brown_lm.scores(df.limit(0)).count() == 0


# --- the pipeline


def test_pipeline_by_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-duplicates", "mixing", "packing"]
    now, model = docs, toxicity_cnn.fit
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, data)
        if name != "packing":
            now = corpus_pipeline.stored(now)
            assert now.columns == docs.columns
        rows_before, kept = before.collect(), now.collect() if name != "packing" else None
        if name == "quality rules":
            want = quality_ledger.op4_quality_rules(spark, data).where("kept").select("doc_id").collect()
            assert {r.doc_id for r in want} == {r.doc_id for r in kept}
        if name == "toxicity":
            model = toxicity_cnn.fit(before, spark.read.parquet(f"{data}/labels.parquet"))
            scorer = toxicity_cnn.Scorer(model.network)
            assert {r.doc_id for r in kept} == {r.doc_id for r in rows_before if scorer.score(r.text) < model.thresholds.get(r.lang, 0.5)}
        if name == "near-duplicates":
            of = simhash_pigeonhole.components(before, simhash_pigeonhole.NEAR_COPIES).collect()
            assert {r.doc_id for r in kept} == {r.component_id for r in of} and len(kept) == len({r.root for r in of})
        if name == "mixing":
            sizes, taken, largest = {}, {}, {}
            for r in rows_before:
                n = len(r.text.split())
                sizes[r.source], largest[r.source] = sizes.get(r.source, 0) + n, max(largest.get(r.source, 0), n)
            for r in kept:
                taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
            for s, target in brute_targets(sizes).items():
                assert abs(taken.get(s, 0) - target) <= largest[s] / 2, s
        if name == "packing":
            ids = packing.word_ids(packing._tokenizer())
            check_pieces(now.collect(), {d: [ids.encode(r.text) + packing.END for r in rows_before if r.doc_id == d] for d in {r.doc_id for r in rows_before}})


def test_pipeline_run_and_odd_tables(spark, data, tmp_path):
    """run() gives what the stages give one by one, and leaves only what it is read from."""
    got = corpus_pipeline.run(spark, data)
    assert got.agg(F.sum("length")).first()[0] > 10_000
    plain = spark.read.parquet(f"{data}/documents.parquet")
    for stage in (s for _, s in corpus_pipeline.STAGES):
        plain = corpus_pipeline.stored(stage(spark, plain, data))
    key = lambda df: sorted((r.doc_id, r.start, r.ids_crc32) for r in df.where("filled_by = 'document'").collect())
    assert key(got) == key(plain)
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    words = " ".join(f"w{k}" for k in range(60))
    odd = rows(spark, [*ODD, words, words]).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "row": F.lit(1), "key": F.lit("k")})
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {len(ODD)}
    (tmp_path / "none").mkdir()
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    again = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("de").alias("lang"), F.concat(F.lit("copy "), F.col("id") % 9).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = toxicity_cnn.sample(docs.unionByName(again), labels)
    assert got.count() == got.select("doc_id").distinct().count() > 20


def test_slices_are_bounded_by_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(brown_lm, "SLICE_SIZE", 10)
    monkeypatch.setattr(brown_lm, "SLICE", 3)
    texts = ["", None, "aa", "b" * 9, "c" * 50, "d" * 10, "e", "f", "g", "h"]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [x.column(0).to_pylist() for x in brown_lm.slices([b.slice(1), b.slice(0, 0)])]
    assert sum(parts, []) == texts[1:]
    assert parts == [[None, "aa"], ["b" * 9], ["c" * 50], ["d" * 10], ["e", "f", "g"], ["h"]]
    lists = pa.RecordBatch.from_arrays([pa.array([[1] * 8, [], [1] * 3, [2] * 20])], ["ids"])
    assert [len(x) for x in brown_lm.slices([lists])] == [2, 1, 1]
