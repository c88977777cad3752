"""Operators whose results are fixed: SQL, brute force or an exact round trip."""

import io
import zipfile
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import common, label_sharding, packing, quality_ledger, registry, token_offsets, topk_blocks, word_ids, zip_warc

ODD = [None, "", " \n\t", "one", "word " * 30, "same line here\n" * 40, "Ünïcode – 中文 <|endoftext|> 12,5 ½ it's", "x" * 30_000, "tokens and words " * 4000, "a\x1cb\x0bc", "THE SAME TEXT", "THE SAME TEXT"]


def rows(spark, texts=ODD):
    data = [(i, t, "shard", 7) for i, t in enumerate(texts)] + [(None, "null id", None, None), (3, "one", "again", 1), (3, "one", "again", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, slot string, size long")


def test_sql_queries(spark, data):
    con = duckdb.connect()
    for t in "documents embeddings pages".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, data).collect(), con.sql(sql)
        by = {c: i for i, c in enumerate(want.columns)}
        assert sorted(by) == sorted(got[0].asDict()), name
        assert sorted(map(str, ([r[c] for c in by] for r in got))) == sorted(map(str, map(list, want.fetchall()))), name


# --- quality ledger


def brute_quality(text):
    import re

    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_ledger_matches_brute_force(spark):
    texts = [*ODD, "a b c d e f g h " * 3, "q " * 9, " ".join(map(str, range(50))) + " " + " ".join(map(str, range(10, 30))), "\n\na # b\n \na # b\n"]
    df = rows(spark, texts)
    got = {(r.row.doc_id, r.row.size): r for r in quality_ledger.ledger(df).collect()}
    for i, t in enumerate(texts):
        r = got[(i, 7)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), t
    stage = quality_ledger.accepted(spark, df, "")
    assert stage.columns == df.columns
    assert quality_ledger.accepted(spark, df.limit(0), "").count() == 0


def test_ablations_are_bitwise(spark, data):
    ledger = quality_ledger.ledger(spark.read.parquet(f"{data}/documents.parquet")).cache()
    for r in quality_ledger.ablations(ledger).collect():
        policy = next(p for p in quality_ledger.POLICIES if p.version == r.version)
        bit = 1 << quality_ledger.RULES.index(r.rule)
        bits = [x.fail_bits for x in ledger.select("fail_bits").collect()]
        assert r.fails == sum(b & bit != 0 for b in bits) and r.kept == sum(b & policy.mask == 0 for b in bits)
        assert r.kept_without == sum(b & policy.mask & ~bit == 0 for b in bits) and r.only_this == r.kept_without - r.kept
    assert {(r.kept, r.fails) for r in quality_ledger.ablations(ledger.limit(0)).collect()} == {(0, 0)}


# --- packing


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing._tokenizer()
    exact, own = Tokenizer.from_file(path), word_ids.WordIds(path)
    rng = np.random.default_rng(5)
    chars = [*map(chr, range(1, 0x180)), *"  \n\t'’中١ΣſK😀<|>½²_é̀"]
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(chars, 30)) for _ in range(1500)] + ["<|startoftext|>x"]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids, t


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(2)
    p = packing.SumOfSquares(32)
    for _ in range(400):
        size = int(rng.integers(1, 32))

        def total(level, p=p, size=size):
            n = p.count.copy()
            n[level] -= level > 0
            if level + size < 32:
                n[level + size] += 1
            return (n[1:32] ** 2).sum()

        fits = [0, *(h for h in range(1, 33 - size) if p.count[h])]
        assert total(p.level_for(size)) == min(map(total, fits))
        p.place([("d", 0, b"", 0)], size)


def check_pieces(pieces, want, capacity=2048):
    """Every id of every row (``want`` lists the rows' ids by document) in one piece, gapless
    sequences, no padding but at powers of two."""
    docs, sequences = {}, {}
    for r in pieces:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(want)
    for d, got in docs.items():
        left = {}  # rows that repeat an id: pieces follow each other in as many chains
        for ids in want[d]:
            left[len(ids) // 4, 0] = [*left.get((len(ids) // 4, 0), []), ids]
        for r in sorted(got, key=lambda r: r.start):
            open_ = left[r.doc_tokens, r.start]
            ids = next(x for x in open_ if crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32)
            open_.remove(ids)
            left.setdefault((r.doc_tokens, r.start + r.length), []).append(ids)
        assert all(not x for (n, at), x in left.items() if n != at), d
    for got in sequences.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


def test_packing_is_whole(spark, data, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing._tokenizer())
    exact = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
    by = lambda df: {d: [exact(x) for i, x in df if i == d] for d, _ in df}
    df = rows(spark)
    check_pieces(packing.packed(spark, df, "").collect(), by([(r.doc_id, r.text) for r in df.collect()]))
    assert packing.packed(spark, df.limit(0), "").count() == 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check_pieces(packing.op2_packing(spark, data).collect(), by(docs))


def test_open_windows_are_packed_again(spark, monkeypatch):
    """Three passes: most windows are filled by the rule, and the last rest does not grow."""
    monkeypatch.setattr(packing, "FAN", 3)
    rng = np.random.default_rng(9)
    texts = [" ".join(["word"] * int(rng.integers(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    out = packing.pack(df, packing._tokenizer(), capacity=32).cache()
    n = {r.filled_by: r.windows for r in packing.filled(out).collect()}
    assert n["rule"] > 5 * n["rest"] and n["document"] > 0
    assert {r.sequence_id >> 56 for r in out.select("sequence_id").collect()} == {0, 1, 2, 3}
    ids = packing.word_ids(packing._tokenizer())
    check_pieces(out.collect(), {i: [ids.encode(x) + packing.END] for i, x in enumerate(texts)}, 32)
    assert all(crc32(bytes(r.ids)) == r.ids_crc32 for r in out.collect())


# --- archives


def test_round_trip_and_revisits(spark):
    long = "<p>" + "x" * 200
    pages = [(1, "http://a/ü b", long, 1), (2, None, long, 2), (5, "http://c", None, 3), (6, "u", "", 4), (None, "n", long, 5), (7, "é", "<b>ü</b>" * 40, 6), (1, "again", long, 7), (8, "u\r\nX: y", "short", 8), (9, "u", "short", 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int")
    got = sorted(zip_warc.round_trip(df).collect(), key=lambda r: (r.page_id or 0, r.record_type, r.url or ""))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (None, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (9, "response", None),
    ]
    assert [r.payload for r in got if r.page_id == 7] == [bytearray(("<b>ü</b>" * 40).encode())]
    assert {r.stated_bytes for r in got if r.record_type == "revisit"} == {len(long)}
    facts = zip_warc.resolved(zip_warc.round_trip(df)).collect()
    assert len(facts) == len(pages) and {(r.payload_bytes, r.payload_digest) for r in facts if r.record_type == "revisit"} == {(len(long), sha256(long.encode()).hexdigest())}
    assert zip_warc.round_trip(df.limit(0)).count() == 0 and zip_warc.resolved(zip_warc.round_trip(df.limit(0))).count() == 0


def test_revisits_must_meet_their_response(spark):
    rows = [(1, "u", "response", None, b"abc", sha256(b"abc").hexdigest(), 3), (2, "u", "revisit", 1, None, sha256(b"abc").hexdigest(), 3)]
    good = spark.createDataFrame(rows, zip_warc.RECORDS)
    assert {r.payload_bytes for r in zip_warc.resolved(good).collect()} == {3}
    for bad in ((2, "u", "revisit", 7, None, rows[1][5], 3), (2, "u", "revisit", 1, None, "00", 3), (2, "u", "revisit", 1, None, rows[1][5], 4)):
        with pytest.raises(Exception, match="no response"):
            zip_warc.resolved(spark.createDataFrame([rows[0], bad], zip_warc.RECORDS)).collect()


def test_many_archives_and_long_payloads(spark, monkeypatch):
    """A task closes several archives, and its records are read by several ranges and tasks."""
    monkeypatch.setattr(zip_warc, "ARCHIVE_BYTES", 5_000)
    monkeypatch.setattr(zip_warc, "RANGE_RECORDS", 3)
    monkeypatch.setattr(zip_warc, "READ_BYTES", 500)
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>" * (1 + i % 90)) for i in range(200)] + [(500, "http://long", "é<long payload>" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    manifest = zip_warc.write(df, zip_warc.shared_dir(spark))
    assert manifest.count() > 10 and manifest.agg(F.sum("records")).first()[0] == len(pages)
    got = zip_warc.read(manifest)
    assert got.rdd.getNumPartitions() > 8
    assert {(r.page_id, bytes(r.payload)) for r in got.collect()} == {(i, h.encode()) for i, _, h in pages}


def test_store_names():
    assert zip_warc.renamed("s3a://b/x") == "s3://b/x" and zip_warc.renamed("file:///tmp/x") == "file:///tmp/x" and zip_warc.renamed("/tmp/x") == "/tmp/x"


class Bytes(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(monkeypatch, wide):
    if wide:  # the writer then believes that everything is too large for the old fields
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    f = Bytes()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
        for k in range(5):
            z.writestr(f"dir/{k}.bin", bytes([k]) * (100 + k))
        z.comment = b"PK\x05\x06 in a comment"
    size = len(f.getvalue())
    found = zip_warc.members(f, size)
    assert (b"PK\x06\x06" in f.getvalue()) == wide
    for k in range(5):
        m = found[f"dir/{k}.bin"]
        assert f.read_at(m.size, zip_warc.data_start(f, m)) == bytes([k]) * (100 + k)
    with pytest.raises(ValueError):
        zip_warc.members(Bytes(b"no archive"), 10)


# --- token attribution


def test_attribution_matches_brute_force(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    texts = [*ODD, "one. two. three\n\n\nfour — ü\n", "日本語。\n\nテキスト"]
    for t in texts:
        starts, stops = token_offsets.spans(t or "", P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
        e = exact.encode(t or "", add_special_tokens=False)
        assert len(starts) == len(e.ids)
        for mark in ("\n", ". "):
            ends = token_offsets.section_ends(t or "", mark)
            for rule in token_offsets.RULES:
                counts, crossing = token_offsets.attribute(starts, stops, ends, rule)
                own = np.searchsorted(ends, np.arange(len(t or "")), side="right")
                want = np.zeros(len(ends), int)
                for a, b in zip(starts, stops):
                    inside = np.bincount(own[a:b], minlength=len(ends))
                    want[own[a] if rule == "start" else inside.argmax()] += 1
                assert counts.tolist() == want.tolist() and counts.sum() == len(starts)
                assert crossing.sum() == sum(own[a] != own[b - 1] for a, b in zip(starts, stops))
    df = rows(spark)
    got = token_offsets.token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum((F.col("section") == 0).cast("int") * F.col("doc_tokens")).alias("d")).where("n <> d").count() == 0
    assert got.select("doc_id").distinct().count() == len(ODD) + 1 and token_offsets.token_counts(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_query_and_rules_through_spark(spark, data):
    """op5's rows and both rules against a count of characters, odd and repeated rows among them."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True

    def brute(text, rule, mark):
        text = text or ""
        parts = text.split(mark)
        parts = [p + mark for p in parts[:-1]] + [parts[-1]] * (parts[-1] != "" or len(parts) == 1)
        own = [k for k, p in enumerate(parts) for _ in p]
        counts, cross, at = [0] * len(parts), [0] * len(parts), np.cumsum([0, *map(len, parts)])
        spans = token_offsets.spans(text, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
        assert len(spans[0]) == len(exact.encode(text, add_special_tokens=False).ids)
        for a, b in zip(*spans):
            inside = [own[a:b].count(k) for k in range(len(parts))]
            counts[own[a] if rule == "start" else inside.index(max(inside))] += 1
            cross[own[a]] += own[a] != own[b - 1]
        return [(k, int(at[k]), int(at[k + 1]), counts[k], cross[k], len(spans[0])) for k in range(len(parts))]

    few = [t for t in ODD if t is None or len(t) < 2000] + ["one. two. three\n\n\nfour — ü\n", "日本語。\n\nテキスト"]
    df = rows(spark, few)
    for rule in token_offsets.RULES:
        for mark in ("\n", ". "):
            got = token_offsets.token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, rule, mark)
            want = [(r.doc_id, *x) for r in df.collect() for x in brute(r.text, rule, mark)]
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), (rule, mark)
    docs = [r for r in spark.read.parquet(f"{data}/documents.parquet").collect() if len(r.text) < 3000]
    got = {}
    for r in token_offsets.op5_token_counts(spark, data).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for r in docs[:60]:
        assert sorted(got[r.doc_id]) == brute(r.text, "start", "\n")


# --- top-k


def test_topk_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_blocks, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk_blocks, "PIECE_BLOCKS", 2)
    monkeypatch.setattr(topk_blocks, "QUERY_GROUP", 1)
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=6).round(1).tolist() for i in range(60)} | {100: [1e6] * 6, 200: [0.5, 0.5], 300: [], 301: [1.0, None], 302: [float("nan")] * 6, 303: None, 304: [float("inf")] * 6, 400: [-3e12, 1.0]}
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()] + [(None, [1.0], 1)], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in topk_blocks.top_k(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    terms = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors.items() if v is not None and not any(x is None or not np.isfinite(x) for x in v)}
    for q in (0, 100, 200, 300, 400):
        scored = sorted((-sum(a * b for a, b in zip(terms[q], v)), i) for i, v in terms.items() if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, -s, i) for n, (s, i) in enumerate(scored)], q
    assert set(got) == {0, 100, 200, 300, 400} and topk_blocks.top_k(df.limit(0)).count() == 0


def test_topk_skips_pieces_and_keeps_ties(spark, monkeypatch):
    """Vectors in clusters: bounds leave most pieces out; equal scores at the bound stay, and so do
    rows that repeat an id."""
    for name, n in (("BLOCK_ROWS", 8), ("PIECE_BLOCKS", 2), ("SPAN_PIECES", 3), ("QUERY_GROUP", 2)):
        monkeypatch.setattr(topk_blocks, name, n)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12))
    data = [(i, (centres[i // 100] + rng.normal(size=12) * 0.02).round(2).tolist()) for i in range(800)]
    data = [(i, centres[i // 100].tolist() if i % 7 == 0 else v) for i, v in data]  # ties at the top
    data += [(300, [0.1] * 12), (301, data[301][1]), (301, data[301][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    stats = topk_blocks.pruning(df).first()
    assert stats.queries == 8 and stats.skipped > 0.5 * stats.queries * stats.pieces and stats.scored + stats.skipped == stats.queries * stats.pieces
    terms = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in data]
    got = {}
    for r in topk_blocks.top_k(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    for q in range(0, 800, 100):
        x = min(v for i, v in terms if i == q)
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in terms if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, -s, i) for n, (s, i) in enumerate(scored)], q


# --- sharding


def check_shards(got, n, shards=24):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_sharding_law_and_links(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = label_sharding.op10_sharding(spark, data).collect()
    check_shards(got, len(docs))
    want = {r.doc_id: (len(r.text.encode()) + 8, crc32(r.text.encode())) for r in docs}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == want
    texts = ["hot"] * 70 + ["twin a", "twin a", "twin b", "twin b", "twin b"] + [f"own {i}" for i in range(120)] + [None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(5, "hot", "x"), (None, "hot", "y")], "doc_id long, text string, shard string")
    out = label_sharding.shard(df).cache()
    check_shards(out.collect(), df.count())
    shards = lambda t: {r.shard for r in out.collect() if r.text_crc32 == crc32(t)}
    assert len(shards(b"twin a")) == len(shards(b"twin b")) == 1
    cut = label_sharding.cut_links(out).first()
    assert cut.groups == 4 and cut.cut <= 72 - 9
    assert label_sharding.shard(df.limit(0)).count() == 0


def test_rows_whose_hashes_meet_stay_apart(spark, monkeypatch):
    """All rows get one hash: none is lost or doubled, and groups still come together."""
    monkeypatch.setattr(label_sharding, "_hash", lambda *parts: F.lit(5).cast("long"))
    texts = ["hot"] * 30 + ["a", "a", "b", "b", "b"] + [f"own {i}" for i in range(40)]
    df = spark.createDataFrame([(i % 37, t) for i, t in enumerate(texts)] + [(1, "hot")] * 5, "doc_id long, text string")
    out = label_sharding.shard(df, 5).collect()
    check_shards(out, df.count(), 5)
    assert sorted((r.doc_id, r.text_crc32) for r in out) == sorted((r.doc_id, crc32(r.text.encode())) for r in df.collect())


def test_moves_keep_to_quotas():
    """Moves that the rates allow never bring a shard beyond its quota but by exchange."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        load = rng.integers(5, 50, 6).astype(float)
        wishes = rng.integers(0, 6, (6, 6)) * (1 - np.eye(6))
        quota = np.full(6, 30.0)
        moved = label_sharding.allowed(load, wishes, quota) * wishes
        assert (moved <= wishes + 1e-9).all()
        after = load + moved.sum(axis=0) - moved.sum(axis=1)
        assert (after <= np.maximum(quota, load) + 1e-9).all()


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).alias("k"), "id", F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("v"))
    got = common.running(df, ["g"], ["k", "id"], {"v": "before"}).collect()
    for g in range(3):
        at = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.k, r.id)):
            assert r.before == at
            at += r.v or 0


def test_scratch_deletes_what_stays_listed(spark):
    with common.scratch(spark) as made:
        gone, kept = common.stored(spark.range(3)), common.stored(spark.range(4))
        made.pop()
    assert kept.count() == 4
    with pytest.raises(Exception):
        gone.count()


def test_numbered_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).alias("k"), "id")
    got = common.numbered(df, ["g"], ["k", "id"]).collect()
    for g in range(3):
        mine = sorted((r.k, r.id, r.slot) for r in got if r.g == g)
        assert [s for *_, s in mine] == list(range(len(mine)))
