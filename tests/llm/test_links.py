"""Hard negatives, aliases of URLs and spelling variants against brute force and hand-made cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import packed_negatives as neg
from docloom.llm import spelling_kd as spell
from docloom.llm import url_aliases as url

# --- hard negatives


@pytest.mark.parametrize(("peak", "dims"), [(140, 64), (3, 8), (0, 4), (7, 0), (1 << 20, 64), (1 << 40, 5), (1 << 62, 3)])
def test_packed_products_are_exact(peak, dims):
    rng = random.Random(peak + dims)
    rows = lambda n: np.array([[float(rng.randint(-peak, peak)) for _ in range(dims)] for _ in range(n)]).reshape(n, dims)
    candidates, asked = rows(77), rows(9)
    packed = neg.Packed(candidates, float(np.abs(asked).max(initial=0)))
    got = packed.scores(asked)
    long = (1 << 63) - 1
    want = [[max(-long - 1, min(long, sum(int(a) * int(b) for a, b in zip(q, c)))) for c in candidates] for q in asked]
    assert [[int(v) for v in r] for r in got] == want
    assert packed.fields > 1 or packed.of is np.float64


def brute_negatives(rows, every):
    rows = [(v, (lab + 1) % 10 if v % 7 == 0 else lab, [int(np.floor(256 * x)) for x in e]) for v, e, lab in rows if None not in (v, e, lab) and all(x is not None and np.isfinite(x) for x in e)]
    anchors = {}
    for v, lab, t in rows:
        if v % every == 0:
            anchors[v] = min(anchors.get(v, (t, lab)), (t, lab))
    out = []
    for a, (t, lab) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(t, c)), v, k) for v, k, c in rows if v != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:5]:
            fit = [(n, v) for n, v, k in scored if k != lab and -50 * s <= -100 * n <= -95 * s][:3]
            out += [(a, p, i + 1, v, -s, -n) for i, (n, v) in enumerate(fit)]
    return sorted(out)


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    for name, value in {"BLOCK_ROWS": 16, "ANCHOR_GROUP": 3, "SPAN_BLOCKS": 2}.items():
        monkeypatch.setattr(neg, name, value)
    rng = random.Random(5)
    vector = lambda: [rng.choice((-0.5, 0.0, 0.25, 0.3, 0.5, 0.77)) for _ in range(rng.choice((3, 4, 4, 4)))]
    # one label has a third of the rows; ids and vectors repeat, so scores tie
    rows = [(v, vector(), rng.choice((1, 1, 1, 2, 3, 4, 8, 9))) for v in range(260)]
    rows += [(50, [0.5, 0.5, 0.5], 1), (50, [0.5, 0.5, 0.5], 1), (120, [0.5, 0.5], 2), (None, [0.5], 1), (7, None, 1), (8, [0.5, None], 1), (9, [float("nan")], 1), (10, [float("inf")], 1), (11, [0.5], None), (12, [], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, terms string").repartition(3)
    got = sorted(tuple(r) for r in neg.hard_negatives(df, every=10).collect())
    assert got == brute_negatives(rows, 10)
    assert neg.hard_negatives(df.limit(0)).count() == 0
    assert neg.hard_negatives(df.where("label = 1 and vec_id % 7 <> 0")).count() == 0


# --- aliases of URLs


def test_rules(spark):
    urls = ["http://WWW.Example.com/en/x", "https://a.example.com/en/1?q=/de/", "http://example.com", "http://x.net/es/", "http://net/fr/a#b", "http://notnet/fr/", "http://a.org/", "mailto:a@b", "", None, "http://example.com/EN/", "a://b://c.com/x"]
    df = spark.createDataFrame([(i, u, None, "own") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in url.judged(df).collect()}
    assert [got[i].rule for i in range(12)] == ["www.example.com/en/", "example.com/en/", None, "net/es/", "net/fr/", None, None, None, None, None, "com/", None]
    assert [got[i].verdict for i in range(12)] == ["allow", "block", "allow", "block", "block", *["allow"] * 7]
    assert (got[11].host, got[11].path) == ("b:", "//c.com/x") and (got[9].host, got[9].path, got[9].reason) == ("", "", "default")
    assert got[0].host == "www.example.com" and url.judged(df.limit(0)).count() == 0


def test_links_are_resolved(spark):
    base = "http://h.org/a/b/c?x=1"
    cases = {"http://o.org/z": "http://o.org/z", "//o.org/z": "http://o.org/z", "/z/../y?q#f": "http://h.org/y?q#f", "d": "http://h.org/a/b/d", "../d/./e": "http://h.org/a/d/e", "?y=2": "http://h.org/a/b/c?y=2", "../../../..": "http://h.org/"}
    cases |= {"#top": None, "": None, "mailto:x@y": None, "javascript:void(0)": None, "  z&amp;w  ": "http://h.org/a/b/z&w", ".": "http://h.org/a/b/"}
    df = spark.createDataFrame([(base, k) for k in cases], "base string, link string")
    from pyspark.sql import functions as F

    got = {r.link: r.to for r in df.select("link", url.resolved(F.col("base"), F.col("link")).alias("to")).collect()}
    assert got == cases


def link(href):
    return f"<head><LINK href='{href}' rel=\"canonical\"></head>"


def test_aliases_take_decisions(spark):
    far = "x" * 100_000
    pages = [
        (0, "http://one.org/a", link("http://two.org/b")),  # a chain that ends at a blocked URL
        (1, "http://two.org/b#frag", f'{far}<meta content="0; URL=http://x.net/es/1" http-equiv=refresh>'),
        (2, "HTTP://ONE.org:80/a", None),  # the same resource as page 0
        (3, "http://three.org/", link("http://x.net/fr/2")),
        (4, "http://four.org/", link("http://x.net/fr/2")),
        (5, "http://five.org", link("http://three.org/") + link("http://www.example.com/en/")),  # allowed, which frees 3 and 4
        (6, "http://x.net/fr/2", ""),  # its own rule stands
        (7, "http://six.org/", '<link rel="stylesheet" href="http://x.net/es/1"><meta name="refresh" content="0;url=http://x.net/es/1">'),
        (8, "http://seven.org/", link("http://eight.org/")),
        (9, None, link("http://x.net/es/1")),
        (0, "http://one.org/a", link("http://two.org/b")),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, key int")
    got = {r.page_id: (r.verdict, r.reason, r.aliases) for r in url.judged(df).collect()}
    want = {0: ("block", "alias", 3), 1: ("block", "alias", 3), 2: ("block", "alias", 3), 3: ("allow", "alias", 5), 4: ("allow", "alias", 5), 5: ("allow", "alias", 5), 6: ("block", "rule", 5)}
    want |= {7: ("allow", "default", 1), 8: ("allow", "default", 2), 9: ("allow", "default", 1)}
    assert got == want and url.judged(df).count() == 11
    log = spark.createDataFrame([("http://six.org/", "http://seven.org/"), ("http://eight.org/", "http://y.net/es/"), (None, "http://a.org/")], "source string, target string")
    more = {r.page_id: (r.verdict, r.aliases) for r in url.judged(df, redirects=log).collect()}
    assert more[7] == more[8] == ("block", 4) and more[0] == ("block", 3)


def test_a_third_of_the_pages_with_one_alias(spark):
    pages = [(i, f"http://h{i}.org/", link("http://hub.org/") if i % 3 == 0 else "") for i in range(600)] + [(600, "http://hub.org/", link("http://x.net/es/"))]
    got = url.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).where("verdict = 'block'")
    assert got.count() == 201 and got.agg({"aliases": "min"}).first()[0] == 202


# --- spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    low, count = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 6
    n = {w: k for w, k in count.items() if k >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [8192, 12])
def test_variants_match_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(spell, "CELL_WORDS", cell)
    monkeypatch.setattr(spell, "PIECE_WORDS", 5 if cell == 12 else 32768)
    rng = random.Random(2)
    stems = ["".join(rng.choices("abcdeÀéÿ×", k=rng.choice((6, 6, 7, 8, 12)))) for _ in range(60)] + ["aaabbb", "ababab", "bbbaaa"]
    pool = []
    for stem in stems:
        w = stem
        for times in (650, 120, 24, 5):  # chains of forms, anagrams, repeated letters
            pool += [w] * rng.choice((times, times // 2, 5))
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + rng.choice("abcé") + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + w[i + 1 :]))
    rng.shuffle(pool)
    rows = [(i, " ".join(pool[at : at + 40])) for i, at in enumerate(range(0, len(pool), 40))]
    long = "q" * 70_000
    rows += [(None, "Planet planet PLANET"), (None, "planet planet plane7t"), (10**6, None), (10**6 + 1, ""), (5, "planets planets planets planets planets")] * 2
    rows += [(k, f"{long} {long}x -- short words ÀÉÎ") for k in range(6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(4)
    got = sorted((tuple(r) for r in spell.variants(df).collect()), key=str)
    want = brute_variants(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] and r[1] != r[2] for r in want) and ("planet", None, "planet", 10, 1, None) in want
    assert spell.variants(df.limit(0)).count() == 0


def test_boxes_prune(monkeypatch):
    monkeypatch.setattr(spell, "LEAF_WORDS", 16)
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(4000)})
    piece = spell.Piece(words, [5] * len(words))
    leaves = [len(rows) for _, rows in piece.tree.search(piece.points, 1, 1)]
    assert sum(leaves) < 0.25 * len(words) * len(piece.tree.leaves)
