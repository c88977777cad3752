"""Findings on larger tables: each case failed before its change."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docloom.operators import language as L
from docloom.operators import layout, vectors
from docloom.sources import made, pdf


def test_a_packed_stream_and_a_font_are_read_once_a_file(monkeypatch):
    """objects of one packed stream unpack it once, and pages share their fonts."""
    unpacked, fonts = [], []
    inside, font = pdf.Pdf._inside, pdf.font
    monkeypatch.setattr(pdf.Pdf, "_inside", lambda self, s: unpacked.append(1) or inside(self, s))
    monkeypatch.setattr(pdf, "font", lambda p, about: fonts.append(1) or font(p, about))
    import io

    pages = list(pdf._read_pages(io.BytesIO(made.pdf([["one two"], ["three"], ["four"]], newer=True)), "x"))
    assert [[w[-1] for w in pdf._words(p[6], pdf._fonts(p[5]), p[3])] for p in pages] == [["one", "two"], ["three"], ["four"]]
    assert len(unpacked) == len(fonts) == 1


def test_words_of_even_runs_are_those_of_their_glyphs():
    """a run without blanks is one piece where nothing can part it; spacing and turns still do."""
    f = {"F": {"wide": 1, "chars": {c: chr(c) for c in range(32, 127)}, "widths": {}, "other": 500.0, "bold": False}}
    even = b"BT /F 10 Tf 20 700 Td (one  two) Tj (three four) Tj ET"
    assert [w[-1] for w in pdf._words(even, f, 800)] == ["one", "twothree", "four"]
    assert [g[0] for g in pdf.glyphs(even, f)][:3] == [20.0, 25.0, 30.0]
    assert [(w[1], w[3]) for w in pdf._words(even, f, 800)] == [(20.0, 35.0), (45.0, 85.0), (90.0, 110.0)]
    assert [w[-1] for w in pdf._words(b"BT /F 10 Tf 4 Tc (ab) Tj ET", f, 800)] == ["a", "b"]
    assert [w[-1] for w in pdf._words(b"BT /F 10 Tf 0 1 -1 0 9 9 Tm (ab) Tj ET", f, 800)] == ["a", "b"]
    assert [w[-1] for w in pdf._words(b"BT /F 10 Tf [(a) -900 (b) 10 (c)] TJ ET", f, 800)] == ["a", "bc"]


def test_lines_meet_no_join(spark):
    """what a line is about is told with its words, not joined to them."""
    words = spark.createDataFrame([(1, 0, 0.0, 10.0, 5.0, 20.0, 10.0, False, "a"), (1, 1, 6.0, 10.0, 9.0, 20.0, 12.0, True, "b")], "page int, n int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, text string")
    lines = layout.lines_of(words, ["page"])
    assert "Join" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in lines.select("page", "line", "text", "rtl", "size", "bold", "top", "left").collect()] == [(1, 1, "a b", False, 12.0, True, 10.0, 0.0)]


def test_rows_of_one_file_are_work_for_all_cores(spark, data):
    """papers and names are made of a small file's rows by more than one task."""
    from docloom.plans import retrieval

    assert all(retrieval.read(spark, data, t).rdd.getNumPartitions() == 4 for t in ("orders", "customer", "part", "supplier"))


def test_a_text_of_hints_is_worked_out_once(spark, data):
    """not once more for each hint that is looked for in it."""
    from docloom.plans import filing

    plan = filing.document_types(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2


def test_plain_text_is_folded_by_its_blanks_alone(spark):
    """What ASCII text can't hold is not looked for in it, stopwords are not an array; terms stay."""
    from pyspark.sql import functions as F

    from docloom.functions import text as T

    rows = [(" A \t\tb\n c  D ",), ("قيمةُ   العقد\t٤٥",), ("the cost of AB-12 and AB-12, a 7",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    assert [r.n for r in df.select(T.normalize(F.col("t")).alias("n")).collect()] == ["a b c d", "قيمه العقد 45", "the cost of ab-12 and ab-12, a 7", "", None]
    terms = df.select(T.content(F.col("t")).alias("c"), T.tokens(F.col("t")).alias("k"))
    assert "array_except" not in terms._jdf.queryExecution().analyzed().toString()
    assert terms.collect()[2].c == ["12", "7", "ab-12", "cost"] and terms.collect()[2].k[-1] == "7"


def test_terms_of_evidence_are_worked_out_before_they_are_filtered(spark, data):
    """what an item is described by is no part of the filters and sorts that use it."""
    from docloom.plans import checks

    plan = checks.bound_evidence(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(array_union" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "array_union" in line]


def test_markdown_files_are_read_in_a_fixed_number_of_tasks(spark, tmp_path):
    """not in a task for every thirty-two of them, however small they are."""
    from docloom.sources import files

    for k in range(200):
        (tmp_path / f"{k}.md").write_text(f"---\ntitle: T{k}\n---\nbody {k}")
    (tmp_path / "other.txt").write_text("no")
    found = files.markdown(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 4
    assert {(r.meta["title"], r.body) for r in found.collect()} == {(f"T{k}", f"body {k}") for k in range(200)}


def test_labels_are_not_searched_for_facts_without_one(spark, data):
    """terms that name labels need no patterns; labelled facts are the same with and without them."""
    from pyspark.sql import functions as F

    from docloom.operators import entities as N
    from docloom.plans import entities

    assert "Sub-?Clause" not in entities.ambiguous_labels(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    papers = entities._papers(spark, data).limit(50)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(N.labelled(papers, "o_orderkey", F.col("text"))) == rows(N.entities(papers, "o_orderkey", F.col("text")).where("label <> ''"))


def test_f25_lessons_fold_a_character_once(monkeypatch):
    """Messages are of few characters: each is folded once, not at every place where it stands."""
    folded = []
    fold = L.T.fold
    monkeypatch.setattr(L.T, "fold", lambda text: folded.append(text) or fold(text))
    if hasattr(L, "_character"):
        L._character.cache_clear()
    found = [L.lesson(f"remember that the delivery fee of zone {i} is 12 AED") for i in range(1000)]
    assert found[7] == ("fact", 0.65, "the delivery fee of zone 7 is 12 AED")
    assert len(folded) < 100


def test_f28_cells_come_once_for_all_queries_of_a_task():
    """Not with every query: 4,000 queries of 1,000 cells, a few at once."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(1000, 8))
    cells = [{"cell": i, "n": 3, "low": 0.1, "high": 0.4} for i in range(1000)]
    kind = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())]))
    x, n = rng.normal(size=(4000, 8)), 4002
    columns = [
        pa.array(["a"] * 4001 + ["b"]), pa.array([0] * n, pa.int32()), pa.array([0] + [1] * 4001, pa.int32()), pa.array([None, *range(4001)], pa.int64()),
        pa.array([None, *x.tolist(), x[0].tolist()], pa.list_(pa.float64())), pa.array([None] * n, pa.float64()), pa.array([cells] + [None] * 4001, kind),
    ]
    batch = pa.RecordBatch.from_arrays(columns, ["by", "salt", "side", "vec_id", "unit", "floor", "cells"])
    tracemalloc.start()
    seen = [b.to_pydict() for b in vectors._reaching(iter([batch]), centres, 10) if b.num_rows]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and max(len(b["vec_id"]) for b in seen) <= 64 * 4
    got = {q: {c for b in seen for v, c in zip(b["vec_id"], b["cell"]) if v == q} for q in (0, 3999, 4000)}
    near = lambda q: set(np.linalg.norm(centres - x[q], axis=1).argsort()[:4].tolist())
    assert got == {0: near(0), 3999: near(3999), 4000: set()}
