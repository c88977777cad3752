"""Rules on small examples: numbers in words, measurements, lessons, chunks, layouts, scopes, verdicts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from docloom.functions import numbers
from docloom.functions import text as T
from docloom.functions import vocabulary as V
from docloom.operators import checks, entities, expansion, filing, knowledge, language, layout, measures
from tests.test_operators import values


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("مئة وعشرون يومًا", [120]), ("خمسة و عشرون", [25]), ("ثلاثة عشر", [13]), ("ألفان وخمسمئة درهم", [2500]), ("ثلاثمائة ألف", [300_000]), ("مليون ومئتان", [1_000_200]),
        ("يومين", [2]), ("كل واحد", []), ("عشر قيمة العقد", []), ("واحد وعشرون", [21]), ("thirty-two thousand and five", [32_005]), ("one hundred", [100]), ("one day", []),
        ("two million three hundred thousand", [2_300_000]), ("no figures", []), ("ten days, then fifteen", [10, 15]),
    ],
)
def test_numbers_in_words(text, want):
    assert [v for v, _, _ in numbers.found(numbers.normal(text))] == want


def test_english_numbers_round_trip(spark):
    from pyspark.sql import types as ty

    vs = [0, 2, 17, 40, 58, 100, 342, 1000, 20_000, 99_999_999]
    df = spark.createDataFrame([(v,) for v in vs], ty.StructType([ty.StructField("v", ty.LongType())])).withColumn("t", numbers.english("v"))
    got = {r.v: r.value for r in numbers.spelled(df.select("v", "t"), "v", "t").collect()}
    assert got == {v: v for v in vs}


def test_stems_and_tokens(spark):
    assert values(spark, T.stem(F.col("x")), ["السيناريوهات", "والعقد", "عقد", "Contract", "بها"]) == ["سيناريوه", "عقد", "عقد", "Contract", "بها"]
    assert values(spark, T.tokens(F.col("x")), ["The fee of AB-12/x is 5"])[0] == ["ab-12/x", "ab", "12", "fee", "ab", "12", "5"]
    assert T.fold("إدارةٌ ملغى") == "اداره ملغي"


def test_one_measurement_and_seven_that_are_none(spark):
    texts = [
        "delay notice period 30 days", "11. section number heading 40 items", "ruling of the court 2026", "signed contract on 12/03/2026 today", "reference code fb-2026-147 total", "number 12", "third item list 5", "paid sum amount 1,234.50",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = measures.measurements(df, ["i"], F.col("t")).collect()
    assert [(r.i, r.value, r.unit, list(r.label)) for r in got] == [(0, "30", "days", ["delay", "notice", "period"])]
    assert measures.measurements(df.limit(0), ["i"], F.col("t")).count() == 0


def test_conflicts_need_attribute_unit_and_values(spark):
    rows = [("c", 1, "delivery notice period 30 days"), ("c", 2, "delivery notice period 45 days"), ("c", 3, "delivery notice period 30 AED"), ("c", 4, "warranty term 12 months"), ("d", 5, "delivery notice period 60 days")]
    df = spark.createDataFrame(rows, "pool string, ref int, t string")
    got = measures.conflicts(measures.measurements(df, ["pool", "ref"], F.col("t")), "pool", "ref").collect()
    assert [(r.pool, r.a, r.b, r.left, r.right, r.shared) for r in got] == [("c", 1, 2, "30", "45", "delivery notice period")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Remember that the fee of zone two is 12 AED", ("fact", 0.65, "the fee of zone two is 12 AED")), ("from now on always show totals first", ("rule", 0.85, "always show totals first")),
        ("that is incorrect, the correct value is forty-two days", ("correction", 0.9, "forty-two days")), ("is that incorrect? yes", None), ("what is the fee of the second zone", None),
        ("تعلّم أن مدّة الضمان سنتان كاملتان", ("fact", 0.65, "مدّة الضمان سنتان كاملتان")), ("short", None), (None, None),
    ],
)
def test_lessons(text, want):
    assert language.lesson(text) == want


def test_relative_windows(spark):
    day = F.lit(date(2026, 8, 13))  # a Thursday
    w = language.window(F.col("x"), day)
    got = values(spark, w, ["past 10 days", "3 weeks ago", "last month", "two months ago", "last 3 days before the end", "yesterday", "this year", "nothing"])
    spans = [None if g is None or g.a is None else (g.a.isoformat(), g.b.isoformat()) for g in got]
    assert spans == [("2026-08-03", "2026-08-13"), ("2026-07-20", "2026-07-26"), ("2026-07-01", "2026-07-31"), ("2026-06-01", "2026-06-30"), None, ("2026-08-12", "2026-08-12"), ("2026-01-01", "2026-12-31"), None]


def test_dates_of_a_text(spark):
    got = values(spark, language.all_dates(F.col("x")), ["on 10/02/2026 and 10 فبراير 2026", "10 February 2026, 2026-03-01, 31/02/2026", "none", ""])
    assert [[d.isoformat() for d in x] for x in got] == [["2026-02-10"], ["2026-02-10"], [], []]


def test_synonyms_fire_on_whole_members(spark):
    df = spark.createDataFrame([(1, "غرامة تأخير"), (2, "delay of the boq"), (3, None)], "i int, t string")
    got = {}
    for r in language.expanded(df, "i", T.tokens(T.text_or_empty("t"))).collect():
        got.setdefault(r.i, set()).add(r.word)
    assert {"جزاء", "liquidated damages"} <= got[1] and "جدول الكميات" in got[2] and "delay penalty" not in got[2] and 3 not in got


def test_chunks_share_and_merge(spark):
    sizes = lambda xs: F.lit(xs) if xs else F.array().cast("array<int>")
    one = lambda c: [tuple(x) for x in spark.range(1).select(c.alias("c")).first().c]
    assert one(filing.packed(sizes([700, 600, 150, 90, 50]))) == [(0, 2, 1302), (2, 3, 294)]
    assert one(filing.packed(sizes([800, 150, 600]))) == [(0, 2, 952), (1, 2, 752)]
    assert one(filing.packed(sizes([]))) == []
    assert one(filing.greedy(sizes([600, 700, 300]), F.lit(1400), F.lit(50))) == [(0, 2, 1352), (2, 1, 351)]
    units = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("chars"), F.lit(p).alias("parent"), F.lit(0).alias("place"), F.lit(10).alias("head")) for i, (n, p) in enumerate([(50, 1), (300, 1), (20, 2), (30, 3)])])
    assert [(m.anchor, m.n, m.chars) for m in spark.range(1).select(filing.merged_units(units).alias("c")).first().c] == [(1, 2, 363), (2, 1, 20), (3, 1, 30)]


def test_overlap_pairs_match_all_pairs(spark):
    import random

    rng = random.Random(2)
    sets = {i: sorted(rng.sample("abcdefghij", rng.randrange(1, 7))) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id int, ts array<string>")
    got = {(r.l, r.r) for r in filing.overlap_pairs(df, df, 0.6).collect()}
    share = lambda a, b: len({*a} & {*b}) / min(len(a), len(b))
    assert got == {(i, j) for i in sets for j in sets if share(sets[i], sets[j]) >= 0.6}
    items = df.select(F.col("id").alias("item"), F.col("ts").alias("terms"))
    cover = {(r.q, r.item) for r in knowledge.covering(df.select(F.col("id").alias("q"), "ts"), items, 0.34).collect()}
    assert cover == {(i, j) for i in sets for j in sets if len({*sets[i]} & {*sets[j]}) / len(sets[i]) >= 0.34}


def test_borderless_table(spark):
    """A centred letterhead does not close the lanes; a line without a label fills the row above."""
    page = [(60.0, 40, 300, "ACME HOLDING STATEMENT")] + [
        w for i, (label, a, b) in enumerate([("Cash", "10", "12"), ("Loans", "250", "(30)"), ("Stock", "", "-"), ("", "7", ""), ("Total", "267", "22")])
        for w in [(80.0 + 12 * i, 20, 60, label), (80.0 + 12 * i, 200, 230, a), (80.0 + 12 * i, 300, 330, b)] if w[3]
    ]
    prose = [(20.0 + 12 * i, 20 + 50 * k, 66 + 50 * k, "word") for i in range(5) for k in range(6)]
    df = spark.createDataFrame([(d, float(x0), float(x1), y, t) for d, ws in ((1, page), (2, prose)) for y, x0, x1, t in ws], "doc int, x0 double, x1 double, y double, text string")
    got = layout.tables(layout.layout_cells(df, "doc"), "doc").orderBy("row").collect()
    assert {r.doc for r in got} == {1}
    assert [list(r.cells) for r in got][-4:] == [["Cash", "10", "12"], ["Loans", "250", "(30)"], ["Stock", "7", "-"], ["Total", "267", "22"]]


def test_heading_tiers(spark):
    rows = [("style", i, f"text {i}", 1 if i < 3 else None, False) for i in range(6)] + [("number", i, f"{i}.{i} Part" if i < 3 else "Team = all", None, True) for i in range(5)] + [("shape", i, "Bold line", None, i == 0) for i in range(6)] + [("dense", i, "Bold line", None, True) for i in range(4)]
    p = spark.createDataFrame(rows, "doc string, ord int, text string, style int, bold boolean")
    got = {}
    for r in layout.headings(p, "doc").collect():
        got.setdefault(r.doc, []).append((r.ord, r.level))
    assert {d: sorted(x) for d, x in got.items()} == {"style": [(0, 1), (1, 1), (2, 1)], "number": [(0, 2), (1, 2), (2, 2)], "shape": [(0, 1)]}


def test_document_scope(spark):
    docs = spark.createDataFrame([(1, "MAJED_VILLA_v1.pdf"), (2, "MAJED_VILLA_v2.pdf"), (3, "harbour tower.docx"), (4, "harbour tower annexe north.docx"), (5, "contract.pdf")], "document int, filename string")
    asked = {
        "a": "what is in majed_villa_v2.pdf", "b": "fees of the majed villa", "c": "fees of majed villa v1", "d": "fees of harbour tower annexe north", "e": "compare majed villa and harbour tower", "f": "what does the contract say", "g": "harbour tower fees",
    }
    q = spark.createDataFrame(list(asked.items()), "q string, text string")
    got = {r.q: (r.decision, r.document, r.n) for r in expansion.document_scope(q, docs).collect()}
    assert got == {"a": ("file", 2, 1), "b": ("ambiguous", 1, 2), "c": ("version", 1, 1), "d": ("longest", 4, 1), "e": ("several", 1, 3), "g": ("document", 3, 1)}


def test_reserved_slots_go_first(spark):
    rows = [(1, k, f"s{k % 3}", k >= 4, k, 0.1, k + 1 if k < 4 else None) for k in range(8)] + [(2, 0, "s", True, 5, 0.1, 1), (2, 1, "t", False, 9, 0.1, 2)]
    pool = spark.createDataFrame(rows, "item_id int, doc_id int, section string, dated boolean, day int, fused double, final int")
    got = {}
    for r in expansion.reserved(pool, "item_id", 2, 4, [F.desc("day"), F.col("doc_id")]).orderBy("place").collect():
        got.setdefault(r.item_id, []).append((r.doc_id, r.reserved))
    assert got == {1: [(7, True), (6, True), (0, False), (1, False)], 2: [(0, False), (1, False)]}


def test_rights(spark):
    rows = [("admin", "global", False), ("knowledge_manager", "global", True), ("knowledge_manager", "team", True), ("knowledge_manager", "team", False), ("contributor", "user", True), ("nobody", "user", True)]
    df = spark.createDataFrame(rows, "role string, scope string, same boolean")
    assert [r.ok for r in df.select(knowledge.may_approve(F.col("role"), F.col("scope"), F.col("same")).alias("ok")).collect()] == [True, False, True, False, False, False]


def test_answers_are_held_against_evidence(spark):
    left = checks.unsupported(F.lit("Paid 1,500 AED and 777 [12]"), F.lit("the sum of 1500 AED"))
    r = spark.range(1).select(left.alias("wrong"), checks.cited(F.lit("a [2] b [10] c [2]")).alias("cited"), checks.present(F.lit("Majed Al Hammadi"), F.lit("majed hammadi signed")).alias("named")).first()
    assert list(r.wrong) == ["777"] and list(r.cited) == [2, 10] and r.named
    one, two = {"a": F.lit(1), "b": F.lit(2)}, {"a": F.lit(2), "b": F.lit(2)}
    assert list(spark.range(1).select(checks.better(one, two), checks.better(two, one), checks.better(one, one)).first()) == [True, False, False]


def test_entities_of_a_paper(spark):
    text = "| Fee | 5% |\n| --- | --- |\n| Item | Value |\nSigned 05/03/2026, 30 days, Plot 12 under Clause 4.2, ref PO-2024-0005 by Harbour Marine Contracting. المهندس / احمد علي"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string")
    got = {(r.kind, r.value, r.label) for r in entities.entities(df, "i", T.text_or_empty("t")).collect()}
    assert got == {("percentage", "5%", "Fee"), ("date", "05/03/2026", ""), ("duration", "30 days", ""), ("location", "Plot 12", ""), ("clause", "Clause 4.2", ""), ("identifier", "PO-2024-0005", ""), ("organization", "Harbour Marine Contracting", ""), ("person", "المهندس / احمد علي", "")}
    assert values(spark, entities.classify(F.col("x")), ["1,500 AED", "12/03/2026", "blue", "AB-12345"]) == ["amount", "date", "attribute", "identifier"]


def test_standing_and_headings(spark):
    assert values(spark, filing.standing(T.normalize(F.col("x"))), ["the final version", "superseded by the final version", "renewed", "المأمورية النافذة"]) == ["current", "superseded", "unknown", "current"]
    assert values(spark, filing.bookkeeping(T.normalize(F.col("x"))), ["Version history of it", "indexes", "هذا الملف"]) == ["version history", "", "هذا الملف"]
    assert len(V.INTENTS) == 8


def test_texts_held_whole(spark):
    import random

    from docloom.operators import retrieval

    rng = random.Random(6)
    piece = lambda: "".join(rng.choices("ab .-éB", k=rng.randrange(0, 9)))
    docs = [(0, "say xxhello worldyy now"), (1, "hello world"), (2, "Hello World"), (3, None), (4, ""), (5, "one two three four")] + [(i, " ".join(piece() for _ in range(8))) for i in range(6, 80)]
    asked = [(0, "hello world"), (1, "wo three fou"), (2, ""), (3, None), (4, "two nine three"), (5, "é"), (6, "- ."), (7, " two "), (8, "wo")] + [(i, piece() + " " + piece()) for i in range(9, 60)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    got = sorted(tuple(r) for r in retrieval.holding(q, "item_id", d, "doc_id", "text").collect())
    assert got == sorted((i, k) for i, a in asked for k, b in docs if a is not None and b is not None and a in b)
    assert (0, 0) in got and (1, 5) in got


def test_known_beginnings(spark):
    import random

    from docloom.operators import expansion

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("aaabé中", k=rng.randrange(1, 8)))
    vocabulary, asked = {word() for _ in range(150)} | {"q" * 3000}, {word() for _ in range(400)} | {"q" * 2000, "q" * 4000, "qq", "zzz"}
    column = lambda ws: spark.createDataFrame([(w,) for w in ws], "term string").repartition(3)
    got = {r.term for r in expansion.known_stems(column(asked), column(vocabulary)).collect()}
    known = lambda t: t in vocabulary or len(t) > 2 and any(len(w) > 2 and (w.startswith(t) or t.startswith(w)) for w in vocabulary)
    assert got == {t for t in asked if known(t)} and len(got) < len(asked)
    assert expansion.known_stems(column(asked), column([])).count() == 0


def test_titles_before_prose_are_no_names(spark):
    from docloom.operators import entities

    texts = ["قال الخبير في المحضر كذا", "المهندسة فاطمة علي حضرت", "د. سالم خالد", "مبلغ 1,250.50 د.إ فقط", "see form A1-99x and HR-F-12", "شركة البناء الحديث ذ.م.م"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {}
    for r in entities.entities(df, "i", F.col("t")).collect():
        got.setdefault(r.i, set()).add((r.kind, r.value))
    assert 0 not in got and ("person", "المهندسة فاطمة علي حضرت") in got[1] and ("person", "د. سالم خالد") in got[2]
    assert ("amount", "1,250.50 د.إ") in got[3] and {("form", "form A1-99x"), ("form", "HR-F-12")} <= got[4] and ("organization", "شركة البناء الحديث") in got[5]


def test_file_requests_keep_their_question(spark):
    cases = {
        "اعمل لي ملف pdf بأسعار البنود في أمر التغيير": ("pdf", "question", "أسعار البنود في أمر التغيير؟"),
        "Please give me the list of files in order 7 as a Word file": ("docx", "question", "give me the list of files in order 7؟"),
        "create an excel sheet of the fees for March": ("xlsx", "question", "sheet of the fees for March؟"),
        "export this to pdf": ("pdf", "last", None),
        "اعمل ملخص pdf": ("pdf", "conversation", None),
        "make a pdf of the whole conversation": ("pdf", "conversation", None),
        "what is in contract.pdf?": (None, None, None),
        "is there a word on fees": (None, None, None),
        "": (None, None, None),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    got = {r.q: (r.a, r.b, r.c) for r in df.select("q", *[c.alias(n) for c, n in zip(language.file_request(F.col("q")), "abc")]).collect()}
    assert got == cases
