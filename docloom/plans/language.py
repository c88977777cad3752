"""How questions and texts are read: languages, dates, numbers, cues, terms. Questions are written from
orders by templates, as the corpus asks none; their words come from the vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.functions import vocabulary as V
from docloom.operators import language as L
from docloom.operators import retrieval as R
from docloom.plans.retrieval import read

#: What is asked: # stands for the order, @ for its day.
TEMPLATES = (
    "how much is order # worth and when was it placed", "compare order # with the order of @", "timeline of order # since @", "list all the lines of order #",
    "how to return order #, and how many days are left", "why was order # late; who is responsible for it?", "when was order # shipped", "who is the clerk of order #",
    "latest updates on order # as of today", "what was originally agreed for order #", "tell me about file ORDER_#.pdf", "what happened from 5 March 2026 to @",
    "كم قيمة الطلب # ومتى وقع", "ما هي حالة الطلب # حاليا", "show the version history of order #", "orders of the past 10 days, three weeks ago and last month",
    "بكام الطلب # ودلوقتي فين", "قارن بين الطلب # والعقد", "export order # as pdf please", "If order #: give me an Excel file of this conversation",
)
#: Statements that teach, with # for a number.
LESSONS = (
    "remember that the delivery fee of zone # is 12 AED", "from now on always show totals before notes for # orders", "is # wrong? that is incorrect, the correct value is forty",
    "«boq #» في الأسئلة يُقصد به «جدول الكميات #» في المستندات", "scaffold # = support frame", "i prefer short answers of # lines", "the term party # refers to the buyer", "note that",
)


def _questions(spark: SparkSession, sf_dir: str, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    text = F.get(F.array(*[F.lit(t) for t in templates]), (F.col("o_orderkey") % len(templates)).cast("int"))
    text = F.replace(F.replace(text, F.lit("#"), F.col("o_orderkey").cast("string")), F.lit("@"), F.date_format("day", "dd/MM/yyyy"))
    return o.select("o_orderkey", "day", text.alias("q"))


def query_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole reading of a question as one row: intent, what it wants listed, role, overview, time,
    bookkeeping, range, codes, language."""
    q = _questions(spark, sf_dir).select("o_orderkey", "q", T.normalize(F.col("q")).alias("n"))
    a, b = L.span(F.col("n"))
    return q.select(
        "o_orderkey",
        L.intent(F.col("n")).alias("intent"),
        L.exhaustive(F.col("n")).alias("exhaustive"),
        F.col("n").rlike(T.cues(V.ROLE)).alias("role"),
        (F.col("n").rlike(T.cues(V.OVERVIEW)) & ~L.exhaustive(F.col("n"))).alias("overview"),
        L.time_wish(F.col("n")).alias("time"),
        F.regexp_extract("n", T.cues(V.ABOUT_DOCUMENT), 1).alias("about_document"),
        a.alias("range_from"),
        b.alias("range_to"),
        F.array_join(F.regexp_extract_all("n", F.lit(T.IDENTIFIER), F.lit(0)), " ").alias("codes"),
        L.language_of(F.col("q")).alias("language"),
        L.reads_english(F.col("q")).alias("english"),
        F.size(L.display_parts(F.col("q"))).cast("long").alias("parts"),
        F.array_join(L.keywords(F.col("n")), " ").alias("keywords"),
    )


def live_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that only an operational system can answer, with the first marker found."""
    q = _questions(spark, sf_dir).select("o_orderkey", F.regexp_extract(T.normalize(F.col("q")), T.cues(V.LIVE_DATA), 1).alias("marker"))
    return q.where("marker <> ''")


def colloquial_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in standard words, where that changes them."""
    q = _questions(spark, sf_dir).select("o_orderkey", T.normalize(F.col("q")).alias("n")).withColumn("standard", L.standard(F.col("n")))
    return q.where("standard <> n").select("o_orderkey", "standard")


def synonym_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other members of every group of which a member's words are all in the text: notes of two
    members of the synonym groups each."""
    words = [w for g in V.SYNONYMS for w in g]
    pick = lambda k: F.get(F.array(*[F.lit(w) for w in words]), k.cast("int"))
    key = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", pick(key % len(words)), F.lit("order"), pick((key * 7 + 3) % len(words))).alias("text"))
    return L.expanded(o, "o_orderkey", T.tokens(F.col("text")))


def arabic_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words put together of a beginning, a base and an end, and their light stems."""
    key = F.col("p_partkey")
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int"))
    token = F.concat(pick(("", *V.AR_PREFIXES), key % 7), pick(BASES, F.floor(key / 7) % len(BASES)), pick(("", *V.AR_SUFFIXES), F.floor(key / 3) % 12))
    return read(spark, sf_dir, "part").select("p_partkey", token.alias("token"), T.stem(token).alias("stem"))


BASES = ("عقد", "مهندس", "سيناريو", "بند", "ام", "جدار")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k = F.col("o_orderkey") % 5
    month = F.get(F.array(*[F.lit(m) for m in V.MONTHS_EN]), F.month("day") - 1)
    spelled = F.concat_ws(" ", F.day("day").cast("string"), month, F.year("day").cast("string"))
    said = F.when(k == 0, F.date_format("day", "dd/MM/yyyy")).when(k == 1, F.date_format("day", "d-M-yyyy")).when(k == 2, F.date_format("day", "yyyy-MM-dd")).when(k == 3, spelled).otherwise("31/02/2026 or 40/13/2026")
    return o.select("o_orderkey", "day", F.concat(F.lit("Order of "), said, F.lit(", due 15/08/2026, ref AB-"), F.col("o_orderkey"), F.lit(".")).alias("text"))


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates of a text, in figures or with a month's name; the first date in figures, day first
    or year first; and a lone date in any of three forms."""
    d = _dated(spark, sf_dir)
    days = L.all_dates(F.col("text"))
    coerced = L.coerced(F.trim(F.regexp_replace(F.regexp_replace("text", "^Order of ", ""), ",.*", "")))
    return d.select("o_orderkey", F.array_join(F.transform(days, lambda x: x.cast("string")), " ").alias("days"), L.parsed(F.col("text")).alias("parsed"), F.array_join(L.dmy(F.col("text")), " ").alias("figures"), coerced.cast("string").alias("coerced"))


def relative_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of days that a phrase means, as of each order's day: counted phrases before fixed ones,
    weeks from Monday, months and years as calendar units."""
    k = F.col("o_orderkey")
    unit = F.get(F.array(*[F.lit(u) for u in ("days", "weeks", "months", "years")]), (k % 4).cast("int"))
    forms = F.array(F.concat_ws(" ", F.lit("past"), k % 40, unit), F.concat_ws(" ", k % 12, unit, F.lit("ago")), F.concat_ws(" ", F.lit("last"), k % 9, unit, F.lit("before the end")), *[F.lit(p) for p in L.FIXED])
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.concat(F.lit("orders of "), F.get(forms, (F.floor(k / 4) % (3 + len(L.FIXED))).cast("int"))).alias("q"))
    w = L.window(F.col("q"), F.col("day"))
    return o.select("o_orderkey", "q", w["a"].cast("string").alias("first_day"), w["b"].cast("string").alias("last_day"))


def _value() -> Column:
    """Numbers without "twenty-one" and the like, which the grammar does not read."""
    k = F.col("o_orderkey")
    return k % 3 * 1_000_000 + 2000 * (k % 400) + 2 * (k * 97 % 500)


def spelled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in words are read back as what they state, and stand in the text as digits."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", _value().alias("value"))
    text = F.concat(F.lit("the fee is "), N.english("value"), F.lit(" dirhams for each unit"))
    found = N.spelled(o.select("o_orderkey", text.alias("text")), "o_orderkey", "text")
    return found


def numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by both definitions of a number: a layout's, in which a lone dash is none, and a table's."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("b"))
    digits = F.format_number(F.abs("b"), 2)
    k = F.col("c_custkey") % 8
    cell = F.when(k == 0, F.concat(F.lit("("), digits, F.lit(")"))).when(k == 1, "-").when(k == 2, F.concat(digits, F.lit(" AED"))).when(k == 3, F.concat(digits, F.lit("%"))).when(k == 4, F.lit("Note 5")).when(k == 5, "").otherwise(digits)
    return c.select("c_custkey", cell.alias("cell")).select("c_custkey", "cell", L.layout_number(F.col("cell")).alias("in_layout"), L.table_number(F.col("cell")).alias("in_table"), L.strip_thousands(F.col("cell")).alias("plain"))


def supported_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells all of whose numbers the evidence has, with or without thousands separators."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("n"), (F.col("o_orderkey") % 4).alias("k"))
    cell = F.when(F.col("k") == 0, F.col("n")).when(F.col("k") == 1, F.concat(F.col("n"), F.lit(" and 7,000,001"))).when(F.col("k") == 2, "no figure").otherwise(F.concat(F.lit("total "), F.col("n"), F.lit(".")))
    evidence = F.concat(F.lit("paid "), F.when(F.col("o_orderkey") % 3 == 0, F.regexp_replace("n", ",", "")).otherwise(F.col("n")))
    return o.select("o_orderkey", L.number_supported(cell, evidence).alias("supported"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of how a request ended: by its source and grounding, and as the question log has it,
    where an answer that offers choices clarifies."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, sf_dir, "events").select(k.alias("k"), "event_type")
    source = F.when(F.col("event_type") == "error", "none").when(F.col("k") % 5 == 0, "web").otherwise("documents")
    grounded, choices = (F.col("k") % 3 > 0) & (source == "documents"), F.col("k") % 7 == 0
    return e.groupBy(L.outcome(source, grounded).alias("outcome"), L.logged_outcome(source, grounded, choices).alias("logged")).agg(F.count("*").alias("n"))


def json_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object in a model's text, between the first and the last brace; none where that is no JSON."""
    e = read(spark, sf_dir, "events").select("event_id", "props")
    raw = F.when(F.col("event_id") % 11 == 0, "no object here").when(F.col("event_id") % 13 == 0, F.concat(F.col("props"), F.lit(" {oops"), F.lit("}"))).otherwise(F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```")))
    found = L.json_object(raw)
    return e.select("event_id", F.coalesce(F.get_json_object(found, "$.k").cast("long"), F.lit(-1)).alias("k"))


def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a message would teach: the kind of signal, how sure it is, and the claim itself."""
    m = _questions(spark, sf_dir, LESSONS).select("o_orderkey", "q")
    return L.signals(m, "o_orderkey", "q")


def term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of statements about terms: two quoted ones, or one equal to the other."""
    m = _questions(spark, sf_dir, LESSONS)
    a, b = L.term_pair(F.col("q"))
    return m.select("o_orderkey", a.alias("a"), b.alias("b")).where("a is not null")


def offered_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wording that a clarifying answer offers in place of the question's."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("لا أجد ذلك. إن كنت تقصد «"), F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, " of the very long name here").otherwise(""), F.lit("»، فهو في الملف.")).alias("answer"))
    return p.select("p_partkey", L.offered(F.col("answer")).alias("meant")).where("meant is not null")


def file_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that ask for a file: its format, and whether of the last answer, of the conversation or
    of a question of its own, which is given without the request's words."""
    q = _questions(spark, sf_dir).select("o_orderkey", *[c.alias(n) for c, n in zip(L.file_request(F.col("q")), ("format", "subject", "question"))])
    return q.where("format is not null")


def follow_up_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that leans on the one before, joined with its subject in its own language."""
    q = _questions(spark, sf_dir).select("o_orderkey", L.attached(F.lit("and its fee?"), F.regexp_replace("q", r"\d+", "N")).alias("joined"))
    return q.groupBy("joined").agg(F.count("*").alias("n"))


def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names as tokens: all of them, those that are no version, and whether the question holds the
    name as a run of tokens."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_v"), F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, "_rev2").otherwise(""), F.lit(".pdf")).alias("file"), "p_name")
    name = L.stem_tokens(F.col("file"))
    base = L.base_tokens(name)
    asked = L.file_tokens(F.concat(F.lit("what is in "), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.reverse("p_name")), F.lit("?")))
    return p.select("p_partkey", F.array_join(name, " ").alias("name"), F.array_join(base, " ").alias("base"), L.holds_run(asked, base).alias("named"))


def repaired_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as a file has damaged it, put right: invisible marks out, soft hyphens inside of codes back,
    presentation forms as letters, spreadsheet errors empty."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("CMN­2026­0"), F.col("p_partkey"), F.lit("‏"))).when(k == 1, F.lit("ﻧﻴﺎﺑﺔ ﻣﺮﻭﺭ")).when(k == 2, F.get(F.array(*[F.lit(x) for x in V.SPREADSHEET_ERRORS]), (F.col("p_partkey") % len(V.SPREADSHEET_ERRORS)).cast("int"))).otherwise(F.concat(F.lit(" نسبة 90 "), F.col("p_partkey")))
    return L.repaired(read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw")


def percentages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages that recognition has turned into figures: 90NN and 9/NN before words of value."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("retains "), F.when(F.col("p_partkey") % 2 == 0, "90").otherwise("9/"), F.lpad((F.col("p_size")).cast("string"), 2, "0"), F.when(F.col("p_partkey") % 3 == 0, " من قيمة العقد").otherwise(" units")).alias("text"))
    return p.select("p_partkey", L.percentages(F.col("text")).alias("text"))


def answers_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with contact and access details masked but for the kinds that the question asks for, and
    how many of each kind were masked."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lpad((F.col("c_custkey") * 7919 % 10_000_000).cast("string"), 7, "0").alias("d"))
    answer = F.concat(
        F.lit("Reach "), F.regexp_replace("c_name", "[^A-Za-z0-9]", "."), F.lit("@mail.example.com or 050 "), F.substring("d", 1, 3), F.lit(" "), F.substring("d", 4, 4),
        F.lit(", passcode: k#"), F.col("c_custkey"), F.lit(" meeting id: 812 44"), F.col("d"), F.lit(" id 784-1990-"), F.col("d"), F.lit("-1 account AE07 0331 2345 6789 0123 456 ref 260325-7491734."),
    )
    question = F.get(F.array(*[F.lit(q) for q in ("what is their email", "which phone and whatsapp", "the zoom link please", "identity of the owner", "bank account", "what is the delay penalty")]), (F.col("c_custkey") % 6).cast("int"))
    kept = c.select("c_custkey", answer.alias("a"), question.alias("q"))
    n = lambda k: F.when(T.asks_for(F.col("q"), k), 0).otherwise(F.size(F.regexp_extract_all("a", F.lit(T.PRIVATE[k]), F.lit(0)))).cast("long")
    return kept.select("c_custkey", T.redact(F.col("a"), F.col("q")).alias("text"), sum((n(k) for k in T.PRIVATE), F.lit(0).cast("long")).alias("masked"))


QUERIES = {
    f.__name__: f
    for f in (
        query_analysis, live_markers, colloquial_standard, synonym_terms, arabic_stems, written_dates, relative_phrases, spelled_numbers, numeric_cells, supported_cells, outcomes, json_from_text,
        lessons, term_pairs, offered_meaning, file_requests, follow_up_text, name_tokens, repaired_text, percentages_read, answers_redacted,
    )
}

# --- SQL -----------------------------------------------------------------------------------------


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(xs) -> str:
    return "[" + ", ".join(quoted(x) for x in xs) + "]"


def normal(x: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace(translate({x}, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '{T.MARKS}', '', 'g'), '\\s+', ' ', 'g')))"


def has(x: str, words) -> str:
    return f"regexp_matches({x}, {quoted(T.cues(tuple(words)))})"


def first(x: str, words) -> str:
    return f"regexp_extract({x}, {quoted(T.cues(tuple(words)))}, 1)"


def stemmed(x: str) -> str:
    body = "CASE " + " ".join(f"WHEN starts_with({x}, '{p}') AND length({x}) >= {len(p) + 3} THEN substring({x}, {len(p) + 1})" for p in V.AR_PREFIXES) + f" ELSE {x} END"
    tail = lambda b: "CASE " + " ".join(f"WHEN ends_with({b}, '{s}') AND length({b}) >= {len(s) + 3} THEN left({b}, length({b}) - {len(s)})" for s in V.AR_SUFFIXES) + f" ELSE {b} END"
    return f"CASE WHEN regexp_matches({x}, '{T.ARABIC}') THEN list_transform([{body}], lambda sb: {tail('sb')})[1] ELSE {x} END"


def token_list(x: str) -> str:
    n = normal(x)
    ids = f"regexp_extract_all({n}, '{T.IDENTIFIER}')"
    stop = listed((*V.ARABIC_STOPWORDS, *V.ENGLISH_STOPWORDS))
    words = f"list_filter(list_transform(regexp_split_to_array({n}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_replace(w, '^_+|_+$', '', 'g')), lambda w: (length(w) > 1 OR regexp_full_match(w, '[0-9]')) AND NOT list_contains({stop}, w))"
    return f"list_concat({ids}, flatten(list_transform({ids}, lambda i: list_filter(regexp_split_to_array(i, '[-/._]'), lambda p: length(p) > 1))), list_transform({words}, lambda w: {stemmed('w')}))"


def content_list(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({token_list(x)}, lambda t: length(t) > 2 OR regexp_full_match(t, '[0-9]+'))))"


def _asked(templates: tuple[str, ...] = TEMPLATES) -> str:
    return f"q AS (SELECT o_orderkey, o_orderdate::DATE AS day, replace(replace({listed(templates)}[o_orderkey % {len(templates)} + 1], '#', o_orderkey::VARCHAR), '@', strftime(o_orderdate, '%d/%m/%Y')) AS q FROM orders), n AS (SELECT *, {normal('q')} AS n FROM q)"


_LETTERS = lambda x, p: f"(length({x}) - length(regexp_replace({x}, '{p}', '', 'g')))"
_PROSE = f"array_to_string(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: NOT regexp_matches(w, {quoted(L.NOT_LANGUAGE)})), ' ')"
_INTENT = f"CASE WHEN {has('n', ('متى', 'when'))} AND {has('n', V.INTENTS['aggregation'])} THEN 'timeline' " + " ".join(f"WHEN {has('a', ws)} THEN '{k}'" for k, ws in V.INTENTS.items()) + " ELSE 'fact' END"
_EXH = f"({has('n', V.EXHAUSTIVE)} OR intent IN ('timeline', 'aggregation'))"
_GROUPS = ", ".join(f"({g}, {m}, {quoted(w)}, {listed(L.member_stems(w))})" for g, ws in enumerate(V.SYNONYMS) for m, w in enumerate(ws))
_ALL_SYN = listed(w for g in V.SYNONYMS for w in g)


_PERSONAL = {k: quoted(p) for k, p in T.PRIVATE.items()}
_ASKED_FOR = {k: "(" + " OR ".join(f"contains(q, {quoted(T.fold(w))})" for w in ws) + ")" for k, ws in T.RELEASED_BY.items()}
_MASKED = "a"
for _k, _p in T.PRIVATE.items():
    _MASKED = f"CASE WHEN {_ASKED_FOR[_k]} THEN {_MASKED} ELSE regexp_replace({_MASKED}, {_PERSONAL[_k]}, '\\1[{_k}]', 'g') END"
_FIXED_SQL = " ".join(f"WHEN contains(q, '{p}') THEN {{'a': {a}, 'b': {b}}}" for p, (a, b) in L.FIXED_SQL.items())

SQL = {
    "query_analysis": f"""WITH {_asked()}, p AS (SELECT *, {_PROSE} AS prose, regexp_replace(n, {quoted(L.GIVEN_DATE)}, ' ', 'g') AS a FROM n),
        i AS (SELECT *, {_INTENT} AS intent, {_LETTERS('prose', T.LATIN)} AS la, {_LETTERS('prose', T.ARABIC)} AS ar,
          regexp_extract(n, {quoted(L.RANGE_AR)}, 1) AS a1, regexp_extract(n, {quoted(L.RANGE_AR)}, 2) AS b1, regexp_extract(n, {quoted(L.RANGE_EN)}, 1) AS a2, regexp_extract(n, {quoted(L.RANGE_EN)}, 2) AS b2 FROM p)
        SELECT o_orderkey, intent, {_EXH} AS exhaustive, {has('n', V.ROLE)} AS role, {has('n', V.OVERVIEW)} AND NOT {_EXH} AS overview,
          CASE WHEN regexp_matches(n, {quoted(L.DMY)}) OR regexp_matches(n, {quoted(L.WRITTEN)}) THEN 'explicit' WHEN {has('n', V.LATEST)} THEN 'latest' WHEN {has('n', V.EARLIEST)} THEN 'earliest' ELSE 'none' END AS time,
          {first('n', V.ABOUT_DOCUMENT)} AS about_document, trim(CASE WHEN a1 <> '' THEN a1 ELSE a2 END) AS range_from, trim(CASE WHEN a1 <> '' THEN b1 ELSE b2 END) AS range_to,
          array_to_string(regexp_extract_all(n, '{T.IDENTIFIER}'), ' ') AS codes, CASE WHEN la + ar = 0 THEN 'none' WHEN ar / (la + ar) >= 0.6 THEN 'ar' WHEN ar / (la + ar) <= 0.15 THEN 'en' ELSE 'mixed' END AS language, la > ar AS english,
          greatest(1, len(list_filter(regexp_split_to_array(q, {quoted(L.PART_MARK)}), lambda x: length(trim(x)) > 6)))::BIGINT AS parts,
          array_to_string(list_filter({token_list('n')}, lambda t: length(t) > 1 AND NOT list_contains({listed(L.QUESTION_WORDS)}, t)), ' ') AS keywords FROM i""",
    "live_markers": f"WITH {_asked()} SELECT o_orderkey, {first('n', V.LIVE_DATA)} AS marker FROM n WHERE {has('n', V.LIVE_DATA)}",
    "colloquial_standard": f"""WITH {_asked()}, w AS (SELECT o_orderkey, n, list_transform(string_split(n, ' '), lambda x: coalesce(map_extract({L.standard_map_sql()}, x)[1], x)) AS ws FROM n)
        SELECT o_orderkey, array_to_string(list_filter(ws, lambda x: NOT list_contains({listed(V.FILLERS)}, x)), ' ') AS standard FROM w WHERE array_to_string(ws, ' ') <> n""",
    "synonym_terms": f"""WITH t AS (SELECT o_orderkey, {_ALL_SYN}[o_orderkey % {len([w for g in V.SYNONYMS for w in g])} + 1] || ' order ' || {_ALL_SYN}[(o_orderkey * 7 + 3) % {len([w for g in V.SYNONYMS for w in g])} + 1] AS text FROM orders),
        k AS (SELECT o_orderkey, {token_list('text')} AS ts FROM t), g(g, m, word, stems) AS (VALUES {_GROUPS}),
        f AS (SELECT o_orderkey, g, m, word, len(stems) > 0 AND len(list_filter(stems, lambda s: NOT list_contains(ts, s))) = 0 AS present FROM k, g),
        h AS (SELECT *, bool_or(present) OVER (PARTITION BY o_orderkey, g) AS fired FROM f) SELECT DISTINCT o_orderkey, word FROM h WHERE fired AND NOT present""",
    "arabic_stems": f"""WITH t AS (SELECT p_partkey, {listed(('', *V.AR_PREFIXES))}[p_partkey % 7 + 1] || {listed(BASES)}[(p_partkey // 7) % {len(BASES)} + 1] || {listed(('', *V.AR_SUFFIXES))}[(p_partkey // 3) % 12 + 1] AS token FROM part) SELECT p_partkey, token, {stemmed('token')} AS stem FROM t""",
    "written_dates": f"""WITH s AS (SELECT o_orderkey, o_orderdate::DATE AS day, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate) WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
          WHEN 3 THEN day(o_orderdate) || ' ' || {listed(V.MONTHS_EN)}[month(o_orderdate)] || ' ' || year(o_orderdate) ELSE '31/02/2026 or 40/13/2026' END AS said FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN array_to_string(list_sort(list_distinct([day::VARCHAR, '2026-08-15'])), ' ') ELSE '2026-08-15' END AS days,
          CASE o_orderkey % 5 WHEN 0 THEN day::VARCHAR WHEN 1 THEN day::VARCHAR WHEN 2 THEN '2026-08-15' WHEN 3 THEN '2026-08-15' ELSE '2026-02-31' END AS parsed,
          CASE o_orderkey % 5 WHEN 2 THEN '15/08/2026' WHEN 3 THEN '15/08/2026' WHEN 4 THEN '31/02/2026 40/13/2026 15/08/2026' ELSE said || ' 15/08/2026' END AS figures,
          CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN day::VARCHAR END AS coerced FROM s""",
    "relative_phrases": f"""WITH u AS (SELECT o_orderkey, o_orderdate::DATE AS day, ['days', 'weeks', 'months', 'years'][o_orderkey % 4 + 1] AS unit, ((o_orderkey // 4) % {3 + len(L.FIXED)})::INTEGER AS form FROM orders),
        f AS (SELECT *, CASE form WHEN 0 THEN o_orderkey % 40 WHEN 1 THEN o_orderkey % 12 ELSE o_orderkey % 9 END AS c FROM u),
        q AS (SELECT *, 'orders of ' || CASE form WHEN 0 THEN 'past ' || c || ' ' || unit WHEN 1 THEN c || ' ' || unit || ' ago' WHEN 2 THEN 'last ' || c || ' ' || unit || ' before the end' ELSE {listed(L.FIXED)}[greatest(form - 2, 1)] END AS q FROM f),
        b AS (SELECT *, (CASE unit WHEN 'days' THEN day - c::INTEGER WHEN 'weeks' THEN day - 7 * c::INTEGER WHEN 'months' THEN day - to_months(c::INTEGER) ELSE day - to_years(c::INTEGER) END)::DATE AS back FROM q),
        w AS (SELECT o_orderkey, q, CASE WHEN form = 0 AND c > 0 THEN {{'a': back, 'b': day}} WHEN form = 1 AND c > 0 THEN CASE unit WHEN 'days' THEN {{'a': back, 'b': back}} WHEN 'weeks' THEN {{'a': date_trunc('week', back)::DATE, 'b': date_trunc('week', back)::DATE + 6}}
          WHEN 'months' THEN {{'a': date_trunc('month', back)::DATE, 'b': last_day(back)}} ELSE {{'a': date_trunc('year', back)::DATE, 'b': make_date(year(back), 12, 31)}} END {_FIXED_SQL} END AS w FROM b)
        SELECT o_orderkey, q, w.a::VARCHAR AS first_day, w.b::VARCHAR AS last_day FROM w""",
    "spelled_numbers": """WITH v AS (SELECT o_orderkey, o_orderkey % 3 * 1000000 + 2000 * (o_orderkey % 400) + 2 * (o_orderkey * 97 % 500) AS value FROM orders)
        SELECT o_orderkey, value, value || CASE WHEN value >= 1000 THEN ' ' || format('{:,}', value) ELSE '' END AS digit_forms, 'the fee is ' || value || ' dirhams for each unit' AS with_digits FROM v""",
    "numeric_cells": f"""WITH b AS (SELECT c_custkey, format('{{:,.2f}}', abs(c_acctbal::DECIMAL(18,2))::DOUBLE) AS s, c_custkey % 8 AS k FROM customer),
        c AS (SELECT c_custkey, CASE k WHEN 0 THEN '(' || s || ')' WHEN 1 THEN '-' WHEN 2 THEN s || ' AED' WHEN 3 THEN s || '%' WHEN 4 THEN 'Note 5' WHEN 5 THEN '' ELSE s END AS cell FROM b)
        SELECT c_custkey, cell, regexp_matches(cell, {quoted(L.LAYOUT_NUMBER)}) AS in_layout, regexp_replace(cell, '[^0-9./-]', '', 'g') <> '' AND (try_cast(regexp_replace(cell, '[^0-9./-]', '', 'g') AS DOUBLE) IS NOT NULL OR regexp_full_match(regexp_replace(cell, '[^0-9./-]', '', 'g'), '[0-9./-]{{4,}}')) AS in_table, replace(replace(cell, ',', ''), ' ', '') AS plain FROM c""",
    "supported_cells": "SELECT o_orderkey, o_orderkey % 4 <> 1 AS supported FROM orders",
    "outcomes": """WITH k AS (SELECT json_extract_string(props, '$.k')::BIGINT AS k, event_type FROM events), s AS (SELECT *, CASE WHEN event_type = 'error' THEN 'none' WHEN k % 5 = 0 THEN 'web' ELSE 'documents' END AS src FROM k),
        o AS (SELECT *, CASE WHEN src = 'web' THEN 'web' WHEN k % 3 > 0 AND src = 'documents' THEN 'answered' WHEN src = 'none' THEN 'refused' ELSE 'clarified' END AS outcome FROM s)
        SELECT outcome, CASE WHEN k % 3 > 0 AND src = 'documents' THEN 'answered' WHEN k % 7 = 0 THEN 'clarified' WHEN src = 'web' THEN 'web' ELSE 'refused' END AS logged, count(*) AS n FROM o GROUP BY ALL""",
    "json_from_text": "SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN -1 ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events",
    "lessons": f"""SELECT o_orderkey, {L.lessons_sql(listed)} FROM orders WHERE o_orderkey % {len(LESSONS)} NOT IN (4, 7)""",
    "term_pairs": f"""SELECT o_orderkey, CASE o_orderkey % {len(LESSONS)} WHEN 3 THEN 'boq ' || o_orderkey ELSE 'scaffold ' || o_orderkey END AS a, CASE o_orderkey % {len(LESSONS)} WHEN 3 THEN 'جدول الكميات ' || o_orderkey ELSE 'support frame' END AS b FROM orders WHERE o_orderkey % {len(LESSONS)} IN (3, 4)""",
    "offered_meaning": f"SELECT p_partkey, {normal('p_name')} AS meant FROM part WHERE p_partkey % 4 <> 0 AND len(string_split(p_name, ' ')) <= 5",
    "file_requests": f"SELECT o_orderkey, CASE o_orderkey % {len(TEMPLATES)} WHEN 18 THEN 'pdf' ELSE 'xlsx' END AS format, CASE o_orderkey % {len(TEMPLATES)} WHEN 18 THEN 'question' ELSE 'conversation' END AS subject, CASE o_orderkey % {len(TEMPLATES)} WHEN 18 THEN 'order ' || o_orderkey || '؟' END AS question FROM orders WHERE o_orderkey % {len(TEMPLATES)} IN (18, 19)",
    "follow_up_text": f"""WITH {_asked()}, x AS (SELECT regexp_replace(q, '\\d+', 'N', 'g') AS s FROM q) SELECT 'and its fee regarding ' || regexp_replace(regexp_replace(s, {quoted(L.LEADING_QUESTION)}, ''), '[?؟.\\s]+$', '') || '?' AS joined, count(*) AS n FROM x GROUP BY 1""",
    "name_tokens": """WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS ws FROM part)
        SELECT p_partkey, lower(array_to_string(ws, ' ')) || ' v' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' rev2' ELSE '' END AS name, lower(array_to_string(ws, ' ')) AS base,
          p_partkey % 3 = 0 OR contains(' what is in ' || lower(reverse(p_name)) || ' ', ' ' || lower(p_name) || ' ') AS named FROM w JOIN part USING (p_partkey, p_name)""",
    "repaired_text": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CMN-2026-0' || p_partkey WHEN 1 THEN 'نيابة مرور' WHEN 2 THEN '' ELSE 'نسبة 90 ' || p_partkey END AS text FROM part""",
    "percentages_read": """SELECT p_partkey, 'retains ' || CASE WHEN p_partkey % 3 = 0 THEN lpad(p_size::VARCHAR, 2, '0') || '%' ELSE CASE WHEN p_partkey % 2 = 0 THEN '90' ELSE '9/' END || lpad(p_size::VARCHAR, 2, '0') END
        || CASE WHEN p_partkey % 3 = 0 THEN ' من قيمة العقد' ELSE ' units' END AS text FROM part""",
    "answers_redacted": f"""WITH c AS (SELECT c_custkey, c_name, lpad((c_custkey * 7919 % 10000000)::VARCHAR, 7, '0') AS d FROM customer),
        k AS (SELECT c_custkey, 'Reach ' || regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g') || '@mail.example.com or 050 ' || substring(d, 1, 3) || ' ' || substring(d, 4, 4) || ', passcode: k#' || c_custkey || ' meeting id: 812 44' || d || ' id 784-1990-' || d
          || '-1 account AE07 0331 2345 6789 0123 456 ref 260325-7491734.' AS a, ['what is their email', 'which phone and whatsapp', 'the zoom link please', 'identity of the owner', 'bank account', 'what is the delay penalty'][c_custkey % 6 + 1] AS q FROM c)
        SELECT c_custkey, {_MASKED} AS text, ({' + '.join(f"CASE WHEN {_ASKED_FOR[k]} THEN 0 ELSE len(regexp_extract_all(a, {_PERSONAL[k]})) END" for k in T.PRIVATE)})::BIGINT AS masked FROM k""",
}
