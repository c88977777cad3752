"""How questions and texts are read, as Column expressions over (normalised) text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vocabulary as V

#: Tokens that say nothing about the language: names of files, addresses and codes.
NOT_LANGUAGE = r"[_./\\@]|^[^\p{L}\p{N}]*[A-Z0-9][A-Z0-9-]{2,}[^\p{L}\p{N}]*$"
#: A date that a question states, with the word that introduces it.
GIVEN_DATE = r"(?i)(?:ب?(?:ال)?تاريخ|المؤرخ[ةه]?|مؤرخ[ةه]?|dated|date)?\s*\(?\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\)?"
RANGE_AR = r"(?:^|\s)من\s+(.+?)\s+(?:حتي|الي|لغايه)\s+(.+?)\s*[.?]*$"
RANGE_EN = r"(?:^|\s)from\s+(.+?)\s+(?:to|until|till)\s+(.+?)\s*[.?]*$"
_MONTHS = "|".join(T.fold(m) for m in (*V.MONTHS_AR, *V.MONTHS_EN))
DMY = r"(?:^|[^\p{L}\p{N}_])(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b"
YMD = r"(?:^|[^\p{L}\p{N}_])(\d{4}-\d{1,2}-\d{1,2})\b"
WRITTEN = rf"(?:^|[^\p{{L}}\p{{N}}_])(\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})\b"
PART_MARK = r"[،؛,؟?]\s+|\s+و(?:متى|كم|ما|من|اين|أين|كيف|لماذا|هل)\s"
QUESTION_WORDS = tuple(dict.fromkeys(p + T.fold(w) for p in ("", "و") for w in (*V.INTERROGATIVES, "ماذا", "اي") if not p or T.fold(w)[0] > "z"))


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


# --- what is asked -------------------------------------------------------------------------------


def language_of(question: Column) -> Column:
    """The language that a question is asked in, its names and codes left out."""
    return T.language(prose(question))


def prose(question: Column) -> Column:
    kept = F.array_join(F.filter(F.split(question, r"\s+"), lambda w: ~w.rlike(NOT_LANGUAGE)), " ")
    return F.when(F.trim(kept) == "", question).otherwise(kept)


def reads_english(question: Column) -> Column:
    return T.count_of(prose(question), T.LATIN) > T.count_of(prose(question), T.ARABIC)


def intent(n: Column) -> Column:
    """By the first list of cues that fits; a date that the question names is no cue. When something of
    a list happened is a timeline."""
    asked = F.regexp_replace(n, GIVEN_DATE, " ")
    out = F.lit("fact")
    for name, words in reversed(V.INTENTS.items()):
        out = F.when(asked.rlike(T.cues(words)), name).otherwise(out)
    return F.when(n.rlike(T.cues(("متى", "when"))) & n.rlike(T.cues(V.INTENTS["aggregation"])), "timeline").otherwise(out)


def exhaustive(n: Column) -> Column:
    return n.rlike(T.cues(V.EXHAUSTIVE)) | intent(n).isin("timeline", "aggregation")


def time_wish(n: Column) -> Column:
    """A named date, else the newest, else the oldest."""
    named = n.rlike(DMY) | n.rlike(WRITTEN)
    return F.when(named, "explicit").when(n.rlike(T.cues(V.LATEST)), "latest").when(n.rlike(T.cues(V.EARLIEST)), "earliest").otherwise("none")


def span(n: Column) -> tuple[Column, Column]:
    """Both ends of "from ... to ..."; empty without."""
    arabic = F.regexp_extract(n, RANGE_AR, 1) != ""
    return tuple(F.trim(F.when(arabic, F.regexp_extract(n, RANGE_AR, k)).otherwise(F.regexp_extract(n, RANGE_EN, k))) for k in (1, 2))


def display_parts(question: Column) -> Column:
    """Parts of more than six characters; the question itself unless there are two."""
    parts = F.filter(F.split(question, PART_MARK), lambda p: F.length(F.trim(p)) > 6)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(question))


def keywords(n: Column) -> Column:
    words = F.array(*[F.lit(w) for w in QUESTION_WORDS])
    return F.filter(T.tokens(n), lambda t: (F.length(t) > 1) & ~F.array_contains(words, t))


# --- colloquial words and synonyms ---------------------------------------------------------------


def standard_words() -> dict[str, str]:
    """Colloquial word to standard word, with and without the conjunction before it."""
    words = dict(V.COLLOQUIAL_WORDS)
    for verb in V.COLLOQUIAL_VERBS:
        for person in "ينت":
            words.setdefault("ب" + person + verb[1:], person + verb[1:])
            words.setdefault("ه" + person + verb[1:], "س" + person + verb[1:])
    return words | {"و" + a: "و" + b for a, b in words.items() if "و" + a not in words}


def standard_map_sql() -> str:
    words = standard_words()
    return "map([" + ", ".join(f"'{a}'" for a in words) + "], [" + ", ".join(f"'{b}'" for b in words.values()) + "])"


def standard(n: Column) -> Column:
    """A normalised question in standard words; fillers go where something else changed."""
    text = n
    for phrase, by in V.COLLOQUIAL_PHRASES.items():
        text = F.regexp_replace(text, rf"(^|[^\p{{L}}\p{{N}}_]){phrase}($|[^\p{{L}}\p{{N}}_])", f"$1{by}$2")
    lookup = F.create_map(*[F.lit(x) for kv in standard_words().items() for x in kv])
    words = F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(lookup, w), w))
    kept = F.filter(words, lambda w: ~w.isin(*V.FILLERS))
    return F.when(F.array_join(words, " ") == n, n).otherwise(F.array_join(kept, " "))


def member_stems(member: str) -> list[str]:
    """Search terms of a fixed phrase."""
    out = []
    for w in re.split(r"[^\w]+", T.fold(member)):
        if len(w) > 1 and w not in V.ARABIC_STOPWORDS and w not in V.ENGLISH_STOPWORDS:
            if re.search("[؀-ۿ]", w):
                w = next((w[len(p) :] for p in V.AR_PREFIXES if w.startswith(p) and len(w) >= len(p) + 3), w)
                w = next((w[: -len(s)] for s in V.AR_SUFFIXES if w.endswith(s) and len(w) >= len(s) + 3), w)
            out.append(w)
    return out


def expanded(df: DataFrame, key: str, tokens: Column, groups: tuple[tuple[str, ...], ...] = V.SYNONYMS) -> DataFrame:
    """``key, word`` once each: the other members of every group of which a member's terms are all in the
    text. Texts meet members by an equi-join on terms; the groups are a fixed table."""
    rows = [(g, m, w, t, len(set(member_stems(w)))) for g, ws in enumerate(groups) for m, w in enumerate(ws) for t in set(member_stems(w))]
    members = F.broadcast(df.sparkSession.createDataFrame(rows, "g int, m int, word string, term string, terms int"))
    had = df.select(key, F.explode(F.array_distinct(tokens)).alias("term")).join(members, "term")
    had = had.groupBy(key, "g", "m", "terms").agg(F.count("*").alias("n")).where("n = terms")
    everyone = F.broadcast(members.select("g", F.col("m").alias("other"), "word").distinct())
    fired = had.groupBy(key, "g").agg(F.collect_set("m").alias("ms")).join(everyone, "g")
    return fired.where(~F.array_contains("ms", F.col("other"))).select(key, "word").distinct()


# --- dates ---------------------------------------------------------------------------------------


def dmy(text: Column) -> Column:
    """Dates day first, as written, in order."""
    return F.regexp_extract_all(T.normalize(text), F.lit(DMY), F.lit(1))


def all_dates(text: Column) -> Column:
    """Days that a text states day first or with a month's name; distinct, sorted; impossible ones left out."""
    names = F.create_map(*[F.lit(x) for months in (V.MONTHS_AR, V.MONTHS_EN) for k, m in enumerate(months, 1) for x in (T.fold(m), str(k))])
    figures = F.transform(dmy(text), lambda d: F.regexp_replace(d, "-", "/"))
    words = F.regexp_extract_all(T.normalize(text), F.lit(WRITTEN), F.lit(1))
    spelled = F.transform(words, lambda d: F.concat_ws("/", F.regexp_extract(d, r"^\d+", 0), F.try_element_at(names, F.regexp_extract(d, r"^\d+\s+(\S+)", 1)), F.regexp_extract(d, r"\d+$", 0)))
    return F.sort_array(F.array_distinct(F.array_compact(F.transform(F.concat(figures, spelled), lambda d: F.try_to_date(d, "d/M/yyyy")))))


def parsed(text: Column) -> Column:
    """The first date day first, else year first, as year-month-day if month and day can be such."""
    n = T.normalize(text)
    day_first, year_first = F.split(F.regexp_extract(n, DMY, 1), "[/-]"), F.split(F.regexp_extract(n, YMD, 1), "-")
    parts = F.when(F.size(day_first) == 3, F.reverse(day_first)).when(F.size(year_first) == 3, year_first)
    y, m, d = (F.get(parts, k).cast("int") for k in range(3))
    return F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d))


def coerced(text: Column) -> Column:
    """A lone date in one of three forms."""
    return F.coalesce(*[F.try_to_date(text, form) for form in ("yyyy-MM-dd", "dd/MM/yyyy", "d-M-yyyy")])


#: Phrases of fixed periods, tried in this order.
FIXED = ("day before yesterday", "yesterday", "tomorrow", "last week", "next week", "this week", "last month", "next month", "this month", "last year", "this year")
_WEEK = lambda by: (f"date_trunc('week', day)::DATE + {7 * by}", f"date_trunc('week', day)::DATE + {7 * by + 6}")
_MONTH = lambda by: (f"(date_trunc('month', day) + to_months({by}))::DATE", f"last_day((date_trunc('month', day) + to_months({by}))::DATE)")
_YEAR = lambda by: (f"make_date(year(day) + {by}, 1, 1)", f"make_date(year(day) + {by}, 12, 31)")
FIXED_SQL = dict(zip(FIXED, (*[(f"day + {k}", f"day + {k}") for k in (-2, -1, 1)], *map(_WEEK, (-1, 1, 0)), *map(_MONTH, (-1, 1, 0)), *map(_YEAR, (-1, 0)))))


def window(phrase: Column, day: Column) -> Column:
    """The days that a phrase means as of a day, as (a, b): so many units back until that day, the unit so
    many back, or a fixed period; null if none. A count before "of", "before" and the like is none."""
    unit = r"(day|week|month|year)s?"
    small = F.create_map(*[F.lit(x) for k, w in enumerate(V.EN_SMALL) if k > 1 for x in (w, k)])
    count = lambda p, g: F.coalesce(F.regexp_extract(phrase, p, g).try_cast("int"), F.try_element_at(small, F.regexp_extract(phrase, p, g)))
    ago, since = rf"\b(\w+)\s+{unit}\s+ago\b", rf"\b(?:past|last)\s+(\w+)\s+{unit}\b(\s+(?:of|before|after|from|prior)\b)?"
    pair = lambda a, b: F.struct(a.cast("date").alias("a"), b.cast("date").alias("b"))

    def back(n: Column, u: Column) -> Column:
        return F.when(u == "day", F.date_sub(day, n)).when(u == "week", F.date_sub(day, 7 * n)).when(u == "month", F.add_months(day, -n)).otherwise(F.add_months(day, -12 * n))

    def whole(d: Column, u: Column) -> Column:
        start = F.when(u == "day", d).when(u == "week", F.date_trunc("week", d)).when(u == "month", F.trunc(d, "month")).otherwise(F.trunc(d, "year")).cast("date")
        end = F.when(u == "day", d).when(u == "week", F.date_add(start, 6)).when(u == "month", F.last_day(d)).otherwise(F.make_date(F.year(d), F.lit(12), F.lit(31)))
        return pair(start, end)

    n1, u1, n2, u2 = count(ago, 1), F.regexp_extract(phrase, ago, 2), count(since, 1), F.regexp_extract(phrase, since, 2)
    out = F.when(n1.between(1, 3650), whole(back(n1, u1), u1)).when(n2.between(1, 3650) & (F.regexp_extract(phrase, since, 3) == ""), pair(back(n2, u2), day))
    for p in FIXED:
        word, _, u = p.partition(" ")
        by = {"last": -1, "next": 1, "this": 0}.get(word)
        if by is None:
            d = F.date_add(day, {"day before yesterday": -2, "yesterday": -1, "tomorrow": 1}[p])
            period = pair(d, d)
        else:
            moved = {"week": F.date_add(day, 7 * by), "month": F.add_months(day, by), "year": F.add_months(day, 12 * by)}[u]
            period = whole(moved, F.lit(u))
        out = out.when(phrase.rlike(rf"\b{p}\b"), period)
    return out


# --- numbers in cells ----------------------------------------------------------------------------

LAYOUT_NUMBER = r"^\s*[(\[]?-?[\d٠-٩][\d٠-٩,،.\s]*%?[)\]]?\s*$"


def layout_number(cell: Column) -> Column:
    """A figure as a layout shows it: brackets, separators, a percent sign; a lone dash is none."""
    return cell.rlike(LAYOUT_NUMBER)


def table_number(cell: Column) -> Column:
    """A figure once everything but digits, dots, dashes and slashes is left out."""
    rest = F.regexp_replace(cell, r"[^0-9.\-/]", "")
    return (rest != "") & (rest.try_cast("double").isNotNull() | rest.rlike(r"^[0-9./-]{4,}$"))


def strip_thousands(value: Column) -> Column:
    return F.regexp_replace(value, "[, ]", "")


def number_supported(cell: Column, evidence: Column) -> Column:
    """Every number of the cell is in the evidence, with or without separators; without numbers true."""
    numbers = F.filter(F.transform(F.regexp_extract_all(cell, F.lit(r"\d[\d,.]*"), F.lit(0)), lambda x: F.regexp_replace(x, r"[.,]+$", "")), lambda x: x != "")
    flat = F.regexp_replace(evidence, ",", "")
    return F.forall(numbers, lambda x: F.contains(evidence, x) | F.contains(flat, F.regexp_replace(x, ",", "")))


# --- outcomes and model texts --------------------------------------------------------------------


def outcome(source: Column, grounded: Column) -> Column:
    return F.when(source == "web", "web").when(grounded, "answered").when(source == "none", "refused").otherwise("clarified")


def logged_outcome(source: Column, grounded: Column, choices: Column) -> Column:
    return F.when(grounded, "answered").when(choices, "clarified").when(source == "web", "web").otherwise("refused")


def json_object(raw: Column) -> Column:
    """From the first brace to the last, if that is JSON."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    # in brackets, so that whatever follows the object makes it unsound
    return F.when((found != "") & F.try_parse_json(F.concat(F.lit("["), found, F.lit("]"))).isNotNull(), found)


# --- lessons and terms ---------------------------------------------------------------------------

_LEAST, _MOST, _TRIM = 12, 1000, " \t\n\r،,:؛—-.«»ـ"
_SIGNALS = [(name, sure, re.compile(rf"(?<![\w])(?:{'|'.join(re.escape(T.fold(w)) for w in sorted(ws, key=len, reverse=True))})(?:(?![\w])|(?<=[بلك]))")) for name, (sure, ws) in V.SIGNALS.items()]


@lru_cache(maxsize=1 << 16)
def _character(c: str) -> str:
    return T.fold(unicodedata.normalize("NFKC", c))


def _folded(text: str) -> tuple[str, list[int]]:
    """Normalised text and, for each of its characters, where the original goes on after it."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in _character(c) or (" " if c.isspace() and out and out[-1] != " " else ""):
            out.append(x)
            at.append(i + 1)
    while out and out[-1] == " ":
        out.pop(), at.pop()
    return "".join(out), at


def lesson(text: str | None) -> tuple[str, float, str] | None:
    """(kind, how sure, claim) of a message that teaches; the claim is lifted from the text as written."""
    text = (text or "").strip()
    if not _LEAST <= len(text) <= _MOST:
        return None
    norm, at = _folded(text)
    for name, sure, pattern in _SIGNALS:
        if m := pattern.search(norm):
            claim = text[at[m.end() - 1] :].strip(_TRIM) or text
            low, back = _folded(claim)
            lead = next(((low.index(w) + len(w)) for w in V.LEAD_INS if w in low), 0)
            if lead and len(rest := claim[back[lead - 1] :].strip(_TRIM)) >= _LEAST:
                claim = rest
            if len(claim) >= _LEAST:
                sure += 0.1 * (m.start() <= 3) - 0.25 * (norm.endswith("?") or "؟" in text)
                return name, round(max(0.05, min(sure, 0.95)), 2), claim.strip()
    return None


def signals(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, signal, sure, claim`` of the messages that teach something."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *found) for k, t in zip(b[key], b[text]) if (found := lesson(t))]
            yield pd.DataFrame(rows, columns=[key, "signal", "sure", "claim"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, signal string, sure double, claim string")


def lessons_sql(listed) -> str:
    """What the example messages teach, by hand."""
    claims = {
        0: ("fact", 0.65, "'the delivery fee of zone ' || o_orderkey || ' is 12 AED'"), 1: ("rule", 0.85, "'always show totals before notes for ' || o_orderkey || ' orders'"),
        2: ("correction", 0.8, "'the correct value is forty'"), 3: ("terminology", 0.6, "'ه «جدول الكميات ' || o_orderkey || '» في المستندات'"),
        5: ("preference", 0.8, "'short answers of ' || o_orderkey || ' lines'"), 6: ("terminology", 0.7, "'party ' || o_orderkey || ' refers to the buyer'"),
    }
    case = lambda k: "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {v[k] if k == 2 else repr(v[k])}" for i, v in claims.items()) + " END"
    return f"{case(0)} AS signal, ({case(1)})::DOUBLE AS sure, {case(2)} AS claim"


def term_pair(content: Column) -> tuple[Column, Column]:
    """Both sides of a statement about terms, five words at most each: two quoted ones, or a = b."""
    quoted = F.regexp_extract_all(content, F.lit("«([^»]{2,60})»"), F.lit(1))
    equal = r"^\s*([^=:]{2,60}?)\s*(?:=|:|يعني|تعني)\s*([^=:]{2,60})\s*$"
    n = T.normalize(content)
    side = lambda k: F.nullif(F.when(F.size(quoted) == 2, T.normalize(F.get(quoted, k))).otherwise(F.trim(F.regexp_extract(n, equal, k + 1))), F.lit(""))
    a, b = side(0), side(1)
    good = (a != b) & (F.size(F.split(a, " ")) <= 5) & (F.size(F.split(b, " ")) <= 5)
    return F.when(good, a), F.when(good, b)


def offered(answer: Column) -> Column:
    """What "if you mean ..., " offers, in five words at most."""
    meant = T.normalize(F.regexp_replace(F.regexp_extract(answer, r"(?:إن|ان|إذا|اذا)\s+كنت\s+تقصد\s+([^،,.\n]{2,80}?)\s*[،,]", 1), "[«»\"']", ""))
    return F.when((meant != "") & (F.size(F.split(meant, " ")) <= 5), meant)


#: Verbs of making or giving, formats by name, words of a request that are not its question's, and
#: what a request may be about.
_MAKE = (
    r"(?:اعمل|اعملي|إعمل|اعملى|سوّي|سوي|سويلي|هات|هاتلي|هاتلى|ابعت|ابعتلي|ارسل|أرسل|حول|حوّل|حولي|حوّلي|صدّر|صدر|طلّع|طلع|طلعلي|جهز|جهّز|جهزلي|انشئ|أنشئ|اكتب|اكتبلي|"
    r"اعطني|أعطني|عايز|عاوز|ابغى|أبغى|ابي|أبي|نزّل|نزل|generate|create|make|export|give\s+me|convert|prepare|send\s+me)"
)
_FORMATS = {"pdf": r"pdf|بي\s*دي\s*[اإ]ف|بى\s*دى\s*[اإ]ف|بدف", "docx": r"word|docx|وورد|ورد", "xlsx": r"excel|xlsx|اكسل|إكسل|اكسيل|إكسيل|اكسال|شيت|spreadsheet"}
_JOINING = r"(?iU)(?:\s|^)(?:لـ|ل|بـ|ب|بال|كـ|ك|الى|إلى|to|as|in)\s*$"
_FILLERS = tuple(
    """لي لى ملف ملفات بصيغة كملف فايل نسخة فيه فيها عليه عليها
    please a an the file as in to into for me of with
    لـ ل ب بـ يا من فضلك لو سمحت شكل على في صيغة""".split()
)
_PHRASES = r"(?iU)(?:على|في)\s+شكل|من\s+فضلك|لو\s+سمحت|بصيغة"
_LISTS = ("جدول", "قائمة", "ملخص", "مقارنة", "تفاصيل", "بنود", "كل", "جميع", "ارقام", "أرقام")
_CONVERSATION = r"(?iU)المحادث[ةه]|الشات|المحاور[ةه]|كل\s+(?:الكلام|اللي\s+فات)|conversation|chat"
_SUMMARY = r"(?iU)ملخص|لخص|تلخيص|ملخّص|summary|summari[sz]e"
_THAT = r"(?iU)^(?:دا|ده|دي|هذا|هذه|هذي|الإجابة|الاجابة|الرد|الجواب|الكلام\s+(?:دا|ده|هذا)|الجدول\s+(?:دا|ده|هذا)|it|this|that|the\s+answer)?$"
_EDGES = r"^[ .،,:\-—]+|[ .،,:\-—]+$"


def _request_words_off(text: Column) -> Column:
    """Words of a request at both ends dropped; the same words within belong to the question."""
    verb = rf"(?:و)?{_MAKE}(?:لي|لى|ي|ني)?"
    out = F.regexp_replace(text, _PHRASES, " ")
    for _ in range(3):
        out = F.regexp_replace(out, rf"(?iU)^\s*{verb}(?=\s|$)", "")
    words = F.filter(F.split(out, r"\s+"), lambda w: w != "")
    own = lambda ws: F.transform(ws, lambda w: ~(F.lower(w).isin(*_FILLERS) | w.rlike(rf"(?iU)^{verb}$")))
    ahead = lambda ws: F.when(F.array_contains(own(ws), True), F.array_position(own(ws), True)).otherwise(F.size(ws) + 1)
    lead = F.slice(words, ahead(words).cast("int"), F.size(words))
    back = F.reverse(lead)
    kept = F.reverse(F.slice(back, ahead(back).cast("int"), F.size(back)))
    first = F.get(kept, F.lit(0))
    joined = (F.length(first) > 4) & F.startswith(first, F.lit("ب")) & (first.rlike("^ب(?:ال|أ|ا)") | F.substring(first, 2, 1 << 20).isin(*_LISTS))
    return F.concat_ws(" ", F.when(joined, F.concat(F.array(F.substring(first, 2, 1 << 20)), F.slice(kept, 2, F.size(kept)))).otherwise(kept))


def file_request(question: Column) -> tuple[Column, Column, Column]:
    """Format, subject and cleaned question of a request for a file: of the last answer, of the conversation, or
    of a question of its own. Null for other questions, the question null for the first two."""
    text = F.trim(F.regexp_replace(question, r"\s+", " "))
    whole = rf"(?isU)\A(.*?)(?<![\w.])({'|'.join(_FORMATS.values())})(?![\w])(.*)\z"
    asked = text.rlike(whole) & text.rlike(rf"(?iU)(?:^|\s|و){_MAKE}")
    word = F.regexp_extract(text, whole, 2)
    form = F.lit(None).cast("string")
    for name, p in reversed(_FORMATS.items()):
        form = F.when(word.rlike(rf"(?iU)^(?:{p})$"), name).otherwise(form)
    before = F.regexp_replace(F.regexp_extract(text, whole, 1), _JOINING, " ")
    rest = F.trim(F.regexp_replace(F.concat(before, F.lit(" "), F.regexp_extract(text, whole, 3)), r"[\s؟?]+", " "))
    rest = F.regexp_replace(_request_words_off(F.regexp_replace(rest, _EDGES, "")), _EDGES, "")
    words = F.size(F.filter(F.split(rest, r"\s+"), lambda w: w != ""))
    subject = F.when(rest.rlike(_CONVERSATION) | (rest.rlike(_SUMMARY) & (words <= 3)), "conversation").when(rest.rlike(_THAT) | (words <= 1), "last").otherwise("question")
    return F.when(asked, form), F.when(asked, subject), F.when(asked & (subject == "question"), F.concat(rest, F.lit("؟")))


LEADING_QUESTION = r"(?i)^\s*(?:ما\s+هي|ما\s+هو|ماذا|ما|كم|هل|متى|أين|اين|كيف|من|لماذا|what|how|when|is|are)\s+"


def attached(question: Column, subject: Column) -> Column:
    """One question of a follow-up and the subject that it leans on, in the follow-up's language."""
    bare = lambda c: F.regexp_replace(F.trim(c), r"[؟?.\s]+$", "")
    topic = bare(F.regexp_replace(subject, LEADING_QUESTION, ""))
    english = F.concat(bare(question), F.lit(" regarding "), topic, F.lit("?"))
    return F.when(language_of(question) == "en", english).otherwise(F.concat(bare(question), F.lit(" بخصوص "), topic, F.lit("؟")))


# --- names of files ------------------------------------------------------------------------------

VERSION_TOKEN = r"^(?:v\d+|\d+|rev\d*|r\d+)$"


def file_tokens(text: Column) -> Column:
    return F.filter(F.split(T.normalize(text), "[^0-9a-z؀-ۿ]+"), lambda t: t != "")


def stem_tokens(filename: Column) -> Column:
    return file_tokens(F.regexp_replace(filename, r"\.[^.]*$", ""))


def base_tokens(name: Column) -> Column:
    """The tokens that are no version, or all of them where all are."""
    base = F.filter(name, lambda t: ~t.rlike(VERSION_TOKEN))
    return F.when(F.size(base) > 0, base).otherwise(name)


def holds_run(tokens: Column, run: Column) -> Column:
    """Whether the run of tokens is in there, one after another."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return (F.size(run) > 0) & F.contains(padded(tokens), padded(run))


# --- repair --------------------------------------------------------------------------------------

PRESENTATION = r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}]"
_PERCENT = r"(?<![\d,./])(?:90|9/)(\d{1,2})(?![\d,./])(\)?)(?=\s*(?:\S+\s+){0,2}?(?:من\s+(?:قيمة|المقاولة|العقد|الأعمال|مبلغ)|بالمائة|بالمئة|في\s+المائة|في\s+المئة))"


def repaired(df: DataFrame, key: str, raw: str) -> DataFrame:
    """``key, text``. Only rows that hold presentation forms leave Spark's own expressions: for those
    alone Unicode's compatibility forms are taken, and stretches dropped."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200B}\x{FEFF}]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?<=[\p{L}\p{N}])\x{AD}(?=[\p{L}\p{N}])", "-"), r"\x{AD}", "")
    text = F.when(F.upper(F.trim(text)).isin(*V.SPREADSHEET_ERRORS), "").otherwise(F.trim(text))
    clean = df.select(key, text.alias("text"))
    kind = clean.schema[key].dataType.simpleString()

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [unicodedata.normalize("NFKC", t).replace("ـ", "").strip() for t in b["text"]]
            yield b

    odd = F.col("text").rlike(PRESENTATION)
    return clean.where(~odd).unionByName(clean.where(odd).mapInPandas(forms, f"{key} {kind}, text string"))


def percentages(text: Column) -> Column:
    return F.regexp_replace(text, _PERCENT, "$1%$2")
