"""Facts in text: eleven kinds by pattern, label and value rows, what leads a fact sheet, dated sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import language as L
from docloom.operators import retrieval as R

#: Kinds of fact and their patterns; group 1 is the value. Organisations have two.
KINDS = (
    ("date", r"(?:^|[^\d/-])(\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{4}-\d{1,2}-\d{1,2})\b"),
    ("percentage", r"(?:^|[^\d.,])(\d{1,3}(?:[.,]\d+)?\s*%)"),
    ("amount", r"(?:^|[^\d.,])(\d{1,3}(?:,\d{3})+(?:\.\d+)?\s*(?:درهم|AED|dirham|د\.إ)?|\d+(?:\.\d+)?\s*(?:درهم|AED|dirham))"),
    ("duration", r"(?:^|[^\d.,])(\d+(?:\.\d+)?\s*(?:يوم[؀-ۿ]*|أيام|شهر[؀-ۿ]*|أشهر|سنة|سنوات|days?|months?|years?|weeks?|أسابيع|أسبوع)\b)"),
    ("clause", r"((?:البند|المادة|الفقرة)\s*(?:رقم\s*)?[\d]+(?:[./-]\d+)*|Sub-?Clause\s*\d+(?:\.\d+)*|Clause\s*\d+(?:\.\d+)*)"),
    ("form", r"((?:نموذج|form)\s+[A-Z0-9][A-Za-z0-9-]{2,}|\b[A-Z]{2,5}-F-\d{2,4}\b)"),
    ("organization", r"((?:شركة|مؤسسة|بنك|بلدية|دائرة|هيئة|وزارة)\s+[؀-ۿ][؀-ۿ\s]{2,45}?)(?:\s*[|،.\n]|\s+ذ\.م\.م|$)"),
    ("organization", r"(?:^|[^A-Za-z])([A-Z][A-Za-z]{2,}(?:\s+[A-Z][A-Za-z]{2,}){1,4}\s+(?:Consultancy|Engineering|Contracting|Construction|LLC|Ltd))\b"),
    ("person", r"((?:المهندس|المهندسة|م\.|السيد|السيدة|الدكتور|د\.|الخبير|المحامي)\s*/?\s*[؀-ۿ]{2,}(?:\s+[؀-ۿ]{2,}){1,4})"),
    ("location", r"((?:القطعة|قطعة|Plot)\s*(?:رقم\s*)?\d+)"),
    ("identifier", r"(?:^|[^A-Za-z0-9/-])([A-Za-z0-9]{2,}(?:[-/][A-Za-z0-9]{2,}){1,6})\b"),
)
#: Words that start no name, so that a title before one of them is prose.
NO_NAMES = tuple(
    T.fold(w)
    for w in """
في من على عن الى إلى لدى نحو خلال عبر مع بعد قبل عند حتى ثم او أو لا ما هو هي
لن لم لما كلما بلا دون سوى كان كانت يكون تكون التي الذي الذين هذا هذه ذلك تلك
مخول مخوَّل مكلف مطالب ملزم قال قالت طلب طلبت أرسل ارسل أعلن اعلن ردَّ رد ردت
أزال ازال أكد اكد رفض رفضت وافق أضاف اضاف ذكر ذكرت بيّن بين أوضح اوضح منح منحت
لديه لديها عليه عليها إليه اليه له لها به بها منه منها
""".split()
)
DATE = r"^(?:\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{4}-\d{1,2}-\d{1,2})$"
ROW = r"^\s{0,3}\|([^|]+)\|([^|]*)\|?\s*$"
SEPARATOR = r"^\s{0,3}\|[\s:|-]+\|\s*$"
HEADER_WORDS = ("البند", "التفاصيل", "القيمه", "item", "value")
#: Order of kinds on a fact sheet, and its length; terms, labels and sentences of a summary.
PRIORITY, SHEET = ("amount", "date", "percentage", "duration", "person", "organization"), 45
TERMS, LABELS, SENTENCES = 12, 14, 3


def useful(kind: str, value: Column) -> Column:
    fits = (value != "") & (F.length(value) <= 120)
    if kind == "person":
        words = F.split(value, r"\s+")
        return fits & (F.size(words) >= 2) & ~T.normalize(F.get(words, F.lit(1))).isin(*NO_NAMES)
    if kind == "identifier":
        return fits & (F.length(value) >= 7) & value.rlike(r"\d") & ~value.rlike(DATE)
    return fits & (F.length(value) >= 8) if kind == "organization" else fits


def _keep(kind: str):
    return lambda v: useful(kind, v)


def classify(value: Column) -> Column:
    """The first kind of which the pattern is the whole value; else an attribute."""
    order = ("date", "percentage", "amount", "duration", "identifier", "person", "organization")
    out = F.lit("attribute")
    for kind in reversed(order):
        for k, p in KINDS:
            if k == kind:
                hit = F.regexp_extract(value, _swift(k, p), 1) == value
                out = F.when(hit & value.rlike(r"\d") if k == "identifier" else hit, kind).otherwise(out)
    return out


def _swift(kind: str, pattern: str) -> str:
    """The pattern as Java searches it best. What must stand before a value is looked back at, not matched: a value is then
    tried where it begins alone. What a match has ended with stands before no other, so none begins at its end. Runs of an
    identifier are possessive, as none of its characters follows one and a shorter run never fits."""
    before, after = "(?:^|[^", "])("
    if pattern.startswith(before):
        at = pattern.index(after)
        pattern = rf"(?<![{pattern[len(before):at]}])(?:^|(?!\G)){pattern[at + 2:]}"
    return pattern.replace("{2,}", "{2,}+") if kind == "identifier" else pattern


def _rows(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, kind, value, label, o`` of rows of two cells; ``o`` is the line."""
    clean = lambda c: F.trim(F.regexp_replace(c, "[*_`]", ""))
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).where(F.col("line").rlike(ROW) & ~F.col("line").rlike(SEPARATOR))
    # out of a generator, so that the filters below don't work both cells out again
    cells = F.struct(clean(F.regexp_extract("line", ROW, 1)).alias("label"), clean(F.regexp_extract("line", ROW, 2)).alias("value"))
    rows = lines.select(key, "at", F.inline(F.array(cells)))
    rows = rows.where((F.col("label") != "") & (F.col("value") != "") & (F.length("value") <= 300) & ~T.normalize(F.col("label")).isin(*HEADER_WORDS))
    return rows.select(key, classify(F.col("value")).alias("kind"), "value", "label", F.col("at").alias("o"))


def _once(found: DataFrame, key: str) -> DataFrame:
    return R.first_of(found.withColumn("n", T.normalize(F.col("value"))), [key, "kind", "n"], F.col("o"), F.col("value")).drop("n", "o")


def labelled(df: DataFrame, key: str, text: Column) -> DataFrame:
    """The rows of ``entities`` that have a label, for texts of up to 1,000 lines: these stand before what
    patterns find, so they are the same without it."""
    return _once(_rows(df, key, text), key)


def entities(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, kind, value, label`` once each by kind and value: rows of two cells first, then patterns; a value
    in a row is classified on its own."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(1000 + i).alias("o"), F.filter(F.transform(F.regexp_extract_all(text, F.lit(_swift(k, p)), F.lit(1)), lambda v: F.trim(v)), _keep(k)).alias("vs")) for i, (k, p) in enumerate(KINDS)])
    by = df.select(key, F.explode(found).alias("f")).select(key, F.col("f.kind").alias("kind"), F.explode("f.vs").alias("value"), F.lit("").alias("label"), F.col("f.o").alias("o"))
    return _once(_rows(df, key, text).unionByName(by), key)


def described(text: Column) -> tuple[Column, Column, Column]:
    """Whether a section has a table, a list, code."""
    return text.rlike(r"(?m)^\s{0,3}\|"), text.rlike(r"(?m)^\s{0,3}(?:[-*+]|\d{1,3}[.)])\s+"), text.rlike(r"(?m)^\s{0,3}(?:`{3,}|~{3,})")


def fact_sheet(facts: DataFrame, key: str) -> DataFrame:
    """``key, kind, value, label, place``: facts once each by label and value, those that a label names first,
    then by kind, SHEET of them."""
    one = R.first_of(facts, [key, "label", "value"], F.col("kind"))
    kind = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("kind")), F.lit(0))
    order = F.when(F.col("label") != "", 0).when(kind > 0, kind).otherwise(len(PRIORITY) + 1)
    return R.ranked(one, [key], order, F.col("kind"), F.col("value"), out="place").where(F.col("place") <= SHEET)


def ambiguous_terms(terms: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``key, term, labels``: terms of a question that name two labels or more of its facts."""
    said = facts.where("label <> ''").select(key, "label", F.explode(T.content(F.col("label"))).alias("term")).distinct()
    hit = terms.join(said, [key, "term"]).groupBy(key, "term").agg(F.countDistinct("label").alias("labels"))
    return hit.where("labels >= 2")


def dated_sections(sections: DataFrame, doc: str, as_of: Column, most: int = 14) -> DataFrame:
    """``doc, section, day, timeline_rank``: of each section the newest date of its heading or facts that is not in
    the future; the newest sections of each document. ``sections``: ``doc, section, heading, body``."""
    days = F.array_union(L.all_dates(F.col("heading")), L.all_dates(F.col("body")))
    day = F.array_max(F.filter(days, lambda d: d <= as_of))
    s = sections.select(doc, "section", day.alias("day")).where("day is not null")
    return R.ranked(s, [doc], F.desc("day"), F.col("section"), out="timeline_rank").where(F.col("timeline_rank") <= most)


def swept(dated: DataFrame, chunks: DataFrame, related: DataFrame, doc: str) -> DataFrame:
    """``doc, chunk, timeline_rank``: the first chunk of each dated section, else of the first section related
    to it; a chunk keeps its best place."""
    first = chunks.groupBy(doc, "section").agg(F.min("chunk").alias("chunk"))
    via = related.join(first.withColumnRenamed("section", "other").withColumnRenamed("chunk", "other_chunk"), [doc, "other"])
    d = dated.join(first, [doc, "section"], "left").join(via.select(doc, "section", "other_chunk"), [doc, "section"], "left")
    return d.withColumn("chunk", F.coalesce("chunk", "other_chunk")).where("chunk is not null").groupBy(doc, "chunk").agg(F.min("timeline_rank").alias("timeline_rank"))


def rivals(passages: DataFrame, doc: str, key: str, least: int = 6, share: float = 0.45, most: int = 3) -> DataFrame:
    """``key, rivals`` of passages that one in force replaces: of the same document, six terms and 45 % of the
    smaller one's in common; one that would replace more than three is none. ``passages``: ``doc, key,
    standing, terms``. Passages meet by an equi-join on terms within a document."""
    t = passages.select(doc, key, "standing", F.size("terms").alias("n"), F.explode("terms").alias("t"))
    a = t.where("standing = 'current'").select(doc, F.col(key).alias("by"), F.col("n").alias("m"), "t")
    met = t.where("standing <> 'current'").join(a, [doc, "t"]).groupBy(doc, key, "by").agg(F.count("*").alias("shared"), F.first(F.least("n", "m")).alias("smaller"))
    met = met.where((F.col("shared") >= least) & (F.col("shared") / F.col("smaller") >= share))
    met = met.withColumn("replaced", F.count("*").over(Window.partitionBy(doc, "by"))).where(F.col("replaced") <= most)
    return met.groupBy(key).agg(F.count("*").alias("rivals"))


def summary(breadcrumb: Column, labels: Column, sentences: Column, terms: Column, chars: int = 300) -> Column:
    """Breadcrumb, up to fourteen labels, and up to three sentences that fit; terms where there is neither."""
    upto = lambda i: F.aggregate(F.slice(sentences, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x))
    kept = F.filter(F.slice(sentences, 1, SENTENCES), lambda s, i: upto(i) <= chars)
    some = F.slice(labels, 1, LABELS)
    body = F.when((F.size(some) == 0) & (F.size(kept) == 0), F.array_join(terms, ", ")).otherwise(F.concat_ws(" ", F.nullif(F.array_join(some, "; "), F.lit("")), F.nullif(F.array_join(kept, " "), F.lit(""))))
    return F.concat_ws(": ", breadcrumb, body)
