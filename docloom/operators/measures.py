"""Quantities that texts state, with the words that name them, and disagreements between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vocabulary as V
from docloom.operators import retrieval as R

#: Words before a number that may name it, terms that two labels share, conflicts in all.
LABEL_WINDOW, MIN_SHARED, MOST = 8, 2, 12
NUMBER = r"^\(?(\d[\d,]*)(%?)[).,:]*$"
#: A whole number and what follows it at the beginning of a segment: a list or section number.
MARKER = r"^\s*\d+\s*[.)\-–—/]"


def _is_stop(word: Column) -> Column:
    return word.isin(*V.ARABIC_STOPWORDS, *V.ENGLISH_STOPWORDS)


def label_terms(words: Column) -> Column:
    """Distinct words of three characters or more that are neither stopwords nor figures, sorted."""
    bare = F.flatten(F.transform(words, lambda w: F.split(w, r"[^\p{L}\p{N}_]+")))
    return F.sort_array(F.array_distinct(F.filter(bare, lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$") & ~_is_stop(w))))


def measurements(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys, segment, pos, value, unit, label`` of every quantity: segments are lines and cells of a
    table row, so that a column never lends its words to the next. Dates, codes and figures with dots
    are no quantities, nor are list numbers, bare years and single digits without a unit; two words at
    least must name it. Numbers written in words count where the text was given its digits before."""
    return _measured(segments(df, keys, text), keys)


def segments(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    cut = df.select(*keys, F.posexplode(F.split(text, r"[|\n\r;]+")).alias("segment", "raw"))
    return cut.select(*keys, "segment", T.normalize(F.col("raw")).alias("s"))


def _measured(found: DataFrame, keys: list[str]) -> DataFrame:
    words = found.where((F.trim("s") != "") & ~F.col("s").rlike(MARKER)).withColumn("ws", F.split(F.trim("s"), r"\s+"))
    w = words.select(*keys, "segment", "ws", F.posexplode("ws").alias("pos", "w"))
    at = lambda k: F.coalesce(F.get("ws", F.col("pos") + k), F.lit(""))
    before = F.when(F.col("pos") > 0, F.coalesce(F.get("ws", F.col("pos") - 1), F.lit(""))).otherwise("")
    twice = F.when(F.col("pos") > 1, F.coalesce(F.get("ws", F.col("pos") - 2), F.lit(""))).otherwise("")
    day, year = F.col("w").rlike(r"^\d{1,2}$") & at(1).rlike(r"^\p{L}+$") & at(2).rlike(r"^\d{4}\b"), F.col("w").rlike(r"^\d{4}\b") & before.rlike(r"^\p{L}+$") & twice.rlike(r"^\d{1,2}$")
    digits = F.regexp_replace(F.regexp_extract("w", NUMBER, 1), ",", "")
    following = F.regexp_extract(at(1), r"^(\p{L}+)", 1)
    unit = F.when(F.regexp_extract("w", NUMBER, 2) == "%", "%").when(F.length(following).between(2, 12) & ~_is_stop(following), following).otherwise("")
    label = label_terms(F.slice("ws", F.greatest(F.col("pos") - LABEL_WINDOW + 1, F.lit(1)), F.least(F.col("pos"), F.lit(LABEL_WINDOW))))
    # through a list of one, so that what is filtered by and returned is worked out once
    read = F.struct(digits.alias("value"), unit.alias("unit"), label.alias("label"))
    w = w.where(F.col("w").rlike(NUMBER) & ~day & ~year).select(*keys, "segment", "pos", "w", F.inline(F.array(read)))
    return w.where(is_quantity(F.col("w"), F.col("value"), F.col("unit")) & (F.size("label") >= MIN_SHARED)).drop("w")


def is_quantity(raw: Column, value: Column, unit: Column) -> Column:
    """Whether a number is a measured amount: one digit or a bare year needs a unit."""
    bare = unit == ""
    year = value.rlike(r"^\d{4}$") & value.try_cast("int").between(1900, 2100) & ~raw.contains(",")
    return ~(bare & (F.length(value) < 2)) & ~(bare & F.coalesce(year, F.lit(False)))


def compatible(a: Column, b: Column) -> Column:
    """Units of one kind: one is missing, or one begins the other."""
    return (a == "") | (b == "") | a.startswith(b) | b.startswith(a)


def conflicts(found: DataFrame, pool: str, ref: str) -> DataFrame:
    """``pool, a, b, left, right, shared`` of references within a pool that name two terms or more alike and
    state different values in compatible units; of a pair with one shared label the first, MOST for each
    pool. Readings meet within their pool, which is bounded by the caller."""
    # no side is sent to all: readings are many more than the size of the files lets expect
    left, right = (found.select(F.col(pool).alias("pool"), *[F.col(c).alias(f"{x}_{c}") for c in (ref, "segment", "pos", "value", "unit", "label")]) for x in "ab")
    differ = (F.col(f"a_{ref}") < F.col(f"b_{ref}")) & (F.col("a_value") != F.col("b_value")) & compatible(F.col("a_unit"), F.col("b_unit"))
    both = left.hint("merge").join(right.hint("merge"), "pool").where(differ).select("*", F.inline(F.array(F.struct(F.array_intersect("a_label", "b_label").alias("common")))))
    both = both.where(F.size("common") >= MIN_SHARED).withColumn("shared", F.array_join(F.sort_array("common"), " ")).drop("a_label", "b_label", "common")
    order = [F.col(c) for c in ("a_segment", "a_pos", "b_segment", "b_pos")]
    one = R.first_of(both, ["pool", f"a_{ref}", f"b_{ref}", "shared"], *order)
    out = one.select(F.col("pool").alias(pool), F.col(f"a_{ref}").alias("a"), F.col(f"b_{ref}").alias("b"), F.col("a_value").alias("left"), F.col("b_value").alias("right"), "shared")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(pool).orderBy("a", "b", "shared"))).where(F.col("place") <= MOST)


def grid(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, row, col, cell`` of the pipe rows of a text, separators left out, where there are three rows."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "s")).where(F.col("s").rlike(r"^\s*\|.*\|\s*$") & ~F.col("s").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    rows = R.ranked(lines, [key], F.col("line"), out="row").withColumn("rows", F.count("*").over(Window.partitionBy(key))).where("rows >= 3")
    cells = F.split(F.regexp_replace(F.regexp_replace("s", r"^\s*\|\s*", ""), r"\s*\|\s*$", ""), r"\s*\|\s*")
    return rows.select(key, "row", F.posexplode(cells).alias("col", "cell"))


def number_conflicts(taught: DataFrame, passages: DataFrame) -> DataFrame:
    """``item, citation, taught, stated``: of every taught item the first passage (``group, citation, terms,
    numbers``) of its group with two shared terms and other numbers only."""
    both = taught.join(passages, "group").where((F.size(F.array_intersect("item_terms", "terms")) >= 2) & (F.size("item_numbers") > 0) & (F.size("numbers") > 0) & ~F.arrays_overlap("item_numbers", "numbers"))
    one = R.first_of(both, ["item"], F.col("citation"))
    few = lambda c: F.array_join(F.slice(F.sort_array(c), 1, 3), ", ")
    return one.select("item", "citation", few("item_numbers").alias("taught"), few("numbers").alias("stated"))
