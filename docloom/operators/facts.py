"""Facts in running text, their dates and standing, and matching under tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the kinds of fact, in the order in which a value is classified.
KINDS = (
    ("date", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("percentage", r"\d+(?:\.\d+)?%"),
    ("amount", r"\d{1,3}(?:,\d{3})*\.\d{2} AED"),
    ("duration", r"\d+ (?:days|weeks|months)"),
    ("identifier", r"[A-Z]{2,4}-\d{3,}"),
)
#: Words that say what has been replaced, and what holds.
SUPERSEDED, CURRENT = r"(?i)(?:^|[^\p{L}])(?:superseded|replaced|cancelled)(?:[^\p{L}]|$)", r"(?i)(?:^|[^\p{L}])(?:in force|current)(?:[^\p{L}]|$)"


def facts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, kind, value`` once each: all patterns over a text in one pass."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("vs")) for k, p in KINDS])
    per = df.select(key, F.explode(found).alias("f"))
    return per.select(key, F.col("f.kind").alias("kind"), F.explode("f.vs").alias("value"))


def classify(value: Column) -> Column:
    """The first kind whose pattern is the whole value, else ``attribute``."""
    out = F.lit("attribute")
    for k, p in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{p})$"), k).otherwise(out)
    return out


def dates(text: Column) -> Column:
    """Days of all D/M/Y dates that exist, in order."""
    found = F.regexp_extract_all(text, F.lit(KINDS[0][1]), F.lit(0))
    return F.array_compact(F.transform(found, lambda d: F.try_to_date(d, "d/M/yyyy")))


def standing(text: Column) -> Column:
    """Replaced is looked for first."""
    return F.when(text.rlike(SUPERSEDED), "superseded").when(text.rlike(CURRENT), "current").otherwise("unknown")


def band_join(left: DataFrame, right: DataFrame, group: tuple[str, str], value: tuple[str, str], width: float) -> DataFrame:
    """Rows of one group whose values are no more than ``width`` apart: values fall into buckets
    of that width, so what can match is in the same or a neighbouring one (an equi-join)."""
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    near = right.withColumn("__b", F.explode(F.array(at(value[1]) - 1, at(value[1]), at(value[1]) + 1)))
    same = (F.col(group[0]) == F.col(group[1])) & (at(value[0]) == F.col("__b"))
    return left.join(near, same).where(F.abs(F.col(value[0]) - F.col(value[1])) <= width).drop("__b")


def swaps(word: Column) -> Column:
    """All spellings with two neighbouring letters exchanged."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(word, 1, i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word))),
    )


def unswapped(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word, fixed``: words outside the counted vocabulary become its most frequent word that is
    one exchange of letters away (ties by spelling), by an equi-join on the spellings."""
    known = words.join(vocabulary.select("word"), "word", "left_anti").where(F.length("word") >= 3).select("word").distinct()
    tries = known.select("word", F.explode(F.array_distinct(swaps(F.col("word")))).alias("t"))
    hits = tries.join(vocabulary.withColumnRenamed("word", "t"), "t")
    best = hits.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("n"), "t"))["t"].alias("fixed"))
    return best
