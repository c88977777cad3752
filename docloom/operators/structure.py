"""Structure of documents and pages: lines, blocks, chunks, headings, links.

A document's structure is worked out within its row by array functions, so nothing is shuffled
before there is something to count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V

#: Chunk size in characters, and sizes of a summary.
CHUNK_CHARS, SUMMARY_CHARS, SUMMARY_SENTENCES = 1400, 300, 3
HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
TAG = r"(?s)<[^>]*>"
UNSEEN = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->"


def lines(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))


def line_class(content: Column) -> Column:
    return (
        F.when(F.trim(content) == "", "blank")
        .when(content.rlike(r"^\s*#{1,6}\s"), "heading")
        .when(content.rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "list")
        .when(content.rlike(r"\|.*\|"), "table")
        .otherwise("paragraph")
    )


def blocks(classed: DataFrame, key: str) -> DataFrame:
    """Runs of lines of one class (gaps and islands): ``key, block, class, first_line, n_lines``.
    Blank lines part blocks and belong to none."""
    w = Window.partitionBy(key).orderBy("line")
    starts = F.when(F.lag("class").over(w).eqNullSafe(F.col("class")), 0).otherwise(1)
    runs = classed.withColumn("starts", starts)
    runs = runs.withColumn("block", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(key, "block", "class").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"))
    return out.where("class <> 'blank'")


def hard_cut(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Pieces of ``size`` characters, the last one shorter; an empty text has none."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def leading(text: Column, sentences: int = SUMMARY_SENTENCES) -> Column:
    """The first sentences of a text, three at most."""
    return F.slice(F.filter(F.split(text, r"[.!?]+\s+"), lambda s: F.trim(s) != ""), 1, sentences)


def summary(found: str, chars: int = SUMMARY_CHARS) -> Column:
    """Of a column of leading sentences those that fit; the first always."""
    upto = lambda i: F.aggregate(F.slice(found, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x))
    return F.array_join(F.filter(found, lambda s, i: (i == 0) | (upto(i) <= chars)), " | ")


def plain(html: Column) -> Column:
    """Visible text of a page on one line."""
    text = F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), TAG, " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def headings(html: Column) -> Column:
    """Array of (level, text) of a page's headings, in order."""
    level = F.regexp_extract_all(html, F.lit(HEADING), F.lit(1))
    body = F.regexp_extract_all(html, F.lit(HEADING), F.lit(2))
    return F.zip_with(level, body, lambda a, b: F.struct(a.cast("int").alias("level"), plain(b).alias("heading")))


def parents(found: Column) -> Column:
    """Place of each heading's parent: the nearest one before it of a smaller level; -1 if none."""
    before = lambda x, i: F.filter(F.transform(F.slice(found, 1, i), lambda y, j: F.when(y["level"] < x["level"], j)), lambda j: j.isNotNull())
    return F.transform(found, lambda x, i: F.coalesce(F.array_max(before(x, i)), F.lit(-1)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def domain_rank(host: Column) -> Column:
    """0 for authorities and what is below them, 2 for aggregators, else 1."""
    some = lambda tests: reduce(lambda a, b: a | b, tests)
    first = some([(host == h) | host.endswith("." + h) for h in V.AUTHORITATIVE_HOSTS] + [host.endswith(s) for s in V.AUTHORITATIVE_SUFFIXES])
    return F.when(first, 0).when(some([host.contains(h) for h in V.LOW_QUALITY_HOSTS]), 2).otherwise(1)


def canonical(url: Column) -> Column:
    """A URL without scheme, query, fragment and last slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://", ""), r"[?#].*$", "")
    return F.lower(F.regexp_replace(bare, r"/+$", ""))
