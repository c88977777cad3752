"""Filing and chunking: kinds of documents, names of projects, chunks with overlap, small units merged."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vocabulary as V
from docloom.operators import retrieval as R

#: Characters of a chunk, of what two chunks share, and of a unit that is merged.
CHUNK, OVERLAP, SMALL = 1400, 200, 200


def hinted(text: Column, hints: dict[str, tuple[str, ...]], least: int = 2, none: str = "general") -> Column:
    """The kind of which most hints are in the normalised text, of equal ones the first listed; ``least``
    are needed."""
    scores = [(sum((F.contains(text, F.lit(T.fold(w))).cast("int") for w in ws), F.lit(0)), k, name) for k, (name, ws) in enumerate(hints.items())]
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for n, k, name in scores]))
    return F.when(best["n"] >= least, best["name"]).otherwise(none)


def filed(head: Column, top: Column, body: Column, kinds: dict[str, tuple[str, ...]] = V.FILING) -> Column:
    """The kind that words point to: 3 for each in the name or title, else 2 in the first lines, else 1 in
    the text; two are needed, of equal ones the first listed wins."""
    points = lambda w: F.when(F.contains(head, F.lit(w)), 3).when(F.contains(top, F.lit(w)), 2).when(F.contains(body, F.lit(w)), 1).otherwise(0)
    scores = [(sum((points(T.fold(w)) for w in ws), F.lit(0)), k, name) for k, (name, ws) in enumerate(kinds.items())]
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for n, k, name in scores]))
    return F.when(best["n"] >= 2, best["name"]).otherwise("")


def standing(text: Column) -> Column:
    """What normalised text says of itself: replaced is looked for first."""
    return F.when(text.rlike(T.cues(V.SUPERSEDED)), "superseded").when(text.rlike(T.cues(V.CURRENT)), "current").otherwise("unknown")


def bookkeeping(heading: Column) -> Column:
    """The cue by which a normalised heading is about the document itself; empty if none."""
    found = F.regexp_extract(heading, T.cues(V.BOOKKEEPING), 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(heading, T.cues(V.SELF_REFERENCE), 1))


def statements(df: DataFrame, key: str, text: Column, citation: Column) -> DataFrame:
    """``key, citation, kind, line``: sentences and lines of 12 to 320 characters with a figure that declare
    what is in force or what is deleted, once each by their first 120 normalised characters."""
    parts = F.split(text, r"[\n\r]+|(?<=[.؟!])\s+")
    lines = df.select(F.col(key), citation.alias("citation"), F.posexplode(parts).alias("at", "raw"))
    line = F.regexp_replace(F.regexp_replace("raw", r"[|~*`>]+", " "), r"^[\s\-—:]+|[\s\-—:]+$", "")
    lines = lines.select(key, "citation", "at", line.alias("line")).withColumn("n", T.normalize(F.col("line")))
    kind = F.when(F.col("n").rlike(T.cues(V.IN_FORCE)), "in_force").when(F.col("n").rlike(T.cues(V.DELETED)), "deletion")
    lines = lines.withColumn("kind", kind).where(F.length("line").between(12, 320) & F.col("line").rlike(r"\d") & F.col("kind").isNotNull())
    return R.first_of(lines.withColumn("same", F.substring("n", 1, 120)), [key, "same"], F.col("citation"), F.col("at")).drop("n", "same")


# --- names ---------------------------------------------------------------------------------------


def overlap_pairs(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """``l, r, overlap`` of rows ``id, ts`` (distinct tokens) whose shared tokens are at least ``share`` of
    the smaller set.

    A set that shares t of its n tokens has one of any n - t + 1 of them in common, so each side looks
    for its rarest n - t + 1 among all tokens of the other: no token that many sets have joins them all."""
    df = left.unionByName(right).select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    need = lambda n: F.ceil(n * F.lit(share)).cast("int")

    def tokens(side: DataFrame) -> DataFrame:
        t = side.select("id", F.size("ts").alias("n"), F.explode("ts").alias("t")).join(df, "t")
        t = t.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("df", "t")))
        return t.withColumn("rare", F.col("place") <= F.col("n") - need(F.col("n")) + 1).select("id", "t", "rare")

    a, b = tokens(left), tokens(right)
    met = a.select(F.col("id").alias("l"), "t", F.col("rare").alias("x")).join(b.select(F.col("id").alias("r"), "t", F.col("rare").alias("y")), "t").where("x or y").select("l", "r").distinct()
    both = met.join(left.select(F.col("id").alias("l"), F.col("ts").alias("a")), "l").join(right.select(F.col("id").alias("r"), F.col("ts").alias("b")), "r")
    overlap = F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b"))
    return both.select("l", "r", overlap.alias("overlap")).where(F.col("overlap") >= share)


def name_tokens(name: Column) -> Column:
    """Distinct words of a name that are not generic."""
    generic = F.array(*[F.lit(T.fold(w)) for w in V.GENERIC_NAMES])
    return F.array_distinct(F.filter(F.split(T.normalize(name), " "), lambda t: (F.length(t) > 1) & ~F.array_contains(generic, t)))


# --- chunks --------------------------------------------------------------------------------------


def packed(sizes: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Chunks of neighbouring blocks as (first, n, chars) from the blocks' lengths: a block opens a new
    chunk where the open one would grow beyond ``size``; the last blocks of the old one, ``overlap``
    characters at most, are carried into it. A block that is longer than a chunk is one alone, and
    nothing is carried over it. One pass over a text's blocks, in Arrow batches: an expression that folds
    them would copy the chunks it has at each."""

    @F.pandas_udf("array<struct<first:int,n:int,chars:int>>")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda blocks: None if blocks is None else _chunks(blocks.tolist(), size, overlap))

    return fold(sizes)


def _chunks(blocks: list[int], size: int, overlap: int) -> list[dict]:
    out: list[tuple[int, int, int]] = []
    first = chars = 0  # of the open chunk; its blocks are parted by two characters
    for i, x in enumerate(blocks):
        if x > size or (i > first and chars + x > size):
            if i > first:
                out.append((first, i - first, chars - 2))
            kept, carried = i, 0
            while x <= size and kept > first and carried + blocks[kept - 1] <= overlap:
                kept, carried = kept - 1, carried + blocks[kept - 1]
            if x > size:
                out.append((i, 1, x))
                first, chars = i + 1, 0
                continue
            first, chars = kept, carried + 2 * (i - kept)
        chars += x + 2
    if len(blocks) > first:
        out.append((first, len(blocks) - first, chars - 2))
    return [{"first": a, "n": n, "chars": c} for a, n, c in out]


def greedy(sizes: Column, size: Column, before: Column) -> Column:
    """Parts of neighbouring pieces as (first, n, chars): a piece opens a new part where the open one,
    which starts with ``before`` characters, would grow beyond ``size`` with it and a separator."""
    item = "struct<first:int,n:int,chars:int>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n"), before.alias("len"), F.lit(0).alias("at"))
    part = lambda s: F.struct(s["first"].alias("first"), s["n"].alias("n"), s["len"].alias("chars"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & (s["len"] + x + 1 > size)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(part(s)))).otherwise(s["done"]).alias("done"),
            F.when(full | (s["n"] == 0), s["at"]).otherwise(s["first"]).alias("first"),
            F.when(full, 1).otherwise(s["n"] + 1).alias("n"),
            (F.when(full, before).otherwise(s["len"]) + x + 1).alias("len"),
            (s["at"] + 1).alias("at"),
        )

    return F.aggregate(sizes, start, step, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(part(s)))).otherwise(s["done"]))


def merged_units(units: Column, small: int = SMALL, size: int = CHUNK) -> Column:
    """Units (at, chars, parent, place, head) in order with small ones folded into the next: where both
    have one parent and one place in the file and fit together. The longer unit names the result."""
    item = "struct<anchor:int,first:int,n:int,chars:int,longest:int,parent:int,place:int>"
    fresh = lambda u: F.struct(u["at"].alias("anchor"), u["at"].alias("first"), F.lit(1).alias("n"), u["chars"].alias("chars"), u["chars"].alias("longest"), u["parent"].alias("parent"), u["place"].alias("place"))
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("open"))

    def step(s: Column, u: Column) -> Column:
        o = s["open"]
        joins = o.isNotNull() & (o["chars"] < small) & (o["chars"] + u["chars"] + 2 <= size) & (o["parent"] == u["parent"]) & (o["place"] == u["place"])
        grown = F.struct(
            F.when(u["chars"] > o["chars"], u["at"]).otherwise(o["anchor"]).alias("anchor"), o["first"].alias("first"), (o["n"] + 1).alias("n"),
            (o["chars"] + u["chars"] + u["head"] + 3).alias("chars"), F.greatest(o["longest"], u["chars"]).alias("longest"), o["parent"].alias("parent"), o["place"].alias("place"),
        )
        done = F.when(joins | o.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(o)))
        return F.struct(done.alias("done"), F.when(joins, grown).otherwise(fresh(u)).alias("open"))

    return F.aggregate(units, start, step, lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def markdown_class(line: Column) -> Column:
    return (
        F.when(line.rlike(r"^\s*\|.*\|\s*$"), "table")
        .when(line.rlike(r"^\s*#{1,6}\s+"), "heading")
        .when(line.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+"), "bullet")
        .when(line.rlike(r"^\s*\*\*[^*]+\*\*:?\s*$"), "lead")
        .when(F.trim(line) == "", "blank")
        .otherwise("paragraph")
    )


def manifest_differences(want: DataFrame, have: DataFrame) -> DataFrame:
    """``name, state`` of two manifests ``name, digest, rows``: what a copy lacks, has besides, or has otherwise."""
    h = have.select("name", F.col("digest").alias("d2"), F.col("rows").alias("r2"))
    both = want.join(h, "name", "full")
    state = F.when(F.col("d2").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("rows") != F.col("r2"), "rows differ").when(F.col("digest") != F.col("d2"), "content differs").otherwise("same")
    return both.select("name", state.alias("state"))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
