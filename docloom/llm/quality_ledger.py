"""Quality rules as a bitmask ledger, in Spark's own expressions only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit
for each failed rule; a policy is a mask of the bits that reject, so policies of any version,
and what each rule of a policy costs, are bit operations on the ledger and never read the texts
again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import WORD, table, text_or_empty, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Marks that begin a list line, and what ends a line that breaks off.
BULLETS, ELLIPSES = r"^[\x20\t]*[-*\x{2022}]", r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bullets", "n_ellipses", "n_wordlike")


#: The position of a rule is its bit: append new rules, never reorder them.
RULES = ("short", "repeated", "symbols", "dup_lines", "upper", "word_length", "bullets", "ellipses", "wordlike")


def rules() -> dict[str, Column]:
    """Rule name to a test of the measurements that is true where a document fails."""
    n = F.col("n_words")
    tests = {
        "short": n < 20,
        "repeated": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "upper": 100 * F.col("n_upper") > 40 * F.col("word_chars"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "bullets": 10 * F.col("n_bullets") > 9 * F.col("n_lines"),
        "ellipses": 10 * F.col("n_ellipses") > 3 * F.col("n_lines"),
        "wordlike": 10 * F.col("n_wordlike") < 8 * n,
    }
    return {r: tests[r] for r in RULES}


@dataclass(frozen=True)
class Policy:
    version: int
    rejects: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rejects)


BASE = Policy(1, ("short", "repeated"))
#: Repeated lines are measured but don't reject: licence lines and footers repeat in good texts.
CURRENT = Policy(2, ("short", "repeated", "symbols", "upper", "word_length"))
#: Measured for comparison: lists and lines that break off, and texts of few words with letters.
STRICT = Policy(3, (*CURRENT.rejects, "dup_lines", "bullets", "ellipses", "wordlike"))
POLICIES = (BASE, CURRENT, STRICT)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` as the struct ``row``, the measurements and ``fail_bits``.

    A null text counts as an empty one, which has 0 everywhere and fails ``short``. Repeated
    rows are rows of their own. All of a document's work is within its row: no shuffle.

    ``n_repeat_words``: windows of eight words are compared by 64-bit hash within one text; the
    positions of windows found again are sorted, and each adds the words up to the next one,
    eight at most."""
    long = lambda c: c.cast("long")
    df = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("t"))
    df = df.withColumn("w", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    df = df.select("row", "t", "w", lines.alias("lines"), long(F.size("w")).alias("n_words"))
    df = df.select(
        "row",
        "w",
        "n_words",
        long(F.length(F.array_join("w", ""))).alias("word_chars"),
        long(F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).alias("n_upper"),
        long(F.size(F.filter("lines", lambda x: x.rlike(BULLETS)))).alias("n_bullets"),
        long(F.size(F.filter("lines", lambda x: x.rlike(ELLIPSES)))).alias("n_ellipses"),
        long(F.size(F.filter("w", lambda x: x.rlike(r"\p{L}")))).alias("n_wordlike"),
        F.when(
            F.size("w") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))),
        ).alias("h"),
    ).drop("w")
    again = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("s", F.when(again, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.drop("h").withColumn(
        "p",
        F.sort_array(
            F.array_compact(
                F.transform(
                    "s",
                    lambda x, k: F.when(
                        (F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"]), x["i"]
                    ),
                )
            )
        ),
    )
    step = F.transform("p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - p, F.lit(WINDOW))))
    df = df.drop("s").withColumn(
        "n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    )
    bits = [F.when(test, F.lit(1 << k)).otherwise(0) for k, test in enumerate(rules().values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    # A hint to the optimizer: a column that it holds to be not deterministic stops it from pushing a
    # filter on the bits below all of the above, with the split into words copied into each measure.
    # Storing the ledger would do the same at the cost of another copy of the texts.
    fixed = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))
    return df.drop("p").select("row", *MEASURES, total.cast("long").bitwiseOR(fixed).alias("fail_bits"))


def kept(policy: Policy) -> Column:
    """True where no rule of the policy has failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and each of its rules: documents that fail it, that only it rejects, and
    that are kept with and without it.

    The ledger is first counted by its bits, at most 2 to the number of rules, so everything
    after that is a few rows whatever the input. An empty ledger gives zeros."""
    by_bits = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    of = F.array(
        *[
            F.struct(F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit"))
            for p in policies
            for r in p.rejects
        ]
    )
    zero = entries.sparkSession.range(1).select(F.lit(0).cast("long").alias("fail_bits"), F.lit(0).cast("long").alias("n"))
    one = by_bits.unionByName(zero).select("fail_bits", "n", F.explode(of).alias("a"))
    failed = F.col("fail_bits").bitwiseAND(F.col("a.mask"))
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return one.groupBy("a.version", "a.rule").agg(
        count(F.col("fail_bits").bitwiseAND(F.col("a.bit")) != 0).alias("fails"),
        count(failed == F.col("a.bit")).alias("only_this"),
        count(failed == 0).alias("kept"),
        count(failed.bitwiseAND(F.bitwise_not(F.col("a.bit"))) == 0).alias("kept_without"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0).alias("base_failed"),
        kept(CURRENT).alias("kept"),
        "fail_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, over all documents."""
    return ablations(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the current policy keeps."""
    return ledger(docs).where(kept(CURRENT)).select("row.*")


_LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS k
  FROM d, unnest(range(1, len(w) - 6)) AS r(i) WHERE len(w) > 8),
twice AS (
  SELECT doc_id, i FROM win
  QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_upper,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_wordlike,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
e AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words,
         (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
         + 8 * (10 * (len(ls) - len(list_distinct(ls))) > 3 * len(ls))::BIGINT + 16 * (100 * n_upper > 40 * word_chars)::BIGINT
         + 32 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
         + 64 * (10 * len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\t]*[-*\x{2022}]'))) > 9 * len(ls))::BIGINT
         + 128 * (10 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) > 3 * len(ls))::BIGINT
         + 256 * (10 * n_wordlike < 8 * n_words)::BIGINT AS fail_bits
  FROM m)
"""
ORACLE = _LEDGER_SQL + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 55) = 0 AS kept, fail_bits FROM e
"""
ABLATIONS = _LEDGER_SQL + """, a AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({p.version}, {p.mask}, '{r}', {1 << RULES.index(r)})" for p in POLICIES for r in p.rejects
) + """) AS a(version, mask, rule, bit))
SELECT version::INTEGER AS version, rule, count(*) FILTER ((fail_bits & bit) <> 0) AS fails, count(*) FILTER ((fail_bits & mask) = bit) AS only_this,
       count(*) FILTER ((fail_bits & mask) = 0) AS kept, count(*) FILTER ((fail_bits & mask & ~bit) = 0) AS kept_without FROM e, a GROUP BY version, rule
"""
