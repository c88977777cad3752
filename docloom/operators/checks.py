"""Evidence sets, what an answer states of them, and whether an answer or its second version stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import retrieval as R

#: Kinds that name someone; least overlap to bind (primary evidence less), candidates, confidence by shape.
NAMED = ("attribute", "person", "organization")
BIND, BIND_PRIMARY, CANDIDATES, BY_SHAPE = 0.34, 0.2, 3, 0.15
LEAST_PART, LEAST_DIGITS = 0.34, 3
CITATION = r"\[(\d{1,2})\]"


def evidence(facts: DataFrame, key: str) -> DataFrame:
    """One item for each kind, label and value (normalised) of a question's facts: the first by origin and
    place. All origins are one pool."""
    same = [key, "kind", "nl", "nv"]
    f = facts.withColumns({"nl": T.normalize(F.col("label")), "nv": T.normalize(F.col("value"))})
    return R.first_of(f, same, F.col("origin"), F.col("place"))


def names_someone(value: Column) -> Column:
    """Two words or more that are no figures."""
    return F.size(F.filter(T.content(value), lambda t: ~t.rlike(r"^\d+$"))) >= 2


def present(value: Column, answer: Column) -> Column:
    """A value stands in a normalised answer whole, or by two of its words (all, if it has one)."""
    words = F.filter(T.content(value), lambda t: F.length(t) > 2)
    hits = F.size(F.array_intersect(words, T.content(answer)))
    return F.contains(answer, T.normalize(value)) | ((F.size(words) > 0) & (hits >= F.greatest(F.lit(1), F.least(F.lit(2), F.size(words)))))


def shape_fits(kind: Column, value: Column, label: Column) -> Column:
    """Whether a value can answer a requirement of this kind at all."""
    dated = r"\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{4}-\d{1,2}-\d{1,2}"
    return (F.trim(value) != "") & F.when(kind == "date", value.rlike(dated) | label.rlike(dated)).when(kind == "number", value.rlike(r"\d")).when(kind.isin("person", "organization"), names_someone(value)).otherwise(True)


def compatible(wanted: Column, kind: Column) -> Column:
    return (wanted == kind) | ((wanted == "number") & kind.isin("amount", "percentage", "duration", "identifier")) | kind.isin("attribute")


def bound(requirements: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """``key, requirement, item, confidence, shape_only``: the three items of a compatible kind and shape whose
    label and section echo most of the requirement's words; where none does and the kind says what a value
    looks like, primary ones of that shape at little confidence."""
    described = F.array_union(T.content(F.col("label")), T.content(F.col("section")))
    # exploded, so that filters on what comes of it don't work it out anew
    items = items.withColumn("described", F.explode(F.array(described)))
    met = requirements.join(items, key).where(compatible(F.col("wanted"), F.col("kind")) & shape_fits(F.col("wanted"), F.col("value"), F.col("label")))
    overlap = F.when(F.size("terms") > 0, F.size(F.array_intersect("terms", "described")) / F.size("terms")).otherwise(0.0)
    met = met.withColumn("overlap", overlap)
    good = met.where(F.col("overlap") >= F.when(F.col("primary"), BIND_PRIMARY).otherwise(BIND)).withColumn("confidence", F.round(F.col("overlap") + F.when(F.col("primary"), 0.1).otherwise(0.0), 3))
    good = good.withColumn("shape_only", F.lit(False))
    rest = met.where(F.col("primary") & F.col("wanted").isin("person", "organization", "date", "number")).join(good.select(key, "requirement").distinct(), [key, "requirement"], "left_anti")
    rest = rest.withColumns({"confidence": F.lit(BY_SHAPE), "shape_only": F.lit(True)})
    both = good.select(key, "requirement", "place", "confidence", "shape_only").unionByName(rest.select(key, "requirement", "place", "confidence", "shape_only"))
    return R.ranked(both, [key, "requirement"], F.desc("confidence"), F.col("place")).where(F.col("rank") <= CANDIDATES)


def cited(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))))


def unsupported(answer: Column, haystack: Column) -> Column:
    """Numbers of three digits or more in an answer (citations aside) that the evidence lacks."""
    plain = lambda c: F.regexp_replace(c, "[, ]", "")
    numbers = T.numeric_tokens(F.regexp_replace(answer, CITATION, " "))
    hay = plain(T.normalize(haystack))
    return F.filter(numbers, lambda x: (T.count_of(x, r"\d") >= LEAST_DIGITS) & ~F.contains(hay, plain(x)))


def unanswered(parts: Column, answer: Column) -> Column:
    """Parts of a question of which the answer has less than 34 % of the longer words."""
    said = T.content(answer)

    def short(p: Column) -> Column:
        words = F.filter(T.content(p), lambda t: F.length(t) > 3)
        return (F.size(words) > 0) & (F.size(F.array_intersect(words, said)) < LEAST_PART * F.size(words))

    return F.filter(parts, short)


def better(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """A second version is taken if no measure falls and one rises."""
    falls, rises = F.lit(False), F.lit(False)
    for name, was in old.items():
        falls, rises = falls | (new[name] < was), rises | (new[name] > was)
    return ~falls & rises


def slots(sections: DataFrame, cited_: DataFrame, doc: str) -> DataFrame:
    """``doc, section, citation``: a section's own citation (the last one of it), else the first of its
    document."""
    own = cited_.groupBy(doc, "section").agg(F.max("citation").alias("own"))
    first = cited_.groupBy(doc).agg(F.min("citation").alias("first"))
    s = sections.join(own, [doc, "section"], "left").join(first, doc)
    return s.select(doc, "section", F.coalesce("own", "first").alias("citation"), F.col("own").isNotNull().alias("is_own"))


def scored(answers: DataFrame) -> DataFrame:
    """``known, share, answer, context, lines`` with ``completeness, correct, invented, refused, document_hit, citation_hit``.

    An answer that cites is grounded. What the corpus knows is correct where it is grounded, cites a line that is
    there and one of the first two, and states no figure that the corpus lacks; what it doesn't know is correct
    and complete where it is refused. How complete an answer is says nothing of how correct it is."""
    sources = cited(F.col("answer"))
    grounded, wrong = F.size(sources) > 0, F.size(unsupported(F.col("answer"), F.col("context"))) > 0
    hit = F.size(F.filter(sources, lambda p: p <= F.col("lines"))) > 0
    primary = F.arrays_overlap(sources, F.array(F.lit(1), F.lit(2)))
    known, refused = F.col("known"), ~grounded
    return answers.withColumns(
        {
            "completeness": F.when(known, F.col("share")).otherwise(refused.cast("double")),
            "correct": F.when(known, grounded & hit & primary & ~wrong).otherwise(refused),
            "invented": wrong & (known | grounded),
            "refused": refused,
            "document_hit": hit,
            "citation_hit": primary,
        }
    )
