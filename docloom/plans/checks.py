"""Checks of answers: an order is a question, its lines are facts, its answer states some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import checks as C
from docloom.operators import language as L
from docloom.operators import retrieval as R
from docloom.plans.language import content_list, normal
from docloom.plans.layout import _lines
from docloom.plans.retrieval import read


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every order from its lines, and of every second line again as knowledge."""
    k, rn = F.col("l_partkey"), F.col("rn")
    kind = F.get(F.array(*[F.lit(x) for x in ("date", "amount", "person", "attribute")]), (k % 4).cast("int"))
    value = F.when(k % 4 == 0, F.date_format(F.col("l_shipdate").cast("date"), "dd/MM/yyyy")).when(k % 4 == 1, F.format_number(k * 37 + 1000, 0)).when(k % 4 == 2, F.concat(F.lit("Agent Harbour"), k)).otherwise(F.concat(F.lit("shade"), k % 9, F.lit(" lacquer")))
    label = F.concat(F.lit("delivery of part "), F.when(k % 3 == 0, "alpha").otherwise("beta"))
    l = _lines(spark, sf_dir).select("doc", rn.alias("place"), kind.alias("kind"), label.alias("label"), value.alias("value"), F.when(k % 5 == 0, "settlement notes").otherwise("shipping terms").alias("section"), (rn <= 2).alias("primary"), F.col("l_suppkey").alias("s"), F.lit(0).alias("origin"))
    again = l.where("s % 2 = 0").withColumns({"origin": F.lit(1), "label": F.upper("label")})
    return l.unionByName(again)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc, q, answer, context``: the answer states two lines of three, and one figure of its own."""
    f = _facts(spark, sf_dir).where("origin = 0")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("s") % 3 > 0, F.struct("place", "value")))), lambda x: F.concat(x["value"], F.lit(" ["), x["place"], F.lit("]"))), "; ")
    seen = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "label", "value"))), lambda x: F.concat(x["label"], F.lit(": "), x["value"])), ". ")
    a = f.groupBy("doc").agg(said.alias("said"), seen.alias("context"), F.max("place").alias("lines"))
    q = F.when(F.col("doc") % 2 == 0, "list all delivery details of part alpha, who handles the settlement process").otherwise("when is delivery of part beta")
    return a.select("doc", q.alias("q"), F.concat("said", F.when(F.col("doc") % 5 == 0, "; about 987,654 more").otherwise("; settlement process")).alias("answer"), "context", "lines")


def evidence_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of documents and of knowledge as one pool, once each, the first origin's."""
    return C.evidence(_facts(spark, sf_dir), "doc").select("doc", "kind", "label", "value", "origin", "place")


def bound_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for what each question asks: a person and a number by the wording, else by their shape."""
    need = F.array(F.struct(F.lit("who").alias("requirement"), F.lit("person").alias("wanted"), T.content(F.lit("who handles delivery alpha")).alias("terms")), F.struct(F.lit("cost").alias("requirement"), F.lit("number").alias("wanted"), T.content(F.lit("what quayside tariff")).alias("terms")))
    r = _lines(spark, sf_dir).select("doc").distinct().select("doc", F.explode(need).alias("r")).select("doc", "r.*")
    out = C.bound(r, C.evidence(_facts(spark, sf_dir), "doc").where("origin = 0"), "doc")
    return out.select("doc", "requirement", "place", "confidence", "shape_only", "rank")


def stated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of the whole evidence the answer states."""
    e = C.evidence(_facts(spark, sf_dir), "doc").join(_answers(spark, sf_dir).select("doc", T.normalize(F.col("answer")).alias("a")), "doc")
    return e.groupBy("doc").agg(F.count("*").alias("items"), F.count_if(F.contains("a", T.normalize(F.col("value")))).alias("stated"))


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.evidence(_facts(spark, sf_dir), "doc").join(_answers(spark, sf_dir), "doc")
    exhaustive = L.exhaustive(T.normalize(F.col("q")))
    targeted = F.arrays_overlap(T.content(F.col("q")), F.array_union(T.content(F.col("label")), T.content(F.col("section"))))
    # what costs least is asked first
    owed = F.col("primary") & F.col("kind").isin(*C.NAMED) & C.names_someone(F.col("value")) & exhaustive & targeted
    return e.where(owed & ~C.present(F.col("value"), T.normalize(F.col("answer"))))


def missing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that primary evidence has for a question that wants all of them, and the answer lacks."""
    return _missing(spark, sf_dir).select("doc", "place", "label", "value")


def overlooked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing facts met with the knowledge that states the same: by kind, label and value."""
    k = _facts(spark, sf_dir).where("origin = 1").select("doc", "kind", T.normalize(F.col("label")).alias("nl"), T.normalize(F.col("value")).alias("nv"), F.col("place").alias("taught_at"))
    m = _missing(spark, sf_dir).select("doc", "kind", "nl", "nv", "place")
    return m.join(k, ["doc", "kind", "nl", "nv"]).select("doc", "place", "taught_at")


def answer_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer cites, which primary evidence it does not, figures that no evidence has, parts of the
    question that it leaves out, and whether it is complete."""
    a = _answers(spark, sf_dir)
    missing = _missing(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("omitted"))
    cited = C.cited(F.col("answer"))
    primary = F.filter(F.array(F.lit(1), F.lit(2)), lambda p: p <= F.col("lines"))
    parts = L.display_parts(F.col("q"))
    left = F.when(F.size(parts) > 1, F.size(C.unanswered(parts, F.col("answer")))).otherwise(0)
    wrong = C.unsupported(F.col("answer"), F.col("context"))
    v = a.join(missing, "doc", "left").select("doc", F.size(cited).alias("cited"), F.size(F.array_except(primary, cited)).alias("uncited"), F.array_join(wrong, " ").alias("unsupported"), left.alias("unanswered"), F.coalesce("omitted", F.lit(0)).alias("omitted"))
    return v.withColumn("complete", (F.col("unsupported") == "") & (F.col("unanswered") == 0) & (F.col("omitted") == 0) & (F.col("cited") > 0))


def accepted_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second version of an answer, which adds a line or drops its end, is taken."""
    a = _answers(spark, sf_dir)
    first = _facts(spark, sf_dir).where("origin = 0 and place = 1").select("doc", "value")
    a = a.join(first, "doc").withColumn("second", F.when(F.col("doc") % 3 == 0, F.concat("answer", F.lit("; "), "value", F.lit(" [1]"))).when(F.col("doc") % 3 == 1, F.substring_index("answer", ";", 1)).otherwise(F.concat("answer", F.lit("; 555,111"))))
    measures = lambda c: {"cited": F.size(C.cited(F.col(c))), "supported": -F.size(C.unsupported(F.col(c), F.col("context")))}
    return a.select("doc", C.better(measures("answer"), measures("second")).alias("accepted"))


def completed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a question that its answer neither numbers nor covers, two at most, with their numbers."""
    a = _answers(spark, sf_dir).select("doc", "answer", F.posexplode(L.display_parts(F.col("q"))).alias("at", "part"))
    a = a.where(~F.col("answer").rlike(r"(^|\n)\s*1[.)]")).where(F.size(C.unanswered(F.array("part"), F.col("answer"))) > 0)
    return R.ranked(a, ["doc"], F.col("at"), out="n").where("n <= 2").select("doc", (F.col("at") + 1).alias("number"), "part")


def answer_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by kind of question: share of gold values stated; answers that rest on the document and cite its
    primary lines; figures that the corpus lacks; and, of questions that the corpus can't answer (every
    eleventh), how many are refused: answered without a source."""
    e = C.evidence(_facts(spark, sf_dir), "doc").where("origin = 0").join(_answers(spark, sf_dir), "doc")
    per = e.groupBy("doc").agg(F.avg(F.contains(T.normalize(F.col("answer")), T.normalize(F.col("value"))).cast("int")).alias("share"), F.first("answer").alias("answer"), F.first("context").alias("context"), F.first("lines").alias("lines"))
    per = C.scored(per.withColumn("known", F.col("doc") % 11 > 0))
    rate = lambda c, of=None: F.round(F.avg(c.cast("double") if of is None else F.when(of, c.cast("double"))), 6)
    known = F.col("known")
    return per.groupBy((F.col("doc") % 2 == 0).alias("exhaustive")).agg(
        F.count("*").alias("n"), rate(F.col("completeness")).alias("completeness"), rate(F.col("correct")).alias("correct"), rate(F.col("invented")).alias("hallucinated"),
        rate(F.col("refused"), ~known).alias("refusal_accuracy"), rate(F.col("document_hit"), known).alias("document_accuracy"), rate(F.col("citation_hit"), known).alias("citation_accuracy"),
    )


def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound questions (two to four parts) and those that need reasoning."""
    a = _answers(spark, sf_dir)
    parts = F.size(L.display_parts(F.col("q")))
    return a.select("doc", parts.between(2, 4).alias("compound"), F.col("q").rlike(r"(?i)\b(?:why|compare|difference|total|sum)\b").alias("reasoning"))


def section_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation of each section: its own, else the first of its document."""
    l = _lines(spark, sf_dir).select("doc", F.col("l_linenumber").alias("section"), F.col("rn").alias("citation"), "l_suppkey")
    return C.slots(l.select("doc", "section").distinct(), l.where("l_suppkey % 4 = 0").select("doc", "section", "citation"), "doc")


def section_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of chosen kinds in the sections that an answer reads, of each answer 200 at most, in order."""
    f = _facts(spark, sf_dir).where("origin = 0").select("doc", "place", "kind", "value", (F.col("place") % 3).alias("section"))
    pairs = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 3).cast("int").alias("section"))
    hit = f.where(F.col("kind").isin("date", "amount")).join(pairs.distinct(), ["doc", "section"], "left_semi")
    return R.ranked(hit, ["doc"], F.col("place"), out="n").where("n <= 200").select("doc", "place", "value")


def clarified_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with one or two words that no part name has, with the name offered in their place."""
    p = read(spark, sf_dir, "part")
    asked = p.select("p_partkey", "p_name", F.explode(F.split(F.concat(F.regexp_extract("p_name", r"^\S+", 0), F.when(F.col("p_partkey") % 3 == 0, " gadgetry").when(F.col("p_partkey") % 3 == 1, " gadgetry thing odd").otherwise("")), " ")).alias("word"))
    known = p.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    unknown = asked.join(known, "word", "left_anti").groupBy("p_partkey", "p_name").agg(F.array_join(F.sort_array(F.collect_list("word")), " ").alias("asked"), F.count("*").alias("n"))
    return unknown.where("n <= 2").select("p_partkey", "asked", F.col("p_name").alias("meant"))


QUERIES = {
    f.__name__: f
    for f in (
        evidence_set, bound_evidence, stated_counts, missing_facts, overlooked_values, answer_verdict, accepted_rewrites, completed_parts, answer_eval, question_flags, section_slots, section_facts,
        clarified_terms,
    )
}

_F = """l AS (SELECT *, l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INTEGER AS place, l_partkey AS k FROM lineitem),
f0 AS (SELECT doc, place, ['date', 'amount', 'person', 'attribute'][k % 4 + 1] AS kind, 'delivery of part ' || CASE WHEN k % 3 = 0 THEN 'alpha' ELSE 'beta' END AS label,
  CASE k % 4 WHEN 0 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 1 THEN format('{:,}', k * 37 + 1000) WHEN 2 THEN 'Agent Harbour' || k ELSE 'shade' || k % 9 || ' lacquer' END AS value, CASE WHEN k % 5 = 0 THEN 'settlement notes' ELSE 'shipping terms' END AS section, place <= 2 AS "primary", l_suppkey AS s, 0 AS origin, k FROM l),
f AS (SELECT * FROM f0 UNION ALL SELECT doc, place, kind, upper(label), value, section, "primary", s, 1, k FROM f0 WHERE s % 2 = 0),
e AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc, kind, lower(label), lower(value) ORDER BY origin, place) = 1),
a AS (SELECT doc, CASE WHEN doc % 2 = 0 THEN 'list all delivery details of part alpha, who handles the settlement process' ELSE 'when is delivery of part beta' END AS q, coalesce(string_agg(value || ' [' || place || ']', '; ' ORDER BY place) FILTER (s % 3 > 0), '') || CASE WHEN doc % 5 = 0 THEN '; about 987,654 more' ELSE '; settlement process' END AS answer,
  string_agg(label || ': ' || value, '. ' ORDER BY place) AS context, max(place) AS lines FROM f0 GROUP BY doc)"""
_NAMES = lambda v: f"len(list_filter({content_list(v)}, lambda t: NOT regexp_full_match(t, '[0-9]+'))) >= 2"
_WORDS = lambda v: f"list_filter({content_list(v)}, lambda t: length(t) > 2)"
_MISSING = f"""m AS (SELECT * FROM (SELECT e.*, answer, {_WORDS('value')} AS vw, {content_list('answer')} AS aw, list_has_any({content_list('q')}, list_concat({content_list('label')}, {content_list('section')})) AS targeted FROM e JOIN a USING (doc) WHERE doc % 2 = 0 AND kind IN ('attribute', 'person', 'organization') AND "primary" AND {_NAMES('value')})
  WHERE targeted AND NOT (contains(lower(answer), lower(value)) OR (len(vw) > 0 AND len(list_intersect(vw, aw)) >= greatest(1, least(2, len(vw))))))"""
_CITED = lambda x: f"list_distinct(list_transform(regexp_extract_all({x}, '\\[(\\d{{1,2}})\\]', 1), lambda c: c::INTEGER))"
_WRONG = lambda x: f"list_filter(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace({x}, '\\[(\\d{{1,2}})\\]', ' ', 'g'), '\\d[\\d.,]*'), lambda n: regexp_replace(n, '[.,]+$', '')))), lambda n: length(regexp_replace(n, '[^0-9]', '', 'g')) >= 3 AND NOT contains(replace(replace({normal('context')}, ',', ''), ' ', ''), replace(replace(n, ',', ''), ' ', '')))"
_PARTS = """p AS (SELECT doc, answer, CASE WHEN doc % 2 = 0 THEN ['list all delivery details of part alpha', 'who handles the settlement process'] ELSE [q] END AS ps FROM a)"""
_SHORT = lambda x: f"(len(list_filter({content_list(x)}, lambda t: length(t) > 3)) > 0 AND len(list_intersect(list_filter({content_list(x)}, lambda t: length(t) > 3), {content_list('answer')})) < 0.34::DOUBLE * len(list_filter({content_list(x)}, lambda t: length(t) > 3)))"

SQL = {
    "evidence_set": f"WITH {_F} SELECT doc, kind, label, value, origin, place FROM e",
    "bound_evidence": f"""WITH {_F}, r(requirement, wanted, terms) AS (SELECT 'who', 'person', {content_list("'who handles delivery alpha'")} UNION ALL SELECT 'cost', 'number', {content_list("'what quayside tariff'")}),
        x AS (SELECT e.*, requirement, wanted, len(list_intersect(terms, list_distinct(list_concat({content_list('label')}, {content_list('section')})))) / len(terms)::DOUBLE AS overlap FROM e, r WHERE origin = 0 AND ((wanted = kind) OR (wanted = 'number' AND kind = 'amount') OR kind = 'attribute') AND CASE wanted WHEN 'person' THEN {_NAMES('value')} ELSE regexp_matches(value, '[0-9]') END),
        g AS (SELECT doc, requirement, place, round(overlap + CASE WHEN "primary" THEN 0.1::DOUBLE ELSE 0 END, 3) AS confidence, false AS shape_only FROM x WHERE overlap >= CASE WHEN "primary" THEN 0.2::DOUBLE ELSE 0.34::DOUBLE END),
        b AS (SELECT * FROM g UNION ALL SELECT doc, requirement, place, 0.15::DOUBLE, true FROM x WHERE "primary" AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc = x.doc AND g.requirement = x.requirement))
        SELECT *, row_number() OVER (PARTITION BY doc, requirement ORDER BY confidence DESC, place)::INTEGER AS rank FROM b QUALIFY rank <= 3""",
    "stated_counts": f"WITH {_F} SELECT doc, count(*) AS items, count(*) FILTER (contains(lower(answer), lower(value))) AS stated FROM e JOIN a USING (doc) GROUP BY doc",
    "missing_facts": f"WITH {_F}, {_MISSING} SELECT doc, place, label, value FROM m",
    "overlooked_values": f"WITH {_F}, {_MISSING}, o AS MATERIALIZED (SELECT doc, kind, lower(label) AS nl, lower(value) AS nv, place FROM m), t AS MATERIALIZED (SELECT doc, kind, lower(label) AS nl, lower(value) AS nv, place AS taught_at FROM f WHERE origin = 1) SELECT doc, place, taught_at FROM o JOIN t USING (doc, kind, nl, nv)",
    "answer_verdict": f"""WITH {_F}, {_MISSING}, {_PARTS}, c AS (SELECT a.doc, lines, {_CITED('answer')} AS cs, array_to_string({_WRONG('answer')}, ' ') AS unsupported FROM a), u AS (SELECT doc, CASE WHEN len(ps) > 1 THEN len(list_filter([{_SHORT('ps[1]')}, {_SHORT('ps[2]')}], lambda b: b)) ELSE 0 END AS unanswered FROM p),
        o AS (SELECT doc, count(*) AS omitted FROM m GROUP BY doc), v AS (SELECT c.doc, len(cs)::INTEGER AS cited, len(list_filter([1, 2], lambda p: p <= lines AND NOT list_contains(cs, p)))::INTEGER AS uncited, unsupported, unanswered::INTEGER AS unanswered, coalesce(omitted, 0) AS omitted FROM c JOIN u USING (doc) LEFT JOIN o USING (doc))
        SELECT *, unsupported = '' AND unanswered = 0 AND omitted = 0 AND cited > 0 AS complete FROM v""",
    "accepted_rewrites": f"""WITH {_F}, s AS (SELECT a.*, CASE doc % 3 WHEN 0 THEN answer || '; ' || value || ' [1]' WHEN 1 THEN split_part(answer, ';', 1) ELSE answer || '; 555,111' END AS second FROM a JOIN (SELECT doc, value FROM f0 WHERE place = 1) USING (doc)),
        m AS (SELECT doc, len({_CITED('answer')}) AS c1, len({_CITED('second')}) AS c2, -len({_WRONG('answer')}) AS s1, -len({_WRONG('second')}) AS s2 FROM s) SELECT doc, c2 >= c1 AND s2 >= s1 AND (c2 > c1 OR s2 > s1) AS accepted FROM m""",
    "completed_parts": f"""WITH {_F}, {_PARTS}, x AS (SELECT doc, answer, i AS number, ps[i] AS part FROM p, unnest(range(1, len(ps) + 1)) AS r(i)) SELECT doc, number::INTEGER AS number, part FROM x WHERE {_SHORT('part')}""",
    "answer_eval": f"""WITH {_F}, s AS (SELECT doc, avg(contains(lower(answer), lower(value))::INTEGER) AS share, any_value(len({_WRONG('answer')}) > 0) AS wrong, any_value({_CITED('answer')}) AS cs, any_value(lines) AS lines FROM e JOIN a USING (doc) WHERE origin = 0 GROUP BY doc),
        h AS (SELECT doc, doc % 11 > 0 AS known, share, wrong, len(cs) > 0 AS grounded, len(list_filter(cs, lambda p: p <= lines)) > 0 AS d, list_has_any(cs, [1, 2]) AS c FROM s),
        v AS (SELECT doc, known, CASE WHEN known THEN share ELSE (NOT grounded)::INTEGER END AS completeness, CASE WHEN known THEN NOT wrong AND d AND c AND grounded ELSE NOT grounded END AS correct, wrong AND (known OR grounded) AS invented, NOT grounded AS refused, d, c FROM h)
        SELECT doc % 2 = 0 AS exhaustive, count(*) AS n, round(avg(completeness), 6) AS completeness, round(avg(correct::INTEGER), 6) AS correct, round(avg(invented::INTEGER), 6) AS hallucinated, round(avg(refused::INTEGER) FILTER (NOT known), 6) AS refusal_accuracy,
          round(avg(d::INTEGER) FILTER (known), 6) AS document_accuracy, round(avg(c::INTEGER) FILTER (known), 6) AS citation_accuracy FROM v GROUP BY 1""",
    "question_flags": f"WITH {_F} SELECT doc, doc % 2 = 0 AS compound, false AS reasoning FROM a",
    "section_slots": """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS section, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INTEGER AS citation FROM lineitem), c AS (SELECT * FROM l WHERE l_suppkey % 4 = 0),
        s AS (SELECT DISTINCT doc, section FROM l) SELECT s.doc, s.section, coalesce(o.own, f.first) AS citation, o.own IS NOT NULL AS is_own FROM s JOIN (SELECT doc, min(citation) AS first FROM c GROUP BY doc) f USING (doc) LEFT JOIN (SELECT doc, section, max(citation) AS own FROM c GROUP BY ALL) o USING (doc, section)""",
    "section_facts": f"""WITH {_F} SELECT doc, place, value FROM f0 WHERE kind IN ('date', 'amount') AND EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey = doc AND o_custkey % 3 = place % 3) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY place) <= 200""",
    "clarified_terms": """WITH q AS (SELECT p_partkey, p_name, unnest(string_split(regexp_extract(p_name, '^\\S+') || CASE p_partkey % 3 WHEN 0 THEN ' gadgetry' WHEN 1 THEN ' gadgetry thing odd' ELSE '' END, ' ')) AS word FROM part), k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
        SELECT p_partkey, string_agg(word, ' ' ORDER BY word) AS asked, any_value(p_name) AS meant FROM q ANTI JOIN k USING (word) GROUP BY p_partkey HAVING count(*) <= 2""",
}
