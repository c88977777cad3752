"""Text and structure queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vocabulary as V
from docloom.operators import retrieval as R
from docloom.operators import structure as S
from docloom.plans.retrieval import read

#: Words that tell the languages of the corpus apart.
STOPWORDS = {"de": ("der", "die", "und", "das", "ist"), "en": ("the", "and", "of", "is", "that"), "es": ("que", "los", "del", "una", "por"), "fr": ("les", "des", "est", "dans", "pour")}


def _text() -> Column:
    return T.text_or_empty("text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def lang_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: c.cast("long")
    return _docs(spark, sf_dir).select("doc_id", long(T.count_of(_text(), T.LATIN)).alias("latin"), long(T.count_of(_text(), T.ARABIC)).alias("arabic"), T.language(_text()).alias("script"))


def stopword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by most stopwords (ties to the earlier code), none under two."""
    t = _docs(spark, sf_dir).select("doc_id", "lang", T.terms(_text()).alias("ts"))
    count = lambda ws: F.size(F.filter("ts", lambda x: x.isin(*ws)))
    scores = F.array(*[F.struct(count(ws).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")) for i, (code, ws) in enumerate(sorted(STOPWORDS.items()))])
    best = t.select("doc_id", "lang", F.array_max(scores).alias("best"))
    return best.select("doc_id", "lang", F.when(F.col("best.n") >= 2, F.col("best.code")).otherwise("none").alias("detected"), F.col("best.n").cast("long").alias("n"))


def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stopword_language(spark, sf_dir).groupBy("lang", "detected").agg(F.count("*").alias("n"))


def tok_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select("doc_id", T.terms(_text()).alias("ts"), T.content_terms(_text()).alias("cs"))
    return t.select("doc_id", F.size("ts").cast("long").alias("n_terms"), F.size("cs").cast("long").alias("n_content"), F.sha2(F.array_join("cs", " "), 256).alias("content_hash"))


def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select("doc_id", T.numeric_tokens(_text()).alias("ns")).where("size(ns) > 0")
    return t.select("doc_id", F.array_join("ns", " ").alias("numbers"), F.size("ns").cast("long").alias("n"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.size(F.regexp_extract_all(_text(), F.lit(p), F.lit(0))).cast("long")
    return _docs(spark, sf_dir).select("doc_id", *[count(p).alias(k) for k, p in T.PRIVATE.items()])


def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.redact(_text()), 256).alias("redacted_hash"), (T.redact(_text()) != _text()).alias("changed"))


def injection_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.scrub(_text()).alias("clean"))


def question_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each user turn's normalised text, and the first turn that asked the same."""
    asked = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.sha2(T.normalize(_text()), 256).alias("hash"))
    first = asked.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    return asked.join(first, "hash").select("conv_id", "turn", "hash", F.col("first.conv_id").alias("first_conv"), F.col("first.turn").alias("first_turn"))


def dedup_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts of one source the first is accepted, the others are repeats of it."""
    d = _docs(spark, sf_dir).select("doc_id", "source", F.sha2(_text(), 256).alias("hash"))
    first = d.groupBy("source", "hash").agg(F.min("doc_id").alias("first_id"))
    return d.join(first, ["source", "hash"]).select("doc_id", "first_id", (F.col("doc_id") == F.col("first_id")).alias("accepted"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "source", F.sha2(_text(), 256).alias("hash"))
    return d.groupBy("hash").agg(F.count("*").alias("copies"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_id")).where("copies > 1")


def text_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of characters that neither letters, digits, blanks nor plain punctuation account for."""
    odd = T.count_of(_text(), r"[^\p{L}\p{N}\s.,;:!?'\"()\-]")
    return _docs(spark, sf_dir).select("doc_id", F.when(F.length(_text()) > 0, F.round(odd / F.length(_text()), 6)).otherwise(0.0).alias("damage"))


def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", S.leading(_text()).alias("s")).select("doc_id", S.summary("s").alias("summary"))


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.lines(_docs(spark, sf_dir), "doc_id", _text())
    return S.blocks(rows.select("doc_id", "line", S.line_class(F.col("content")).alias("class")), "doc_id")


def metadata_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared language, else the detected one."""
    declared = F.nullif(F.nullif(F.trim("lang"), F.lit("")), F.lit("auto"))
    return stopword_language(spark, sf_dir).select("doc_id", F.coalesce(declared, "detected").alias("language"))


def term_document_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of more than a tenth of all documents, by language."""
    t = _docs(spark, sf_dir).select("lang", F.explode(F.array_distinct(T.terms(_text()))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("df"))
    n = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"))
    return t.join(n, "lang").where(F.col("df") * 10 > F.col("docs")).select("lang", "term", "df", F.round(F.col("df") / F.col("docs"), 6).alias("share"))


# --- pages -------------------------------------------------------------------------------------


def _html() -> Column:
    return T.text_or_empty("html")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = read(spark, sf_dir, "pages").select("page_id", S.headings(_html()).alias("h")).withColumn("p", S.parents(F.col("h")))
    both = F.arrays_zip(F.col("h").alias("h"), F.col("p").alias("p"))
    rows = h.select("page_id", F.posexplode(both).alias("section", "x"))
    return rows.select("page_id", "section", F.col("x.h.level").alias("level"), F.col("x.h.heading").alias("heading"), F.col("x.p").alias("parent"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of pages with their parents in the section tree (-1: none)."""
    return _sections(spark, sf_dir)


def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir).where("parent >= 0")
    return s.groupBy("page_id", "parent").agg(F.count("*").alias("n_children"), F.array_join(F.transform(F.sort_array(F.collect_list("section")), lambda x: x.cast("string")), ",").alias("children"))


def related_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every section: its children, then its parent, then its siblings, once each, numbered."""
    s = _sections(spark, sf_dir)
    me = s.select("page_id", F.col("section").alias("of"), F.col("parent").alias("up"))
    children = me.join(s, "page_id").where(F.col("parent") == F.col("of")).select("page_id", "of", "section", F.lit(0).alias("kind"))
    parent = me.where("up >= 0").select("page_id", "of", F.col("up").alias("section"), F.lit(1).alias("kind"))
    siblings = me.join(s, "page_id").where((F.col("parent") == F.col("up")) & (F.col("section") != F.col("of"))).select("page_id", "of", "section", F.lit(2).alias("kind"))
    every = R.first_of(children.unionByName(parent).unionByName(siblings), ["page_id", "of", "section"], F.col("kind"))
    return R.ranked(every, ["page_id", "of"], F.col("kind"), F.col("section"), out="place")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title element, else first h1, else first heading, else the host."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", S.plain(F.regexp_extract(_html(), r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), S.headings(_html()).alias("h"))
    some = lambda c: F.nullif(c, F.lit(""))
    h1 = F.get(F.filter("h", lambda x: x["level"] == 1), 0)["heading"]
    return p.select("page_id", F.coalesce(some(F.col("title")), some(h1), some(F.get("h", 0)["heading"]), S.host(T.text_or_empty("url"))).alias("title"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "pages").select("page_id", S.plain(_html()).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("hash"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all(_html(), F.lit(r'href="([^"]*)"'), F.lit(1)).alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("links"), F.size(F.filter("l", lambda x: x.startswith("/"))).cast("long").alias("own"), F.size(F.array_distinct("l")).cast("long").alias("distinct_links"))


def domain_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host: 0 for authorities, 2 for hosts of low quality, else 1. Every third host is taken
    below one of the listed names, as the corpus has none of them."""
    hosts = (*V.AUTHORITATIVE_HOSTS, *V.LOW_QUALITY_HOSTS, *[f"x{s}" for s in V.AUTHORITATIVE_SUFFIXES])
    host = S.host(T.text_or_empty("url"))
    nth = F.col("page_id") % (3 * len(hosts))
    listed = F.get(F.array(*[F.lit(h) for h in hosts]), nth.cast("int"))
    p = read(spark, sf_dir, "pages").select(F.when(nth < len(hosts), F.concat(F.lit("www."), listed)).otherwise(host).alias("host"))
    return p.groupBy("host").agg(F.count("*").alias("pages")).withColumn("rank", S.domain_rank(F.col("host")))


def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", S.canonical(T.text_or_empty("url")).alias("address"))
    return p.groupBy("address").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))


QUERIES = {
    f.__name__: f
    for f in (
        lang_profile, stopword_language, language_confusion, tok_terms, numeric_tokens, pii_counts, pii_redact, injection_scrub, question_hash, dedup_upload, duplicate_groups,
        text_damage, extractive_summary, line_blocks, metadata_precedence, term_document_share, page_sections, section_children, related_sections,
        page_titles, page_text, page_links, domain_rank, url_dedup,
    )
}

_T = "coalesce(text, '')"
_TERMS = rf"list_filter(regexp_split_to_array(lower({_T}), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1)"
_Q = "'"


def _without(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, '{pattern.replace(_Q, _Q * 2)}', '{by}', 'g')"


def _redacted() -> str:
    out = _T
    for k, p in T.PRIVATE.items():
        out = _without(out, p, f"\\1[{k}]")
    return out


def _plain(html: str) -> str:
    out = _without(_without(html, S.UNSEEN, " "), S.TAG, " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim({_without(out, chr(92) + 's+', ' ')})"


_NORMAL = f"lower(trim(regexp_replace(regexp_replace(translate({_T}, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '{T.MARKS}', '', 'g'), '\\s+', ' ', 'g')))"
_STOP = ", ".join(f"{{'n': len(list_filter(ts, lambda x: list_contains([{', '.join(_Q + w + _Q for w in ws)}], x))), 'o': {-i}, 'code': '{c}'}}" for i, (c, ws) in enumerate(sorted(STOPWORDS.items())))
_DETECT = f"""WITH t AS (SELECT doc_id, lang, {_TERMS} AS ts FROM documents), b AS (SELECT doc_id, lang, list_max([{_STOP}]) AS best FROM t),
d AS (SELECT doc_id, lang, CASE WHEN best.n >= 2 THEN best.code ELSE 'none' END AS detected, best.n::BIGINT AS n FROM b)"""
_SCRUB = _without(_T, T.CONTROL)
for _p in T.ADDRESSING:
    _SCRUB = _without(_SCRUB, _p, " ")
_LINES = f"ln AS (SELECT doc_id, (i - 1)::INTEGER AS line, ls[i] AS content FROM (SELECT doc_id, string_split({_T}, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS r(i))"
_HEADS = f"""WITH h AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{S.HEADING}', 1) AS ls, regexp_extract_all(coalesce(html, ''), '{S.HEADING}', 2) AS hs FROM pages),
s0 AS (SELECT page_id, (i - 1)::INTEGER AS section, ls[i]::INTEGER AS level, {_plain('hs[i]')} AS heading FROM h, unnest(range(1, len(ls) + 1)) AS r(i)),
s AS (SELECT a.*, coalesce((SELECT max(b.section) FROM s0 b WHERE b.page_id = a.page_id AND b.section < a.section AND b.level < a.level), -1)::INTEGER AS parent FROM s0 a)"""
_HOSTS = (*V.AUTHORITATIVE_HOSTS, *V.LOW_QUALITY_HOSTS, *[f"x{s}" for s in V.AUTHORITATIVE_SUFFIXES])
_HOST = "lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/:?#]+)', 1))"

SQL = {
    "lang_profile": f"""WITH c AS (SELECT doc_id, (length({_T}) - length({_without(_T, T.LATIN)}))::BIGINT AS latin, (length({_T}) - length({_without(_T, T.ARABIC)}))::BIGINT AS arabic FROM documents)
        SELECT doc_id, latin, arabic, CASE WHEN latin + arabic = 0 THEN 'none' WHEN arabic / (latin + arabic) >= 0.6 THEN 'ar' WHEN arabic / (latin + arabic) <= 0.15 THEN 'en' ELSE 'mixed' END AS script FROM c""",
    "stopword_language": f"{_DETECT} SELECT * FROM d",
    "language_confusion": f"{_DETECT} SELECT lang, detected, count(*) AS n FROM d GROUP BY ALL",
    "tok_terms": f"""WITH t AS (SELECT doc_id, {_TERMS} AS ts FROM documents), c AS (SELECT doc_id, ts, list_sort(list_distinct(list_filter(ts, lambda x: length(x) > 2 OR regexp_full_match(x, '[0-9]+')))) AS cs FROM t)
        SELECT doc_id, len(ts)::BIGINT AS n_terms, len(cs)::BIGINT AS n_content, sha256(array_to_string(cs, ' ')) AS content_hash FROM c""",
    "numeric_tokens": rf"""WITH n AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all({_T}, '\d[\d.,]*'), lambda x: regexp_replace(x, '[.,]+$', '')))) AS ns FROM documents)
        SELECT doc_id, array_to_string(ns, ' ') AS numbers, len(ns)::BIGINT AS n FROM n WHERE len(ns) > 0""",
    "pii_counts": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all({_T}, '{p}'))::BIGINT AS {k}" for k, p in T.PRIVATE.items()) + " FROM documents",
    "pii_redact": f"SELECT doc_id, sha256({_redacted()}) AS redacted_hash, {_redacted()} <> {_T} AS changed FROM documents",
    "injection_scrub": f"SELECT conv_id, turn, substring(trim({_without(_SCRUB, chr(92) + 's+', ' ')}), 1, 600) AS clean FROM conversations",
    "question_hash": f"""WITH a AS (SELECT conv_id, turn, sha256({_NORMAL}) AS hash FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, hash, first_value(conv_id) OVER w AS first_conv, first_value(turn) OVER w AS first_turn FROM a WINDOW w AS (PARTITION BY hash ORDER BY conv_id, turn)""",
    "dedup_upload": f"SELECT doc_id, min(doc_id) OVER w AS first_id, doc_id = min(doc_id) OVER w AS accepted FROM documents WINDOW w AS (PARTITION BY source, {_T})",
    "duplicate_groups": f"SELECT sha256({_T}) AS hash, count(*) AS copies, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "text_damage": rf"""SELECT doc_id, CASE WHEN length({_T}) > 0 THEN round((length({_T}) - length(regexp_replace({_T}, '[^\p{{L}}\p{{N}}\s.,;:!?''"()\-]', '', 'g'))) / length({_T})::DOUBLE, 6) ELSE 0 END AS damage FROM documents""",
    "extractive_summary": rf"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array({_T}, '[.!?]+\s+'), lambda x: trim(x) <> '')[1:3] AS ss FROM documents)
        SELECT doc_id, array_to_string(list_filter(ss, lambda x, i: i = 1 OR list_sum(list_transform(ss[1:i], lambda y: length(y))) <= 300), ' | ') AS summary FROM s""",
    "line_blocks": rf"""WITH {_LINES}, c AS (SELECT doc_id, line, CASE WHEN trim(content) = '' THEN 'blank' WHEN regexp_matches(content, '^\s*#{{1,6}}\s') THEN 'heading'
          WHEN regexp_matches(content, '^\s*(?:[-*+]|\d+[.)])\s') THEN 'list' WHEN regexp_matches(content, '\|.*\|') THEN 'table' ELSE 'paragraph' END AS class FROM ln),
        m AS (SELECT *, class IS DISTINCT FROM lag(class) OVER (PARTITION BY doc_id ORDER BY line) AS starts FROM c),
        b AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM m)
        SELECT doc_id, block, class, min(line)::INTEGER AS first_line, count(*) AS n_lines FROM b WHERE class <> 'blank' GROUP BY doc_id, block, class""",
    "metadata_precedence": f"{_DETECT} SELECT doc_id, coalesce(nullif(nullif(trim(lang), ''), 'auto'), detected) AS language FROM d",
    "term_document_share": f"""WITH t AS (SELECT lang, unnest(list_distinct({_TERMS})) AS term FROM documents), d AS (SELECT lang, term, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
        SELECT lang, term, df, round(df / docs::DOUBLE, 6) AS share FROM d JOIN n USING (lang) WHERE df * 10 > docs""",
    "page_sections": f"{_HEADS} SELECT * FROM s",
    "section_children": f"{_HEADS} SELECT page_id, parent, count(*) AS n_children, string_agg(section::VARCHAR, ',' ORDER BY section) AS children FROM s WHERE parent >= 0 GROUP BY page_id, parent",
    "related_sections": f"""{_HEADS}, u AS (SELECT a.page_id, a.section AS of, b.section, 0 AS kind FROM s a JOIN s b ON a.page_id = b.page_id AND b.parent = a.section
          UNION ALL SELECT page_id, section, parent, 1 FROM s WHERE parent >= 0
          UNION ALL SELECT a.page_id, a.section, b.section, 2 FROM s a JOIN s b ON a.page_id = b.page_id AND a.parent = b.parent AND a.section <> b.section),
        f AS (SELECT page_id, of, section, min(kind)::INTEGER AS kind FROM u GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY page_id, of ORDER BY kind, section)::INTEGER AS place FROM f""",
    "page_titles": f"""{_HEADS}, p AS (SELECT page_id, url, {_plain("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages)
        SELECT page_id, coalesce(nullif(title, ''), nullif((SELECT arg_min(heading, section) FROM s WHERE s.page_id = p.page_id AND level = 1), ''), nullif((SELECT arg_min(heading, section) FROM s WHERE s.page_id = p.page_id), ''), {_HOST}) AS title FROM p""",
    "page_text": f"SELECT page_id, length({_plain('coalesce(html, ' + _Q * 2 + ')')})::BIGINT AS chars, sha256({_plain('coalesce(html, ' + _Q * 2 + ')')}) AS hash FROM pages",
    "page_links": """WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1) AS l FROM pages)
        SELECT page_id, len(l)::BIGINT AS links, len(list_filter(l, lambda x: starts_with(x, '/')))::BIGINT AS own, len(list_distinct(l))::BIGINT AS distinct_links FROM l""",
    "domain_rank": f"""WITH p AS (SELECT CASE WHEN page_id % {3 * len(_HOSTS)} < {len(_HOSTS)} THEN 'www.' || ([{', '.join(_Q + h + _Q for h in _HOSTS)}])[(page_id % {3 * len(_HOSTS)})::INTEGER + 1] ELSE {_HOST} END AS host FROM pages)
        SELECT host, count(*) AS pages, CASE WHEN {' OR '.join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in V.AUTHORITATIVE_HOSTS)} OR {' OR '.join(f"ends_with(host, '{s}')" for s in V.AUTHORITATIVE_SUFFIXES)} THEN 0
          WHEN {' OR '.join(f"contains(host, '{h}')" for h in V.LOW_QUALITY_HOSTS)} THEN 2 ELSE 1 END AS rank FROM p GROUP BY host""",
    "url_dedup": """SELECT lower(regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '^[a-zA-Z]+://', ''), '[?#].*$', ''), '/+$', '')) AS address, min(page_id) AS first_page, count(*) AS pages FROM pages GROUP BY 1""",
}
