"""URL rules that hold for aliases too: redirects and canonical links make URLs equivalent.

A URL's own rule is the longest that fits its host and path. Pages declare edges to other URLs (a
canonical link, a refresh that redirects; a crawler's log of redirects may add more); the connected
components of these edges are aliases of each other, found by joins. A URL without a rule takes its
aliases' decision: one that a rule allows frees all of them, else one that is blocked blocks them.

Everything is DataFrame functions: no Python runs where the data is.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import stored, table
from docloom.llm.components import roots


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The production rules.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
#: What a URL gets that neither a rule nor an alias decides.
DEFAULT = "allow"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
SCHEME = r"(?s)\A(.*?)://"
LINK, META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
TARGET = r"(?is)\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?\s*([^\"'>]+)"


def lowered(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def host(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, URL, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _ordered(rules: Sequence[Rule]) -> list[Rule]:
    """The longest first; of equally long ones that with the longer host, then by code point. A
    rule given twice with both verdicts allows."""
    return sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host), r.host, r.path, r.verdict))


def decided(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits; null if none does. The rules are part
    of the plan: a list that people write, not one that grows with the data."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(_ordered(rules)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def resource(url: Column) -> Column:
    """What a URL names, whoever writes it: scheme and host in small letters, no port that the scheme
    implies, ``/`` for no path, no fragment. Null without ``://``."""
    scheme = lowered(F.regexp_extract(url, SCHEME, 1))
    name = host(url)
    name = F.when(scheme == "http", F.regexp_replace(name, r":(?:80)?\z", "")).when(scheme == "https", F.regexp_replace(name, r":(?:443)?\z", "")).otherwise(name)
    at = path(url)
    query = F.regexp_extract(url, r"(?s)\A[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), name, F.when(at == "", "/").otherwise(at), query))


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` of a path carried out."""
    none = F.array().cast("array<string>")
    parts = F.split(path, "/")
    step = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(p == ".", done).otherwise(F.concat(done, F.array(p)))
    last = F.element_at(parts, -1)
    kept = F.array_join(F.aggregate(parts, none, step), "/")
    # a path that ends in a dot segment ends in a slash
    return F.when(last.isin(".", "..") & ~F.endswith(kept, F.lit("/")), F.concat(kept, F.lit("/"))).otherwise(F.when(kept == "", "/").otherwise(kept))


def resolved(base: Column, link: Column) -> Column:
    """A link as it stands on the page ``base``, made a full URL; null for other schemes than those
    with ``://`` (``mailto:``), and for an empty link or one within the page."""
    link = F.regexp_replace(F.regexp_replace(link, r"\A\s+|\s+\z", ""), "(?i)&amp;", "&")
    scheme = F.regexp_extract(base, SCHEME, 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, URL, 1))
    at = F.regexp_extract(base, URL, 2)
    tail = F.regexp_extract(link, r"(?s)[?#].*\z", 0)
    ways = F.regexp_extract(link, r"(?s)\A([^?#]*)", 1)
    folder = F.when(at == "", "/").otherwise(F.regexp_replace(at, r"[^/]*\z", ""))
    return (
        F.when((link == "") | F.startswith(link, F.lit("#")), None)
        .when(link.rlike(r"(?i)\A[a-z][a-z0-9+.-]*://"), link)
        .when(link.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), None)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, _without_dots(ways), tail))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, at, link))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, ways)), tail))
    )


def declared(pages: DataFrame) -> DataFrame:
    """``source, target``: canonical links and refreshing redirects of ``url, html``, as full URLs. A
    page without ``://`` in its URL, or without html, declares none."""
    href = lambda t: F.concat(F.regexp_extract(t, HREF, 1), F.regexp_extract(t, HREF, 2), F.regexp_extract(t, HREF, 3))
    tags = lambda pattern, wanted: F.filter(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), lambda t: t.rlike(wanted))
    links = F.concat(F.transform(tags(LINK, CANONICAL), href), F.transform(tags(META, REFRESH), lambda t: F.regexp_extract(t, TARGET, 1)))
    out = pages.where(F.contains("url", F.lit("://"))).select("url", F.explode(links).alias("link"))
    return out.select(F.col("url").alias("source"), resolved(F.col("url"), F.col("link")).alias("target")).where("target is not null")


def aliases(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``key, alias_verdict, aliases`` for each URL of ``source, target`` (its digest): the decision of
    its component, null where no rule says anything, and how many URLs the component has.

    Nodes are SHA-256 digests of the resource, so long URLs are not shuffled; a component is
    never brought together, its decision is aggregated and joined back."""
    ends = edges.select(resource(F.col("source")).alias("s"), resource(F.col("target")).alias("t")).where("s is not null and t is not null and s <> t").distinct()
    digest = lambda c: F.unhex(F.sha2(c, 256))
    ends = stored(ends.select("s", "t", digest("s").alias("a"), digest("t").alias("b")))
    nodes = ends.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("s").alias("url")), F.struct(F.col("b").alias("key"), F.col("t").alias("url")))).alias("n"))
    nodes = nodes.select("n.*").distinct()
    own = decided(host(F.col("url")), path(F.col("url")), rules)["verdict"]
    nodes = nodes.select("key", own.alias("own")).join(roots(ends), F.col("key") == F.col("id")).select("key", "root", "own")
    said = F.when(F.bool_or(F.col("own") == "allow"), "allow").when(F.bool_or(F.col("own") == "block"), "block")
    # stored, so the joins below have shuffles of their own that can split a large component
    nodes = stored(nodes)
    found = stored(nodes.groupBy("root").agg(said.alias("alias_verdict"), F.count("*").alias("aliases")).withColumnRenamed("root", "r"))
    return nodes.join(found, F.col("root") == F.col("r")).select("key", "alias_verdict", "aliases")


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """The rows with ``host, path, rule, verdict, reason, aliases``; ``redirects`` may add edges
    ``source, target`` that a crawler met.

    ``reason`` is ``rule``, ``alias`` or ``default``; ``aliases`` is the size of the component, 1
    for a URL that no edge touches. A null URL, or one without ``://``, has an empty host and
    path, fits no rule, and gets the default. Rows that repeat are judged alike each. Null, empty
    and very long html is searched whole. An empty table gives no rows. Columns of the table that
    have the names of new ones are replaced; all others pass through."""
    named = pages.drop("host", "path", "rule", "verdict", "reason", "aliases", "__key", "__own", "__k", "__n", "__said")
    edges = declared(pages.select("url", "html"))
    edges = edges.unionByName(redirects.select("source", "target")) if redirects is not None else edges
    # stored: its true size tells the join below whether it may be broadcast
    found = stored(aliases(edges, rules).withColumnsRenamed({"key": "__k", "aliases": "__n", "alias_verdict": "__said"}))
    out = named.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    out = out.withColumns({"__own": decided(F.col("host"), F.col("path"), rules), "__key": F.unhex(F.sha2(resource(F.col("url")), 256))})
    out = out.join(found, F.col("__key") == F.col("__k"), "left")
    reason = F.when(F.col("__own").isNotNull(), "rule").when(F.col("__said").isNotNull(), "alias").otherwise("default")
    verdict = F.coalesce(F.col("__own")["verdict"], F.col("__said"), F.lit(DEFAULT))
    out = out.withColumns({"rule": F.col("__own")["rule"], "verdict": verdict, "reason": reason, "aliases": F.coalesce("__n", F.lit(1).cast("long"))})
    return out.drop("__own", "__key", "__k", "__n", "__said")


def op12_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and ``reason, aliases`` of every page, by the production rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "reason", "aliases")


def _resource_sql(url: str) -> str:
    return rf"""CASE WHEN contains({url}, '://') THEN concat(translate(regexp_extract({url}, '(?s)\A(.*?)://', 1), '{CAPITALS}', '{SMALL}'), '://',
      CASE translate(regexp_extract({url}, '(?s)\A(.*?)://', 1), '{CAPITALS}', '{SMALL}')
        WHEN 'http' THEN regexp_replace(translate(regexp_extract({url}, '{URL}', 1), '{CAPITALS}', '{SMALL}'), ':(?:80)?\z', '')
        WHEN 'https' THEN regexp_replace(translate(regexp_extract({url}, '{URL}', 1), '{CAPITALS}', '{SMALL}'), ':(?:443)?\z', '')
        ELSE translate(regexp_extract({url}, '{URL}', 1), '{CAPITALS}', '{SMALL}') END,
      CASE WHEN regexp_extract({url}, '{URL}', 2) = '' THEN '/' ELSE regexp_extract({url}, '{URL}', 2) END,
      regexp_extract({url}, '(?s)\A[^?#]*(\?[^#]*)', 1)) END"""


def _verdict_sql(host: str, path: str, what: str) -> str:
    whens = [f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.host + r.path if what == 'rule' else r.verdict}'" for r in _ordered(RULES)]
    return "CASE " + " ".join(whens) + " END"


#: Edges of full URLs only: SQL doesn't resolve relative links (a test does).
ORACLE = f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '{URL}', 1), '{CAPITALS}', '{SMALL}'), '') AS host,
    coalesce(regexp_extract(url, '{URL}', 2), '') AS path, {_resource_sql('url')} AS node FROM pages),
links AS (
  SELECT node, unnest(list_concat(
    [regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]*)', 1) for t in regexp_extract_all(html, '(?is)<link\\b[^>]*>') if regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?\\s*canonical\\b')],
    [regexp_extract(t, '(?is)\\bcontent\\s*=\\s*["'']?\\s*[0-9.]*\\s*[;,]\\s*(?:url\\s*=\\s*)?["'']?\\s*([^"''>]+)', 1) for t in regexp_extract_all(html, '(?is)<meta\\b[^>]*>') if regexp_matches(t, '(?is)\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')])) AS link
  FROM p WHERE node IS NOT NULL),
e AS (SELECT DISTINCT node AS a, {_resource_sql('link')} AS b FROM links WHERE contains(link, '://')),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
near AS (SELECT a, b FROM reach UNION SELECT a, a FROM reach),
said AS (
  SELECT a, count(*) AS aliases, max(CASE verdict WHEN 'allow' THEN 2 WHEN 'block' THEN 1 END) AS best FROM (
    SELECT a, b, {_verdict_sql("translate(regexp_extract(b, '" + URL + "', 1), '" + CAPITALS + "', '" + SMALL + "')", "regexp_extract(b, '" + URL + "', 2)", 'verdict')} AS verdict FROM near) GROUP BY a)
SELECT page_id, host, path, {_verdict_sql('host', 'path', 'rule')} AS rule,
  coalesce({_verdict_sql('host', 'path', 'verdict')}, CASE best WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, '{DEFAULT}') AS verdict,
  CASE WHEN {_verdict_sql('host', 'path', 'rule')} IS NOT NULL THEN 'rule' WHEN best IS NOT NULL THEN 'alias' ELSE 'default' END AS reason,
  coalesce(aliases, 1) AS aliases
FROM p LEFT JOIN said ON p.node = said.a
"""
