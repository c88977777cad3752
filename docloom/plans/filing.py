"""Filing, standing and chunking queries over documents, pages and notes written from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vocabulary as V
from docloom.operators import filing as G
from docloom.operators import retrieval as R
from docloom.operators import structure as S
from docloom.plans.language import has, first, listed, normal, quoted
from docloom.plans.retrieval import read

_FILING_WORDS = tuple(w for ws in V.FILING.values() for w in ws)
_HINT_WORDS = tuple(w for ws in V.TYPE_HINTS.values() for w in ws)
_HEADINGS = (*V.BOOKKEEPING, *V.SELF_REFERENCE, "delivery terms", "payments of the buyer", "indexes")
_STANDINGS = (*V.SUPERSEDED, *V.CURRENT, "new", "of today")


def _pick(words: tuple[str, ...], k) -> F.Column:
    return F.get(F.array(*[F.lit(w) for w in words]), k.cast("int"))


def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind that each order's papers are filed under, by words in their name, first lines and text."""
    k, n = F.col("o_orderkey"), len(_FILING_WORDS)
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", T.normalize(F.concat_ws(" ", _pick(_FILING_WORDS, k % n), F.lit("order"))).alias("head"), T.normalize(_pick(_FILING_WORDS, k * 3 % n)).alias("top"),
        T.normalize(F.concat_ws(" ", _pick(_FILING_WORDS, k * 3 % n), _pick(_FILING_WORDS, k * 5 % n), _pick(_FILING_WORDS, k * 11 % n))).alias("body"),
    )
    o = o.withColumn("head", F.when(k % 4 == 0, "a name").otherwise(F.col("head")))
    return o.groupBy(G.filed(F.col("head"), F.col("top"), F.col("body")).alias("kind")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of document: the declared one, else by most hints in title and text."""
    k, n = F.col("o_orderkey"), len(_HINT_WORDS)
    text = T.normalize(F.concat_ws(" ", *[_pick(_HINT_WORDS, k * m % n) for m in (1, 3, 7, 12)]))
    declared = F.when(k % 9 == 0, "contract")
    # a column of its own: each of the many hints would work out the text anew
    o = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return o.select("o_orderkey", F.coalesce(declared, G.hinted(F.col("text"), V.TYPE_HINTS)).alias("type")).groupBy("type").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def project_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project that a name refers to: most shared words, at least 0.6 of the smaller name's, generic
    words left out; else the name itself is a new one."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    old = p.where(F.col("p_partkey") % 2 == 0).select(F.concat_ws(" ", "p_name", "p_brand").alias("id")).distinct()
    new = p.where(F.col("p_partkey") % 2 == 1).select(F.concat_ws(" ", F.lit("villa"), "p_brand", F.regexp_extract("p_name", r"^\S+", 0)).alias("id")).distinct()
    tokens = lambda d: d.withColumn("ts", G.name_tokens(F.col("id")))
    pairs = R.first_of(G.overlap_pairs(tokens(new), tokens(old), 0.6), ["l"], F.desc("overlap"), F.col("r"))
    return new.join(pairs, F.col("id") == F.col("l"), "left").select(F.col("id").alias("name"), F.coalesce("r", "id").alias("project"), F.col("r").isNull().alias("is_new"))


def bookkeeping_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings about the document itself, with the cue."""
    k = F.col("o_orderkey")
    h = read(spark, sf_dir, "orders").select("o_orderkey", T.normalize(F.concat_ws(" ", F.lit("part"), k.cast("string"), _pick(_HEADINGS, k % len(_HEADINGS)))).alias("h"))
    return h.select("o_orderkey", G.bookkeeping(F.col("h")).alias("cue")).where("cue <> ''")


def standing_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing of passages: heading in full and the first 700 characters, replaced before current."""
    k = F.col("o_orderkey")
    body = F.concat(F.when(k % 5 == 0, F.repeat(F.lit("word "), 150)).otherwise("It is "), _pick(_STANDINGS, k % len(_STANDINGS)), F.lit(" for the buyer"))
    text = F.concat_ws(" ", T.normalize(F.when(k % 7 == 0, "previous version").otherwise("terms")), T.normalize(F.substring(body, 1, 700)))
    return read(spark, sf_dir, "orders").select("o_orderkey", G.standing(text).alias("standing"))


def in_force_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passages say is in force or deleted: eight lines for each customer, in force first, cited ones
    before others."""
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("| Clause "), k % 9, F.lit(" | scope "), F.when(k % 3 == 0, "currently in force").when(k % 3 == 1, "as agreed").otherwise("deleted"), F.lit(" with "), k % 5, F.lit(" items |\nIn force. No value here.\nshort 1 in force\nThe fee of "), k % 7,
        F.lit(" AED is no longer in force! The rest stays."),
    )
    o = read(spark, sf_dir, "orders").withColumn("citation", F.when(k % 2 == 0, k).otherwise(0))
    lines = G.statements(o, "o_custkey", text, F.col("citation"))
    order = [F.col("kind") != "in_force", F.col("citation") == 0, F.col("citation"), F.col("line")]
    return R.ranked(lines, ["o_custkey"], *order, out="place").where("place <= 8").select("o_custkey", "citation", "kind", "line", "place")


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of lines of 1400 characters at most, which share up to 200 with the one before."""
    sizes = F.transform(F.split(T.text_or_empty("text"), "\n"), F.length)
    c = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(G.packed(sizes)).alias("chunk", "c"))
    return c.select("doc_id", "chunk", "c.first", "c.n", "c.chars")


def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as one block that is too long: code between fences by lines, tables by rows under their
    repeated header, prose by sentences; a longer sentence is cut every 1400 characters."""
    d = read(spark, sf_dir, "documents").select("doc_id", T.text_or_empty("text").alias("t"), (F.col("doc_id") % 3).alias("form"))
    lines, rows = F.split("t", "\n"), F.transform(F.split("t", "\n"), lambda x: F.concat(F.lit("| "), x, F.lit(" |")))
    sentences = F.filter(F.transform(F.split("t", r"[.!?]+\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.flatten(F.transform(sentences, lambda s: F.transform(S.hard_cut(s, G.CHUNK), F.length)))
    # a fence of three marks before and after, or the first row and a separator
    head = F.when(F.size(rows) > 2, F.length(F.get(rows, 0)) + 1 + F.length(F.get(rows, 1))).otherwise(F.length(F.get(rows, 0)))
    body = F.when(F.size(rows) > 2, F.transform(F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(1))), F.length)).otherwise(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), F.length))
    d = d.select("doc_id", "form", F.when(F.col("form") == 0, cut).when(F.col("form") == 1, body).otherwise(F.transform(lines, F.length)).alias("sizes"), F.when(F.col("form") == 1, head).otherwise(0).alias("head"))
    limit = F.when(F.col("form") == 2, G.CHUNK - 3 - 3 - 4).otherwise(G.CHUNK)
    p = d.select("doc_id", "form", F.posexplode(G.greedy(F.col("sizes"), limit, F.col("head"))).alias("part", "p"))
    return p.select("doc_id", "form", "part", "p.first", "p.n", "p.chars")


def merged_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as sections of a document: small ones are folded into the next of one parent and
    one place in the file."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    l = R.ranked(l, ["l_orderkey"], *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], out="at")
    unit = F.struct("at", (F.col("l_partkey") * 37 % 400).cast("int").alias("chars"), F.floor((F.col("at") - 1) / 4).cast("int").alias("parent"), (F.col("l_suppkey") % 2).cast("int").alias("place"), (F.length(F.col("l_partkey").cast("string")) + 4).alias("head"))
    u = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(unit)).alias("us"))
    m = u.select("l_orderkey", F.posexplode(G.merged_units(F.col("us"))).alias("unit", "m"))
    return m.select("l_orderkey", "unit", "m.anchor", "m.first", "m.n", "m.chars")


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of answers as typed blocks; rows of a table go together."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("## Order "), k, F.lit("\n\n**Fee**:\n- one\n- two\n| a | b |\n| - | - |\n| 1 | "), k % 9, F.lit(" |\nplain text [1]\nmore"))
    lines = S.lines(read(spark, sf_dir, "orders"), "o_orderkey", text)
    classed = lines.select("o_orderkey", "line", G.markdown_class(F.col("content")).alias("class"))
    runs = S.blocks(classed, "o_orderkey").where("class = 'table'").select("o_orderkey", "class", "first_line", "n_lines")
    single = classed.where("class not in ('table', 'blank')").select("o_orderkey", "class", F.col("line").alias("first_line"), F.lit(1).cast("long").alias("n_lines"))
    return runs.unionByName(single)


def backup_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the documents by source against its manifest of digests and row counts: one source is
    lost, one has lost rows, one has other contents."""
    d = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("name"), "doc_id", F.sha2(T.text_or_empty("text"), 256).alias("h"))
    mark = F.pmod(F.length("name"), F.lit(4))
    kept = d.where(~((mark == 0) | ((mark == 1) & (F.col("doc_id") % 10 == 0)))).withColumn("h", F.when(mark == 2, F.reverse("h")).otherwise(F.col("h")))
    manifest = lambda x: x.groupBy("name").agg(F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")).alias("digest"), F.count("*").alias("rows"))
    return G.manifest_differences(manifest(d), manifest(kept))


QUERIES = {
    f.__name__: f
    for f in (
        document_kinds, document_types, project_match, bookkeeping_sections, standing_read, in_force_lines, chunk_pack, oversize_split, merged_units, markdown_blocks, backup_verified,
    )
}

_N, _H = len(_FILING_WORDS), len(_HINT_WORDS)
_W = listed(_FILING_WORDS)
_POINTS = lambda w: f"CASE WHEN contains(head, {quoted(T.fold(w))}) THEN 3 WHEN contains(top, {quoted(T.fold(w))}) THEN 2 WHEN contains(body, {quoted(T.fold(w))}) THEN 1 ELSE 0 END"
_KINDS = "[" + ", ".join(f"{{'n': {' + '.join(_POINTS(w) for w in ws)}, 'k': {-i}, 'name': {quoted(k)}}}" for i, (k, ws) in enumerate(V.FILING.items())) + "]"
_TYPES = "[" + ", ".join(f"{{'n': {' + '.join(f'contains(t, {quoted(T.fold(w))})::INTEGER' for w in ws)}, 'k': {-i}, 'name': {quoted(k)}}}" for i, (k, ws) in enumerate(V.TYPE_HINTS.items())) + "]"
_TOKENS = lambda x: f"list_distinct(list_filter(string_split({normal(x)}, ' '), lambda t: length(t) > 1 AND NOT list_contains({listed(T.fold(w) for w in V.GENERIC_NAMES)}, t)))"
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '[|~*`>]+', ' ', 'g'), '^[\\s—:-]+|[\\s—:-]+$', '', 'g')"

SQL = {
    "document_kinds": f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'a name' ELSE {normal(f"{_W}[o_orderkey % {_N} + 1] || ' order'")} END AS head, {normal(f"{_W}[o_orderkey * 3 % {_N} + 1]")} AS top,
          {normal(f"{_W}[o_orderkey * 3 % {_N} + 1] || ' ' || {_W}[o_orderkey * 5 % {_N} + 1] || ' ' || {_W}[o_orderkey * 11 % {_N} + 1]")} AS body FROM orders), b AS (SELECT o_orderkey, list_max({_KINDS}) AS m FROM t)
        SELECT CASE WHEN m.n >= 2 THEN m.name ELSE '' END AS kind, count(*) AS n, min(o_orderkey) AS first_order FROM b GROUP BY 1""",
    "document_types": f"""WITH t AS (SELECT o_orderkey, {normal(" || ' ' || ".join(f"{listed(_HINT_WORDS)}[o_orderkey * {m} % {_H} + 1]" for m in (1, 3, 7, 12)))} AS t FROM orders), b AS (SELECT o_orderkey, list_max({_TYPES}) AS m FROM t)
        SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'contract' WHEN m.n >= 2 THEN m.name ELSE 'general' END AS type, count(*) AS n, min(o_orderkey) AS first_order FROM b GROUP BY 1""",
    "project_match": f"""WITH o AS (SELECT DISTINCT p_name || ' ' || p_brand AS id FROM part WHERE p_partkey % 2 = 0), n AS (SELECT DISTINCT 'villa ' || p_brand || ' ' || regexp_extract(p_name, '^\\S+') AS id FROM part WHERE p_partkey % 2 = 1),
        ot AS (SELECT id, {_TOKENS('id')} AS ts FROM o), nt AS (SELECT id, {_TOKENS('id')} AS ts FROM n),
        p AS (SELECT n.id AS l, o.id AS r, len(list_intersect(n.ts, o.ts)) / least(len(n.ts), len(o.ts))::DOUBLE AS v FROM nt n JOIN ot o ON len(n.ts) > 0 AND len(o.ts) > 0),
        b AS (SELECT l, r FROM p WHERE v >= 0.6::DOUBLE QUALIFY row_number() OVER (PARTITION BY l ORDER BY v DESC, r) = 1) SELECT id AS name, coalesce(r, id) AS project, r IS NULL AS is_new FROM n LEFT JOIN b ON l = id""",
    "bookkeeping_sections": f"""WITH h AS (SELECT o_orderkey, {normal(f"'part ' || o_orderkey || ' ' || {listed(_HEADINGS)}[o_orderkey % {len(_HEADINGS)} + 1]")} AS h FROM orders), c AS (SELECT o_orderkey, CASE WHEN {has('h', V.BOOKKEEPING)} THEN {first('h', V.BOOKKEEPING)} ELSE {first('h', V.SELF_REFERENCE)} END AS cue FROM h) SELECT * FROM c WHERE cue <> ''""",
    "standing_read": f"""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN repeat('word ', 150) ELSE 'It is ' END || {listed(_STANDINGS)}[o_orderkey % {len(_STANDINGS)} + 1] || ' for the buyer' AS body FROM orders),
        t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'previous version' ELSE 'terms' END || ' ' || {normal('substring(body, 1, 700)')} AS t FROM b)
        SELECT o_orderkey, CASE WHEN {has('t', V.SUPERSEDED)} THEN 'superseded' WHEN {has('t', V.CURRENT)} THEN 'current' ELSE 'unknown' END AS standing FROM t""",
    "in_force_lines": f"""WITH o AS (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END AS citation, o_orderkey AS k FROM orders),
        l AS (SELECT o_custkey, citation, unnest(['Clause ' || k % 9 || '   scope ' || CASE k % 3 WHEN 0 THEN 'currently in force' WHEN 1 THEN 'as agreed' ELSE 'deleted' END || ' with ' || k % 5 || ' items', 'short 1 in force', 'The fee of ' || k % 7 || ' AED is no longer in force!']) AS line FROM o),
        n AS (SELECT *, {normal('line')} AS n FROM l), c AS (SELECT *, CASE WHEN {has('n', V.IN_FORCE)} THEN 'in_force' WHEN {has('n', V.DELETED)} THEN 'deletion' END AS kind FROM n),
        d AS (SELECT o_custkey, citation, kind, line FROM c WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey, substring(n, 1, 120) ORDER BY citation) = 1)
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY kind <> 'in_force', citation = 0, citation, line)::INTEGER AS place FROM d QUALIFY place <= 8""",
    "chunk_pack": """WITH RECURSIVE b AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)) AS ls FROM documents),
        f AS (SELECT doc_id, ls, 0::BIGINT AS i, 0::BIGINT AS first, NULL::BIGINT AS out_first, NULL::BIGINT AS out_last, false AS alone, 0 AS step FROM b UNION ALL
          SELECT doc_id, ls, i + 1,
            CASE WHEN ls[i + 1] > 1400 THEN i + 1 WHEN i > first AND coalesce(list_sum(list_transform(ls[first + 1 : i], lambda x: x + 2)), 0) + ls[i + 1] > 1400
              THEN list_min(list_filter(range(first, i + 1), lambda j: coalesce(list_sum(ls[j + 1 : i]), 0) <= 200)) ELSE first END,
            CASE WHEN i > first AND (ls[i + 1] > 1400 OR coalesce(list_sum(list_transform(ls[first + 1 : i], lambda x: x + 2)), 0) + ls[i + 1] > 1400) THEN first END,
            CASE WHEN i > first AND (ls[i + 1] > 1400 OR coalesce(list_sum(list_transform(ls[first + 1 : i], lambda x: x + 2)), 0) + ls[i + 1] > 1400) THEN i END, ls[i + 1] > 1400, step + 1
          FROM f WHERE i < len(ls)),
        c AS (SELECT doc_id, step * 2 AS o, out_first AS first, out_last - out_first AS n, (list_sum(list_transform(ls[out_first + 1 : out_last], lambda x: x + 2)) - 2) AS chars FROM f WHERE out_first IS NOT NULL
          UNION ALL SELECT doc_id, step * 2 + 1, i - 1, 1, ls[i] FROM f WHERE alone
          UNION ALL SELECT doc_id, step * 2 + 2, first, len(ls) - first, list_sum(list_transform(ls[first + 1 : len(ls)], lambda x: x + 2)) - 2 FROM f WHERE i = len(ls) AND first < len(ls))
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INTEGER AS chunk, first::INTEGER AS first, n::INTEGER AS n, chars::INTEGER AS chars FROM c""",
    "oversize_split": """WITH RECURSIVE d AS (SELECT doc_id, doc_id % 3 AS form, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        s AS (SELECT doc_id, form, CASE form WHEN 0 THEN flatten(list_transform(list_filter(list_transform(regexp_split_to_array(t, '[.!?]+\\s+|\\n+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: list_transform(range(0, ceil(length(x) / 1400.0)::BIGINT), lambda i: least(1400, length(x) - 1400 * i))))
            WHEN 1 THEN list_transform(ls[CASE WHEN len(ls) > 2 THEN 3 ELSE 2 END : len(ls)], lambda x: length(x) + 4) ELSE list_transform(ls, lambda x: length(x)) END AS zs,
          CASE WHEN form = 1 THEN CASE WHEN len(ls) > 2 THEN length(ls[1]) + length(ls[2]) + 9 ELSE length(ls[1]) + 4 END ELSE 0 END AS head, CASE form WHEN 2 THEN 1390 ELSE 1400 END AS size FROM d),
        f AS (SELECT doc_id, form, zs, head, size, 0::BIGINT AS i, 0 AS part, head::BIGINT AS used, 0::BIGINT AS n FROM s UNION ALL
          SELECT doc_id, form, zs, head, size, i + 1, CASE WHEN n > 0 AND used + zs[i + 1] + 1 > size THEN part + 1 ELSE part END, CASE WHEN n > 0 AND used + zs[i + 1] + 1 > size THEN head ELSE used END + zs[i + 1] + 1, CASE WHEN n > 0 AND used + zs[i + 1] + 1 > size THEN 1 ELSE n + 1 END FROM f WHERE i < len(zs))
        SELECT doc_id, form, part::INTEGER AS part, (min(i) - 1)::INTEGER AS first, count(*)::INTEGER AS n, max(used)::INTEGER AS chars FROM f WHERE i > 0 GROUP BY doc_id, form, part""",
    "merged_units": """WITH RECURSIVE u AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, l_partkey * 37 % 400 AS chars, l_suppkey % 2 AS place, length(l_partkey::VARCHAR) + 4 AS head FROM lineitem),
        f AS (SELECT l_orderkey, pos, 0 AS unit, pos AS anchor, pos AS first, chars, (pos - 1) // 4 AS parent, place FROM u WHERE pos = 1 UNION ALL
          SELECT u.l_orderkey, u.pos, CASE WHEN j THEN unit ELSE unit + 1 END, CASE WHEN j AND u.chars <= f.chars THEN anchor ELSE u.pos END, CASE WHEN j THEN first ELSE u.pos END, CASE WHEN j THEN f.chars + u.chars + u.head + 3 ELSE u.chars END, (u.pos - 1) // 4, u.place
          FROM (SELECT f.*, n.chars AS nc, f.chars < 200 AND f.chars + n.chars + 2 <= 1400 AND f.parent = (n.pos - 1) // 4 AND f.place = n.place AS j FROM f JOIN u n ON n.l_orderkey = f.l_orderkey AND n.pos = f.pos + 1) f JOIN u ON u.l_orderkey = f.l_orderkey AND u.pos = f.pos + 1)
        SELECT l_orderkey, unit::INTEGER AS unit, arg_max(anchor, pos)::INTEGER AS anchor, min(first)::INTEGER AS first, count(*)::INTEGER AS n, arg_max(chars, pos)::INTEGER AS chars FROM f GROUP BY l_orderkey, unit""",
    "markdown_blocks": """SELECT o_orderkey, class, first_line::INTEGER AS first_line, n::BIGINT AS n_lines FROM orders, (VALUES ('heading', 0, 1), ('lead', 2, 1), ('bullet', 3, 1), ('bullet', 4, 1), ('table', 5, 3), ('paragraph', 8, 1), ('paragraph', 9, 1)) AS b(class, first_line, n)""",
    "backup_verified": """WITH s AS (SELECT coalesce(source, '') AS name, count(*) AS n, count(*) FILTER (doc_id % 10 = 0) AS lost FROM documents GROUP BY 1)
        SELECT name, CASE WHEN length(name) % 4 = 0 OR (length(name) % 4 = 1 AND n = lost) THEN 'missing' WHEN length(name) % 4 = 1 AND lost > 0 THEN 'rows differ' WHEN length(name) % 4 = 2 THEN 'content differs' ELSE 'same' END AS state FROM s""",
}
