"""What joins a pool of candidates or is moved in it: arms by entities, scopes, slots, splices, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V
from docloom.operators import language as L
from docloom.operators import retrieval as R
from docloom.operators.store import stored

#: Hits, sections and chunks of the entity arm; slots; projects that a word may name.
HITS, SECTIONS, CHUNKS, RECENT, PROJECTS = 40, 8, 12, 3, 3
COMPARES = r"الفرق|فرق|مقارنه|قارن|مقابل|versus|\bvs\b|difference|compare|differ"


def entity_hits(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """``q, document, section`` that facts of a question's words and kinds point to: its first 40 hits, and
    of each document among them the first eight sections. ``questions``: ``q, term, kind``; ``entities``:
    ``document, section, id, term, kind``. A word and kind has its first hits once, for all questions of it."""
    asked = questions.select("term", "kind").distinct()
    hits = entities.join(F.broadcast(asked), ["term", "kind"], "left_semi")
    # a hit that stands twice is no second one: ranks of equal rows are equal
    few = Window.partitionBy("term", "kind").orderBy("document", "section", "id")
    hits = hits.select("term", "kind", "document", "section", "id").withColumn("n", F.dense_rank().over(few)).where(F.col("n") <= HITS).distinct().drop("n")
    hit = questions.join(hits, ["term", "kind"]).select("q", "document", "section", "id").distinct()
    hit = R.ranked(hit, ["q"], F.col("document"), F.col("section"), F.col("id"), out="n").where(F.col("n") <= HITS)
    first = hit.groupBy("q", "document", "section").agg(F.min("n").alias("n"))
    return R.ranked(first, ["q", "document"], F.col("n"), out="place").where(F.col("place") <= SECTIONS).drop("n")


def chunks_in(sections: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """``q, document, section, chunk``: the chunks of the wanted sections of each document in order."""
    met = sections.join(chunks, ["document", "section"])
    return R.ranked(met, ["q", "document"], F.col("chunk"), F.col("section"), out="nth").where(F.col("nth") <= most).select("q", "document", "section", "chunk")


def known_stems(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The terms that a vocabulary has, or that begin one of its words or begin with one, of three letters at
    least.

    Both are sorted together by ranges. A word is the interval of all that begins with it: a term lies in
    one if, of the words up to it, the furthest end lies behind it; and it begins a word if the next word
    does. Each range is looked through on its own; the furthest end before it and the first word after it
    are carried over, a row for each range. No bucket grows with the vocabulary."""
    word = vocabulary.select(F.col("term").alias("t")).distinct().withColumn("known", F.lit(1))
    term = terms.select(F.col("term").alias("t")).distinct().withColumn("known", F.lit(0))
    sized = F.length("t") >= 3
    end = F.when((F.col("known") == 1) & sized, F.concat("t", F.lit("\U0010ffff")))
    # words come before equal terms, so that they count as up to them
    placed = stored(word.unionByName(term).withColumn("end", end).repartitionByRange("t").withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part").orderBy("t", F.desc("known"))
    own = F.when((F.col("known") == 1) & sized, F.col("t"))
    inside = placed.withColumn("furthest", F.max("end").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    # the next word, as the last one of those that come before from the far end: a frame that only grows
    back = Window.partitionBy("part").orderBy(F.desc("t"), "known").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("next", F.last(own, ignorenulls=True).over(back))
    inside = inside.withColumn("same", F.max("known").over(Window.partitionBy("part", "t")) == 1)
    parts = placed.groupBy("part").agg(F.max("end").alias("e"), F.min(own).alias("w"))
    along = Window.partitionBy(F.lit(0)).orderBy("part")  # a row for each range
    parts = parts.select("part", F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("w", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    met = inside.where("known = 0").join(parts, "part")
    furthest, following = F.greatest("furthest", "before"), F.coalesce("next", "after")
    hit = F.col("same") | (sized & (F.coalesce(furthest > F.col("t"), F.lit(False)) | F.coalesce(F.startswith(following, F.col("t")), F.lit(False))))
    return met.where(hit).select(F.col("t").alias("term"))


def runs(tokens: Column, most: int) -> Column:
    """All runs of one to ``most`` neighbouring tokens, as text."""
    n = F.size(tokens)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(k) for k in range(1, most + 1)])))


def distinctive(tokens: Column) -> Column:
    """A word beyond kinds of document and figures."""
    return F.exists(tokens, lambda t: (F.length(t) > 2) & ~t.rlike(r"^\d+$") & ~t.isin(*V.KIND_WORDS))


def document_scope(questions: DataFrame, documents: DataFrame, longest: int = 8) -> DataFrame:
    """``q, decision, document, n``: the documents that a question names. ``questions``: ``q, text``;
    ``documents``: ``document, filename``.

    A full file name; else base names (without versions) that are specific and say which document; of
    several the one whose version is given, or the longest that contains all others; different names, or
    any in a comparison, mean several; else it is ambiguous. Names are met by an equi-join of the
    question's runs of tokens with the names."""
    d = documents.withColumn("name", L.stem_tokens(F.col("filename"))).withColumn("base", L.base_tokens(F.col("name")))
    text = lambda c: F.array_join(c, " ")
    d = d.select("document", text(F.col("name")).alias("name"), text(F.col("base")).alias("base"), text(F.concat("name", F.array(F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))))).alias("full"), F.size("base").alias("width"), distinctive(F.col("base")).alias("good"), ((F.size("base") >= 2) | (F.length(F.get("base", 0)) >= 6)).alias("names"), (F.size("name") > F.size("base")).alias("versioned"))
    q = questions.withColumn("ts", L.file_tokens(F.col("text"))).withColumn("compares", F.lower("text").rlike(COMPARES))
    said = q.select("q", "compares", F.explode(runs(F.col("ts"), longest)).alias("run"))
    exact = said.join(d, F.col("run") == F.col("full")).select("q", "document").withColumn("exact", F.lit(True))
    base = said.join(d.where("names and good and width >= 2"), F.col("run") == F.col("base")).select("q", "document", "base", "width", "versioned", "name")
    named = base.join(said.select(F.col("q").alias("q2"), F.col("run").alias("r2")), (F.col("q") == F.col("q2")) & (F.col("name") == F.col("r2")), "left").withColumn("version", F.col("versioned") & F.col("r2").isNotNull()).drop("q2", "r2")
    m = named.join(exact, ["q", "document"], "full").withColumn("exact", F.coalesce("exact", F.lit(False)))
    w = Window.partitionBy("q")
    m = m.join(q.select("q", "compares"), "q").withColumns({"n_exact": F.count_if("exact").over(w), "n_base": F.count("base").over(w), "n_version": F.count_if("version").over(w), "widest": F.max("width").over(w)})
    m = m.withColumn("n_widest", F.count_if(F.col("width") == F.col("widest")).over(w)).withColumn("bases", F.array_distinct(F.collect_set("base").over(w)))
    top = F.max(F.when(F.col("width") == F.col("widest"), F.col("base"))).over(w)
    m = m.withColumn("top", top)
    inside = F.forall("bases", lambda b: F.contains(F.concat(F.lit(" "), F.col("top"), F.lit(" ")), F.concat(F.lit(" "), b, F.lit(" "))))
    apart = (F.size("bases") == F.col("n_base")) & ~F.exists("bases", lambda a: F.exists("bases", lambda b: (a != b) & F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))))
    decision = (
        F.when((F.col("n_exact") == 1) & ~F.col("compares"), "file").when(F.col("n_base") == 0, "none").when(F.col("compares") & (F.col("n_base") > 1), "several").when(F.col("n_base") == 1, "document")
        .when(F.col("n_version") == 1, "version").when((F.col("n_widest") == 1) & inside & (F.size("bases") > 1), "longest").when(apart, "several").otherwise("ambiguous")
    )
    m = m.withColumn("decision", decision)
    taken = F.when(F.col("decision") == "file", F.col("exact")).when(F.col("decision") == "version", F.col("version")).when(F.col("decision") == "longest", F.col("width") == F.col("widest")).otherwise(F.col("base").isNotNull())
    return m.where((F.col("decision") != "none") & taken).groupBy("q", "decision").agg(F.min("document").alias("document"), F.count("*").alias("n"))


def word_projects(names: DataFrame) -> DataFrame:
    """``word, project`` of words that few projects' names carry. ``names``: ``project, word`` distinct."""
    few = names.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") <= PROJECTS).select("word")
    return names.join(few, "word", "left_semi")


def project_scope(questions: DataFrame, projects: DataFrame) -> DataFrame:
    """``q, project`` of the projects with most of a question's words; none if more than three tie."""
    hits = questions.join(projects, "word").groupBy("q", "project").agg(F.count("*").alias("n"))
    best = F.max("n").over(Window.partitionBy("q"))
    top = hits.withColumn("best", best).where("n = best").withColumn("ties", F.count("*").over(Window.partitionBy("q")))
    return top.where(F.col("ties") <= PROJECTS).select("q", "project")


def reserved(pool: DataFrame, group: str, slots: int, limit: int, order: list[Column], key: str = "doc_id", section: str = "section") -> DataFrame:
    """Final places once dated evidence has its slots: one row for each section of the dated ones
    (``dated``) in the given order, ``slots`` of them. Those that the final rows (``final``: place or null)
    lack go first, and the final rows fill the rest of ``limit``; nothing changes where none is missing."""
    one = R.ranked(pool.where("dated"), [group, section], *order, out="in_section").where("in_section = 1")
    picked = R.ranked(one, [group], *order, out="slot").where(F.col("slot") <= slots).select(group, key, "slot")
    both = pool.join(picked, [group, key], "left")
    missing = F.when(F.col("slot").isNotNull() & F.col("final").isNull(), F.col("slot"))
    w = Window.partitionBy(group)
    both = both.withColumn("lead", missing).withColumn("n_missing", F.count("lead").over(w))
    keep = F.greatest(F.lit(limit) - F.col("n_missing"), F.lit(1))
    both = both.where(F.col("lead").isNotNull() | (F.col("final").isNotNull() & (F.col("final") <= keep)))
    return R.ranked(both, [group], F.col("lead").isNull(), F.coalesce("lead", "final"), out="place").select(group, key, "place", F.col("lead").isNotNull().alias("reserved"))


def spliced(final: DataFrame, added: DataFrame, group: str, key: str, after: int) -> DataFrame:
    """Rows of ``added`` (``group, key, nth``) placed after the first ``after`` of ``final`` (``group, key, place``)."""
    a = added.select(group, key, (F.lit(after) + F.col("nth") / 1000).alias("at"), F.lit(True).alias("added"))
    both = final.select(group, key, F.col("place").cast("double").alias("at"), F.lit(False).alias("added")).unionByName(a)
    return R.ranked(both, [group], F.col("at"), out="place").drop("at")


def cascade(ranked: DataFrame, group: str, scorer, head: int, weight: float) -> DataFrame:
    """The first ``head`` rows of each group by score plus ``weight`` times the sigmoid of what ``scorer`` (a
    function of Columns) says; the tail keeps its places after them."""
    logit = scorer()
    bonus = F.when(F.col("rank") <= head, F.round(F.lit(weight) / (1 + F.exp(-logit)), 6))
    r = ranked.withColumn("total", F.round(F.col("score") + F.coalesce(bonus, F.lit(0.0)), 6))
    order = [F.col("rank") > head, F.when(F.col("rank") <= head, -F.col("total")).otherwise(F.col("rank").cast("double")), F.col("rank")]
    return R.ranked(r, [group], *order, out="place")
