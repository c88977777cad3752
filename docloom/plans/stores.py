"""Queries over tables that change in versions, and over backups that are checked and restored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import backups as B
from docloom.operators.store import forget, shared, stored
from docloom.plans.retrieval import read
from docloom.sources.snapshots import Table

PAGES = 10


def _as_one(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a table; pages replace those of their ids; the toxic ones are deleted; the last step is taken
    back; new files are made of what is left. What each version holds by kind, read once all are there."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.text_or_empty("text").alias("body"), F.lit("document").alias("kind"))
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.text_or_empty("html").alias("body"), F.lit("page").alias("kind"))
    table = Table(spark, shared(spark, "versions"))
    table.append(d)
    table.replace(p, ["id"])
    deleted = table.delete(read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), ["id"])
    table.back_to(deleted - 1)
    table.compact()
    per = [table.read(v).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("body").cast("long")).alias("chars")).withColumn("version", F.lit(v)) for v in table.versions()]
    out = stored(_as_one(per))
    forget(spark, table.path)
    return out


def _vectors(spark: SparkSession, sf_dir: str) -> Table:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    table = Table(spark, shared(spark, "vectors"))
    table.append(v)
    table.replace(v.where(F.col("vec_id") % 3 == 0).select("vec_id", (F.col("label") + 100).alias("label")), ["vec_id"])
    table.delete(v.where("label = 5").select("vec_id"), ["vec_id"])
    return table


def vector_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after a second load that relabels every third, and after a delete by label: counts by payload."""
    table = _vectors(spark, sf_dir)
    out = stored(_as_one([table.read(v).groupBy("label").agg(F.count("*").alias("n")).withColumn("version", F.lit(v)) for v in table.versions()]))
    forget(spark, table.path)
    return out


def vector_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that are left, scrolled through in ten pages while more are added: each row once."""
    table = _vectors(spark, sf_dir)
    size = -(-table.count() // PAGES) or 1
    pages = []
    for i, page in enumerate(table.pages(["label", "vec_id"], size)):
        pages.append(page.agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.max("vec_id").alias("most"), F.min("label").alias("label")).withColumn("page", F.lit(i)))
        table.append(page.limit(1))
    out = stored(_as_one(pages)) if pages else spark.createDataFrame([], "n long, least long, most long, label int, page int")
    forget(spark, table.path)
    return out


def backup_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup of the documents, and a table that has since lost rows, gained copies and changed texts: the
    parts that differ, their rows before and in the backup, and whether a restore of these alone makes all equal."""
    d = read(spark, sf_dir, "documents")
    path, part = shared(spark, "backup"), B.part_of(F.col("doc_id"))
    B.backup(d, part, path)
    mark = F.col("doc_id") % 512
    live = d.where(mark != 3).withColumn("text", F.when(mark == 5, F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text")))
    live = stored(live.unionByName(d.where(mark == 7)))
    _, was = B.saved(spark, path)
    found = stored(B.differing(B.tree(live, part), was))
    after = stored(B.restored(live, part, path, found))
    still = B.differing(B.tree(after, part), was)
    broken = B.drill(spark, path)
    checked = still.agg(F.count("*").alias("left")).crossJoin(broken.agg(F.count("*").alias("damaged")))
    out = stored(found.crossJoin(F.broadcast(checked)).select("part", "ours", "theirs", ((F.col("left") == 0) & (F.col("damaged") == 0)).alias("restored")))
    forget(spark, path)
    return out


QUERIES = {f.__name__: f for f in (document_versions, vector_versions, vector_scroll, backup_restored)}

_VECTORS = """v AS (SELECT 0 AS version, vec_id, label FROM embeddings UNION ALL SELECT x, vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END FROM embeddings, (VALUES (1), (2)) t(x) WHERE x = 1 OR label IS DISTINCT FROM 5)"""

SQL = {
    "document_versions": """WITH a AS (SELECT doc_id AS id, 'document' AS kind, length(coalesce(text, '')) AS c FROM documents), p AS (SELECT page_id AS id, 'page' AS kind, length(coalesce(html, '')) AS c FROM pages),
        b AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM p) UNION ALL FROM p), t AS (SELECT doc_id FROM labels WHERE toxic = 1),
        v AS (SELECT 0 AS version, * FROM a UNION ALL SELECT x, id, kind, c FROM b, (VALUES (1), (2), (3), (4)) AS t(x) WHERE x <> 2 OR id NOT IN (FROM t))
        SELECT version, kind, count(*) AS n, sum(c)::BIGINT AS chars FROM v GROUP BY version, kind""",
    "vector_versions": f"WITH {_VECTORS} SELECT version, label, count(*) AS n FROM v GROUP BY version, label",
    "vector_scroll": f"""WITH {_VECTORS}, o AS (SELECT *, row_number() OVER (ORDER BY label, vec_id) - 1 AS i, greatest(1, (count(*) OVER () + {PAGES - 1}) // {PAGES}) AS size FROM v WHERE version = 2)
        SELECT (i // size)::INTEGER AS page, count(*) AS n, min(vec_id) AS least, max(vec_id) AS most, min(label) AS label FROM o GROUP BY 1""",
    "backup_restored": """WITH d AS (SELECT doc_id % 256 AS part, doc_id % 512 AS m FROM documents)
        SELECT part::INTEGER AS part, count(*) FILTER (m <> 3) + count(*) FILTER (m = 7) AS ours, count(*) AS theirs, true AS restored FROM d GROUP BY part HAVING bool_or(m IN (3, 5, 7))""",
}
