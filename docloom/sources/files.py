"""Files as rows: what they are, Markdown with front matter, and the sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.listing import listed, opened, registry  # noqa: F401  every file below a folder and what it is

#: The front-matter keys that are read.
KEYS = ("title", "category", "source", "version", "date", "language", "author", "tags", "project", "reference")
FRONT = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


#: What reads each kind of file; a kind without a reader is refused.
READERS = {"markdown": "markdown", "docx": "paragraphs", "xlsx": "cells", "pdf": "pages", "png": "pages", "jpeg": "pages", "tiff": "pages"}


def dispatched(files: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """``path, kind, reader``: the reader of each file whose kind is allowed and has one, else null."""
    lookup = F.create_map(*[F.lit(x) for k, r in READERS.items() if k in allowed for x in (k, r)])
    return files.select("path", "kind", F.try_element_at(lookup, F.col("kind")).alias("reader"))


def _content(f, path: str) -> Iterator[tuple]:
    yield f.read(), None


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """``path, meta, body`` of the Markdown files below a folder: flat front matter becomes a map
    of the known keys, lower-cased, without empty values; the block goes from the body. Files are listed and
    opened in as many tasks as there is room for, however many there are; one that can't be read is an error."""
    files = opened(listed(spark, path).where(F.col("path").rlike(r"\.(md|markdown)$")), _content, "content binary, error string")
    content = F.when(F.col("error").isNull(), F.col("content")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")).cast("binary"))
    text = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    return split_front_matter(files.select("path", text.alias("text")))


def split_front_matter(df: DataFrame) -> DataFrame:
    block = F.regexp_extract("text", FRONT, 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\s*\w+\s*:"))
    entry = lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^\s*(\w+)\s*:", 1))).alias("k"), F.trim(F.regexp_replace(F.regexp_extract(x, r":\s*(.*)$", 1), r"^[\"']|[\"']$", "")).alias("v"))
    wanted = F.filter(F.transform(pairs, entry), lambda e: e["k"].isin(*KEYS) & (e["v"] != ""))
    # of a key given twice the last counts
    last = F.filter(wanted, lambda e, i: ~F.exists(F.slice(wanted, i + 2, F.greatest(F.size(wanted), F.lit(1))), lambda o: o["k"] == e["k"]))
    return df.select("path", F.map_from_entries(last).alias("meta"), F.regexp_replace("text", FRONT, "").alias("body"))


def markdown_sections(df: DataFrame, key: str, body: str) -> DataFrame:
    """``key, section, level, heading, first_line, n_lines``: ATX headings outside of code fences;
    lines before the first one are a section of level 0, left out where empty."""
    from pyspark.sql import Window

    lines = df.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("line", "content"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("content").rlike(r"^\s*(```|~~~)")
    lines = lines.withColumn("inside", F.sum(fence.cast("int")).over(w) % 2 == 1)
    level = F.when(F.col("inside") | fence, 0).otherwise(F.length(F.regexp_extract("content", r"^(#{1,6})\s+\S", 1)))
    lines = lines.withColumn("level", level)
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    heading = F.trim(F.regexp_replace(F.regexp_replace("content", r"^#{1,6}\s+", ""), r"\s+#+\s*$", ""))
    out = lines.groupBy(key, "section").agg(
        F.max("level").alias("level"),
        F.max(F.when(F.col("level") > 0, heading)).alias("heading"),
        F.min("line").alias("first_line"),
        F.count("*").alias("n_lines"),
        F.max((F.trim("content") != "").cast("int")).alias("some"),
    )
    return out.where("level > 0 or some = 1").drop("some")


def write(df: DataFrame, path: str, form: str = "parquet", by: str | None = None) -> None:
    """Parquet, ORC, JSON or CSV; with ``by`` one folder for each value, replaced on its own."""
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(by) if by else out).format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)
