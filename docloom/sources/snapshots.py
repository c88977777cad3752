"""Tables that change in whole steps: a reader sees all of a replace or nothing of it.

A version is a manifest that names folders of Parquet files, which are never changed, and of rows that are
gone: their file and place in it, as Spark's own file metadata tells. It is committed by giving the finished manifest its
name, which one writer alone can do. Who comes second finds the name taken: additions follow the other's
commit, whatever depends on rows that were read is a conflict.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE, PLACE = "__file", "__place"
GONE = f"{FILE} string, {PLACE} long"


class Conflict(Exception):
    """Another writer has committed since the version that this one read."""


class Table:
    """A table below ``path``. Methods that change it commit one version and return its number; those that
    read take the last one, or the one asked for, which stays as it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- versions

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where, fs = self._hadoop(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            version = (self.versions() or [-1])[-1]
        if version < 0:
            return {"version": -1, "kind": "none", "data": [], "gone": [], "schema": None}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{version:012d}.json").collect()))

    def _commit(self, base: dict, kind: str, data: list[str], gone: list[str], schema: str) -> int:
        """Names the next manifest; an addition goes behind other commits, anything else raises."""
        while True:
            made = base | {"version": base["version"] + 1, "kind": kind, "data": data, "gone": gone, "schema": schema}
            if self._named(json.dumps(made), made["version"]):
                return made["version"]
            if kind != "append":
                raise Conflict(f"version {made['version']} of {self.path} is another writer's")
            new = data[len(base["data"]) :]
            base = self.manifest(made["version"])
            data, gone = base["data"] + new, base["gone"]

    def _named(self, text: str, version: int) -> bool:
        """Whether the manifest could take the version's name, which is free but once."""
        draft, name = f"{self.path}/versions/.{uuid.uuid4().hex}", f"{self.path}/versions/{version:012d}.json"
        where, fs = self._hadoop(draft)
        out = fs.create(where, False)
        out.write(text.encode())
        out.close()
        try:
            if urlparse(draft).scheme in ("", "file"):
                # a local rename would replace the file; a second link to a taken name fails
                try:
                    os.link(unquote(urlparse(draft).path), unquote(urlparse(name).path))
                    return True
                except FileExistsError:
                    return False
            return bool(fs.rename(where, self._hadoop(name)[0]))
        finally:
            if fs.exists(where):
                fs.delete(where, False)

    def _folder(self, df: DataFrame, kind: str) -> str:
        folder = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    # --- reading

    def _rows(self, m: dict) -> DataFrame:
        """The rows of a version, each with its file and its place there."""
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        places = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE)]
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{d}" for d in m["data"]]).select("*", *places)
        if m["gone"]:
            gone = self.spark.read.schema(GONE).parquet(*[f"{self.path}/{d}" for d in m["gone"]])
            rows = rows.join(gone, [FILE, PLACE], "left_anti")
        return rows

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError(f"{self.path} has no version")
        if not m["data"]:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(m["schema"])))
        return self._rows(m).drop(FILE, PLACE)

    def count(self, version: int | None = None, where: Column | str | None = None) -> int:
        rows = self.read(version)
        return (rows.where(where) if where is not None else rows).count()

    def scroll(self, keys: list[str], size: int, after: tuple | None = None, version: int | None = None, where: Column | str | None = None) -> DataFrame:
        """The next ``size`` rows in the order of ``keys`` after the keys of the last row that was seen. Keys must tell rows
        apart and hold no nulls; pages of one version then have every row once, whatever is committed meanwhile."""
        rows = self.read(version)
        rows = rows.where(where) if where is not None else rows
        if after is not None:
            # (a, b) > (x, y), in a form that is pushed down to the files
            beyond, same = F.lit(False), F.lit(True)
            for k, v in zip(keys, after, strict=True):
                beyond, same = beyond | (same & (F.col(k) > F.lit(v))), same & (F.col(k) == F.lit(v))
            rows = rows.where((F.col(keys[0]) >= F.lit(after[0])) & beyond)
        return rows.orderBy(*keys).limit(size)

    def pages(self, keys: list[str], size: int, version: int | None = None) -> Iterator[DataFrame]:
        version, after = self.manifest(version)["version"], None
        while True:
            page = self.scroll(keys, size, after, version)
            last = page.select(*keys).tail(1)
            if not last:
                return
            yield page
            after = tuple(last[0])

    # --- changing

    def append(self, df: DataFrame) -> int:
        m = self.manifest()
        return self._commit(m, "append", [*m["data"], self._folder(df, "data")], m["gone"], m["schema"] or df.schema.json())

    def replace(self, df: DataFrame, keys: list[str]) -> int:
        """``df`` in place of all rows that have one of its keys; rows of new keys are added. Null keys meet null keys."""
        return self._changed("replace", df, df.select(*keys).distinct(), keys)

    def delete(self, gone: DataFrame, keys: list[str]) -> int:
        """Without the rows that have one of the keys of ``gone``."""
        return self._changed("delete", None, gone.select(*keys).distinct(), keys)

    def _changed(self, kind: str, df: DataFrame | None, asked: DataFrame, keys: list[str]) -> int:
        m = self.manifest()
        data, gone = list(m["data"]), list(m["gone"])
        new = self._folder(df, "data") if df is not None else None
        if data:
            asked = asked.select(*[F.col(k).alias(f"__{k}") for k in keys])
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
            gone.append(self._folder(self._rows(m).join(asked, same, "left_semi").select(FILE, PLACE), "gone"))
        return self._commit(m, kind, data + ([new] if new else []), gone, m["schema"] or (df.schema.json() if df is not None else None))

    def back_to(self, version: int) -> int:
        """A new version with the rows of an old one."""
        m, old = self.manifest(), self.manifest(version)
        return self._commit(m, "back", old["data"], old["gone"], old["schema"])

    def compact(self) -> int:
        """The same rows in new files, without the rows that are gone."""
        m = self.manifest()
        return self._commit(m, "compact", [self._folder(self._rows(m).drop(FILE, PLACE), "data")], [], m["schema"])
