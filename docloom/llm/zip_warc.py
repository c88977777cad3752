"""Web archives packed in ZIP files: written by Spark tasks, read back by ranges.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz``, one
gzip member for each WARC record, and ``indexes/index.cdxj``, a line for each record with its
offset and length. The reader parses the ZIP's directories, ZIP64 ones too, finds where the two
members begin, and reads only the ranges of the records that it wants; nothing is extracted.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import shared_dir, stored, table

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_REVISIT = 100
#: Payload after which an archive is closed, and records that are read by one range.
ARCHIVE_BYTES, RANGE_RECORDS = 32 << 20, 128
#: Archive bytes that a reading task gets, about.
READ_BYTES = 16 << 20
#: Spark's names of stores that the file-system library calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}
MANIFEST = "uri string, records long, size long"
RANGES = "uri string, start long, length long, sizes array<long>"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, stated_digest string, stated_bytes long"


# --- ZIP directories ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def _find_directory(f, size: int) -> tuple[int, int, int]:
    """Offset, length and entries of the central directory, from the end record or, where one of
    its fields is full, the ZIP64 end record that the locator before it points to."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    entries, length, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    if entries == 0xFFFF or 0xFFFFFFFF in (length, offset):
        locator = f.read_at(20, tail_at + at - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = f.read_at(56, struct.unpack("<Q", locator[8:16])[0])
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, length, offset = struct.unpack("<QQQ", end[32:56])
    return offset, length, entries


def members(f, size: int) -> dict[str, Member]:
    """The members that the central directory lists."""
    offset, length, entries = _find_directory(f, size)
    raw, at, out = f.read_at(length, offset), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        method = struct.unpack("<H", raw[at + 10 : at + 12])[0]
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
        header = struct.unpack("<I", raw[at + 42 : at + 46])[0]
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: 8-byte values of those fields that are full, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        out[name] = Member(name, method, packed, header)
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes begin: its local header has lengths of its own."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed: its records can't be read by ranges")
    local = f.read_at(30, member.header)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.header + 30 + sum(struct.unpack("<HH", local[26:30]))


def renamed(uri: str) -> str:
    """The URI under the scheme that the file-system library knows."""
    scheme, mark, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme.lower(), scheme)}{mark}{rest}" if mark else uri


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(renamed(uri))


# --- WARC records ------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; with ``first`` a revisit of that page's, which has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    fields = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    fields["WARC-Payload-Digest"] = f"sha256:{digest}"
    if first is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{first}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "None"
    return None if number == "None" else int(number)


def parse(raw: bytes) -> tuple:
    """A row of RECORDS. A payload that is not what its digest says is an error."""
    from hashlib import sha256

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].removeprefix("sha256:")
    revisit = warc["warc-type"] == "revisit"
    if not revisit and sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {warc['warc-record-id']} has another digest")
    return (
        _page(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], _page(warc.get("warc-refers-to")),
        None if revisit else payload, digest, int(_fields(http_head)["content-length"]),
    )


# --- the jobs ----------------------------------------------------------------------------------


def numbered_copies(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, first``: ``first`` is the page that a revisit refers to.

    Digests are counted in each task before the shuffle, and only those that repeat are kept, in
    a stored table whose size Spark knows: small it is broadcast and pages stay where they are;
    large it is a join that splits a digest with very many pages."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    again = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    again = stored(again.where("n > 1 and least is not null").select(F.col("digest").alias("d"), "least"))
    first = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    return rows.join(again, F.col("digest") == F.col("d"), "left").select("page_id", "url", "payload", "digest", first.alias("first"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of all pages in ``folder``, a URI that every executor can write to, and their
    stored manifest ``uri, records, size``. A task that runs again writes files of new names; the
    manifest lists those of the attempt that counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        warc, index, held = io.BytesIO(), [], 0

        def closed() -> pa.RecordBatch:
            out, name = io.BytesIO(), f"{uuid.uuid4().hex}.wacz"
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(WARC, warc.getbuffer())
                z.writestr(INDEX, "".join(index))
            with system.open_output_stream(f"{path}/{name}") as f:
                f.write(out.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)]), pa.array([out.tell()])], ["uri", "records", "size"])

        for b in batches:
            for row in zip(*(b.column(k) for k in range(5))):
                page_id, url, payload, digest, first = (v.as_py() for v in row)
                raw = gzip.compress(record(page_id, url, payload, digest, first), compresslevel=1, mtime=0)
                key = json.dumps({"offset": str(warc.tell()), "length": str(len(raw)), "filename": "data.warc.gz", "digest": f"sha256:{digest}"})
                index.append(f"{'' if url is None else quote(url)} 19700101000000 {key}\n")
                warc.write(raw)
                held += len(payload)
                if held >= ARCHIVE_BYTES:
                    yield closed()
                    warc, index, held = io.BytesIO(), [], 0
        if index:
            yield closed()

    return stored(numbered_copies(pages).mapInArrow(run, MANIFEST))


def ranges(manifest: DataFrame) -> DataFrame:
    """``uri, start, length, sizes``: ranges of the archives, each of some neighbouring records
    of the given sizes, from the directories and indexes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                system, path = _open(uri)
                with system.open_input_file(path) as f:
                    found = members(f, f.size())
                    base = data_start(f, found[WARC])
                    index = f.read_at(found[INDEX].size, data_start(f, found[INDEX])).decode()
                keys = [json.loads(line.split(" ", 2)[2]) for line in index.splitlines()]
                spans = [(base + int(k["offset"]), int(k["length"])) for k in keys]
                parts = [spans[k : k + RANGE_RECORDS] for k in range(0, len(spans), RANGE_RECORDS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(parts), pa.string()), pa.array([p[0][0] for p in parts], pa.int64()), pa.array([sum(n for _, n in p) for p in parts], pa.int64()), pa.array([[n for _, n in p] for p in parts], pa.list_(pa.int64()))],
                    [c.split()[0] for c in RANGES.split(", ")],
                )

    return manifest.select("uri").mapInArrow(run, RANGES)


def read(manifest: DataFrame) -> DataFrame:
    """The records of all archives, dealt out evenly by range before they are read: to as many tasks
    as the archives' size asks for, and to every core at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start, length, sizes in zip(*(b.column(k).to_pylist() for k in range(4))):
                system, path = _open(uri)
                with system.open_input_file(path) as f:
                    raw = f.read_at(length, start)
                rows, at = [], 0
                for n in sizes:
                    rows.append(parse(zlib.decompress(raw[at : at + n], wbits=31)))
                    at += n
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in RECORDS.split(", ")])

    spark = manifest.sparkSession
    size = manifest.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    spread = stored(ranges(manifest)).repartition(int(tasks), "uri", "start")
    return spread.mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` of all records, both
    figures from payloads that were read: a revisit's are those of the response that it refers to.

    What is stored for this has no payloads. A revisit of a response that is not there, or whose
    digest or length its header states otherwise, is an error."""
    facts = records.select("page_id", "url", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"), "stated_digest", "stated_bytes")
    facts = stored(facts)
    revisits = facts.where("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("page"), F.col("stated_digest").alias("d")).distinct()
    first = facts.where("record_type = 'response'").select(F.col("page_id").alias("page"), F.col("digest").alias("d"), F.col("n").alias("found")).join(wanted, ["page", "d"], "left_semi")
    # stored, so that the join below has a shuffle of its own that can split a response with many revisits
    first = stored(first.distinct())
    met = revisits.join(first, (F.col("refers_to") == F.col("page")) & (F.col("stated_digest") == F.col("d")), "left")
    same = F.col("found") == F.col("stated_bytes")
    wrong = F.raise_error(F.concat(F.lit("no response that a revisit refers to: page "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))
    columns = ["page_id", "url", "record_type", "refers_to"]
    met = met.select(*columns, F.when(same, F.col("found")).otherwise(wrong.cast("long")).alias("payload_bytes"), F.col("d").alias("payload_digest"))
    own = facts.where("record_type = 'response'").select(*columns, F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    return own.unionByName(met)


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload, stated_digest, stated_bytes``: all pages
    written to archives in the shared folder and read back from them.

    Null html is an empty payload. Of pages with equal payloads of 100 bytes or more those with
    the smallest page_id are responses (all rows that repeat it), the others revisit it; a null
    page_id is never the smallest, and rows of null ids alone are responses. An empty table
    writes no archive and gives no rows; extra columns are left out."""
    return read(write(pages, shared_dir(pages.sparkSession) + "-archives"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
