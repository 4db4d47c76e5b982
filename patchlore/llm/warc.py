"""WARC archives as a Spark data source (operator 11).

Format ``warc`` writes and reads archives (WARC 1.1, plain or one gzip member a
record). ``DataFrame.write`` sends one record per row: each task fills files of
about ``FILE_BYTES`` under names no other attempt has, and the commit lists the
files of successful tasks in a manifest, so that drafts of lost tasks are never
read. ``spark.read`` plans partitions from the manifest (or from the
folder, for archives made elsewhere), several small files in one; a file is read
by one task. Headers are parsed first. Predicates on the header columns
are pushed down and decided on the header alone; the block of a record that fails them, and
of every record if the asked schema has no ``payload``, is passed over: by a seek
in plain files, without decoding in compressed ones.

Columns (a reader's schema may name any of them):
  record_type, record_id, target_uri, date, refers_to, payload_digest string
      (header fields; the digest as lower-case hex, stored in base 32)
  content_length long      bytes of the record's block
  payload_bytes long       bytes of the whole payload, from the HTTP header of the
                           block (revisits carry this header alone)
  payload binary           what follows the HTTP header in responses; the block of
                           other records; null for revisits
Transfer and content encodings inside a payload are left as they are.

``deduplicated`` makes records of pages: of equal payloads of at least
``MIN_BYTES`` the page with the largest id is the response, the others revisit it.

Defined results: a null html is the empty payload; null ids and urls are left
out of the header and come back as null; control characters and outer blanks of a url are percent-encoded
in the header, which then carries the url itself in base 64; rows tied for the largest
id of equal payloads are all responses; null ids are less than others; an empty
table writes an empty archive; further columns are ignored; a record
cut off by the end of its file or without a valid length raises an error.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
                                    WriterCommitMessage)
from pyspark.sql.types import StructType

from patchlore.llm.registry import query, ship, table
from patchlore.session import cut, new_path

MIN_BYTES = 1000
FILE_BYTES = 32 << 20     # a writing task begins a new file beyond this
SPLIT_BYTES = 64 << 20    # files read by one task, unless a single one is larger
BATCH_BYTES = 8 << 20
BATCH_ROWS = 5000
MANIFEST = "_manifest.jsonl"
SCHEMA = ("record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
          "content_length long, payload_bytes long, payload binary")
IN_HEADER = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "content_length")
# Names and media types of the WARC 1.1 format.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http; msgtype=response"
EXACT_URI = "X-Exact-Target-URI-Base64"
OUTER = re.compile(r"[\x00-\x1f\x7f]|^ +| +$")


def header_bytes(first: str, fields: list[tuple[str, str]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record_bytes(row: dict[str, Any], date: str) -> bytes:
    """One record: response or revisit with an HTTP header, any other type with its payload as the block."""
    kind, payload = row["record_type"], row["payload"] or b""
    fields = [("WARC-Type", kind)]
    if row["record_id"] is not None:
        fields.append(("WARC-Record-ID", f"<{row['record_id']}>"))
    fields.append(("WARC-Date", row["date"] or date))
    uri = row["target_uri"]
    if uri is not None:
        plain = OUTER.sub(lambda m: "".join(f"%{ord(c):02X}" for c in m.group()), uri)
        fields.append(("WARC-Target-URI", plain))
        if plain != uri:
            fields.append((EXACT_URI, base64.b64encode(uri.encode()).decode()))
    if row["refers_to"] is not None:
        fields.append(("WARC-Refers-To", f"<{row['refers_to']}>"))
    if kind == "revisit":
        fields.append(("WARC-Profile", REVISIT_PROFILE))
    if row["payload_digest"] is not None:
        fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()))
    block = payload
    if kind in ("response", "revisit"):
        size = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
        block = header_bytes("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))]) + (payload if kind == "response" else b"")
        fields.append(("Content-Type", HTTP_RESPONSE))
    fields.append(("Content-Length", str(len(block))))
    return header_bytes("WARC/1.1", fields) + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]   # name, bytes, records


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, compressed: bool, overwrite: bool):
        self.folder, self.names, self.compressed, self.overwrite = folder, schema.fieldNames(), compressed, overwrite
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.folder)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, records = None, "", 0, 0
        known = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload")

        def put(data: bytes) -> None:
            nonlocal size
            data = gzip.compress(data, 6) if self.compressed else data
            out.write(data)
            size += len(data)

        for batch in iterator:
            cols = {c: batch.column(self.names.index(c)) if c in self.names else None for c in known}
            for i in range(batch.num_rows):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.compressed else "")
                    out, size, records = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    info = b"software: patchlore\r\nformat: WARC File Format 1.1\r\n"
                    put(header_bytes("WARC/1.1", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", name),
                                                  ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n")
                put(record_bytes({c: None if v is None else v[i].as_py() for c, v in cols.items()}, self.date))
                records += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, records))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.folder)
        store.create_dir(base, recursive=True)
        old: list[dict] = [] if self.overwrite else manifest(store, base) or []
        new = [{"name": n, "bytes": b, "records": r} for m in messages if m is not None for n, b, r in m.files]
        with store.open_output_stream(f"{base}/{MANIFEST}") as f:
            for line in old + new:
                f.write((json.dumps(line) + "\n").encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            for name, _, _ in m.files if m is not None else ():
                store.delete_file(f"{base}/{name}")


def manifest(store: fs.FileSystem, base: str) -> list[dict] | None:
    if store.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{base}/{MANIFEST}") as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def archive_files(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives of a folder, or of the one file that ``folder`` names."""
    store, base = fs.FileSystem.from_uri(folder)
    if store.get_file_info(base).type == fs.FileType.File:
        return [(base, store.get_file_info(base).size)]
    listed = manifest(store, base)
    if listed is not None:
        return [(f"{base}/{x['name']}", x["bytes"]) for x in listed]
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz")))


@dataclass
class Files(InputPartition):
    paths: list[str]


TESTS = {
    EqualTo: lambda v, w: v is not None and v == w,
    EqualNullSafe: lambda v, w: v == w,
    In: lambda v, w: v is not None and v in w,
    GreaterThan: lambda v, w: v is not None and v > w,
    GreaterThanOrEqual: lambda v, w: v is not None and v >= w,
    LessThan: lambda v, w: v is not None and v < w,
    LessThanOrEqual: lambda v, w: v is not None and v <= w,
    StringStartsWith: lambda v, w: v is not None and v.startswith(w),
    StringEndsWith: lambda v, w: v is not None and v.endswith(w),
    StringContains: lambda v, w: v is not None and w in v,
}


def decidable(f: Filter) -> bool:
    """Can the header alone decide this predicate?"""
    if isinstance(f, Not):
        return decidable(f.child) and not isinstance(f.child, Not)
    return isinstance(f, (*TESTS, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in IN_HEADER


def holds(f: Filter, row: dict[str, Any]) -> bool:
    if isinstance(f, Not):  # a comparison with null is unknown, and so is its negation
        return holds(f.child, row) is False and (row[f.child.attribute[0]] is not None or isinstance(f.child, (IsNull, IsNotNull, EqualNullSafe)))
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    return TESTS[type(f)](value, f.value)


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema, self.filters = folder, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if decidable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        groups, room = [Files([])], SPLIT_BYTES
        for path, size in archive_files(self.folder):
            if groups[-1].paths and size > room:
                groups.append(Files([]))
                room = SPLIT_BYTES
            groups[-1].paths.append(path)
            room -= size
        return groups

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        names = self.schema.fieldNames()
        kinds = {"content_length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        held: dict[str, list] = {c: [] for c in names}
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[c], kinds.get(c, pa.string())) for c in names], names=names)

        for path in partition.paths:
            with store.open_input_file(path) as raw:
                for row in read_records(io.BufferedReader(raw, 1 << 16), path.endswith(".gz"), "payload" in names, "payload_bytes" in names, self.filters):
                    for c in names:
                        held[c].append(row[c])
                    size += 200 + len(row.get("payload") or b"")
                    if size > BATCH_BYTES or len(held[names[0]] if names else ()) >= BATCH_ROWS:
                        yield batch()
                        held, size = {c: [] for c in names}, 0
        yield batch()


def read_header(stream: BinaryIO, at_start: bool) -> tuple[str, dict[str, str]] | None:
    """First line and fields of a header (names in lower case), None at the end of the file; folded lines are joined."""
    line = stream.readline()
    while at_start and line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    first, fields, last = line.decode("utf-8", "replace").strip(), {}, None
    while (line := stream.readline()).strip(b"\r\n"):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and last is not None:
            fields[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip(" \t")
    if not line:
        raise EOFError("a header is cut off")
    return first, fields


def hex_digest(value: str | None) -> str | None:
    """Lower-case hex of ``sha1:`` and base 32 or hex; anything else as it stands."""
    kind, _, digest = (value or "").partition(":")
    if kind.lower() == "sha1" and len(digest) == 32:
        return base64.b32decode(digest.upper()).hex()
    return digest.lower() if kind.lower() == "sha1" and len(digest) == 40 else value


def read_records(stream: BinaryIO, compressed: bool, wants_payload: bool, wants_size: bool, filters: list[Filter]) -> Iterator[dict[str, Any]]:
    """Rows of one archive whose headers satisfy the filters."""
    source: Any = gzip.GzipFile(fileobj=stream) if compressed else stream
    size = None if compressed else stream.seek(0, io.SEEK_END)
    source.seek(0)
    while (head := read_header(source, True)) is not None:
        first, fields = head
        if not first.startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError(f"no WARC record: {first[:80]!r}")
        row: dict[str, Any] = {c: fields.get(n.lower()) for c, n in FIELDS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].removeprefix("<").removesuffix(">") if row[c] is not None else None
        if EXACT_URI.lower() in fields:
            row["target_uri"] = base64.b64decode(fields[EXACT_URI.lower()]).decode()
        row["payload_digest"] = hex_digest(fields.get("warc-payload-digest"))
        row["content_length"] = left = int(fields["content-length"])
        if size is not None and source.tell() + left > size:
            raise EOFError(f"record {row['record_id']} is cut off")
        end = source.tell() + left
        if all(holds(f, row) for f in filters):
            if wants_payload or wants_size:
                row["payload_bytes"], row["payload"] = None, None
                if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
                    http = read_header(source, False)
                    told = (http[1] if http else {}).get("content-length", "")
                    rest = end - source.tell()
                    row["payload_bytes"] = int(told) if told.isdigit() else None if row["record_type"] == "revisit" else rest
                else:
                    rest, row["payload_bytes"] = left, left
                if wants_payload and row["record_type"] != "revisit":
                    row["payload"] = source.read(rest)
                    if len(row["payload"]) < rest:
                        raise EOFError(f"record {row['record_id']} is cut off")
            yield row
        source.seek(end)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``; option ``compression`` is none or gzip."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema, self.options.get("compression", "none") == "gzip", overwrite)


def register(spark: SparkSession) -> None:
    """Make format ``warc`` known to a session, with pushed predicates."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archives(spark: SparkSession, folder: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Records of the archives in ``folder``, all columns or only those named.

    Spark keeps a Python reader with the predicates last pushed to it and asks
    anew only if a query has any; the first filter, true for every record, sees
    to that, so that one table can be queried by different predicates.
    """
    register(spark)
    asked = [c.split()[0] for c in SCHEMA.split(", ") if columns is None or c.split()[0] in columns]
    schema = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in (*asked, "content_length"))
    return spark.read.format("warc").schema(schema).load(folder).filter("content_length >= 0").select(*asked)


def write_archives(records: DataFrame, folder: str, compression: str = "none") -> None:
    register(records.sparkSession)
    records.write.format("warc").option("compression", compression).mode("append").save(folder)


def deduplicated(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """One record per page: (record_type, record_id, target_uri, refers_to, payload_digest, payload_bytes, payload).

    Only digests are grouped; those that occur more than once are a written
    table, which Spark broadcasts or not by its size. Short payloads have keys of
    their own, so that many equal ones do not meet in one task; a long payload
    with very many copies is left to the adaptive split of skewed joins.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    marked = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("target_uri"), F.sha1(body).alias("payload_digest"),
                          F.octet_length(body).cast("long").alias("payload_bytes"), body.alias("payload"))
    long_ = F.col("payload_bytes") >= min_bytes
    copies = marked.filter(long_).groupBy("payload_digest").agg(F.max("page").alias("head"), F.count("*").alias("n")).filter("n > 1")
    heads = cut(copies.select(F.col("payload_digest").alias("key"), "head"), "copied")
    key = F.when(long_, F.col("payload_digest")).otherwise(F.concat("payload_digest", F.lit("-"), F.xxhash64("page", "target_uri").cast("string")))
    met = marked.withColumn("key", key).join(heads, "key", "left")
    response = F.col("head").isNull() | F.col("head").eqNullSafe(F.col("page"))

    def urn(column: str):
        return F.concat(F.lit("urn:page:"), F.col(column).cast("string"))

    return met.select(F.when(response, "response").otherwise("revisit").alias("record_type"), urn("page").alias("record_id"), "target_uri",
                      F.when(~response, urn("head")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(response, F.col("payload")).alias("payload"))


SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, CASE WHEN strlen(h) >= {MIN_BYTES} THEN max(page_id) OVER (PARTITION BY h) END AS head FROM p)
SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN head IS NULL OR head IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head IS DISTINCT FROM page_id THEN head END AS refers_to
FROM m
"""


@query("op11_warc", SQL)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payload, whose length and digest are taken anew; of revisits only the headers are read."""
    folder = new_path(spark, "warc")
    write_archives(deduplicated(table(spark, sf_dir, "pages")), folder)
    full = read_archives(spark, folder).filter(F.col("record_type") == "response")
    full = full.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    names = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes")
    again = read_archives(spark, folder, names).filter(F.col("record_type") == "revisit")

    def number(column: str):
        return F.regexp_extract(column, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")

    both = full.select(*names).unionByName(again.select(*names))
    return both.select(number("record_id").alias("page_id"), F.col("target_uri").alias("url"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
