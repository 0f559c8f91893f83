"""WARC archives: writing with Spark's text sink, reading with a Python data source (operator 4).

Archives are written uncompressed, so that a reader can seek over a payload it
does not want. ``spark.read.format("warc")`` plans its partitions over files,
takes filters on the record type and on header fields before any payload is
touched, parses each record's headers first and skips the block of a record that
the filters refuse or whose payload is not asked for.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, StringStartsWith)

from tidepanel.session import materialise, scratch_path

REVISIT_BYTES = 1000
#: Duplicated payloads up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_PAYLOADS = 100_000
#: Bytes of archives that one task reads, unless one file has more.
PARTITION_BYTES = 64 << 20
#: Header fields as columns.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
          "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
          "payload_length": "X-Payload-Length"}
SCHEMA = (", ".join(f"{name} string" for name in FIELDS)
          + ", content_length bigint, payload_bytes bigint, payload_sha1 string, payload binary")
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        super().__init__(0)
        self.paths = paths


class WarcSource(DataSource):
    """Options: path; payload = none (default), digest or full."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "none"))


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str) -> None:
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, IN and prefix conditions on header columns; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in FIELDS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((FIELDS[name], "in", (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((FIELDS[name], "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((FIELDS[name], "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files in groups of about PARTITION_BYTES; a file is read by one task."""
        store, root = _open(self.path)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True))
        names = [(f.path, f.size) for f in found if f.type == pafs.FileType.File
                 and f.size and not f.base_name.startswith(("_", "."))]
        groups: list[list[str]] = []
        room = 0
        for name, size in sorted(names):
            if size > room:
                groups.append([])
                room = PARTITION_BYTES
            groups[-1].append(name)
            room -= size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with io.BufferedReader(store.open_input_file(path), 1 << 18) as stream:
                for row in self.records(stream):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def records(self, stream: io.BufferedReader) -> Iterator[tuple]:
        while (line := stream.readline()):
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {stream.tell() - len(line)}")
            fields = _headers(stream)
            length = int(fields["content-length"])
            if not self.admits(fields):
                stream.seek(length, io.SEEK_CUR)
                continue
            size = sha1 = body = None
            if self.payload == "none":
                stream.seek(length, io.SEEK_CUR)
            else:
                block = stream.read(length)
                if len(block) != length:
                    raise EOFError("a WARC record ends early")
                start = 0
                if fields.get("content-type", "").startswith("application/http"):
                    start = block.index(b"\r\n\r\n") + 4
                view = memoryview(block)[start:]
                size, sha1 = len(view), hashlib.sha1(view).hexdigest()
                body = bytes(view) if self.payload == "full" else None
            yield (*[fields.get(name.lower()) for name in FIELDS.values()], length, size, sha1, body)

    def admits(self, fields: dict[str, str]) -> bool:
        for name, how, values in self.wanted:
            value = fields.get(name.lower())
            if value is None or not (value in values if how == "in" else value.startswith(values)):
                return False
        return True


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if ":/" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _headers(stream: io.BufferedReader) -> dict[str, str]:
    fields: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * len(FIELDS) + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [*FIELDS, "content_length", "payload_bytes", "payload_sha1", "payload"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_warc(spark: SparkSession, path: str, payload: str = "none") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def duplicated_payloads(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Digests of payloads of at least ``least`` bytes that several pages have, with the largest page_id."""
    body = F.coalesce(F.col("html"), F.lit(""))
    return (pages.where(F.octet_length(body) >= least)
            .groupBy(F.sha1(body.cast("binary")).alias("dup_digest"))
            .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
            .where("n > 1 AND keeper IS NOT NULL").drop("n"))


def write_warc(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """A record per row of (page_id, url, html); payloads equal to an earlier keeper's become revisits.

    Of equal payloads of at least ``least`` bytes the one with the largest
    page_id is a response and the others revisit it; rows that share that
    page_id are responses all (repeated rows), and so are equal payloads without
    any page_id. A null html is an empty payload, a null url gets ``urn:none``.
    Only digests are grouped, with a map-side maximum, so a payload that a third
    of all pages share stays a sum; pages themselves are not shuffled while the
    duplicated digests are few enough to send out.
    """
    few = materialise(duplicated_payloads(pages, least), "payloads")
    if few.count() <= BROADCAST_PAYLOADS:
        few = F.broadcast(few)
    rows = pages.select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\r\n]+", "%0A").alias("url"),
        F.coalesce("html", F.lit("")).alias("body"))
    rows = rows.withColumn("size", F.octet_length("body")).withColumn(
        "digest", F.sha1(F.col("body").cast("binary")))
    rows = rows.join(few, (F.col("digest") == F.col("dup_digest")) & (F.col("size") >= least), "left")
    revisit = F.coalesce(F.col("keeper") != F.col("page_id"), F.col("keeper").isNotNull())
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _record_id(F.col("keeper")),
                                 F.lit(f"\r\nWARC-Profile: {_REVISIT_PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    (rows.withColumn("block", block).select(F.concat(head, "block").alias("value"))
     .write.option("lineSep", "\r\n\r\n").text(path))


def _page(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the archives.

    Responses are read with their payload, whose size and SHA-1 are taken anew;
    revisits hold none, so theirs come from the header, and all payloads are
    skipped in that pass.
    """
    full = read_warc(spark, path, "digest").where("record_type = 'response'").select(
        _page(F.col("record_id")).alias("page_id"), "payload_bytes",
        F.col("payload_sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, "none").where("record_type = 'revisit'").select(
        _page(F.col("record_id")).alias("page_id"), F.col("payload_length").cast("long").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type",
        _page(F.col("refers_to")).alias("refers_to"))
    return full.unionByName(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages through archives in the shared folder and back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return archived_pages(pages.sparkSession, path)


#: The records of the archives in DuckDB, from the table itself.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND coalesce(keeper <> page_id, keeper IS NOT NULL)
       THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND coalesce(keeper <> page_id, keeper IS NOT NULL)
       THEN keeper END AS refers_to
FROM k
"""
