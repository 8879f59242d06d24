"""WARC/1.1 archives: writing, reading and revisit resolution.

Spark's text writer, with the record separator as its line separator, writes WARC files to any store that Spark can
write to; a file is one gzip member. Responses hold an HTTP message, revisits its header only. Reading goes by
Content-Length, record by record. Resolving shuffles headers by payload digest, finds the original response of every digest
with a second record and joins it to the others; archives are then written with fresh headers, and without the payloads of
revisits.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize, new_path

ID = "urn:record:"
#: Records of up to ``SMALL`` bytes are written together, so many a file; larger ones apart, as many as fit into ``FILE_BYTES``.
SMALL, FILE_BYTES = 1 << 16, 1 << 27
#: Bytes that are inflated, and about as many of payload that are sent on, at once.
CHUNK = 1 << 22
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def resolve(records: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``records`` (id, url, payload) plus digest, n_bytes, record_type and refers_to.

    Records with equal payloads of ``least_bytes`` or more are revisits of the one with the smallest id. Null payloads are
    empty; a null id refers to others but no other refers to it, unless its digest has no other id. Rows that repeat the smallest id
    are all responses. Only (digest, id) is shuffled to find the originals. Their table is written before it is joined, so that Spark
    can send it to all tasks while it is small, and split a digest with very many records; records that are too short
    to have an original join by their own id, which spreads them.
    """
    full = records.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    full = full.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    headers = full.where(F.col("n_bytes") >= least_bytes).groupBy(F.col("digest").alias("same")).agg(F.min("id").alias("original"), F.count("*").alias("n"))
    originals = materialize(headers.where("n > 1").drop("n"), "originals")
    key = F.when(F.col("n_bytes") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("id:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    full = full.withColumn("key", key).join(originals, F.col("key") == F.col("same"), "left")
    again = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    full = full.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    return full.withColumn("refers_to", F.when(again, F.col("original"))).drop("key", "same", "original")


def write_warc(resolved: DataFrame, path: str, date: str | None = None) -> None:
    """Write ``resolved`` (see ``resolve``) as gzipped WARC files of at most ``FILE_BYTES`` or one record.

    Each record has fresh headers: its type, id, date (``date`` or now), target, length and payload digest, and for revisits the
    original they refer to. Ids are written URL-encoded; line breaks in urls are dropped, and an empty url is ``about:blank``. Rows that
    repeat an id share their record's id.
    """
    revisit = F.col("record_type") == "revisit"
    named = lambda c: F.concat(F.lit(f"<{ID}"), F.url_encode(F.col(c).cast("string")), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n\x00]", "")
    now = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.concat(F.lit(_HTTP), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(named("id"), F.lit(f"<{ID}>"))),
        F.concat(F.lit("WARC-Date: "), now),
        F.concat(F.lit("WARC-Target-URI: "), F.when(url == "", "about:blank").otherwise(url)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), named("refers_to"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    text = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block).alias("value")
    largest = resolved.agg(F.max("n_bytes")).first()[0] or 0
    parts = [(F.col("n_bytes") <= SMALL, FILE_BYTES // SMALL)]
    if largest > SMALL:
        parts.append((F.col("n_bytes") > SMALL, max(1, FILE_BYTES // largest)))
    for some, records_per_file in parts:
        writer = resolved.where(some).select(text).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
        writer.option("compression", "gzip").text(path)


class _Inflated:
    """The bytes of a gzip file of any number of members, as they are asked for."""

    def __init__(self, content: bytes):
        self.rest, self.at, self.held, self.member = content, 0, bytearray(), zlib.decompressobj(31)

    def fill(self) -> bool:
        """Inflate some more; False at the end."""
        if self.member.eof:
            if not (left := self.member.unused_data + self.rest[self.at :]):
                return False
            self.rest, self.at, self.member = left, 0, zlib.decompressobj(31)
        part = self.member.unconsumed_tail or self.rest[self.at : self.at + CHUNK]
        if not self.member.unconsumed_tail:
            self.at += len(part)
        more = self.member.decompress(part, CHUNK)
        self.held += more
        return bool(part or more)

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.fill():
            pass
        if len(self.held) < n:
            raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def head(self) -> dict[str, str] | None:
        """The next record's named fields; None at the end."""
        while (end := self.held.find(b"\r\n\r\n")) < 0 and self.fill():
            pass
        if not self.held:
            return None
        lines = self.take(end + 4).decode().split("\r\n") if end >= 0 else [""]
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        return dict(line.split(": ", 1) for line in lines[1:] if line)


_FIELDS = (("record_id", "string"), ("record_type", "string"), ("date", "string"), ("url", "string"), ("digest", "string"), ("refers", "string"), ("n_bytes", "long"), ("whole", "boolean"), ("payload", "string"))


def _parse(batches):
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in _FIELDS])
    for batch in batches:
        for content in batch.column(0):
            data, out, size = _Inflated(content.as_py()), [], 0
            while head := data.head():
                block = data.take(int(head["Content-Length"]))
                if data.take(4) != b"\r\n\r\n":
                    raise ValueError("a record does not end where its header says")
                http, _, payload = block.partition(b"\r\n\r\n")
                named = lambda key: unquote_plus(head[key][len(ID) + 1 : -1]) if key in head else None  # noqa: B023, E731
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                whole = head["WARC-Type"] == "revisit" or hashlib.sha256(payload).hexdigest() == digest
                said = int(http.rpartition(b": ")[2])
                out.append((named("WARC-Record-ID"), head["WARC-Type"], head["WARC-Date"], head["WARC-Target-URI"], digest, named("WARC-Refers-To"), said, whole, payload.decode()))
                size += len(payload)
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, date, url, digest, refers, n_bytes, whole, payload) of every record; one compressed file and about
    ``CHUNK`` bytes of records are in memory at a time.

    ``n_bytes`` is the payload's length as the HTTP header gives it, for revisits too; ``whole`` tells whether the payload has the
    digest that its header gives. A broken archive raises an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse, ", ".join(f"{name} {kind}" for name, kind in _FIELDS))


def archive_roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, path: str | None = None) -> DataFrame:
    """Write ``pages`` as deduplicated archives, read them back, and return (id, payload_bytes, payload_digest, record_type, refers_to).

    All of it is read from the records' own headers. Null html is empty, a null id stays null. An empty table gives an empty table; rows that
    repeat id and payload are records of their own, all of them responses if the id is the smallest. Other columns play no part.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    id_type = pages.schema[id_col].dataType
    write_warc(resolve(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("payload")), least_bytes), path)
    found = read_warc(spark, path)
    whole = F.when(F.col("whole"), True).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ in record "), F.col("record_id"))))
    page = lambda c: F.when(F.col(c) != "", F.col(c)).cast(id_type)
    return found.where(whole).select(page("record_id").alias(id_col), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page("refers").alias("refers_to"))
