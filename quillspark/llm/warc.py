"""WARC archives: writing, reading back and revisit resolution.

Records are written by Spark's text sink (the record separator is its line
separator) and read as whole binary files, so both sides use only Spark's own
file systems. Deduplication reads every archive's headers once into a table,
shuffles them by payload digest to decide which record stays the response, and
writes fresh archives in which all others are revisits; resolution joins the
revisits to their originals. Payloads are never shuffled.

Records of like size share a folder, so a bound on records bounds a file's bytes.
"""

import base64
import gzip
import hashlib
import io
import json
import re
import zlib
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import BROADCAST_BYTES, small, table, text_or_empty

#: Bytes of records in one archive file on average. A reader holds one file, which has
#: at most four times as many bytes, or one record.
ARCHIVE_BYTES = 16 << 20
#: Largest payload of the first folder; each further one holds payloads up to four times as large.
SMALL_BYTES = 16 << 10
#: Bytes of payloads that a reader hands on at once.
BATCH_BYTES = 8 << 20
HEADER_BYTES = 600
PAGE_ID = re.compile(r"-?[0-9]{1,18}")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Record types that a crawl may hold besides those that are read.
OTHER_TYPES = {"warcinfo", "request", "metadata", "resource", "conversion", "continuation"}
HTTP_TYPE = "application/http; msgtype=response"
HEADS = "folder string, record_id string, record_type string, page_id long, uri string, date string, payload_digest string, payload_bytes long, refers_to_id string, refers_to_uri string, refers_to_date string"
RECORD = HEADS + ", content_type string, http_head binary, payload binary"
UNREADABLE = "file string, at long, reason string, header string"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1: 160 bits are 8 groups of 20, each 4 letters."""
    digest = F.sha1(data)
    group = lambda i: F.conv(F.substring(digest, i * 5 + 1, 5), 16, 10).cast("int")
    letter = lambda n, shift: F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(group(i), shift) for i in range(8) for shift in (15, 10, 5, 0)])


def _record(record_id: Column, page_id: Column, uri: Column, date: Column, digest: Column, payload: Column, original: Column | None = None,
            http_head: Column | None = None, content_type: Column | None = None) -> Column:
    """A record as text (of whatever bytes); ``original`` (id, uri, date) makes it a
    revisit where it is not null."""
    reply = F.lit(HTTP_HEAD) if http_head is None else http_head.cast("string")
    media = F.lit(HTTP_TYPE) if content_type is None else content_type
    size = F.octet_length(payload) + F.octet_length(reply)
    block = F.concat(reply, payload)
    revisit = ()
    kind = F.lit("response")
    if original is not None:
        again = original.isNotNull()
        kind = F.when(again, "revisit").otherwise("response")
        size, block = F.when(again, F.octet_length(reply)).otherwise(size), F.when(again, reply).otherwise(block)
        revisit = (
            F.when(again, f"WARC-Profile: {PROFILE}"),
            F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), original["id"], F.lit(">"))),
            F.when(again, F.concat(F.lit("WARC-Refers-To-Target-URI: "), original["uri"])),
            F.when(again, F.concat(F.lit("WARC-Refers-To-Date: "), original["date"])),
        )
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), record_id, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("X-Page-Id: "), page_id.cast("string")),
        *revisit,
        F.concat(F.lit("Content-Type: "), media),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    )
    return F.concat(head, F.lit("\r\n\r\n"), block)


def _write(values: DataFrame, records: int, total: int, largest: int, path: str) -> None:
    """Archives from rows of ``value``, written where the rows are. A file is closed
    after as many records as make ARCHIVE_BYTES on average; the ``largest`` payload
    bounds what an unlucky run of records can make of that."""
    bound = 4 * ARCHIVE_BYTES // (largest + HEADER_BYTES)
    each = max(1, min(bound, ARCHIVE_BYTES * records // (total + HEADER_BYTES * records + 1)))
    values.select("value").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", each).text(path)


def write_archive(pages: DataFrame, path: str, date: str | None = None) -> None:
    """One response record per row of ``pages`` (page_id, url, html).

    Null html is an empty payload, a null url an empty target; white space in a
    url is percent-encoded so that it stays on its header line. Record ids are
    drawn anew at each writing; ``date`` is the time of capture (now, if not given).
    Repeated rows are a record each; other columns are ignored; an empty table
    gives an archive without records.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    uri = F.regexp_replace(F.regexp_replace(text_or_empty("url"), r"[\r\n\t\x0B\x0C\x00]", "%0A"), " ", "%20")
    rows = pages.select("page_id", uri.alias("uri"), text_or_empty("html").alias("payload"))
    size = F.octet_length("payload").cast("long")
    kind = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / SMALL_BYTES) / 2)).cast("int")
    found = rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.max(size).alias("largest")).collect()
    for k, n, total, largest in found or [(0, 0, 0, 0)]:
        value = _record(F.expr("uuid()"), F.col("page_id"), F.col("uri"), F.lit(date), base32_sha1(F.col("payload")), F.col("payload"))
        _write((rows if len(found) < 2 else rows.filter(kind == k)).select(value.alias("value")), n, total, largest, f"{path}/size-{k}")


def _lines(text: bytes) -> str:
    try:
        return text.decode("utf-8")
    except UnicodeDecodeError:
        return text.decode("latin-1")


def parse_archive(data: bytes):
    """(offset, headers with lower-case names, block, fault) of every record, read one
    after the other; of an archive in gzip members only the record at hand is unpacked.

    A record without a readable Content-Length, or cut off by the end of the file, has
    a fault and no block. Reading goes on at the next line that begins a record; a
    gzip stream that breaks ends the file with a fault.
    """
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    at = 0
    try:
        line = stream.readline()
        while line:
            if not line.startswith(b"WARC/"):
                at += len(line)
                line = stream.readline()
                continue
            start, head = at, {}
            at += len(line)
            while (line := stream.readline()) and line.strip():
                at += len(line)
                name, _, value = line.partition(b":")
                head.setdefault(_lines(name).strip().lower(), _lines(value).strip())
            at += len(line)
            size = head.get("content-length", "")
            if not (size.isascii() and size.isdigit()):
                yield start, head, None, "no readable Content-Length"
            else:
                block = stream.read(int(size))
                at += len(block)
                yield start, head, (block if len(block) == int(size) else None), (None if len(block) == int(size) else "cut off by the end of the file")
            line = stream.readline()
    except (OSError, EOFError, zlib.error) as e:
        yield at, {}, None, f"broken gzip stream: {type(e).__name__}"


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_archive(spark, path: str, payloads: bool = True) -> DataFrame:
    """A row per response and revisit record below ``path``; other records are left out,
    and so are those that cannot be read (:func:`unreadable_records` has them).

    Size of a response is that of the payload read, bytes of whatever charset; what
    is no HTTP message is payload as a whole. With ``payloads`` rows have the payload
    and the digest that the header states; without, the digest is computed from the
    payload. Revisits have the digest of their header and no payload. A record without
    an id gets one from its place. ``folder`` is where the record's file stands.
    """
    ddl = RECORD if payloads else HEADS
    names = [c.split()[0] for c in ddl.split(", ")]

    def frame(rows):
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    def parse(batches):
        bare = lambda x: x and x.removeprefix("<urn:uuid:").removesuffix(">")
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                rows, held, folder = [], 0, file.rsplit("/", 1)[0]
                for at, head, block, fault in parse_archive(data):
                    kind = head.get("warc-type")
                    if fault or kind not in ("response", "revisit"):
                        continue
                    cut = block.find(b"\r\n\r\n") + 4 if block[:5] == b"HTTP/" else 0
                    cut = 0 if cut == 3 else cut
                    payload = block[cut:] if kind == "response" else None
                    stated = head.get("warc-payload-digest", "").partition(":")[2]
                    digest = stated if payload is None or (payloads and stated) else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    page = head.get("x-page-id", "")
                    own = bare(head.get("warc-record-id")) or hashlib.md5(f"{file} {at}".encode()).hexdigest()
                    row = (folder, own, kind, int(page) if PAGE_ID.fullmatch(page) else None, head.get("warc-target-uri", ""), head.get("warc-date"), digest, None if payload is None else len(payload),
                           bare(head.get("warc-refers-to")), head.get("warc-refers-to-target-uri"), head.get("warc-refers-to-date"))
                    rows.append((*row, head.get("content-type", HTTP_TYPE), block[:cut] if kind == "response" else block, payload) if payloads else row)
                    held += len(payload or b"") if payloads else 1
                    if held >= BATCH_BYTES or len(rows) >= 2000:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return _files(spark, path).mapInPandas(parse, ddl)


def unreadable_records(spark, path: str) -> DataFrame:
    """(file, at, reason, header as JSON) of every record below ``path`` that cannot be
    read, or whose type no archive has; ``at`` counts unpacked bytes."""

    def parse(batches):
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                rows = []
                for at, head, _, fault in parse_archive(data):
                    kind = head.get("warc-type")
                    if fault or kind not in OTHER_TYPES | {"response", "revisit"}:
                        rows.append((file, at, fault or f"type {kind!r}", json.dumps(head)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in UNREADABLE.split(", ")])

    return _files(spark, path).mapInPandas(parse, UNREADABLE)


def sized(written: DataFrame) -> DataFrame:
    """``written`` with a broadcast hint if its rows, URIs and all, are small together."""
    size = written.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*written.columns)))), F.lit(0))).first()[0]
    return F.broadcast(written) if size <= BROADCAST_BYTES else written


def deduplicate_archive(spark, source: str, target: str, min_bytes: int = 0) -> None:
    """Write the records of ``source`` anew, each payload of at least ``min_bytes``
    once: the record with the largest page_id (then record id; null ids last)
    stays a response, the others revisit it. Revisits of the source keep their
    original, or what that revisits now. All records get new ids."""
    heads = materialize(read_archive(spark, source, payloads=False), "warc-heads")
    best = materialize(heads.filter((F.col("payload_bytes") >= min_bytes) & (F.col("record_type") == "response")).groupBy("payload_digest", "payload_bytes").agg(
        F.max(F.struct("page_id", "record_id", "uri", "date")).alias("best"), F.count("*").alias("n")
    ).filter("n > 1").select("payload_digest", "payload_bytes", "best"), "warc-best")
    fresh = lambda c: F.regexp_replace(F.md5(F.concat_ws(" ", c, F.lit(target))), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    again = heads.filter("record_type = 'response'").join(sized(best), ["payload_digest", "payload_bytes"]).filter(F.col("record_id") != F.col("best.record_id")).select(
        F.col("record_id").alias("_id"), F.col("best.record_id").alias("to"), F.struct(fresh(F.col("best.record_id")).alias("id"), F.col("best.uri").alias("uri"), F.col("best.date").alias("date")).alias("original"))
    again = materialize(again, "warc-revisits")
    folders = heads.groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.coalesce("payload_bytes", F.lit(0))).alias("total"), F.coalesce(F.max("payload_bytes"), F.lit(0)).alias("largest"), F.count_if(F.col("record_type") == "revisit").alias("old")).collect()
    if any(f["old"] for f in folders):
        moved = again.select(F.col("_id").alias("refers_to_id"), "original")
        kept = F.struct(fresh(F.col("refers_to_id")).alias("id"), F.col("refers_to_uri").alias("uri"), F.col("refers_to_date").alias("date"))
        again = again.select("_id", "original").unionByName(heads.filter("record_type = 'revisit'").join(moved, "refers_to_id", "left").select(
            F.col("record_id").alias("_id"), F.coalesce("original", kept).alias("original")))
        again = materialize(again, "warc-revisits")
    for folder, n, total, largest, _ in folders or [(None, 0, 0, 0, 0)]:
        rows = read_archive(spark, folder or source).join(sized(again.select("_id", "original")), F.col("record_id") == F.col("_id"), "left")
        value = _record(fresh(F.col("record_id")), F.col("page_id"), F.col("uri"), F.col("date"), F.col("payload_digest"), F.coalesce(F.col("payload").cast("string"), F.lit("")), F.col("original"),
                        F.col("http_head"), F.col("content_type"))
        _write(rows.select(value.alias("value")), n, total, largest, f"{target}/{folder.rsplit('/', 1)[1] if folder else 'size-0'}")


def resolve_revisits(spark, path: str) -> DataFrame:
    """Every record with its full payload's size and digest and, for revisits,
    ``refers_to``: the page_id of the response that holds the payload."""
    heads = materialize(read_archive(spark, path, payloads=False), "warc-resolved")
    asked = heads.filter("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct()
    originals = materialize(heads.filter("record_type = 'response'").join(asked, "record_id", "left_semi").select(
        F.col("record_id").alias("_o"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes")), "warc-originals")
    return heads.join(small(originals, 100), F.col("refers_to_id") == F.col("_o"), "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "record_id", "uri"
    )


def op7_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Writes ``pages`` as an archive, deduplicates it and resolves what it reads
    back: one row per row of ``pages``. Null html is the empty payload; rows
    that repeat, and null page_ids, are records of their own."""
    crawl, fresh = scratch_path(spark, "warc-crawl"), scratch_path(spark, "warc-dedup")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), crawl)
    deduplicate_archive(spark, crawl, fresh, min_bytes=0)
    return resolve_revisits(spark, fresh).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Page ids of ``pages`` are unique: the largest of each payload is its response.
OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
t AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5) AS INT)) AS groups FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((groups[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM t WINDOW w AS (PARTITION BY hex)
"""
