"""WARC archives with revisit resolution.

Rows get a key and are saved once, in buckets of the partition they lie in. Headers alone (digest, page_id, key) are
shuffled by payload digest to find each digest's original response; the others become revisit records that name it and
hold no payload. What is found goes back to the saved rows by key: the few columns of it are dealt to the buckets, and
payloads stay where they are. Archives are text files of records that Spark's writer commits task by task, so a lost
executor leaves no half-written archive; they are read back as a stream of pieces, one record in memory at a time, and
cut by the records' own lengths.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_keyed, new_path, save, scratch, staged, tidied

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload an archive holds, on average at most, and its records, at most; one file is read by one task.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 128 << 20, 50_000
#: Stands for a null page_id.
LAST = 2**63 - 1


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from 20 bits of the hexadecimal digest at a time; the lambda binds the digest once."""

    def letters(digest: Column) -> Column:
        out = []
        for i in range(8):
            number = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
            out += [F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
        return F.concat(*out)

    return F.transform(F.array(F.sha1(data)), letters)[0]


def record_urn(key: Column) -> Column:
    """urn:uuid of the record key's hash."""
    h = F.md5(key)
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """For each digest of two records or more of at least ``least_bytes``: their number n and the original, the record of smallest page_id (then key).

    headers: payload_digest, payload_bytes, page_id, key. Counting and choosing need one row per digest and task, so a
    digest that a third of the records share is reduced before it is shuffled.
    """
    first = F.min(F.struct(F.col("page_id"), F.col("key")))
    return headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(first.alias("original"), F.count("*").alias("n")).where("n > 1")


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest and payload_bytes per row of ``pages``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(LAST)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    return rows.withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))


def with_originals(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Staged ``rows`` with the original of every revisit (page_id and key), null for responses; payloads are not shuffled."""
    headers = rows.select("payload_digest", "payload_bytes", "page_id", "part", "key")
    found = save(resolve_revisits(headers, least_bytes), "warc-originals")
    revisits = join_keyed(headers.select("payload_digest", "part", "key"), found, ["payload_digest"], headers.count())
    revisits = save(revisits.where(F.col("original.key") != F.col("key")).select("part", "key", "original"), "warc-revisits")
    return rows.join(revisits.hint("shuffle_hash"), ["part", "key"], "left")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html), payloads in UTF-8; null html is an empty payload.

    A revisit record refers to the original's id and target. Repeated rows are records of their own: of equal page_ids
    the first as saved is taken as the smaller. A null page_id counts as the largest.
    """
    name = lambda page, key: record_urn(F.concat_ws(":", page, key))
    revisit = F.col("original").isNotNull()
    own, other = name(F.col("page_id"), F.col("key")), name(F.col("original.page_id"), F.col("original.key"))
    number = lambda c: F.when(c == LAST, "").otherwise(c.cast("string"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    safe = F.regexp_replace("url", r"[\r\n]", " ")
    refers = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", other), line("WARC-Refers-To-Page-ID", number(F.col("original.page_id"))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", own), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", safe), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("WARC-Page-ID", number(F.col("page_id"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")), F.when(revisit, refers).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    with scratch(pages.sparkSession), staged(with_digests(pages)) as rows:
        average = rows.agg(F.avg("payload_bytes")).first()[0] or 1.0
        most = max(1, min(ARCHIVE_RECORDS, int(archive_bytes / max(average, 1.0))))
        records = with_originals(rows, least_bytes).select(F.concat(head, block).alias("value"))
        # a record ends with two line ends: the writer's line separator
        records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def cut_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, HTTP head and payload of each record of archives that come in pieces, cut at every empty line."""
    pieces, end = iter(pieces), b"\r\n\r\n"
    held = bytearray()
    for piece in pieces:
        held += piece + end
        while held.startswith(b"\r\n"):  # of a payload that ends with line ends, after the last record of a file
            del held[:2]
        if not held:
            continue
        at = held.index(end)
        headers = dict(x.split(": ", 1) for x in held[:at].decode("utf-8", "replace").split("\r\n")[1:])
        upto = at + 4 + int(headers["Content-Length"])
        if len(held) < upto + 4:
            parts, missing = [], upto + 4 - len(held)
            while missing > 0:
                parts += (next(pieces), end)
                missing -= len(parts[-2]) + 4
            held += b"".join(parts)
        http, _, payload = bytes(held[at + 4 : upto]).partition(end)
        yield headers, http, payload
        del held[: upto + 4]


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string"
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """READ columns per record (and payload, null for revisits, if ``payloads``). The digest and the size of a response are
    computed from its payload, those of a revisit come from its headers."""
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payloads

    def row(h: dict[str, str], payload: bytes) -> tuple:
        full = h["WARC-Type"] == "response"
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else h["WARC-Payload-Digest"].removeprefix("sha1:")
        number = lambda k: int(h[k]) if h.get(k, "").strip() else None
        size = len(payload) if full else int(h["WARC-Payload-Length"])
        return number("WARC-Page-ID"), h["WARC-Target-URI"], size, digest, h["WARC-Type"], number("WARC-Refers-To-Page-ID"), h["WARC-Record-ID"], h.get("WARC-Refers-To"), payload if full else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))[: len(names)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=False)], names=names)

        rows, held = [], 0
        for h, _, payload in cut_records(x.as_py() for batch in batches for x in batch.column(0)):
            rows.append(row(h, payload))
            held += len(payload) if payloads else 0
            if len(rows) >= 1_000 or held >= 32 << 20:
                yield give(rows)
                rows, held = [], 0
        if rows:
            yield give(rows)

    # a compressed file is read whole by one task and in order, and ends with a record's end
    pieces = spark.read.option("lineSep", "\r\n\r\n").option("pathGlobFilter", "*.txt.gz").schema("value string").text(path)
    return pieces.select(F.col("value").cast("binary")).mapInArrow(tidied(run), READ + ", payload binary" * payloads)


def with_payloads(records: DataFrame) -> DataFrame:
    """Joins revisit records to their original responses: every record with its full payload."""
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("payload").alias("__full"))
    return records.join(originals, "refers_to_record", "left").withColumn("payload", F.coalesce("payload", "__full")).drop("__full")


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as deduplicated archives in the shared folder and reads them back: READ columns per page."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
