"""WARC archives: written by Spark's text writer, read back by a reader that salvages damaged files.

Writing: records with equal payloads of at least ``min_bytes`` bytes become one response (that with the smallest key)
and revisits of it. Records are put together in the JVM, and each task writes its own files.

Reading: a record must have a version line, a header with a length, a whole block with its end mark and, if it
names a digest, a payload that fits it. Where a check fails, the reader goes on from the next place that starts a
sound record (a version line, or a gzip member), and reports the bytes between as a gap.

Defined cases: a null payload is an empty one; a null url is empty. Repeated rows are records of their own: all that have
the smallest key of their payload are responses. Records with a null key refer to the smallest key that is not null;
if there is none all are responses. An empty table gives no archive and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankloom.staging import stage, staging_path

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Digits of numbers in base 32, and the base32 alphabet in the same order.
DIGITS, ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 32 << 20
# Pages beyond this many times the mean size are long.
LONG = 4


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string in base32: every 5 hex digits are 4 letters."""
    digest = F.sha1(payload.cast("binary"))
    quarters = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quarters), DIGITS, ALPHABET)


def record_text(key: Column, url: Column, payload: Column, n_bytes: Column, digest: Column, refers_to: Column) -> Column:
    """A whole record but for its end mark; ``refers_to`` is null for a response."""
    is_revisit = refers_to.isNotNull()
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " ")
    name = lambda k: F.concat(F.lit("<urn:page:"), F.coalesce(k, F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    n_bytes.cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(is_revisit, 0).otherwise(n_bytes)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(key), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), clean,
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(refers_to),
                                    F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nContent-Length: "), length.cast("string"), F.lit(END), http,
        F.when(is_revisit, "").otherwise(payload))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url_column: str = "url",
                   payload_column: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> str:
    """Write a record per row below ``path``, in files of about ``file_bytes``: no file has more than ``LONG`` times that, or
    one page that is longer.

    Payloads are not shuffled as long as the list of revisits is small enough for Spark to broadcast it by its size;
    a larger one is joined by key.
    """
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url_column).alias("url"), payload.alias("payload"))
    sums = stage(rows.select("key", base32_sha1(F.col("payload")).alias("digest"),
                             F.octet_length("payload").cast("long").alias("n_bytes")), "payload-digests")
    first = (sums.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes")
             .agg(F.min("key").alias("first_key"), F.count("*").alias("n")).where("n > 1 AND first_key IS NOT NULL"))
    revisits = stage(sums.join(first, ["digest", "n_bytes"]).where("NOT key <=> first_key")
                     .select("key", "digest", "first_key").distinct(), "revisits")
    total, n, longest = sums.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*"), F.coalesce(F.max("n_bytes"), F.lit(0))).first()
    summed = rows.select("*", base32_sha1(F.col("payload")).alias("digest"),
                         F.octet_length("payload").cast("long").alias("n_bytes"))
    same = summed["key"].eqNullSafe(revisits["key"]) & (summed["digest"] == revisits["digest"])
    joined = summed.join(revisits, same, "left").select(summed["*"], revisits["first_key"])
    record = record_text(F.col("key").cast("string"), F.col("url"), F.col("payload"), F.col("n_bytes"), F.col("digest"),
                         F.col("first_key").cast("string"))
    mean = total / max(n, 1) + 600
    # Long pages get files of their own, which count them at the longest: where they lie together, files would be too large.
    long = F.col("n_bytes") > int(LONG * mean)
    lines = lambda rows, size: (rows.select(record.alias("value")).write.option("lineSep", END)
                                .option("maxRecordsPerFile", max(1, int(file_bytes // size))))
    lines(joined.where(~long), mean).text(path)
    if longest > int(LONG * mean):
        lines(joined.where(long), longest + 600).mode("append").text(path)
    return path


# --- reading

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
FIELD = re.compile(rb"([!-9;-~]+)[ \t]*:[ \t]*(.*?)[ \t]*\r\n(?![ \t])", re.DOTALL)
MEMBER = b"\x1f\x8b\x08"
LIST = ("archive", "offset", "length", "problem", "record_type", "record_id", "refers_to", "url", "payload_bytes",
        "payload_digest", "payload")
SCHEMA = ("archive string, offset bigint, length bigint, problem string, record_type string, record_id string, "
          "refers_to string, url string, payload_bytes bigint, payload_digest string, payload binary")


class Damaged(Exception):
    """Why the bytes at a place are no sound record."""


def digest_of(payload: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_record(data: bytes, start: int) -> tuple[int, dict]:
    """(end, fields) of the record at ``start``; raises Damaged if a check fails."""
    line = VERSION.match(data, start)
    if not line:
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", line.end())
    if head_end < 0:
        raise Damaged("header without end")
    fields = {k.lower(): v for k, v in FIELD.findall(data[line.end():head_end + 2] + b"\0")}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        raise Damaged("header without length or type")
    block, end = head_end + 4, head_end + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("block without end mark")
    body, n_bytes = block, end - block
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        http_end = data.find(b"\r\n\r\n", block, end)
        if http_end < 0:
            raise Damaged("response without its header's end")
        body = http_end + 4
        n_bytes = end - body
        if fields[b"warc-type"] == b"revisit":
            stated = re.search(rb"\r\nContent-Length:[ \t]*(\d+)\r\n", data[block:body], re.IGNORECASE)
            n_bytes = int(stated[1]) if stated else None
    payload = data[body:end]
    stated = fields.get(b"warc-payload-digest", b"").decode("latin1")
    whole = fields[b"warc-type"] != b"revisit"
    if whole and stated.startswith("sha1:") and stated[5:] != digest_of(payload):
        raise Damaged("payload does not fit its digest")
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    return end + 4, {
        "record_type": text(b"warc-type"), "record_id": text(b"warc-record-id"), "refers_to": text(b"warc-refers-to"),
        "url": text(b"warc-target-uri"), "payload_bytes": n_bytes,
        "payload_digest": stated.removeprefix("sha1:") or (digest_of(payload) if whole else None), "payload": payload}


def sound_records(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record or reason of a gap) over uncompressed bytes; the ranges cover all bytes."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            end, record = parse_record(data, at)
        except Damaged as problem:
            if gap is None:
                gap, reason = at, str(problem)
            following = VERSION.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield at, end, record
        at = end
    if gap is not None:
        yield gap, len(data), reason


def unpack(data: bytes, start: int) -> tuple[int, bytes, bool]:
    """(end, content, whole) of the gzip member at ``start``; a broken one gives what came before the break."""
    reader, parts, at = zlib.decompressobj(31), [], start
    try:
        while not reader.eof and at < len(data):
            parts.append(reader.decompress(data[at:at + (1 << 16)]))
            at += 1 << 16
    except zlib.error:
        return start, b"".join(parts), False
    if not reader.eof:
        return start, b"".join(parts), False
    return min(at, len(data)) - len(reader.unused_data), b"".join(parts), True


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record or reason) over an archive, plain or of gzip members.

    Places are bytes of the archive; records of one member share its range. A member may hold many records: sound ones
    of a damaged member are kept, and the member's range is also reported as a gap.
    """
    if data[:3] != MEMBER and (VERSION.search(data) or MEMBER not in data):
        yield from sound_records(data)
        return
    at, gap, reason = 0, None, ""
    while at < len(data):
        problem, content, end, whole = "no gzip member", b"", at, False
        if data[at:at + 3] == MEMBER:
            end, content, whole = unpack(data, at)
            problem = "broken gzip member"
        found = list(sound_records(content)) if VERSION.match(content) else []
        good = [r for _, _, r in found if isinstance(r, dict)]
        bad = [r for _, _, r in found if isinstance(r, str)]
        if whole and not found and not content:
            at = end
            continue
        if whole and not found:
            problem = "no version line"
        if whole and (good or bad):
            if gap is not None:
                yield gap, at, reason
                gap = None
            yield from ((at, end, r) for r in [*good, *bad])
            at = end
            continue
        following = data.find(MEMBER, at + 1)
        following = len(data) if following < 0 else following
        if good:
            if gap is not None:
                yield gap, at, reason
            yield from ((at, following, r) for r in good)
            gap, reason = at, problem
        elif gap is None:
            gap, reason = at, problem
        at = following
    if gap is not None:
        yield gap, len(data), reason


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record and per gap; a gap has a ``problem`` and no record type.

    A task holds one archive at a time: archives should have bounded size, as those that ``write_archives`` makes.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                rows: list[dict] = []
                held = 0
                for start, end, found in salvage(content.as_py()):
                    row = dict.fromkeys(LIST) | {"archive": archive.as_py(), "offset": start, "length": end - start}
                    row |= {"problem": found} if isinstance(found, str) else found
                    held += len(row["payload"] or b"") if with_payload else 0
                    rows.append(row if with_payload else row | {"payload": None})
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.mapInArrow(run, SCHEMA)


ARROW = pa.schema([(n, {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(),
                        "payload": pa.binary()}.get(n, pa.string())) for n in LIST])


def archived(pages: DataFrame, **settings) -> DataFrame:
    """Write the pages and read them back."""
    spark = pages.sparkSession
    path = write_archives(pages, staging_path(spark, "archives"), **settings)
    return read_archives(spark, path)
