"""WARC archives: one gzip member a record, revisits of equal payloads, and a reader that salvages damaged archives."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table, shared_folder
from .common import small_batches

RECORDS_PER_FILE, LEVEL, DATE = 4000, 6, "2024-01-01T00:00:00Z"
READ = 1 << 16
# Fixed values of the format
VERSION, MAGIC = b"WARC/1.1\r\n", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()

SCHEMA = (
    "archive string, start bigint, end bigint, kind string, reason string, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes bigint, payload binary"
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record with its HTTP header alone; the header tells the payload's length either way."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(2, f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte: the top of its length field, or for 16 MB and more that of an empty member after it."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write_archives(pages: DataFrame, path: str | None = None) -> str:
    """Write a record for every row (page_id, url, html) of ``pages`` and return the folder.

    Payloads are the html in UTF-8, empty for null. Of rows with equal payloads that with the largest page_id is the response
    (all of them, if the id itself repeats) and the others revisit it; rows without id revisit it too. Only digests of payloads that repeat
    are shuffled: they are written out, and Catalyst broadcasts them if their files are below its threshold.

    The text sink puts a separator after every row. Here that is the zero byte in which every member ends, so the files are
    plain concatenations of members.
    """
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc", uuid.uuid4().hex)
    rows = small_batches(pages).select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    again = scratch_table(rows.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1").select("sha", "first"), "repeated")
    rows = rows.join(again, "sha", "left").withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))

    def pack(batches):
        for b in batches:
            cols = (b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].cast(pa.binary()).to_pylist(), b["refers_to"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([member(record(*r))[:-1] for r in zip(*cols)], type=pa.binary())], names=["data"])

    packed = rows.select("page_id", "url", "html", "refers_to").mapInArrow(pack, "data binary")
    packed.select(F.col("data").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def parse(data: bytes) -> tuple[dict, int]:
    """The record at the head of ``data`` and its length; ValueError if a check fails."""
    if not data.startswith(b"WARC/1."):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("header not ended")
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise ValueError("header incomplete")
    start, n = end + 4, int(fields["content-length"])
    block = data[start : start + n]
    if len(block) < n or data[start + n : start + n + 4] != b"\r\n\r\n":
        raise ValueError("record cut short")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    head, found, payload = block.partition(b"\r\n\r\n")
    if "application/http" not in fields.get("content-type", "") or not found:
        head, payload = b"", block
    told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if sha and sha != digest(payload):
            raise ValueError("payload digest differs")
        sha = sha or digest(payload)
    revisit = fields["warc-type"] == "revisit"
    return {
        "record_type": fields["warc-type"], "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "payload_digest": sha or None, "payload_bytes": int(told[1]) if revisit and told else None if revisit else len(payload), "payload": None if revisit else payload,
    }, start + n + 4


def unzip(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content and length of the gzip member at ``at``; for one that is damaged or cut short, what comes out before that, its bytes, and why."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            piece = data[pos : pos + READ]
            if not piece:
                return b"".join(out), pos - at, "member cut short"
            out.append(z.decompress(piece))
            pos += len(piece)
        return b"".join(out), pos - len(z.unused_data) - at, None
    except zlib.error as e:
        why = f"member damaged: {e}"
    z, out = zlib.decompressobj(31), []
    for i in range(at, pos, READ):
        out.append(z.decompress(data[i : min(i + READ, pos)]))
    try:  # byte by byte, so that nothing before the error is lost
        while pos < len(data):
            out.append(z.decompress(data[pos : pos + 1]))
            pos += 1
    except zlib.error:
        pass
    return b"".join(out), pos - at, why


def record_at(data: bytes, at: int, most: int) -> tuple[dict, int]:
    """``parse`` at a place of ``data``, for headers of at most ``most`` bytes, without a copy of all that follows."""
    end = data.find(b"\r\n\r\n", at, at + most)
    told = re.search(rb"(?im)^content-length:\s*(\d+)", data[at:end]) if end > 0 and data.startswith(b"WARC/1.", at) else None
    return parse(data[at : end + 8 + int(told[1])] if told else data[at : at + READ])


def records_of(inner: bytes) -> list[dict | str]:
    """Sound records of a member's content, and the first failure of every stretch between them; the search goes on at the next version line."""
    out, at, reason = [], 0, None
    while 0 <= at < len(inner):
        try:
            found, length = record_at(inner, at, len(inner))
        except ValueError as e:
            reason = reason or ("bytes after the record" if at and not inner.startswith(b"WARC/1.", at) else str(e))
            at = inner.find(b"WARC/1.", at + 1)
            continue
        out += [reason, found] if reason else [found]
        at, reason = at + length, None
    return out + [reason] if reason else out


def salvage(data: bytes):
    """Yield (start, end, record) for every sound record of an archive and (start, end, reason) for every gap between them.

    At each place a gzip member or a plain record is tried. After a failed check the search goes on at the next byte that
    begins a member or a version line, until one passes all checks; the bytes in between are one gap with the first failure as
    reason. Empty members count as padding.

    A member may hold any number of records; they, and gaps between them, have the member's place. So do records that come out of
    a damaged member before the damage; its bytes are a gap besides.
    """
    at = gap = until = 0
    reason, early = None, []  # early: records out of damaged members, the bytes of which end at ``until``
    while at < len(data):
        try:
            if data.startswith(MAGIC, at):
                inner, length, damage = unzip(data, at)
                inside = records_of(inner)
                if damage:
                    early = early if at < until else []
                    records = [x for x in inside if isinstance(x, dict)]
                    if records:
                        if reason:
                            yield gap, at, reason
                        for x in records:
                            yield at, at + length, x
                        gap, until, early, reason = at, max(until, at + length), early + records, None
                    raise ValueError(damage)
                if inside and not any(isinstance(x, dict) for x in inside):
                    reason = reason or inside[0]
                    at += length
                    continue
            else:
                found, length = record_at(data, at, READ)
                inside = [found] if at >= until or found not in early else []  # a damaged member may have held it uncompressed
        except ValueError as e:
            reason = reason or str(e)
            later = [x for x in (data.find(MAGIC, at + 1), data.find(b"WARC/1.", at + 1)) if x > 0]
            at = min(later, default=len(data))
            continue
        if reason:
            yield gap, at, reason
        for x in inside:
            yield at, at + length, x
        at = gap = at + length
        reason = None
    if reason:
        yield gap, at, reason


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA for all archives in a folder, plain or compressed: kind is record or gap; a gap has its bytes and reason alone."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            for name, data in zip(b["path"].to_pylist(), b["content"]):
                rows = []
                for start, end, x in salvage(data.as_py()):
                    rows.append({"archive": name, "start": start, "end": end, "kind": "gap" if isinstance(x, str) else "record"} | ({"reason": x} if isinstance(x, str) else x))
                for i in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows[i : i + 512]] for n in names}, schema=ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in SCHEMA.split(", ")])


def page_of(urn: str):
    """The page_id in a record id written here; null if there is none."""
    return F.expr(f"try_cast(regexp_extract({urn}, 'urn:page:(-?[0-9]+)', 1) as bigint)")
