"""Operator 1: legacy ARC archives are parsed and rewritten as WARC archives.

ARC has two versions: the URL-record line has five blank-separated fields in the first and ten in the
second; the version block at the head of a file says which. Each record's declared length says where
the next one begins. The converter gives each record what WARC wants and ARC lacks: an identifier
(a name-based UUID), an ISO timestamp (from the 14-digit date), a type (response, or revisit of an
equal payload) and SHA-1 digests of payload and block.

Both kinds of archive are files of some megabytes, gzipped, written by Spark into a folder that all
executors see; a file is one chunk of records, so no task holds more than a chunk and a record.

Defined results: a null payload is an empty one; a null url is written as "-", blanks in a url as
%20; a record without an id is a response and nothing refers to it; of several records with the same
largest id and payload, one is the response. Damaged archives lose no more than what is damaged: a line
that is no head, a record that is longer than its file or a damaged gzip member is skipped up to the
next head or member, and skipped_arc() lists it. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwright.llm.common import read, staged_path

#: Raw bytes after which an archive file ends.
CHUNK = 8 << 20
#: Field counts of the URL-record line, by version.
ARC_FIELDS = {1: 5, 2: 10}
#: Copies of each payload's entry, so that the rows of a frequent payload meet it in as many tasks.
SALTS = 32

ARC_SCHEMA = "archive string, offset long, record_id long, url string, ip string, arc_date string, mime string, head binary, payload binary, payload_bytes long, payload_digest string"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _chunks(records: Iterator[bytes], start: bytes, name: str) -> Iterator[pa.RecordBatch]:
    held, size = [start], len(start)
    for r in records:
        if size + len(r) > CHUNK and len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], [name])
            held, size = [start], len(start)
        held.append(r)
        size += len(r)
    if len(held) > 1:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], [name])


def _write(chunks: DataFrame, path: str) -> None:
    """One gzipped file for each row; the text writer puts a row's bytes out as they are, and a line feed."""
    chunks.select(F.col("archive").cast("string")).write.options(compression="gzip", maxRecordsPerFile="1", lineSep="\n").text(path)


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20000101000000") -> None:
    """Rows (record_id long, url string, payload binary) as ARC files of the given version."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
        block = f"{version} 0 chartwright\n{fields}\n\n".encode()
        middle = "" if version == 1 else " 200 - - 0 records.arc"
        start = f"filedesc://records.arc 0.0.0.0 {date} text/plain{middle} {len(block)}\n".encode() + block + b"\n"

        def records() -> Iterator[bytes]:
            for b in batches:
                for key, url, payload in zip(*(b.column(c) for c in ("record_id", "url", "payload")), strict=True):
                    body, key = payload.as_py() or b"", key.as_py()
                    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Record-Key: {key}\r\n" if key is not None else "") + f"Content-Length: {len(body)}\r\n\r\n"
                    where = "%20".join((url.as_py() or "-").split()) or "-"
                    yield f"{where} 0.0.0.0 {date} text/html{middle} {len(head) + len(body)}\n{head}".encode() + body + b"\n"

        yield from _chunks(records(), start, "archive")

    _write(pages.select("record_id", "url", "payload").mapInArrow(pack, "archive binary"), path)


def _head_and_payload(content: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head with its empty line, and the rest; all is payload where there is no such head."""
    if content.startswith(b"HTTP/") and (at := content.find(b"\r\n\r\n")) >= 0:
        return content[: at + 4], content[at + 4 :]
    return b"", content


def _field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if colon and k.strip().lower() == name.lower():
            return v.strip()
    return None


#: A line that can be a record's head, where the parser looks for the next one.
HEAD_LIKE = re.compile(rb"(?m)^(?:filedesc:|[A-Za-z][A-Za-z0-9+.-]{0,20}:|- )[^\n]* \d+\r?$")


def unpacked(data: bytes) -> tuple[bytes, list[tuple[int, int, str]]]:
    """The uncompressed bytes of a file of gzip members, or the file itself, and what was skipped of the compressed file: offset, bytes, reason."""
    if data[:2] != b"\x1f\x8b":
        return data, []
    out, skipped, at = [], [], 0
    while 0 <= at < len(data):
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data[at:]))
            if not member.eof:
                skipped.append((at, len(data) - at, "gzip member cut short"))
            after = len(data) - len(member.unused_data)
        except zlib.error:
            after = at + 1
            found = data.find(b"\x1f\x8b\x08", after)
            skipped.append((at, (found if found >= 0 else len(data)) - at, "damaged gzip member"))
        at = data.find(b"\x1f\x8b\x08", after)
    return b"".join(out), skipped


def head_fields(line: bytes, n: int) -> list[bytes] | None:
    """The n fields of a URL-record line, if it is one: a date of up to 14 digits and a length; blanks in a url stay."""
    parts = line.rstrip(b"\r").rsplit(b" ", n - 1)
    return parts if len(parts) == n and all(parts) and parts[-1].isdigit() and parts[2].isdigit() and len(parts[2]) <= 14 else None


def scan_arc(data: bytes) -> Iterator[tuple[int, dict | None, int, str]]:
    """(offset, record, bytes, "") of each record of one uncompressed ARC file, and (offset, None, bytes, reason) of what is no record.

    The version block says how many fields a line has. Where no head stands, or a record is longer than
    the file, the parser goes on at the next line that can be a head.
    """
    at, n = 0, ARC_FIELDS[1]
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        if not line:
            at = end + 1
            continue
        reason, length = "", 0
        if line.startswith(b"filedesc:"):
            last = line.rsplit(b" ", 1)[-1]
            length = int(last) if last.isdigit() else len(data)
            version = (data[end + 1 : end + 1 + 20].split(maxsplit=1) or [b"1"])[0]
            n = ARC_FIELDS.get(int(version) if version.isdigit() else 1, ARC_FIELDS[1])
            if end + 1 + length > len(data):
                reason = "version block without its length"
        elif (parts := head_fields(line, n)) is None:
            reason = "no head"
        else:
            length = int(parts[-1])
            if end + 1 + length > len(data):
                reason = "record cut short"
            else:
                head, payload = _head_and_payload(data[end + 1 : end + 1 + length])
                yield at, {"url": parts[0].decode("utf-8", "replace"), "ip": parts[1].decode("latin-1"), "arc_date": parts[2].decode(), "mime": parts[3].decode("latin-1"), "head": head, "payload": payload}, end + 1 + length - at, ""
        if reason:
            found = HEAD_LIKE.search(data, end + 1)
            after = found.start() if found else len(data)
            yield at, None, after - at, reason
            at = after
        else:
            at = end + 1 + length


def parse_arc(data: bytes) -> Iterator[tuple[int, dict]]:
    """(offset, record) of one uncompressed ARC file."""
    return ((at, r) for at, r, _, _ in scan_arc(data) if r is not None)


def whole_number(text: bytes | str | None) -> int | None:
    """A number of up to 18 digits, else none."""
    return int(text) if text and len(text) <= 18 and text.isdigit() and text.isascii() else None


def skipped_arc(spark: SparkSession, path: str) -> DataFrame:
    """What of the ARC files in a folder is no record: archive, offset (of the compressed file for a damaged one), bytes, reason."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data, bad = unpacked(content.as_py())
                rows = [(file.rsplit("/", 1)[1], *x) for x in [*bad, *((at, n, why) for at, r, n, why in scan_arc(data) if r is None)]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["archive", "offset", "bytes", "reason"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(look, "archive string, offset long, bytes long, reason string")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files in a folder (ARC_SCHEMA), version blocks left out; record_id is null where the head has no key."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ARC_SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
        for b in batches:
            for i in range(b.num_rows):
                file, data = b.column("path")[i].as_py(), unpacked(b.column("content")[i].as_py())[0]
                rows = []
                for at, r in parse_arc(data):
                    key = _field(r["head"], b"X-Record-Key")
                    rows.append((file.rsplit("/", 1)[1], at, whole_number(key), r["url"], r["ip"], r["arc_date"], r["mime"], r["head"], r["payload"], len(r["payload"]), digest_of(r["payload"])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, ARC_SCHEMA)


def iso_date(arc_date: str) -> str:
    """2001-02-03T04:05:06Z from a date of up to 14 digits; missing parts are the least ones."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_name(url: str, date: str, key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {key} {digest}')}>"


def with_types(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds response_id, response_url, response_date: for records to be written as revisits, of the record that they repeat; else null.

    Of records with equal payloads of at least least_bytes bytes, that with the largest id is the
    response. Digests are counted before the shuffle; only those that occur again are joined, and
    each record of a frequent payload goes to one of SALTS tasks.
    """
    spot = F.struct("record_id", F.concat_ws(":", "archive", F.col("offset").cast("string")).alias("spot"), "url", "arc_date")
    again = records.where((F.col("payload_bytes") >= least_bytes) & F.col("record_id").isNotNull()).groupBy("payload_digest", "payload_bytes").agg(F.max(spot).alias("of"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "payload_bytes", "of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = records.withColumn("salt", F.pmod(F.xxhash64("archive", "offset"), F.lit(SALTS)).cast("int"))
    joined = salted.join(again, ["payload_digest", "payload_bytes", "salt"], "left")
    own = (F.col("of.spot") == F.concat_ws(":", "archive", F.col("offset").cast("string"))) | F.col("record_id").isNull()
    return joined.select(*records.columns, *(F.when(F.col("of").isNotNull() & ~own, F.col(f"of.{c}")).alias(f"response_{to}") for c, to in (("record_id", "id"), ("url", "url"), ("arc_date", "date"))))


def write_warc(records: DataFrame, path: str) -> None:
    """Rows of with_types() as WARC 1.1 files."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
            lines = [*fields, ("WARC-Block-Digest", "sha1:" + digest_of(block)), ("Content-Length", len(block))]
            return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines if v is not None), "\r\n"]).encode() + block + b"\r\n\r\n"

        info = b"software: chartwright\r\nformat: WARC File Format 1.1\r\n"
        start = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_name("warcinfo", "", None, digest_of(info))), ("WARC-Date", iso_date("2000")), ("Content-Type", "application/warc-fields")], info)

        def all_records() -> Iterator[bytes]:
            for b in batches:
                for r in b.to_pylist():
                    date, digest = iso_date(r["arc_date"]), r["payload_digest"]
                    revisit = r["response_id"] is not None
                    fields = [("WARC-Type", "revisit" if revisit else "response" if r["head"] else "resource"), ("WARC-Record-ID", record_name(r["url"], date, r["record_id"], digest)), ("WARC-Date", date), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha1:{digest}")]
                    if revisit:
                        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_name(r["response_url"], iso_date(r["response_date"]), r["response_id"], digest)), ("WARC-Refers-To-Target-URI", r["response_url"]), ("WARC-Refers-To-Date", iso_date(r["response_date"])), ("X-Refers-To-Key", r["response_id"])]
                    fields += [("X-Record-Key", r["record_id"]), ("X-Payload-Length", r["payload_bytes"]), ("Content-Type", "application/http; msgtype=response" if r["head"] else r["mime"])]
                    yield record(fields, r["head"] if revisit else r["head"] + r["payload"])

        yield from _chunks(all_records(), start, "archive")

    _write(records.mapInArrow(pack, "archive binary"), path)


def parse_warc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields by lower-case name, block) of one uncompressed WARC file."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = whole_number(fields.get("content-length"))
        if length is None or "warc-type" not in fields:
            at += 5  # no record's head
            continue
        yield at, fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length


WARC_SCHEMA = "record_id long, warc_id string, warc_type string, warc_date string, url string, payload_bytes long, payload_digest string, refers_to_id string, refers_to long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files in a folder (WARC_SCHEMA), warcinfo left out. Length and digest of a response are those of the payload read; a revisit declares them."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in WARC_SCHEMA.split(", ")]
        types = [pa.int64() if c.endswith("long") else pa.string() for c in WARC_SCHEMA.split(", ")]
        for b in batches:
            for data in b.column("content"):
                data = data.as_py()
                rows = []
                for _, f, block in parse_warc(unpacked(data)[0]):
                    if f["warc-type"] == "warcinfo":
                        continue
                    digest, size = f.get("warc-payload-digest", "").removeprefix("sha1:"), whole_number(f.get("x-payload-length")) or 0
                    if f["warc-type"] != "revisit":
                        payload = _head_and_payload(block)[1]
                        digest, size = digest_of(payload), len(payload)
                    rows.append((whole_number(f.get("x-record-key")), f.get("warc-record-id"), f["warc-type"], f.get("warc-date"), f.get("warc-target-uri"), size, digest, f.get("warc-refers-to"), whole_number(f.get("x-refers-to-key"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, WARC_SCHEMA)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> DataFrame:
    """Converts the ARC files of one folder to WARC files in another and returns the records read back from those."""
    write_warc(with_types(read_arc(spark, arc_path), least_bytes), warc_path)
    return read_warc(spark, warc_path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each page: page_id, payload_bytes, payload_digest, record_type (response or revisit), refers_to. Odd ids go through ARC 1, even ones through ARC 2."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    root = staged_path(spark, "archives")
    odd = F.coalesce(F.pmod("record_id", F.lit(2)), F.lit(0)) == 1
    write_arc(pages.where(odd), f"{root}/arc/v1", 1)
    write_arc(pages.where(~odd), f"{root}/arc/v2", 2)
    found = convert(spark, f"{root}/arc/*", f"{root}/warc")
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h FROM p),
b AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest FROM d),
m AS (SELECT payload_digest, max(page_id) AS top FROM b GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM b JOIN m USING (payload_digest)
"""
