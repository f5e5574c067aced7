"""Legacy archives: ARC files of versions 1 and 2, and their conversion to WARC.

Both are written as gzip members, one per record, by Spark's text writer: a row is a record's member, and the line
separator is an empty member, so the files are plain multi-member gzip and are committed like any Spark output.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.llm.common import stored, typed
from tripleweave.operators.checkpoints import checkpoint_folder

#: Uncompressed bytes per archive file, about.
ARCHIVE_BYTES = 32 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT_BYTES = 0

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tripleweave:archives")


def member(record: bytes) -> bytes:
    """A gzip member with the record."""
    return gzip.compress(record, 1, mtime=0)


def unpacked(content: bytes) -> bytes:
    """All members of a file, one after another; a file that isn't compressed stays as it is."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, at = [], 0
    view = memoryview(content)
    while at < len(content):
        one = zlib.decompressobj(31)
        while not one.eof:
            part = view[at : at + 4096]
            if not part:
                raise ValueError("the last member is cut off")
            out.append(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
    return b"".join(out)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 tripleweave\n{ARC_FIELDS[version]}\n\n".encode()
    rest = f"0.0.0.0 {date} text/plain {len(body)}" if version == 1 else f"0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} {rest}\n".encode() + body


def arc_record(version: int, url: str, date: str, mime: str, content: bytes, name: str) -> bytes:
    if version == 1:
        line = f"{url} 0.0.0.0 {date} {mime} {len(content)}"
    else:
        line = f"{url} 0.0.0.0 {date} {mime} 200 {hashlib.md5(content).hexdigest()} - 0 {name} {len(content)}"
    return line.encode() + b"\n" + content + b"\n"


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record, version blocks included.

    The version block names the header's fields; a header line is split from its right end into as many, since only a
    URL may hold blanks. Content is as long as declared; line feeds between records are passed over.
    """
    fields = ARC_FIELDS[1].split()
    at = 0
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.index(b"\n", at)
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        if line.startswith("filedesc://"):
            length = int(line.rsplit(" ", 1)[1])
            body = content[end + 1 : end + 1 + length]
            version, names = body.split(b"\n", 2)[:2]
            fields = names.decode().split() or ARC_FIELDS[int(version.split()[0])].split()
            record = {"URL": line.split(" ", 1)[0], "Archive-date": line.split(" ")[2], "Content-type": "text/plain", "version": version.split()[0].decode()}
        else:
            values = line.rsplit(" ", len(fields) - 1)
            if len(values) != len(fields):
                raise ValueError(f"header with {len(values)} fields for {len(fields)} at byte {at}: {line[:200]}")
            record = dict(zip(fields, values))
            length = int(record["Archive-length"])
            body = content[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"record at byte {at} declares {length} bytes, {len(body)} are left")
        yield record, body
        at = end + 1 + length


def http_parts(content: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head (with its blank line), body and header fields (names in lower case) of an HTTP response."""
    cut = content.find(b"\r\n\r\n")
    end = cut + 4 if cut >= 0 else len(content)
    head = content[:end]
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return head, content[end:], fields


def warc_date(date: str) -> str:
    """ISO form of an ARC date, whose parts from month to second may be missing."""
    full = (date + "00010101000000"[len(date) :])[:14] if len(date) < 8 else (date + "000000")[:14]
    return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(*parts: object) -> str:
    """The same identifier whenever the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(31).join(map(str, parts)))}>"


def warc_record(fields: dict[str, object], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in fields.items() if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (as written) and block of each record, by declared lengths."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        length = int(fields["Content-Length"])
        block = content[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"record at byte {at} declares {length} bytes, {len(block)} are left")
        yield fields, block
        at = end + 4 + length + 4


def _write(rows: DataFrame, path: str, per_file: int) -> None:
    rows.select(F.col("value").cast("string").alias("value")).write.options(
        lineSep=_EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=per_file
    ).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes ``page_id, url, html`` as ARC files, of version 1 and 2 in turn, without a shuffle; returns records per file.

    Html is UTF-8, null empty. What a header can't hold of a URL is percent-encoded; null becomes a page URN.
    """
    size = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    per_file = int(max(1, min(20_000, archive_bytes // (size + 400))))

    def records(batches):
        count, version, name = 0, 2, ""
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                at = datetime(2000, 1, 1) + timedelta(seconds=(page_id or 0) % (1 << 29))
                date = at.strftime("%Y%m%d%H%M%S")
                if count % per_file == 0:
                    version = 3 - version
                    name = f"pages-{count // per_file}.arc"
                    out.append(member(arc_version_block(name, version, date)))
                count += 1
                body = (html or "").encode("utf-8", "surrogatepass")
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{own}\r\n"
                target = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{page_id}"
                out.append(member(arc_record(version, target, date, "text/html", head.encode() + body, name)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html").mapInArrow(records, "value binary")
    _write(rows, path, per_file + 1)
    return per_file


def convert(spark: SparkSession, arc_path: str, warc_path: str, per_file: int, least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """Converts the ARC files below ``arc_path`` to WARC files.

    Of HTTP records with equal payloads of at least ``least_bytes``, that with the largest page id is a response and the
    others are revisits of it; records without a page id, or with that same id, are responses. Payloads are moved once,
    compressed, to where their page's decision is; decisions are made on digests alone.
    """
    schema, arrow = typed("page_id bigint, digest string, bytes bigint")

    def digests(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, body in arc_records(unpacked(content.as_py())):
                    if body.startswith(b"HTTP/"):
                        _, payload, http = http_parts(body)
                        if "x-page-id" in http and len(payload) >= least_bytes:
                            rows.append((int(http["x-page-id"]), base32_sha1(payload), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ((), (), ()), arrow)], schema=arrow)

    found = stored(_files(spark, arc_path).mapInArrow(digests, schema))
    latest = stored(found.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    revisits = stored(found.join(latest, ["digest", "bytes"]).filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct())
    # (page_id, digest) of a record, its response as a member, and what a revisit needs
    schema2, arrow2 = typed("page_id bigint, digest string, record binary, uri string, date string, head binary")

    def responses(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, body in arc_records(unpacked(content.as_py())):
                    date = warc_date(fields["Archive-date"])
                    common = {"WARC-Date": date, "WARC-Target-URI": fields["URL"]}
                    if fields["URL"].startswith("filedesc://"):
                        continue  # each WARC file gets a warcinfo record of its own
                    if body.startswith(b"HTTP/"):
                        head, payload, http = http_parts(body)
                        digest, page = base32_sha1(payload), http.get("x-page-id")
                        named = {
                            "WARC-Type": "response", "WARC-Record-ID": record_id("response", page or fields["URL"], digest), **common,
                            "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(body)}",
                            "Content-Type": "application/http;msgtype=response",
                        }
                    else:
                        head, digest, page = b"", base32_sha1(body), None
                        named = {
                            "WARC-Type": "resource", "WARC-Record-ID": record_id("resource", fields["URL"], date, digest), **common,
                            "WARC-Block-Digest": f"sha1:{digest}", "Content-Type": fields["Content-type"],
                        }
                    rows.append((page and int(page), digest, member(warc_record(named, body)), fields["URL"], date, head))
                    size += len(rows[-1][2])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow2)], schema=arrow2)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow2)], schema=arrow2)

    decided = _files(spark, arc_path).mapInArrow(responses, schema2).join(revisits, ["page_id", "digest"], "left")

    def final(batches):
        count = 0
        for batch in batches:
            out = []
            for page, digest, record, uri, date, head, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if count % per_file == 0:
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", page, digest), "WARC-Date": date, "Content-Type": "application/warc-fields"}
                    out.append(member(warc_record(info, b"software: tripleweave\r\nformat: WARC File Format 1.1\r\n")))
                count += 1
                if refers_to is not None:
                    record = member(warc_record({
                        "WARC-Type": "revisit", "WARC-Record-ID": record_id("revisit", page, digest), "WARC-Date": date, "WARC-Target-URI": uri,
                        "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Profile": REVISIT_PROFILE,
                        "WARC-Refers-To": record_id("response", refers_to, digest), "X-Refers-To-Page-Id": refers_to,
                        "Content-Type": "application/http;msgtype=response",
                    }, head))
                out.append(record)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = decided.select("page_id", "digest", "record", "uri", "date", "head", "refers_to").mapInArrow(final, "value binary")
    _write(rows, warc_path, per_file + 1)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per response, revisit or resource record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, uri,
    record_id``. A response's digest is that of the payload read, and must be the declared one; a revisit's are declared."""
    schema, arrow = typed("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, uri string, record_id string")

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_records(unpacked(content.as_py())):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http: dict[str, str] = {}
                    digest, size = fields.get("WARC-Payload-Digest", fields.get("WARC-Block-Digest", ""))[5:], len(block)
                    if kind != "resource":
                        _, payload, http = http_parts(block)
                        size = len(payload) if kind == "response" else int(http["content-length"])
                        if kind == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't that of the declared digest")
                    page, refers = http.get("x-page-id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((page and int(page), size, digest, kind, refers and int(refers), fields.get("WARC-Target-URI"), fields["WARC-Record-ID"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 7, arrow)], schema=arrow)

    return _files(spark, path).mapInArrow(records, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as ARC, converts that to WARC, and returns what the WARC files hold. Both are in the shared folder."""
    spark = pages.sparkSession
    base = f"{checkpoint_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    per_file = write_arc(pages, f"{base}/arc")
    convert(spark, f"{base}/arc", f"{base}/warc", per_file)
    return read_warc(spark, f"{base}/warc")
