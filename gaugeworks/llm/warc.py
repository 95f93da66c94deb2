"""Legacy web archives (ARC) and their conversion to WARC.

An ARC file starts with a version block, whose lines name the version and the
fields of the header line; each record is a header line with space-separated
fields, the last of them the declared length of the content behind it.  Version
1 has URL, IP address, date, content type and length; version 2 adds result
code, checksum, location, offset and file name.

The converter reads records by declared length and writes, for each, a WARC
record with what ARC lacks: an identifier (a name-based UUID of URL, date and
content), an ISO timestamp, the type (``warcinfo`` for the version block,
``response`` for an HTTP message, ``revisit`` where an equal payload is kept
elsewhere, else ``resource``) and block and payload digests.

Archives are held as binary values of a table in the shared folder, so they are
written and read by Spark and live in any store that it reaches.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._store import discard, settle
from gaugeworks.llm._words import slices, texts_of, tidy

# The field names of both versions' header lines.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A field of our own beside ``WARC-Refers-To``, which names a record: the page of that record.
PAGE_FIELD = "X-Refers-To-Page"
LEAST_REVISIT, ARCHIVE_BYTES = 1000, 8 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs


@dataclass
class Record:
    """A record of either format: named header fields, in order, and the content block."""

    fields: dict[str, str]
    block: bytes = b""
    version: int = 0

    def http(self) -> tuple[dict[str, str], bytes]:
        """Lower-case HTTP header fields and the body; of a block that is not HTTP, none and the block."""
        if not self.block.startswith(b"HTTP/"):
            return {}, self.block
        head, _, body = self.block.partition(b"\r\n\r\n")
        pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
        return {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in pairs}, body


def write_arc(records: list[Record], name: str, date: str, version: int = 1) -> bytes:
    """An ARC file; ``records`` have the fields of :data:`FIELDS` but length, offset and file name."""
    body = f"{version} 0 gaugeworks\n{' '.join(FIELDS[version])}\n\n".encode()
    out = bytearray()
    for r in [Record({"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200"}, body), *records]:
        known = r.fields | {"Offset": str(len(out)), "Filename": name, "Archive-length": str(len(r.block))}
        out += " ".join(known.get(f, "-") for f in FIELDS[version]).encode() + b"\n" + r.block + b"\n"
    return bytes(out)


def read_arc(data: bytes) -> Iterator[Record]:
    """The version block and then the records, each by its declared length."""
    at, version, names = 0, 1, FIELDS[1]
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode()
        if not line.strip():
            at = end + 1
            continue
        values = line.split(" ")
        first = line.startswith("filedesc://")
        if not first and len(values) != len(names):
            raise ValueError(f"header line of {len(values)} fields; version {version} has {len(names)}")
        size = int(values[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        if first:
            head = block.decode().splitlines()
            version, names = int(head[0].split()[0]), head[1].split()
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
        yield Record(dict(zip(names, values, strict=len(values) == len(names))) if not first else dict(zip([*FIELDS[1][:4]], values[:4], strict=True)), block, version)
        at = end + 1 + size


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, content: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {hashlib.sha1(content).hexdigest()}')}>"


def iso_date(date: str) -> str:
    """``YYYYMMDD[hh[mm[ss]]]`` to ISO 8601, UTC."""
    d = (date + "00010100000000"[len(date) :]) if len(date) < 14 else date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc(fields: dict[str, str], block: bytes) -> bytes:
    fields = fields | {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Kept:
    """The record that holds a payload for others: its page, URI and identifier."""

    page: int
    uri: str
    record: str


def convert(arc: bytes, refers: dict[str, Kept] | None = None) -> bytes:
    """ARC to WARC.  ``refers`` says, by the identifier of a record, which record holds its payload; it becomes a revisit of that one."""
    refers, out = refers or {}, bytearray()
    for r in read_arc(arc):
        url, date = r.fields["URL"], r.fields["Archive-date"]
        name = record_id(url, date, r.block)
        known = {"WARC-Record-ID": name, "WARC-Date": iso_date(date)}
        if url.startswith("filedesc://"):
            out += _warc({"WARC-Type": "warcinfo", **known, "WARC-Filename": url.removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}, f"software: gaugeworks\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/{r.version}\r\n".encode())
            continue
        http, body = r.http()
        known |= {"WARC-Target-URI": url, "WARC-IP-Address": r.fields["IP-address"], "WARC-Payload-Digest": _sha1(body)}
        if not http:
            out += _warc({"WARC-Type": "resource", **known, "WARC-Block-Digest": _sha1(r.block), "Content-Type": r.fields["Content-type"]}, r.block)
            continue
        known["Content-Type"] = "application/http; msgtype=response"
        to = refers.get(name)
        if to is None:
            out += _warc({"WARC-Type": "response", **known, "WARC-Block-Digest": _sha1(r.block)}, r.block)
        else:
            head = r.block[: len(r.block) - len(body)]
            refer = {"WARC-Refers-To": to.record, "WARC-Refers-To-Target-URI": to.uri, "WARC-Refers-To-Date": iso_date(date), PAGE_FIELD: str(to.page)}
            out += _warc({"WARC-Type": "revisit", **known, "WARC-Profile": REVISIT_PROFILE, **refer, "WARC-Block-Digest": _sha1(head)}, head)
    return bytes(out)


def read_warc(data: bytes) -> Iterator[Record]:
    """Records of a WARC file by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record begins here")
        fields = {k: v.strip() for k, _, v in (line.partition(":") for line in rest)}
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield Record(fields, block)
        at = end + 8 + size


def page_record(page_id: int | None, url: str | None, payload: bytes, date: str) -> Record:
    """A page as an ARC record: an HTTP message whose ``X-Page-Id`` names the row."""
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n"
    link = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{'' if page_id is None else page_id}"
    return Record({"URL": link or "-", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200"}, head.encode() + payload)


def _archiver(date: str):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html", ARCHIVE_BYTES):
                ids, urls, refers, links, payloads = *(batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "refers_url")), texts_of(batch.column("html"))
                records = [page_record(i, u, p, date) for i, u, p in zip(ids, urls, payloads, strict=True)]
                kept = {}
                for own, to, link, payload in zip(records, refers, links, payloads, strict=True):
                    if to is not None:  # the record there has this payload too, so its identifier follows from its page and URL
                        other = page_record(to, link, payload, date)
                        kept[record_id(own.fields["URL"], date, own.block)] = Kept(to, other.fields["URL"], record_id(other.fields["URL"], date, other.block))
                version = 1 + (ids[0] or 0) % 2  # both versions are written
                name = f"pages-{ids[0]}-{len(ids)}"
                legacy = write_arc(records, name + ".arc", date, version)
                made = convert(legacy, kept)
                yield pa.RecordBatch.from_arrays([pa.array([name + ".warc"]), pa.array([made], pa.binary())], ["name", "content"])

    return run


def _reader(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for r in read_warc(memoryview(content.as_buffer()).tobytes()):
                kind = r.fields["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                http, body = r.http()
                digest = base64.b32decode(r.fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError("a payload does not have its digest")
                page, to = http.get("x-page-id"), r.fields.get(PAGE_FIELD)
                rows.append((None if page is None else int(page), int(http["content-length"]), digest, kind, None if to is None else int(to), r.fields["WARC-Record-ID"], r.fields.get("WARC-Refers-To"), r.fields["WARC-Date"], r.fields["WARC-Target-URI"]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", "warc_date", "target_uri"])


def write_archives(pages: DataFrame, least_revisit: int = LEAST_REVISIT, date: str = "20260101000000") -> DataFrame:
    """``pages(page_id, url, html)`` -> the table of archives ``(name, content binary)``, written to the shared folder.

    Of rows with equal payloads of ``least_revisit`` bytes or more the one with
    the largest ``page_id`` is kept as a response, the others revisit it; rows
    that share this largest id are responses, and the one with the greatest URL
    is referred to.  Rows of one id with different payloads are told apart.
    Payloads are found equal by their digest; only digests that occur twice are
    joined, so a hot payload is a single row on that side.  A null page has an
    empty payload; a row with a null id is a response.  Other columns are not
    read.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keyed = own.withColumn("digest", F.when(F.length(payload) >= least_revisit, F.sha2(payload, 256)))
    digested = keyed.where("digest is not null").select("page_id", "url", "digest")
    kept = digested.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    kept = settle(kept.select("digest", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_url")), "payloads")
    revisits = digested.select("page_id", "digest").join(kept, "digest").where("page_id < refers_to").distinct()
    found = keyed.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to", "refers_url")
    archives = settle(found.mapInArrow(tidy(_archiver(date)), "name string, content binary"), "archives")
    discard(kept)
    return archives


def read_archives(archives: DataFrame) -> DataFrame:
    """``(name, content)`` -> a row per response or revisit record; payload digests are checked."""
    return archives.select("content").mapInArrow(tidy(_reader), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, warc_date string, target_uri string")
