"""Legacy archives: ARC version 1 and 2 files are parsed by declared lengths and converted to WARC 1.1.

ARC parsing follows the version block, which names the fields of the header lines to come: a
record is one header line and as many bytes as its last field says, whatever these contain. WARC
identifiers are derived from the record's place and contents, so a converted archive is the same
on any run. Archives are written by Spark's own file writer (a record's end, CR LF CR LF, is its
line separator), one commit protocol for all machines, and read back by declared lengths too.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

#: Fixed values of the ARC format: the fields of a record's header line in either version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_END = b"\r\n\r\n"
#: Payloads under this many bytes are always stored.
LEAST = 100
#: Records in an archive file at most; files are read as streams, so long records cost no more memory than their own length.
FILE_RECORDS = 4096


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    body: bytes
    version: int
    offset: int


def arc_bytes(records: list[ArcRecord], version: int, name: str = "legacy.arc") -> bytes:
    """An ARC file of that version: its version block, then the records."""
    fields = " ".join(ARC_FIELDS[version])
    block = f"{version} 0 lodequery\n{fields}\n".encode()
    lead = ["filedesc://" + name, "0.0.0.0", "19700101000000", "text/plain"]
    more = ["200", "-", "-", "0", name] if version == 2 else []
    out = io.BytesIO()
    out.write(" ".join([*lead, *more, str(len(block))]).encode() + b"\n" + block + b"\n")
    for r in records:
        more = ["200", hashlib.md5(r.body).hexdigest(), "-", str(out.tell()), name] if version == 2 else []
        out.write(" ".join([r.url, r.ip, r.date, r.kind, *more, str(len(r.body))]).encode() + b"\n" + r.body + b"\n")
    return out.getvalue()


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file; the first block says which version's header lines follow. ValueError if it's cut short."""
    at, fields, version = 0, None, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        start, stop = at, data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"header line at {at} doesn't end")
        line = data[at:stop].decode("utf-8", "replace").split(" ")
        try:
            length = int(line[-1])
        except ValueError:
            raise ValueError(f"header line at {at} declares no length") from None
        at = stop + 1
        body = data[at : at + length]
        if length < 0 or len(body) < length:
            raise ValueError(f"record at {start} declares {length} bytes, {len(body)} are there")
        at += length
        if line[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} isn't known")
            fields = ARC_FIELDS[version]
            continue
        if fields is None:
            raise ValueError("the file doesn't begin with a version block")
        if len(line) < len(fields):
            raise ValueError(f"header line at {start} has {len(line)} fields, version {version} has {len(fields)}")
        line = [" ".join(line[: len(line) - len(fields) + 1]), *line[len(line) - len(fields) + 1 :]]  # URLs with spaces
        named = dict(zip(fields, line, strict=True))
        yield ArcRecord(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], body, version, start)


def timestamp(date: str) -> str:
    """YYYYMMDDhhmmss, or a shorter beginning of it, as a WARC-Date."""
    full = (date + "19700101000000"[len(date) :]) if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, gap, payload = block.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap else (b"", block)


def to_warc(record: ArcRecord, refers_to: str | None = None, name: str | None = None) -> bytes:
    """The record as WARC 1.1, without the end mark. refers_to: the name of the response it revisits.

    Identifiers are derived from the payload's digest and a name, by default the URL and date.

    HTTP records become response or revisit, all others resource; the block digest covers what is
    stored and the payload digest the whole payload.
    """
    head, payload = split_http(record.body) if record.url.startswith(("http://", "https://")) else (b"", record.body)
    digest = hashlib.sha256(payload).hexdigest()
    kind = "revisit" if refers_to else "response" if head else "resource"
    block = head if refers_to else record.body
    named = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(name or f"{record.url} {record.date}", digest)),
        ("WARC-Date", timestamp(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response" if head else record.kind),
        ("Content-Length", str(len(block))),
    ]
    if refers_to:
        named += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Name", refers_to)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode() + b"\r\n" + block


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a binary stream, by its declared length. ValueError if it is cut short or no WARC."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        named = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            named[k.lower()] = v.strip()
        length = int(named["content-length"])
        block = stream.read(length)
        if len(block) < length or stream.read(len(WARC_END)) != WARC_END:
            raise ValueError("record is cut short")
        yield named, block


def _page_record(page_id, url: str | None, payload: bytes) -> ArcRecord:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    head += f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
    place = "".join(c if c > " " else "%20" for c in url or "") or "about:blank"
    if not place.startswith(("http://", "https://")):
        place = "http://invalid/" + place
    return ArcRecord(place, "0.0.0.0", "20200101000000", "text/html", head.encode() + payload, 0, 0)


def archive_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) -> one converted WARC record a page, as (record string).

    Pages pass through ARC files, version 1 and 2 by turns. Of pages with equal payloads of at
    least `least` bytes those with the smallest id are responses and the rest revisits; a null id
    is larger than any. A null html is the empty payload; pages of any length pass whole, repeated
    ids are records each, and no pages give no records. Copies are found by digest: their
    smallest id is one row a digest, and the join of a digest that many pages share is split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = F.octet_length("html") >= least
    first = rows.filter(long).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(first, rows["digest"] == first["_digest"], "left").drop("_digest", "digest")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1
        for batch in batches:
            ids, urls, htmls, firsts = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(ids), 256):
                part = slice(at, at + 256)
                records = [_page_record(i, u, h.encode()) for i, u, h in zip(ids[part], urls[part], htmls[part], strict=True)]
                version = 3 - version
                out = []
                for i, first_id, arc in zip(ids[part], firsts[part], parse_arc(arc_bytes(records, version)), strict=True):
                    again = first_id is not None and i != first_id
                    out.append(to_warc(arc, f"page {first_id}" if again else None, None if i is None else f"page {i}").decode())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return rows.select("page_id", "url", "html", "first").mapInArrow(convert, "value string")


def write_archives(records: DataFrame, path: str) -> None:
    """Gzipped WARC files of at most FILE_RECORDS records."""
    records.write.option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", WARC_END.decode()).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, uri, date) of each record.

    Responses' digests are taken from the stored payload and must equal the declared ones.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri", "date"]
        for batch in batches:
            for content in batch.column(0):
                out = []
                for named, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    head, payload = split_http(block)
                    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
                    digest, kind = named["warc-payload-digest"].removeprefix("sha256:"), named["warc-type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {named['warc-record-id']} doesn't have its digest")
                    page, to = http.get("x-page-id", ""), named.get("warc-refers-to-name", "").removeprefix("page ")
                    out.append((int(page) if page else None, int(http["content-length"]), digest, kind, int(to) if to else None, named["warc-record-id"], named["warc-target-uri"], named["warc-date"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, uri string, date string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages as WARC files in the shared folder and returns what reading them back gives."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(archive_pages(pages), path)
    return read_archives(pages.sparkSession, path)


ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {LEAST} and first <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {LEAST} and first <> page_id then first end as refers_to from f"""
