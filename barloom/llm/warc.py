"""Legacy archives: ARC files (versions 1 and 2) are read by their header lines and declared lengths and rewritten as WARC.

Both sides are files of one gzip member per record in the shared folder.  Tasks write files under names of their own
and report what they wrote; only what Spark committed is read further on.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import by_file, file_system, settle, shared_files, spread

#: The header fields that each ARC version declares, in order.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Bytes of payload after which a task starts the next archive.
ARCHIVE_BYTES = 64 << 20
_BLANK = re.compile(r"[\x00-\x20\x7f-\x9f]")
_SPACE = uuid.NAMESPACE_URL


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_line(version: int, url: str | None, date: str, kind: str, size: int, ip: str = "0.0.0.0", status: int = 200, checksum: str = "-", offset: int = 0, name: str = "-") -> bytes:
    """An ARC record's header line; white space and controls in the URL are percent-encoded, no URL is a dash."""
    url = _BLANK.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url or "") or "-"
    values = (url, ip, date, kind, size) if version == 1 else (url, ip, date, kind, status, checksum, "-", offset, name, size)
    return " ".join(map(str, values)).encode("utf-8", "surrogatepass") + b"\n"


def parse_header(line: bytes, version: int) -> dict[str, str]:
    """Named fields of a header line of that version; a wrong number of fields or a length that is none raises."""
    parts = line.decode("utf-8", "surrogatepass").rstrip("\r\n").split(" ")
    if len(parts) != len(FIELDS[version]):
        raise ValueError(f"ARC version {version} has {len(FIELDS[version])} fields, found {len(parts)}")
    found = dict(zip(FIELDS[version], parts))
    if not found["Archive-length"].isdigit():
        raise ValueError("Archive-length is no number")
    return found


def version_block(version: int, name: str, date: str) -> bytes:
    """The first record of an archive: it names the version and lists the fields."""
    body = f"{version} 0 Unnamed\n{' '.join(FIELDS[version])}\n".encode()
    return header_line(version, f"filedesc://{name}", date, "text/plain", len(body), name=name) + body


class _Members:
    """Reads a file of gzip members (or of plain bytes) as a stream that knows each member's offset."""

    def __init__(self, stream):
        self.stream, self.raw, self.at = stream, b"", stream.tell()

    def member(self) -> tuple[int, bytes] | None:
        """Offset and content of the next member."""
        start, inflate, out = self.at, zlib.decompressobj(31), []
        while True:
            self.raw = self.raw or self.stream.read(1 << 18)
            if not self.raw:
                if out:
                    raise ValueError("archive cut inside a record")
                return None
            out.append(inflate.decompress(self.raw))
            self.at += len(self.raw) - len(inflate.unused_data)
            self.raw = inflate.unused_data
            if inflate.eof:
                return start, b"".join(out)


def http_block(payload: bytes, page_id: int | None, headers: str = "") -> bytes:
    """An HTTP response as archives hold it."""
    named = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n{headers}\r\n".encode() + payload


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Headers with their closing blank line, and payload; a block that is no HTTP message is all payload."""
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if block.startswith(b"HTTP/") and end >= 0 else (b"", block)


def http_field(headers: bytes, name: str) -> str | None:
    """A header's value."""
    for line in headers.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def read_arc(stream):
    """``offset, version, fields, block`` of each record of an ARC file of gzip members, the version block left out."""
    members, version = _Members(stream), None
    while (found := members.member()) is not None:
        offset, record = found
        line, _, rest = record.partition(b"\n")
        if version is None:
            version = int(rest.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            parse_header(line, version)
            continue
        fields = parse_header(line, version)
        size = int(fields["Archive-length"])
        if len(rest) < size:
            raise ValueError("record shorter than its declared length")
        yield offset, version, fields, rest[:size]


def write_arc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000") -> DataFrame:
    """Legacy archives of the pages, versions 1 and 2 by turns: ``path, records`` of every archive written."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, stream, held, records, done = TaskContext.get().partitionId(), 0, None, 0, 0, []
        for batch in batches:
            for page, link, text in zip(*(batch.column(i) for i in range(3))):
                if stream is None:
                    version, name = 1 + (part + number) % 2, f"{part:06d}-{number:05d}-{uuid.uuid4().hex[:12]}.arc.gz"
                    path, number = f"{folder}/{name}", number + 1
                    stream = _create(path)
                    stream.write(gzip.compress(version_block(version, name, date), 1))
                    records, held = 0, 0
                payload = (text.as_py() or "").encode("utf-8", "surrogatepass")
                block = http_block(payload, page.as_py())
                line = header_line(version, link.as_py(), date, "text/html", len(block), offset=stream.tell(), name=name)
                stream.write(gzip.compress(line + block + b"\n", 1))
                records, held = records + 1, held + len(payload)
                if held >= ARCHIVE_BYTES:
                    stream.close()
                    done.append((path, records))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    rows = spread(pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html")))
    return settle(rows.mapInArrow(run, "path string, records long"), "arc")


def _create(path: str):
    system, place = file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place, compression=None)


def _open(path: str):
    system, place = file_system(path)
    return system.open_input_file(place)


def scan_arc(archives: DataFrame) -> DataFrame:
    """``path, offset, id, size, digest, key`` of each record: its place, WARC id to be, payload and page number.

    ``key`` is null where the record names no page.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, stream = [], _open(path)
                for offset, _, _, block in read_arc(stream):
                    headers, payload = split_http(block)
                    page = http_field(headers, "X-Page-Id")
                    out.append((path, offset, record_id(path, offset), len(payload), digest(payload), None if page is None else int(page)))
                stream.close()
                columns = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=schema.names)

    schema = T.StructType.fromDDL("path string, offset long, id string, size long, digest string, key long")
    return by_file(archives.select("path"), "path", archives.count()).mapInArrow(run, schema)


def record_id(path: str, offset: int) -> str:
    """A WARC record id that follows from the record's archive and offset, so that reruns of a task give it again."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{path}#{offset}')}>"


def choose(records: DataFrame, least: int = 0) -> DataFrame:
    """Adds ``refers``, the id of the response that a record repeats, null for responses.

    Of records of one payload of at least ``least`` bytes the one with the largest key is the response (null keys last;
    then the last by place).  Counts and maxima are summed up before the shuffle, and only payloads that repeat are
    joined, a join whose skew Spark splits.
    """
    order = F.struct(F.coalesce("key", F.lit(-(1 << 63))).alias("key"), "path", "offset", "id")
    best = records.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max(order).alias("best")).filter("n > 1")
    best = settle(best.select("digest", "size", F.col("best.id").alias("first")), "responses")
    joined = records.join(best, ["digest", "size"], "left")
    return joined.withColumn("refers", F.when(F.col("first") != F.col("id"), F.col("first"))).drop("first")


def warc_date(date: str) -> str:
    """An ARC date (digits, year first, possibly cut short) as a WARC timestamp."""
    digits = (date if date.isdigit() else "")[:14]
    filled = (digits + "00010101000000"[len(digits) :])[:14]
    return f"{filled[:4]}-{filled[4:6]}-{filled[6:8]}T{filled[8:10]}:{filled[10:12]}:{filled[12:14]}Z"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.0 record."""
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def convert(chosen: DataFrame, folder: str, files: int = 1000) -> DataFrame:
    """Rewrite chosen ARC records as WARC: ``path, records`` of every archive written.

    A task takes whole ARC files (``files`` is about how many there are) and reads them front to back, one record in memory at a time.  Identifiers follow from
    archive and offset, timestamps from the archive date, the block digest from the block, the payload digest from the
    full payload; revisits keep the HTTP headers, and name the response they repeat.
    """

    def run(batches):
        import pyarrow as pa

        source, stream, out, path, records, held, done, number = None, None, None, None, 0, 0, [], 0
        for batch in batches:
            for arc, offset, own, refers, sha in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if arc != source:
                    if stream is not None:
                        stream.close()
                    source, stream = arc, _open(arc)
                    version = int(_Members(stream).member()[1].split(b"\n", 1)[1].split(b" ", 1)[0])
                if out is None:
                    path, number, records, held = f"{folder}/{uuid.uuid4().hex}-{number:05d}.warc.gz", number + 1, 0, 0
                    out = _create(path)
                    info = b"software: archive converter\r\nformat: WARC File Format 1.0\r\n"
                    own_info = [("WARC-Record-ID", record_id(path, 0)), ("WARC-Date", warc_date("")), ("Content-Type", "application/warc-fields")]
                    out.write(gzip.compress(warc_record("warcinfo", own_info, info), 1))
                stream.seek(offset)
                line, _, rest = _Members(stream).member()[1].partition(b"\n")
                fields = parse_header(line, version)
                block = rest[: int(fields["Archive-length"])]
                http, payload = split_http(block)
                headers = [("WARC-Record-ID", own), ("WARC-Date", warc_date(fields["Archive-date"]))]
                if fields["URL"] != "-":
                    headers.append(("WARC-Target-URI", fields["URL"]))
                headers += [("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{sha}")]
                if refers is not None:
                    headers += [("WARC-Refers-To", refers), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("X-Payload-Length", str(len(payload)))]
                    block = http
                headers.append(("WARC-Block-Digest", f"sha1:{digest(block)}"))
                headers.append(("Content-Type", "application/http; msgtype=response" if http else fields["Content-type"]))
                out.write(gzip.compress(warc_record("response" if refers is None else "revisit", headers, block), 1))
                records, held = records + 1, held + len(block)
                if held >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records))
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    rows = by_file(chosen.select("path", "offset", "id", "refers", "digest"), "path", files).sortWithinPartitions("path", "offset")
    return settle(rows.mapInArrow(run, "path string, records long"), "warc")


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name and the block of declared length."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size + 4 or rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    return headers, rest[:size]


def read_warc(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of WARC files: ``id, type, refers, date, uri, key, payload_bytes, payload_digest`` and, if asked, ``payload``.

    Block digests, and payload digests of responses, are verified; a difference raises.  A revisit's length and digest
    are those of the full payload, its ``payload`` is null.
    """

    def run(batches):
        import pyarrow as pa

        def pack(out):
            columns = list(zip(*out)) if out else [[]] * len(schema)
            kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, size, stream = [], 0, _open(path)
                members = _Members(stream)
                while (found := members.member()) is not None:
                    headers, block = parse_warc(found[1])
                    if headers["warc-type"] == "warcinfo":
                        continue
                    if headers["warc-block-digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"block digest differs in {headers['warc-record-id']}")
                    http, payload = split_http(block)
                    sha, full = headers["warc-payload-digest"].partition(":")[2], headers["warc-type"] == "response"
                    if full and digest(payload) != sha:
                        raise ValueError(f"payload digest differs in {headers['warc-record-id']}")
                    page = http_field(http, "X-Page-Id")
                    row = (
                        headers["warc-record-id"], headers["warc-type"], headers.get("warc-refers-to"), headers["warc-date"], headers.get("warc-target-uri"),
                        None if page is None else int(page), len(payload) if full else int(headers["x-payload-length"]), sha,
                    )
                    out.append(row + ((payload if full else None,) if with_payload else ()))
                    size += len(block) if with_payload else 256
                    if size > 4 << 20:
                        yield pack(out)
                        out, size = [], 0
                stream.close()
                yield pack(out)

    ddl = "id string, type string, refers string, date string, uri string, key long, payload_bytes long, payload_digest string"
    schema = T.StructType.fromDDL(ddl + (", payload binary" if with_payload else ""))
    return by_file(archives.select("path"), "path", archives.count()).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Pages as ARC, converted to WARC, read back: ``key, payload_bytes, payload_digest, record_type, refers_to, uri, date``.

    A null page text is an empty payload, a null URL leaves the target out, a null key gives a record without page
    number, which is a response only where no numbered page has its payload.  Repeated rows are records of their own.
    """
    spark = pages.sparkSession
    archives = write_arc(pages, shared_files(spark, "arc"), key, url, html)
    records = settle(scan_arc(archives), "records")
    found = read_warc(convert(choose(records, least), shared_files(spark, "warc"), archives.count()))
    found = settle(found, "read")
    answers = found.filter("type = 'response'").select(F.col("id").alias("refers"), F.col("key").alias("refers_to"))
    joined = found.join(answers, "refers", "left")
    return joined.select(F.col("key").alias(key), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "uri", "date")


# SQL has no base32: the digest's 160 bits are taken five at a time from the hexadecimal SHA-1
PAGES_SQL = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
    (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (('0x' || h[1 + g * 5 : 5 + g * 5])::BIGINT >> (15 - 5 * i)) % 32], '' ORDER BY g, i)
     FROM range(8) a(g), range(4) b(i)) AS payload_digest
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS m FROM coded)
"""
