"""Legacy archives: ARC files to WARC records, WARC files written and read by Spark.

ARC: a version block names the version (1 or 2) and the fields of the header lines; each record is one such line,
which ends with the declared length, and as many bytes. The converter makes the WARC fields that ARC lacks:
record ids from what identifies a record, ISO time stamps from 14-digit dates, record types from the content, digests.

WARC files are written by Spark's text writer, one record a row with the record's own line ends, so they reach
any store that Spark reaches, in parts of a bounded number of records.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the fields of a header line in ARC's versions 1 and 2 (fixed values).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: The HTTP header that names a page, by which record ids are made.
KEY_HEADER = "X-Page-Key"
#: Records of an archive, and bytes after which the next one begins: an archive is one value of a column.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 500, 16 << 20
#: Payloads of more bytes are written to WARC files of their own kind, of LONG_FILE_BYTES or one record.
LONG_PAYLOAD, LONG_FILE_BYTES = 256 << 10, 512 << 20

RECORD = "key string, warc_type string, record_id string, target_uri string, ip string, warc_date string, content_type string, http_header binary, payload binary, payload_bytes bigint, payload_digest string, truncated boolean"


def uuid_of(name: str) -> str:
    """A UUID of version 8 whose bits come from a name's SHA-256."""
    h = hashlib.sha256(name.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-8{h[13:16]}-8{h[17:20]}-{h[20:32]}"


def uuid_column(name: Column) -> Column:
    h = F.sha2(name.cast("binary"), 256)
    part = lambda a, n: F.substring(h, a + 1, n)
    return F.concat(part(0, 8), F.lit("-"), part(8, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(17, 3), F.lit("-"), part(20, 12))


def iso_date(arc_date: str) -> str | None:
    """20240131235959 as 2024-01-31T23:59:59Z; shorter dates begin their period; None for what is no date."""
    digits = arc_date.strip()
    if not digits.isdigit() or not 4 <= len(digits) <= 14:
        return None
    try:
        return datetime.datetime.strptime((digits + "00000101000000"[len(digits) :])[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


# ------------------------------------------------------------------ ARC


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 lanternlake\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = ["filedesc://" + name, "0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return " ".join(fields).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, content_type: str, document: bytes, name: str = "-", offset: int = 0, status: int = 200) -> bytes:
    fields = [url, ip, date, content_type, *([str(status), "-", "-", str(offset), name] if version == 2 else []), str(len(document))]
    return " ".join(fields).encode() + b"\n" + document + b"\n"


def pack_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(name, content): ARC archives of the pages, in versions 1 and 2 in turn.

    An archive holds ARCHIVE_RECORDS records at most, and ends with the record that takes it over ARCHIVE_BYTES. Each page is an
    HTTP response with its body in UTF-8, empty for null, and its id in KEY_HEADER, which a null id lacks. A null url is stored as -.
    Repeated ids are records of their own, an empty table gives no archive. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            keys, lengths = batch.column(0).to_pylist(), [x or 0 for x in pc.binary_length(batch.column(2)).to_pylist()]
            at = 0
            while at < len(keys):
                end, total = at, 0
                while end < min(at + ARCHIVE_RECORDS, len(keys)) and total <= ARCHIVE_BYTES:
                    total += lengths[end]
                    end += 1
                version = 1 + n % 2
                n += 1
                # Ids tell archives apart; where some lack one, what they hold does.
                held = hashlib.sha256(b"".join(batch.column(2)[i].as_py() or b"" for i in range(at, end))).hexdigest() if None in keys[at:end] else ""
                name = f"pages-{uuid_of(f'{keys[at]} {keys[end - 1]} {end - at} {n}{held}')}.arc"
                parts = [arc_version_block(version, name, "20240101000000")]
                size = len(parts[0])
                for i in range(at, end):
                    url, body = batch.column(1)[i].as_py(), batch.column(2)[i].as_py() or b""
                    key = "" if keys[i] is None else f"{KEY_HEADER}: {keys[i]}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(body)}\r\n\r\n"
                    url = (url or "-").replace("\n", "%0A").replace("\r", "%0D")
                    parts.append(arc_record(version, url, "0.0.0.0", "20240101000000", "text/html", head.encode() + body, name, size))
                    size += len(parts[-1])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["name", "content"])
                at = end

    columns = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("binary").alias("body"))
    return columns.mapInArrow(run, "name string, content binary")


def opened(content: bytes) -> io.BufferedIOBase:
    """A stream of an archive's bytes, whether compressed as a whole, by record, or not at all."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def split_http(document: bytes) -> tuple[bytes | None, bytes]:
    """The header of an HTTP response with the empty line, and the payload; None where the document is no such response."""
    if not document.startswith(b"HTTP/"):
        return None, document
    for gap in (b"\r\n\r\n", b"\n\n"):
        at = document.find(gap)
        if at >= 0:
            return document[: at + len(gap)], document[at + len(gap) :]
    return document, b""


def http_field(header: bytes | None, name: str) -> str | None:
    for line in (header or b"").split(b"\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def arc_records(content: bytes) -> Iterator[tuple[int, list[str], bytes, bool]]:
    """(version, fields of the header line, bytes, whether bytes are missing) of each record, the version block included.

    The version block says how many fields a header line has; a URL may hold spaces. Lines that are no header line of
    that version, as after a wrong length, are passed over up to the next one. Without a version block: version 1.
    """
    stream, version = opened(content), 1
    while line := stream.readline():
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not text:
            continue
        parts = text.rsplit(" ", len(ARC_FIELDS[version]) - 1)
        if text.startswith("filedesc://"):
            parts = text.split(" ")
        elif len(parts) < len(ARC_FIELDS[version]) or not parts[2].isdigit():
            continue
        if not parts[-1].isdigit():
            continue
        length = int(parts[-1])
        document = stream.read(length)
        if text.startswith("filedesc://"):
            number = document[:1].decode("ascii", "replace")
            version = int(number) if number.isdigit() and int(number) in ARC_FIELDS else 1
        yield version, parts, document, len(document) < length


def convert_arc(archives: DataFrame, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """The WARC records (see RECORD) of ARC archives, a row each.

    archives: (name, content), as of spark.read.format("binaryFile"); null contents have no records. The version block becomes
    a warcinfo record, an HTTP response a response record, anything else a resource record. A record's id follows from its
    key (KEY_HEADER, if it has one that is not empty) and digest, or else from archive, place, URL and date, so reruns agree and only records of equal key and
    payload share one; a date that can't be read becomes the archive's. Digests are SHA-256 of the whole payload, in hexadecimal. truncated: fewer bytes than declared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"binary": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_()}.get(k, pa.string())) for n, k in (x.split(" ") for x in RECORD.split(", "))])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                rows, held, archive_date = [], 0, "1970-01-01T00:00:00Z"
                for place, (_, fields, document, short) in enumerate(arc_records(content) if content else ()):
                    url, ip, date, kind = fields[:4]
                    stamp = iso_date(date) or archive_date
                    if url.startswith("filedesc://"):
                        archive_date = stamp
                        header, payload, warc_type, content_type = None, document, "warcinfo", "application/warc-fields"
                    else:
                        header, payload = split_http(document)
                        warc_type, content_type = ("response", "application/http; msgtype=response") if header is not None else ("resource", kind)
                    key, digest = http_field(header, KEY_HEADER) or None, hashlib.sha256(payload).hexdigest()
                    record = uuid_of(f"key {key} {digest}" if key else f"{name} {place} {url} {date}")
                    rows.append((key, warc_type, record, url, ip, stamp, content_type, header, payload, len(payload), digest, short))
                    held += len(payload)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select(F.col(name_col).cast("string").alias("name"), F.col(content_col).alias("content")).mapInArrow(run, RECORD)


# ------------------------------------------------------------------ revisits


def repeated_payloads(payloads: DataFrame, least: int = 100, id_col: str = "page_id", digest_col: str = "payload_digest", bytes_col: str = "payload_bytes") -> DataFrame:
    """(payload_digest, first_key): of payloads of at least `least` bytes that more than one row has, the smallest id. Null ids are passed over; first_key is null if there is no other."""
    big = payloads.where(F.col(bytes_col) >= least).groupBy(F.col(digest_col).alias("payload_digest"))
    return big.agg(F.min(id_col).alias("first_key"), F.count("*").alias("n")).where("n > 1").drop("n")


def mark_revisits(records: DataFrame, repeated: DataFrame, salts: int = 32) -> DataFrame:
    """records with refers_to_key: the first key of its payload where another record has that payload first, then warc_type is revisit.

    Records of the first key itself, however many, are no revisits; one without a key revisits the first key, if there is one. repeated: rows of repeated_payloads(). A payload that a third of the records share is dealt over `salts` tasks.
    """
    first = F.struct(F.col("first_key").cast("string").alias("key")).alias("first")
    dealt = repeated.select("payload_digest", first, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).alias("dealt")
    own = records.alias("own")
    salt = F.pmod(F.xxhash64("own.record_id"), F.lit(salts)).cast("int")
    joined = own.join(dealt, (F.col("own.payload_digest") == F.col("dealt.payload_digest")) & (salt == F.col("dealt.salt")), "left")
    first_key = F.col("dealt.first.key")
    again = (F.col("own.warc_type") == "response") & first_key.isNotNull() & (first_key != F.coalesce("own.key", F.lit("")))
    changed = {"warc_type": F.when(again, "revisit").otherwise(F.col("own.warc_type")), "refers_to_key": F.when(again, first_key)}
    kept = [changed["warc_type"].alias(c) if c == "warc_type" else F.col(f"own.`{c}`") for c in records.columns if c != "refers_to_key"]
    return joined.select(*kept, changed["refers_to_key"].alias("refers_to_key"))


# ------------------------------------------------------------------ WARC

#: What a revisit record says it is (fixed value).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_warc(records: DataFrame, path: str, records_per_file: int = 2000, compression: str = "gzip", longest: int | None = None) -> None:
    """Writes rows of RECORD, with refers_to_key if there is one, as WARC 1.1 files under path.

    A file is read as one value, so its bytes are bounded: records with payloads over LONG_PAYLOAD bytes are written in a second pass,
    to files with few records. A table without rows writes no record; null fields are left out, repeated rows written as often. longest: the length of the longest payload if it is known; else a pass over records finds it. A revisit keeps the HTTP header and leaves the payload out. Nothing goes through Python: a row's bytes are put together
    as columns and written as they are.
    """
    refers = F.col("refers_to_key") if "refers_to_key" in records.columns else F.lit(None).cast("string")
    b = lambda c: F.coalesce(c.cast("binary"), F.lit(b""))
    revisit = F.col("warc_type") == "revisit"
    block = F.concat(b(F.col("http_header")), F.when(revisit, F.lit(b"")).otherwise(b(F.col("payload"))))
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    clean = lambda c: F.regexp_replace(c, r"[\r\n]", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("warc_type")), field("WARC-Record-ID", urn(F.col("record_id"))), field("WARC-Date", F.col("warc_date")),
        field("WARC-Target-URI", clean(F.when(F.col("warc_type") != "warcinfo", F.col("target_uri")))), field("WARC-IP-Address", clean(F.when(F.col("warc_type") != "warcinfo", F.col("ip")))),
        field("Content-Type", clean(F.col("content_type"))), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(REVISIT_PROFILE)), field("WARC-Refers-To", urn(uuid_column(F.concat(F.lit("key "), refers, F.lit(" "), F.col("payload_digest"))))), field("X-Refers-To-Key", refers))).otherwise(F.lit("")),
        F.when(F.col("truncated"), F.lit("WARC-Truncated: unspecified\r\n")).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    # The writer ends each row with the line separator: the second of the two line ends that follow a record.
    row = F.concat(head.cast("binary"), block, F.lit(b"\r\n")).cast("string")
    if longest is None:
        longest = records.agg(F.max(F.length("payload")).alias("n")).first()["n"] or 0
    is_long = F.coalesce(F.length("payload"), F.lit(0)) > LONG_PAYLOAD
    passes = [(records.where(~is_long), records_per_file, "errorifexists")]
    if longest > LONG_PAYLOAD:
        passes.append((records.where(is_long), max(1, min(records_per_file, LONG_FILE_BYTES // longest)), "append"))
    for some, most, mode in passes:
        some.select(row.alias("value")).write.mode(mode).option("lineSep", "\r\n").option("compression", compression).option("maxRecordsPerFile", most).text(path)


READ = "key string, warc_type string, record_id string, target_uri string, warc_date string, payload_bytes bigint, payload_digest string, refers_to_key string, intact boolean, payload binary"


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record of a WARC file, by its declared lengths."""
    stream = opened(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        yield fields, stream.read(int(length)) if length.isdigit() else b""


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all WARC files under path, a row each, repeated ones too, no rows if there are none; payload is null unless asked for, and what a record lacks or leaves empty is null.

    payload_bytes: of the payload itself, or of what a revisit's HTTP header declares. payload_digest: of the payload itself, or
    as a revisit names it. intact: a response's digest is the one that its record names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"binary": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_()}.get(k, pa.string())) for n, k in (x.split(" ") for x in READ.split(", "))])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in warc_records(content.as_py()):
                    kind = fields.get("warc-type")
                    header, payload = split_http(block)
                    named = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if kind == "revisit":
                        declared = http_field(header, "Content-Length")
                        n, digest = int(declared) if declared and declared.isdigit() else None, named
                    else:
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((http_field(header, KEY_HEADER) or None, kind, fields.get("warc-record-id", "").removeprefix("<urn:uuid:").rstrip(">"), fields.get("warc-target-uri"), fields.get("warc-date"), n, digest, fields.get("x-refers-to-key"), digest == named, payload if payloads else None))
                    held += len(payload) if payloads else 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)
