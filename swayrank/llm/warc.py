"""Legacy ARC archives, their conversion to WARC, and both read back.

An archive file is made in the task that has its records, one gzip member a record, and ends after `FILE_BYTES`; Spark's
writer puts each on the shared storage as bytes, and binary files are read back, so archives can be in any store Spark
reaches. A task holds one file and one record.

Conversion reads the version block of an ARC file for the names of its header fields, then each header line and the
declared length, and synthesises what WARC has and ARC lacks: record identifiers, ISO timestamps, record types,
block and payload digests. Blocks are bytes throughout; nothing is decoded but header lines. What is not a record is kept apart
and reported (`arc_faults`), the records after it are found again. Records with equal payloads become revisits of
the one with the smallest page id. Only digests and places are shuffled to find those, and files to apply them where they are very
many.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swayrank.llm.words import arrow_schema, join_counted, record_batch, utf8
from swayrank.session import freeze, shared_folder

# The header fields of ARC versions 1 and 2, and the WARC profile of revisits.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_END = b"\r\n\r\n"
MIN_SHARED_BYTES = 100
FLUSH_BYTES = 4_000_000
CHUNK = 1 << 16
MAX_BROADCAST_REVISITS = 100_000  # about 20 MB
FILE_BYTES = 32 << 20  # of compressed records, after which a file ends
LEVEL = 6
#: A gzip member without content: what Spark's writer puts after each file, since it must put something.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_SPACE = re.compile(r"[\x00-\x20\x7f]")


def _spaceless(value: str | None) -> str:
    """A value that fits into a header line; "-" for null and empty."""
    return _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "-"


def _member(record: bytes) -> bytes:
    return gzip.compress(record, LEVEL, mtime=0)


class Files:
    """Collects members into files of about `limit` bytes; `head` gives a file's first member from its number."""

    def __init__(self, limit: int, head=None):
        self.limit, self.head, self.parts, self.size, self.made = limit, head, [], 0, 0

    def add(self, member: bytes) -> Iterator[bytes]:
        if not self.parts and self.head is not None:
            self.parts.append(self.head(self.made))
        self.parts.append(member)
        self.size += len(member)
        if self.size >= self.limit:
            yield from self.end()

    def end(self) -> Iterator[bytes]:
        if self.parts:
            yield b"".join(self.parts)
            self.parts, self.size = [], 0
            self.made += 1


_FILE = pa.schema([("value", pa.binary())])


def _one_file(content: bytes) -> pa.RecordBatch:
    return record_batch({"value": [content]}, _FILE)


def _new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _write(files: DataFrame, path: str) -> str:
    """One file a row. The writer takes the bytes as they are: a cast from binary changes nothing."""
    rows = files.select(F.col("value").cast("string").alias("value"))
    end = {"lineSep": EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": 1, "compression": "none"}
    rows.write.options(**end).text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


# ---- ARC ----

def _arc_record(fields: dict[str, str], version: int, block: bytes) -> bytes:
    values = fields | {"Archive-length": str(len(block))}
    line = " ".join(values.get(name, "-") for name in ARC_FIELDS[version].split())
    return utf8(line) + b"\n" + block + b"\n"


def _version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 swayrank\n{ARC_FIELDS[version]}\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name}
    return _arc_record(line, version, body)


def write_arc(
    pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), date: str = "20000101000000",
    page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES,
) -> str:
    """Write gzip ARC files of about `file_bytes` bytes, versions in turn by task; returns `path`.

    The block of a record is an HTTP response whose body is the html, in UTF-8 if it is text and as it is if it is binary
    (null: empty), and whose headers have the page id, if there is one.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version = versions[task % len(versions)]
        name = lambda number: f"pages-{task:05d}-{number:05d}.arc.gz"
        files = Files(file_bytes, lambda number: _member(_version_block(name(number), version, date)))
        for batch in batches:
            for page, address, body in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body"))):
                body = body or b""
                known = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n{known}\r\n"
                fields = {
                    "URL": _spaceless(address), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html",
                    "Result-code": "200", "Checksum": hashlib.md5(body).hexdigest(), "Filename": name(files.made),
                }
                yield from map(_one_file, files.add(_member(_arc_record(fields, version, head.encode() + body))))
        yield from map(_one_file, files.end())

    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("binary").alias("body")
    )
    return _write(rows.mapInArrow(each, "value binary"), path)


def is_version_block(url: str, block: bytes) -> bool:
    """Whether a record describes its file; a page that was fetched from such an address does not."""
    return url.startswith("filedesc://") and not block.startswith(b"HTTP/")


class Members(io.RawIOBase):
    """The content of gzip members one after the other. A broken one gives what it holds and sets `fault`; the next is looked for."""

    MAGIC = b"\x1f\x8b\x08"

    def __init__(self, content: bytes):
        self.content, self.at, self.inflater, self.fault = memoryview(content), 0, None, ""

    def readable(self) -> bool:
        return True

    def _broken(self, start: int, reason: str) -> None:
        self.fault = self.fault or f"the compressed stream ends: {reason}"
        found = bytes(self.content[start:]).find(self.MAGIC)
        self.at, self.inflater = (start + found if found >= 0 else len(self.content)), None

    def readinto(self, buffer) -> int:
        while True:
            if self.inflater is None:
                if self.at >= len(self.content):
                    return 0
                if self.content[self.at : self.at + 3] != self.MAGIC:
                    self._broken(self.at, "not a gzip member")
                    continue
                self.inflater, self.start = zlib.decompressobj(31), self.at
            given = self.inflater.unconsumed_tail or self.content[self.at : self.at + CHUNK]
            fresh = not self.inflater.unconsumed_tail
            try:
                made = self.inflater.decompress(given, len(buffer))
            except zlib.error as error:
                self._broken(self.start + 3, str(error))
                continue
            if fresh:
                self.at += len(given)
            if self.inflater.eof:
                self.at -= len(self.inflater.unused_data)
                self.inflater = None
            elif not made and self.at >= len(self.content):
                self._broken(self.start + 3, "a member is cut off")
            if made:
                buffer[: len(made)] = made
                return len(made)


@dataclass
class Fault:
    """Bytes of an archive that are no record, and why."""

    reason: str
    n_bytes: int


# How the fields of a header line look. A URL may hold spaces, as may a content type; no other field does.
FIELD_PATTERNS = {
    "URL": r"(.*\S)", "Archive-date": r"(\d{4,14}|-)", "Content-type": r"(.*?)", "Archive-length": r"(\d+)",
}


def header_pattern(names: list[str]) -> re.Pattern[bytes]:
    return re.compile(" ".join(FIELD_PATTERNS.get(name, r"(\S+)") for name in names).encode() + rb"\r?\n?")


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes] | Fault]:
    """(header fields by name, block) of each record, version blocks included, and a `Fault` for what lies between.

    A version block names the fields of the headers after it. Lines are skipped up to the next header where one
    should stand and does not; a block that ends before its declared length, an unknown version and a broken
    compressed stream are faults too.
    """
    members = Members(content)
    stream = io.BufferedReader(members, CHUNK)
    names = ARC_FIELDS[1].split()
    known = header_pattern(names)
    skipped, why = 0, ""
    while line := stream.readline():
        if not line.strip():
            continue
        versioned = line.startswith(b"filedesc://")
        found = known.fullmatch(line) or (versioned and re.fullmatch(rb"(\S+) .*?(\d+)\r?\n?", line))
        if not found:
            skipped, why = skipped + len(line), why or f"not a header of {len(names)} fields ending with a length: {_text(line[:80])!r}"
            continue
        if skipped:
            yield Fault(why, skipped)
            skipped, why = 0, ""
        values = [_text(v) for v in found.groups()]
        length = int(values[-1])
        block = stream.read(length)
        if len(block) < length:
            yield Fault(f"{values[0]} declares {length} bytes but {len(block)} are left", len(line) + len(block))
            continue
        fields = dict(zip(names, values)) if len(values) == len(names) else {"URL": values[0]}
        if is_version_block(values[0], block):
            version, _, definition = _text(block).partition("\n")
            wanted = definition.split("\n")[0].split()
            number = version.split()[0] if version.split() else ""
            if number not in map(str, ARC_FIELDS) or wanted[-1:] != ["Archive-length"]:
                yield Fault(f"{values[0]}: not a known ARC version: {version[:80]!r}", len(line) + length)
                continue
            names, known = wanted, header_pattern(wanted)
        elif len(values) != len(names):
            yield Fault(f"{values[0]}: not a version block", len(line) + length)
            continue
        yield fields, block
    if skipped:
        yield Fault(why, skipped)
    if members.fault:
        yield Fault(members.fault, 0)


@dataclass
class Http:
    """An HTTP response taken apart; `head` is empty for blocks of another kind."""

    head: bytes
    payload: bytes
    fields: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, block: bytes) -> Http:
        cut = block.find(b"\r\n\r\n")
        if not block.startswith(b"HTTP/") or cut < 0:
            return cls(b"", block)
        lines = _text(block[:cut]).split("\r\n")[1:]
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        return cls(block[: cut + 4], block[cut + 4 :], fields)

    @property
    def page_id(self) -> int | None:
        """The id that `write_arc` noted; none in archives from elsewhere, or for what does not fit into a long."""
        value = self.fields.get("x-page-id", "")
        return int(value) if re.fullmatch(r"-?[0-9]{1,19}", value) and -(1 << 63) <= int(value) < 1 << 63 else None


# ---- conversion ----

def record_id(path: str, ordinal: int) -> str:
    """The identifier of the record converted from a place in an ARC file; the same however often it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{ordinal}')}>"


def warc_date(arc_date: str) -> str:
    """ISO time of an ARC date of 14 digits, or of 4 to 13 filled up; anything else is the start of 1970."""
    digits = (arc_date + "19700101000000"[len(arc_date) :])[:14] if arc_date.isdigit() and len(arc_date) >= 4 else "19700101000000"
    y, m, d, hour, minute, second = (int(x) for x in (digits[:4], *[digits[i : i + 2] for i in range(4, 14, 2)]))
    if not (1 <= m <= 12 and 1 <= d <= 31 and hour < 24 and minute < 60 and second < 60):
        return "1970-01-01T00:00:00Z"
    return f"{y:04d}-{m:02d}-{d:02d}T{hour:02d}:{minute:02d}:{second:02d}Z"


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _warc_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    headers = [*headers, ("WARC-Block-Digest", f"sha256:{_sha256(block)}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers if value is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block + RECORD_END


def _converted(path: str, content: bytes, revisits: dict[int, dict]) -> Iterator[bytes]:
    ordinal = -1
    for record in arc_records(content):
        if isinstance(record, Fault):
            continue
        fields, block = record
        ordinal += 1
        common = [
            ("WARC-Record-ID", record_id(path, ordinal)),
            ("WARC-Date", warc_date(fields.get("Archive-date", ""))),
        ]
        if is_version_block(fields["URL"], block):
            name = fields["URL"].removeprefix("filedesc://")
            about = utf8(f"software: swayrank\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n")
            yield _warc_record([("WARC-Type", "warcinfo"), *common, ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], about)
            continue
        http = Http.of(block)
        ip = fields.get("IP-address", "-")
        common += [
            ("WARC-Target-URI", None if fields["URL"] == "-" else fields["URL"].replace(" ", "%20")),
            ("WARC-IP-Address", None if ip in ("-", "0.0.0.0") else ip),
            ("WARC-Payload-Digest", f"sha256:{_sha256(http.payload)}"),
        ]
        if not http.head:
            yield _warc_record([("WARC-Type", "resource"), *common, ("Content-Type", fields.get("Content-type", "-"))], block)
            continue
        kind = ("Content-Type", "application/http;msgtype=response")
        if ordinal not in revisits:
            yield _warc_record([("WARC-Type", "response"), *common, kind], block)
            continue
        first = revisits[ordinal]
        refers = [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(first["path"], first["ordinal"])),
            ("X-Refers-To-Page-Id", None if first["page_id"] is None else str(first["page_id"])),
            ("X-Payload-Length", str(len(http.payload))),
        ]
        yield _warc_record([("WARC-Type", "revisit"), *common, *refers, kind], http.head)


def arc_index(spark: SparkSession, arc_path: str) -> DataFrame:
    """(path, ordinal, page_id, n_bytes, digest, fault): a row for each HTTP record in the ARC files, and for each fault.

    A fault has its reason and the bytes it concerns, and the number of the record it comes before.
    """
    schema = "path string, ordinal long, page_id long, n_bytes long, digest binary, fault string"
    target = arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, ordinal = [], 0
                for record in arc_records(content):
                    if isinstance(record, Fault):
                        rows.append((path, ordinal, None, record.n_bytes, None, record.reason))
                        continue
                    http = Http.of(record[1])
                    if http.head:
                        rows.append((path, ordinal, http.page_id, len(http.payload), hashlib.sha256(http.payload).digest(), None))
                    ordinal += 1
                if rows:
                    yield record_batch(dict(zip(target.names, map(list, zip(*rows)))), target)

    return _files(spark, arc_path).mapInArrow(each, schema)


def arc_faults(spark: SparkSession, arc_path: str) -> DataFrame:
    """(path, ordinal, n_bytes, fault): what in the ARC files is no record, before which record, and why."""
    return arc_index(spark, arc_path).filter("fault is not null").select("path", "ordinal", "n_bytes", "fault")


def convert(
    spark: SparkSession, arc_path: str, warc_path: str, min_shared_bytes: int = MIN_SHARED_BYTES,
    file_bytes: int = FILE_BYTES,
) -> str:
    """Convert all ARC files below `arc_path`; returns `warc_path`.

    Of HTTP records with equal payloads of at least `min_shared_bytes`, the one with the smallest page id (then by
    place) is a response, others revisit it. Records without a page id come last. What is no record is left out;
    `arc_faults` lists it.
    """
    index = freeze(arc_index(spark, arc_path).filter("fault is null").drop("fault"))
    place = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "path", "ordinal")
    large = index.filter(F.col("n_bytes") >= min_shared_bytes)
    first = freeze(
        large.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    )
    shared = large.select("path", "ordinal", "digest")
    revisits = (
        join_counted(shared, first, "digest", index.count())
        .filter((F.col("path") != F.col("first.path")) | (F.col("ordinal") != F.col("first.ordinal")))
        .groupBy("path").agg(F.collect_list(F.struct("ordinal", "first")).alias("revisits"))
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(file_bytes)
        for batch in batches:
            for path, content, listed in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "revisits"))):
                known = {r["ordinal"]: r["first"] for r in listed or ()}
                for record in _converted(path, content, known):
                    yield from map(_one_file, files.add(_member(record)))
        yield from map(_one_file, files.end())

    # Files stay where they are read as long as the list of revisits is small enough to go to them.
    listed = first.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    files = _files(spark, arc_path).join(F.broadcast(revisits) if listed <= MAX_BROADCAST_REVISITS else revisits, "path", "left")
    return _write(files.mapInArrow(each, "value binary"), warc_path)


# ---- WARC ----

def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-cased name, block) of each record; blocks are checked against their digest."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = _text(line).partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if fields["warc-block-digest"] != f"sha256:{_sha256(block)}":
            raise ValueError(f"{fields['warc-record-id']}: the block does not have its digest")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_id, date, record_type, payload_bytes, payload_digest, refers_to, payload) of all HTTP records.

    For revisits, whose payload is stored with the record they refer to, `payload` is null; its size and digest
    are those of the full payload.
    """
    schema = (
        "page_id long, url string, record_id string, date string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to long, payload binary"
    )
    target = arrow_schema(schema)

    def rows(content: bytes) -> Iterator[tuple]:
        for fields, block in warc_records(content):
            kind = fields["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            http = Http.of(block)
            digest = fields["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and digest != _sha256(http.payload):
                raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
            refers = fields.get("x-refers-to-page-id")
            yield (
                http.page_id, fields.get("warc-target-uri"), fields["warc-record-id"], fields["warc-date"], kind,
                len(http.payload) if kind == "response" else int(fields["x-payload-length"]),
                digest, None if refers is None else int(refers), http.payload if kind == "response" else None,
            )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                held, size = [], 0
                for row in rows(content):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size >= FLUSH_BYTES:
                        yield record_batch(dict(zip(target.names, map(list, zip(*held)))), target)
                        held, size = [], 0
                if held:
                    yield record_batch(dict(zip(target.names, map(list, zip(*held)))), target)

    return _files(spark, path).mapInArrow(each, schema)


def archive_pages(
    pages: DataFrame, folder: str | None = None, versions: tuple[int, ...] = (1, 2), file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write `pages` as ARC files, convert them to WARC, and return what `read_warc` finds there.

    A null html is an empty payload; null ids and urls are left out of the headers and come back null (urls are
    percent-encoded where they hold white space or control characters). Repeated rows are records of their own: equal
    payloads below 100 bytes are all responses, of others one is. Very long pages are one record. Columns other
    than page_id, url and html are ignored; an empty table gives archives without records.
    """
    spark = pages.sparkSession
    arc = write_arc(pages, f"{folder}/arc" if folder else _new_folder(spark, "arc"), versions, file_bytes=file_bytes)
    warc = f"{folder}/warc" if folder else _new_folder(spark, "warc")
    return read_warc(spark, convert(spark, arc, warc, file_bytes=file_bytes))
