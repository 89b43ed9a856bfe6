"""WARC archives: writing, reading, and resolving repeated payloads into revisit records.

Only headers (key, address, date, digest) are grouped to find the original of each payload, per task
first; the payload travels once, to the record that is written.  A third of all pages may share a
payload: the join that hands the answers back has a plain exchange on both sides, so that adaptive
execution can split a hot digest.

Archives are written by Spark's text writer: a record ends with two CRLFs, which is the writer's
line separator, so every file is a WARC file, committed by the usual protocol when executors are
lost.  A file holds what a task writes, which adaptive execution bounds by bytes, and ``RECORDS_PER_FILE``
records at most.  Compression covers whole files; archives with a gzip member per record are read as
well.  Files are read one at a time per task and must stay below two gigabytes.

Any archive can be read: response and revisit records of HTTP are split into head and payload, chunked
ones put together; every other record keeps its block as payload and its fields.

Defined results: a null payload is empty; a null key is never an original and refers to the
smallest key of its payload if there is one, else stands alone as a response; rows that repeat
the smallest key of a payload are all responses; line breaks in an address are percent-encoded; very
long payloads are handled whole, in memory several times over; other columns of a table are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, shared_path, table

CRLF = "\r\n"
#: Payloads below this many bytes are stored again rather than referred to.
MIN_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 20_000
EPOCH = "1970-01-01T00:00:00Z"
_READ = 1 << 20

HEADER_SCHEMA = (
    "record_type string, record_key long, record_id string, uri string, date string, http_head binary, payload_bytes long, payload_digest string, refers_to long, "
    "refers_to_id string, refers_to_uri string, refers_to_date string, digest_ok boolean, payload binary, fields array<struct<name:string,value:string>>"
)
_ARROW = pa.schema(
    [
        ("record_type", pa.string()), ("record_key", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("http_head", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("refers_to_uri", pa.string()), ("refers_to_date", pa.string()), ("digest_ok", pa.bool_()),
        ("payload", pa.binary()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
    ]
)
#: Fields that are written anew for responses and revisits.
_FRESH = [
    "warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest", "warc-block-digest", "warc-profile", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date",
    "x-record-key", "x-refers-to-key", "content-type", "content-length",
]
_RESOLVED = ["record_key", "record_id", "date", "uri", "http_head", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_id", "refers_to_uri", "refers_to_date", "fields"]


def _urn(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(key.cast("string"), F.lit("none"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", date: str = EPOCH) -> DataFrame:
    """One record per row: key and id, date, uri, http_head (without lengths), payload, payload_bytes, payload_digest."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    number = F.col(key).cast("long")
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8").cast("binary")
    return pages.select(number.alias("record_key"), _urn(number).alias("record_id"), F.lit(date).alias("date"), F.col(uri).alias("uri"), http.alias("http_head"), body.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )


def resolve_revisits(recs: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, order: tuple[str, ...] = ("record_key",)) -> DataFrame:
    """Adds record_type and what a revisit refers to (key, id, uri, date): of equal payloads the smallest by
    ``order`` stays; records with a null in it are never originals."""
    known = F.lit(True)
    for c in order:
        known = known & F.col(c).isNotNull()
    own = [c for c in ("record_key", "record_id", "uri", "date") if c not in order]
    originals = (
        recs.where((F.col("payload_bytes") >= min_bytes) & known)
        # Grouped by the length too, so that the join below exchanges this side as well: adaptive
        # execution splits a hot digest only between two exchanges.
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(F.struct(*order, *own)).alias("__first"))
        .select("payload_digest", "__first")
    )
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"__first.{c}"))
    again = (F.col("payload_bytes") >= min_bytes) & F.col("__first").isNotNull() & ~same
    first = lambda c: F.when(again, F.col(f"__first.{c}"))
    return recs.join(originals, "payload_digest", "left").select(
        *recs.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        first("record_key").alias("refers_to"), first("record_id").alias("refers_to_id"), first("uri").alias("refers_to_uri"), first("date").alias("refers_to_date"),
    )


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def _one_line(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(resolved: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the records of :func:`resolve_revisits`, with fresh headers, as WARC files in ``path``; fields of
    their own (``fields``) that are not written anew are kept, and records of other types are as they were."""
    size = F.coalesce("payload_bytes", F.lit(0).cast("long"))
    revisit, http = F.col("record_type") == "revisit", F.col("record_type").isin("response", "revisit") & F.col("http_head").isNotNull()
    head = F.concat(F.col("http_head").cast("string"), F.coalesce(F.concat(F.lit(f"{CRLF}Content-Length: "), F.col("payload_bytes").cast("string")), F.lit("")), F.lit(CRLF * 2))
    head = F.when(http, head).otherwise(F.lit(""))
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("payload").cast("string"), F.lit("")))
    length = F.octet_length(head) + F.when(revisit, F.lit(0)).otherwise(size)
    line = lambda f: F.concat(f["name"], F.lit(": "), f["value"], F.lit(CRLF))
    fields = F.col("fields") if "fields" in resolved.columns else F.array().cast("array<struct<name:string,value:string>>")
    extra = F.array_join(F.transform(F.filter(fields, lambda f: ~F.lower(f["name"]).isin(*_FRESH)), line), "")
    fresh = F.concat(
        _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", F.coalesce("record_id", _urn(F.col("record_key")))), _field("WARC-Date", F.coalesce("date", F.lit(EPOCH))),
        _field("WARC-Target-URI", _one_line(F.col("uri"))), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(revisit, F.col("refers_to_id"))), _field("WARC-Refers-To-Target-URI", _one_line(F.col("refers_to_uri"))), _field("WARC-Refers-To-Date", F.col("refers_to_date")),
        _field("X-Record-Key", F.col("record_key").cast("string")), _field("X-Refers-To-Key", F.col("refers_to").cast("string")), extra,
        F.when(http, F.lit("Content-Type: application/http; msgtype=response" + CRLF)).otherwise(F.lit("Content-Type: application/octet-stream" + CRLF)),
    )
    kept = F.array_join(F.transform(F.filter(fields, lambda f: F.lower(f["name"]) != "content-length"), line), "")
    ours = F.col("record_type").isin("response", "revisit")
    record = F.concat(F.lit("WARC/1.1" + CRLF), F.when(ours, fresh).otherwise(kept), _field("Content-Length", length.cast("string")), F.lit(CRLF), head, body)
    resolved.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _stream(content: memoryview) -> Iterator[bytes]:
    """The bytes of a file, unpacked if it is gzip (of any number of members)."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), _READ):
            yield bytes(content[at : at + _READ])
        return
    unpack = zlib.decompressobj(31)
    for at in range(0, len(content), _READ // 4):
        data = bytes(content[at : at + _READ // 4])
        while data:
            yield unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)


class _Buffer:
    def __init__(self, content: memoryview) -> None:
        self.more, self.held, self.at = _stream(content), bytearray(), 0

    def _fill(self) -> bool:
        data = next(self.more, None)
        if data is None:
            return False
        del self.held[: self.at]
        self.at = 0
        self.held += data
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = self.at
        while (end := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - self.at - len(mark))
            if not self._fill():
                return None
        out = bytes(self.held[self.at : end])
        self.at = end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self._fill():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out

    def skip(self, mark: bytes) -> None:
        """Leaves out ``mark``, as far as it follows before the end."""
        for at in range(len(mark)):
            if self.at == len(self.held) and not self._fill():
                return
            if self.held[self.at] != mark[at]:
                return
            self.at += 1


def parse(content: memoryview | bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Fields in order and block of every record of one file."""
    buf = _Buffer(memoryview(content))
    while (head := buf.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        size = next((int(v) for k, v in fields if k.lower() == "content-length"), None)
        if size is None:
            raise ValueError("a record without Content-Length")
        block = buf.take(size)
        buf.skip(b"\r\n\r\n")
        yield fields, block


def _whole(body: bytes) -> bytes:
    """The payload of a chunked body; one that is cut off gives what is there."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def http_parts(block: bytes) -> tuple[bytes, bytes, int | None, bytes]:
    """Head without its length fields, payload, the length its head states, and the body as it was sent."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    stated, chunked, kept = None, False, lines[:1]
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        name, value = name.strip().lower(), value.strip()
        if name == b"content-length" and value.isdigit():
            stated = int(value)
        elif name == b"transfer-encoding" and value.lower() == b"chunked":
            chunked = True
        elif name not in (b"content-length", b"transfer-encoding"):
            kept.append(line)
    return b"\r\n".join(kept), _whole(body) if chunked else body, stated, body


def _matches(declared: str, data: bytes) -> bool:
    """Whether data has a digest written as algorithm:value, the value in hexadecimal or base 32."""
    name, _, value = declared.partition(":")
    try:
        digest = hashlib.new(name.replace("-", "").lower(), data).digest()
    except (ValueError, TypeError):
        return False
    return value.lower() == digest.hex() or value.rstrip("=").upper() == base64.b32encode(digest).decode().rstrip("=")


def _row(fields: list[tuple[str, str]], block: bytes, with_payload: bool) -> tuple:
    field = {k.lower(): v for k, v in reversed(fields)}
    kind, declared = field.get("warc-type", ""), field.get("warc-payload-digest")
    number = lambda k: int(field[k]) if re.fullmatch(r"-?\d{1,19}", field.get(k, "")) else None
    head, payload, stated, sent = None, block, None, block
    if kind in ("response", "revisit") and field.get("content-type", "application/http").lower().startswith("application/http"):
        head, payload, stated, sent = http_parts(block)
    if kind == "revisit":
        hexed = declared.partition(":")[2] if declared and declared.lower().startswith("sha256:") else declared
        size, digest, ok, payload = stated, hexed, not payload, None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        ok = None if declared is None else _matches(declared, payload) or (sent is not payload and _matches(declared, sent))
        ok = ok if stated is None or ok is None else ok and stated == len(sent)
    return (
        kind, number("x-record-key"), field.get("warc-record-id"), field.get("warc-target-uri"), field.get("warc-date"), head if with_payload else None, size, digest, number("x-refers-to-key"),
        field.get("warc-refers-to"), field.get("warc-refers-to-target-uri"), field.get("warc-refers-to-date"), ok, payload if with_payload else None,
        [{"name": k, "value": v} for k, v in fields] if with_payload else [],
    )


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all files in ``path``.  A revisit's payload is null; its length and digest are
    those its headers declare (null where they do not).  Other records' digests are computed.
    digest_ok: the payload has the declared digest, if there is one, and length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        full = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
        for batch in batches:
            for cell in batch.column(0):
                for fields, block in parse(memoryview(cell.as_buffer())):
                    out.append(_row(fields, block, with_payload))
                    held += len(block) if with_payload else 200
                    if held > 4 * _READ:
                        yield full()
                        out, held = [], 0
        if out:
            yield full()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, HEADER_SCHEMA)


def deduplicate_archive(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Read archives, resolve their responses against each other, the earliest staying, and write them anew
    with their dates and HTTP heads.  Revisits that the source already holds keep their reference, or take
    that of the record they refer to if this has become a revisit; all other records stay as they are."""
    read = materialize(read_archive(spark, source), "records")
    refers = ["refers_to", "refers_to_id", "refers_to_uri", "refers_to_date"]
    fresh = resolve_revisits(read.where("record_type = 'response'").drop("record_type", *refers), min_bytes, ("date", "record_id")).select(_RESOLVED)
    fresh = materialize(fresh, "resolved")
    moved = fresh.where("record_type = 'revisit'").select(F.col("record_id").alias("refers_to_id"), *[F.col(c).alias(f"__{c}") for c in refers])
    old = read.where("record_type = 'revisit'").join(moved, "refers_to_id", "left")
    gone = F.col("__refers_to_id").isNotNull()
    old = old.select(*[F.when(gone, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in refers else F.col(c) for c in _RESOLVED])
    rest = read.where("record_type NOT IN ('response', 'revisit')").select(_RESOLVED)
    write_archive(fresh.unionByName(old).unionByName(rest), target)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(resolve_revisits(records(table(spark, sf_dir, "pages"))), path)
    return read_archive(spark, path, with_payload=False).select(
        F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
