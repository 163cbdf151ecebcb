"""WARC archives as a Spark data source, format "warc".

Reading plans file partitions (small files together), takes predicates on header columns, and parses a record's headers
first: what doesn't match is skipped, by its length in plain files and by the length that the gzip member's "sl" field
gives in compressed ones, so its payload is neither read nor inflated. Writing makes one gzip member a record; each
attempt writes files of its own, and a manifest written on commit names those that count.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from trackmotif.llm import storage
from trackmotif.session import scratch_dir, ship_package

SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, refers_to string, payload_length long, payload binary, error string"
_FIELDS = pa.schema([*((n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "content_type", "payload_digest", "refers_to")), ("payload_length", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
# Header names of the columns; the profile of a revisit; the length field's gzip subfield.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
PARTITION_BYTES, BATCH_BYTES, HEAD_BYTES = 64 << 20, 8 << 20, 4096
MANIFEST = "_manifest-"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """Header values hold no control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(data: bytes) -> bytes:
    """One gzip member whose extra field tells its length and that of its content, unless it has 4 GB or more."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF) if size < 1 << 32 else b""  # the field has 32 bits
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, payload: bytes, digest: str, target_uri: str | None, date: str, refers_to: str | None = None, content_type: str = "text/html; charset=utf-8") -> bytes:
    """A response with an HTTP head and its payload, or a revisit with the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {_clean(content_type)}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {_clean(date)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(target_uri)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_clean(refers_to or '')}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    found: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return found


def _columns(headers: dict[str, str]) -> dict[str, str | None]:
    row = {c: headers.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c].strip("<>") if row[c] is not None else None
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    return row


def _length(headers: dict[str, str]) -> int:
    size = headers.get("content-length", "")
    if not size.isdecimal():
        raise ValueError(f"a record has no length: {size!r}")
    return int(size)


def _plain_records(f: pa.NativeFile, wanted, whole: bool) -> Iterator[tuple[dict, bytes, int]]:
    """Header columns, block and its length, of each wanted record of an uncompressed file. Without ``whole`` a block's
    first ``HEAD_BYTES`` are all that is read of it."""
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        head = f.read(HEAD_BYTES)
        while (k := head.find(b"\r\n\r\n")) < 0:
            more = f.read(HEAD_BYTES)
            if not more:
                if head.strip(b"\r\n"):
                    raise ValueError("a record's headers don't end")
                return
            head += more
        headers = _parse_head(head[:k])
        size, start = _length(headers), at + k + 4
        if start + size > end:
            raise ValueError("a record is cut short")
        if wanted(row := _columns(headers)):
            f.seek(start)
            yield row, f.read(size if whole else min(size, HEAD_BYTES)), size
        at = start + size + 4


def _packed_records(f: pa.NativeFile, wanted, whole: bool) -> Iterator[tuple[dict, bytes, int]]:
    """The same of a file of gzip members, of one record or several. Members that state their length (sl) have one record,
    and are inflated no further than needed; of others, what isn't needed is inflated to find their end, and not kept."""
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        raw = f.read(HEAD_BYTES)
        size = None
        if len(raw) > 24 and raw[3] & 4 and raw[12:14] == b"sl":
            size = struct.unpack_from("<I", raw, 16)[0]
        unpack, fresh = zlib.decompressobj(31), raw
        data = b""

        def more(least: int) -> None:
            """Inflate until there are so many bytes, or the member ends."""
            nonlocal data, fresh
            parts, have = [data], len(data)
            while have < least and not unpack.eof:
                if not fresh and not (fresh := f.read(1 << 16)):
                    raise ValueError("a gzip member is cut short")
                parts.append(got := unpack.decompress(fresh, max(HEAD_BYTES, least - have)))
                have += len(got)
                fresh = unpack.unconsumed_tail
            data = b"".join(parts)

        while True:
            more(4)
            while (k := data.find(b"\r\n\r\n")) < 0 and not unpack.eof:
                more(len(data) + HEAD_BYTES)
            if k < 0:
                if data.strip(b"\r\n"):
                    raise ValueError("a record's headers don't end")
                break
            headers = _parse_head(data[:k])
            length = _length(headers)
            if wanted(row := _columns(headers)):
                more(k + 4 + (length if whole else min(length, HEAD_BYTES)))
                block = data[k + 4 : k + 4 + length]
                if len(block) < (length if whole else min(length, HEAD_BYTES)):
                    raise ValueError("a record is cut short")
                yield row, block, length
            if size:
                break
            left = k + 4 + length + 4
            while len(data) < left and not unpack.eof:
                left -= len(data)
                data = b""
                more(min(left, 1 << 20))
            data = data[left:]
        if size:
            at += size
        else:
            while not unpack.eof:
                data = b""
                more(1 << 20)
            at = f.tell() - len(unpack.unused_data)


def _matches(row: dict, filters: list[tuple[str, str, object]]) -> bool:
    for column, test, value in filters:
        x = row[column]
        if test == "null":
            if (x is None) != value:
                return False
        elif x is None or (test == "in" and x not in value) or (test == "starts" and not x.startswith(value)):
            return False
    return True


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    """Options: path; payload = "full", "digest" (digest and length computed from what is read, no bytes) or "none" (the
    length that headers state; no payload is read or inflated whole); mode = "fail", where a malformed record or one
    without a length ends the job, or "permissive", where it gives one row with nothing but ``error`` (all headers null, for
    filters too), and the rest of its file is given up. A file is one task's: gzip members can't be found from the middle."""

    def __init__(self, options: dict[str, str]):
        self.path, self.payload, self.mode, self.filters = options["path"], options.get("payload", "full"), options.get("mode", "fail"), []
        if self.mode not in ("fail", "permissive"):
            raise ValueError("mode must be fail or permissive")
        if self.payload not in ("full", "digest", "none"):
            raise ValueError("payload must be full, digest or none")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Spark doesn't test again what is taken, so only columns that are what the header says, error rows included."""
        header = {c for c in HEADERS if c != "payload_digest" or self.payload != "digest"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in header and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.filters.append((column, "in", (f.value,)))
            elif column in header and isinstance(f, In):
                self.filters.append((column, "in", tuple(f.value)))
            elif column in header and isinstance(f, StringStartsWith):
                self.filters.append((column, "starts", f.value))
            elif column in header and isinstance(f, IsNull | IsNotNull):
                self.filters.append((column, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, path = storage.resolve(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [Files([self.path])]
        sizes = {i.base_name: i.size for i in system.get_file_info(fs.FileSelector(path))}
        names = [n for n in sizes if n.endswith((".warc", ".warc.gz"))]
        if manifests := [n for n in sizes if n.startswith(MANIFEST)]:
            named: set[str] = set()
            for m in manifests:
                with storage.open_file(f"{self.path}/{m}") as f:
                    named |= set(json.loads(f.read()))
            names = [n for n in names if n in named]
        out: list[Files] = []
        room = 0
        for n in sorted(names):
            if room < sizes[n] or not out:
                out.append(Files([]))
                room = PARTITION_BYTES
            out[-1].paths.append(f"{self.path}/{n}")
            room -= sizes[n]
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        """Without any file Spark asks once, with no partition."""
        rows: list[dict] = []
        held = 0
        for path in partition.paths if partition else []:
            try:
                with storage.open_file(path) as f:
                    f.seek(0)
                    records = _packed_records if f.read(2) == b"\x1f\x8b" else _plain_records
                    for row, block, length in records(f, lambda r: _matches(r, self.filters), self.payload != "none"):
                        rows.append(self._row(row, block, length))
                        held += len(row["payload"] or b"") + 300
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)
                            rows, held = [], 0
            except (ValueError, zlib.error) as e:
                if self.mode == "fail":
                    raise ValueError(f"{path}: {e}") from e
                if _matches(dict.fromkeys(HEADERS), self.filters):
                    rows.append({"error": f"{path}: {e}"})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    def _row(self, row: dict, block: bytes, length: int) -> dict:
        """A response's payload follows the HTTP head; a revisit has the length of what it refers to in its head."""
        head, gap, payload = block.partition(b"\r\n\r\n") if block[:5] == b"HTTP/" else (b"", b"", block)
        declared = [h.partition(b":")[2].strip() for h in head.split(b"\r\n") if h.lower().startswith(b"content-length:")]
        row["payload"] = None
        if row["record_type"] == "revisit":
            row["payload_length"] = int(declared[0]) if declared and declared[0].isdigit() else None
            return row
        row["payload_length"] = length - len(head) - len(gap)
        if self.payload == "digest":
            row["payload_digest"] = digest_of(payload)
        elif self.payload == "full":
            row["payload"] = payload
        return row


@dataclass
class Written(WriterCommitMessage):
    name: str


class Writer(DataSourceArrowWriter):
    """Rows of record_type, record_id, target_uri, date, payload_digest (bare base32), refers_to and payload."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, wrote = f"part-{uuid.uuid4().hex}.warc.gz", False
        with storage.create(f"{self.path}/{name}") as out:
            for batch in iterator:
                columns = [batch.column(n) for n in ("record_type", "record_id", "payload", "payload_digest", "target_uri", "date", "refers_to")]
                for values in zip(*columns, strict=True):
                    kind, record_id, payload, digest, uri, date, refers_to = (v.as_py() for v in values)
                    payload = payload or b""
                    out.write(member(record(kind, record_id, payload, digest or digest_of(payload), uri, date or DATE, refers_to)))
                    wrote = True
        return Written(name if wrote else "")

    def commit(self, messages: list[Written | None]) -> None:
        with storage.create(f"{self.path}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([m.name for m in messages if m and m.name]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that no manifest names are never read."""


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read(spark: SparkSession, path: str, payload: str = "full", mode: str = "fail") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).option("mode", mode).load(path)


def _base32(hexadecimal: F.Column) -> F.Column:
    """40 hexadecimal digits as 32 base32 characters, five digits to four characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def group(k: F.Column) -> F.Column:
        n = F.conv(F.substring(hexadecimal, 5 * k + 1, F.lit(5)), 16, 10).cast("int")
        one = lambda shift: F.substring(F.lit(letters), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
        return F.concat(one(15), one(10), one(5), one(0))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), "")


def archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of page_id, url, html. Of equal payloads of ``min_bytes`` or more, that with the
    smallest page_id is a response and others revisit it; smaller ones, and rows with a null page_id, are responses.

    Null html counts as empty; a null url gives no target; rows with one page_id and payload are written alike.
    """
    register(pages.sparkSession)
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    again = (F.col("page_id") != F.col("first")) & (F.octet_length("payload") >= min_bytes)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    records = rows.join(first, "sha").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        name("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.lit("text/html").alias("content_type"),
        _base32(F.col("sha")).alias("payload_digest"),
        F.when(again, name("first")).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        "payload",
        F.lit(None).cast("string").alias("error"),
    )
    records.write.format("warc").mode("append").save(path)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write all pages to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    archive(pages, path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return read(spark, path, "digest").select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


ORACLE_SQL = """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS sha FROM page),
first AS (SELECT sha, min(page_id) AS first FROM sized GROUP BY sha),
digit AS (SELECT sha, g, sum((position(substr(sha, g * 5 + k, 1) IN '0123456789abcdef') - 1) * (16 ** (5 - k))::BIGINT)::BIGINT AS n
  FROM (SELECT DISTINCT sha FROM sized), range(0, 8) a(g), range(1, 6) b(k) GROUP BY sha, g),
coded AS (SELECT sha, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n // (32 ** (3 - c))::BIGINT) % 32 + 1)::INT, 1), '' ORDER BY g, c) AS payload_digest FROM digit, range(0, 4) t(c) GROUP BY sha)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM sized JOIN first USING (sha) JOIN coded USING (sha)
"""
