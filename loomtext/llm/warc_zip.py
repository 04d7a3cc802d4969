"""WARC records in ZIP archives: written as stored members, read by range without extraction.

An archive is a ZIP file whose members are all *stored*: ``archive/data.warc.gz`` (one gzip
member for each record), ``indexes/index.jsonl`` (one line for each record: id, kind,
offset and length in the data member) and ``datapackage.json``.  The writer always adds
ZIP64 fields.  The reader finds the end record from the tail of the file, follows the
ZIP64 locator, parses the central directory, places a member by its local header, reads
the index and then reads records by range, so archives of any size are split by records.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, fresh_path, materialise

#: A writer starts a new archive beyond this many bytes of data; a reader takes ranges up to so many bytes.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Digests that may be broadcast (64 bytes each), and most tasks that read archives.
BROADCAST_DIGESTS, MOST_TASKS = 300_000, 20_000
#: Payloads of at least this size may be recorded as a revisit of an equal one.
LEAST_REVISIT = 1000
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.jsonl", "datapackage.json"
#: Fixed values of the ZIP format.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
_DOS_TIME, _DOS_DATE = 0, (1 << 5) | 1


@dataclass(frozen=True)
class Member:
    """An entry of the central directory."""

    name: str
    method: int
    crc: int
    packed: int
    size: int
    header_at: int


class ZipWriter:
    """Writes stored members one after another to a stream, without seeking back: sizes follow in data descriptors."""

    def __init__(self, stream):
        self.stream, self.at, self.members = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.header_at, self.crc = name, self.at, 0
        raw = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, _DOS_TIME, _DOS_DATE, 0, _MAX32, _MAX32, len(raw), len(extra)) + raw + extra)
        self.data_at = self.at

    def write(self, data: bytes) -> int:
        """Adds bytes to the open member and returns their offset in it."""
        offset = self.at - self.data_at
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)
        return offset

    def end(self) -> None:
        size = self.at - self.data_at
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, size, size))
        self.members.append(Member(self.name, 0, self.crc, size, size, self.header_at))

    def close(self) -> int:
        """Writes the central directory, the ZIP64 end record and locator and the end record; returns the file size."""
        start = self.at
        for m in self.members:
            raw = m.name.encode()
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.packed, m.header_at)
            self._put(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, _DOS_TIME, _DOS_DATE, m.crc, _MAX32, _MAX32, len(raw), len(extra), 0, 0, 0, 0, _MAX32) + raw + extra)
        size, end64 = self.at - start, self.at
        n = len(self.members)
        self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(_LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0))
        return self.at


class ZipReader:
    """Reads the directory of a ZIP file, with or without ZIP64 fields, and ranges of its stored members."""

    def __init__(self, file, size: int):
        self.file, self.file_size = file, size
        self.members = {m.name: m for m in self._directory()}

    def read_at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.file_size - 22 - _MAX16 - 20)
        tail = self.read_at(tail_at, self.file_size - tail_at)
        found = tail.rfind(_END)
        while found >= 0:  # a comment may hold the signature; the true record's comment ends with the file
            if len(tail) - found >= 22 and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
                break
            found = tail.rfind(_END, 0, found)
        if found < 0:
            raise ValueError("not a ZIP file: no end record")
        count, size, start = struct.unpack_from("<HII", tail, found + 10)
        locator = tail[found - 20:found] if found >= 20 else b""
        if locator[:4] == _LOCATOR64:
            record = self.read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != _END64:
                raise ValueError("the ZIP64 end record is missing")
            count, size, start = struct.unpack_from("<QQQ", record, 32)
        raw, at, out = self.read_at(start, size), 0, []
        for _ in range(count):
            if raw[at:at + 4] != _CENTRAL:
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", raw, at + 16)
            header_at = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + n_name:at + 46 + n_name + n_extra]
            if _MAX32 in (packed, full, header_at):
                full, packed, header_at = self._wide(extra, full, packed, header_at)
            out.append(Member(name, method, crc, packed, full, header_at))
            at += 46 + n_name + n_extra + n_comment
        return out

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values of 32 bits, with those that are all ones taken from the ZIP64 extra field in turn."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
                return [next(wide) if v == _MAX32 else v for v in values]
            at += 4 + size
        raise ValueError("a ZIP64 field is missing")

    def data_at(self, name: str) -> int:
        """Where the bytes of a stored member start."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is compressed by the archive; only stored members are read by range")
        header = self.read_at(m.header_at, 30)
        if header[:4] != _LOCAL:
            raise ValueError(f"{name} has no local header")
        n_name, n_extra = struct.unpack_from("<HH", header, 26)
        return m.header_at + 30 + n_name + n_extra

    def read(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        m = self.members[name]
        return self.read_at(self.data_at(name) + offset, m.size - offset if size is None else min(size, m.size - offset))


def warc_record(kind: str, record_id: str, url: str, payload: bytes, digest: bytes, refers_to: str | None) -> bytes:
    """A WARC 1.1 record with an HTTP block; a revisit keeps the HTTP header and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join(url.split())), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
    ]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (both with lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}, payload


class ArchiveWriter:
    """Writes records to archives of bounded size under names that no other task attempt uses."""

    def __init__(self, folder: str):
        self.fs, self.root = file_system(folder)
        self.folder, self.open, self.done = folder, None, []

    def add(self, page_id: int | None, kind: str, raw: bytes) -> None:
        if self.open is None:
            name = f"{uuid.uuid4().hex}.wacz"
            self.name, self.stream = name, self.fs.open_output_stream(f"{self.root}/{name}")
            self.open, self.index = ZipWriter(self.stream), []
            self.open.begin(DATA)
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        at = self.open.write(packed)
        self.index.append(json.dumps([page_id, kind, at, len(packed)]))
        if at > ARCHIVE_BYTES:
            self.finish()

    def finish(self) -> None:
        if self.open is None:
            return
        self.open.end()
        for name, text in ((INDEX, "\n".join(self.index)), (PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))):
            self.open.begin(name)
            self.open.write(text.encode())
            self.open.end()
        size = self.open.close()
        self.stream.close()
        self.done.append((self.name, size, len(self.index)))
        self.open = None


def plan_revisits(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Adds ``payload`` (null html: no bytes), its ``digest`` and ``refers_to``, the response that a revisit refers to.

    Of equal payloads of at least ``least`` bytes the largest key is the response.  Only
    digests that occur twice are of interest, found with counts from each task.  Up to
    ``BROADCAST_DIGESTS`` of them are broadcast and no payload moves; beyond it the large
    payloads meet them in a join that can be split where a digest is very common, and the
    small ones stay where they are.  Null keys sort lowest and are never referred to unless alone.
    """
    rows = pages.withColumn("payload", F.coalesce(F.col(html), F.lit("")).cast("binary"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    groups = rows.where(large).groupBy("digest").agg(F.max(key).alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("same"), "response")
    groups = materialise(groups, "warc-digests")
    if groups.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(groups), (F.col("digest") == F.col("same")) & large, "left")
    else:
        joined = rows.where(large).join(groups, F.col("digest") == F.col("same"), "left").unionByName(rows.where(~large), allowMissingColumns=True)
    return joined.withColumn("refers_to", F.when(~F.col(key).eqNullSafe(F.col("response")), F.col("response"))).drop("same", "response")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes one WARC record for each row and returns the manifest: ``archive``, ``bytes``, ``records``.

    Only archives of attempts that succeeded are in the manifest, which is written to the
    shared folder at once; files of lost attempts stay unlisted.
    """
    planned = plan_revisits(pages.select(key, url, html), key, html).select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), "payload", F.unhex("digest").alias("digest"), F.col("refers_to").cast("bigint").alias("refers_to"))
    spark = pages.sparkSession
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder)
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, at, payload, digest, other = (x.as_py() for x in row)
                kind = "response" if other is None else "revisit"
                writer.add(page, kind, warc_record(kind, "" if page is None else str(page), at or "", payload, digest, None if other is None else str(other)))
        writer.finish()
        if writer.done:
            names, sizes, counts = zip(*writer.done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["archive", "bytes", "records"])

    return materialise(planned.mapInArrow(run, "archive string, bytes bigint, records bigint"), "warc-manifest")


def archive_ranges(manifest: DataFrame, folder: str) -> DataFrame:
    """Ranges of whole records in each archive, from its directory and index member alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['archive']}") as f:
                    reader = ZipReader(f, row["bytes"])
                    start, index = reader.data_at(DATA), reader.read(INDEX)
                out, first, end, sizes = [], None, 0, []
                for line in index.splitlines():
                    _, _, at, size = json.loads(line)
                    if first is not None and at + size - first > RANGE_BYTES:
                        out.append((row["archive"], start + first, end - first, sizes))
                        first = None
                    if first is None:
                        first, sizes = at, []
                    sizes.append(size)
                    end = at + size
                if first is not None:
                    out.append((row["archive"], start + first, end - first, sizes))
                if out:
                    names, ats, lengths, records = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ats, pa.int64()), pa.array(lengths, pa.int64()), pa.array(records, pa.list_(pa.int64()))], names=["archive", "at", "size", "records"])

    return manifest.select("archive", "bytes").mapInArrow(run, "archive string, at bigint, size bigint, records array<bigint>")


def read_archives(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """One row for each record, read by range.

    ``payload_bytes`` and ``payload_digest`` are of the full payload; for a response both
    are taken from the bytes read and the stored digest must agree, for a revisit they
    come from its header.  ``payload`` is null for revisits and left out if not asked for.
    There is a task for each ``RANGE_BYTES`` of archives, ``MOST_TASKS`` at most.
    """
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string" + ", payload binary" * payload

    def number(name: str | None) -> int | None:
        own = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(own) if own else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['archive']}") as f:
                    f.seek(row["at"])
                    raw, at, out = f.read(row["size"]), 0, []
                for size in row["records"]:
                    fields, http, body = parse_record(zlib.decompress(raw[at:at + size], 31))
                    at += size
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if (kind := fields["warc-type"]) == "response":
                        n = len(body)
                        if hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{row['archive']}: a payload differs from its digest")
                    else:
                        n = int(http["content-length"])
                    out.append((number(fields["warc-record-id"]), fields["warc-target-uri"], kind, number(fields.get("warc-refers-to")), n, digest, *([body if kind == "response" else None] * payload)))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] * payload)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] * payload)])

    size, n = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    spread = lambda tasks: max(1, min(MOST_TASKS, tasks))
    ranges = archive_ranges(manifest.repartition(spread(n), "archive"), folder)
    return ranges.repartition(spread(-(-size // RANGE_BYTES)), F.col("archive"), F.col("at")).mapInArrow(run, schema)


def through_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", payload: bool = False) -> DataFrame:
    """Writes all rows as archives in the shared folder and reads them back.

    Null html counts as the empty payload, a null key comes back null, an empty table makes
    no archive and no rows, and rows that repeat a key are written once for each row.  Of
    equal payloads with the largest key more than once each row of that key is a response.
    Only the three named columns are read.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, key, url, html), folder, payload)
