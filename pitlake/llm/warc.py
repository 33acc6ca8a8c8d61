"""Legacy archive conversion: ARC files in, equivalent WARC files out, and both read back by their declared lengths.

An ARC file opens with a version block that says which fields its record lines have; version 1 lines hold five, version 2 lines ten. The converter
reads lines and lengths, synthesises record ids, timestamps, types and digests, and turns later captures of an equal payload into revisits.
Files are gzip streams, written by Spark's text writer with the format's record separator, so they land wherever Spark can write.

Cases: a null url or html is empty, an empty payload is a response of its own; payloads under ``LEAST_REVISIT`` bytes are never revisits. Of equal
payloads the smallest record key is the response (keys are numbers; a null key is the largest), then the first in the archives; so repeated rows are
one response and its revisits. Payloads may hold anything, record separators and header look-alikes included. An empty table gives archives
without records. A line that does not fit the version, or a length that runs past the end of the file, fails with the file's name. Urls, headers and
payloads may be of any length; a task holds one compressed file and one record. The MD5 in version 2 lines is for other readers: SHA-256 digests are
what is checked here. Other columns of the pages are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm.common import as_bytes, row_batches
from pitlake.session import shared_folder, stage

LEAST_REVISIT = 100
# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "20000101000000"
KEY_HEADER = "X-Record-Key"
READ_BLOCK, INFLATED = 1 << 20, 1 << 22
# Both archives are written at zlib's quickest level; the reader takes any.
GZIP_LEVEL = "BEST_SPEED"


def spaceless(value: str, otherwise: str = "-") -> str:
    """A field of a space-separated line: white space and controls are percent-encoded, an empty one is a dash."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) or otherwise


# --- ARC ---------------------------------------------------------------------------------------------------------------------------


def arc_head(name: str, version: int) -> bytes:
    block = f"{version} 0 Archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = ["filedesc://" + name, "0.0.0.0", EPOCH, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return f"{' '.join(values)} {len(block)}\n".encode() + block


def arc_record(version: int, name: str, url: str, key: object, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n"
    if key is not None:
        head += f"{KEY_HEADER}: {key}\r\n"
    content = head.encode() + b"\r\n" + payload
    values = [spaceless(url), "0.0.0.0", EPOCH, "text/html"]
    if version == 2:
        values += ["200", hashlib.md5(payload).hexdigest(), "-", "0", name]
    return f"{' '.join(values)} {len(content)}\n".encode() + content


def write_gzip(records: DataFrame, folder: str, separator: str, level: str) -> None:
    """Records of one binary column as gzip files, one per partition. ``level`` is one of zlib's names (BEST_SPEED to BEST_COMPRESSION)."""
    lines = records.select(F.col(records.columns[0]).cast("string"))
    lines.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", level).text(folder)


def write_arc(pages: DataFrame, folder: str, version: int | None = None, level: str = GZIP_LEVEL) -> None:
    """One ARC file per input partition from (page_id, url, html); ``version`` None alternates between the two by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, kind = f"part-{part:05d}.arc", version or 1 + part % 2
        yield pa.RecordBatch.from_arrays([pa.array([arc_head(name, kind)], pa.binary())], ["value"])
        for batch in row_batches(batches, 64):
            keys, urls, payloads = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([arc_record(kind, name, u, k, p) for k, u, p in zip(keys, urls, payloads, strict=True)], pa.binary())], ["value"])

    write_gzip(pages.select("page_id", F.coalesce("url", F.lit("")), as_bytes("html")).mapInArrow(run, "value binary"), folder, "\n", level)


class Stream:
    """Bytes of a gzip member chain (or of plain bytes), inflated as they are asked for."""

    def __init__(self, name: str, data: bytes):
        self.name, self.data, self.at, self.packed, self.ready, self.place = name, data, 0, b"", bytearray(), 0
        self.inflater = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Take in the next bytes, at most ``INFLATED`` of them however well they are packed."""
        if not self.packed:
            if self.at >= len(self.data):
                return False
            self.packed = self.data[self.at:self.at + READ_BLOCK]
            self.at += len(self.packed)
        if self.inflater is None:
            self.ready += self.packed
            self.packed = b""
            return True
        self.ready += self.inflater.decompress(self.packed, INFLATED)
        self.packed = self.inflater.unconsumed_tail
        if self.inflater.eof:
            self.packed = self.inflater.unused_data
            self.inflater = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next ``mark``, however far it is, which is passed over; None at the end of the file."""
        searched = 0
        while (found := self.ready.find(mark, searched)) < 0:
            searched = max(0, len(self.ready) - len(mark) + 1)
            if not self.more():
                if self.ready.strip():
                    raise ValueError(f"{self.name}: no header ends after byte {self.place}")
                return None
        out = bytes(self.ready[:found])
        self.skip(found + len(mark))
        return out

    def take(self, size: int) -> bytes:
        while len(self.ready) < size:
            if not self.more():
                raise ValueError(f"{self.name}: a record declares {size} bytes after byte {self.place}, {len(self.ready)} are left")
        out = bytes(self.ready[:size])
        self.skip(size)
        return out

    def skip(self, size: int) -> None:
        del self.ready[:size]
        self.place += size

    def pass_over(self, mark: bytes) -> None:
        while len(self.ready) < len(mark) and self.more():
            pass
        if self.ready.startswith(mark):
            self.skip(len(mark))


def arc_records(name: str, data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(fields, offset, content) of the records after the version block."""
    stream, fields = Stream(name, data), None
    while True:
        while stream.ready[:1] == b"\n" or not stream.ready and stream.more():
            if stream.ready[:1] == b"\n":
                stream.skip(1)
        offset = stream.place
        line = stream.until(b"\n")
        if line is None:
            return
        values = line.decode("utf-8", "replace").split(" ")
        if fields is None:
            if not values[0].startswith("filedesc:") or not values[-1].isdigit():
                raise ValueError(f"{name}: no version block")
            block = stream.take(int(values[-1])).decode("utf-8", "replace").split("\n")
            version = int(block[0].split(" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"{name}: version {version}")
            fields = ARC_FIELDS[version]
            continue
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"{name}: the line at byte {offset} does not have the {len(fields)} fields of its version")
        yield dict(zip(fields, values, strict=True)), offset, stream.take(int(values[-1]))


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header block and payload; content without such a block is all payload."""
    if content.startswith(b"HTTP/") and (end := content.find(b"\r\n\r\n")) >= 0:
        return content[:end + 4], content[end + 4:]
    return b"", content


def header_value(block: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", block)
    return found[1].decode("utf-8", "replace") if found else None


def key_of(head: bytes) -> int | None:
    value = header_value(head, KEY_HEADER)
    return int(value) if value is not None and re.fullmatch(r"-?\d+", value) else None


def archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


CAPTURE = "record_key long, file string, place long, payload_bytes long, payload_digest string"


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """What decides types: key, place, size and digest of every ARC record; payloads stay in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in row_batches(batches, 1):
            name = batch.column(0)[0].as_py()
            found = []
            for _, offset, content in arc_records(name, batch.column(1)[0].as_py()):
                head, payload = split_http(content)
                found.append((key_of(head), name, offset, len(payload), hashlib.sha256(payload).hexdigest()))
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in CAPTURE.split(", ")])

    return archives(spark, folder).mapInArrow(run, CAPTURE)


# --- conversion --------------------------------------------------------------------------------------------------------------------


def record_id(file: str, place: int) -> str:
    """The same id for the same ARC record in every run: a name-based UUID of its file's name and offset."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{file.rsplit('/', 1)[-1]}:{place}')}>"


def warc_date(arc_date: str) -> str:
    return datetime.strptime(arc_date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def revisits(found: DataFrame) -> DataFrame:
    """(file, place, first_file, first_place) of captures whose payload an earlier record holds."""
    long_enough = found.where(F.col("payload_bytes") >= LEAST_REVISIT)
    order = F.struct(F.col("record_key").isNull().alias("no_key"), "record_key", "file", "place")
    firsts = long_enough.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    same = (F.col("file") == F.col("first.file")) & (F.col("place") == F.col("first.place"))
    return long_enough.join(firsts, "payload_digest").where(~same).select("file", "place", F.col("first.file").alias("first_file"), F.col("first.place").alias("first_place"))


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, level: str = GZIP_LEVEL) -> None:
    """Write the WARC equivalent of every ARC file below ``arc_folder``.

    Which records are revisits is decided from digests alone. The revisits of a file, a list of offsets, are sorted beside its content, so
    payloads are never shuffled.
    """
    later = stage(revisits(stage(captures(spark, arc_folder), "captures")), "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, 1):
            name, data, marks = (batch.column(i)[0].as_py() for i in range(3))
            first_of = {m["place"]: (m["first_file"], m["first_place"]) for m in marks or []}
            yield values([warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", warc_date(EPOCH)), ("Content-Type", "application/warc-fields")],
                                      b"software: pitlake\r\nformat: WARC File Format 1.1\r\n")])
            for fields, offset, content in arc_records(name, data):
                head, payload = split_http(content)
                first = first_of.get(offset)
                block = head if first else content
                headers = [
                    ("WARC-Type", "revisit" if first else "response" if head else "resource"), ("WARC-Record-ID", record_id(name, offset)),
                    ("WARC-Date", warc_date(fields["Archive-date"])), ("WARC-Target-URI", fields["URL"]), ("WARC-IP-Address", fields["IP-address"]),
                    ("Content-Type", "application/http;msgtype=response" if head else fields["Content-type"]),
                    ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest())]
                if first:
                    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*first))]
                yield values([warc_record(headers, block)])

    def values(records: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["value"])

    marks = later.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("place", "first_file", "first_place")).alias("marks"))
    files = archives(spark, arc_folder)
    records = files.join(F.broadcast(marks) if not later.take(1) else marks, "path", "left").select("path", "content", "marks").mapInArrow(run, "value binary")
    write_gzip(records, warc_folder, "\r\n\r\n", level)


# --- WARC --------------------------------------------------------------------------------------------------------------------------


def warc_records(name: str, data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header block, block) of every record, by declared length."""
    stream = Stream(name, data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record before byte {stream.place}")
        yield head, stream.take(int(header_value(head, "Content-Length") or 0))
        stream.pass_over(b"\r\n\r\n")


RECORD = "record_id string, record_type string, record_date string, target_uri string, refers_to_id string, record_key long, payload_bytes long, payload_digest string, intact boolean"


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Records of WARC files (warcinfo left out). ``intact``: the block has the digest its header states."""
    schema = RECORD + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string(), pa.bool_()] + [pa.binary()] * with_payload
        for batch in row_batches(batches, 1):
            out = []
            for head, block in warc_records(batch.column(0)[0].as_py(), batch.column(1)[0].as_py()):
                kind = header_value(head, "WARC-Type")
                if kind == "warcinfo":
                    continue
                http, payload = split_http(block)
                stated = (header_value(head, "WARC-Payload-Digest") or "").removeprefix("sha256:")
                whole = kind != "revisit"
                digest = hashlib.sha256(payload).hexdigest() if whole else stated
                size = len(payload) if whole else int(header_value(http, "Content-Length") or 0)
                intact = "sha256:" + hashlib.sha256(block).hexdigest() == header_value(head, "WARC-Block-Digest") and digest == stated
                out.append((header_value(head, "WARC-Record-ID"), kind, header_value(head, "WARC-Date"), header_value(head, "WARC-Target-URI"), header_value(head, "WARC-Refers-To"),
                            key_of(http), size, digest, intact, *([payload] * with_payload)))
                if len(out) >= 256 or with_payload and len(payload) > 1 << 22:
                    yield table_of(out, kinds)
                    out = []
            if out:
                yield table_of(out, kinds)

    def table_of(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return archives(spark, folder).mapInArrow(run, schema)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as ARC files, convert them, read the WARC files back: page_id, payload_bytes, payload_digest, record_type, refers_to, and more."""
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    records = stage(read_warc(spark, warc), "records")
    referred = records.where("record_type = 'revisit'").join(
        records.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("record_key").alias("refers_to")), "refers_to_id", "left")
    plain = records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.unionByName(referred).select(
        F.col("record_key").cast(pages.schema["page_id"].dataType).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "record_date", "target_uri", "intact")
