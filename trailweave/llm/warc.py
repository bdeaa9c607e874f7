"""WARC archives: a sink and a splittable source for Spark, one gzip member a record.

The source cuts files into byte ranges without looking inside. A task looks for the magic number of gzip in its range,
takes a place for the start of a member only if it unpacks to the head of a WARC record, and owns the records that
start in its range; it reads beyond the range to end the last one. A place that should be a record and isn't whole
is told (option mode). Files are opened by pyarrow's file systems, so the folder may be any that they know; only names
that the job committed are visible. Which payloads repeat is found from digests and numbers alone; then each payload
is shuffled once, by its digest, at every size."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..sources.shared import new_path
from .common import file_system, pieces, spread_join

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES, CHUNK_BYTES, FILE_BYTES, BATCH_BYTES = 16 << 20, 1 << 18, 128 << 20, 4 << 20
#: Seconds are of no interest to what is tested, so all records carry one date; a fixed value.
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
COMMITTED = "_committed"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing ------------------------------------------------------------------------------------------------------------


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None, digest: str) -> bytes:
    """A WARC/1.1 record as a gzip member. A revisit has the head of the response, but no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if record_type == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def committed(fs: pafs.FileSystem, root: str) -> dict[str, list[str]]:
    """The lists of the jobs that have written to a folder, by their paths: the names of their files."""
    lists = {}
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(COMMITTED):
            with fs.open_input_stream(info.path) as f:
                lists[info.path] = json.loads(f.read())
    return lists


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own; commit() lists those of the attempts that count."""

    def __init__(self, path: str, file_bytes: int, overwrite: bool = False) -> None:
        self.path, self.file_bytes, self.overwrite = path, file_bytes, overwrite

    def write(self, iterator: Iterator) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        rows = (row for batch in pieces(iterator, 100) for row in batch.to_pylist())
        for row in rows:
            if out is None or size >= self.file_bytes:
                if out is not None:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
            data = record(row["page_id"], row["url"], bytes(row["payload"] or b""), row["record_type"], row["refers_to"], row["payload_digest"])
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        """A list for each job: readers take what all of them name. Where the job overwrites, earlier ones go with it."""
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        before = committed(fs, root) if self.overwrite else {}
        with fs.open_output_stream(f"{root}/{COMMITTED}-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(sorted(name for m in messages if m for name in m.names)).encode())
        for path in [*before, *(f"{root}/{name}" for names in before.values() for name in names)]:
            fs.delete_file(path)

    def abort(self, messages: list) -> None:
        fs, root = file_system(self.path)
        for name in (name for m in messages if m for name in m.names):
            fs.delete_file(f"{root}/{name}")


# Reading ------------------------------------------------------------------------------------------------------------


@dataclass
class ByteRange(InputPartition):
    name: str
    start: int
    end: int


class Window:
    """A file from some place on, read in chunks; what is behind is let go."""

    def __init__(self, file: pa.NativeFile, start: int) -> None:
        self.file, self.at, self.data = file, start, bytearray()
        file.seek(start)

    def more(self) -> bool:
        chunk = self.file.read(CHUNK_BYTES)
        self.data += chunk
        return bool(chunk)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _unpacked(window: Window, least: int | None) -> tuple[bytes, int] | None:
    """The member at the window's beginning, unpacked: its first `least` bytes or those before it is damaged (None:
    all) and how long it is packed. None if there is no whole member."""
    packed, used, out = zlib.decompressobj(31), 0, bytearray()
    try:
        while not packed.eof and (least is None or len(out) < least):
            if used == len(window.data) and not window.more():
                break
            piece = bytes(window.data[used : used + (CHUNK_BYTES if least is None else 1 << 12)])
            used += len(piece)
            out += packed.decompress(piece)
    except zlib.error:
        return (bytes(out), 0) if least is not None else None
    if least is not None:
        return bytes(out), 0
    return (bytes(out), used - len(packed.unused_data)) if packed.eof else None


def is_record(window: Window) -> bool:
    """Whether the member at the window's beginning unpacks to the head of a WARC record, however long that is."""
    least = 1 << 12
    while (got := _unpacked(window, least)) is not None and re.match(rb"WARC/\d+\.\d+\r\n", got[0]):
        head, ended, _ = got[0].partition(b"\r\n\r\n")
        if ended:
            return re.search(rb"(?i)\r\nWARC-Type:", head) is not None
        if len(got[0]) < least:  # damaged within its head
            return True
        least *= 4
    return False


def members(file: pa.NativeFile, start: int, end: int, mode: str = "FAILFAST") -> Iterator[bytes | int]:
    """The unpacked records that start from start on and before end. Where a member should be, at the file's beginning,
    after a member or where a record's head unpacks, and no whole record is, FAILFAST raises; PERMISSIVE gives how
    many bytes were passed over, a number in place of a record; DROPMALFORMED gives nothing."""
    window, expected, lost = Window(file, start), start == 0, None
    while window.at < end:
        while len(window.data) < len(MAGIC) and window.more():
            pass
        if not window.data:
            break
        head = window.data.startswith(MAGIC) and is_record(window)
        if head and (got := _unpacked(window, None)):
            if lost is not None:
                yield window.at - lost
                lost = None
            yield got[0]
            window.drop(got[1])
            expected = True
            continue
        if head or expected:
            if mode == "FAILFAST":
                raise ValueError(f"no whole WARC record at byte {window.at}")
            lost = window.at if lost is None and mode == "PERMISSIVE" else lost
        expected = False
        found = window.data.find(MAGIC, 1)
        # The last bytes may be the beginning of a magic number that the next chunk ends.
        window.drop(found if found > 0 else max(1, len(window.data) - len(MAGIC) + 1))
    if lost is not None:
        yield min(window.at, end) - lost


def parsed(data: bytes) -> tuple:
    """A record as a row of RECORDS. The digest of a response is taken from its payload, that of a revisit is told.
    Records of others may lack what ours have: without a length that can be read, the block is all that follows."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    told = fields.get("content-length", "")
    block = rest[: int(told)] if re.fullmatch(r"[0-9]+", told) else rest.removesuffix(b"\r\n\r\n")
    http, split, payload = block.partition(b"\r\n\r\n")

    def number(name: str) -> int | None:
        found = re.search(r"urn:x-page:(-?\d{1,19})>", fields.get(name, ""))
        value = int(found[1]) if found else None
        return value if value is not None and -(1 << 63) <= value < 1 << 63 else None

    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    length = re.search(rb"(?i)content-length: *(\d{1,18})", http)
    if kind == "response":
        payload = payload if split else block
        return number("warc-record-id"), fields.get("warc-target-uri"), kind, None, digest_of(payload), len(payload), payload
    return number("warc-record-id"), fields.get("warc-target-uri"), kind, number("warc-refers-to"), digest, int(length[1]) if length else None, None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, mode: str) -> None:
        self.path, self.range_bytes, self.mode = path, range_bytes, mode

    def partitions(self) -> list[ByteRange]:
        fs, root = file_system(self.path)
        lists = committed(fs, root)
        if lists:
            infos = fs.get_file_info([f"{root}/{name}" for names in lists.values() for name in names])
        else:
            infos = [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.path.endswith(".warc.gz")]
        return [ByteRange(i.path, at, min(at + self.range_bytes, i.size)) for i in infos for at in range(0, i.size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, _ = file_system(self.path)
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        with fs.open_input_file(partition.name) as f:
            for data in members(f, partition.start, partition.end, self.mode):
                if isinstance(data, int):
                    rows.append((None, None, "damaged", None, None, data, None))
                    continue
                rows.append(parsed(data))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


class WarcSource(DataSource):
    """format("warc"): load(path) reads RECORDS, save(path) writes them. Options: range_bytes, file_bytes, and mode for
    what is damaged: FAILFAST (the default), DROPMALFORMED, or PERMISSIVE, by which each damaged stretch is a row of
    record_type damaged, with its length as payload_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> WarcReader:
        mode = self.options.get("mode", "FAILFAST").upper()
        if mode not in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
            raise ValueError(f"no such mode: {mode}")
        return WarcReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), mode)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)), overwrite)


def as_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A row of RECORDS for every row of pages (page_id, url, html, ...).

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of least_bytes or more, that of the
    smallest page_id is the response and others revisit it; rows that share this page_id are all responses. A row
    without page_id revisits one that has; where none has, all are responses. An empty table gives no record; other
    columns are ignored, whatever their names; a payload of any length is one row."""
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    size = F.octet_length("payload")
    again = rows.filter(size >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    joined = spread_join(rows, again, ["sha1"], [F.col("page_id")])
    revisit = (size >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kept = F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response")
    return joined.select("page_id", "url", kept.alias("record_type"), F.when(kept == "revisit", F.col("first")).alias("refers_to"), _base32(F.col("sha1")).alias("payload_digest"), size.cast("bigint").alias("payload_bytes"), "payload")


def _base32(sha1):
    """RFC 4648's base 32 of 20 bytes: eight groups of 20 bits, four letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    text = F.hex(sha1)
    groups = [F.conv(F.substring(text, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*(F.substr(letters, F.shiftright(g, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    pages.sparkSession.dataSource.register(WarcSource)
    as_records(pages, least_bytes).write.format("warc").mode("append").save(path)


def read(spark, path: str, **options) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes archives into the shared folder and reads them back: (page_id, payload_bytes, payload_digest,
    record_type, refers_to) by record. The archives go with the driver, or with the released() block around.

    One row for every row of pages, repeated ones too; null and empty html, null numbers and addresses, payloads of any
    length, empty tables and other columns are as in as_records()."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with hashed as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as sha1 from pages),
firsts as (select *, min(page_id) over (partition by sha1) as first from hashed),
digits as (
  select *, list_transform(range(0, 8), lambda g: list_reduce(list_transform(range(1, 6), lambda k: (instr('0123456789abcdef', sha1[5 * g + k]) - 1)::bigint), lambda x, y: x * 16 + y)) as groups from firsts)
select page_id, payload_bytes,
  array_to_string(list_transform(groups, lambda v: concat('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 15) & 31) + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 10) & 31) + 1],
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 5) & 31) + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v & 31) + 1])), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from digits
"""
