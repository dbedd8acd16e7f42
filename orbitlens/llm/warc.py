"""WARC archives as a PySpark data source, reader and writer.

Files written here hold one gzip member a record, with the member's compressed length in the gzip header's extra field `sl`, so a reader goes from record to record without
inflating what it skips.  Partitions are planned from the files that a finished write has listed; a folder without such a list is one of other makers' archives, and each of its
.warc and .warc.gz files is a partition, read record by record whether it is plain, one member a record or one for all.  Filters on record_type and the header columns are pushed down:
the headers are parsed first, and only a record that passes has its payload decoded, if payloads are asked for at all.

Paths are Hadoop-style URIs that pyarrow opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import saved, scratch, scratch_path, table

#: Bytes after which a writer opens its next file.
FILE_BYTES = 256 << 20
#: Least payload that a revisit record may stand for.
LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
_HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
MANIFEST = "_MANIFEST.json"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _line(x: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in x)


def record_bytes(row: dict, date: str = DATE) -> bytes:
    """One record: WARC headers, HTTP headers with the full payload's length, and for a response the payload."""
    payload = b"" if row["record_type"] == "revisit" else row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    head = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}")
    if row["refers_to"] is not None:
        head += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + http + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its own length in the extra field."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    length = 10 + 2 + 4 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, length & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _skip_length(head: bytes) -> int | None:
    """Compressed length from the extra field, if it is there and the record is below 4 GB."""
    if head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl" and len(head) >= 24:
        size, whole = struct.unpack("<II", head[16:24])
        return size if whole < 1 << 31 else None
    return None


def parse_headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name:
            out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _row(head: dict[str, str]) -> dict:
    row = {c: head.get(h.lower()) for c, h in _HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if row[c] is not None:
            row[c] = row[c].strip("<>")
    if (d := row["payload_digest"]) and d.startswith("sha1:") and len(d) == 37:
        row["payload_digest"] = base64.b32decode(d[5:]).hex()
    return row


def read_records(stream, wanted, payloads: bool, chunk: int = 1 << 12):
    """Rows of the records of an open file whose headers `wanted` accepts; without `payloads` theirs is None."""
    while head := stream.read(24):
        skip = _skip_length(head)
        start = stream.tell() - len(head)
        inflate = zlib.decompressobj(31)
        data, rest = inflate.decompress(head), head

        def more(until, data=data, inflate=inflate):
            while not until(data) and not inflate.eof and (rest := stream.read(chunk)):
                data += inflate.decompress(rest)
            return data

        data = more(lambda x: b"\r\n\r\n" in x)
        top, _, data = data.partition(b"\r\n\r\n")
        headers = parse_headers(top)
        row = _row(headers)
        if keep := wanted(row):
            length = int(headers.get("content-length", 0))
            is_http = headers.get("content-type", "").startswith("application/http")
            if payloads and row["record_type"] != "revisit":
                parts, have = [data], len(data)
                while have < length and not inflate.eof and (rest := stream.read(1 << 16)):
                    parts.append(inflate.decompress(rest))
                    have += len(parts[-1])
                data = b"".join(parts)[:length]
            else:
                data = more(lambda x: b"\r\n\r\n" in x, data) if is_http else data
            body = data
            row["payload_bytes"] = length
            if is_http:
                top, _, body = data.partition(b"\r\n\r\n")
                row["payload_bytes"] = int(parse_headers(top).get("content-length", length - len(top) - 4))
            row["payload"] = body if payloads and row["record_type"] != "revisit" else None
        if skip is not None:
            stream.seek(start + skip)
        else:
            while not inflate.eof and (rest := stream.read(1 << 16)):
                inflate.decompress(rest)
            stream.seek(stream.tell() - len(inflate.unused_data))
        if keep:
            yield row


class _Bytes:
    """The bytes of an open file that is plain or gzip of any number of members."""

    def __init__(self, stream, zipped: bool):
        self.stream, self.inflate, self.held = stream, zlib.decompressobj(31) if zipped else None, b""

    def _more(self) -> bool:
        raw = self.stream.read(1 << 16)
        if not raw:
            return False
        while raw and self.inflate is not None:
            self.held += self.inflate.decompress(raw)
            raw = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.held += raw
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, size: int, keep: bool) -> bytes:
        parts = []
        while size > 0 and (self.held or self._more()):
            piece, self.held = self.held[:size], self.held[size:]
            size -= len(piece)
            if keep:
                parts.append(piece)
        return b"".join(parts)


def read_foreign(stream, zipped: bool, wanted, payloads: bool):
    """As `read_records`, of a file without skip lengths: records are told apart by their Content-Length."""
    source = _Bytes(stream, zipped)
    while (top := source.until(b"\r\n\r\n")) is not None:
        if not (top := top.lstrip(b"\r\n")):  # the end of the record before
            continue
        headers = parse_headers(top)
        length = int(headers.get("content-length", 0))
        row = _row(headers)
        keep = wanted(row)
        is_http = headers.get("content-type", "").startswith("application/http")
        data = source.take(length, keep and (payloads or is_http))
        if not keep:
            continue
        row["payload_bytes"], body = length, data
        if is_http:
            http, _, body = data.partition(b"\r\n\r\n")
            revisit = row["record_type"] == "revisit"
            row["payload_bytes"] = int(parse_headers(http).get("content-length", 0)) if revisit else len(body)
        row["payload"] = body if payloads and row["record_type"] != "revisit" else None
        yield row


class WarcPartition(InputPartition):
    def __init__(self, path: str, own: bool):
        self.path, self.own = path, own


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.tests: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters):
        """Equality, membership and presence of the header columns hold here; every other filter is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.tests[name] = self.tests[name] & values if name in self.tests else values
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.present.add(f.attribute[0])
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        files, base = _file_system(self.path)
        if files.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
            with files.open_input_stream(f"{base}/{MANIFEST}") as f:
                return [WarcPartition(f"{base}/{x}", True) for x in json.loads(f.read())] or [WarcPartition("", True)]
        found = files.get_file_info(fs.FileSelector(base, recursive=True))
        names = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")))
        return [WarcPartition(x, False) for x in names] or [WarcPartition("", False)]

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None for c in self.present) and all(row[c] in values for c, values in self.tests.items())

    def read(self, partition):
        if not partition.path:
            return
        files, _ = _file_system(self.path)
        fields = SCHEMA.replace(",", "").split()[::2]
        rows, size = [], 0
        with files.open_input_file(partition.path) as stream:
            records = read_records(stream, self.wanted, self.payloads) if partition.own else read_foreign(stream, partition.path.endswith(".gz"), self.wanted, self.payloads)
            for row in records:
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 8 << 20:
                    yield _batch(rows, fields)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, fields)


def _batch(rows: list[dict], fields: list[str]) -> pa.RecordBatch:
    kind = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind.get(c, pa.string())) for c in fields], names=fields)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.limit = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator):
        files, base = _file_system(self.path)
        files.create_dir(base, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = [c.to_pylist() for c in batch.columns]
                for row in zip(*columns, strict=True):
                    if out is None or size > self.limit:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = files.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    data = member(record_bytes(dict(zip(batch.schema.names, row, strict=True))))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages):
        """Lists the files of the tasks that succeeded; files of failed or repeated attempts are in no list and never read."""
        files, base = _file_system(self.path)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages):
        files, base = _file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            files.delete_file(f"{base}/{name}")


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder); option payloads=false leaves every payload undecoded.  df.write.format("warc").mode("append").save(folder)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """A record (WRITE_SCHEMA) for each row of `pages` (page_id, url, html).

    Of rows with equal payloads of at least `least` bytes the largest page_id is the response and the others revisit it.  A null html is an empty payload, a null url has no header.
    Rows that share the largest page_id are all responses; a null page_id is smaller than any other and, if all are null, all are responses.  An empty table gives no records.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload")).withColumn("own", F.coalesce("page_id", F.lit(-(2**63))))
    # Only digests and ids are grouped: who revisits whom is settled before a payload moves, and then by page, so that no digest's copies meet in one task.
    with scratch() as scope:
        digests = saved(rows.where(F.col("payload_bytes") >= least).select("own", "page_id", "payload_digest"), "digests")
        copies = saved(digests.groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
        later = digests.join(copies, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("own", "payload_digest", "first").distinct()
        later = scope.keep(saved(later, "revisits"))
    joined = rows.join(later, ["own", "payload_digest"], "left")
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return joined.select(
        urn("page_id").alias("record_id"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.col("url").cast("string").alias("target_uri"),
        "payload_digest",
        F.when(revisit, urn("first")).alias("refers_to"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame, path: str | None = None) -> str:
    """Writes the pages' records and returns the archive's folder (in the shared folder unless `path` is given)."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records (SCHEMA) of an archive's folder, this module's own or another maker's; without `payloads` no payload is decoded.

    An empty folder has no records; one that does not exist raises FileNotFoundError.  A record without a header has null in its column.  Of another
    maker's response payload_bytes counts what the record holds, of a revisit what its HTTP header states (0 without).
    """
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages and reads the archives back: responses are measured by their payload as read, revisits by their headers alone."""
    path = write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    number = lambda c: F.when(F.col(c) != "urn:page:none", F.substring_index(c, ":", -1).cast("long"))
    responses = read_archive(spark, path).where(F.col("record_type") == "response")
    responses = responses.select("record_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    revisits = read_archive(spark, path, payloads=False).where(F.col("record_type") == "revisit").select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return responses.unionByName(revisits).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS first FROM p WHERE n >= {LEAST_REVISIT} GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN m USING (d)
"""
