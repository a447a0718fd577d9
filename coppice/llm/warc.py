"""WARC archives as a Python data source (operator 9).

Writing: every task writes one archive, a gzip member for each record with the member's lengths in an extra field, and
an index of where members begin; the archives count once the driver has written a manifest that names them, so what a
failed or repeated attempt leaves is never read. Every write has a manifest of its own, so appending keeps what is
there; overwriting takes the earlier ones away. Reading: partitions are ranges of members planned from the manifests,
or whole files without any. Predicates on record type and header fields are pushed down: a record's headers are
inflated and parsed first, and the rest is skipped, not inflated, unless they hold and its payload is wanted."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.skew import lookup
from .common import cut

SCHEMA = "record_id string, record_type string, target_uri string, date string, page_id long, refers_to_id string, payload_digest string, http_length long, headers map<string,string>, payload binary"
#: Columns that are header fields; predicates on these are pushed down.
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to_id": "warc-refers-to"}
#: Names of manifests; the star stands for what is the write's own.
MANIFEST = "_manifest-*.json"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EXTRA = b"sl"
HEADER_MOST = 1 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        path = re.sub(r"^file:/+", "file:///", path)
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field 'sl' has its own and the record's lengths."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if size >= 1 << 32:
        raise ValueError("a record is too long for its lengths' field: 4 GB at most")
    extra = EXTRA + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _plain(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest.hex()}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit of the response of another page with this payload."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _plain(url))] if url is not None else []
    fields += [("WARC-Page-ID", str(page_id))] if page_id is not None else []
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    start, end = MANIFEST.split("*")
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in found if i.base_name.startswith(start) and i.base_name.endswith(end))


@dataclass
class Written(WriterCommitMessage):
    file: str
    #: Offsets at which ranges of members may begin, and the file's length at last.
    marks: list[int]
    records: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.overwrite = overwrite
        self.path, self.date, self.every = options["path"], options.get("date", "1970-01-01T00:00:00Z"), int(options.get("split_bytes", 16 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name, marks, at, n = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0, 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for low in range(0, batch.num_rows, 256):
                    part = batch.slice(low, 256)
                    for page, url, html, refers in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                        if at - marks[-1] >= self.every:
                            marks.append(at)
                        data = member(record(page, url, (html or "").encode(), refers, self.date))
                        out.write(data)
                        at, n = at + len(data), n + 1
        return Written(name, [*marks, at], n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"file": m.file, "marks": m.marks, "records": m.records} for m in messages if m]
        before, name = manifests(fs, root), MANIFEST.replace("*", uuid.uuid4().hex)
        with fs.open_output_stream(f"{root}/{name}.new", compression=None) as out:
            out.write(json.dumps(files).encode())
        fs.move(f"{root}/{name}.new", f"{root}/{name}")
        for old in before if self.overwrite else ():
            fs.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.file}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int | None


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.tests = options["path"], str(options.get("payload", "true")).lower() == "true", []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.tests = []
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and column in FIELDS:
                self.tests.append((FIELDS[column], (f.value,)))
            elif isinstance(f, In) and column in FIELDS:
                self.tests.append((FIELDS[column], tuple(f.value)))
            elif isinstance(f, IsNotNull) and column in FIELDS:
                self.tests.append((FIELDS[column], None))
            elif isinstance(f, EqualTo) and column == "page_id":
                self.tests.append(("warc-page-id", (str(f.value),)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, root = opened(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Range(root, 0, None)]
        if own := manifests(fs, root):
            listed = []
            for path in own:
                with fs.open_input_stream(path, compression=None) as f:
                    listed += json.loads(f.read())
            return [Range(f"{root}/{x['file']}", a, b) for x in listed for a, b in zip(x["marks"], x["marks"][1:]) if b > a] or [Range("", 0, 0)]
        found = [i.path for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if re.search(r"\.warc(\.gz)?$", i.path)]
        return [Range(p, 0, None) for p in sorted(found)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.file) as f:
            size = f.size() if partition.stop is None else partition.stop
            walk = _members if partition.file.endswith(".gz") else _records
            for fields, block in walk(f, partition.start, size, self._holds):
                yield self._row(fields, block)

    def _holds(self, fields: dict[str, str]) -> bool:
        return all(k in fields if values is None else fields.get(k) in values for k, values in self.tests)

    def _row(self, fields: dict[str, str], block) -> tuple:
        page, digest = fields.get("warc-page-id"), fields.get("warc-payload-digest", "")
        length, payload = None, None
        if "application/http" in fields.get("content-type", ""):
            data = block(None if self.payload else 1 << 16)
            head, _, rest = data.partition(b"\r\n\r\n")
            if m := re.search(rb"(?im)^content-length:\s*(\d+)", head):
                length = int(m[1])
            payload = rest if self.payload and fields.get("warc-type") != "revisit" else None
        elif self.payload:
            payload = block(None)
        kind, _, value = digest.partition(":")
        digest = base64.b32decode(value).hex() if kind.lower() == "sha1" and len(value) == 32 else value.lower() or None
        return (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"), int(page) if page else None, fields.get("warc-refers-to"), digest, length, fields, payload)


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _headers(inflate) -> tuple[dict[str, str], bytes]:
    """The fields, and what has been read beyond them. inflate(n): up to n more bytes, empty at the end."""
    data = b""
    while (end := data.find(b"\r\n\r\n")) < 0:
        more = inflate(2048)
        if not more or len(data) > HEADER_MOST:
            raise ValueError("a record's headers have no end")
        data += more
    return _fields(data[:end]), data[end + 4 :]


def _members(f, at: int, stop: int, holds) -> Iterator[tuple]:
    """Records of gzip members that begin in [at, stop). What follows a record's headers is inflated only if block is called."""
    while at < stop:
        f.seek(at)
        head = f.read(1 << 14)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {at}")
        flags, body, size = head[3], 10, None
        if flags & 4:
            (n,) = struct.unpack_from("<H", head, 10)
            extra, body = head[12 : 12 + n], 12 + n
            while len(extra) >= 4:
                (m,) = struct.unpack_from("<H", extra, 2)
                if extra[:2] == EXTRA and m == 8:
                    size = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + m :]
        for flag in (8, 16):
            if flags & flag:
                body = head.index(b"\0", body) + 1
        body += 2 * bool(flags & 2)
        z = zlib.decompressobj(-15)
        source = [head[body:]]

        def inflate(n: int) -> bytes:
            out = b""
            while len(out) < n and not z.eof:
                given = z.unconsumed_tail or source[0] or f.read(1 << 16)
                source[0] = b""
                if not given:
                    raise ValueError("a member is cut off")
                out += z.decompress(given, n - len(out))
            return out

        f.seek(at + len(head))
        fields, rest = _headers(inflate)
        if holds(fields):
            length, got = int(fields["content-length"]), [rest]

            def block(most: int | None) -> bytes:
                want = length if most is None else min(length, most)
                if len(got[0]) < want:
                    got[0] += inflate(want - len(got[0]))
                if len(got[0]) < want:
                    raise ValueError("a record is shorter than it says")
                return got[0][:want]

            yield fields, block
        if size is None:
            while not z.eof:
                inflate(1 << 16)
            at = f.tell() - len(z.unused_data) + 8
        else:
            at += size


def _records(f, at: int, stop: int, holds) -> Iterator[tuple]:
    """Records of an archive that isn't compressed; blocks that nobody asks for are not read."""
    while at < stop:
        f.seek(at)
        fields, rest = _headers(f.read)
        begin, length = f.tell() - len(rest), int(fields["content-length"])

        def block(most: int | None) -> bytes:
            f.seek(begin)
            return f.read(length if most is None else min(length, most))

        if holds(fields):
            yield fields, block
        at = begin + length + 4


class WarcSource(DataSource):
    """Format "warc". Options: path; payload (true: decode payloads); when writing, date and split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def linked(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, refers_to: of rows with equal payloads of `least` bytes or more, which row's record each revisits (null: it is a response itself).

    The response is the largest page_id; rows that repeat it are responses too. A null page_id is never referred to, so
    rows of which all have a null page_id are responses."""
    own = pages.select("page_id", "url", "html")
    long = F.coalesce(F.octet_length("html") >= least, F.lit(False))
    marked = own.where(long).withColumn("of", F.sha1(F.col("html").cast("binary")))
    groups = cut(marked.groupBy(F.col("of").alias("d")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1"))
    met = lookup(marked, "of", groups, "d", "n")
    repeats = met.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))
    return repeats.unionByName(own.where(~long).withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType)))


def write(pages: DataFrame, path: str, least: int = 1000, mode: str = "append") -> None:
    """Archives of all pages under path: a record for every row. mode: "append", which keeps the records that are there, or "overwrite". Null html is an empty payload, a null url leaves its field out; other columns are not looked at."""
    register(pages.sparkSession)
    linked(pages, least).write.format("warc").option("path", path).mode(mode).save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records under path. Read anew for each set of predicates: Spark keeps what it has pushed down with a relation."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
