"""WARC 1.1 archives: a Python data source that writes and reads them.

Writing: rows (page_id, uri, payload, record_type, refers_to, digest, payload_bytes) become records, a file for each
task and max_file_bytes. Each record of a file is a gzip member of its own if compression is gzip. A manifest names
the files and, for every index_bytes of them, a place where a record begins.
Reading: files, or stretches of them that the manifest marks, are planned into partitions by size; archives of other writers, without a
manifest, are read file by file, every record of them. Conditions on record_type, page_id, refers_to, record_id, uri and digest
are pushed down. Headers are parsed first; a payload that the conditions exclude, or that the read does not ask for
(option payload = false), is stepped over: by seeking in plain files, by inflating without decoding in gzip ones.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .binary import _open
from .common import scratch

FIELDS = "page_id long, uri string, record_type string, refers_to long, digest string, payload_bytes long, payload binary, record_id string, date string, content_type string"
_ARROW = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("date", pa.string()), ("content_type", pa.string())])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time


_OWN = re.compile(r"<urn:attesta:page:(none|-?[0-9]+)(?::[0-9a-f]*)?>")


def _record_id(page_id: int | None, digest: str | None) -> str:
    """Stable URN of a page's record, by its payload too, as pages can share an id; the reading side takes the number back out of it."""
    return "<urn:attesta:page:" + ("none" if page_id is None else str(page_id)) + ":" + (digest or "") + ">"


def _page_of(urn: str | None) -> int | None:
    """Null for a record of another writer."""
    m = _OWN.fullmatch(urn or "")
    return None if m is None or m[1] == "none" else int(m[1])


def encode_record(row: dict) -> bytes:
    """One record. Header values keep no line ends, so a hostile uri cannot add fields."""
    payload = row["payload"] or b""
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _record_id(row["page_id"], row["digest"])), ("WARC-Date", _DATE)]
    if row["uri"] is not None:
        fields.append(("WARC-Target-URI", "".join(c for c in row["uri"] if c not in "\r\n")))
    fields.append(("WARC-Payload-Digest", "sha1:" + (row["digest"] or "")))
    fields.append(("X-Payload-Bytes", str(row["payload_bytes"])))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(row["refers_to"], row["digest"]))]
        block = http + b"\r\n"
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_header(raw: bytes) -> dict[str, str]:
    """Fields of a record header by lower-case name; folded lines continue the field before."""
    lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class Stretch:
    """Bytes from start to end of a file, to be read and sought in from where it stands."""

    def __init__(self, file, start: int, end: int):  # noqa: ANN001
        self.file, self.left = file, end - start
        file.seek(start)

    def read(self, n: int) -> bytes:
        data = self.file.read(min(n, self.left))
        self.left -= len(data)
        return data

    def seek(self, n: int, whence: int) -> None:
        self.file.seek(n, whence)
        self.left = max(0, self.left - n)


class Plain:
    """Reads a file ahead in blocks; what is stepped over beyond the block in hand is not read."""

    def __init__(self, file, block: int = 1 << 18):  # noqa: ANN001
        self.file, self.block, self.have = file, block, b""

    def _more(self) -> bool:
        got = self.file.read(self.block)
        self.have += got
        return bool(got)

    def until(self, mark: bytes) -> bytes | None:
        """Up to mark, which is dropped; None at the end of the file."""
        seen = 0
        while (at := self.have.find(mark, seen)) < 0:
            seen = max(0, len(self.have) - len(mark) + 1)
            if not self._more():
                if self.have.strip():
                    raise ValueError("the file ends inside a record header")
                return None
        out, self.have = self.have[:at], self.have[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, size = [self.have], len(self.have)
        while size < n:
            got = self.file.read(max(self.block, n - size))
            if not got:
                raise ValueError("the file ends inside a record")
            parts.append(got)
            size += len(got)
        data = b"".join(parts)
        self.have = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        if n <= len(self.have):
            self.have = self.have[n:]
        else:
            self.file.seek(n - len(self.have), 1)
            self.have = b""


class Members:
    """The inflated bytes of a file of gzip members, as something to read() and step over."""

    def __init__(self, file, block: int = 1 << 18):  # noqa: ANN001
        self.file, self.block, self.inflate, self.rest = file, block, zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        while True:
            if self.inflate.eof:
                self.rest = self.inflate.unused_data or self.rest
                self.inflate = zlib.decompressobj(31)
            data = self.rest or self.file.read(self.block)
            if not data:
                return b""
            out = self.inflate.decompress(data, n)
            self.rest = self.inflate.unconsumed_tail
            if out:
                return out

    def seek(self, n: int, _whence: int) -> None:
        while n > 0:
            got = self.read(min(n, self.block))
            if not got:
                raise ValueError("the file ends inside a record")
            n -= len(got)


#: Columns that a header alone decides, by the way they are got from it.
_HEADER = {
    "page_id": lambda h: _page_of(h.get("warc-record-id")),
    "uri": lambda h: h.get("warc-target-uri"),
    "record_type": lambda h: h.get("warc-type"),
    "refers_to": lambda h: _page_of(h.get("warc-refers-to")),
    "digest": lambda h: h["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in h else None,
    "record_id": lambda h: h.get("warc-record-id"),
    "date": lambda h: h.get("warc-date"),
    "content_type": lambda h: h.get("content-type"),
}


def read_records(file, compressed: bool, wanted: dict[str, set], payload: bool) -> Iterator[dict]:  # noqa: ANN001
    """Rows of one archive, a row for each record whose columns are among `wanted`. A record's block is read only if its header passes
    and its payload is wanted. The payload of an HTTP response is what follows its HTTP header, of a revisit null, of other records the block."""
    source = Plain(Members(file) if compressed else file)
    while (raw := source.until(b"\r\n\r\n")) is not None:
        h = parse_header(raw.lstrip(b"\r\n"))
        size = int(h["content-length"])
        row = {name: of(h) for name, of in _HEADER.items()}
        if any(row[name] not in values for name, values in wanted.items()):
            source.skip(size + 4)
            continue
        kind, http = row["record_type"], (row["content_type"] or "").replace(" ", "").lower().startswith("application/http")
        stated = int(h["x-payload-bytes"]) if "x-payload-bytes" in h else None if kind == "revisit" or (kind == "response" and http) else size
        body = None
        if payload and kind != "revisit":
            body = source.take(size)
            if kind == "response" and http:
                at = body.find(b"\r\n\r\n")
                body = body[at + 4 :] if at >= 0 else b""
            source.skip(4)
        else:
            source.skip(size + 4)
        yield row | {"payload": body, "payload_bytes": len(body) if stated is None and body is not None else stated}


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, compression: str, max_file_bytes: int, index_bytes: int):
        self.path, self.gzip, self.max_file_bytes, self.index_bytes = path, compression == "gzip", max_file_bytes, index_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        stem = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"  # attempts don't meet
        files, out, size, marks = [], None, 0, [0]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None:
                        name = f"pages-{stem}-{len(files):05d}.warc" + ".gz" * self.gzip
                        out, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                        marks = [0]
                    elif size >= marks[-1] + self.index_bytes:
                        marks.append(size)
                    data = encode_record(row)
                    if self.gzip:
                        z = zlib.compressobj(1, zlib.DEFLATED, 31)
                        data = z.compress(data) + z.flush()
                    out.write(data)
                    size += len(data)
                    if size >= self.max_file_bytes:
                        out.close()
                        files.append((name, size, marks))
                        out = None
        if out is not None:
            out.close()
            files.append((name, size, marks))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())


@dataclass
class Files(InputPartition):
    parts: list  # (name, start, end)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, payload: bool):
        self.path, self.split_bytes, self.payload, self.wanted = path, split_bytes, payload, {}

    def partitions(self) -> list[Files]:
        """Neighbouring stretches up to split_bytes together; the manifest names them, else the folder its files."""
        fs, root = _open(self.path)
        info = fs.get_file_info(f"{root}/manifest.json")
        if info.type == pa.fs.FileType.File:
            with fs.open_input_stream(info.path) as f:
                files = json.loads(f.read())
        else:
            files = sorted((i.base_name, i.size, [0]) for i in fs.get_file_info(pa.fs.FileSelector(root)) if i.base_name.endswith((".warc", ".warc.gz")))
        parts, size = [], 0
        for name, length, marks in files:
            for start, end in zip(marks, [*marks[1:], length], strict=True):
                if not parts or size + end - start > self.split_bytes:
                    parts.append(Files([]))
                    size = 0
                parts[-1].parts.append((name, start, end))
                size += end - start
        return parts

    def read(self, part: Files | None) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.path)
        for name, start, end in part.parts if part else []:  # None where there are no partitions
            with fs.open_input_file(f"{root}/{name}") as f:
                rows, size = [], 0
                for r in read_records(Stretch(f, start, end), name.endswith(".gz"), self.wanted, self.payload):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)


class PushingReader(WarcReader):
    """Takes = and in conditions on columns that a header decides.

    Spark keeps the conditions last pushed into a relation, also for a later read of it that has none; so this reader serves
    only relations that are filtered as soon as they are made (read_warc with where)."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in _HEADER:
                name = f.attribute[0]
                self.wanted[name] = (self.wanted[name] & values if name in self.wanted else values) - {None}
            else:
                yield f


class Warc(DataSource):
    """Format warc: path; compression (gzip or none), max_file_bytes and index_bytes to write; split_bytes, payload and pushdown to read."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return FIELDS

    def writer(self, schema, overwrite: bool) -> WarcWriter:  # noqa: ANN001
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip"), int(self.options.get("max_file_bytes", 1 << 30)), int(self.options.get("index_bytes", 32 << 20)))

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else WarcReader
        return kind(self.options["path"], int(self.options.get("split_bytes", 128 << 20)), self.options.get("payload", "true").lower() != "false")


def with_revisits(pages: DataFrame, least_bytes: int = 1000, salts: int = 16) -> DataFrame:
    """pages (page_id, url, html) as rows of the format: the largest page_id of equal payloads is the response.

    Null html is an empty payload; payloads under least_bytes are all responses. Rows that share the largest page_id
    are all responses; a null page_id is never referred to. Equal payloads are found by their SHA-1;
    only digests with two different ids go into the join, and a payload that many pages share is dealt over `salts` keys.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").alias("uri"), html.alias("payload")).select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    big = rows.filter(F.col("payload_bytes") >= least_bytes)
    shared = big.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").select("digest", "last")
    shared = shared.select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(salts)))
    out = salted.join(shared, ["digest", "salt"], "left")
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.select(
        "page_id", "uri", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"),
        "digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    pages.sparkSession.dataSource.register(Warc)
    with_revisits(pages).write.format("warc").option("compression", compression).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, where: str | None = None, payload: bool = True) -> DataFrame:
    """Records of the archives in a folder, of this writer or others: page_id, uri, record_type, refers_to, digest, payload_bytes, payload,
    record_id, date, content_type. page_id and refers_to are null for records of others, payload_bytes is null where only the payload could tell and it is not read.
    Of `where`, = and in conditions on columns of the header reach the reader (the session's option for that is set). A file that ends
    inside a record fails the read; an empty file or folder has no records."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    rows = spark.read.format("warc").option("payload", str(payload)).option("pushdown", str(where is not None)).load(path)
    return rows if where is None else rows.filter(where)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to a new folder in the shared one and read them: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Figures of responses are taken from their payloads as read; revisits carry none, theirs stand in their headers.
    """
    path = scratch(pages.sparkSession, "warc")
    write_warc(pages, path)
    r = read_warc(pages.sparkSession, path)
    response = F.col("record_type") == "response"
    return r.select("page_id", F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")
