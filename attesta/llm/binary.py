"""Length-delimited binary records of token ids, with an offset index beside each file.

A record is: length (u64), masked CRC-32C of those 8 bytes (u32), the ids (little-endian u16 or
u32), masked CRC-32C of the ids (u32), all little-endian. `part-N.idx` has one row of four i64 for each record of
`part-N.rec`: doc_id, byte offset of the record, bytes of its ids, ids before it in the file.
`manifest.json`, written at commit, names the files in order with their ids; files that it does not
name (from lost or repeated tasks) are never read.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import encoder, scratch

#: Chunks whose ids a worker remembers: half of the encoder's own number, as sorted texts are in the JVM's memory beside it.
KEEP = 450_000

# ---------------------------------------------------------------- CRC-32C (Castagnoli), many records at once
_POLY = 0x82F63B78  # fixed value: the reflected polynomial
_BLOCK = 256


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1).astype(np.uint32)
    return t


_TABLE = _byte_table()


def _zeros_tables() -> list[list[int]]:
    """What _BLOCK zero bytes make of a register, by each of its bytes (the step is linear)."""
    out = []
    for shift in (0, 8, 16, 24):
        r = np.arange(256, dtype=np.uint32) << np.uint32(shift)
        for _ in range(_BLOCK):
            r = _TABLE[r & 0xFF] ^ (r >> np.uint32(8))
        out.append(r.tolist())
    return out


_Z0, _Z1, _Z2, _Z3 = _zeros_tables()


def crc32c(records: list[bytes]) -> list[int]:
    """CRC-32C of each record. Blocks of all records advance together; a record's blocks are then chained."""
    rows, starts = [], [0]
    for r in records:
        head = bytes(x ^ 0xFF for x in r[:4])  # the initial register, moved into the data
        pad = -len(r) % _BLOCK
        rows.append(b"\0" * pad + head + r[4:])
        starts.append(starts[-1] + (len(r) + pad) // _BLOCK)
    data = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, _BLOCK).T.copy()
    reg = np.zeros(data.shape[1], np.uint32)
    for column in data:
        reg = _TABLE[(reg ^ column) & 0xFF] ^ (reg >> np.uint32(8))
    blocks, out = reg.tolist(), []
    for r, a, b in zip(records, starts, starts[1:], strict=False):
        c = 0
        for x in blocks[a:b]:
            c = _Z0[c & 255] ^ _Z1[c >> 8 & 255] ^ _Z2[c >> 16 & 255] ^ _Z3[c >> 24] ^ x
        if len(r) < 4:  # the rest of the initial register has not met data
            c = 0xFFFFFFFF
            for x in r:
                c = int(_TABLE[(c ^ x) & 0xFF]) ^ (c >> 8)
        out.append(c ^ 0xFFFFFFFF)
    return out


def masked(crc: int) -> int:
    """Rotated by 15 bits and shifted by a fixed value, so that a checksum of checksums stays sound."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


# ---------------------------------------------------------------- the data source
@dataclass
class Written(WriterCommitMessage):
    part: int
    stem: str
    records: int
    ids: int


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class RecordWriter(DataSourceArrowWriter):
    """Writes column ids; with a tokenizer it encodes column text instead and ends each text with end_id, so ids never pass through the JVM."""

    def __init__(self, path: str, width: int, tokenizer: str | None = None, end_id: int = 0):
        self.path, self.width, self.tokenizer, self.end_id = path, width, tokenizer, end_id

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
        """doc_ids and bytes of ids, of a few records at a time."""
        if self.tokenizer:
            e = encoder(self.tokenizer, True, KEEP)
            end = np.array([self.end_id], e.dtype).tobytes()
        for batch in batches:
            docs = batch.column(batch.schema.get_field_index("doc_id"))
            data = batch.column(batch.schema.get_field_index("text" if self.tokenizer else "ids"))
            for at in range(0, batch.num_rows, 512):
                own = data.slice(at, 512)
                yield docs.slice(at, 512).to_pylist(), [a.tobytes() + end for a in e.encode(own)] if self.tokenizer else own.to_pylist()

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        stem = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"  # attempts don't meet
        offset = records = ids = 0
        with fs.open_output_stream(f"{root}/{stem}.rec") as rec, fs.open_output_stream(f"{root}/{stem}.idx") as idx:
            for docs, data in self._rows(batches):
                heads = [struct.pack("<Q", len(d)) for d in data]
                rows = []
                for doc, d, head, c, h in zip(docs, data, heads, crc32c(data), crc32c(heads), strict=True):
                    rec.write(b"".join((head, struct.pack("<I", masked(h)), d, struct.pack("<I", masked(c)))))
                    rows.append((-(1 << 63) if doc is None else doc, offset, len(d), ids))
                    offset += len(d) + 16
                    ids += len(d) // self.width
                    records += 1
                idx.write(np.array(rows, "<i8").tobytes())
        return Written(part, stem, records, ids)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        files, start = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            if m.records:
                files.append({"stem": m.stem, "records": m.records, "ids": m.ids, "start": start})
                start += m.ids
        with fs.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps({"width": self.width, "files": files}).encode())


@dataclass
class RecordPart(InputPartition):
    stem: str
    start: int
    first: int
    last: int


class RecordReader(DataSourceReader):
    """A partition for each run of records of about split_bytes, read by its rows of the index."""

    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def _manifest(self) -> dict:
        fs, root = _open(self.path)
        with fs.open_input_stream(f"{root}/manifest.json") as f:
            return json.loads(f.read())

    def partitions(self) -> list[RecordPart]:
        m = self._manifest()
        parts = []
        for f in m["files"]:
            n = max(1, -(-f["ids"] * m["width"] // self.split_bytes))
            step = -(-f["records"] // n)
            parts += [RecordPart(f["stem"], f["start"], a, min(a + step, f["records"])) for a in range(0, f["records"], step)]
        return parts

    def read(self, part: RecordPart | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no partitions
            return
        names = ["doc_id", "start", "ids"]
        fs, root = _open(self.path)
        with fs.open_input_file(f"{root}/{part.stem}.idx") as f:
            f.seek(32 * part.first)
            index = np.frombuffer(f.read(32 * (part.last - part.first)), "<i8").reshape(-1, 4)
        with fs.open_input_file(f"{root}/{part.stem}.rec") as f:
            for at in range(0, len(index), 256):
                own, data = index[at : at + 256], []
                for _, offset, size, _ in own.tolist():
                    f.seek(offset)
                    data.append(f.read(size + 16))
                ids = [d[12:-4] for d in data]
                heads = [d[:8] for d in data]
                for d, h, c, (_, offset, size, _) in zip(data, crc32c(heads), crc32c(ids), own.tolist(), strict=True):
                    if struct.unpack("<QI", d[:12]) != (size, masked(h)) or struct.unpack("<I", d[-4:])[0] != masked(c):
                        raise ValueError(f"{part.stem}: the record at {offset} is damaged")
                docs = [None if x == -(1 << 63) else x for x in own[:, 0].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(own[:, 3] + part.start, pa.int64()), pa.array(ids, pa.binary())], names)


class TokenRecords(DataSource):
    """Format token_records: path; for writing width (2 or 4 bytes an id), tokenizer and end_id; for reading split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return "doc_id long, start long, ids binary"

    def writer(self, schema, overwrite: bool) -> RecordWriter:  # noqa: ANN001
        return RecordWriter(self.options["path"], int(self.options.get("width", 4)), self.options.get("tokenizer"), int(self.options.get("end_id", 0)))

    def reader(self, schema) -> RecordReader:  # noqa: ANN001
        return RecordReader(self.options["path"], int(self.options.get("split_bytes", 32 << 20)))


def write_token_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode docs (doc_id, text) and write them in ascending doc_id order; a text's ids end with end_id.

    Null and empty texts are just end_id; a null doc_id comes first; rows with equal doc_id follow
    each other in the order of their texts; no rows give an empty manifest; other columns are not read.
    """
    docs.sparkSession.dataSource.register(TokenRecords)
    width = encoder(tokenizer, True, KEEP).dtype.itemsize
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.write.format("token_records").option("width", width).option("tokenizer", tokenizer).option("end_id", end_id).mode("append").save(path)


def read_token_records(spark: SparkSession, path: str) -> DataFrame:
    """Records written by write_token_records: doc_id, start (ids of all records before it), ids."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format("token_records").load(path)


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """stem, at (byte offset), size (bytes of ids), doc_id, start of every record, from the index files alone; a row for each file of the manifest is
    dealt out, their indexes are read by tasks."""
    fs, root = _open(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    rows = spark.createDataFrame([(f["stem"], f["start"]) for f in files], "stem string, start long").repartition(max(1, len(files)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        for b in batches:
            for stem, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{stem}.idx") as f:
                    while raw := f.read(32 * 65536):
                        x = np.frombuffer(raw, "<i8").reshape(-1, 4)
                        docs = pa.array(x[:, 0], pa.int64(), mask=x[:, 0] == -(1 << 63))
                        yield pa.RecordBatch.from_arrays([pa.array([stem] * len(x)), pa.array(x[:, 1]), pa.array(x[:, 2]), docs, pa.array(x[:, 3] + start)], ["stem", "at", "size", "doc_id", "start"])

    return rows.mapInArrow(run, "stem string, at long, size long, doc_id long, start long")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in a random order that the seed fixes: doc_id, start, ids. The index is sorted by a hash of seed and place, then each task seeks
    its records, so neither texts nor ids are shuffled. A damaged record fails the read."""
    order = F.xxhash64(F.lit(seed), "stem", "at")
    index = record_index(spark, path).withColumn("turn", order).repartitionByRange("turn").sortWithinPartitions("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        files: dict = {}
        try:
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part, data = b.slice(k, 256), []
                    for stem, at, size in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                        if stem not in files:
                            if len(files) >= 64:  # few handles at a time
                                files.pop(next(iter(files))).close()
                            files[stem] = fs.open_input_file(f"{root}/{stem}.rec")
                        files[stem].seek(at)
                        data.append(files[stem].read(size + 16))
                    ids = [d[12:-4] for d in data]
                    for d, h, c, size, stem, at in zip(data, crc32c([d[:8] for d in data]), crc32c(ids), part.column(2).to_pylist(), part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        if struct.unpack("<QI", d[:12]) != (size, masked(h)) or struct.unpack("<I", d[-4:])[0] != masked(c):
                            raise ValueError(f"{stem}: the record at {at} is damaged")
                    yield pa.RecordBatch.from_arrays([part.column(3), part.column(4), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])
        finally:
            for f in files.values():
                f.close()

    return index.mapInArrow(run, "doc_id long, start long, ids binary")


def record_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs to a new folder in the shared one, read it back: doc_id, start, n_tokens, ids_crc32 (of u32 ids)."""
    path = scratch(docs.sparkSession, "records")
    write_token_records(docs, path, tokenizer, end_id)
    width = encoder(tokenizer, True, KEEP).dtype.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            ids = [np.frombuffer(x, f"<u{width}") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_token_records(docs.sparkSession, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
