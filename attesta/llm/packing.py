"""Best-fit packing by levels: partitions pack on their own and emit nearly full bins; underfull bins are items of the next level."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoder, spill

PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = pa.schema([("done", pa.bool_()), ("bin", pa.int64()), ("size", pa.int32()), ("pieces", pa.list_(_PIECE))])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: largest first, each into the fullest bin that it fits. One bit for each free space that some bin has."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fits = has >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                has ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > s:
            free[room - s].append(b)
            has |= 1 << (room - s)
    return bins


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep: int = 900_000) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut only if longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, False, keep)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), e.encode(b.column(1)), strict=True):
                raw = ids.astype("<u4").tobytes() + end
                n = len(raw) // 4
                out += [(doc, k, at, min(capacity, n - at), zlib.crc32(raw[4 * at : 4 * (at + capacity)])) for k, at in enumerate(range(0, n, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 5, _PIECE, strict=True)], [f.name for f in _PIECE])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _level(items: DataFrame, parts: int, capacity: int, least_fill: int, level: int) -> DataFrame:
    """Pack each of `parts` partitions of items (size, pieces, key: a number of their own, so that equal ids are dealt out too); bins of least_fill or more are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (-r["size"], [tuple(-1 if v is None else v for v in p.values()) for p in r["pieces"][:1]]))  # the same bins if the task runs again
        first = (level << 52) + (TaskContext.get().partitionId() << 32)
        packed = best_fit([r["size"] for r in rows], capacity)
        for at in range(0, len(packed), 2000):
            out = []
            for k, members in enumerate(packed[at : at + 2000], at):
                size = sum(rows[i]["size"] for i in members)
                out.append({"done": size >= least_fill, "bin": first + k, "size": size, "pieces": [p for i in members for p in rows[i]["pieces"]]})
            yield pa.RecordBatch.from_struct_array(pa.array(out, pa.struct(list(_BINS))))

    return items.select("size", "pieces", "key").repartition(parts, F.xxhash64(F.lit(level), "key")).select("size", "pieces").mapInArrow(run, f"done boolean, bin bigint, size int, pieces array<{PIECE}>")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, per_task: int = 50_000, fan_in: int = 8, least_fill: float = 0.995, keep: int = 900_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs (doc_id, text).

    keep bounds the chunks of text whose ids a worker remembers; per_task bounds the items of a packing task at every level; bins filled to least_fill are emitted, the
    others meet bins of fan_in times as many partitions in the next level, until one task holds them all or
    a level no longer saves bins. Null and empty texts are the single id end_id; equal rows are packed each;
    a null doc_id stays null; no rows give no rows; other columns are not read.
    """
    cut = spill(pieces(docs, tokenizer, capacity, end_id, keep).withColumn("key", F.monotonically_increasing_id()), "pieces")
    items = cut.select("key", F.col("length").cast("int").alias("size"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("pieces"))
    full = cut.drop("key").filter(F.col("length") >= capacity)
    rest, done, level = items.filter(F.col("size") < capacity), [], 0
    count = rest.count()
    parts = max(1, -(-count // per_task), min(16, count // 2_000))
    least = int(capacity * least_fill)
    while True:
        level += 1
        bins = spill(_level(rest, parts, capacity, least, level), f"bins{level}")
        left, all_bins = bins.agg(F.sum(F.when(~F.col("done"), 1).otherwise(0)), F.count("*")).first()
        left = left or 0
        last = parts == 1 or left == 0 or (level > 1 and all_bins > 0.98 * count)
        done.append(bins.select("bin", "pieces") if last else bins.filter("done").select("bin", "pieces"))
        if last:
            break
        rest, count = bins.filter("not done").select("size", "pieces", F.col("bin").alias("key")), left
        parts = max(1, -(-parts // fan_in), -(-left // per_task))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for number, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                offset = 0
                for p in members:
                    rows.append(p | {"sequence_id": number, "offset": offset})
                    offset += p["length"]
            yield pa.RecordBatch.from_struct_array(pa.array(rows, pa.struct([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])))

    flat = out.mapInArrow(lay, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # A full piece is a sequence by itself; its number is drawn from its place in the table of pieces.
    return flat.unionByName(full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
