"""Sharding by extendible hashing: a directory over hash prefixes, in which only oversized buckets split on another bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spill

#: Bits of the hash, and bits that one round may split on. A round's histogram has at most 2**STEP rows for each
#: bucket that was oversized before it.
BITS, STEP = 60, 12


def _sizes(rows: DataFrame, depth: int) -> DataFrame:
    """Bytes of every bucket `depth`+1 to `depth`+STEP bits deep, made from the histogram of the deepest."""
    deepest = rows.groupBy("bucket", F.shiftright("hash", BITS - depth - STEP).alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"))
    each = deepest.select("bucket", "prefix", "n_bytes", F.explode(F.sequence(F.lit(depth + 1), F.lit(depth + STEP))).alias("depth"))
    return each.groupBy("bucket", "depth", F.expr(f"shiftright(prefix, {depth + STEP} - depth)").alias("prefix")).agg(F.sum("n_bytes").alias("bucket_bytes"))


def shards(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """doc_id, n_bytes, depth, prefix, shard_bytes, fits for each row of docs (doc_id, text).

    A shard is the bucket of the `depth` leading bits `prefix` of a 60-bit hash of doc_id and text, so rows that
    share a doc_id still part. A bucket splits while its bytes exceed limit_bytes, down to 60 bits. A single row above the
    limit, or equal rows that exceed it together, make a shard alone with fits = false. Null and empty texts have 0
    bytes; a null doc_id hashes as an empty string; no rows give no rows; other columns are not read.
    """
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return _dealt(spill(docs.select("doc_id", n_bytes.alias("n_bytes"), _hash().alias("hash")), "hashes"), limit_bytes).drop("hash")


def _hash() -> Column:
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long")


def _dealt(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """rows (doc_id, n_bytes, hash) with depth, prefix, shard_bytes, fits."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    if total <= limit_bytes:
        return rows.select("doc_id", "n_bytes", "hash", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.lit(total).cast("long").alias("shard_bytes"), F.lit(True).alias("fits"))
    done, depth, live = [], 0, rows.withColumn("bucket", F.lit(0).cast("long"))
    while depth < BITS:
        end = depth + STEP
        sizes = _sizes(live, depth)
        # The leaf of a hash is its shallowest bucket that fits; parents only shrink into children, so the first that fits is unique.
        leaves = sizes.filter((F.col("bucket_bytes") <= limit_bytes) | (F.col("depth") == end))
        cells = leaves.select("bucket", "depth", "prefix", "bucket_bytes")
        own = live.withColumn("cell", F.shiftright("hash", BITS - end))
        # Directory: each cell of the deepest level names its leaf. Only cells that hold rows are in it.
        deepest = own.groupBy("bucket", "cell").agg((F.min("hash") == F.max("hash")).alias("alone"))
        ways = deepest.select("bucket", "cell", "alone", F.explode(F.sequence(F.lit(depth + 1), F.lit(end))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {end} - depth)"))
        directory = ways.join(cells, ["bucket", "depth", "prefix"]).groupBy("bucket", "cell").agg(F.min(F.struct("depth", "prefix", "bucket_bytes")).alias("leaf"), F.min("alone").alias("alone"))
        directory = spill(directory, f"directory{end}")
        if depth == 0:
            directory = F.broadcast(directory)  # at most 2**STEP rows, whatever the input
        placed = own.join(directory, ["bucket", "cell"])
        over = F.col("leaf.bucket_bytes") > limit_bytes
        last = over & (F.col("alone") if end < BITS else F.lit(True))  # one hash can't part: it is a shard of all its bits at once
        leaf = (F.when(last, BITS).otherwise(F.col("leaf.depth")).alias("depth"), F.when(last, F.col("hash")).otherwise(F.col("leaf.prefix")).alias("prefix"), F.col("leaf.bucket_bytes").alias("shard_bytes"), (~over).alias("fits"))
        done.append(placed.filter(~over | last).select("doc_id", "n_bytes", "hash", *leaf))
        if directory.filter(over & (~F.col("alone") if end < BITS else F.lit(False))).isEmpty():
            break
        live = spill(placed.filter(over & ~F.col("alone")).select("doc_id", "n_bytes", "hash", F.col("cell").alias("bucket")), f"oversized{end}")
        depth = end
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def write_shards(docs: DataFrame, path: str, limit_bytes: int) -> str:
    """Write docs (doc_id, text) as Parquet, a folder depth-prefix for each shard, its rows dealt to one task.

    All rows and columns are written; equal rows, which hash alike, stand in one folder. Returns the name of the folder column:
    shard, with as many underscores after it as docs has columns of that name."""
    column = "shard"
    while column.lower() in (c.lower() for c in docs.columns):
        column += "_"
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _hash().alias("hash"))
    place = _dealt(spill(docs.select("doc_id", n_bytes.alias("n_bytes"), _hash().alias("hash")), "hashes"), limit_bytes)
    place = place.groupBy("hash").agg(F.concat_ws("-", F.min("depth"), F.min("prefix")).alias(column))
    rows.join(place, "hash").repartition(column).select("row.*", column).write.partitionBy(column).parquet(path)
    return column
