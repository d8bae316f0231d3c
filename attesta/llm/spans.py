"""Substring dedup by de Bruijn compaction: runs of `n` words are edges between runs of n - 1 words.

1. Texts of equal words are one class; all but the row with the least doc_id are repeated as a whole.
2. Each window of n words has a minimizer, its least hash of k words. Only windows whose minimizer
   stands in two documents can be repeated, so only those become edges.
3. An edge that two documents hold is repeated; its source is the first place in the least document. A node with one repeated edge in
   and one out does not branch. Edges that follow each other in their source over such nodes are a run, and runs that meet
   at such a node are joined to paths by pointer doubling.
4. Where a document follows a run it has a span with both coordinates. Digests of the words at both are compared; a span
   stands only if they are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spill, words
from .shingles import sliding_min, windows, word_hashes


def _sha(ws: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(ws)).hexdigest()


_EMPTY = _sha([])


def _minimizers(docs: DataFrame, n: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, sha, least = [], [], []
            for t in b.column(1).to_pylist():
                ws = words(t)
                size.append(len(ws))
                sha.append(_sha(ws))
                least.append(np.unique(sliding_min(windows(word_hashes(ws), k), n - k + 1)).view(np.int64).tolist() if len(ws) >= n else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(sha), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "n_words", "sha", "least"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, sha string, least array<long>")


def _edges(texts: DataFrame, n: int, k: int) -> DataFrame:
    """doc_id, own, sha, text, at, left, right: the windows of each document whose minimizers are among `shared`, as edges from the node
    of their first n - 1 words to that of their last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 200):
                part, at, left, right, keep = b.slice(start, 200), [], [], [], []
                for sha, text, shared in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    ws = words(text)
                    own = _sha(ws) == sha  # else another text of the same doc_id
                    keep.append(own)
                    hit = node = np.empty(0, np.int64)
                    if own:
                        h = word_hashes(ws)
                        hit = np.flatnonzero(np.isin(sliding_min(windows(h, k), n - k + 1), np.array(shared, np.int64).view(np.uint64)))
                        node = windows(h, n - 1).view(np.int64)
                    at.append(hit.astype(np.int32).tolist())
                    left.append(node[hit].tolist())
                    right.append(node[hit + 1].tolist())
                out = pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(at, pa.list_(pa.int32())), *(pa.array(x, pa.list_(pa.int64())) for x in (left, right))], ["doc_id", "own", "sha", "text", "at", "left", "right"])
                yield out.filter(pa.array(keep, pa.bool_()))

    return texts.select("doc_id", "own", "sha", "text", "shared").mapInArrow(run, "doc_id long, own int, sha string, text string, at array<int>, left array<long>, right array<long>")


def _digests(texts: DataFrame) -> DataFrame:
    """doc, own, begin, words, digest of each asked stretch of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, own, text, asked in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ws = words(text)
                rows += [{"doc": doc, "own": own, "begin": a["begin"], "words": a["words"], "digest": _sha(ws[a["begin"] : a["begin"] + a["words"]])} for a in asked]
            yield pa.RecordBatch.from_struct_array(pa.array(rows, pa.struct([("doc", pa.int64()), ("own", pa.int32()), ("begin", pa.int32()), ("words", pa.int32()), ("digest", pa.string())])))

    return texts.mapInArrow(run, "doc long, own int, begin int, words int, digest string")


def _cut(texts: DataFrame) -> DataFrame:
    """doc_id, sha, n_removed, kept_sha256 of each text without its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, kept = [], []
            for text, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ws = words(text)
                out = np.zeros(len(ws), bool)
                for s in spans:
                    out[s["begin"] : s["begin"] + s["words"]] = True
                gone.append(int(out.sum()))
                kept.append(_sha([w for w, o in zip(ws, out.tolist(), strict=True) if not o]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(kept)], ["doc_id", "sha", "n_removed", "kept_sha256"])

    return texts.mapInArrow(run, "doc_id long, sha string, n_removed long, kept_sha256 string")


def _runs(edges: DataFrame) -> DataFrame:
    """Rows left, right, source (doc_id, own, at), run (the source of its first edge) of the repeated ones of edges (doc_id, own, at, left, right).

    An edge goes on the run of the one before it in the source if the node between them has one repeated edge in and one out."""
    first = edges.groupBy("left", "right").agg(F.min(F.struct("doc_id", "own", "at")).alias("source"), F.max("doc_id").alias("high")).filter("source.doc_id < high").select("left", "right", "source")
    first = spill(first, "repeated")
    out = first.groupBy(F.col("left").alias("node")).agg(F.count("*").alias("n")).filter("n = 1").select("node")
    into = first.groupBy(F.col("right").alias("node")).agg(F.count("*").alias("n")).filter("n = 1").select("node")
    plain = into.join(out, "node").withColumn("plain", F.lit(True))
    placed = first.join(plain, F.col("left") == F.col("node"), "left").select("left", "right", "source", F.coalesce("plain", F.lit(False)).alias("plain"))
    order = Window.partitionBy("source.doc_id", "source.own").orderBy("source.at")
    goes_on = F.col("plain") & (F.lag("right").over(order) == F.col("left")) & (F.lag("source.at").over(order) == F.col("source.at") - 1)
    marked = placed.withColumn("start", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("source")))
    return marked.withColumn("run", F.last("start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("left", "right", "source", "run", "plain")


def _paths(runs: DataFrame) -> DataFrame:
    """Rows run, path, offset: the first run of the nonbranching path that a run is part of, and the edges before it there.

    Pointer doubling: each round a run takes over the pointer of the run that it points to, so paths end after a logarithm of their
    length. What never reaches a first run is a cycle; its runs are paths by themselves."""
    ends = spill(runs.groupBy("run").agg(F.min_by("left", "source.at").alias("left"), F.min_by("plain", "source.at").alias("plain"), F.max_by("right", "source.at").alias("right"), F.count("*").alias("n")), "ends")
    before = ends.select(F.col("run").alias("up"), F.col("right").alias("left"), F.col("n").alias("offset"))
    joined = ends.filter("plain").select("run", "left").join(before, "left").select("run", "up", "offset")
    heads = ends.select("run").join(joined.select("run"), "run", "left_anti").select("run", F.col("run").alias("up"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("done"))
    table, left = spill(heads.unionByName(joined.withColumn("done", F.lit(False))), "pointers"), -1
    while (now := table.filter("not done").count()) not in (0, left):
        left = now
        target = table.select(F.col("run").alias("up"), F.col("up").alias("far"), F.col("offset").alias("more"), F.col("done").alias("ended"))
        moved = table.filter("not done").join(target, "up").select("run", F.col("far").alias("up"), (F.col("offset") + F.col("more")).alias("offset"), F.col("ended").alias("done"))
        table = spill(table.filter("done").unionByName(moved), "pointers")
    return table.select("run", F.when(F.col("done"), F.col("up")).otherwise(F.col("run")).alias("path"), F.when(F.col("done"), F.col("offset")).otherwise(0).alias("offset"))


def repeated_spans(docs: DataFrame, n: int = 50, k: int = 12, salts: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: figures of all rows (doc_id, n_words, sha, first), verified spans (doc_id, own, begin, words, source, source_own, source_begin,
    path, path_begin) of the representatives of classes, and the texts of documents with edges (doc_id, own, sha, text).

    path names the nonbranching path that a span follows and path_begin the edge of it that the span begins at."""
    base = spill(_minimizers(docs, n, k), "minimizers")
    able = base.filter((F.col("n_words") >= n) & F.col("doc_id").isNotNull())
    shared = able.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("sha", "first")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    figures = base.select("doc_id", "n_words", "sha", F.pmod(F.hash("doc_id"), F.lit(salts)).alias("salt")).join(shared, ["sha", "salt"], "left").select("doc_id", "n_words", "sha", "first")
    figures = spill(figures, "figures")

    lone = able.join(figures.filter("first is not null and doc_id <> first").select("doc_id", "sha"), ["doc_id", "sha"], "left_anti")
    # Texts that share a doc_id are told apart by a small number, 0 nearly always, instead of their long digest.
    clash = lone.groupBy("doc_id").agg(F.sort_array(F.collect_set("sha")).alias("shas")).filter(F.size("shas") > 1).select("doc_id", F.posexplode("shas").alias("own", "sha"))
    lone = lone.join(spill(clash, "clash"), ["doc_id", "sha"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    lone = spill(lone.select("doc_id", "own", "sha", "least"), "lone")
    each = lone.select("doc_id", "own", F.explode("least").alias("minimizer"))
    twice = each.groupBy("minimizer").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("minimizer")
    asked = each.join(twice, "minimizer").groupBy("doc_id", "own").agg(F.collect_set("minimizer").alias("shared"))  # as many as the document has
    asked = asked.join(lone.select("doc_id", "own", "sha"), ["doc_id", "own"])
    held = spill(_edges(docs.select("doc_id", "text").join(asked, "doc_id"), n, k), "edges").filter(F.size("at") > 0)

    edges = held.select("doc_id", "own", F.explode(F.arrays_zip("at", "left", "right")).alias("e")).select("doc_id", "own", "e.at", "e.left", "e.right")
    runs = spill(_runs(edges), "runs")  # written, so that a join with a hot edge has partitions of its own to split
    met = edges.join(runs.select("left", "right", "source", "run"), ["left", "right"]).filter(F.col("doc_id") > F.col("source.doc_id"))
    # A span goes on while the next edge is next in the document and in the run.
    order = Window.partitionBy("doc_id", "own").orderBy("at")
    last, step = F.lag(F.struct("source", "run")).over(order), F.col("at") - F.lag("at").over(order)
    same = (step <= 1) & (last["run"] == F.col("run")) & (F.col("source.at") - last["source"]["at"] == step)  # 0: a repeated row
    marked = met.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("doc_id", "own", "span").agg(F.min("at").alias("begin"), (F.max("at") - F.min("at") + n).alias("words"), F.min("source").alias("from"), F.min("run").alias("run"))
    spans = spans.select("doc_id", "own", "begin", "words", F.col("from.doc_id").alias("source"), F.col("from.own").alias("source_own"), F.col("from.at").alias("source_begin"), "run").distinct()
    spans = spill(spans, "spans")

    ends = spans.select("doc_id", "own", "begin", "words").union(spans.select("source", "source_own", "source_begin", "words")).distinct()
    lists = ends.groupBy("doc_id", "own").agg(F.collect_list(F.struct("begin", "words")).alias("asked"))
    texts = held.select("doc_id", "own", "sha", "text").dropDuplicates(["doc_id", "own"])
    digests = spill(_digests(texts.join(lists, ["doc_id", "own"]).select("doc_id", "own", "text", "asked")), "digests")
    here = digests.withColumnsRenamed({"doc": "doc_id"})
    there = digests.withColumnsRenamed({"doc": "source", "own": "source_own", "begin": "source_begin", "digest": "source_digest"})
    good = spans.join(here, ["doc_id", "own", "begin", "words"]).join(there, ["source", "source_own", "source_begin", "words"]).filter("digest = source_digest")
    good = good.join(_paths(runs), "run")
    return figures, good.select("doc_id", "own", "begin", "words", "source", "source_own", "source_begin", "path", (F.col("offset") + F.col("source_begin") - F.col("run.at")).alias("path_begin")), texts


def without_repeats(docs: DataFrame, n: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs (doc_id, text).

    A word goes if a window of n words over it also starts in a document with a smaller doc_id; all windows are judged on
    the input. Null, empty and shorter texts keep all words; equal doc_ids don't count as smaller, so repeated
    rows fare alike; rows with a null doc_id neither lose words nor are a source; no rows give no rows; other columns are not read.
    """
    figures, spans, texts = repeated_spans(docs, n)
    of_doc = spans.groupBy("doc_id", "own").agg(F.collect_list(F.struct("begin", "words")).alias("spans"))
    cut = spill(_cut(texts.join(of_doc, ["doc_id", "own"]).select("doc_id", "sha", "text", "spans")), "cut")
    copy = F.col("first").isNotNull() & F.col("doc_id").isNotNull() & (F.col("doc_id") > F.col("first"))
    out = figures.join(cut, ["doc_id", "sha"], "left")
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
