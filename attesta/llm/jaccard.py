"""N-gram Jaccard join: a MinHash LSH forest proposes, exact sets of shingles decide.

1. Texts of equal words are one class; only its representative goes on.
2. Each representative gets a key in every tree. A tree is its sorted keys, so neighbours show the longest prefix that a key
   shares with any other. Matched prefixes begin at full depth and are shortened tree by tree, the one that lets in
   the fewest new matches first, until the recall at the threshold reaches the target.
3. Under a trie node documents are compared by sketches of their signatures, and likely ones are linked to
   the least of them; a crowded node is linked to its least document as a whole. What these links connect is a part.
4. Parts are cut into blocks of bounded size, and pairs of blocks are verified by products of
   their incidence matrices; what leaves a task is a count and a root for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, counted, lean, spill, words
from .shingles import MinHash, shingle_set

#: Documents of a trie node that are compared with each other; the exact way for larger nodes is a link of all to the least.
CROWD = 512


def forest_depths(threshold: float, trees: int, target: float, matched: dict[tuple[int, int], int], least: int = 1) -> list[int]:
    """Prefix length, of `least` or more, of each tree at which a pair at the threshold shares a node of some tree with the target probability.

    matched[tree, n]: keys whose longest shared prefix in that tree has n hashes, so those that shortening it to n lets in. Starting from
    full depth, the tree with the fewest of them for its gain in recall is shortened next."""
    depths, miss = [MinHash.depth] * trees, lambda d: log(1 - threshold**d)
    total = trees * miss(MinHash.depth)
    while total > log(1 - target) and max(depths) > least:
        price = lambda t: ((1 + matched.get((t, depths[t] - 1), 0)) / (miss(depths[t]) - miss(depths[t] - 1)), t)
        t = min((t for t in range(trees) if depths[t] > least), key=price)
        total += miss(depths[t] - 1) - miss(depths[t])
        depths[t] -= 1
    return depths


def uniform_depth(threshold: float, trees: int, target: float) -> int:
    """The longest prefix that reaches the target in all trees alike."""
    depth = MinHash.depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def _signatures(docs: DataFrame, n: int, forest: MinHash) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            own, sets, sketches = [], [], []
            for t in b.column(1).to_pylist():
                ws = words(t)
                keys = forest.keys(s) if len(s := shingle_set(ws, n)) else None
                own.append(xxhash.xxh3_128_digest(b" ".join(ws)) if ws else None)
                sets.append(None if keys is None else keys.view(np.int64).tolist())
                sketches.append(None if keys is None else forest.sketch(keys))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "words_key", "forest", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words_key binary, forest array<long>, sketch binary")


def _matched(keys: DataFrame, least: int) -> DataFrame:
    """Rows doc_id, tree, key, matched: of the sorted keys of each tree those that share `least` hashes or more with a neighbour.

    Sorted by ranges, so that a hot key has as many tasks as it needs; the first and the last row of a range, whose neighbours
    are elsewhere, count as matched in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, tree, key, before = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64), MinHash.depth

        def rows(upto: int, near: np.ndarray) -> pa.RecordBatch:
            keep = np.flatnonzero(near[:upto] >= least)
            return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(tree[keep]), pa.array(key[keep].view(np.int64)), pa.array(near[keep].astype(np.int32))], ["doc_id", "tree", "key", "matched"])

        for b in batches:
            doc, tree = np.concatenate((doc, b.column(0).to_numpy())), np.concatenate((tree, b.column(1).to_numpy()))
            key = np.concatenate((key, b.column(2).to_numpy().view(np.uint64)))
            if not len(doc):
                continue
            apart, common = key[1:] ^ key[:-1], np.zeros(len(key) - 1, np.int64)
            for k in range(MinHash.depth):
                common += apart >> np.uint64(8 * k) == 0
            common[tree[1:] != tree[:-1]] = 0
            shared = np.concatenate(([before], common, [MinHash.depth]))
            yield rows(len(doc) - 1, np.maximum(shared[:-1], shared[1:]))
            doc, tree, key, before = doc[-1:], tree[-1:], key[-1:], shared[-2]
        if len(doc):
            yield rows(1, np.array([MinHash.depth]))

    # As many ranges as shuffle partitions; a number given to repartitionByRange would hold at any size.
    return keys.repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id").mapInArrow(run, "doc_id long, tree int, key long, matched int")


def _likely(under: DataFrame, agreement: int) -> DataFrame:
    """Links a, b of rows (trie, doc_id, sketch) to the least document of those that chains of likely pairs connect in a node.

    A node's rows are neighbours in a sorted partition; they are compared at distance 1, 2, ... over a whole batch at once."""

    def links(trie: np.ndarray, doc: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        half, n = sketch.shape[1] // 2, len(doc)
        root, step = np.arange(n), 1  # rows rise by doc_id within a node, so the least row is the least document
        while step < n and (near := trie[step:] == trie[:-step]).any():
            at = np.flatnonzero(near & (root[step:] != root[:-step]))  # what is connected already need not be compared
            for k in range(0, len(at), 1 << 14):
                i = at[k : k + (1 << 14)]
                apart = sketch[i] ^ sketch[i + step]
                i = i[64 * half - np.bitwise_count(apart[:, :half] | apart[:, half:]).sum(axis=1) >= agreement]
                a, b = root[i], root[i + step]
                while len(a):
                    parent = np.arange(n)
                    np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                    while (parent[parent] != parent).any():
                        parent = parent[parent]
                    root, a, b = parent[root], parent[a], parent[b]
                    a, b = a[a != b], b[a != b]
            step += 1
        far = np.flatnonzero(root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(doc[root[far]]), pa.array(doc[far])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held = None
        for b in batches:
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            trie = held.column(0).to_numpy()
            cut = int(np.flatnonzero(trie != trie[-1])[-1]) + 1 if trie[0] != trie[-1] else 0  # the last node may go on
            if cut >= 4096:
                yield links(*arrays(held.slice(0, cut)))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield links(*arrays(held))

    def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = b"".join(b.column(2).to_pylist())
        return b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(raw, np.uint64).reshape(b.num_rows, -1)

    return under.select("trie", "doc_id", "sketch").repartition("trie").sortWithinPartitions("trie", "doc_id").mapInArrow(run, "a long, b long")


def _verify(threshold: tuple[int, int]):  # noqa: ANN202
    """Group function over one pair of blocks: links and least linked node of each of its documents."""
    num, den = threshold

    def run(table: pa.Table) -> pa.Table:
        lean()
        node = np.array(table.column("node").to_pylist(), np.int64)
        side = np.array(table.column("block").to_pylist(), np.int64)
        weight = np.array(table.column("copies").to_pylist(), np.int64)
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        m = len(sets)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1  # shingles of a single document add nothing
        row = np.repeat(np.arange(m), size)
        shared = times[column] > 1
        row, column = row[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((m, m), np.float32)
        step = 4096
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            a, b = np.searchsorted(column, (at, at + step))
            dense = np.zeros((m, step), np.float32)
            dense[row[a:b], column[a:b] - at] = 1
            common += dense @ dense.T
        common = common.astype(np.int64)
        link = common * den >= num * (size[:, None] + size[None, :] - common)
        link &= node[:, None] != node[None, :]
        if low != high:
            link &= side[:, None] != side[None, :]
        links = link @ weight
        root = node.copy()
        while True:  # least node over links, until nothing changes
            new = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == root).all():
                break
            root = new
        return pa.table({"node": pa.array(node), "links": pa.array(links), "root": pa.array(root)})

    return run


def near_duplicates(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), trees: int = 32, target: float = 0.9999, block: int = 384, salts: int = 16, crowd: int = CROWD) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs (doc_id, text).

    n_links is the number of other documents whose sets of n-word shingles have a Jaccard similarity of
    threshold (a fraction) or more, copies included; class_id is the least doc_id of those that links connect. Texts
    of fewer than n words are one shingle. Null, empty and blank texts link to nothing. Rows that share a doc_id
    are one document, and links within it don't count; rows with a null doc_id link to nothing and have a null
    class_id. Repeated rows come repeatedly; no rows give no rows; other columns are not read.
    """
    num, den = threshold
    forest = MinHash(trees)
    sig = spill(_signatures(docs, n, forest), "forest")
    known = sig.filter("doc_id is not null and words_key is not null")
    classes = known.groupBy("words_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    # Only shared classes are joined, each under `salts` keys, so that a class of very many copies is dealt out.
    shared = classes.filter("copies > 1").select("words_key", "node", "copies", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = sig.select("doc_id", "words_key", F.pmod(F.hash("doc_id"), F.lit(salts)).alias("salt")).join(shared, ["words_key", "salt"], "left")
    rows = spill(rows.select("doc_id", F.col("words_key").isNotNull().alias("has"), F.coalesce("node", "doc_id").alias("node"), F.coalesce("copies", F.lit(1)).alias("copies")), "rows")

    alone = rows.groupBy("node").agg(F.max("copies").alias("copies"), F.max(F.when(F.col("doc_id") == F.col("node"), 1)).alias("own")).filter("own = 1 and node is not null").select("node", "copies")
    known = known.join(alone.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "forest", "sketch")
    shallow = max(1, uniform_depth(num / den, trees, target) - 1)
    keys = spill(_matched(known.select("doc_id", F.posexplode("forest").alias("tree", "key")), shallow), "matched")
    stats = {(r["tree"], r["matched"]): r["count"] for r in keys.groupBy("tree", "matched").count().collect()}  # trees x depths numbers
    depth = F.element_at(F.array(*map(F.lit, forest_depths(num / den, trees, target, stats, shallow))), F.col("tree") + 1)
    under = keys.withColumn("depth", depth).filter("matched >= depth").select("doc_id", F.xxhash64("tree", F.expr(f"shiftrightunsigned(key, 8 * ({MinHash.depth} - depth))")).alias("trie"))
    nodes = under.groupBy("trie").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    under = spill(under.join(nodes, "trie"), "under")
    crowded = under.filter((F.col("n") > crowd) & (F.col("doc_id") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    small = under.filter(F.col("n") <= crowd).select("trie", "doc_id").join(known.select("doc_id", "sketch"), "doc_id")
    edges = _likely(small, forest.least_agreement(num / den)).union(crowded).distinct()
    parts = connected(edges)

    sizes = parts.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    member = parts.join(sizes, "root").select(F.col("id").alias("node"), F.col("root").alias("part"), "blocks").join(alone, "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            own = [shingle_set(words(t), n).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + [pa.array(own, pa.binary())], ["node", "part", "blocks", "copies", "shingles"])

    # Merged at every size: members grow with the input, so one plan holds for small and large tables.
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(member.hint("merge"), "node").select("node", "part", "blocks", "copies", "text")
    held = spill(texts.mapInArrow(sets, "node long, part long, blocks int, copies long, shingles binary").filter(F.octet_length("shingles") > 0), "shingles")
    dealt = held.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "part", "copies", "shingles", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = spill(dealt.groupBy("part", "low", "high").applyInArrow(_verify(threshold), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    bonds = found.filter("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b"))
    joined = connected(bonds)
    nodes = links.join(joined, links["node"] == joined["id"], "left").select("node", "links", F.coalesce("root", "node").alias("root"))
    # Few classes hold most rows of a hot class, so its figures too are dealt over salted keys.
    wide = nodes.filter("links > 0 or root <> node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = rows.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts))).join(wide, ["node", "salt"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("class_id"), F.when(F.col("has") & F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of each class the document with the least doc_id stays, with all its columns.

    Of several rows with a doc_id that stays, the least in the order of all columns is kept; rows without a doc_id stay."""
    # Few rows go or share a doc_id, so these are sought, not those that stay; rows without a doc_id meet none of them.
    found = near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.col("class_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("rows"))
    special = counted(found.filter("not stays or rows > 1").select("doc_id", "stays"), "special")
    out = docs.join(special, "doc_id", "left_anti")
    if special.filter("stays").isEmpty():
        return out
    again = docs.join(special.filter("stays"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(again.select("row.*"))
