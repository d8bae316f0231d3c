"""What the operators of this subpackage share: words, scratch tables, chunk-wise token encoding."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); an error on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:  # a local session is one machine, so a folder of its own will do
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def spill(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of up to four numbers that a join may broadcast: about 100 bytes each in a hashed relation, so 40 MB at most.
FEW = 400_000


def counted(df: DataFrame, kind: str) -> DataFrame:
    """df, written and counted: a join broadcasts it if it has up to FEW rows, so that texts on the other side stay where
    they are; beyond that Spark is free to shuffle both sides."""
    df = spill(df, kind)
    return F.broadcast(df) if df.count() <= FEW else df


def connected(edges: DataFrame) -> DataFrame:
    """id, root for each end of edges (a, b): the least id of its component.

    First each id keeps just the edge to its least neighbour and hands its others over to that, so the edges of a dense group
    become few distinct ones between its least ids. Each round then takes the least label of all neighbours, then the label of that label, so chains
    shorten by halves. A node with many edges is aggregated before its rows are shuffled; labels are cut off at each round.
    """
    up = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    least = up.groupBy("b").agg(F.min("a").alias("m"))
    handed = up.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    few = least.select(F.col("m").alias("a"), "b").union(handed).distinct()
    both = few.union(few.select("b", "a")).distinct()
    both = spill(both, "edges")
    labels = spill(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        low = labels.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        low = spill(low, "labels")
        up = low.select(F.col("id").alias("root"), F.col("root").alias("up"))
        labels = spill(low.join(up, "root").select("id", F.least("root", "up").alias("root"), "was"), "labels")
        if labels.filter("root <> was").isEmpty():
            return labels.select("id", "root")
        labels = labels.select("id", "root")


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; bytes.split() knows just the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: A space before more white space, or white space before a space that ends the text: there a
#: run of white space may be one token, so the text can't be cut at its spaces.
_UNSAFE = re.compile(r" \s|\s \Z")


def cut_at_spaces(text: str) -> tuple[str, list[str]] | None:
    """What stands before the first space and after each space, where a byte-level pre-tokenizer always cuts before
    these spaces; None if it may not."""
    if _UNSAFE.search(text):
        return None
    head, *rest = text.split(" ")
    return head, rest


def _flags(values: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values.encode() if isinstance(values, str) else values)] = True
    return out


_LETTERS = _flags(bytes(range(65, 91)) + bytes(range(97, 123)))
_MARKS = _flags("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")  # without ', as it may begin a contraction
#: Second bytes of the letters from U+00C0 to U+00FF, whose first byte is C3.
_LATIN = _flags(bytes(set(range(0x80, 0xC0)) - {0x97, 0xB7}))


class ChunkEncoder:
    """Ids of texts from a tokenizers file, each distinct chunk of a text encoded once.

    A text is cut before its spaces and where a letter meets a mark, which the tokenizer does too. byte_level: also around a line end between two other
    characters; a space belongs to the chunk behind it. Otherwise the tokenizer drops white space, and a line end is as good as a space.
    Chunks are found and numbered in arrays, so a chunk costs Python's time once for each slice of texts. The cache has two halves: when the young one is full it
    becomes the old one, from which chunks met again move on. Both hold `keep` entries (about 200 bytes each), so memory is bounded.
    """

    #: Between chunks that are encoded together and don't begin with a space; one id by itself.
    _BAR = "\x01"
    #: Bytes of text whose chunks are numbered together.
    _SLICE = 2 << 20

    def __init__(self, path: str, byte_level: bool, keep: int = 900_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.byte_level, self.keep, self.cache, self.old = byte_level, keep, {}, {}
        self.opens, self.ends, self.bar = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(3))
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bar[self.tokenizer.encode(self._BAR, add_special_tokens=False).ids] = True
        self.marks = _MARKS.copy()  # an added token is never cut
        for t in self.tokenizer.get_added_tokens_decoder().values():
            self.marks[[ord(m) for m in t.content[1:] if ord(m) < 256]] = False

    def _encode(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, chunks: list[str], lead: str, bar: str, marks: np.ndarray, skip: int) -> list[bytes]:
        """Ids of each chunk out of one text of them all, cut before each marked id; one by one if there are not as many marks as chunks.

        skip leaves out the marked id itself (1), keeps it (0), or keeps it in the chunk that it ends (-1).
        """
        ids = np.frombuffer(self._encode([lead + bar.join(chunks)])[0], self.dtype)
        at = np.flatnonzero(marks[ids])
        if len(at) != len(chunks) or (at[-1] != len(ids) - 1 if skip < 0 else at[0] != 0):
            return self._encode(chunks)
        edges = np.concatenate(([0], at + 1)) if skip < 0 else np.concatenate((at, [len(ids)]))
        width, raw = self.dtype.itemsize, ids.tobytes()
        return [raw[a:b] for a, b in zip(((edges[:-1] + max(skip, 0)) * width).tolist(), (edges[1:] * width).tolist(), strict=True)]

    def _learn(self, fresh: list[str]) -> None:
        old = self.old
        self.cache.update((c, old[c]) for c in fresh if c in old)
        fresh = [c for c in fresh if c not in old]
        if self.byte_level:  # white space after a space may be one token with it: no text with such a chunk is cut
            spaced = [c for c in fresh if c[0] == " "]
            self.cache.update((c, None) for c in spaced if c == " " or c[1].isspace())
            rest = [c for c in fresh if c[0] != " "]
            plain = [c for c in rest if c.isascii() and c.isalpha()]
            ways = [([c for c in spaced if c != " " and not c[1].isspace()], "", "", self.opens, 0), (plain, self._BAR, self._BAR, self.bar, 1)]
            alone = [c for c in rest if not (c.isascii() and c.isalpha())]
            self.cache.update(zip(alone, self._encode(alone), strict=True))
        else:  # a chunk of letters is one word and has one word end
            words = {c: c.removeprefix(" ") for c in fresh}
            ways = [([c for c, w in words.items() if w.isalpha()], "", " ", self.ends, -1), ([c for c, w in words.items() if not w.isalpha()], self._BAR + " ", f" {self._BAR} ", self.bar, 1)]
        for own, *way in ways:
            for k in range(0, len(own), 1024):
                part = own[k : k + 1024]
                self.cache.update(zip(part, self._together(part, *way), strict=True))

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of texts, and the places where those of each text begin and end."""
        at = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if at[0] == at[-1]:
            return pa.array([], pa.string()), np.zeros(len(at), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
        at -= at[0]
        line = data == 10
        if not self.byte_level:
            data = np.where(line, np.uint8(32), data)
        cut = data == 32
        letter = _LETTERS[data]
        first = letter.copy()
        letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
        cut[1:] |= letter[:-1] & self.marks[data[1:]]
        if self.byte_level:
            black = letter | _MARKS[data]  # surely no white space
            line[1:] &= black[:-1]
            line[0] = False
            cut |= line
            cut[1:] |= line[:-1] & first[1:]
        cut[at[at < len(data)]] = True
        begins = np.flatnonzero(cut)
        edges = np.append(begins, len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(begins), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))), np.searchsorted(begins, at)

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.cache) > self.keep // 2:
            self.old, self.cache = self.cache, {}
        chunks, edges = self._chunks(texts)
        numbered = chunks.dictionary_encode()
        number, own, known = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), self.cache
        self._learn([c for c in own if c not in known])
        each = [known[c] for c in own]
        whole = []
        if None in each:  # these texts can't be cut
            bad = np.array([x is None for x in each])[number]
            whole = np.unique(np.searchsorted(edges, np.flatnonzero(bad), "right") - 1).tolist()
            each = [x or b"" for x in each]
        ids = np.frombuffer(b"".join(each), self.dtype)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        size = sizes[number]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[number] - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[edges].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for k in whole:
            out[k] = np.frombuffer(self._encode([texts[k].as_py()])[0], self.dtype)
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """An array of ids for each text; null is an empty text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        out, at = [], 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self._SLICE, "right")))
            out += self._slice(texts.slice(at, upto - at))
            at = upto
        return out


@lru_cache(maxsize=2)
def encoder(path: str, byte_level: bool, keep: int = 900_000) -> ChunkEncoder:
    """One for each file and worker process, so that tasks share its cache."""
    return ChunkEncoder(path, byte_level, keep)


def lean() -> None:
    """Give back the encoders that this worker process may hold from other work, and what Arrow doesn't use of its memory.

    Tasks of operators without an encoder begin with it, as workers outlive the stage that they were started for."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
