"""Token counts without ids: byte-pair merging over a heap and a linked list."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cut_at_spaces


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table


class _Counts(dict):
    """A dict that computes what it lacks."""

    def __init__(self, compute):  # noqa: ANN001
        self.compute = compute

    def __missing__(self, key: str) -> int:
        value = self[key] = self.compute(key)
        return value


class PairCounter:
    """Counts tokens of texts under a byte-level BPE file (vocabulary, merges, special strings).

    The count of a piece is its initial symbols minus its merges. Counts of pieces and of chunks
    are cached; each cache is emptied at `keep` entries, so memory is bounded.
    """

    def __init__(self, path: str, pattern: str, keep: int = 500_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.symbol = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(pattern).findall
        self.keep, self.of_piece = keep, {}
        self.of_chunk = _Counts(lambda chunk: self._whole(" " + chunk))

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token: pop the lowest-ranked, leftmost adjacent pair until no pair has a rank."""
        sym: list[str | None] = [self.symbol[b] for b in piece.encode("utf-8", "surrogatepass")]
        n, rank = len(sym), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = a + b, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return n - merges

    def _whole(self, text: str) -> int:
        total, of_piece = 0, self.of_piece
        parts = self.cut.split(text) if self.cut else [text]
        for part in parts:
            for p in self.pieces(part):
                if (c := of_piece.get(p)) is None:
                    if len(of_piece) > self.keep:
                        of_piece.clear()
                    c = of_piece[p] = self.merged(p)
                total += c
        return total + len(parts) - 1

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        cut = cut_at_spaces(text)
        if cut is None:
            return self._whole(text)
        if len(self.of_chunk) > self.keep:
            self.of_chunk.clear()
        head, rest = cut
        return self._whole(head) + sum(map(self.of_chunk.__getitem__, rest))


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> PairCounter:
    """One for each file and worker process, so that tasks share its caches."""
    return PairCounter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows come repeatedly, a null doc_id
    stays null, no rows give no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
