"""Secret scans with a recursive decoding worklist: each layer of a text is scanned, what it encodes is scanned too."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

# The kinds in the order that breaks ties of spans, and their patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # maximal runs, so the same as runs filtered by length
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one layer: leftmost non-overlapping matches of each kind that pass."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


class Layer:
    """A text and where each stretch of it stands in the document.

    marks: (from, start, end) by rising `from`: characters from `from` on, up to the next mark, stand at start,
    start + 1, ... if end is None, else each of them stands at start:end as a whole."""

    def __init__(self, text: str, marks: list[tuple[int, int, int | None]]):
        self.text, self.marks, self.froms = text, marks, [m[0] for m in marks]

    def place(self, i: int) -> tuple[int, int]:
        """Where character i stands in the document."""
        at, start, end = self.marks[bisect_right(self.froms, i) - 1]
        return (start + i - at, start + i - at + 1) if end is None else (start, end)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Least span of the document that holds all of i:j."""
        a, b = self.place(i), self.place(j - 1)
        return min(a[0], b[0]), max(a[1], b[1])

    def rewritten(self, changes: list[tuple[int, int, str]]) -> Layer:
        """With i:j replaced by other text, for each change; the rest keeps its place."""
        text, marks, done, size = [], [], 0, 0

        def keep(upto: int) -> None:
            nonlocal size
            i = done
            while i < upto:
                k = bisect_right(self.froms, i) - 1
                stop = min(upto, self.froms[k + 1] if k + 1 < len(self.froms) else upto)
                at, start, end = self.marks[k]
                marks.append((size, start + i - at, None) if end is None else (size, start, end))
                size += stop - i
                i = stop
            text.append(self.text[done:upto])

        for i, j, new in changes:
            keep(i)
            if new:
                marks.append((size, *self.span(i, j)))
                text.append(new)
                size += len(new)
            done = j
        keep(len(self.text))
        return Layer("".join(text), marks or [(0, 0, 0)])


_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: A run of escaped and plain characters of URLs with an escape in it, and how packed bytes begin.
_URLRUN = re.compile(r"(?<![A-Za-z0-9%._~!*'()+,;:@/?&=$-])[A-Za-z0-9._~!*'()+,;:@/?&=$-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9._~!*'()+,;:@/?&=$-]*+)++")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+|(?:&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2})*")
#: Bytes that two blocks of unpacked text share; what is encoded in a longer run can be cut at a block's end.
OVERLAP = 1 << 20
_HEXRUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){12,}(?![0-9A-Fa-f])")
#: How gzip, bzip2, xz and zlib streams begin in base64: a packed part may follow other characters of the alphabet, such as a path.
_PACKED64 = re.compile(r"H4sI|Qlpo|/Td6WFoA|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")
#: Bytes without any of these (NUL left out, for UTF-16) hold no span and encode nothing, so they need not become a layer.
_TRIGGER = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9A-Fa-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}|&#|[A-Za-z0-9+/_-]{16}")


def _text(data: bytes) -> str:
    """The text of bytes: UTF-16 if marked so or if a third of them are NUL, else UTF-8, else Latin-1, so that each layer can be scanned."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    if data.count(0) * 3 >= len(data):
        return data.decode("utf-16-le" if data[1::2].count(0) >= data[::2].count(0) else "utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _packing(data: bytes):  # noqa: ANN202
    """What unpacks data if it is gzip, zlib, bzip2 or xz."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def _inflated(data: bytes, most: int) -> Iterator[bytes]:
    """Unpacked bytes of all members of data, `most` at a time, so that a bomb can't fill the memory, and what follows
    the last; nothing if data is not packed."""
    some = False
    while (unpack := _packing(data)) is not None:
        try:
            while not unpack.eof:
                if out := unpack.decompress(data, most):
                    some = True
                    yield out
                data = getattr(unpack, "unconsumed_tail", b"")
                if not out and not data and not unpack.eof:  # it ends too early
                    return
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            return
        data = unpack.unused_data.lstrip(b"\0")
    if some and data:
        yield data


def _blocks(data: bytes, most: int) -> Iterator[bytes]:
    """_inflated in blocks that repeat the last OVERLAP bytes of the one before."""
    held = b""
    fresh = False
    for chunk in _inflated(data, most):
        held, fresh = held + chunk, True
        if len(held) >= most + OVERLAP:
            yield held
            held, fresh = held[-OVERLAP:], False
    if fresh:
        yield held


def _unpacked(data: bytes, most: int, seen: frozenset[bytes] = frozenset()) -> Iterator[str]:
    """Text of decoded bytes in blocks: unpacked as often as they are packed (with a stop at what was seen before), then read as text."""
    key, some = hashlib.sha256(data).digest(), False
    if key not in seen:
        for block in _blocks(data, most):
            some = True
            yield from _unpacked(block, most, seen | {key})
    if not some and data:
        yield _text(data)


def _percent(run: str) -> str:
    return _text(bytes.fromhex(run.replace("%", "")))


def _unescaped(run: str) -> str | None:
    try:
        text = "".join(map(chr, _codes(run))).encode("utf-16", "surrogatepass").decode("utf-16")  # joins surrogate pairs
    except (ValueError, OverflowError, UnicodeDecodeError):
        return None
    return text


def _base64(run: str, most: int) -> Iterator[str]:
    """What a run of base64 characters decodes to, in each of the four alignments, as characters before it may belong to something else;
    and what is unpacked from each place where a packed stream begins."""
    for body in re.split("=+", re.sub(r"\s+", "", run).translate({45: 43, 95: 47})):  # padding ends a stretch

        def decoded(at: int) -> bytes:
            part = body[at : len(body) - ((len(body) - at) % 4 == 1)]  # a last character by itself has no whole byte
            return base64.b64decode(part + "=" * (-len(part) % 4))

        for at in range(min(4, len(body))):
            data = decoded(at)
            if _packing(data) is not None:
                yield from _unpacked(data, most)  # as text if it only looks packed
            elif _TRIGGER.search(data.replace(b"\0", b"") if 0 in data else data):
                yield _text(data)
        for m in _PACKED64.finditer(body, 4):
            data = decoded(m.start())
            if _packing(data) is not None:
                yield from _unpacked(data, most)


def _codes(run: str) -> list[int]:
    return [int(next(g for g in m.groups()[:4] if g), 16) if not m[5] else int(m[5]) for m in _ESCAPE.finditer(run)]


def _unpacked_in(data: bytes, most: int) -> Iterator[str]:
    for m in _MAGIC.finditer(data):
        if next(_inflated(data[m.start() :], 1), None):
            yield from _unpacked(data[m.start() :], most)


def layers(layer: Layer, most: int) -> Iterator[Layer]:
    """What a layer encodes: itself with all URL escapes, or all Unicode escapes, undone; each base64 or hex run undone; what is
    unpacked from bytes that are written with escapes."""
    text = layer.text
    if "%" in text:
        for m in _URLRUN.finditer(text):
            for d in _unpacked_in(unquote_to_bytes(m[0]), most):
                yield Layer(d, [(0, *layer.span(m.start(), m.end()))])
        changes = [(m.start(), m.end(), _percent(m[0])) for m in _PERCENT.finditer(text)]
        if changes:
            yield layer.rewritten(changes)
    if "\\" in text or "&#" in text:
        for m in _UNICODE.finditer(text):
            if max(codes := _codes(m[0])) < 256:
                for d in _unpacked_in(bytes(codes), most):
                    yield Layer(d, [(0, *layer.span(m.start(), m.end()))])
        changes = [(m.start(), m.end(), d) for m in _UNICODE.finditer(text) if (d := _unescaped(m[0])) is not None]
        if changes:
            yield layer.rewritten(changes)
    for m in _BASE64.finditer(text):
        for d in _base64(m[0], most):
            yield Layer(d, [(0, *layer.span(m.start(), m.end()))])
    for m in _WRAPPED.finditer(text):
        for i in {m.start(), m.start(1)}:  # the first line may be a heading such as that of PEM
            for d in _base64(text[i : m.end()], most):
                yield Layer(d, [(0, *layer.span(i, m.end()))])
    for m in _HEXRUN.finditer(text):
        for d in _unpacked(bytes.fromhex(m[0]), most):
            yield Layer(d, [(0, *layer.span(m.start(), m.end()))])


def find(text: str | None, most: int = 16 << 20) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans of a text, and all spans with those of decoded layers mapped to the text, each by start, then kind.

    A layer whose text has been met at the same place is not taken up again, so the worklist ends at its fixpoint. Packed runs
    are unpacked and scanned whole, in blocks of about `most` bytes."""
    text = text or ""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(scan(text), key=order)
    spans = set(base)
    work = [Layer(text, [(0, 0, None)])]
    seen: set[tuple] = set()
    while work:
        for new in layers(work.pop(), most):
            key = (hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).digest(), tuple(new.marks))
            if new.text and key not in seen:
                seen.add(key)
                work.append(new)
                spans |= {(*new.span(i, j), kind) for i, j, kind in scan(new.text)}
    return base, sorted(spans, key=order)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{i}:{j}" for i, j, kind in spans)


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping or touching spans replaced by mask; null stays null."""
    if not text:
        return text
    out, done = [], 0
    merged: list[list[int]] = []
    for i, j, _ in find(text)[1]:
        if merged and i <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], j)
        else:
            merged.append([i, j])
    for i, j in merged:
        out += [text[done:i], mask]
        done = j
    return "".join([*out, text[done:]]) if merged else text


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs (doc_id, text).

    Null and empty texts have no spans (base_sha256 of the empty string); repeated rows come repeatedly, a null
    doc_id stays null, no rows give no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            found = [find(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]), pa.array([listed(every) for _, every in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted_documents(docs: DataFrame) -> DataFrame:
    """docs with the secrets of text masked; all rows and columns stay, n_chars is counted anew if present."""
    names = docs.schema.names
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            texts, cols = [redact(t) for t in b.column(at).to_pylist()], list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if size is not None:
                cols[size] = pa.array([len(t or "") for t in texts], pa.int64()).cast(b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
