"""Secrets in whole texts, also behind nested encodings.

A worklist holds layers of a text. The first is the text itself; a layer is scanned, then unwrapped: its percent
escapes are decoded, its Unicode escapes are decoded, and what its base64 runs hold becomes layers of their own: readable
stretches of UTF-8 or UTF-16 in any of the four phases, and the content of compressed streams (gzip, zlib, bzip2, xz, raw
deflate; all members) at any place. New layers join the list until none is left. A layer that repeats one it was
unwrapped from is not taken, which ends cycles such as streams that unpack to themselves; otherwise equal content is
taken again wherever it comes from another span of the text.
Every layer carries, for each character, the span of the text it came from, so findings in any depth are spans of the
text. Findings of the first layer are the base; deeper ones are added, never replacing a base span.

A base64 run has 16 characters at least. Streams are unpacked to their end in windows of 16 MiB that share 1 MiB, one window at a
time, so memory is bounded whatever they hold; a single finding or nested run longer than the shared part may be found in
parts. Defined results: a null text is an
empty one (no spans); result columns replace input columns of the same name; repeated rows are scanned alike.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{76}\r?\n|[A-Za-z0-9+/]{64}\r?\n)+[A-Za-z0-9+/]*={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
URL_SAFE = str.maketrans("-_", "+/", "\r\n")
GLUE = re.compile(r"[/+]")  # what `/`, `-` and `_` became
MAGIC = re.compile(rb"(?P<gzip>\x1f\x8b\x08)|(?P<zlib>\x78[\x01\x5e\x9c\xda])|(?P<bzip2>BZh[1-9]1AY&SY)|(?P<xz>\xfd7zXZ\x00)")
READABLE = re.compile(rb"[\t\r\n\x20-\x7e]{12}")  # no finding and no further layer is shorter
WIDE = re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){12,}|(?:\x00[\t\r\n\x20-\x7e]){12,}")
PIECE = 1 << 16
WINDOW, OVERLAP = 16 << 20, 1 << 20
PROBE = 1 << 10
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of one layer: leftmost, not overlapping within a kind."""
    low = text.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text and, per character, where it comes from in the original; None: the text is the original. `chain` has the
    content hashes of the layer and of those it was unwrapped from."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end
        self.chain: frozenset[bytes] = frozenset()

    def mark(self) -> bytes:
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest()

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self.start is None:
            own = np.arange(len(self.text) + 1)
            return own[:-1], own[1:]
        return self.start, self.end


def _spliced(layer: Layer, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """The layer with [a, b) replaced by strings whose characters come from the given spans of the layer."""
    start, end = layer.arrays()
    texts, starts, ends, at = [], [], [], 0
    for a, b, plain, first, last in parts:
        texts += [layer.text[at:a], plain]
        starts += [start[at:a], start[first]]
        ends += [end[at:a], end[last]]
        at = b
    texts.append(layer.text[at:])
    return Layer("".join(texts), np.concatenate([*starts, start[at:]]), np.concatenate([*ends, end[at:]]))


def percent(layer: Layer) -> Layer | None:
    parts = []
    for m in PERCENT.finditer(layer.text) if "%" in layer.text else ():
        raw = bytes.fromhex(m[0].replace("%", ""))
        plain = raw.decode("utf-8", "replace")
        sizes = np.array([len(c.encode()) if c != "�" else 1 for c in plain])
        if sizes.sum() != len(raw):  # invalid bytes that became one mark each or in groups: the whole run is their origin
            first, last = np.full(len(plain), m.start()), np.full(len(plain), m.end() - 1)
        else:
            ends = np.cumsum(sizes)
            first, last = m.start() + 3 * (ends - sizes), m.start() + 3 * ends - 1
        parts.append((m.start(), m.end(), plain, first, last))
    return _spliced(layer, parts) if parts else None


def unicode_escapes(layer: Layer) -> Layer | None:
    parts = []
    for m in ESCAPE.finditer(layer.text) if "\\" in layer.text or "&#" in layer.text else ():
        s = m[0]
        value = int(s[2:-1]) if s[0] == "&" and s[2] != "x" else int(re.sub(r"[^0-9A-Fa-f]", "", s[3 if s[0] == "&" else 2:]), 16)
        if value < 0x110000 and not 0xD800 <= value < 0xE000:
            parts.append((m.start(), m.end(), chr(value), np.array([m.start()]), np.array([m.end() - 1])))
    return _spliced(layer, parts) if parts else None


def _tool(form: str):
    if form == "bzip2":
        return bz2.BZ2Decompressor()
    if form == "xz":
        return lzma.LZMADecompressor()
    return zlib.decompressobj({"gzip": 31, "zlib": 15, "deflate": -15}[form])


def _pieces(raw: bytes, at: int) -> Iterator[bytes]:
    for i in range(at, len(raw), PIECE):
        yield raw[i:i + PIECE]


def _unpacked(pieces: Iterable[bytes], form: str) -> Iterator[bytes]:
    """The content of all members of a stream, at most `PIECE` bytes at a time, up to its end or first error."""
    tool = None
    for piece in pieces:
        while piece or (tool is not None and not getattr(tool, "needs_input", True)):
            if tool is None:
                piece = piece.lstrip(b"\0")  # members may be padded
                if not piece:
                    break
                tool = _tool(form)
            try:
                out = tool.decompress(piece, PIECE)
            except (OSError, zlib.error, lzma.LZMAError, EOFError):
                return
            if out:
                yield out
            if tool.eof:
                piece, tool = tool.unused_data, None
            else:
                piece = getattr(tool, "unconsumed_tail", b"")
    if tool is not None and hasattr(tool, "flush"):
        try:
            yield tool.flush()
        except zlib.error:
            return


def _contents(raw: bytes, at: int, form: str) -> Iterator[bytes]:
    """Windows of what the stream at a place holds, streams directly within streams unpacked too. No window if it is
    no stream or one that unpacks to itself."""
    pieces, met = _pieces(raw, at), set()
    while True:
        stream, head = _unpacked(pieces, form), bytearray()
        for piece in stream:
            head += piece
            if len(head) >= WINDOW:
                break
        else:
            stream = iter(())
        mark = hashlib.sha256(head).digest()
        if not head or mark in met:
            return
        met.add(mark)
        inner = MAGIC.match(head)
        if not inner or next(_unpacked([bytes(head)], inner.lastgroup), None) is None:
            break
        # a stream that ended is let go, so levels do not pile up
        pieces, form = itertools.chain([bytes(head)], stream), inner.lastgroup
    fresh = True
    while fresh:
        yield bytes(head)
        del head[:max(0, len(head) - OVERLAP)]
        fresh = False
        for piece in stream:
            head += piece
            fresh = True
            if len(head) >= WINDOW:
                break


def _texts(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, first byte, bytes per character) of what may hold a secret. All patterns are ASCII and every byte of a longer
    UTF-8 character is none, so bytes are read as one character each."""
    if READABLE.search(raw):
        yield raw.decode("latin-1"), 0, 1
    for m in WIDE.finditer(raw) if b"\0" in raw else ():
        yield m[0].replace(b"\0", b"").decode("ascii"), m.start(), 2


def _decoded(run: str) -> bytes:
    run = run[:len(run) - (len(run) % 4 == 1)]
    return binascii.a2b_base64(run + "=" * (-len(run) % 4))


def base64_runs(layer: Layer) -> Iterator[Layer]:
    """Layers behind the base64 runs. A run may be glued to letters, a path or a name, so each is decoded in all four phases, and
    compressed streams are sought at every place; a stream without a signature starts the run or follows `/`, `-` or `_`."""
    start = end = None
    for m in BASE64.finditer(layer.text):
        if start is None:
            start, end = layer.arrays()
        whole = m[0].rstrip("=")
        run = whole.translate(URL_SAFE)
        places = np.arange(m.start(), m.start() + len(run)) if len(run) == len(whole) else \
            m.start() + np.flatnonzero([c not in "\r\n" for c in whole])

        def packed(raw: bytes, at: int, form: str, char: int) -> Iterator[Layer]:
            a = int(start[places[char]:m.end()].min())
            b = int(end[places[char]:m.end()].max())
            for window in _contents(raw, at, form):
                for text, _, _ in _texts(window):
                    yield Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)))

        for phase in range(4):
            raw = _decoded(run[phase:])
            for text, first, width in _texts(raw):
                at = first + width * np.arange(len(text))
                yield Layer(text, start[places[phase + at * 8 // 6]], end[places[phase + ((at + width) * 8 - 1) // 6]])
            for sign in MAGIC.finditer(raw):
                yield from packed(raw, sign.start(), sign.lastgroup, phase + sign.start() * 8 // 6)
        for char in (0, *(x.end() for x in GLUE.finditer(run))):
            probe = next(_unpacked([_decoded(run[char:char + PROBE])], "deflate"), b"")
            if READABLE.search(probe) or WIDE.search(probe):
                yield from packed(_decoded(run[char:]), 0, "deflate", char)


def _behind(layer: Layer) -> Iterator[Layer]:
    for new in itertools.chain((percent(layer), unicode_escapes(layer)), base64_runs(layer)):
        if new is not None and new.text:
            yield new


def scan_text(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, base) of all layers, in order."""
    base = find(text)
    found = {x: True for x in base}
    first = Layer(text)
    first.chain = frozenset([first.mark()])
    work, seen = [(first, _behind(first))], set()
    while work:
        layer, rest = work[-1]
        new = next(rest, None)
        if new is None:
            work.pop()
            continue
        mark = new.mark()
        place = mark, new.origin(0, len(new.text))
        if mark in layer.chain or place in seen:
            continue
        seen.add(place)
        new.chain = layer.chain | {mark}
        for a, kind, b in find(new.text):
            s, e = new.origin(a, b)
            found.setdefault((s, kind, e), False)
        work.append((new, _behind(new)))
    return sorted((s, k, e, b) for (s, k, e), b in found.items())


def scan(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds `spans`: array of (kind, start, end, base) in code points, end exclusive."""
    df = df.drop(spans)
    schema = T.StructType([*df.schema.fields, T.StructField(spans, T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(text):
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b}
                             for s, k, e, b in scan_text(value.as_py() or "")])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(ARROW_SPAN))], names=schema.names)

    return map_arrow(df, run, schema)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with every span replaced by `mark`; overlapping spans are replaced together. Null stays null."""
    schema = df.schema

    def clean(value: str | None) -> str | None:
        out, at = [], 0
        for s, _, e, _ in scan_text(value) if value else ():
            if s >= at:
                out += [value[at:s], mark]
            at = max(at, e)
        return "".join([*out, value[at:]]) if out else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = schema.names.index(text)
        for batch in batches:
            columns = list(batch.columns)
            columns[k] = pa.array([clean(v.as_py()) for v in columns[k]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(df, run, schema)
