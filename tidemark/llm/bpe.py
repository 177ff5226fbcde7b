"""Byte-level BPE by ranks: encoding and decoding of whole texts.

Pre-tokenisation runs without regular expressions. Every code point has a class; a small automaton over classes knows
where a token starts. A character is a function from states to states, and composition is associative, so a long text
is cut into blocks, the functions of all blocks are composed independently, a scan over blocks gives the state at each
block's start, and a last sweep over all blocks at once yields the boundaries. White space forgets the past (its
function is constant), so most blocks need only the characters behind their last one.

The slices between boundaries go through pair merging, lowest rank first and leftmost of equals, with a bounded cache
per worker. Offsets of all tokens are kept, so a token can be traced to its bytes; decoding joins the tokens' bytes.

Special tokens do not exist here: their strings are ordinary text. Defined results: a null text is an empty one (no
tokens); repeated rows are encoded alike; result columns replace input columns of the same name.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_arrow

# Classes of code points.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE, ONE, C_R, C_V, C_L, C_E, END = range(12)
# States: what the last character was. After QUOTED a contraction may follow; HAVE_* wait for its second letter.
BEGIN, LETTERS, NUMBERS, OTHERS, BLANKS, SPACED, QUOTED, HAVE_R, HAVE_V, HAVE_L, DONE = range(11)
BLOCK = 128
CACHED = 400_000
# The code points that Unicode calls white space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        table[cp] = kinds.get(unicodedata.category(chr(cp))[0], OTHER)
    table[WHITE] = BLANK
    table[[ord(" "), ord("'")]] = SPACE, QUOTE
    table[[ord(c) for c in "stmd"]] = ONE
    table[[ord(c) for c in "rvle"]] = C_R, C_V, C_L, C_E
    return table


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, 'a token starts here' and 'a token started one character back', each by class * 16 + state."""
    after, here, back = (np.zeros(12 * 16, np.uint8) for _ in range(3))
    letters = {LETTER, ONE, C_R, C_V, C_L, C_E}
    second = {HAVE_R: C_E, HAVE_V: C_E, HAVE_L: C_L}
    run = {LETTERS: LETTER, NUMBERS: NUMBER, OTHERS: OTHER, QUOTED: OTHER}
    for c in range(12):
        for s in range(11):
            kind = LETTER if c in letters else OTHER if c == QUOTE else c
            state, starts, late = s, True, False
            if c == END:
                state, starts = BEGIN, False
            elif c in (BLANK, SPACE):
                state, starts = (BLANKS if c == BLANK else SPACED), s not in (BLANKS, SPACED)
            else:
                state = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}[kind]
                starts = s != SPACED and run.get(s) != kind
                late = s in (BLANKS, SPACED)  # the last blank before a word stands alone or goes with it
                if s == QUOTED and kind == LETTER:
                    state = {ONE: DONE, C_R: HAVE_R, C_V: HAVE_V, C_L: HAVE_L}.get(c, LETTERS)
                    starts = state == LETTERS
                elif s in second:
                    state, starts = (DONE, False) if c == second[s] else (state, kind != LETTER)
                if c == QUOTE and starts:
                    state = QUOTED
            if s in second and c != second[s]:
                late = True  # no contraction: its letter begins a word
            after[c * 16 + s], here[c * 16 + s], back[c * 16 + s] = state, starts, late
    return after, here, back


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Flags of token starts for a sequence of classes that ends with END (END separates texts)."""
    after, here, back = automaton()
    n = len(classes)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, END, np.uint8)
    padded[:n] = classes
    blocks = (padded * 16).reshape(rows, BLOCK)
    steps = np.ascontiguousarray(blocks.T)
    # 1. The function of each block: constant behind a forgetting character, else composed for all states.
    forgets = (blocks == BLANK * 16) | (blocks == SPACE * 16) | (blocks == END * 16)
    known = forgets.any(axis=1)
    last = np.where(known, BLOCK - 1 - np.argmax(forgets[:, ::-1], axis=1), 0)
    function = np.tile(np.arange(16, dtype=np.uint8), (rows, 1))
    at = np.flatnonzero(known)
    state, where = after[blocks[at, last[at]]], last[at] + 1
    while len(at):
        done = where == BLOCK
        function[at[done]] = state[done, None]
        at, state, where = at[~done], state[~done], where[~done]
        state, where = after[blocks[at, where] + state], where + 1
    long = np.flatnonzero(~known)
    if len(long):
        composed = function[long]
        for j in range(BLOCK):
            composed = after[np.minimum(steps[j, long, None] + composed, 191)]
        function[long] = composed
    # 2. Scan over blocks: compose with the function 1, 2, 4, ... blocks before until all are constant.
    step = 1
    scanned = function
    while step < rows and (scanned[:, :11] != scanned[:, :1]).any():
        scanned = np.concatenate([scanned[:step], np.take_along_axis(scanned[step:], scanned[:-step].astype(np.intp), 1)])
        step *= 2
    state = np.concatenate([[BEGIN], scanned[:-1, BEGIN]]).astype(np.uint8)
    # 3. All blocks at once, character by character.
    index = np.empty((BLOCK, rows), np.uint8)
    for j in range(BLOCK):
        np.add(steps[j], state, out=index[j])
        state = after[index[j]]
    index = np.ascontiguousarray(index.T).reshape(-1)[:n]
    starts = here[index].astype(bool)
    starts[:-1] |= back[index[1:]].astype(bool)
    return starts


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: merge the pair of lowest rank, leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    if len(parts) > 48:
        return _merge_long(parts, ranks)
    top = len(ranks) + 256
    pairs = [ranks.get(a + b, top) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == top:
            break
        i = pairs.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], top)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], top)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, for slices where a search per merge would cost the square of the length."""
    n = len(parts)
    right, left, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if not live[i] or parts[i] is not a or j >= n or parts[j] is not b:
            continue
        parts[i], live[j], right[i] = a + b, False, right[j]
        if right[j] < n:
            left[right[j]] = i
        for x in (left[i], i):
            if x >= 0 and (y := right[x]) < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for p, on in zip(parts, live) if on]


class Codec:
    """Ranks, their inverse and the cache of merged slices; one per worker and file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def slices(self, texts: list[bytes]) -> list[list[bytes]]:
        """Pre-tokens of each text."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = data[lead].astype(np.uint32)
        for first, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            at = np.flatnonzero(points >= first) if more == 1 else at[data[lead[at]] >= first]
            value = data[lead[at]].astype(np.uint32) & mask
            for k in range(1, more + 1):
                value = value << 6 | (data[lead[at] + k] & 0x3F)
            points[at] = value
        classes = class_table()[points]
        classes[np.searchsorted(lead, ends)] = END
        flags = boundaries(classes)
        starts = lead[flags]
        first = np.searchsorted(starts, np.concatenate([[0], ends[:-1] + 1]))
        counts = np.diff(np.append(first, len(starts)))
        out = []
        for text, base, a, k in zip(texts, ends - np.array([len(t) for t in texts]), first, counts):
            cuts = (starts[a:a + k] - base).tolist()
            out.append([text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)])])
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cache, out = self.cache, []
        for pieces in self.slices(texts):
            for p in set(pieces).difference(cache) if len(pieces) > 50 else pieces:
                if p not in cache:
                    cache[p] = np.array(merge_piece(p, self.ranks), "<u4").tobytes()
            out.append(b"".join([cache[p] for p in pieces]))
            if len(cache) > CACHED:
                cache.clear()
        return out

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte position of every token of an encoded text."""
        sizes = self.lengths[np.frombuffer(ids, "<u4")]
        return np.cumsum(sizes) - sizes

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def chunks(values: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (null: empty) as UTF-8, about `size` bytes each, with the row where they start."""
    start, out, total = 0, [], 0
    for i, v in enumerate(values.cast(pa.large_binary())):
        out.append(v.as_py() or b"")
        total += len(out[-1])
        if total >= size:
            yield start, out
            start, out, total = i + 1, [], 0
    if out:
        yield start, out


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """Replaces `text` by `ids` (binary: 32-bit little-endian ids) and, if named, the token offsets (array<bigint>)."""
    df = df.drop(*{ids, offsets} - {None, text})
    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField(ids, T.BinaryType()), *(
        [T.StructField(offsets, T.ArrayType(T.LongType()))] if offsets else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            keep = [f.name for f in rest]
            for start, texts in chunks(batch.column(text)):
                coded = own.encode(texts)
                columns = [batch.column(c).slice(start, len(texts)) for c in keep] + [pa.array(coded, pa.binary())]
                if offsets:
                    columns.append(pa.array([own.offsets(c) for c in coded], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(df.select(*[f.name for f in rest], text), run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes (binary) that the ids stand for; null ids give empty bytes."""
    df = df.drop(decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for start, coded in chunks(batch.column(ids), 4 << 20):
                plain = pa.array([own.decode(c) for c in coded], pa.binary())
                part = batch.slice(start, len(coded))
                yield pa.RecordBatch.from_arrays([*part.columns, plain], names=schema.names)

    return map_arrow(df, run, schema)
