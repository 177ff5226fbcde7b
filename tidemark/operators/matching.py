"""Exact substring join: which dictionary terms occur in which texts. One plan for dictionaries of any size.

A term is filed under the hash of one of its windows: of the width in WIDTHS that is next below its length (so at least
four fifths of a term up to the widest are in it), the one that fewest terms have. Hashes of all windows of a text come
from one running sum of powers, so one vectorised pass over the texts, in Arrow batches, looks up every position. It
knows only a filter of bounded size (two marks per hash, broadcast) and passes on (text, hash) for what the filter has;
Spark joins these with the filed terms, gathers the candidates of a text in one list, and each is searched for once in
the text's own row. A text moves once, however many candidates it has.

Terms stay in Spark; the driver sees the marks of the filter. With more terms than it distinguishes more windows pass,
and the result stays exact. A window in very many texts is a join key with one or few terms on its other side, which
Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import snippet_at
from ..session import materialize, reachable

WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 18, 22, 27, 32)
WIDEST = WIDTHS[-1]
MARKS_PER_TERM = 64
MIN_MARKS, MAX_MARKS = 1 << 18, 1 << 24
BLOCK = 1 << 16  # characters looked at together
FACTOR = 0x9E3779B97F4A7C15  # odd, so that its powers can be undone
UNDO = pow(FACTOR, -1, 1 << 64)
SECOND = 20


def contained_terms(texts: DataFrame, terms: DataFrame, key: str = "topic_id", text: str = "text",
                    term: str = "term") -> DataFrame:
    """(key, term, context) for every term that is a substring of the text. `key` is unique in `texts`."""
    base = texts.select(F.col(key), F.col(text).alias("text"))
    return base.join(candidates(base, terms, key, term), key).select(key, F.inline(found_terms(F.col("text"), F.col("terms"))))


def candidates(texts: DataFrame, terms: DataFrame, key: str = "topic_id", term: str = "term") -> DataFrame:
    """(key, terms): per text (column `text`) the terms whose window it has. Texts without any have no row."""
    filed = materialize(filed_terms(terms, term))
    size = _filter_size(filed.count())
    marks = filed.select(F.explode(F.array(*_slots(F.col("hash"), size))).alias("slot")).distinct().toArrow().column(0).to_numpy()
    table = np.zeros(size, dtype=bool)
    table[marks] = True
    widths = sorted(r[0] for r in filed.select("width").distinct().collect())  # of WIDTHS
    met = _windows_met(texts.select(key, "text"), key, widths, texts.sparkSession.sparkContext.broadcast(table))
    return met.join(filed.select("hash", "term"), "hash").groupBy(key).agg(F.collect_set("term").alias("terms"))


def filed_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, width, hash): each distinct term under its window that fewest terms have, the first of these."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            width = [_width(len(w)) for w in words]
            hashes = [_hashes(_running(_codes(w)), n, len(w)) for w, n in zip(words, width)]
            counts = [len(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(words, dtype=object), counts), pa.string()), pa.array(np.repeat(width, counts), pa.int32()),
                 pa.array(np.concatenate([np.arange(c) for c in counts]) if counts else [], pa.int32()),
                 pa.array(np.concatenate(hashes).view(np.int64) if hashes else [], pa.int64())], names=["term", "width", "at", "hash"])

    words = terms.select(F.col(term).alias("term")).where("term IS NOT NULL AND term <> ''").distinct()
    spread = reachable(words).mapInArrow(windows, "term string, width int, at int, hash bigint")
    shared = spread.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("width", "hash")))
    return shared.groupBy("term").agg(F.min(F.struct("n", "at", "width", "hash")).alias("w")).select("term", "w.width", "w.hash")


def _windows_met(texts: DataFrame, key: str, widths: list[int], bits) -> DataFrame:
    """(key, hash) of windows that the filter has, once per block of a text."""
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            # Texts are laid side by side, a block at a time; a long one runs over blocks that overlap.
            bodies = batch.column("text").to_pylist()
            waiting: list[tuple[int, str]] = []
            size = 0
            for row, body in enumerate(bodies):
                for at in range(0, len(body or ""), BLOCK):
                    piece = body[at:at + BLOCK + WIDEST - 1]
                    waiting.append((row, piece))
                    size += len(piece)
                    if size >= BLOCK:
                        yield found(batch, waiting, table)
                        waiting, size = [], 0
            if waiting:
                yield found(batch, waiting, table)

    def found(batch: pa.RecordBatch, pieces: list[tuple[int, str]], table: np.ndarray) -> pa.RecordBatch:
        running = _running(_codes("".join(p for _, p in pieces)))
        shift = 64 - (len(table).bit_length() - 1)
        ends = np.cumsum([len(p) for _, p in pieces])
        rows, hashes = [], []
        for width in widths:
            h = _hashes(running, width, int(ends[-1]))
            at = np.flatnonzero(table[h >> np.uint64(shift)])
            at = at[table[h[at] >> np.uint64(SECOND) & np.uint64(len(table) - 1)]]
            piece = np.searchsorted(ends, at, "right")
            inside = at + width <= ends[piece]
            rows.append(np.array([r for r, _ in pieces])[piece[inside]])
            hashes.append(h[at[inside]].view(np.int64))
        both = np.unique(np.stack([np.concatenate(rows), np.concatenate(hashes)], 1), axis=0) if rows else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(both[:, 0])), pa.array(both[:, 1])], names=schema.names)

    return reachable(texts).mapInArrow(run, schema)


def _width(length: int) -> int:
    return max(w for w in WIDTHS if w <= length)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


@lru_cache(4)
def _powers(factor: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, factor, dtype=np.uint64))


def _up_to(factor: int, n: int) -> np.ndarray:
    """factor ** 1 to factor ** n, modulo 2 ** 64."""
    return _powers(factor, max(1 << max(n - 1, 1).bit_length(), 4 * BLOCK))[:n]


def _running(codes: np.ndarray) -> np.ndarray:
    """Sums of code * FACTOR ** place up to every place."""
    return np.append(np.uint64(0), np.cumsum((codes + np.uint64(1)) * _up_to(FACTOR, len(codes))))


def _hashes(running: np.ndarray, width: int, length: int) -> np.ndarray:
    """The hash of every window of `width`: independent of its place."""
    n = length - width + 1
    return (running[width:width + n] - running[:n]) * _up_to(UNDO, n) if n > 0 else np.zeros(0, dtype=np.uint64)


def _filter_size(terms: int) -> int:
    return min(max(1 << (max(terms, 1) * MARKS_PER_TERM - 1).bit_length(), MIN_MARKS), MAX_MARKS)


def _slots(h: Column, size: int) -> tuple[Column, Column]:
    """Two places in the filter: by the highest digits and by middle ones."""
    return (F.shiftrightunsigned(h, 64 - (size.bit_length() - 1)), F.shiftrightunsigned(h, SECOND).bitwiseAND(F.lit(size - 1)))


def found_terms(text: Column, terms: Column) -> Column:
    """Array of (term, context) of those terms that the text contains; each is searched once."""
    placed = F.transform(terms, lambda t: F.struct(t.alias("term"), F.position(t, text).alias("at")))
    return F.transform(F.filter(placed, lambda p: p["at"] > 0), lambda p: F.struct(
        p["term"].alias("term"), snippet_at(text, p["term"], p["at"]).alias("context")))
