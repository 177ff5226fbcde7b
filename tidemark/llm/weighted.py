"""Document fingerprints by consistent weighted sampling.

A term's weight in a text is 1 + ln(occurrences); terms are the lower-cased words. For each of `SAMPLES` samples a term has
gamma variates r and c and a uniform b, drawn from a hash of the term alone. With weight w, t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1); the sample of a text is the (term, t) with the least a. Two texts agree in a sample with
the probability of their generalised Jaccard similarity (sum of least weights by sum of greatest). A fingerprint keeps
16 bits of each sample's least a, which names its (term, t).

Defined results: a null text is an empty one; a text without words has a fingerprint of zeros, like to another such
text only. Equal texts have equal fingerprints, whatever batch or machine they meet.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow

SAMPLES = 128
CACHED = 200_000
PAIRS = 30_000
STEP = 256  # terms at a time, so that their numbers stay in the processor's cache
ROWS_PER_PART = 5_000
MAX_PARTS = 10_000


def _uniforms(seeds: np.ndarray, stream: int, samples: int = SAMPLES) -> np.ndarray:
    """Two uniform numbers in (0, 1) per term and sample (last axis), from the halves of a mix of the term's hash, the
    sample and the stream."""
    z = seeds[:, None] + (np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(4) + np.uint64(stream)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    uniform = z.view("<u4").astype(np.float64).reshape(*z.shape, 2)
    uniform += 0.5
    uniform *= 2.0 ** -32
    return uniform


def least(terms: list[tuple[str, int]]) -> np.ndarray:
    """ln a of each (term, occurrences) and sample."""
    seeds = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 7) for t, _ in terms], np.uint64)
    u = _uniforms(seeds, 0)
    r = -np.log(u[..., 0] * u[..., 1])
    u = _uniforms(seeds, 1)
    c = np.log(-np.log(u[..., 0] * u[..., 1]))
    b = _uniforms(seeds, 2, SAMPLES // 2).reshape(len(terms), SAMPLES) - 1
    # t is 0 for a term that occurs once: its weight is 1
    many = np.flatnonzero(np.array([n for _, n in terms]) > 1)
    if len(many):
        logs = np.log(np.array([1.0 + math.log(terms[i][1]) for i in many]))
        b[many] -= np.floor(logs[:, None] / r[many] + b[many] + 1)
    return (c + r * b).astype(np.float32)


class Sampler:
    """Fingerprints of texts, with a bounded table of (term, occurrences) met before; when it is full, the half used most
    stays."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, int], int] = {}  # in order of their row
        self.table = np.empty((CACHED + PAIRS, SAMPLES), np.float32)
        self.uses = np.zeros(CACHED + PAIRS, np.int64)

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        return self.both(texts, [None] * len(texts))[0]

    def both(self, texts: list[str], others: list[str | None]) -> np.ndarray:
        """Fingerprints of the texts and of each one's other text (zeros if None). What both hold as often is looked
        up once."""
        best = np.full((2, len(texts), SAMPLES), np.inf, np.float32)
        parts: list[tuple[tuple[int, ...], int, list[tuple[str, int]]]] = []
        total = 0
        for i, (text, other) in enumerate(zip(texts, others)):
            own = Counter(text.lower().split())
            if other is None:
                groups = [((0,), list(own.items()))]
            else:
                theirs = Counter(other.lower().split())
                in_own, in_theirs = own.get, theirs.get
                groups = [((0, 1), [x for x in own.items() if in_theirs(x[0]) == x[1]]),
                          ((0,), [x for x in own.items() if in_theirs(x[0]) != x[1]]),
                          ((1,), [x for x in theirs.items() if in_own(x[0]) != x[1]])]
            for sides, terms in groups:
                for k in range(0, len(terms), PAIRS):
                    part = terms[k:k + PAIRS]
                    if total + len(part) > PAIRS:
                        self._lower(best, parts)
                        parts, total = [], 0
                    parts.append((sides, i, part))
                    total += len(part)
        self._lower(best, parts)
        return np.where(np.isposinf(best), np.uint16(0), _bits(best))

    def _lower(self, best: np.ndarray, parts: list[tuple[tuple[int, ...], int, list[tuple[str, int]]]]) -> None:
        index = self._index([t for _, _, x in parts for t in x])
        at = 0
        for sides, i, terms in parts:
            least_here = self.table[index[at:at + len(terms)]].min(axis=0)
            at += len(terms)
            for side in sides:
                np.minimum(best[side, i], least_here, out=best[side, i])

    def _index(self, terms: list[tuple[str, int]]) -> np.ndarray:
        """Rows of the table for the terms; at most PAIRS of them."""
        if len(self.rows) >= CACHED:
            self._halve()
        rows = self.rows
        index = np.fromiter(map(rows.get, terms, itertools.repeat(-1)), np.int64, len(terms))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            first = len(rows)
            new = list(dict.fromkeys([terms[i] for i in missing]))
            for i in range(0, len(new), STEP):
                self.table[first + i:first + i + len(new[i:i + STEP])] = least(new[i:i + STEP])
            rows.update(zip(new, range(first, first + len(new))))
            index[missing] = [rows[terms[i]] for i in missing]
        self.uses[:len(rows)] += np.bincount(index, minlength=len(rows))
        return index

    def _halve(self) -> None:
        keep = np.sort(np.argpartition(-self.uses[:len(self.rows)], CACHED // 2)[:CACHED // 2])
        terms = list(self.rows)
        self.rows = {terms[j]: i for i, j in enumerate(keep.tolist())}
        self.table[:len(keep)] = self.table[keep]
        self.uses[:len(keep)] = self.uses[keep] // 2
        self.uses[len(keep):] = 0


def _bits(values: np.ndarray) -> np.ndarray:
    """16 mixed bits of each value; never all zero, which stands for no words."""
    z = np.ascontiguousarray(values, np.float32).view(np.uint32) * np.uint32(0x9E3779B1)
    z = (z ^ (z >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return np.maximum(z >> np.uint32(16), 1).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint (hex) of each text."""
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            prints = sampler.fingerprints([v.as_py() or "" for v in batch.column(text)])
            hexes = [p.astype(">u2").tobytes().hex() for p in prints]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hexes, pa.string())], names=schema.names)

    return map_arrow(df, run, schema)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, ends, key, text), each part in descending key order in one partition, closed by its successor.

    Keys are cut at quantiles into parts; the head of each part also goes, with `ends` set, to the end of the part before
    it (of the first part: to the last). So every row meets its successor although no task sees more than a part, and texts move
    once. At most `MAX_PARTS` heads come to the driver. Equal keys are ordered by text; null keys come last.
    """
    total = df.count()
    parts = max(1, min(MAX_PARTS, total // ROWS_PER_PART))
    cuts = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()[0] or []
    cuts = sorted(set(cuts), reverse=True) if parts > 1 else []
    part = F.lit(len(cuts)) if not cuts else F.coalesce(
        F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("_key"))), F.lit(len(cuts)))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn(
        "part", F.when(F.col("_key").isNull(), F.lit(len(cuts))).otherwise(part))
    heads = {r[0]: r[1] for r in rows.groupBy("part").agg(F.max("_key")).collect()}
    filled = sorted(heads)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    head = F.create_map(*[F.lit(x) for p in filled for x in (p, heads[p])]) if filled else F.lit(None)
    to = F.create_map(*[F.lit(x) for p in filled for x in (p, before[p])]) if filled else F.lit(None)
    if not filled:
        return rows.select("part", F.lit(False).alias("ends"), F.col("_key").alias(key), F.col("_text").alias(text))
    places = F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("e")),
                     F.when(F.col("_key").eqNullSafe(head[F.col("part")]), F.struct(to[F.col("part")].alias("p"), F.lit(True).alias("e"))))
    spread = rows.select(F.explode(F.array_compact(places)).alias("at"), "_key", "_text").select(
        F.col("at.p").alias("part"), F.col("at.e").alias("ends"), F.col("_key").alias(key), F.col("_text").alias(text))
    return spread.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(
        "part", "ends", F.col(key).desc_nulls_last(), F.col(text).asc_nulls_first())


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the fingerprint of the text, of the text whose last third is replaced by the successor's beginning,
    and the likeness of the first to the second and to the successor's."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(
        T.StructField(n, t) for n, t in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()),
                                         ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()),
                                         ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        held: list[tuple] = []  # the last row: (part, ends, key, text), which waits for its successor
        for batch in batches:
            key_type = batch.schema.field(key).type
            for i in range(0, batch.num_rows, 500):
                piece = batch.slice(i, 500)
                rows = held + [(p, e, k, t or "") for p, e, k, t in zip(*(piece.column(n).to_pylist() for n in ("part", "ends", key, text)))]
                held = rows[-1:]
                edited: list[str | None] = [None] * len(rows)
                for j, ((part, ends, _, body), after) in enumerate(itertools.pairwise(rows)):
                    if part == after[0] and not ends:  # only the first closing row counts
                        third = len(body) // 3
                        edited[j] = body[:len(body) - third] + after[3][:third]
                prints, others = sampler.both([r[3] for r in rows], edited)
                done = [j for j, e in enumerate(edited) if e is not None]
                if done:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([rows[j][2] for j in done], key_type), pa.array([len(rows[j][3]) for j in done], pa.int64()),
                        pa.array([hashlib.sha256(edited[j].encode("utf-8", "surrogatepass")).hexdigest() for j in done]),
                        pa.array([prints[j].astype(">u2").tobytes().hex() for j in done]),
                        pa.array([others[j].astype(">u2").tobytes().hex() for j in done]),
                        pa.array([likeness(prints[j], others[j]) for j in done], pa.float64()),
                        pa.array([likeness(prints[j], prints[j + 1]) for j in done], pa.float64())], names=schema.names)

    return map_arrow(with_next(df, key, text), run, schema)
