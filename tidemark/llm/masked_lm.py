"""Masked pseudo-likelihood of texts under a small bidirectional network.

Tokens are the UTF-8 bytes of a text, so every script is covered: each byte value that occurs in the corpus has a symbol of its own, one
marks the edge of a text, and the last stands for byte values that the corpus lacks. The network predicts each token from
`SIDE` tokens on both sides: their embeddings, one matrix per place, are added, pass tanh, and a softmax names the token. A
text's score is the sum of the log probabilities of its tokens, each with all the others given.

Training: the counts of all windows (left, token, right) of the whole corpus are a sufficient statistic of the loss. They are counted
with partial sums, stored, and dealt by hash to shards, `SHARDS` at least and one more for each `SHARD_WINDOWS` windows. In each
round every shard runs Adam in numpy over its windows, in the order of their codes, starting from the common weights, and
sends back only its weights; the driver averages these by the shards' token counts. The corpus alone decides what a shard
holds, so the weights do not depend on the machines. What crosses to the driver has the size of the model per shard.

Scoring: a batch holds far fewer different contexts than tokens, so the network runs once per context, some thousand at a time.

Defined results: a null or empty text has no tokens, score 0 and null mean; repeated rows count and score each; result columns replace
input columns of the same name; an empty corpus leaves the network at its start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow
from .suffix_dedup import store

SIDE = 2
HIDDEN = 32
SHARDS = 12
SHARD_WINDOWS = 4_000_000
ROUNDS = 8
BATCH = 1024
STEPS = 200  # at least so many steps a round; a shard with few windows goes over them several times
RATE = 0.01
EDGE = 0
BITS = 9  # an edge, 256 bytes; five symbols fill 45 bits
MASK = (1 << BITS) - 1
CHUNK = 1 << 21
CONTEXTS = 1 << 14


@dataclass
class Model:
    points: np.ndarray  # byte values with symbols 1, 2, ...
    weights: list[np.ndarray]  # place tables (2 SIDE, symbols, HIDDEN), bias, output (HIDDEN, symbols), output bias


def _ids(texts: list[bytes], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts with SIDE edges between them, and the place of each text's first symbol."""
    gap = b"\x00" * SIDE
    raw = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    table = np.full(256, len(points) + 1, np.int64)
    table[points] = np.arange(1, len(points) + 1)
    ids = table[raw]
    starts = SIDE + np.cumsum([0, *[len(t) + SIDE for t in texts[:-1]]])
    lengths = np.array([len(t) for t in texts])
    for k in range(SIDE):
        ids[starts - 1 - k] = EDGE
        ids[starts + lengths + k] = EDGE
    return ids, starts


def _codes(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window code, text) of every token; a code is the context and, in its last bits, the token."""
    text = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    code = np.zeros(len(at), np.int64)
    for k in (*range(-SIDE, 0), *range(1, SIDE + 1), 0):
        code = code << BITS | ids[at + k]
    return code, text


def _chunks(values: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    first, part, size = 0, [], 0
    for i, v in enumerate(values):
        part.append((v.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= CHUNK:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def used_bytes(docs: DataFrame, text: str) -> np.ndarray:
    """The byte values that occur, by counts over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch.column(text)):
                total += np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total))], names=["point"])

    found = map_arrow(docs.select(text), run, "point long").distinct().collect()  # 256 at most
    return np.array(sorted(r["point"] for r in found), np.int64)


def window_counts(docs: DataFrame, text: str, points: np.ndarray) -> DataFrame:
    """(context, token, n): how often each window occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, numbers = [], []
            for _, texts in _chunks(batch.column(text)):
                ids, starts = _ids(texts, points)
                code, n = np.unique(_codes(ids, starts, np.array([len(t) for t in texts]))[0], return_counts=True)
                codes.append(code)
                numbers.append(n)
            if not codes:
                continue
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(back, np.concatenate(numbers)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return map_arrow(docs.select(text), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def fresh(symbols: int, seed: int = 7) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.3, (2 * SIDE, symbols, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
            rng.normal(0, 0.1, (HIDDEN, symbols)).astype(np.float32), np.zeros(symbols, np.float32)]


def _places(context: np.ndarray) -> np.ndarray:
    shifts = np.arange(2 * SIDE - 1, -1, -1) * BITS
    return (context[:, None] >> shifts) & MASK


def forward(weights: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hidden, log probabilities of all symbols) for context codes."""
    tables, bias, out, out_bias = weights
    places = _places(context)
    hidden = np.tanh(tables[np.arange(2 * SIDE), places].sum(axis=1) + bias)
    logits = hidden @ out + out_bias
    logits -= logits.max(axis=1, keepdims=True)
    return places, hidden, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def fit(weights: list[np.ndarray], context: np.ndarray, token: np.ndarray, n: np.ndarray, rate: float, seed: int) -> list[np.ndarray]:
    """Adam over weighted windows, all of them at least once; a window's weight is its count, on the scale of its batch."""
    weights = [w.copy() for w in weights]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    rng, mean = np.random.default_rng(seed), n.mean()
    order = np.concatenate([rng.permutation(len(n)) for _ in range(-(-STEPS * BATCH // len(n)))])
    for step, i in enumerate(range(0, len(order), BATCH), 1):
        at = order[i:i + BATCH]
        places, hidden, logs = forward(weights, context[at])
        share = (n[at] / (mean * len(at))).astype(np.float32)[:, None]
        error = np.exp(logs)
        error[np.arange(len(at)), token[at]] -= 1
        error *= share
        inner = (error @ weights[2].T) * (1 - hidden * hidden)
        tables = np.zeros_like(weights[0])
        for k in range(2 * SIDE):
            np.add.at(tables[k], places[:, k], inner)
        for j, grad in enumerate((tables, inner.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
            first[j] = 0.9 * first[j] + 0.1 * grad
            second[j] = 0.99 * second[j] + 0.01 * grad * grad
            weights[j] -= (rate * first[j] / (1 - 0.9 ** step) / (np.sqrt(second[j] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return weights


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Fits the network to all windows of all texts. A task holds one shard's windows at a time."""
    points = used_bytes(docs, text)
    counts = store(window_counts(docs, text, points))
    shards = SHARDS + counts.count() // SHARD_WINDOWS
    counts = counts.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int"))
    weights = fresh(len(points) + 2)
    for k in range(rounds):
        start, speed = weights, rate * 0.7 ** k

        def run(batches: Iterator[pa.RecordBatch], start=start, speed=speed, k=k) -> Iterator[pa.RecordBatch]:
            parts = [[c.to_numpy() for c in b.columns] for b in batches]
            if not parts:
                return
            codes, counted, owner = (np.concatenate(c) for c in zip(*parts))
            for shard in np.unique(owner):
                at = np.flatnonzero(owner == shard)
                at = at[np.argsort(codes[at])]
                code, n = codes[at], counted[at]
                fitted = fit(start, code >> BITS, code & MASK, n.astype(np.float64), speed, k)
                raw = b"".join(w.astype("<f4").tobytes() for w in fitted)
                yield pa.RecordBatch.from_arrays([pa.array([int(shard)]), pa.array([int(n.sum())]), pa.array([raw], pa.binary())],
                                                 names=["shard", "n", "raw"])

        dealt = counts.repartitionById(shards, F.col("shard"))
        back = sorted(map_arrow(dealt, run, "shard long, n long, raw binary").collect(), key=lambda r: r["shard"])
        if not back:
            break
        total = sum(r["n"] for r in back)
        flat = sum(np.frombuffer(r["raw"], "<f4").astype(np.float64) * (r["n"] / total) for r in back).astype(np.float32)
        cuts = np.cumsum([w.size for w in start])[:-1]
        weights = [p.reshape(w.shape) for p, w in zip(np.split(flat, cuts), start)]
    return Model(points, weights)


def window_scores(weights: list[np.ndarray], code: np.ndarray) -> np.ndarray:
    """The log probability of each window's token; codes in order."""
    context = code >> BITS
    firsts = np.flatnonzero(np.diff(context, prepend=-1))
    bounds = np.append(firsts, len(code))
    out = np.zeros(len(code), np.float32)
    for i in range(0, len(firsts), CONTEXTS):
        heads = firsts[i:i + CONTEXTS]
        a, b = bounds[i], bounds[min(i + CONTEXTS, len(firsts))]
        logs = forward(weights, context[heads])[2]
        out[a:b] = logs[np.searchsorted(heads, np.arange(a, b), "right") - 1, code[a:b] & MASK]
    return out


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds n_tokens, log_prob (sum over tokens) and mean_log_prob."""
    docs = docs.drop("n_tokens", "log_prob", "mean_log_prob")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()),
                           T.StructField("mean_log_prob", T.DoubleType())])
    points, weights = model.points, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch.column(text)):
                lengths = np.array([len(t) for t in texts])
                code, owner = _codes(*_ids(texts, points), lengths)
                back, seen = pd.factorize(code)
                order = np.argsort(seen)
                logs = np.zeros(len(seen), np.float32)
                logs[order] = window_scores(weights, seen[order])
                total = np.bincount(owner, logs[back], len(texts)).astype(np.float64)
                mean = np.divide(total, lengths, out=np.zeros(len(texts)), where=lengths > 0)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lengths.astype(np.int64)), pa.array(total, pa.float64()),
                                                  pa.array(mean, pa.float64(), mask=lengths == 0)], names=schema.names)

    return map_arrow(docs, run, schema)
