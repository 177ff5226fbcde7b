"""Alignment of two tokenizers: groups of tokens between common ends, links of overlapping tokens, corpus-wide link counts.

Two tokens overlap in one stretch without an end inside, so the links of a text are the stretches between neighbouring
ends of either side: one union of the ends lists them.

Counting does not move a record per link through Spark. It works with runs:

1. `aligned` encodes texts and gathers records (pair, text, times). Every SPILL records it sorts them, deals them by the
   low digits of the B id to BUCKETS runs, each packed with zstd in frames, and writes the runs as rows.
2. `partial_counts`: the runs of a bucket are dealt to groups of at most RECORDS_PER_GROUP records (salts), so that a pair
   that a third of all texts have is counted in many places. A heap merges the runs of a group, frame by frame, and each
   pair is counted.
3. `totals` merges the groups of a bucket the same way. Order is by B id first, so the highest count of a B id is known
   when its pairs have passed.
4. `contributions` reads the runs of each group again beside the totals, in the same order, and gives every text the sum of
   its links' counts and the number of its best links.

Memory: a task holds SPILL records, or the packed runs of one group and a frame of each, or the distinct pairs of one
bucket. Distinct pairs are bounded by the two vocabularies, not by the corpus.

Defined results: a null or empty text, or one whose tokens do not spell it (a blank before the text included), has no
tokens: zeros and an empty list. Repeated rows and ids are texts of their own. An empty table gives no rows. The output
has its own columns only.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .arrow import map_arrow, reachable
from .packing import encoder
from .suffix_dedup import store

SPILL = 2_000_000
FRAME = 32_768
BUCKETS = 16
RECORDS_PER_GROUP = 8_000_000
SLICE_CHARS = 2_000_000


# -- vocabularies ------------------------------------------------------------------------

class Side:
    """A tokenizer with the bytes of each id."""

    def __init__(self, encode, pieces: list[bytes]) -> None:
        self.encode, self.pieces = encode, pieces
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)

    def spelled(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(2)
def byte_side(path: str) -> Side:
    """The byte-level BPE of a tokenizers file, on a blank and the text; special tokens' strings are plain text."""
    own = encoder(path)
    special = set(own._special_tokens.values())
    pieces = [b"" if k in special else own.decode_single_token_bytes(k) for k in range(own.n_vocab)]
    return Side(lambda texts: [own.encode_to_numpy(" " + t, allowed_special=set(), disallowed_special=()).astype(np.int64) for t in texts], pieces)


@lru_cache(2)
def piece_side(path: str) -> Side:
    """A sentencepiece model, which puts a blank before the text itself."""
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(own.id_to_piece(k)[3:5], 16)]) if own.is_byte(k) else own.id_to_piece(k).replace("▁", " ").encode()
              for k in range(own.get_piece_size())]
    return Side(lambda texts: [np.array(ids, dtype=np.int64) for ids in own.encode(texts, num_threads=1)], pieces)


# -- runs ----------------------------------------------------------------------------------

def _pack(*columns: np.ndarray) -> bytes:
    """Equally long columns, differences split by the place of the byte, which packs well when sorted."""
    n = np.array([len(columns[0])], dtype="<u4").tobytes()
    parts = [np.diff(c, prepend=c.dtype.type(0)).astype(f"<u{c.itemsize}").view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns]
    return zstandard.compress(n + b"".join(parts), 3)


def _unpack(frame: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.decompress(frame)
    n, at, out = int(np.frombuffer(raw, "<u4", 1)[0]), 4, []
    for t in types:
        width = np.dtype(t).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel(), dtype=f"<u{width}").astype(t))
        at += n * width
    return out


RECORD = (np.uint32, np.uint32, np.uint32)  # pair, number of the text, times
COUNT = (np.uint32, np.uint64)              # pair, times


def write_run(*columns: np.ndarray) -> bytes:
    frames = [_pack(*(c[at:at + FRAME] for c in columns)) for at in range(0, len(columns[0]), FRAME)]
    return b"".join(len(f).to_bytes(4, "little") + f for f in frames)


def read_run(run: bytes, *types: type) -> Iterator[list[np.ndarray]]:
    at = 0
    while at < len(run):
        end = at + 4 + int.from_bytes(run[at:at + 4], "little")
        yield _unpack(run[at + 4:end], *types)
        at = end


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys once, with the sum of their times."""
    if not len(keys):
        return keys, times.astype(np.uint64)
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[start], np.add.reduceat(times.astype(np.uint64), start)


def merge_counts(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """k-way merge of sorted (keys, times) frames: a heap holds the frame of each run that begins first. What lies up to the
    least last key of the frames that begin before it can be counted; the rest of a frame goes back to the heap."""
    heap = []

    def push(k: int, keys: np.ndarray | None = None, times: np.ndarray | None = None) -> None:
        while keys is None or not len(keys):
            frame = next(runs[k], None)
            if frame is None:
                return
            keys, times = frame
        heapq.heappush(heap, (int(keys[0]), k, keys, times))

    for k in range(len(runs)):
        push(k)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while heap:
        taken = [heapq.heappop(heap)]
        cut = int(taken[0][2][-1])
        while heap and heap[0][0] <= cut:
            taken.append(heapq.heappop(heap))
            cut = min(cut, int(taken[-1][2][-1]))
        keys, times = [], []
        for _, k, own, own_times in taken:
            at = int(np.searchsorted(own, cut, "right"))
            keys.append(own[:at])
            times.append(own_times[:at])
            push(k, own[at:], own_times[at:])
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys, kind="stable")
        done.append(summed(keys[order], times[order]))
    if not done:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    return summed(np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done]))


# -- texts -----------------------------------------------------------------------------------

def align(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple:
    """(links: ends, index of the A and of the B token; common ends). Ends are ascending; both sides end together."""
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    again = np.append(both[1:] == both[:-1], False)
    ends = both[~again]
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), both[again]


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text (bucket null) with its numbers, and one per run (bucket set): `row` numbers the texts, `records` of a
    run are how many it has."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, docs.schema[key].dataType),
                           *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                           T.StructField("groups", T.StringType()), T.StructField("bucket", T.IntegerType()),
                           T.StructField("records", T.LongType()), T.StructField("run", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = byte_side(path_a), piece_side(path_b)
        width = len(side_a.pieces)
        if width * len(side_b.pieces) > 1 << 32:
            raise ValueError("vocabularies whose pairs do not fit 32 bits")
        words = [f"{k}{end}" for k in range(max(width, len(side_b.pieces))) for end in ",|;"]
        base, number = TaskContext.get().partitionId() << 33, 0
        waiting: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal count
            records = np.sort(np.concatenate(waiting))
            waiting.clear()
            count = 0
            start = np.flatnonzero(np.append(True, records[1:] != records[:-1]))
            times = np.diff(np.append(start, len(records))).astype(np.uint32)
            pair, doc = (records[start] >> 31).astype(np.uint32), (records[start] & (1 << 31) - 1).astype(np.uint32)
            where = pair // np.uint32(width) % np.uint32(BUCKETS)
            rows = []
            for k in range(BUCKETS):
                mine = np.flatnonzero(where == k)
                if len(mine):
                    rows.append((base, k, len(mine), write_run(pair[mine], doc[mine], times[mine])))
            row, bucket, n, runs = zip(*rows)
            return batch_of({"row": row, "bucket": bucket, "records": n, "run": runs}, len(rows))

        def batch_of(columns: dict, n: int) -> pa.RecordBatch:
            types = {f.name: pa.int64() for f in schema} | {"groups": pa.string(), "bucket": pa.int32(), "run": pa.binary(), key: key_type}
            return pa.RecordBatch.from_arrays([
                pa.array(columns[f.name], types[f.name]) if f.name in columns and not isinstance(columns[f.name], pa.Array)
                else columns.get(f.name, pa.nulls(n, types[f.name])) for f in schema], names=schema.names)

        for batch in batches:
            key_type = batch.schema.field(key).type
            bodies = [t or "" for t in batch.column(text).to_pylist()]
            cuts = [0]
            size = 0
            for k, body in enumerate(bodies):
                size += len(body)
                if size > SLICE_CHARS:
                    cuts.append(k + 1)
                    size = 0
            for low, high in zip(cuts, [*cuts[1:], len(bodies)]):
                if low == high:
                    continue
                own = bodies[low:high]
                full = [k for k, t in enumerate(own) if t]
                ids_a, ids_b = (side.encode([own[k] for k in full]) for side in (side_a, side_b))
                good = [j for j, k in enumerate(full) if side_a.spelled(ids_a[j]) == side_b.spelled(ids_b[j]) == (" " + own[k]).encode()]
                numbers = np.zeros((5, high - low), dtype=np.int64)
                lists = [""] * (high - low)
                if good:
                    at = np.array([full[j] for j in good])
                    a, b = (np.concatenate([ids[j] for j in good]) for ids in (ids_a, ids_b))
                    ends_a, ends_b = np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b])
                    sizes_a, sizes_b = (np.array([len(ids[j]) for j in good]) for ids in (ids_a, ids_b))
                    until_a, until_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
                    close = ends_a[until_a - 1]
                    ends, link_a, link_b, common = align(a, b, ends_a, ends_b)
                    links = np.diff(np.searchsorted(ends, close, "right"), prepend=0)
                    groups = np.diff(np.searchsorted(common, close, "right"), prepend=0)
                    numbers[:4, at] = sizes_a, sizes_b, groups, links
                    # Tokens in the order of the list: group by group, A before B.
                    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
                    first_b = np.searchsorted(group_b, np.arange(len(common)))
                    after_a = np.searchsorted(group_a, np.arange(len(common)), "right")
                    stream = np.empty(len(a) + len(b), dtype=np.int64)
                    stream[np.arange(len(a)) + first_b[group_a]] = a * 3 + (ends_a == common[group_a])
                    stream[np.arange(len(b)) + after_a[group_b]] = b * 3 + 2 * (ends_b == common[group_b])
                    begin = 0
                    for k, end in zip(at, until_a + until_b):
                        listed = "".join(map(words.__getitem__, stream[begin:end].tolist()))
                        lists[k] = hashlib.sha256(listed[:-1].encode()).hexdigest()
                        begin = end
                    pair = b[link_b] * width + a[link_a]
                    waiting.append(pair << 31 | np.repeat(number + at, links))
                    count += len(pair)
                yield batch_of({"row": pa.array(base + number + np.arange(high - low)), key: batch.column(key).slice(low, high - low),
                                "n_a": numbers[0], "n_b": numbers[1], "n_groups": numbers[2], "n_links": numbers[3], "groups": lists}, high - low)
                number += high - low
                if count >= SPILL:
                    yield flush()
        if count:
            yield flush()

    return map_arrow(docs.select(key, text), run, schema)


# -- counts ------------------------------------------------------------------------------------

def partial_counts(runs: DataFrame, slices: int, width: int) -> DataFrame:
    """(bucket, slice, run): counts of each group, cut by B id."""
    def count(table: pa.Table) -> pa.Table:
        keys, times = merge_counts([map(lambda f: summed(f[0], f[2]), read_run(r.as_py(), *RECORD)) for r in table.column("run")])
        part = keys // width // BUCKETS % slices
        rows = [(table.column("bucket")[0].as_py(), int(k), write_run(keys[m], times[m])) for k in np.unique(part)
                for m in [np.flatnonzero(part == k)]]
        return _table(rows, ("bucket", pa.int32()), ("slice", pa.int32()), ("run", pa.binary()))

    return reachable(runs).groupBy("bucket", "salt").applyInArrow(count, "bucket int, slice int, run binary")


def totals(parts: DataFrame, width: int) -> DataFrame:
    """(bucket, run): counts of all groups together; a best pair of its B id carries an odd number, twice the count plus 1."""
    def add(table: pa.Table) -> pa.Table:
        keys, times = merge_counts([map(tuple, read_run(r.as_py(), *COUNT)) for r in table.column("run")])
        start = np.flatnonzero(np.append(True, keys[1:] // width != keys[:-1] // width))
        most = np.repeat(np.maximum.reduceat(times, start), np.diff(np.append(start, len(keys))))
        marked = times * np.uint64(2) + (times == most)
        return _table([(table.column("bucket")[0].as_py(), write_run(keys, marked))], ("bucket", pa.int32()), ("run", pa.binary()))

    return reachable(parts).groupBy("bucket", "slice").applyInArrow(add, "bucket int, run binary")


def contributions(runs: DataFrame, counted: DataFrame, salts: int) -> DataFrame:
    """(row, n_best, count_sum) per text and group; `counted` is read once per group of its bucket."""
    def give(table: pa.Table) -> pa.Table:
        base, raw = table.column("base"), table.column("run")
        sums = [frame for b, r in zip(base, raw) if not b.is_valid for frame in read_run(r.as_py(), *COUNT)]
        keys, marked = (np.concatenate([f[k] for f in sums]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, marked = keys[order], marked[order].astype(np.int64)
        out = []
        for b, r in zip(base, raw):
            if not b.is_valid:
                continue
            rows, best, total = [], [], []
            for pair, doc, times in read_run(r.as_py(), *RECORD):
                value, times = marked[np.searchsorted(keys, pair)], times.astype(np.int64)
                low = int(doc.min())
                for given, n in ((best, times * (value & 1)), (total, times * (value >> 1))):
                    have = np.zeros(int(doc.max()) - low + 1, dtype=np.int64)
                    np.add.at(have, doc - low, n)
                    given.append(have)
                there = np.flatnonzero(total[-1])
                best[-1], total[-1] = best[-1][there], total[-1][there]
                rows.append(there + low)
            rows, best, total = (np.concatenate(x) for x in (rows, best, total))
            ids, where = np.unique(rows, return_inverse=True)
            both = np.zeros((2, len(ids)), dtype=np.int64)
            np.add.at(both[0], where, best)
            np.add.at(both[1], where, total)
            out.append((ids + b.as_py(), *both))
        return pa.table({n: pa.array(np.concatenate([o[k] for o in out])) for k, n in enumerate(("row", "n_best", "count_sum"))})

    spread = counted.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"),
                            F.lit(None).cast("long").alias("base"), "run")
    beside = runs.select("bucket", "salt", F.col("row").alias("base"), "run").unionByName(spread)
    return reachable(beside).groupBy("bucket", "salt").applyInArrow(give, "row bigint, n_best bigint, count_sum bigint")


def _table(rows: list[tuple], *fields: tuple) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, fields)})


def alignment(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): see the module. `groups` is the SHA-256 of the list
    of groups in hex, empty without tokens."""
    stored = store(aligned(docs, path_a, path_b, key, text))
    runs = stored.where("bucket IS NOT NULL")
    width = len(byte_side(path_a).pieces)
    records = runs.agg(F.sum("records").alias("n")).first().n or 0
    salts = max(1, -(-records // (BUCKETS * RECORDS_PER_GROUP)))
    dealt = runs.withColumn("salt", F.pmod(F.xxhash64("row", "run"), F.lit(salts)))
    counted = materialize(totals(partial_counts(dealt, salts, width), width))
    given = contributions(dealt, counted, salts).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    texts = stored.where("bucket IS NULL").select("row", key, "n_a", "n_b", "n_groups", "n_links", "groups")
    nothing = F.lit(0).cast("long")
    return texts.join(given, "row", "left").select(
        key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", nothing).alias("n_best"),
        F.coalesce("count_sum", nothing).alias("count_sum"), "groups")
