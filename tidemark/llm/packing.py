"""Best-fit packing of token sequences after a dominance reduction.

Texts become token ids; what is longer than the capacity is cut into full pieces, the remainder first. Packing looks
at lengths only, and there are at most `capacity` different ones, so the instance is a histogram of bounded size,
however many texts there are. On it the driver

1. reduces: a small set of pieces that dominates every other way to fill the sequence of its longest piece is fixed for
   good (exact complement; nothing fits beside; only one piece fits beside: the longest; at most two fit beside: the
   longest single or the pair that every feasible choice can be exchanged for);
2. packs the rest best-fit, longest first, many equal sequences at a time.

The result is a list of patterns (lengths in one sequence, number of such sequences). Pieces are then numbered within
their length, in parallel: hashed into salts, counted, and numbered inside (length, salt), so that a length that a
third of all pieces share is no single task; the number picks pattern, copy and place.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are packed each; the
output has its own columns only.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .arrow import map_arrow

CAPACITY = 2048
END_ID = 0
SALTS = 256
ROWS_PER_SALT = 100_000
# Fixed value: how the vocabulary file splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file. Its merges are in the order of its ids, so that ranks say it all and
    the faster library gives the same ids; added tokens are found anywhere in a text, as by the tokenizers library. A file
    for which that does not hold is refused."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    if any(t.get(k) for t in file.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path}: added tokens that take in or need what is beside them")
    if any(a != b and b.startswith(a) for a in added for b in added):
        raise ValueError(f"{path}: an added token begins another")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in merges]
    if ids != sorted(ids) or max(model["vocab"][c] for c in letters) > min(ids, default=1 << 30):
        raise ValueError(f"{path}: ids do not follow the order of the merges")
    known = {"".join(m) for m in merges} | letters.keys()
    ranks = {bytes(letters[c] for c in token): model["vocab"][token] for token in known}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(own: tiktoken.Encoding, text: str) -> np.ndarray:
    ids = own.encode_to_numpy(text, allowed_special="all")
    return np.append(ids, END_ID).astype("<u4")


def to_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
              with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every text."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(
        T.StructField(n, T.LongType() if n != "piece" else T.IntegerType()) for n in ("piece", "start", "length", "ids_crc32")),
        *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows: list[tuple] = []
                for k, body in enumerate(part.column(text)):
                    ids = token_ids(own, body.as_py() or "")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    rows += [(k, i, a, b - a, ids[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                where, piece, start, length, raw = zip(*rows)
                columns = [part.column(key).take(pa.array(where)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if with_ids else []),
                                                 names=schema.names)

    return map_arrow(df.select(key, text), run, schema)


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, times), ...) and number of sequences


def reduce_instance(counts: list[int], capacity: int = CAPACITY) -> list[Pattern]:
    """Fixes dominating sets, lowering `counts` (by length) in place; passes over the lengths until nothing changes."""
    fixed: list[Pattern] = []

    def fix(*lengths: int) -> None:
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
        fixed.append((tuple(need.items()), times))

    changed = True
    while changed:
        changed = False
        present = [x for x in range(capacity, 0, -1) if counts[x]]
        for longest in present:
            while counts[longest]:
                sets = _dominating(counts, longest, capacity)
                if sets is None:
                    break
                fix(longest, *sets)
                changed = True
    return fixed


def _dominating(counts: list[int], longest: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside a piece so that no other choice can be better; None if none of the rules tells."""
    room = capacity - longest

    def left(x: int, *used: int) -> int:
        return counts[x] - (x == longest) - used.count(x)

    if room == 0:
        return ()
    if left(room) > 0:
        return (room,)
    small: list[int] = []
    for x in range(1, room + 1):
        small += [x] * min(left(x), 3 - len(small))
        if len(small) == 3:
            break
    if not small:
        return ()
    best = next(x for x in range(room, 0, -1) if left(x) > 0)
    if len(small) < 2 or small[0] + small[1] > room:
        return (best,)
    if len(small) == 3 and sum(small) <= room:
        return None
    # At most two pieces fit beside the longest. The greatest sum of a feasible pair, and the greatest smaller part of one.
    pair, minor = 0, 0
    for y in range(1, room // 2 + 1):
        if left(y) > 0:
            x = next((x for x in range(room - y, y - 1, -1) if left(x, y) > 0), 0)
            if x:
                pair, minor = max(pair, x + y), y
    if pair <= best:
        return (best,)
    second = next((y for y in range(min(room - best, best), 0, -1) if left(y, best) > 0), 0)
    if second and minor <= second:
        return (best, second)
    return None


def best_fit(counts: list[int], capacity: int = CAPACITY) -> list[Pattern]:
    """Longest first into the fullest sequence with room; equal sequences are filled together."""
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [[content, number]]
    for x in range(capacity, 0, -1):
        todo = counts[x]
        while todo:
            room = next((r for r in range(x, capacity) if open_.get(r)), capacity)
            content, number = open_[room].pop() if room < capacity else ((), todo)
            take = min(room // x, todo)  # a sequence takes the length again while it is the fullest with room
            used = min(number, todo // take)
            if used < number and room < capacity:
                open_[room].append([content, number - used])
            open_[room - take * x].append([(*content, (x, take)), used])
            todo -= used * take
    return [(content, number) for group in open_.values() for content, number in group]


def plan(counts: list[int], capacity: int = CAPACITY) -> list[Pattern]:
    counts = list(counts)
    fixed = reduce_instance(counts, capacity)
    return [p for p in fixed + best_fit(counts, capacity) if p[1]]


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length: rows (first number, times per sequence, first sequence, place of the first copy), by first number."""
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for content, number in patterns:
        place = 0
        for x, times in content:
            rows[x].append((used[x], times, sequence, place))
            used[x] += times * number
            place += x * times
        sequence += number
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def numbered(pieces: DataFrame, total: int, order: list[str]) -> DataFrame:
    """Adds `number`: gapless from 0 within each length. `pieces` must be stored, as it is read twice."""
    salts = max(SALTS, -(-total // ROWS_PER_SALT))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    below = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
             .select("length", "_salt", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_base")))
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    return (salted.withColumn("_in", inside).join(bases, ["length", "_salt"])
            .withColumn("number", F.col("_base") + F.col("_in") - 1).drop("_salt", "_in", "_base"))


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces. The histogram (at most `capacity` rows) comes to the driver, and the
    patterns (a few per length) go to the workers."""
    pieces = materialize(pieces)
    counts = [0] * (capacity + 1)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    where = places(plan(counts, capacity))
    kept = pieces.columns
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                rows = where[int(x)]
                hit = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
                copy, slot = np.divmod(number[at] - hit[:, 0], hit[:, 1])
                sequence[at], offset[at] = hit[:, 2] + copy, hit[:, 3] + slot * x
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=out.names)

    ranked = numbered(pieces, sum(counts), [key, "piece", "ids_crc32"])
    return map_arrow(ranked.select(*kept, "number"), run, out)


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   with_ids: bool = False) -> DataFrame:
    return pack(to_pieces(docs, path, key, text, capacity, with_ids), key, capacity)
