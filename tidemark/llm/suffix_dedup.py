"""Removal of repeated byte strings by bucket-pointer refinement over a sparse suffix order.

Wanted: every byte covered by a string of `length` bytes that also starts somewhere else. A suffix order over all bytes would
sort hundreds of suffixes for each repeated passage; here only content-chosen positions are sorted. Every string of `length`
bytes chooses one of its grams (the least, leftmost), so equal strings choose equal grams at equal distance, and an
anchor answers for a run of neighbouring strings.

1. Initial buckets are the grams at the anchors. A bucket with one member holds nothing repeated and is dropped.
2. Buckets are refined by the identifier of all bytes that the anchor's strings cover: members of one class are
   repeated whole. A bucket with several classes goes on with one representative of each class, the update
   being reused for its members.
3. The representatives' strings are split into blocks of `BLOCK` neighbours. A block's bucket is the identifier of the bytes common to
   its strings (without them no string can be shared), refined by the bytes on both sides.
4. Blocks whose bucket still has several classes are split into single strings.

Each round is one pass of counting by bucket and a join back that may be split; a bucket that everything falls into is
reduced by partial counts. Identifiers have 64 bits and are compared only within a bucket, that is, under an equal
identifier of other bytes as well.

Texts are known by hash and length, so copies share their spans, ids do not matter, and null or repeated ids are no
problem. Texts travel compressed, once per different text. Defined results: a null text is an empty one; texts
shorter than `length` keep all bytes; rows are never dropped.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .arrow import map_arrow
from .frames import set_aside
from .substrings import BATCH, GRAM, Rolling, anchors, merged

LENGTH = 400
BLOCK = 16


def store(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: compressed, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _identified(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"tid": F.xxhash64(body), "nb": F.octet_length(body)})


def _batches(values: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, part, size = 0, [], 0
    for i, v in enumerate(values):
        part.append(v)
        size += len(v)
        if size >= BATCH:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


ANCHORS = "tid long, nb int, start int, end int, a int, bucket long, cls long, weight int"


def anchor_rows(docs: DataFrame, text: str, length: int) -> DataFrame:
    """Anchors (bucket: gram, cls: identifier of all covered bytes, weight 2 if the class is repeated in its own text,
    else 1); and rows without bucket: spans that are repeated inside their own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, nb = (batch.column(c).to_numpy() for c in ("tid", "nb"))
            for first, part in _batches([v.as_py().encode() for v in batch.column(text)]):
                ends = np.cumsum([len(p) for p in part])
                starts = ends - np.array([len(p) for p in part])
                owner, a, low, high, gram, span = anchors(np.frombuffer(b"".join(part), np.uint8), starts, ends, length)
                if not len(a):
                    continue
                order = np.lexsort((span, gram, owner))
                o, g, s = owner[order], gram[order], span[order]
                new = np.concatenate([[True], (o[1:] != o[:-1]) | (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
                group = np.cumsum(new) - 1
                size = np.bincount(group)
                rep = order[new]
                again = np.sort(order[(size > 1)[group]])
                w, x, y = merged(owner[again], (a - high)[again], (a - low)[again] + length)
                who = np.concatenate([owner[rep], w]) + first
                columns = [tid[who], nb[who], np.concatenate([(a - high)[rep], x]), np.concatenate([(a - low)[rep] + length, y]),
                           np.concatenate([a[rep], np.full(len(w), -1)])]
                none = np.concatenate([np.zeros(len(rep), bool), np.ones(len(w), bool)])
                columns = [pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, *[np.int32] * 4))]
                columns += [pa.array(np.concatenate([c[rep], np.zeros(len(w), np.uint64)]).view(np.int64), mask=none) for c in (gram, span)]
                columns.append(pa.array(np.concatenate([np.minimum(size, 2), np.ones(len(w), np.int64)]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=["tid", "nb", "start", "end", "a", "bucket", "cls", "weight"])

    return map_arrow(docs.select("tid", "nb", text), run, ANCHORS)


def refine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of repeated classes, one row of each class in buckets with several). rows: bucket, cls, weight, others."""
    rest = [c for c in rows.columns if c not in ("bucket", "cls", "weight")]
    sizes = (rows.groupBy("bucket").agg(F.sum("weight").alias("_n"), F.min("cls").alias("_x"), F.max("cls").alias("_y"))
             .where("_n > 1").select("bucket", (F.col("_x") != F.col("_y")).alias("many")))
    live = store(rows.join(sizes, "bucket"))
    classes = store(live.where("many").groupBy("bucket", "cls").agg(
        F.sum("weight").alias("_n"), F.min(F.struct(*rest)).alias("_rep")))
    solved = live.where("NOT many").select(*rest).union(
        live.where("many").join(classes.where("_n > 1").select("bucket", "cls"), ["bucket", "cls"]).select(*rest))
    return solved, classes.select("bucket", "_rep.*")


def packed_texts(docs: DataFrame, text: str) -> DataFrame:
    """The rows with `packed`, the compressed text, in the place of the text. Null stays null."""
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [tool.compress(v.as_py().encode()) if v.is_valid else None for v in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(packed, pa.binary())], names=[*others, "packed"])

    return map_arrow(docs, run, schema)


def texts_by_id(docs: DataFrame, text: str, length: int) -> DataFrame:
    """(tid, nb, packed): each different text that can hold a repeated string, once, compressed."""
    long = docs.where(F.col("nb") >= length).select("tid", "nb", text)
    return packed_texts(long, text).groupBy("tid", "nb").agg(F.first("packed").alias("packed"))


BLOCKS = "bucket long, cls long, weight int, tid long, nb int, a int, low int, high int, top int, left binary, right binary"


def block_rows(texts: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """Blocks of neighbouring strings of the members (tid, nb, a, start, end): bucket by the bytes that all its strings
    share, class by those beside them. low..high: distances of the strings that exist; top: greatest of the block."""
    wanted = members.groupBy("tid", "nb").agg(F.collect_list(F.struct("a", "start", "end", "bucket")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            for tid, nb, packed, found in zip(*(batch.column(c) for c in ("tid", "nb", "packed", "members"))):
                raw = tool.decompress(packed.as_py())
                data, n = np.frombuffer(raw, np.uint8), len(raw)
                rolling = Rolling(data)
                a, start, end, gram = (found.values.field(k).to_numpy() for k in range(4))
                low, high = a + length - end, a - start
                blocks = high // BLOCK - low // BLOCK + 1
                at = np.repeat(np.arange(len(a)), blocks)
                number = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + np.repeat(low // BLOCK, blocks)
                a, low, high, gram = a[at], low[at], high[at], gram[at]
                bottom, top = number * BLOCK, np.minimum(number * BLOCK + BLOCK - 1, length - GRAM)
                one, two = a - bottom, a - top + length  # the bytes shared by all strings of the block
                core = rolling.name(one, np.minimum(two, n))
                left = [raw[max(0, i):j] for i, j in zip((a - top).tolist(), one.tolist())]
                right = [raw[i:j] for i, j in zip(two.tolist(), (a - bottom + length).tolist())]
                low, high = np.maximum(low, bottom), np.minimum(high, top)
                size = len(a)
                yield pa.RecordBatch.from_arrays([
                    pa.array((core ^ (gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (number.astype(np.uint64) << np.uint64(48))).view(np.int64)),
                    pa.array(np.zeros(size, np.int64)), pa.array(np.ones(size, np.int32)), pa.array(np.full(size, tid.as_py())),
                    pa.array(np.full(size, nb.as_py(), np.int32)), *(pa.array(c.astype(np.int32)) for c in (a, low, high, top)),
                    pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    names=["bucket", "cls", "weight", "tid", "nb", "a", "low", "high", "top", "left", "right"])

    rows = map_arrow(texts.join(wanted, ["tid", "nb"]), run, BLOCKS)
    return rows.withColumn("cls", F.xxhash64("left", "right", "low", "high"))


def repeated_spans(docs: DataFrame, text: str, length: int = LENGTH) -> DataFrame:
    """(tid, nb, start, end): spans whose union is what is repeated. docs: identified."""
    long = docs.where(F.col("nb") >= length)
    rows = store(anchor_rows(long, text, length))
    spans = rows.where("bucket IS NULL").select("tid", "nb", "start", "end")
    solved, open_ = refine(rows.where("bucket IS NOT NULL"))
    spans = spans.union(solved.select("tid", "nb", "start", "end"))
    blocks = store(block_rows(texts_by_id(docs, text, length), open_, length))
    solved, open_ = refine(blocks)
    spans = spans.union(solved.select("tid", "nb", F.col("a") - F.col("high"), F.col("a") - F.col("low") + length))
    # Single strings: those of a block differ in how much of either side they take.
    single = open_.select("bucket", "tid", "nb", "a", "top", "left", "right", F.explode(F.sequence("low", "high")).alias("at"))
    beside = F.col("at") % BLOCK, F.col("top") - F.col("at")  # bytes taken on the left and on the right
    single = single.select("tid", "nb", (F.col("a") - F.col("at")).alias("start"), F.xxhash64(
        "bucket", "at", F.right(F.hex("left"), 2 * beside[0]), F.left(F.hex("right"), 2 * beside[1])).alias("bucket"))
    single = store(single)
    twice = single.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    last = single.join(twice, "bucket").select("tid", "nb", "start", (F.col("start") + length).alias("end"))
    return spans.union(last)


def _unions(found: pa.Scalar) -> list[tuple[int, int]]:
    start, end = (found.values.field(k).to_numpy() for k in range(2))
    order = np.argsort(start, kind="stable")
    _, x, y = merged(np.zeros(len(start), np.int64), start[order].astype(np.int64), end[order].astype(np.int64))
    return list(zip(x.tolist(), y.tolist()))


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[i:j] for i, j in zip(cuts[::2], cuts[1::2]))


def _collected(spans: DataFrame) -> DataFrame:
    """All different spans of a text in one row; there are fewer of them than bytes in the text."""
    return spans.groupBy("tid", "nb").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, text) per row. The text is what is kept, less the characters that a cut
    splits (kept_sha256 is of all kept bytes); null stays null."""
    docs = _identified(docs.select(key, text), text)
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                           *(T.StructField(c, T.StringType()) for c in ("kept_sha256", text))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            first, out, size = 0, [], 0
            for packed, found in zip(batch.column("packed"), batch.column("spans")):
                raw = tool.decompress(packed.as_py()) if packed.is_valid else b""
                spans = _unions(found) if found.is_valid else []
                kept = _without(raw, spans)
                out.append((len(raw), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "ignore") if packed.is_valid else None))
                size += len(kept)
                if size >= BATCH or first + len(out) == len(batch):  # texts that pack well are long ones again here
                    columns = [pa.array(c, k) for c, k in zip(zip(*out), (*[pa.int64()] * 3, pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, len(out)), *columns], names=schema.names)
                    first, out, size = first + len(out), [], 0

    spans = _collected(repeated_spans(docs, text, length))
    rows = packed_texts(docs, text).join(spans, ["tid", "nb"], "left")
    return map_arrow(rows.select(key, "packed", "spans"), run, schema)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows with repeated strings cut out of their texts; a character that a cut splits goes. Null stays null."""
    docs, restored = set_aside(docs, text)
    columns = docs.columns
    marked = _identified(docs, text)
    spans = _collected(repeated_spans(marked.select("tid", "nb", text), text, length))
    schema = T.StructType(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = columns.index(text)
        for batch in batches:
            out = list(batch.columns[:len(columns)])
            clean = []
            for value, found in zip(out[k], batch.column(len(columns))):
                body = value.as_py()
                if body is not None and found.is_valid:
                    body = _without(body.encode(), _unions(found)).decode("utf-8", "ignore")
                clean.append(body)
            out[k] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return restored(map_arrow(marked.join(spans, ["tid", "nb"], "left").select(*columns, "spans"), run, schema))
