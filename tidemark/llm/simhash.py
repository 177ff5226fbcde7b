"""Near copies by SimHash, found in an inverted index over the byte positions of fingerprints.

Two 64-bit fingerprints with at most `RADIUS` = 3 differing bits agree in at least 5 of their 8 bytes: the guaranteed
minimum. Lists of (position, byte) alone would each hold 1/256 of everything, so a list is kept for a group of four positions.
The 14 groups are such that any three positions lie together in just one, and any five positions contain one whole
group: no pair with the minimum is missed. Pairs from one list are tallied (bytes that agree at equal positions),
kept from the minimum on, and verified on all bits.

Equal fingerprints are one node, so exact copies cost nothing. A list with more than `LIST` nodes is not paired: its
nodes are filed again under more positions (five bytes, then blocks of six, then of three bits, by the same pigeonhole
argument: exact), which leaves lists of 512 nodes at most, so the work grows with the nodes and not with the square of a group.

`near_copies` takes the same index over fingerprints of five-word shingles first: a text within the radius of smaller ones is
linked to the least of them if their exact Jaccard similarity holds. At similarity 0.8 most pairs differ in more than 3
bits (some 10 of 64), so every text is also filed under `BANDS` keys, each the hash of `ROWS` minima over its set of
five-word shingles (independent hash functions). Two sets of Jaccard similarity s share a list with probability
1 - (1 - s^ROWS)^BANDS: at 0.8 all but 3 in a million pairs do (see `missed`). What shares a list is verified by the exact
Jaccard similarity of the shingle sets, list by list and not pair by pair (see `linked_copies`).

Defined results: a null text is an empty one; a text without words has the fingerprint zero, linked like any other; a
text with fewer words than a shingle is one shingle; null ids never name a component unless all its ids are null.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..session import materialize
from .arrow import map_arrow
from .frames import set_aside

RADIUS = 3
SAME_BYTES = 8 - RADIUS
LIST = 512
SEED = 42
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
ROUNDS, LEVELS = 2, 3
TOGETHER = 2048  # rows of a list whose sets meet in one task


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; A-Z lower-cased, words apart by ASCII white space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data, n = b" ".join(parts), len(parts)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *(ends[:n - words]).tolist()]
    return np.array([xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], np.uint64)


def spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """Each hash stretched to `words` independent ones."""
    z = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Fingerprint words (uint64): a bit is set if it is set in over half of the rows of `hashes` (n, or n x words);
    no rows give zero."""
    hashes = hashes[:, None] if hashes.ndim == 1 else hashes
    width = hashes.shape[1] * 64
    total, step = np.zeros(width, np.int64), max(1, (1 << 22) // width)
    for i in range(0, len(hashes), step):
        raw = hashes[i:i + step].astype(">u8").view(np.uint8).reshape(-1, width // 8)
        total += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes)).view(">u8").astype(np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    return int(majority(shingle_hashes(text, words))[0])


@lru_cache(1)
def position_groups() -> tuple[tuple[int, ...], ...]:
    """14 groups of four of the eight byte positions; any three positions lie in one, any five contain one."""
    halves = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    mixed = [tuple(sorted(p + tuple(4 + x for x in q))) for h in halves for p in h for q in h]
    return ((0, 1, 2, 3), (4, 5, 6, 7), *mixed)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bytes_mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


def finer_masks(mask: int) -> list[int]:
    """Bit masks under which to file the nodes of a long list: every pair within the radius agrees under one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) == 32:  # four bytes known, one more must agree
        blocks, need = [free[i:i + 8] for i in range(0, 32, 8)], 1
    elif len(free) == 24:
        blocks, need = [free[i:i + 6] for i in range(0, 24, 6)], 1
    elif len(free) == 18:
        blocks, need = [free[i:i + 3] for i in range(0, 18, 3)], 3
    else:
        return []
    return [mask | sum(1 << b for block in chosen for b in block) for chosen in combinations(blocks, need)]


def same_bytes(a: Column, b: Column) -> Column:
    """The tally: at how many byte positions two fingerprints agree."""
    x = a.bitwiseXOR(b)
    return sum(F.when(F.call_function("shiftrightunsigned", x, F.lit(8 * p)).bitwiseAND(F.lit(255).cast("bigint")) == 0, 1).otherwise(0)
               for p in range(8))


def _filed(nodes: DataFrame) -> DataFrame:
    """Each node under every group of positions: id, t (table), f (fingerprint, bigint), mask."""
    masks = [F.lit(_signed(_bytes_mask(g))) for g in position_groups()]
    return nodes.select("id", "t", "f", F.explode(F.array(*masks)).alias("mask"))


def _lists(filed: DataFrame) -> DataFrame:
    """With the list a row is in and its number of rows, for lists of two and more. A list's name is a hash; a collision
    only adds candidates that the tally throws out."""
    keyed = filed.select("id", "t", "f", "mask", F.xxhash64("t", "mask", F.col("f").bitwiseAND(F.col("mask"))).alias("list"))
    sizes = keyed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(sizes, "list")


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs of ids that agree in the guaranteed minimum of bytes and differ in at most RADIUS bits.
    `nodes`: id, t (table), f (fingerprint, bigint); one row per (t, id)."""
    masks = [_bytes_mask(g) for g in position_groups()]
    found: DataFrame | None = None
    filed = _filed(nodes)
    while True:
        lists = materialize(_lists(filed))
        children = {m: finer_masks(m) for m in masks}
        last = not any(children.values())
        short = lists if last else lists.where(F.col("n") <= LIST)
        left, right = short.alias("l"), short.alias("r")
        pairs = left.join(right, (F.col("l.list") == F.col("r.list")) & (F.col("l.t") == F.col("r.t"))
                          & (F.col("l.id") < F.col("r.id")))
        pairs = pairs.where(same_bytes(F.col("l.f"), F.col("r.f")) >= SAME_BYTES)
        pairs = pairs.where(F.bit_count(F.col("l.f").bitwiseXOR(F.col("r.f"))) <= RADIUS)
        pairs = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        found = pairs if found is None else found.union(pairs)
        if last or lists.where(F.col("n") > LIST).isEmpty():
            return found.distinct()
        finer = F.create_map(*[x for m in masks for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in children[m]]))])
        filed = (lists.where(F.col("n") > LIST).select("id", "t", "f", F.explode(finer[F.col("mask")]).alias("mask")).distinct())
        masks = sorted({c for m in masks for c in children[m]})


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, f): fingerprint of each text as a bigint."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("f", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(v.as_py() or "", words) for v in batch.column(text)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.array(prints, np.uint64).view(np.int64))],
                                             names=schema.names)

    return map_arrow(docs.select(key, text), run, schema)


def fingerprint_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, f, component_id): component_id is the least key that links of at most RADIUS bits reach."""
    prints = materialize(fingerprints(docs, key, text, words))
    nodes = prints.groupBy("f").agg(F.min(key).alias("least"))
    links = candidate_pairs(nodes.select(F.col("f").alias("id"), F.lit(0).alias("t"), "f"))
    named = nodes.join(components(links), F.col("f") == F.col("node"), "left").select(
        "f", "least", F.coalesce("component", "f").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "component").select("f", "component_id"), "f").select(key, "f", "component_id")


def band_keys(shingles: np.ndarray) -> list[int]:
    """The lists a set of shingles is in: per band, the hash of its minima. No shingles are a set of their own."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, spread(shingles[i:i + 4096], BANDS * ROWS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.astype("<u8").tobytes(), k) for k, band in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def missed(similarity: float = SIMILARITY, shared: int = 1) -> float:
    """The probability that two sets of this similarity share fewer than `shared` lists."""
    one = similarity ** ROWS
    return sum(comb(BANDS, k) * one ** k * (1 - one) ** (BANDS - k) for k in range(shared))


def _text_arrays(docs: DataFrame, text: str, extra: list[str], name: str, made: Callable[[np.ndarray], list[int]],
                 prints: bool = False) -> DataFrame:
    """Extra columns, id (hash of the text) and the array that `made` gives for the set of shingles; with `prints` also f, the
    fingerprint of the shingles, repeats included."""
    schema = T.StructType([*[docs.schema[c] for c in extra], T.StructField("id", T.LongType()),
                           T.StructField(name, T.ArrayType(T.LongType())), *[T.StructField("f", T.LongType())] * prints])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hashes = [shingle_hashes(v.as_py() or "", SHINGLE) for v in part.column(text)]
                columns = [*[part.column(c) for c in extra], part.column("id"),
                           pa.array([made(np.unique(h)) for h in hashes], pa.list_(pa.int64()))]
                if prints:
                    columns.append(pa.array(np.array([int(majority(h)[0]) for h in hashes], np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    body = F.coalesce(F.col(text), F.lit(""))
    return map_arrow(docs.select(*extra, F.xxhash64(body).alias("id"), body.alias(text)), run, schema)


def _shared(filed: DataFrame) -> DataFrame:
    """The rows (list, id, g, others) of lists that hold more than one label g, with the number n of rows in the list; of lists
    with the same rows one stays."""
    once = (filed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("_low"), F.max("g").alias("_high"),
                                      F.bit_xor(F.xxhash64("id", F.lit(1))).alias("_x"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("_y"))
            .where("_low < _high").groupBy("n", "_x", "_y").agg(F.min("list").alias("list")).select("list", "n"))
    return filed.join(once, "list")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) with their exact Jaccard distance and whether they reach the similarity; two empty sets are equal."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("_t")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("shingles").alias("_s")), "a")
    same = F.size(F.array_intersect("_s", "_t"))
    counted = both.select("a", "b", same.alias("_same"), (F.size("_s") + F.size("_t") - same).alias("_all"))
    return counted.select("a", "b", (F.col("_same") >= F.lit(similarity) * F.col("_all") - 1e-9).alias("alike"),
                          F.when(F.col("_all") == 0, 0.0).otherwise(1 - F.col("_same") / F.col("_all")).alias("distance"))


def _release(df: DataFrame) -> None:
    """Lets Spark remove the shuffle files of steps that are done: its cleaner acts when the driver collects garbage, which
    a driver with little of its own to hold does late; and what Python still holds, the driver cannot drop."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share (a square table)."""
    size, owner = len(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common, both = np.zeros((size, size)), np.flatnonzero((times[code] == 2)[:-1] & (code[:-1] == code[1:]))
    np.add.at(common, (np.r_[owner[both], owner[both + 1]], np.r_[owner[both + 1], owner[both]]), 1)
    common[np.arange(size), np.arange(size)] = [len(s) for s in sets]
    many = times[code] > 2
    owner, code = owner[many], np.unique(code[many], return_inverse=True)[1]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        i, j = np.searchsorted(code, [low, low + 2048])
        part = np.zeros((size, 2048), np.float32)
        part[owner[i:j], code[i:j] - low] = 1
        shared = part @ part.T
        np.fill_diagonal(shared, 0)
        common += shared
    return common


def spanning_links(ids: list[int], labels: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between alike sets (exact Jaccard similarity) that, with the labels, connect all that are; one less than the sets at most."""
    common, sizes = common_counts(sets), np.array([len(s) for s in sets])
    alike = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    links, unseen = [], np.ones(len(ids), bool)
    for start in range(len(ids)):
        todo = [start] if unseen[start] else []
        unseen[start] = False
        while todo:
            k = todo.pop()
            found = np.flatnonzero(alike[k] & unseen).tolist()
            unseen[found] = False
            todo += found
            links += [(ids[k], ids[m]) for m in found if labels[k] != labels[m]]
    return links


def short_list_links(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links in the lists (list, id, g). A list's sets meet in one task, so that each moves once a list and not once a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: tuple[list[int], list[int], list[np.ndarray]]) -> pa.RecordBatch:
            found = spanning_links(*held, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

        now, held = None, ([], [], [])
        for batch in batches:
            shingles = batch.column("shingles")
            for k, (name, node, g) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("list", "id", "g")))):
                if name != now and held[0]:
                    yield links(held)
                    held = ([], [], [])
                now = name
                for part, value in zip(held, (node, g, shingles[k].values.to_numpy().copy())):
                    part.append(value)
        if held[0]:
            yield links(held)

    met = rows.select("list", "id", "g").join(sets, "id").select("list", "id", "g", "shingles")
    return map_arrow(met.repartition("list").sortWithinPartitions("list"), run, "a long, b long")


def linked_copies(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between texts (nodes: id, bands, where known a label g that only connected texts share; sets: id, shingles)
    that connect whatever is alike in the same list.

    Near copies share many lists, often with the same rows: such lists count once, and lists of one label not at all. The rows of
    a list of up to `TOGETHER` rows are compared in one task, which gives less links than rows. A longer list is first held against
    one of its rows, the head, and those alike are linked to it: a round makes at most one pair per row. No other pair is
    lost by that: a linked row stays in the list as long as it can be alike to an open one. Jaccard distance is a metric, so that is
    only if the distances of the two from the head differ by no more than the limit. Lists that are longer than `TOGETHER` after
    `ROUNDS` rounds are filed again under each further band (see `missed` for two and three lists), and after the third dealt into
    parts, of which each two meet in one task.
    """
    limit, links, short = 1 - similarity + 1e-9, [], []
    nodes = nodes if "g" in nodes.columns else nodes.withColumn("g", F.col("id"))
    rows = materialize(_shared(nodes.select("id", "g", F.lit(0).alias("linked"), F.explode("bands").alias("list"))))
    for level in range(1, LEVELS + 1):
        for turn in range(ROUNDS + 1):
            short.append(rows.where(F.col("n") <= TOGETHER).select("list", "id", "g"))
            rows = rows.where(F.col("n") > TOGETHER)
            if turn == ROUNDS or rows.isEmpty():
                break
            heads = rows.groupBy("list").agg(F.min(F.struct("linked", F.xxhash64("id").alias("o"), "id")).alias("h"))
            met = materialize(rows.join(heads.select("list", F.col("h.id").alias("a")), "list").where("id <> a").withColumnRenamed("id", "b"))
            checked = materialize(verified(met.select("a", "b").distinct(), sets, similarity))
            links.append(checked.where("alike").select("a", "b"))
            met = materialize(met.join(checked, ["a", "b"]))
            nearest = met.where("NOT alike").groupBy("list").agg(F.min("distance").alias("nearest"))
            kept = met.join(nearest, "list").where(~F.col("alike") | (F.col("distance") + limit >= F.col("nearest")))
            left = kept.select("list", F.col("b").alias("id"), F.when(F.col("alike"), F.col("a")).otherwise(F.col("g")).alias("g"),
                               F.when(F.col("alike"), 1).otherwise(F.col("linked")).alias("linked"), *["used"] * (level > 1))
            rows = materialize(_shared(left))
            _release(rows)
        if rows.isEmpty():
            break
        if level == LEVELS:
            parts = F.ceil(F.col("n") / F.lit(max(1, TOGETHER // 2))).cast("int")
            dealt = rows.select("list", "id", "g", F.pmod(F.xxhash64("id", F.lit(3)), parts).cast("int").alias("_p"),
                                F.explode(F.sequence(F.lit(0), parts - 1)).alias("_q"))
            short.append(dealt.select(F.xxhash64("list", F.least("_p", "_q"), F.greatest("_p", "_q")).alias("list"), "id", "g"))
            break
        long = rows.join(nodes.select("id", "bands"), "id").withColumn("used", F.array("list") if level == 1 else F.col("used"))
        finer = long.select("id", "g", "linked", "used", F.explode(F.array_except("bands", "used")).alias("_more"))
        finer = finer.withColumn("used", F.array_sort(F.concat("used", F.array("_more"))))
        finer = finer.groupBy(F.xxhash64("used").alias("list"), "id").agg(
            F.min("g").alias("g"), F.min("linked").alias("linked"), F.first("used").alias("used"))
        rows = materialize(_shared(materialize(finer)))
    links.append(short_list_links(reduce(DataFrame.union, short), sets, similarity))
    return materialize(reduce(DataFrame.union, links).distinct())


def index_stars(nodes: DataFrame) -> DataFrame:
    """(a, b): each text (nodes: id, f) that has smaller ones within `RADIUS` bits, with the least of them, by the inverted index
    over byte positions (`candidate_pairs`: lists, tally, minimum of equal bytes, all bits). Texts of one fingerprint are one node."""
    prints = materialize(nodes.groupBy("f").agg(F.min("id").alias("least")))
    pairs = candidate_pairs(prints.select(F.col("least").alias("id"), F.lit(0).alias("t"), "f"))
    near = pairs.groupBy(F.col("b").alias("least")).agg(F.min("a").alias("a"))
    named = prints.join(near, "least", "left").select("f", F.coalesce("a", "least").alias("a"))
    return materialize(nodes.join(named, "f").where("id <> a").select("a", F.col("id").alias("b")))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` less all but one of each group of near copies: the one with the least key stays (null last,
    then by the text's hash); fully equal rows count once. Links come from the byte index of fingerprints (radius 3) and, for
    pairs further apart, from the lists of minima; both are held against the exact similarity. Texts move once, to meet the list of those that stay."""
    docs, restored = set_aside(docs, key, text)
    prints = materialize(_text_arrays(docs, text, [key], "bands", band_keys, prints=True))
    nodes = materialize(prints.groupBy("id").agg(F.first("bands").alias("bands"), F.first("f").alias("f")))
    stars = index_stars(nodes.select("id", "f"))
    _release(docs)
    filed = nodes.select("id", F.explode("bands").alias("list"))
    wanted = filed.join(filed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "list").select("id").union(
        stars.select("a")).union(stars.select("b")).distinct().withColumnRenamed("id", "_id")
    copies = docs.withColumn("_id", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(wanted, "_id", "left_semi")
    sets = materialize(_text_arrays(copies.dropDuplicates(["_id"]), text, [], "shingles", lambda x: x.view(np.int64).tolist()))
    _release(docs)
    close = materialize(verified(stars, sets, similarity).where("alike").select("a", "b"))
    _release(docs)
    labelled = nodes.join(close.withColumnRenamed("b", "id"), "id", "left").select("id", "bands", F.coalesce("a", "id").alias("g"))
    links = close.union(linked_copies(labelled, sets, similarity))
    _release(docs)
    groups = components(links)
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("id").alias("id"))
    least = (prints.select(key, "id").join(groups, F.col("id") == F.col("node"), "left")
             .groupBy(F.coalesce("component", "id").alias("component")).agg(F.min(rank).alias("r"))
             .select(F.col("r.key").alias("_key"), F.col("r.id").alias("_id")))
    marked = docs.withColumn("_text_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = marked.join(least, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_text_id") == F.col("_id")), "left_semi")
    return restored(kept.dropDuplicates([key, "_text_id"]))
