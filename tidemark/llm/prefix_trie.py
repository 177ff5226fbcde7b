"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

A turn becomes a mark of 20 bytes (128 bits of SHA-256 of role and text, and the number of code points), a conversation
the string of its marks. Byte order of these strings is pre-order of the trie, so

1. equal strings are counted first (many equal conversations are one row), with the hash of their ids;
2. the rest is sorted by range. A task reads its range in order and cuts it into shards of at most SHARD_NODES
   nodes (or one conversation). Each shard is a trie of its own, held as a bit string of parentheses with the excess in
   blocks and a range-min-max tree over them: `find_close` delimits subtrees, ranks of leaf pairs and cumulative arrays
   give their leaves, conversations and savings;
3. nodes on the path of a shard's first or last conversation (its spines) may go on in the next shard. Every shard knows
   how many nodes it shares with its neighbours and leaves out what the one before it has counted; so parts of a
   spine node simply add up. All other nodes are complete where they are.

The neighbours' first and last conversations are one row per task. A conversation is one row of 20 bytes a turn and is
read by one task; so is, for one set of equal conversations, the string of ids that its hash is taken of (the hash is
sequential by its nature; ids come to it in joined chunks and stream through it).

Defined results: null conversation ids name no conversation, their rows are set aside; null role or text is empty; null
turns come first; equal turn numbers are ordered by the mark; repeated rows are turns of their own; a conversation
without turns ends at the root; without conversations there is no node. The output has its own columns only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .arrow import map_arrow

MARK = 20              # bytes of a turn: 16 of the hash, 4 of the number of code points
SHARD_NODES = 250_000
BLOCK = 64             # parentheses
IDS_A_CHUNK = 4096
ROWS_PER_TASK = 200_000
NO_IDS = hashlib.sha256().hexdigest()


# -- conversations as strings of marks ---------------------------------------------------

def packed(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv, own): every conversation's marks in the order of its turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    mark = F.concat(F.substring(F.sha2(named, 256), 1, 32), F.lpad(F.hex(F.char_length(text)), 8, "0"))
    slim = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col("turn"), mark.alias("mark"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("turn", "mark"))), lambda t: t["mark"])
    return slim.groupBy("conv").agg(F.unhex(F.array_join(in_order, "")).alias("own"))


def with_borrowed_heads(turns: DataFrame, key: str = "conv_id", block: int = 100, most: int = 6) -> DataFrame:
    """(conv, seq): the first h turns of the conversation at the head of the block of ids, then the own turns after the
    first h; h is crc32 of the id modulo `most`. Conversations of a block meet in one window of fewer than 2 * block rows
    (block on either side of zero)."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = F.col("conv") - F.col("conv") % block
    own = packed(turns, key).withColumns({"base": base, "h": h.cast("int")})
    head = F.max(F.when(F.col("conv") == F.col("base"), F.substring("own", 1, (most - 1) * MARK))).over(Window.partitionBy("base"))
    borrowed = F.coalesce(head, F.lit(b""))
    return own.select("conv", F.concat(borrowed.substr(F.lit(1), F.col("h") * MARK),
                                       F.col("own").substr(F.col("h") * MARK + 1, F.octet_length("own"))).alias("seq"))


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """(seq, n, first_conv, ends): equal sequences once, with the hash of their ids in ascending order. Ids are joined in
    chunks of their range, so a sequence that a third of all conversations have is many rows until its hash is taken."""
    chunk = F.floor(F.col("conv") / IDS_A_CHUNK).cast("long").alias("chunk")
    chunks = conversations.groupBy("seq", chunk).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("first_conv"),
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    chunks = materialize(chunks)
    whole = chunks.groupBy("seq").agg(F.sum("n").alias("n"), F.min("first_conv").alias("first_conv"),
                                      F.count(F.lit(1)).alias("chunks"), F.min("ids").alias("ids"))
    alone = whole.where("chunks = 1").select("seq", "n", "first_conv", F.sha2("ids", 256).alias("ends"))
    many = whole.where("chunks > 1").select("seq", F.col("n").alias("all"), F.col("first_conv").alias("least"))
    parts = chunks.join(many, "seq").select("seq", "chunk", "all", "least", "ids")
    streamed = parts.repartition(F.col("seq")).sortWithinPartitions("seq", "chunk")
    return alone.unionByName(map_arrow(streamed, _hash_ids, "seq binary, n bigint, first_conv bigint, ends string"))


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, rows = None, None, []

    def done() -> None:
        if now is not None:
            rows.append((*now, state.hexdigest()))

    for batch in batches:
        for seq, n, least, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "all", "least", "ids"))):
            if now is None or seq != now[0]:
                done()
                now, state = (seq, n, least), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _batch(rows, HASHED)
        rows.clear()
    done()
    yield _batch(rows, HASHED)


HASHED = pa.schema([("seq", pa.binary()), ("n", pa.int64()), ("first_conv", pa.int64()), ("ends", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# -- balanced parentheses -----------------------------------------------------------------

@dataclass
class Parentheses:
    """A trie in pre-order: `opens[k]` is the place of node k's opening bracket."""
    bits: np.ndarray      # 1 opens, 0 closes
    opens: np.ndarray
    excess: np.ndarray    # after each bracket
    levels: list          # least excess of blocks, then of pairs, up to one value

    @classmethod
    def of(cls, bits: np.ndarray) -> Parentheses:
        excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        high = int(excess.max(initial=0)) + 1
        lows = np.pad(excess, (0, -len(bits) % BLOCK), constant_values=high).reshape(-1, BLOCK).min(1)
        levels = [lows]
        while len(levels[-1]) > 1:
            below = np.pad(levels[-1], (0, len(levels[-1]) % 2), constant_values=high)
            levels.append(below.reshape(-1, 2).min(1))
        return cls(bits, np.flatnonzero(bits), excess, levels)

    def find_close(self) -> np.ndarray:
        """For every node the place of its closing bracket: the first place behind with an excess one lower."""
        at, aim = self.opens + 1, self.excess[self.opens] - 1
        out = np.full(len(at), -1)
        open_ = self._scan(out, at, aim, np.arange(len(at)))
        # Blocks: up the tree until a block on the right has the aim, then down to the first that has it.
        node, level = at[open_] // BLOCK, np.zeros(len(open_), dtype=np.int64)
        found = np.zeros(len(open_), dtype=bool)
        for height, lows in enumerate(self.levels):
            todo = np.flatnonzero(~found)
            here = node[todo]
            hit = (here < len(lows)) & (lows[np.minimum(here, len(lows) - 1)] <= aim[open_[todo]])
            found[todo[hit]], level[todo[hit]] = True, height
            miss = todo[~hit]
            node[miss] = node[miss] // 2 + node[miss] % 2  # an odd one steps right to the next pair
        for height in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(level == height)
            left = node[down] * 2
            node[down] = left + (self.levels[height - 1][left] > aim[open_[down]])
            level[down] = height - 1
        at[open_] = node * BLOCK
        self._scan(out, at, aim, open_)
        return out

    def _scan(self, out: np.ndarray, at: np.ndarray, aim: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Looks on from `at` to the end of its block; returns who found nothing, then standing at the next block."""
        waiting = []
        while len(todo):
            hit = self.excess[at[todo]] == aim[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            over = at[todo] % BLOCK == 0
            waiting.append(todo[over])
            todo = todo[~over]
        return np.concatenate(waiting) if waiting else todo


def range_min(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """min(values[start:start + size]) per query, by tables of powers of two, one at a time."""
    out, table, width = np.empty(len(start), dtype=values.dtype), values, 1
    power = np.floor(np.log2(size)).astype(np.int64)
    for p in range(int(power.max(initial=0)) + 1):
        mine = np.flatnonzero(power == p)
        out[mine] = np.minimum(table[start[mine]], table[start[mine] + size[mine] - width])
        table, width = np.minimum(table[:-width], table[width:]) if len(table) > width else table, width * 2
    return out


# -- shards ---------------------------------------------------------------------------------

NODES = pa.schema([("spine", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
                   ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                   ("n_leaves", pa.int64()), ("weighted", pa.int64()), ("once", pa.int64()), ("ends", pa.string())])
NODE_COLUMNS = ("spine boolean, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
                "n_children bigint, n_leaves bigint, weighted bigint, once bigint, ends string")


def common(a: bytes, b: bytes) -> int:
    """Number of leading marks that agree."""
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m // MARK
    x, y = (np.frombuffer(s, dtype=np.uint8, count=m) for s in (a, b))
    return int(np.argmax(x != y)) // MARK


def shard_nodes(rows: list[tuple[bytes, int, int, str]], before: int, after: int) -> pa.RecordBatch:
    """All nodes of one shard. `rows`: (seq, n, first_conv, ends) in byte order. `before` and `after`: depth down to which
    the first (last) sequence shares its nodes with the shard before (behind); -1 where there is none."""
    shared, node_of, lengths = [], [], []
    parents, last, chars, total = [], -1, [], 0
    path: list[int] = []
    previous = b""
    for k, (seq, *_) in enumerate(rows):
        depth = len(seq) // MARK
        keep = common(previous, seq) + 1 if k else 0           # nodes kept, the root counted
        fresh = depth + 1 - keep
        parents.append(path[keep - 1] if keep else -1)
        path[keep:] = range(total, total + fresh)
        counts = np.frombuffer(seq, dtype=np.uint8).reshape(-1, MARK)[:, 16:].copy().view(">u4").ravel().astype(np.int64)
        chars.append(np.append(0, counts)[keep:])
        shared.append(keep)
        lengths.append(depth + 1)
        total += fresh
        node_of.append(total - 1)
        if not k:
            left = list(path)
        previous = seq
    shared, lengths, node_of = np.array(shared), np.array(lengths), np.array(node_of)
    fresh = lengths - shared
    closing = np.append(lengths[:-1] - shared[1:], lengths[-1])
    brackets = Parentheses.of(np.repeat(np.tile([1, 0], len(rows)), np.stack([fresh, closing], 1).ravel()).astype(np.int8))
    first = np.cumsum(fresh) - fresh
    depth = np.arange(total) - np.repeat(first - shared, fresh)
    parent = np.arange(total) - 1
    parent[first] = parents
    chars = np.concatenate(chars)
    ends_n, ends_conv = np.zeros(total, dtype=np.int64), np.full(total, np.iinfo(np.int64).max)
    ends_n[node_of], ends_conv[node_of] = [r[1] for r in rows], [r[2] for r in rows]

    close = brackets.find_close()
    start, size = np.arange(total), (close - brackets.opens + 1) // 2
    until = start + size
    least = range_min(ends_conv, start, size)
    run = np.append(0, np.cumsum(ends_n))
    n = run[until] - run[start]
    # What the shard before has counted counts there: nodes shared with it, and their chars.
    new = np.ones(total, dtype=np.int64)
    new[left[:before + 1]] = 0
    pairs = (brackets.bits[:-1] == 1) & (brackets.bits[1:] == 0)
    leaf = np.append(0, np.cumsum(np.append(pairs, False)))
    leaves = leaf[close] - leaf[brackets.opens]
    weighted, once = np.append(0, np.cumsum(n * chars)), np.append(0, np.cumsum(new * chars))
    children = np.bincount(parent[1:][new[1:] == 1], minlength=total)
    # The last conversation's end is no leaf if the shard behind goes on below it.
    if after >= lengths[-1] - 1:
        leaves[path] -= 1
    spine = np.zeros(total, dtype=bool)
    spine[left], spine[path] = True, True
    keys: list[bytes | None] = [None] * total
    for nodes, seq in ((left, rows[0][0]), (path, rows[-1][0])):
        state = hashlib.sha256()
        for d, node in enumerate(nodes):
            state.update(seq[(d - 1) * MARK:d * MARK] if d else b"")
            keys[node] = state.digest()[:16]
    ends = np.full(total, None, dtype=object)
    ends[node_of] = [r[3] for r in rows]
    under = parent >= 0
    lookup = under & spine[parent]   # the parent's least id is known once its parts are merged
    known = under & ~lookup
    return pa.RecordBatch.from_arrays([
        pa.array(spine), pa.array(keys, pa.binary()), pa.array([keys[p] if x else None for p, x in zip(parent, lookup)], pa.binary()),
        pa.array(least), pa.array(depth), pa.array(np.where(known, least[parent], 0), mask=~known), pa.array(n), pa.array(children),
        pa.array(leaves), pa.array(weighted[until] - weighted[start]), pa.array(once[until] - once[start]),
        pa.array(ends, pa.string())], schema=NODES)


def trie(conversations: DataFrame) -> DataFrame:
    """`conversations`: (conv, seq). One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends (hash of the ids that end there, null for none)."""
    distinct = materialize(distinct_sequences(conversations))
    tasks = distinct.select(F.ceil(F.sum(F.octet_length("seq") / MARK + 1) / ROWS_PER_TASK).alias("n")).first().n or 1
    by_range = materialize(distinct.repartitionByRange(int(tasks), "seq").sortWithinPartitions("seq"))
    numbered = by_range.withColumn("task", F.spark_partition_id())
    # One row per task that has rows: what it shares with its neighbours.
    edges = numbered.groupBy("task").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    beside = edges.select("task", "first", "last", F.lag("last").over(Window.orderBy("task")).alias("before"),
                          F.lead("first").over(Window.orderBy("task")).alias("behind"))

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["task"], -1 if r["before"] is None else common(r["before"], r["first"]),
                     -1 if r["behind"] is None else common(r["last"], r["behind"])) for r in batch.to_pylist()]
            yield _batch(rows, pa.schema([("task", pa.int32()), ("up", pa.int64()), ("down", pa.int64())]))

    # Three numbers per task.
    shared = {r.task: (r.up, r.down) for r in map_arrow(beside, depths, "task int, up bigint, down bigint").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        nodes, before, task = 0, -1, None
        for batch in batches:
            for seq, n, conv, ends, task in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "first_conv", "ends", "task"))):
                if rows and nodes + len(seq) // MARK + 1 > SHARD_NODES:
                    depth = common(rows[-1][0], seq)
                    yield shard_nodes(rows, before, depth)
                    rows, nodes, before = [], 0, depth
                elif not rows:
                    before = shared[task][0]
                rows.append((seq, n, conv, ends))
                nodes += len(seq) // MARK + 1
        if rows:
            yield shard_nodes(rows, before, shared[task][1])

    nodes = materialize(map_arrow(numbered, run, NODE_COLUMNS))
    merged = materialize(nodes.where("spine").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weighted", "once")], F.max("ends").alias("ends")))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    measures = ("n_convs", "n_children", "n_leaves", (F.col("weighted") - F.col("once")).alias("saved_tokens"), "ends")
    complete = nodes.where("NOT spine AND parent_key IS NULL").select("conv_id", "depth", "parent_conv_id", *measures)
    below = nodes.where("NOT spine AND parent_key IS NOT NULL").select("parent_key", "conv_id", "depth", *measures)
    spines = merged.select("parent_key", "conv_id", "depth", *measures)
    looked_up = below.unionByName(spines.where("parent_key IS NOT NULL")).join(parents, "parent_key")
    root = spines.where("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return complete.unionByName(looked_up.withColumnRenamed("_parent", "parent_conv_id").drop("parent_key")).unionByName(
        root.drop("parent_key"))
