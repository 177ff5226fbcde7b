"""Shards along a Hilbert curve over several metadata dimensions.

Native: DataFrame functions only.

Each dimension becomes an order-keeping number, cut at approximate quantiles into 2^bits codes; the codes give the
position on the curve; rows are ordered by (curve index, salt, key, text checksum) and the order is cut into runs. Runs that
are neighbours on the curve are narrow in every dimension, so that min / max of a shard prune files in each.

Law `rows`: shard sizes in rows differ by one at most. Defined results: a null dimension sorts first; an empty
table gives no rows; repeated rows each get a slot of their own; input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BITS = 4
SALTS = 256
ROWS_PER_SALT = 100_000


def order_number(df: DataFrame, name: str) -> Column:
    """A number that orders like the column: strings by their first 6 bytes, null first."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.substring(F.col(name).cast("binary"), 1, 6)
        number = F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("double")
    elif isinstance(kind, (T.DateType, T.TimestampType)):
        number = F.unix_timestamp(F.col(name).cast("timestamp")).cast("double")
    else:
        number = F.col(name).cast("double")
    return F.coalesce(number, F.lit(float("-inf")))


def _gray(w: int) -> int:
    return w ^ (w >> 1)


def _tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """Inverse Gray code, entry point and direction of each of the 2^n sub-cubes of the curve."""
    inverse = sorted(range(1 << n), key=_gray)
    entry = [0 if w == 0 else _gray(2 * ((w - 1) // 2)) for w in range(1 << n)]
    turns = []
    for w in range(1 << n):
        v = w - 1 if w and w % 2 == 0 else w
        ones = 0
        while v >> ones & 1:
            ones += 1
        turns.append(ones % n)
    return inverse, entry, turns


def curve_index(codes: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of integer codes in [0, 2^bits), bit plane by bit plane."""
    n, full = len(codes), (1 << len(codes)) - 1
    inverse, entry, turns = (F.array(*map(F.lit, t)) for t in _tables(n))

    def rotated(v: Column, by: Column, down: bool) -> Column:
        left, right = (F.lit(n) - by, by) if down else (by, F.lit(n) - by)
        return F.call_function("shiftleft", v, left).bitwiseOR(F.call_function("shiftright", v, right)).bitwiseAND(F.lit(full))

    def step(state: Column, bit: Column) -> Column:
        label = F.lit(0)
        for k, code in enumerate(codes):
            label = label.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", code, bit).bitwiseAND(F.lit(1)), F.lit(k)))
        turn = (state["d"] + 1) % n
        turned = rotated(label.bitwiseXOR(state["e"]), turn, True)
        w = F.get(inverse, turned)
        return F.struct(state["e"].bitwiseXOR(rotated(F.get(entry, w), turn, False)).alias("e"),
                        ((state["d"] + F.get(turns, w) + 1) % n).alias("d"),
                        (state["h"] * (1 << n) + w).alias("h"))

    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))
    planes = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(planes, start, step, lambda s: s["h"])


def shard_by_curve(df: DataFrame, dims: list[str], key: str, shards: int, tie: str | None = None,
                   bits: int = BITS) -> DataFrame:
    """Adds curve (long), shard (int) and slot (long, gapless from 0 in each shard).

    `df` should carry metadata only: it is written once, to number a fixed state. `tie` (a column) orders rows with
    one key. Global numbers come from three small steps and no global sort: rows per cell are summed first (at most
    2^(bits * dims) cells), then rows per (cell, salt), and only the rows of one (cell, salt) are numbered together. The salt is a hash of the key and `tie`,
    with enough values that a cell which holds a third of all rows is split into pieces of bounded size.
    """
    marks = [m / (1 << bits) for m in range(1, 1 << bits)]
    df = df.drop("curve", "shard", "slot")
    names = {f"_n{k}": order_number(df, d) for k, d in enumerate(dims)}
    numbered = df.withColumns(names)
    cuts = numbered.agg(*[F.percentile_approx(n, marks, 10_000).alias(n) for n in names], F.count(F.lit(1)).alias("n")).first()
    total = cuts["n"]
    codes = [sum(((F.col(n) > c).cast("int") for c in cuts[n] or ()), F.lit(0)) for n in names]
    salts = max(SALTS, -(-total // ROWS_PER_SALT))
    ties = [key] + ([tie] if tie else [])
    placed = materialize(numbered.withColumns({f"_c{k}": c for k, c in enumerate(codes)})
                         .withColumn("curve", curve_index([F.col(f"_c{k}") for k in range(len(dims))], bits))
                         .withColumn("_salt", F.pmod(F.xxhash64(*ties), F.lit(salts)).cast("int"))
                         .drop(*names, *[f"_c{k}" for k in range(len(dims))]))
    parts = placed.groupBy("curve", "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    cells = parts.groupBy("curve").agg(F.sum("_rows").alias("_all"))
    below = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve", F.coalesce(F.sum("_all").over(below), F.lit(0)).alias("_cell"))
    inside = Window.partitionBy("curve").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = (parts.withColumn("_part", F.coalesce(F.sum("_rows").over(inside), F.lit(0))).join(cells, "curve")
             .select("curve", "_salt", (F.col("_cell") + F.col("_part")).alias("_base")))
    order = Window.partitionBy("curve", "_salt").orderBy(*[F.col(c).asc_nulls_first() for c in ties])
    ranked = (placed.withColumn("_rank", F.row_number().over(order)).join(parts, ["curve", "_salt"])
              .withColumn("_rank", F.col("_base") + F.col("_rank") - 1))
    # shard s holds ranks from ceil(s * total / shards) on
    shard = F.expr(f"CAST((_rank * {shards}) div {max(total, 1)} AS INT)")
    first = F.expr(f"(shard * CAST({max(total, 1)} AS BIGINT) + {shards - 1}) div {shards}")
    return (ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first)
            .drop("_salt", "_rank", "_base"))


def shard_ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Min and max of each dimension per shard: what a reader prunes files by."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[
        f(d).alias(f"{d}_{n}") for d in dims for n, f in (("min", F.min), ("max", F.max))])
