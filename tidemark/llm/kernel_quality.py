"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic steps.

1. `with_statistics` reduces every text to `STATISTICS`, whole numbers that depend on the text alone.
2. `train` scales them, maps them to `FEATURES` cosines that approximate a Gaussian kernel, and sums the normal
   equations. Equal training rows are one row with a weight, so many copies are no large group; rows are dealt to
   groups of bounded size by a hash, each group gives one triangle of sums, and triangles are added cell by cell. Features
   are rounded to 12 bits, which makes every sum a whole number: the model does not depend on how rows are dealt out.
3. Sums are kept per fold. A model without a fold costs one more solution of the same size, and gives the rows of this
   fold a score that they had no part in. The penalty is chosen by these, and so are the isotonic steps: scores are
   counted in `BINS` cells, and only cells come to the driver.
4. `score` applies the model; it reads the statistics only.

What the driver holds is bounded by FEATURES and BINS, whatever the corpus.

Defined results: null and empty texts have statistics (zeros) and a score like others; repeated rows are scored each; a
null id is not held out and learns nothing; of several labels of one id the least counts, null labels do not; without
any usable label every score is 0.5; an empty table gives no rows. Other columns pass through `score`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .arrow import map_arrow, reachable

FEATURES = 192       # cosines of the kernel approximation
WIDTH = 6.0          # of the Gaussian kernel, in standard deviations of the statistics
ONE = 1 << 12        # a feature is a whole number of 1 / ONE
FOLDS = 4
ROWS_PER_GROUP = 50_000
BINS = 4096          # cells of raw scores from -0.5 to 1.5
PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
SEED = 11
WINDOW = 40          # words
REMEMBERED = 200_000  # words a task keeps
BLOCK = 1 << 20      # characters looked at together

# Kinds of characters; a text is counted by them.
KINDS = ("lower", "upper", "digit", "space", "stop", "mark", "quote", "symbol", "caseless")
STATISTICS = ("log_words", "mean_word", "spread_word", "long_words", "short_words", "distinct_words", "top_word", "next_equal",
              "distinct_triples", "log_lines", "distinct_lines", "words_a_line", "letterless", "capital_words",
              "all_capitals", "marked_most", "repeated_most", *(f"{k}_share" for k in KINDS), "kinds_entropy")
TABLE_SIZE = 0x3000


def _kind_table() -> np.ndarray:
    def kind(c: str) -> str:
        if c.isspace():
            return "space"
        if c.isdigit():
            return "digit"
        if c.isalpha():
            return "upper" if c.isupper() else "lower" if c.islower() else "caseless"
        return "stop" if c in ".,;:" else "mark" if c in "!?¡¿" else "quote" if c in "\"'()-’“”«»" else "symbol"

    return np.array([KINDS.index(kind(chr(c))) for c in range(TABLE_SIZE)] + [KINDS.index("caseless")], dtype=np.int8)


class Words(dict):
    """What the statistics need of a word, in one number: length * 16 + flags. Remembered per task, up to a number of words."""

    def __missing__(self, w: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = (len(w) << 4 | (not w[-1].isalnum() and w[-1] not in ".,;:") | (not any(map(str.isalnum, w))) << 1
                | w.istitle() << 2 | (w.isupper() and len(w) > 1) << 3)
        if len(w) < 40:
            self[w] = code
        return code


def statistics_of(text: str, table: np.ndarray, known: Words) -> list[int]:
    """Logarithms and shares in thousandths, in the order of STATISTICS."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(STATISTICS)
    kinds = np.zeros(len(KINDS), dtype=np.int64)
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at:at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds += np.bincount(table[np.minimum(codes, TABLE_SIZE)], minlength=len(KINDS))
    coded = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=n)
    lengths, marked = coded >> 4, coded & 1
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same = np.fromiter(map(eq, words, words[1:]), dtype=np.int64, count=n - 1)
    # The share in the worst window, so that a junk passage in a long text shows.
    starts = np.arange(0, n, WINDOW)
    full = np.maximum(np.diff(np.append(starts, n)), min(n, WINDOW // 2))
    share = kinds / len(text)
    values = (
        np.log1p(n), lengths.mean(), lengths.std(), (lengths > 12).mean(), (lengths < 4).mean(), len(counts) / n,
        max(counts.values()) / n, same.sum() / n,
        len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1, np.log1p(len(lines)),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), *((coded >> k & 1).mean() for k in (1, 2, 3)),
        (np.add.reduceat(marked, starts) / full).max(), (np.add.reduceat(np.append(same, 0), starts) / full).max(), *share,
        -(share[share > 0] * np.log(share[share > 0])).sum())
    return [round(1000 * float(v)) for v in values]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and `stats`, an array in the order of STATISTICS."""
    kept = [f for f in df.schema if f.name not in (text, "stats")]
    schema = T.StructType([*kept, T.StructField("stats", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = _kind_table(), Words()
        for batch in batches:
            stats = [statistics_of(body.as_py() or "", table, known) for body in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(stats, pa.list_(pa.int32()))],
                                             names=schema.names)

    return map_arrow(df.select(*[F.col(f"`{f.name}`") for f in kept], text), run, schema)


@dataclass(frozen=True)
class Model:
    shift: np.ndarray     # of the statistics
    scale: np.ndarray
    weights: np.ndarray   # of the features, the constant last
    steps: np.ndarray     # upper cell of each isotonic step
    levels: np.ndarray    # and its probability
    penalty: float

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.shift, self.scale) @ self.weights / ONE

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.steps, cell_of(raw)).clip(max=len(self.levels) - 1)]


def features(stats: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """cos(w x + b) with Gaussian w, rounded to whole numbers of 1 / ONE; the last column is ONE."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / WIDTH, (stats.shape[1], FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    x = ((stats - shift) / scale).clip(-8, 8)
    return np.hstack([np.rint(np.cos(x @ w + b) * ONE), np.full((len(x), 1), float(ONE))])


def cell_of(raw: np.ndarray) -> np.ndarray:
    return np.floor((raw + 0.5) * (BINS / 2)).clip(0, BINS - 1).astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def solve(gram: np.ndarray, moment: np.ndarray, penalty: float) -> np.ndarray:
    """The ridge solution; the constant is not penalised."""
    n = max(gram[-1, -1] / ONE**2, 1)
    ridge = np.diag(np.append(np.full(len(gram) - 1, penalty * n * ONE**2), 1e-9 * ONE**2))
    return np.linalg.solve(gram + ridge, moment)


def pool(counts: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps over cells by pooling neighbours that are out of order: (upper cell, level) of each step. Half a
    row of either label is added to a step, so that no level is 0 or 1."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(counts):
        blocks.append([k, counts[k], hits[k]])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            top, n, h = blocks.pop()
            blocks[-1] = [top, blocks[-1][1] + n, blocks[-1][2] + h]
    if not blocks:
        return np.array([BINS]), np.array([0.5])
    top, n, h = (np.array(x, dtype=np.float64) for x in zip(*blocks))
    return top, np.maximum.accumulate((h + 0.5) / (n + 1))


def train(rows: DataFrame) -> Model:
    """`rows`: (stats, fold, label): statistics, a number from 0 to FOLDS - 1, and 0 or 1."""
    rows = materialize(rows.groupBy("fold", "label", "stats").agg(F.count(F.lit(1)).alias("n")))
    width = len(STATISTICS)
    sums = rows.select("n", *[F.element_at("stats", k + 1).cast("decimal(20,0)").alias(f"s{k}") for k in range(width)]).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"), *[F.sum(F.col("n") * F.col(f"s{k}")).alias(f"a{k}") for k in range(width)],
        *[F.sum(F.col("n") * F.col(f"s{k}") * F.col(f"s{k}")).alias(f"b{k}") for k in range(width)]).first()
    size = FEATURES + 1
    if not sums.n:
        return Model(np.zeros(width), np.ones(width), np.zeros(size), np.array([BINS]), np.array([0.5]), PENALTIES[0])
    shift = np.array([float(sums[f"a{k}"]) / sums.n for k in range(width)])
    scale = np.sqrt(np.maximum([float(sums[f"b{k}"]) / sums.n for k in range(width)] - shift**2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)

    cells = np.triu_indices(size)

    def triangle(part: pa.Table) -> pa.Table:
        z = features(_matrix(part.column("stats")), shift, scale)
        n, label = (part.column(c).to_numpy().astype(np.float64) for c in ("n", "label"))
        gram, moment = (z * n[:, None]).T @ z, z.T @ (n * label) * ONE
        values = np.concatenate([gram[cells], moment, [ONE * ONE * (n * label).sum()]])
        return pa.table({"fold": pa.array([part.column("fold")[0].as_py()], pa.int32()),
                         "sums": pa.array([np.rint(values).astype(np.int64)], pa.list_(pa.int64()))})

    groups = -(-sums.distinct // ROWS_PER_GROUP)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("stats", "label"), F.lit(groups)))
    added = (reachable(dealt).groupBy("fold", "part").applyInArrow(triangle, "fold int, sums array<bigint>")
             .select("fold", F.posexplode("sums").alias("cell", "v")).groupBy("fold", "cell").agg(F.sum("v").alias("v")))
    # FOLDS * (FEATURES + 1) * (FEATURES + 4) / 2 numbers, whatever the number of rows
    got = np.zeros((FOLDS, len(cells[0]) + size + 1))
    for batch in added.toArrow().to_batches():
        got[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()

    def system(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gram = np.zeros((size, size))
        gram[cells] = values[:len(cells[0])]
        return gram + np.triu(gram, 1).T, values[len(cells[0]):-1]

    whole = got.sum(0)
    folds = [(system(whole - g), system(g), g[-1]) for g in got if g[cells[0].size - 1] > 0]

    def error(penalty: float) -> float:
        total = 0.0
        for (rest, rest_moment), (gram, moment), hits in folds:
            w = solve(rest, rest_moment, penalty)
            total += hits - 2 * w @ moment + w @ gram @ w
        return total

    penalty = min(PENALTIES, key=error)
    apart = np.stack([solve(*system(whole - g), penalty) for g in got])

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = features(_matrix(batch.column("stats")), shift, scale)
                at = cell_of((z * apart[batch.column("fold").to_numpy()]).sum(1) / ONE)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("n"), batch.column("label")],
                                                 names=["cell", "n", "label"])

    steps = map_arrow(rows.select("stats", "fold", "n", "label"), cells_of, "cell int, n bigint, label int")
    counts, hits = np.zeros(BINS), np.zeros(BINS)
    for r in steps.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hits")).collect():
        counts[r.cell], hits[r.cell] = r.n, r.hits
    return Model(shift, scale, solve(*system(whole), penalty), *pool(counts, hits), penalty)


def score(df: DataFrame, model: Model) -> DataFrame:
    """Adds `score`, from 0 to 1, to rows that have `stats`."""
    schema = T.StructType([*(f for f in df.schema if f.name != "score"), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = model.probability(model.raw(_matrix(batch.column("stats"))))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:-1]), pa.array(p, pa.float64())],
                                                 names=schema.names)

    return map_arrow(df.drop("score"), run, schema)


def remainder(key: Column) -> Column:
    """crc32 of the id as text, modulo 5: rows with 0 are held out, the others are in fold remainder - 1."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def labelled(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Training rows for `train`; held-out rows are not among them, and no label of theirs is read."""
    seen = labels.where(F.col(label).isin(0, 1) & (remainder(F.col(key)) > 0)).groupBy(F.col(key).alias("_id")).agg(
        F.min(label).cast("int").alias("label"))
    return stats.join(seen, stats[key] == seen["_id"]).select(
        "stats", (remainder(F.col("_id")) - 1).cast("int").alias("fold"), "label")


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   label: str = "quality") -> DataFrame:
    """(key, held_out, score) for every row of `docs`."""
    stats = materialize(with_statistics(docs.select(key, text), text))
    model = train(labelled(stats, labels, key, label))
    return score(stats, model).select(key, F.coalesce(remainder(F.col(key)) == 0, F.lit(False)).alias("held_out"), "score")
