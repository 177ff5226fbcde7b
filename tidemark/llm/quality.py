"""Quality rules with thresholds learnt from mergeable quantile sketches per language and source.

Native: DataFrame functions only.

Features of a text are counted inside its row. Their values go into sketches: counts per bucket, where a bucket keeps
the seven leading bits of an integer value, so the error of a quantile is below 1/64 of it. Sketches merge by adding
counts, so one pass of partial sums builds them and coarser levels (language, all) are sums of finer ones. A group
with fewer than `MIN_GROUP` texts uses the sketch of its language, and that of all texts below that. Fences stand at
the upper quartile plus `SPREAD` interquartile ranges plus a slack per feature; a text beyond a fence is rejected.
The thresholds are joined back on (language, source).

Defined results: a null text is an empty one (no words, so it fails the base rule); a null language or source is a
group of its own; repeated rows are judged alike; result columns replace input columns of the same name. Repeated windows are found by
64-bit hashes of eight words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .frames import set_aside

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_GROUP = 200
SPREAD = 4
BROADCAST_GROUPS = 50_000
LEAD = 7  # bits of a value that its bucket keeps
QUARTILES = (25, 75)
# Feature: value in thousandths from the counts; slack in thousandths, so that a narrow group rejects no ordinary text.
METRICS = {"symbols": ("n_symbols", 200), "dup_lines": ("n_dup_lines", 150), "repeats": ("n_repeat_words", 300),
           "length": ("word_chars", 2500)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _repeat_words(hashes: Column) -> Column:
    """Positions covered by windows that occur more than once: sort (hash, position), keep equal neighbours."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.transform(F.array(pairs), lambda p: F.transform(F.filter(
        p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])), lambda x: x["i"]))
    covered = F.aggregate(
        F.sort_array(F.get(repeated, F.lit(0))),
        F.struct(F.lit(0).cast("int").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once per row: the optimizer would copy a projected expression into every use,
    also into lambdas, where it would run per element. It does not look through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of each text. One pass, no shuffle; nothing but the row is needed."""
    docs = docs.drop(*COUNTS)
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.size("_words")
    hashed = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                             lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
                    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    docs = docs.withColumns({
        "word_chars": F.char_length(F.translate(body, SPACE, "")).cast("long"),
        "n_symbols": (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long")})
    docs = _once(_once(_once(docs, "_words", _words(body)), "_hashes", hashed), "_lines", lines)
    return docs.withColumns({
        "n_words": n.cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_hashes")).cast("long"),
    }).drop("_words", "_hashes", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _value(metric: str) -> Column:
    """The feature in thousandths per word, as an integer."""
    return F.expr(f"(1000 * {METRICS[metric][0]}) div greatest(n_words, 1)")


def bucket(value: Column) -> Column:
    """Lower bound of the value's bucket: its leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - LEAD, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counted: DataFrame) -> DataFrame:
    """Rows (lang, source, metric, bucket, n) over the texts that pass the base rule."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(_value(m)).alias("bucket")) for m in METRICS]))
    return (counted.where(~base_failed()).select("lang", "source", values.alias("v"))
            .groupBy("lang", "source", "v.metric", "v.bucket").agg(F.count(F.lit(1)).alias("n")))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of each metric per group: the first bucket whose running count reaches the share."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    running = F.sum("n").over(group.orderBy("bucket"))
    ranked = merged.withColumns({"at": running, "all": F.sum("n").over(group)})
    return ranked.groupBy(*by, "metric").agg(F.max("all").alias("all"), *[
        F.min(F.when(F.col("at") * 100 >= q * F.col("all"), F.col("bucket"))).alias(f"q{q}") for q in QUARTILES])


def fences(counted: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with a fence for every metric, taken from the finest level with enough texts."""
    fine = materialize(sketches(counted))
    levels = {"s": quantiles(fine, ["lang", "source"]), "l": quantiles(fine, ["lang"]), "g": quantiles(fine, [])}
    names = [c for c in ("all", *[f"q{q}" for q in QUARTILES])]
    s, l, g = (levels[k].withColumnsRenamed({c: f"{k}_{c}" for c in names}) for k in "slg")
    l = l.withColumnsRenamed({"lang": "l_lang", "metric": "l_metric"})
    g = g.withColumnsRenamed({"metric": "g_metric"})
    joined = (s.join(l, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
              .join(g, F.col("metric") == F.col("g_metric")))

    def pick(q: int) -> Column:
        return (F.when(F.col("s_all") >= min_group, F.col(f"s_q{q}"))
                .when(F.col("l_all") >= min_group, F.col(f"l_q{q}")).otherwise(F.col(f"g_q{q}")))

    slack = F.coalesce(*[F.when(F.col("metric") == m, F.lit(v)) for m, (_, v) in METRICS.items()])
    fence = pick(75) + spread * (pick(75) - pick(25)) + slack
    limits = materialize(joined.withColumn("fence", fence).groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"fence_{m}") for m in METRICS]))
    # Counted, so the hint stands on a known size; with more groups texts and fences meet by a shuffle.
    return F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept. A group without fence (all its texts fail the base rule) needs none."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    out = counted.drop("base_failed", "kept").join(limits, F.col("lang").eqNullSafe(F.col("_lang"))
                       & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & F.coalesce(_value(m) <= F.col(f"fence_{m}"), F.lit(True))
    return (out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)
            .drop("_lang", "_source", *[f"fence_{m}" for m in METRICS]))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns. The counts are taken twice (for the sketches and for the
    verdict), which is cheaper than moving the texts."""
    docs, restored = set_aside(docs, "lang", "source", text)
    slim = with_counts(docs.select("lang", "source", text), text).select("lang", "source", *COUNTS)
    marked = judge(with_counts(docs, text), fences(slim))
    return restored(marked.where("kept"))
