"""Quality classifier, alignment of tokenizers and the prefix trie against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, kernel_quality, prefix_trie, queries

SF = "/root/testdata/sf0.001"
PATHS = tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


# -- 11. Quality classifier ------------------------------------------------------------

def sentences(rng, n, junk):
    words = [rng.choice("the of and to in is that for it was on are with they at be this from have".split())
             + rng.choice(["", "er", "ing", "ed"]) for _ in range(n)]
    if junk == "marks":
        words = [w + rng.choice(["$$$", "###", "%%%"]) for w in words]
    elif junk == "repeats":
        words = [w for w in words for _ in range(20)][:n]
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(k, sentences(rng, rng.randint(30, 200), junk), int(junk is None))
            for k, junk in enumerate(rng.choices([None, "marks", "repeats"], [6, 2, 2], k=600))]
    docs = spark.createDataFrame([(k, t, "x", 7) for k, t, _ in rows] + [(None, None, "x", 7), (700, "", "x", 7), (1, rows[1][1], "x", 7)],
                                 "doc_id long, text string, stats string, score int")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(None, 1), (2, None), (700, 1)], "doc_id long, quality int")
    return rows, docs, labels


def test_held_out_accuracy(spark, corpus):
    rows, docs, labels = corpus
    truth = {k: q for k, _, q in rows}
    got = kernel_quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score >= 0.3, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([p == q for p, q in held]) > 0.97
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_held_out_labels_are_not_read(spark, corpus):
    _, docs, labels = corpus
    held = kernel_quality.remainder(F.col("doc_id")) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    both = [kernel_quality.quality_scores(docs, x).orderBy("doc_id").collect() for x in (labels, turned)]
    assert both[0] == both[1]


def test_model_does_not_depend_on_the_dealing(spark, corpus, monkeypatch):
    _, docs, labels = corpus
    stats = kernel_quality.with_statistics(docs.select("doc_id", "text"))
    models = []
    for parts, rows in ((1, 50_000), (7, 40)):
        monkeypatch.setattr(kernel_quality, "ROWS_PER_GROUP", rows)
        models.append(kernel_quality.train(kernel_quality.labelled(stats.repartition(parts), labels)))
    assert np.array_equal(models[0].weights, models[1].weights) and np.array_equal(models[0].levels, models[1].levels)


def test_normal_equations_against_dense(spark, corpus):
    _, docs, labels = corpus
    rows = kernel_quality.labelled(kernel_quality.with_statistics(docs.select("doc_id", "text")), labels)
    model = kernel_quality.train(rows)
    data = rows.collect()
    x, y = np.array([r.stats for r in data], dtype=float), np.array([r.label for r in data])
    assert np.allclose(model.shift, x.mean(0)) and np.allclose(model.scale[x.std(0) > 1e-3], x.std(0)[x.std(0) > 1e-3])
    z = kernel_quality.features(x, model.shift, model.scale) / kernel_quality.ONE
    ridge = np.diag([model.penalty * len(z)] * (z.shape[1] - 1) + [1e-9])
    assert np.allclose(z @ np.linalg.solve(z.T @ z + ridge, z.T @ y), model.raw(x), atol=1e-6)


def test_fourier_features_approximate_the_kernel(monkeypatch):
    monkeypatch.setattr(kernel_quality, "FEATURES", 8192)
    x = np.random.default_rng(1).normal(0, 2, (20, 5))
    z = kernel_quality.features(x, np.zeros(5), np.ones(5))[:, :-1] / kernel_quality.ONE
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2 / kernel_quality.WIDTH**2)
    assert np.abs(2 * z @ z.T / 8192 - exact).max() < 0.05


def test_isotonic_steps():
    counts, hits = np.zeros(kernel_quality.BINS), np.zeros(kernel_quality.BINS)
    counts[[5, 9, 20, 30]], hits[[5, 9, 20, 30]] = [10, 10, 10, 1000], [2, 1, 9, 1000]
    steps, levels = kernel_quality.pool(counts, hits)
    assert steps.tolist() == [9, 20, 30] and np.all(np.diff(levels) > 0) and levels[0] == pytest.approx(3.5 / 21)
    assert kernel_quality.pool(counts * 0, hits * 0)[1].tolist() == [0.5]


def test_quality_of_nothing(spark, corpus):
    _, docs, labels = corpus
    assert kernel_quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in kernel_quality.quality_scores(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    one = kernel_quality.quality_scores(docs, labels.where("quality = 1")).collect()
    assert all(r.score >= 0.5 for r in one if r.doc_id in (3, 4))


def test_statistics_of_odd_texts():
    table, known = kernel_quality._kind_table(), kernel_quality.Words()
    width = len(kernel_quality.STATISTICS)
    for text in ("", " \n ", "x", "$$$", "中文字 𝒳", "a" * 3_000_000, "a b " * 1_000_000):
        assert len(kernel_quality.statistics_of(text, table, known)) == width
    assert kernel_quality.statistics_of("", table, known) == [0] * width


def test_quality_query(spark):
    rows = queries.QUERIES["op11_quality_classifier"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


# -- 12. Alignment -----------------------------------------------------------------------

def aligned_by_hand(rows):
    """Per text: tokens by the libraries, links by comparing ranges, counts in a dictionary."""
    library = Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def bytes_a(i):
        return bytes(back[c] for c in library.id_to_token(i))

    def bytes_b(i):
        return bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    def ranges(ids, spell):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at := at + len(spell(i))))
        return out

    total, per = collections.Counter(), []
    for doc_id, text in rows:
        a, b = (library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        if not b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + (text or "")).encode():
            a = b = []
        a, b = ranges(a, bytes_a), ranges(b, bytes_b)
        links, low = [], 0
        for i, p, q in a:
            while low < len(b) and b[low][2] <= p:
                low += 1
            at = low
            while at < len(b) and b[at][1] < q:
                links.append((i, b[at][0]))
                at += 1
        groups, start = [], -1
        for end in sorted({x[2] for x in a} & {x[2] for x in b}):
            groups.append("|".join(",".join(str(x[0]) for x in side if start < x[2] <= end) for side in (a, b)))
            start = end
        total.update(links)
        per.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = collections.defaultdict(int)
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    return in_order((d, a, b, g, len(ls), sum(total[x] == best[x[1]] for x in ls), sum(total[x] for x in ls), h) for d, a, b, g, ls, h in per)


ODD = ["<|endoftext|> a<s></s><unk>", "▁a ▁", "a  b\n\n c", None, "", "x" * 5000, " " * 3000, "é中𝒳​\x00", "﻿a", "á ﬁ", "\r\n\t",
       "the same text", "the same text"]


def test_alignment_against_the_libraries(spark):
    rng = random.Random(3)
    rows = [*enumerate(ODD), (None, "abc"), (1, "abc")] + [(100 + k, sentences(rng, rng.randint(1, 60), rng.choice([None, "marks"]))) for k in range(60)]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_a int, bucket string").repartition(3)
    got = alignment.alignment(docs, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert in_order(map(tuple, got.collect())) == aligned_by_hand(rows)
    assert alignment.alignment(docs.limit(0), *PATHS).count() == 0
    assert alignment.alignment(docs.where("text IS NULL"), *PATHS).collect()[0].n_links == 0


def test_alignment_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert in_order(map(tuple, queries.QUERIES["op12_alignment"](spark, SF).collect())) == aligned_by_hand(rows)


def test_salted_counts(spark):
    """Many small runs, dealt to several groups of a bucket and slices, give the counts of a dictionary."""
    rng, width = np.random.default_rng(4), 1000
    rows, want, links = [], collections.Counter(), collections.Counter()
    records = collections.defaultdict(list)
    for run in range(60):
        pair = np.unique((rng.zipf(1.5, 300) % 90 * width + rng.integers(0, 5, 300)) << 8 | rng.integers(0, 9, 300))
        doc, pair, times = (pair & 255).astype(np.uint32), (pair >> 8).astype(np.uint32), rng.integers(1, 4, len(pair)).astype(np.uint32)
        for k in range(alignment.BUCKETS):
            m = pair // width % alignment.BUCKETS == k
            if m.any():
                rows.append((run << 33, k, run % 3, alignment.write_run(pair[m], doc[m], times[m])))
        for p, d, t in zip(pair.tolist(), doc.tolist(), times.tolist()):
            want[p] += t
            records[(run << 33) + d].append((p, t))
    runs = spark.createDataFrame(rows, "row long, bucket int, salt long, run binary").repartition(4)
    counted = alignment.totals(alignment.partial_counts(runs, 3, width), width)
    best = collections.defaultdict(int)
    for p, n in want.items():
        best[p // width] = max(best[p // width], n)
    got = {int(p): int(m) for r in counted.collect() for keys, marked in alignment.read_run(r.run, *alignment.COUNT) for p, m in zip(keys, marked)}
    assert got == {p: 2 * n + (n == best[p // width]) for p, n in want.items()}
    given = alignment.contributions(runs, counted, 3).groupBy("row").agg(F.sum("n_best"), F.sum("count_sum")).collect()
    assert {tuple(r) for r in given} == {(row, sum(t for p, t in rs if want[p] == best[p // width]), sum(t * want[p] for p, t in rs))
                                         for row, rs in records.items()}


def test_runs_come_back_and_merge():
    rng = np.random.default_rng(2)
    runs, want = [], collections.Counter()
    for n in (0, 1, 5, 40_000, 100_000, 3):
        keys = np.sort(rng.integers(0, 2000 if n % 2 else 1 << 32, n)).astype(np.uint32)
        times = rng.integers(1, 1 << 40, n).astype(np.uint64)
        back = list(alignment.read_run(alignment.write_run(keys, times), *alignment.COUNT))
        if n:
            assert all(np.array_equal(np.concatenate([b[k] for b in back]), x) for k, x in enumerate((keys, times)))
        runs.append(iter(map(tuple, back)))
        for k, t in zip(keys.tolist(), times.tolist()):
            want[k] += t
    keys, times = alignment.merge_counts(runs)
    assert dict(zip(keys.tolist(), times.tolist())) == want and np.all(np.diff(keys.astype(np.int64)) > 0)


# -- 13. Prefix trie ---------------------------------------------------------------------

def trie_by_hand(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for s in sorted(members, key=len, reverse=True):
        saved[s] += (len(members[s]) - 1) * (len(s[-1][1]) if s else 0)
        leaves[s] += not children[s]
        if s:
            children[s[:-1]] += 1
            leaves[s[:-1]] += leaves[s]
            saved[s[:-1]] += saved[s]
    return in_order((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s],
                     hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items())


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(turns):
    nodes = prefix_trie.trie(prefix_trie.with_borrowed_heads(turns))
    return in_order(tuple(r[c] if c != "ends_sha256" else r.ends or prefix_trie.NO_IDS for c in TRIE) for r in nodes.collect())


def conversations(rng, n, kinds, longest):
    rows = []
    for c in range(n):
        c = c * 37 if rng.random() < 0.3 else c + 5000
        for t in range(rng.randint(0, longest)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", None]), rng.choice(["hello", "é𝒳", "", None, "x" * t][:kinds])))
    return rows


@pytest.mark.parametrize("limits", [(250_000, 200_000), (25, 60), (1, 7)])
@pytest.mark.parametrize("kinds, longest", [(2, 5), (5, 9)])
def test_trie_against_brute_force(spark, monkeypatch, limits, kinds, longest):
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", limits[0])
    monkeypatch.setattr(prefix_trie, "ROWS_PER_TASK", limits[1])
    rows = list(dict.fromkeys(conversations(random.Random(kinds), 150, kinds, longest)))
    # Equal turn numbers have no order of their own: keep one row of each.
    rows = list({(r[0], r[1]): r for r in rows}.values()) + [(None, 1, "user", "nobody"), *((9000 + k, 0, "user", "same") for k in range(200))]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    assert trie_rows(turns) == trie_by_hand(rows)


def test_trie_of_copies_over_many_chunks(spark, monkeypatch):
    """One conversation under ids far apart: its hash streams over chunks in numerical order."""
    rows = [(c, t, "user", "a" * t) for c in [*range(3, 40_000, 997), 10**12 + 1, 5, -8] for t in range(8)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(turns) == trie_by_hand([r for r in rows])


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", 500)
    rows = [(c, t, "user", "x" if t < 700 else f"{c}-{t}") for c in (1, 2, 3) for t in range(1000)] + [(4, t, "user", "x") for t in range(650)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(turns) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    turns = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie_rows(turns) == [] and trie_rows(turns.limit(0)) == []


def test_find_close():
    rng = random.Random(9)
    for n in (1, 2, 40, 3000):
        for deep in (0.3, 0.5, 0.97):
            bits, depth = [1], 1
            for _ in range(n - 1):
                while depth > 1 and rng.random() > deep:
                    bits.append(0)
                    depth -= 1
                bits.append(1)
                depth += 1
            bits += [0] * depth
            stack, want = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            p = prefix_trie.Parentheses.of(np.array(bits, dtype=np.int8))
            assert dict(zip(p.opens.tolist(), p.find_close().tolist())) == want


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_prefix_trie"](spark, SF)
    assert set(got.columns) == set(TRIE)
    assert in_order(map(tuple, got.select(*TRIE).collect())) == trie_by_hand(rows)
