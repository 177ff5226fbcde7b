"""The operators for training data against brute force, on small fixtures with nulls, empty and repeated rows, ties,
clashing column names and empty tables."""

import base64
import bz2
import collections
import gzip
import hashlib
import itertools
import json
import lzma
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from oracle import compare, duck_connection
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import (bpe, hilbert, masked_lm, packing, quality, queries, secret_scan, simhash, substrings,
                          suffix_dedup, url_filter, weighted)
from tidemark.operators import components

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is that for it was on are as with they at be this from have or by one had not but what all".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "ed", str(rng.randint(0, 99))]) for _ in range(n))


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), "doc_id long, text string")


# -- 1. URL filters ------------------------------------------------------------------

def judged(url, rules=url_filter.RULES):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    hits = [(len(h + p), len(h), p, a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(hits)[4], max(hits)[3]) if hits else (None, "allow"))


URLS = ["http://Example.COM/de/x?q#f", "https://a.example.com/de/", "https://a.example.com/de", "http://notexample.com/de/", None,
        "", "no scheme/de/", "ftp://x.net", "ftp://x.net/", "http://example.net/en/a", "http://sub.example.net/en/",
        "http://example.net/fr/", "http://x.org/fr/y", "http://org/fr/", "x://y://z.net/a", "http://ÄB.example.com/de/ü",
        "http://example.com?x=/de/", "http://u:p@h.net:80/p", "http://a.b.c.d.e.f.net/" + "x" * 3000, "http://./", "\nhttp://z.net/"]


def test_url_rules_against_brute_force(spark):
    rows = [(i, u, "old", 1) for i, u in enumerate(URLS + URLS[:3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, digest int")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.RULES))
    assert "digest" in got.columns
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert found == {i: judged(u) for i, u, *_ in rows}


def test_url_rules_ties_and_empty_tables(spark):
    rules = [("b.c", "/x", "allow"), ("b.c", "/x", "block"), ("c", "/x/yy", "allow"), ("a.b.c", "/x", "allow")]
    pages = spark.createDataFrame([(1, "h://b.c/x/yy"), (2, "h://a.b.c/x/yy")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect()}
    assert got == {i: judged(u, rules)[2:] for i, u in ((1, "h://b.c/x/yy"), (2, "h://a.b.c/x/yy"))}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, rules)).count() == 0
    none = url_filter.judge_urls(pages, url_filter.rule_table(spark, []), default="block").collect()
    assert {r.verdict for r in none} == {"block"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    assert compare(spark, duck_connection(SF), name, SF) is None


# -- 2. Sharding ---------------------------------------------------------------------

@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2)])
def test_hilbert_curve_visits_neighbours(spark, dims, bits):
    side = 1 << bits
    grid = spark.createDataFrame(list(itertools.product(range(side), repeat=dims)), ", ".join(f"c{k} int" for k in range(dims)))
    rows = grid.withColumn("h", hilbert.curve_index([F.col(f"c{k}") for k in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side ** dims))
    assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


def check_shards(rows, shards):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)


def test_shards_are_level_and_narrow(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, i]), rng.choice(["a", "b", None]), rng.randint(0, 10 ** 6), 0) for i in range(1000)] + [(5, "a", 7, 0)] * 400
    df = spark.createDataFrame(rows, "doc_id long, lang string, size long, shard int")
    got = hilbert.shard_by_curve(df, ["lang", "size"], "doc_id", 16)
    found = got.collect()
    check_shards(found, 16)
    assert len(found) == 1400
    widths = [r.size_max - r.size_min for r in hilbert.shard_ranges(got, ["size"]).collect()]
    assert sorted(widths)[8] < 500_000
    assert hilbert.shard_by_curve(df.limit(0), ["lang", "size"], "doc_id", 16).count() == 0


def test_sharding_query(spark):
    rows = queries.QUERIES["op2_sharding"](spark, SF).collect()
    check_shards(rows, 16)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


# -- 3. BPE --------------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(RANKS).ranks, special_tokens={})


def test_bpe_equals_the_library(tik):
    rng = random.Random(1)
    parts = ["'", "'s", "'re", "'ve", "'ll", "'l", "'r", "s", "e", "l", " ", "  ", "\n", "\t", " ", "　", "1", "²", "é", "中", "!",
             "\x1c", "\x00", "𝒳", "'d", "'t", "v", "́", "a", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 2000 + "x", "\n" * 500, "ab" * 800 + "'re", prose(rng, 500), "x" * 127 + " ", "y" * 400 + "'s"]
    own = bpe.codec(RANKS)
    for text, ids in zip(texts, own.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
        assert b"".join(text.encode()[a:b] for a, b in zip(own.offsets(ids), [*own.offsets(ids)[1:], len(text.encode())])) == text.encode()


def test_bpe_frames(spark, tik):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (2, "", None), (1, "a b", "x")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, RANKS, offsets="offsets"), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in rows) == [b"", b"", b"a b", b"a b"]
    assert all(len(r.ids) == 4 * len(r.offsets) for r in rows)
    assert bpe.encode(df.limit(0), RANKS).count() == 0


def test_bpe_query(spark, tik):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op3_bpe"](spark, SF).collect():
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# -- 4. Secrets ----------------------------------------------------------------------

def base_spans(text):
    keys = "password passwd secret token api_?key".split()
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in keys)
    spans = [(m.start(), 0, m.end()) for m in re.finditer(rf"""(?:{either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24])


SECRET = 'password = "hunter2secret99"'


def nested():
    b64 = base64.b64encode(SECRET.encode()).decode()
    percent = "".join(f"%{b:02x}" for b in SECRET.encode())
    return {
        f"see {b64} ok": b64,
        f"see {base64.b64encode(f'a {b64} z'.encode()).decode()} ok": None,
        "g " + base64.b64encode(gzip.compress(SECRET.encode(), mtime=0)).decode() + " h": None,
        "p " + base64.b64encode(zlib.compress(base64.b64encode(SECRET.encode()))).decode(): None,
        f"é {percent} v": percent,
        "é " + percent.replace("%", "%25") + " v": percent.replace("%", "%25"),
        "x " + "".join(f"\\u{ord(c):04x}" for c in SECRET) + " y": "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "x " + "".join(f"&#{ord(c)};" for c in SECRET) + " y": "".join(f"&#{ord(c)};" for c in SECRET),
    }


def test_nested_secrets_map_to_the_text():
    for text, exact in nested().items():
        spans = [s for s in secret_scan.scan_text(text) if not s[3]]
        assert spans and spans[0][1] == 0, text
        a, _, b, _ = spans[0]
        assert 2 <= a < b <= len(text) and (exact is None or text[a:b] in exact)


def test_base_spans_stay():
    rng = random.Random(4)
    parts = ["token", "TOKEN=", "api_key: ", "apikey", "=", ":", "'", '"', " ", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "%41",
             "secret", "é", "ſecret=abcdefg", "\n", "passwd", "x.y-z/+"]
    for text in ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)] + [*nested(), "", "a" * 5000]:
        found = secret_scan.scan_text(text)
        assert [s[:3] for s in found if s[3]] == base_spans(text)
        assert found == sorted(found) and all(0 <= a < b <= len(text) for a, _, b, _ in found)


def test_layers_end():
    text = "token=abcdefgh"
    for _ in range(6):
        text = base64.b64encode(text.encode()).decode()
    assert any(not s[3] for s in secret_scan.scan_text(f"x {text} y {text}"))
    assert secret_scan.scan_text("%2525252525 %25%25 \\u005cu0041 " * 20) == []


def test_every_occurrence_of_a_nested_secret(spark):
    inner = base64.b64encode(b"token=abcdef123456").decode()
    once, other = (base64.b64encode(f"{word} {inner} end".encode()).decode() for word in ("see", "or this"))
    escaped = "".join(f"%{b:02X}" if chr(b) in "+/=" else chr(b) for b in base64.b64encode(f"x\u00ff\u00fe>>?? {inner}".encode()))
    assert "%2B" in escaped or "%2F" in escaped
    for first, second in ((once, once), (once, other), (escaped, escaped)):
        text = f"one {first} two {second} three"
        spans = [s for s in secret_scan.scan_text(text) if not s[3]]
        for begin in (4, 4 + len(first) + 5):
            assert any(begin <= a < b <= begin + max(len(first), len(second)) for a, _, b, _ in spans)
        clean = secret_scan.redact(docs_of(spark, [text])).first().text
        assert clean.count("[secret]") >= 2 and inner[8:16] not in clean


def raw_deflate(raw):
    tool = zlib.compressobj(wbits=-15)
    return tool.compress(raw) + tool.flush()


@pytest.mark.parametrize("raw", [
    b"token=abcdef123456 and so on", "a\u00a0b\u3000 token=abcdef123456".encode(), b"\x01\x02\xff token=abcdef123456 \x00\xfe",
    "é token=abcdef123456".encode("utf-16-le"), "token=abcdef123456".encode("utf-16"), "一 token=abcdef123456".encode("utf-16-be"),
    gzip.compress(b"nothing here") + gzip.compress(b"token=abcdef123456"), bz2.compress(b"nothing") + bz2.compress(b"token=abcdef123456"),
    lzma.compress(b"token=abcdef123456"), raw_deflate(b"token=abcdef123456"), gzip.compress(zlib.compress(lzma.compress(b"token=abcdef123456"))),
    gzip.compress("token=abcdef123456".encode("utf-16-le"))])
def test_layers_behind_glued_prefixes(raw):
    for encode in (base64.b64encode, base64.urlsafe_b64encode):
        body = encode(raw).decode()
        for front in ("", "https://h.com/cb/", "id-", "key_", "a/", "see "):
            spans = [s for s in secret_scan.scan_text(f"{front}{body} end") if not s[3]]
            assert any(k == 0 and len(front) <= a < b <= len(front) + len(body) for a, k, b, _ in spans), (front, body)
        if not raw.startswith(raw_deflate(b"token=abcdef123456")):  # has no signature, so it is sought at separators only
            assert any(k == 0 for _, k, _, s in secret_scan.scan_text(f"x{body}") if not s)


def test_streams_are_read_to_the_end(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 1 << 17)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 10)
    long = b"plain words " * 30_000
    body = base64.b64encode(gzip.compress(long + b"token=abcdef123456 " + long)).decode()
    assert any(k == 0 for _, k, _, _ in secret_scan.scan_text(f"x {body} y"))
    cut = base64.b64encode(gzip.compress(b"token=abcdef123456 " + random.Random(2).randbytes(3000))[:-1000]).decode()
    assert any(k == 0 for _, k, _, _ in secret_scan.scan_text(cut))
    windows = list(secret_scan._contents(gzip.compress(long), 0, "gzip"))
    assert len(windows) > 2 and windows[0] + b"".join(w[1 << 10:] for w in windows[1:]) == long


def test_deep_streams(spark):
    raw = b"token=abcdef123456"
    for _ in range(150):
        raw = gzip.compress(raw, 0)
    text = base64.b64encode(raw).decode()
    assert {k for _, k, _, _ in secret_scan.scan_text(text)} == {0}
    assert secret_scan.redact(docs_of(spark, [text])).first().text == "[secret]"


def test_secret_frames(spark):
    df = spark.createDataFrame([(1, "see token=abcdefgh now", 5), (2, None, 6), (3, "", 7), (1, "see token=abcdefgh now", 5)], "doc_id long, text string, spans int")
    assert [len(r.spans) for r in secret_scan.scan(df).orderBy("doc_id").collect()] == [1, 1, 0, 0]
    clean = secret_scan.redact(df).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["see [secret] now"] * 2 + [None, ""] and clean[0].spans == 5
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_secret_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op4_secret_scans"](spark, SF).collect():
        spans = base_spans(texts[r.doc_id])
        listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]


# -- 5. Quality ----------------------------------------------------------------------

def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_quality_counts_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["", " \n\t ", "a", "a b\n\n a b\na b", "x " * 50, "é  z # $", "a b c d e f g h", "\x0b\x0c\r\n", "\x1c y z"]
    texts += [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(60)]
    texts += ["\n".join(prose(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 30))) + "\n" + "z y " * rng.randint(0, 9) for _ in range(40)]
    df = docs_of(spark, texts + [None]).withColumn("n_words", F.lit("old"))
    got = {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in quality.with_counts(df).collect()}
    assert got == {i: counts_of(t or "") for i, t in enumerate(texts + [None])}


def test_quality_fences_keep_prose_and_reject_junk(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), prose(rng, rng.randint(30, 200))) for i in range(900)]
    rows += [(900 + i, "en", "s1", prose(rng, 100).replace(" ", "*** ")) for i in range(20)]
    rows += [(950 + i, "en", "rare", "pillsbuynowcheapest" * 3 + " " + prose(rng, 50).replace(" ", "verylongsuffixhere ")) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    df = df.withColumns({"n_words": F.lit("own"), "kept": F.lit(7)})
    out = quality.quality_filter(df)
    assert out.columns == df.columns and out.select("n_words", "kept").distinct().collect() == [("own", 7)]
    kept = {r.doc_id for r in out.collect()}
    assert kept >= set(range(900)) - {i for i, *_, t in rows[:900] if counts_of(t)[4] * 100 > 30 * counts_of(t)[0]}
    assert not kept & set(range(900, 955))
    assert quality.quality_filter(df.limit(0)).count() == 0


def test_sketch_quantiles(spark):
    rng = random.Random(7)
    values = [int(rng.lognormvariate(6, 2)) for _ in range(2000)]
    rows = [("m", "g", v) for v in values]
    sketch = (spark.createDataFrame(rows, "metric string, lang string, v long").withColumn("bucket", quality.bucket(F.col("v")))
              .groupBy("metric", "lang", "bucket").agg(F.count(F.lit(1)).alias("n")))
    row = quality.quantiles(sketch, ["lang"]).first()
    for q in quality.QUARTILES:
        exact = sorted(values)[math.ceil(len(values) * q / 100) - 1]
        assert exact * 63 / 64 - 1 <= row[f"q{q}"] <= exact


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = counts_of(texts[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == own
        assert r.base_failed == (own[0] < 20 or 100 * own[4] > 30 * own[0]) and not (r.base_failed and r.kept)


# -- 6. Language model ---------------------------------------------------------------

def test_model_prefers_real_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    model = masked_lm.train(docs.where("doc_id % 5 <> 0"), rounds=3)
    rng = random.Random(8)
    held = [(r.doc_id, r.text) for r in docs.where("doc_id % 5 = 0 AND n_chars > 200").collect()]
    rows = [(i, t, 1, 0.5) for i, t in held] + [(i, "".join(rng.sample(t, len(t))), 0, 0.5) for i, t in held] + [(-1, None, 1, 0.5), (-2, "", 1, 0.5)]
    out = masked_lm.score(spark.createDataFrame(rows, "doc_id long, text string, plain int, log_prob double"), model).collect()
    means = {(r.doc_id, r.plain): r.mean_log_prob for r in out}
    assert np.mean([means[i, 1] > means[i, 0] for i, _ in held]) > 0.98
    assert means[-1, 1] is None and means[-2, 1] is None
    text = held[0][1]
    ids = [int(np.searchsorted(model.points, c)) + 1 if c in model.points else len(model.points) + 1 for c in text.encode()]
    assert next(r.n_tokens for r in out if r.doc_id == held[0][0] and r.plain == 1) == len(ids)
    padded, total = [0, 0, *ids, 0, 0], 0.0
    tables, bias, head, head_bias = model.weights
    for i, token in enumerate(ids):
        around = (padded[i], padded[i + 1], padded[i + 3], padded[i + 4])
        z = np.tanh(sum(tables[k][x] for k, x in enumerate(around)) + bias) @ head + head_bias
        total += z[token] - np.log(np.exp(z - z.max()).sum()) - z.max()
    got = next(r.log_prob for r in out if r.doc_id == held[0][0] and r.plain == 1)
    assert abs(got - total) < 1e-3 * abs(total)


SCRIPTS = ["快速的棕色狐狸跳过了懒惰的狗然后回到森林里睡觉", "быстрая лиса прыгает через ленивую собаку и бежит в лес",
           "η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί"]


def test_model_of_other_scripts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").select("doc_id", "text")
    rng = random.Random(9)
    rows = [(1000 + i, line, i) for i, line in enumerate(SCRIPTS)]
    shuffled = [(2000 + 100 * i + k, "".join(rng.sample(line, len(line))), i) for i, line in enumerate(SCRIPTS) for k in range(20)]
    frame = spark.createDataFrame(rows + shuffled, "doc_id long, text string, script int")
    taught = masked_lm.train(docs.unionByName(frame.where("doc_id < 2000").drop("script")), rounds=4)
    ordinary = masked_lm.score(docs, taught).agg(F.avg("mean_log_prob")).first()[0]
    for model, line_counts in ((taught, True), (masked_lm.train(docs, rounds=2), False)):
        means = {(r.doc_id, r.script): r.mean_log_prob for r in masked_lm.score(frame, model).collect()}
        for i in range(len(SCRIPTS)):
            if line_counts:
                assert np.mean([means[1000 + i, i] > m for (d, j), m in means.items() if d >= 2000 and j == i]) > 0.9
            assert means[1000 + i, i] < ordinary


def test_model_does_not_depend_on_the_splits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, other = (masked_lm.train(docs.repartition(n), rounds=2) for n in (2, 9))
    assert (one.points == other.points).all() and all((a == b).all() for a, b in zip(one.weights, other.weights))


def test_model_takes_long_texts(spark, monkeypatch):
    texts = ["ab " * 400_000, "", None, "一二三" * 1000, "ab " * 400_000]
    monkeypatch.setattr(masked_lm, "SHARD_WINDOWS", 10)
    model = masked_lm.train(docs_of(spark, texts), rounds=1)
    found = [(r.n_tokens, r.log_prob) for r in masked_lm.score(docs_of(spark, texts), model).orderBy("doc_id").collect()]
    assert [n for n, _ in found] == [1_200_000, 0, 0, 9000, 1_200_000] and found[0] == found[4] and found[1][1] == 0


def test_model_of_nothing(spark):
    empty = docs_of(spark, ["x"]).limit(0)
    assert masked_lm.score(empty, masked_lm.train(empty, rounds=1)).count() == 0


# -- 7. Packing ----------------------------------------------------------------------

def check_plan(counts, capacity):
    used = [0] * (capacity + 1)
    plan = packing.plan(counts, capacity)
    for content, number in plan:
        assert sum(x * n for x, n in content) <= capacity
        for x, n in content:
            used[x] += n * number
    assert used == counts
    return sum(n for _, n in plan)


def fewest(sizes, capacity):
    """Exact bin packing of a few sizes."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1:]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(9)
    for _ in range(300):
        capacity = rng.randint(5, 30)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = [sizes.count(x) for x in range(capacity + 1)]
        rest = list(counts)
        fixed = sum(n for _, n in packing.reduce_instance(rest, capacity))
        left = [x for x, n in enumerate(rest) for _ in range(n)]
        assert fixed + (fewest(left, capacity) if left else 0) == fewest(sizes, capacity)
        assert check_plan(counts, capacity) >= fewest(sizes, capacity)


def test_plan_is_near_the_bound():
    rng = random.Random(10)
    counts = [0] * 2049
    for _ in range(20_000):
        counts[min(2048, max(1, int(rng.lognormvariate(5.5, 1.2))))] += 1
    assert check_plan(counts, 2048) <= 1.002 * math.ceil(sum(i * n for i, n in enumerate(counts)) / 2048) + 1


def test_packed_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([0, 1, 5, 300, 2000])) for _ in range(60)] + [None, "", "x", "<|endoftext|> é中𝒳"] + ["same text"] * 30
    ids = [*range(len(texts) - 1), None]
    rows = packing.pack_documents(docs_of(spark, texts, ids).withColumn("piece", F.lit("old")), path, with_ids=True).collect()
    expected = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in zip(ids, texts)}
    found, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert own == expected[r.doc_id][r.start:r.start + r.length] and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        found[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for i, pieces in found.items():
        pieces.sort()
        assert [p for p, *_ in pieces] == list(range(len(pieces))) and sum(n for *_, n in pieces) == len(expected[i])
        assert all(n == 2048 for *_, n in pieces[1:])
    for row in places.values():
        row.sort()
        assert [a for a, _ in row] == [sum(n for _, n in row[:k]) for k in range(len(row))] and sum(n for _, n in row) <= 2048
    assert len(places) <= math.ceil(sum(map(len, expected.values())) / 2048) + 1
    assert packing.pack_documents(docs_of(spark, ["x"]).limit(0), path).count() == 0


def test_added_tokens_are_one_id():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.encoder(path)
    for text in ("a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>\n", "<|endoftext|", "x <|ENDOFTEXT|>"):
        assert packing.token_ids(own, text).tolist() == library.encode(text, add_special_tokens=False).ids + [0]


def test_tokenizer_whose_ids_are_out_of_order_is_refused(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = json.load(f)
    model["model"]["merges"].reverse()
    (tmp_path / "t.json").write_text(json.dumps(model))
    with pytest.raises(ValueError):
        packing.encoder(str(tmp_path / "t.json"))


# -- 8. SimHash ----------------------------------------------------------------------

def simhash_of(text, k=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[j:j + k]), 42) for j in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def linked(ids, prints):
    parent = {i: i for i in range(len(prints))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            parent[find(i)] = find(j)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {i: least.get(find(k)) for k, i in enumerate(ids)}


def near_texts(rng):
    texts = [None, "", " \t", "a", "A", "a b", "x " * 400]
    for _ in range(12):
        words = prose(rng, rng.randint(40, 300)).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("limit", [512, 2])
def test_simhash_components(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST", limit)
    texts = near_texts(random.Random(12))
    ids = [*range(10, 9 + len(texts)), None]
    got = {r.doc_id: (r.f & (1 << 64) - 1, r.component_id) for r in simhash.fingerprint_components(docs_of(spark, texts, ids)).collect()}
    prints = [simhash_of(t) for t in texts]
    groups = linked(ids, prints)
    assert got == {i: (p, groups[i]) for i, p in zip(ids, prints)}


def test_simhash_dense_ball(spark, monkeypatch):
    """Fingerprints in one small ball: lists are filed again down to the finest masks and no link is lost."""
    monkeypatch.setattr(simhash, "LIST", 4)
    rng = random.Random(13)
    centre = rng.getrandbits(64)
    points = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    pairs = simhash.candidate_pairs(spark.createDataFrame([(p, 0, p) for p in signed], "id long, t int, f long"))
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_position_groups():
    groups = simhash.position_groups()
    assert all(sum(set(t) <= set(g) for g in groups) == 1 for t in itertools.combinations(range(8), 3))
    assert all(any(set(g) <= set(f) for g in groups) for f in itertools.combinations(range(8), 5))


def test_components(spark):
    rng = random.Random(14)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[a] == got[b] for a, b in edges if a != b) and all(got[c] == c and c <= n for n, c in got.items())
    assert len({got[i] for i in range(61)}) == 1 and got[139] == 100


def test_near_copies(spark):
    rng = random.Random(15)
    rows, groups = [], []
    for g in range(25):
        words = prose(rng, 400).split()
        for c in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(c and 1):
                copy[rng.randrange(len(copy))] = f"edit{c}"
            groups.append(g)
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    rows += [(500, "exact copy here", "en", "s", 1), (501, "exact copy here", "de", "t", 2), (501, "exact copy here", "de", "t", 2),
             (None, None, "en", "s", 0), (None, "", None, None, 0), (None, "lonely", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _key int")
    kept = simhash.near_copies(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({groups.index(g) for g in groups} | {500})
    assert sorted((r.text or "") for r in kept.collect() if r.doc_id is None) == ["", "lonely"]
    assert simhash.near_copies(df.limit(0)).count() == 0

def jaccard(a, b, words=5):
    cut = [{tuple(t.split()[i:i + words]) for i in range(max(1, len(t.split()) - words + 1))} for t in (a, b)]
    return len(cut[0] & cut[1]) / len(cut[0] | cut[1])


def fresh(rng, n):
    return " ".join(f"{rng.getrandbits(40):x}" for _ in range(n))


def test_near_copies_by_added_and_cut_text(spark):
    rng = random.Random(31)
    pairs = []
    for k in range(120):
        body = fresh(rng, 80 + k)
        words = body.split()
        n = len(words) - 4
        other = body + " " + fresh(rng, n // 4) if k % 2 else " ".join(words[:len(words) - n // 5])
        assert 0.8 <= jaccard(body, other) <= 0.85
        pairs += [body, other]
    kept = {r.doc_id for r in simhash.near_copies(docs_of(spark, pairs)).collect()}
    assert kept == set(range(0, 240, 2))

def test_near_copies_in_chains(spark, monkeypatch):
    rng = random.Random(32)
    texts = []
    for _ in range(40):  # a window that moves on: neighbours are alike, versions further apart are not
        words = fresh(rng, 300).split()
        texts += [" ".join(words[k * 10:k * 10 + 120]) for k in range(6)]
    assert jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[2])
    rng.shuffle(texts)
    owner = {}
    for i, t in enumerate(texts):
        owner.setdefault(i, i)
        for k in range(i):
            if set(t.split()) & set(texts[k].split()) and jaccard(t, texts[k]) >= 0.8:
                a, b = sorted((owner[k], owner[i]))
                owner = {x: a if y == b else y for x, y in owner.items()}
    for limit in (512, 3):
        monkeypatch.setattr(simhash, "LIST", limit)
        monkeypatch.setattr(simhash, "ROUNDS", 8 if limit > 3 else 0)
        assert {r.doc_id for r in simhash.near_copies(docs_of(spark, texts)).collect()} == set(owner.values())


def test_links_of_one_list_connect_what_is_alike(spark):
    words = list(range(40))
    chain = [words[:30], words[3:33], words[6:36], words[9:39]]  # neighbours 27 of 33, others at most 24 of 36
    orders = list(itertools.permutations(range(4)))
    sets = [(10 * k + p, chain[x]) for k, order in enumerate(orders) for p, x in enumerate(order)]
    nodes = [(i, [i // 10]) for i, _ in sets]
    links = simhash.linked_copies(spark.createDataFrame(nodes, "id long, bands array<long>"),
                                  spark.createDataFrame(sets, "id long, shingles array<long>"), 0.8).collect()
    assert all(abs(dict(sets)[r.a][0] - dict(sets)[r.b][0]) == 3 for r in links)
    assert {(min(r), max(r)) for r in links} == {(10 * k + a, 10 * k + b) for k, order in enumerate(orders)
                                                 for a, b in itertools.combinations(range(4), 2) if abs(order[a] - order[b]) == 1}


@pytest.mark.parametrize("together", [2048, 6])
def test_a_list_of_many_unlike_texts_is_compared_at_once(spark, monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together, raising=False)
    jobs, plain = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df: jobs.append(1) or plain(df))
    common = list(range(1000, 1060))
    sets = [(i, common + list(range(100 * i, 100 * i + 20))) for i in range(100, 130)]  # 60 of 100: unlike
    sets += [(i + 1000, s[:-2]) for i, s in sets[:9]]  # 78 of 80
    nodes = spark.createDataFrame([(i, [1, 2, 3, 4]) for i, _ in sets], "id long, bands array<long>")
    links = simhash.linked_copies(nodes, spark.createDataFrame(sets, "id long, shingles array<long>"), 0.8).collect()
    assert {(min(r), max(r)) for r in links} == {(i, i + 1000) for i in range(100, 109)}
    assert together == 6 or len(jobs) <= 3  # no rounds that set one text aside each


def test_common_counts():
    rng = np.random.default_rng(33)
    sets = [np.unique(rng.integers(0, 60, n)) for n in (0, 1, 5, 20, 40, 40, 60)] + [np.arange(70, 5000), np.arange(60, 5000)]
    wanted = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert simhash.common_counts(sets).tolist() == wanted
    assert simhash.spanning_links([1, 2], [1, 2], [np.zeros(0, np.int64)] * 2, 0.8) == [(1, 2)]  # empty sets are equal


def test_near_copies_come_from_the_byte_index(spark, monkeypatch):
    rng = random.Random(34)
    texts = []
    for k in range(30):  # long texts with one word changed: most are within three bits
        words = fresh(rng, 600).split()
        texts += [" ".join(words), " ".join([*words[:300], "edited", *words[301:]])]
    prints = [simhash.fingerprint(t, simhash.SHINGLE) for t in texts]
    near = {k for k in range(0, 60, 2) if (prints[k] ^ prints[k + 1]).bit_count() <= simhash.RADIUS}
    assert len(near) > 10
    monkeypatch.setattr(simhash, "band_keys", lambda shingles: [])
    kept = {r.doc_id for r in simhash.near_copies(docs_of(spark, texts)).collect()}
    assert kept == set(range(60)) - {k + 1 for k in near}


# -- 9. Weighted sampling ------------------------------------------------------------

def weights_of(text):
    return {t: 1 + math.log(n) for t, n in collections.Counter(text.lower().split()).items()}


def test_collision_rate_is_the_generalised_jaccard():
    rng = random.Random(16)
    sampler, errors = weighted.Sampler(), []
    for trial in range(80):  # words of their own, so that the trials are independent
        base = [f"{w}{trial}" for w in prose(rng, 300).split()]
        cut = rng.randint(0, 300)
        other = base[:cut] + [f"{w}{trial}" for w in prose(rng, 300 - cut).split()] + [f"the{trial}"] * rng.randint(0, 50)
        a, b = weights_of(" ".join(base)), weights_of(" ".join(other))
        exact = sum(min(a.get(t, 0), b.get(t, 0)) for t in a | b) / sum(max(a.get(t, 0), b.get(t, 0)) for t in a | b)
        x, y = sampler.fingerprints([" ".join(base), " ".join(other)])
        errors.append(weighted.likeness(x, y) - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_fingerprints_do_not_depend_on_the_batch():
    rng = random.Random(17)
    texts = ["", "one", prose(rng, 50), " ".join(f"w{i}" for i in range(weighted.PAIRS * 2 + 5)), prose(rng, 700)]
    together = weighted.Sampler().fingerprints(texts * 2)
    alone = [weighted.Sampler().fingerprints([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone * 2))
    assert not together[0].any() and together[1].all()


@pytest.mark.parametrize("rows_per_part", [5_000, 7])
def test_edited_texts(spark, monkeypatch, rows_per_part):
    monkeypatch.setattr(weighted, "ROWS_PER_PART", rows_per_part)
    rng = random.Random(18)
    texts = [prose(rng, rng.randint(0, 40)) + "é" for _ in range(50)] + [None, "", "same", "same"]
    ids = [*range(100, 100 + len(texts) - 2), 7, None]
    rows = {r.doc_id: r for r in weighted.compare_edited(docs_of(spark, texts, ids)).collect()}
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is None, -(r[0] or 0)))
    sampler = weighted.Sampler()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + after[:k]
        a, b, c = sampler.fingerprints([text, edited, after])
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].near_edited == weighted.likeness(a, b) and rows[i].near_next == weighted.likeness(a, c)
    assert rows[7].fingerprint == rows[None].fingerprint
    assert weighted.compare_edited(docs_of(spark, ["x"]).limit(0)).count() == 0
    assert weighted.compare_edited(docs_of(spark, ["alone here"])).first().near_next == 1.0
    assert weighted.fingerprint(docs_of(spark, [None, "x"]).withColumn("fingerprint", F.lit(1))).count() == 2


# -- 10. Suffix dedup ----------------------------------------------------------------

def without_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask) if not m)
        out.append((len(b), sum(mask), sum(1 for i in range(len(b)) if mask[i] and (i == 0 or not mask[i - 1])), kept))
    return out


def repetitive(rng):
    base = "".join(rng.choices("abcdefgh é", k=4000))
    texts = [None, "", "z" * 399, "z" * 400, "y" * 401, "q" * 1200, "xy z" * 300]
    for _ in range(80):
        body = ""
        for _ in range(rng.randint(1, 4)):
            i = rng.randint(0, 3500)
            body += base[i:i + rng.randint(100, 1200)] + "".join(rng.choices("klmnop", k=rng.randint(0, 60)))
        texts.append(body)
    return texts + texts[:12]


@pytest.mark.parametrize("length", [400, 150])
def test_repeats_against_brute_force(spark, length):
    texts = repetitive(random.Random(length))
    df = docs_of(spark, texts).withColumn("tid", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.summary(df, length=length).collect()}
    want = without_repeats(texts, length)
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in enumerate(want)}
    clean = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df.drop("tid").withColumn("nb", F.lit(1)), length=length).collect()}
    assert clean == {i: None if texts[i] is None else w[3].decode("utf-8", "ignore") for i, w in enumerate(want)}


@pytest.mark.parametrize("batch", [1 << 20, 500])
def test_summary_gives_what_is_kept(spark, monkeypatch, batch):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    rng = random.Random(21)
    half = "".join(rng.choices("àé", k=200))
    texts = [*repetitive(rng), "ab" + half + "è", "cd" + half + "ê", "plain"]  # è and ê begin with the same byte
    got = {r.doc_id: r for r in suffix_dedup.summary(docs_of(spark, texts), length=400).collect()}
    want = without_repeats(texts, 400)
    assert {i: r.text for i, r in got.items()} == {i: None if t is None else w[3].decode("utf-8", "ignore") for i, (t, w) in enumerate(zip(texts, want))}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {
        i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in enumerate(want)}
    assert got[len(texts) - 3].text == "ab" and got[len(texts) - 3].n_removed == 401


def test_repeats_of_nothing(spark):
    assert suffix_dedup.summary(docs_of(spark, ["x"]).limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(docs_of(spark, ["x", None])).count() == 2


def test_anchor_choice_is_local():
    rng = random.Random(19)
    shared = "".join(rng.choices("abcd", k=450)).encode()
    parts = [bytes(rng.choices(b"wxyz", k=rng.randint(0, 300))) + shared + bytes(rng.choices(b"wxyz", k=200)) for _ in range(4)]
    chosen = []
    for p in parts:
        at = p.index(shared)
        owner, a, low, high, *_ = substrings.anchors(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]), 400)
        chosen.append([next(int(x) - at for x, lo, hi in zip(a, low, high) if x - hi <= s <= x - lo) for s in range(at, at + 51)])
    assert all(c == chosen[0] for c in chosen)


def test_anchors_of_a_text_beyond_the_places(monkeypatch):
    rng = random.Random(33)
    passage = rng.randbytes(1500)
    text = b"".join([rng.randbytes(40_000), passage, rng.randbytes(30_000), passage, rng.randbytes(5_000)])
    monkeypatch.setattr(substrings, "PLACE_BITS", 12)
    owner, at, low, high, grams, span = substrings.anchors(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]), 400)
    one, two = ({(a - start, g) for a, h, b, g in zip(at, high, low, grams) if start <= a - h and a - b + 400 <= start + 1500}
                for start in (40_000, 71_500))
    assert one and one == two and (low <= high).all() and (low >= 0).all() and (high <= 400).all()
    starts = np.concatenate([np.arange(a - y, a - x + 1) for a, x, y in zip(at, low, high)])
    assert (np.sort(starts) == np.arange(len(text) - 399)).all()
