"""The stages of the corpus pipeline, each on its own input."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
from test_operators import SECRET, counts_of, prose
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark, texts):
    rows = [(i, t, random.Random(i).choice(["en", "de", None]), "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    rng = random.Random(20)
    clean = [prose(rng, rng.randint(60, 200)) for _ in range(300)]
    shared = prose(rng, 60)
    texts = clean + [None, "", "too short", prose(rng, 100).replace(" ", "### "), "spam " * 300]
    copy, passage, secret = len(texts), len(texts) + 2, len(texts) + 4
    texts += [clean[0], clean[1].replace(clean[1].split()[5], "edited", 1)]
    texts += [prose(rng, 80) + " " + shared + " " + prose(rng, 80) for _ in range(2)]
    texts += [prose(rng, 50) + f" {SECRET} " + prose(rng, 50)]
    docs = table(spark, texts)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r.doc_id: r for r in docs.collect()} if k < 4 else docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    wanted = {i for i, t in enumerate(texts) if t is not None and counts_of(t)[0] >= 20 and 100 * counts_of(t)[4] <= 30 * counts_of(t)[0]}
    assert set(kept[names[0]]) == wanted - {303}
    assert set(kept[names[1]]) == set(kept[names[0]]) - {copy, copy + 1}
    assert set(kept[names[2]]) == set(kept[names[3]]) == set(kept[names[1]])
    for i, r in kept[names[2]].items():
        if i in (passage, passage + 1):
            assert shared not in r.text and r.n_chars == len(r.text) <= len(texts[i]) - len(shared)
        else:
            assert r.text == texts[i]
    masked = kept[names[3]]
    assert "hunter2" not in masked[secret].text and "[secret]" in masked[secret].text
    assert all(r.text == kept[names[2]][i].text for i, r in masked.items() if i != secret)
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    ids = {i: library.encode(r.text, add_special_tokens=False).ids + [0] for i, r in masked.items()}
    pieces = kept[names[4]]
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
    assert all(zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in pieces)
    assert len({r.sequence_id for r in pieces}) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = table(spark, ["x"]).limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)
