"""Token ids against the public library, and the way back."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligature.llm import tokenize

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}"), reason="no vocabulary")

TEXTS = [
    None, "", " ", "\n\n", "a", "Don't we'll  it's <|endoftext|>\tx", "Größe für 研究室 привет 👩🏽‍🔬", "x" * 5000, "½ ² Ⅷ ١٢٣ a\x1cb\x85c\xa0d", " lead and trail ", "_under_score__ a_b", "é́  ", "﻿bom", "same", "same",
]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, block string")


def test_ids(spark):
    encode = tokenize.encoder(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}")
    got = {r.doc_id: list(r.ids) for r in tokenize.encode_corpus(frame(spark, TEXTS)).collect()}
    assert got == {k: encode(t or "") for k, t in enumerate(TEXTS)}


def test_ids_are_those_of_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in tokenize.encode_corpus(frame(spark, TEXTS)).collect()}
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(TEXTS)}


def test_round_trip(spark):
    coded = tokenize.encode_corpus(frame(spark, TEXTS))
    assert {r.doc_id: r.text for r in tokenize.decode_corpus(coded).collect()} == {k: t or "" for k, t in enumerate(TEXTS)}


def test_decode_lists(spark):
    f = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokenize.decode_corpus(f).collect()} == {1: "", 2: "", 3: "ab"}
    with pytest.raises(Exception, match="vocabulary"):
        tokenize.decode_corpus(spark.createDataFrame([(1, [99_999])], "doc_id long, ids array<int>")).collect()


def test_positions_are_packed_and_unpacked():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 70_000, 100_000).astype(np.int32)
    docs, back = tokenize.documents_of(tokenize.head_of([5, None, -7], [99_990, 0, 10], codes))
    assert (back == codes).all() and docs.tolist() == [[0, 5, 99_990], [1, 0, 0], [0, -7, 10]]


def test_small_blocks_and_settled_input(spark):
    encode = tokenize.encoder(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}")
    f = frame(spark, TEXTS)
    for docs in (f, f.repartition(3, "doc_id"), f.distinct()):
        got = {r.doc_id: list(r.ids) for r in tokenize.encode_corpus(docs, block_chars=5).collect()}
        assert got == {k: encode(t or "") for k, t in enumerate(TEXTS)}


def test_partitions_follow_the_size(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tokenize.partitions(spark, 0) == least
    assert tokenize.partitions(spark, 30 << 30) == 7680 and tokenize.partitions(spark, 100 << 40) == 100 << 40 >> 27


def test_very_long_text(spark):
    texts = ["word " * 200_000, "x" * 300_000, "é" * 100_000]
    encode = tokenize.encoder(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}")
    got = {r.doc_id: list(r.ids) for r in tokenize.encode_corpus(frame(spark, texts)).collect()}
    assert got == {k: encode(t) for k, t in enumerate(texts)}


def test_rows_keep_their_number(spark):
    f = frame(spark, ["a b"]).unionByName(frame(spark, ["c"])).unionByName(frame(spark, [None]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(len(r.ids) for r in tokenize.encode_corpus(f).collect()) == [0, 1, 2]


def test_fast_pattern_agrees():
    full = tokenize.splitters()[2]
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x530), *range(0x2000, 0x2100), *range(0x3000, 0x3100), 0x4E00, 0x9FFF, 0xFF21, 0x1F600, 0x660]]
    for _ in range(3000):
        text = "".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice(" ab1'_s\n") for _ in range(rng.randrange(20)))
        assert tokenize.pre_tokens(text) == full(text)
    for c in pool:
        for text in (f"a{c}b", f"1{c} 2", f" {c}{c} ", f"{c}_ .{c}"):
            assert tokenize.pre_tokens(text) == full(text), repr(text)


def test_empty(spark):
    assert tokenize.encode_corpus(frame(spark, ["x"]).limit(0)).count() == 0
