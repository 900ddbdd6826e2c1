"""The queries of the subpackage against SQL, or against plain ways to the same result."""

from collections import Counter

import pytest

from compare import connect, same
from ligature.llm import leaks, queries, tokenize
from ligature.llm.mail import segments

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", SQL)
def test_same(spark, sf, con, name):
    same(queries.queries()[name](spark, sf), con, SQL[name])


def test_p1_pairs_are_those_of_the_entities(spark, sf):
    members = queries.p1_entities(spark, sf).collect()
    pairs = Counter()
    for r in queries.p1_found(spark, sf).collect():
        pairs[r.entity_kind, r.left_key] += 1
        pairs[r.entity_kind, r.right_key] += 1
    assert {(r.entity_kind, r.member_key): r.links for r in members} == pairs and pairs


def test_p7_ids_are_those_of_the_library(spark, sf):
    encode = tokenize.encoder(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}")
    want = {r.doc_id: encode(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: list(r.ids) for r in queries.p7_ids(spark, sf).collect()} == want


def test_p8_is_a_plain_search_for_ten_words(spark, sf):
    grams = lambda words: {tuple(words[k : k + 10]) for k in range(len(words) - 9)}
    items = {}
    for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect():
        for g in grams(leaks.words_of(r.text or "")):
            items.setdefault(g, set()).add(r.item_id)
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        for piece in segments(r.text):
            for g in grams(leaks.words_of(piece)):
                want |= {(r.doc_id, i) for i in items.get(g, ())}
    assert {(r.doc_id, r.item_id) for r in queries.p8_found(spark, sf).collect()} == want and want


def test_p9_restores_what_it_finds(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    restored = {r.doc_id: r.text for r in queries.p9_restored(spark, sf).collect()}
    assert restored.keys() == {r.doc_id for r in queries.p9_found(spark, sf).collect()} and restored
    # All that the restored text lacks is gone for good: bytes lost.
    assert all(texts[k] != t or "\ufffd" in t for k, t in restored.items())
