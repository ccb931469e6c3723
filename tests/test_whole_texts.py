"""Registered queries see whole texts, not openings."""

import hashlib

import pytest

from spanloom.functions.kernels import clean_span
from spanloom.plans import registry

OPENING = " ".join(f"w{i}" for i in range(40))
TAILS = [" ".join(f"{x}{i}" for i in range(60)) for x in "ab"]


def put(spark, tmp_path, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.fixture
def linked(spark, tmp_path):
    """Document 1 opens like item 7 only; document 2 is item 8 but for its first words."""
    docs = [(1, f"{OPENING} {TAILS[0]}"), (2, f"other start {OPENING} {TAILS[1]}")]
    items = [(7, f"{OPENING} {' '.join(f'c{i}' for i in range(60))}"), (8, f"first words {OPENING} {TAILS[1]}")]
    return put(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))


def test_signatures_of_all_shingles(spark, linked):
    got = {(r.id, r.slot): r.value for r in registry.minhash_signature(spark, linked).collect()}
    words = f"{OPENING} {TAILS[0]}".split()
    hashes = [int(hashlib.md5(" ".join(words[i : i + 3]).encode()).hexdigest()[:7], 16) for i in range(len(words) - 2)]
    assert [got[1, i] for i in range(8)] == [min(((7 * i + 13) * h + 11 * i + 17) % 1_000_000_007 for h in hashes) for i in range(8)]


def test_links_by_whole_texts(spark, linked):
    assert [(r.id, r.match_id) for r in registry.lsh_link(spark, linked).collect()] == [(2, 8)]
    assert {r.id: (r.match_id, r.stage) for r in registry.cascade_link(spark, linked).collect()} == {1: (None, "none"), 2: (8, "lsh")}
    got = {r.id: (r.match_id, round(r.similarity, 6)) for r in registry.length_jaccard_link(spark, linked).collect()}
    assert got == {2: (8, round(100 / 104, 6))}


def test_encoding_of_all_documents(spark, tmp_path):
    texts = ["plain", "café", "cafÃ©", "fÃ¼r 10 â‚¬", "漢字", "", None]
    want = ["plain", "café", "café", "für 10 €", "漢字", "", None]
    sf_dir = put(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in registry.mojibake_fix(spark, sf_dir).collect()) == list(enumerate(want))


def test_distance_of_whole_sentences(spark, tmp_path):
    """Documents 0 and 1 agree in 60 characters and differ after them; document 2 is one edit from document 1."""
    same = "x" * 60
    docs = [(0, f"A first sentence. {same}{'a' * 20}."), (1, f"A first sentence. {same}{'b' * 20}."), (2, f"A first sentence. {same}{'b' * 19}c.")]
    got = registry.levenshtein_link(spark, put(spark, tmp_path, documents=(docs, "doc_id long, text string"))).collect()
    assert sorted((r.id, r.match_id, r.distance) for r in got if r.matched) == [(2, 1, 1)] and len(got) == 3


def test_empty_texts_are_not_alike(spark, tmp_path):
    sf_dir = put(spark, tmp_path, documents=([(1, ""), (2, "..."), (3, None)], "doc_id long, text string"), benchmark=([(7, ""), (8, " !")], "item_id long, text string"))
    assert registry.lsh_link(spark, sf_dir).count() == 0


@pytest.mark.parametrize(
    ("text", "lang", "want"),
    [("koorts van", None, ("koorts", 0, 6)), ("koorts met van", "xx", ("koorts", 0, 6)), ("fever and", "en", ("fever and", 0, 9)), ("fever with", "EN", ("fever", 0, 5)), ("van", "nl", None), ("__", "en", ("__", 0, 2)), ("--", "en", None)],
)
def test_words_left_hanging(text, lang, want):
    assert clean_span(text, 0, len(text), "SYMPTOM", lang) == want
