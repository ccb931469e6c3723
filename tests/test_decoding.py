"""Decoding, tokens and scores on small cases and against plain Python."""

import difflib
import re

import pytest
import regex
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import corpus, link, score, spans

TOKEN = "text string, tokens array<struct<tag:string,start:int,end:int,score:double>>"


def found(spark, text, *tokens, threshold=0.5):
    df = spark.createDataFrame([(text, list(tokens))], TOKEN)
    return [(e.label, e.start, e.end, round(e.score, 6)) for e in df.select(spans.merged_entities(F.col("tokens"), F.col("text"), threshold)).first()[0]]


def test_touching_and_parted(spark):
    assert found(spark, "abc def", ("B-X", 0, 3, 0.9), ("B-X", 4, 7, 0.7)) == [("X", 0, 7, 0.8)]
    assert found(spark, "abcdef", ("B-X", 0, 3, 0.9), ("B-X", 3, 6, 0.9)) == [("X", 0, 6, 0.9)]
    assert found(spark, "abc,def", ("B-X", 0, 3, 0.9), ("B-X", 4, 7, 0.9)) == [("X", 0, 3, 0.9), ("X", 4, 7, 0.9)]
    assert found(spark, "abc def", ("B-X", 0, 3, 0.9), ("B-Y", 4, 7, 0.9)) == [("X", 0, 3, 0.9), ("Y", 4, 7, 0.9)]


def test_intruders_are_passed_over(spark):
    assert found(spark, "aa bb cc", ("B-X", 0, 2, 0.9), ("I-Y", 3, 5, 0.01), ("I-X", 6, 8, 0.7)) == [("X", 0, 8, 0.8)]
    assert found(spark, "aa bb cc", ("B-X", 0, 2, 0.9), ("I-Y", 3, 5, 0.9), ("O", 6, 8, 0.9)) == [("X", 0, 2, 0.9), ("Y", 3, 5, 0.9)]


def test_what_entities_are_kept(spark):
    assert found(spark, "aa bb cc", ("B-X", 0, 2, 0.9), ("I-X", 3, 5, 0.9), ("I-X", 6, 8, 0.05)) == []
    assert found(spark, "aa", ("I-X", 0, 2, 0.5)) == [("X", 0, 2, 0.5)]
    assert found(spark, "--", ("B-X", 0, 2, 0.9)) == []
    assert found(spark, "") == []
    assert found(spark, "aa bb", ("O", 0, 2, 0.9), (None, 3, 5, None)) == []


TEXTS = ["CRP 12,5% hoog", "aap-noot (mies)", "a b 3 kg", "", None, "  ", "é—ß 10 €.", "12 13", "…"]


def test_words_have_their_offsets(spark):
    got = {}
    for r in spans.word_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string"), "id").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.word, r.start, r.end))
    pattern = regex.compile(r"\p{N}+[.,]?\p{N}*\s*[%$€]?|\p{L}+(?:-\p{L}+)*|[()\[\]{}]|[^\p{L}\p{N}\s]")
    want = {i: [(m.group(), m.start(), m.end()) for m in pattern.finditer(t or "")] for i, t in enumerate(TEXTS)}
    assert got == {i: w for i, w in want.items() if w}


@pytest.mark.parametrize(("scores", "want"), [({"O": 0.6, "B-X": 0.3, "I-X": 0.1}, "B-X"), ({"O": 0.8, "B-X": 0.2}, "O"), ({"B-X": 0.5, "O": 0.4}, "B-X"), ({"O": 0.1}, "O"), ({}, None)])
def test_o_gives_way(spark, scores, want):
    df = spark.createDataFrame([(scores,)], "m map<string,double>")
    assert df.select(spans.override_o(F.col("m"), 0.7)).first()[0] == want


def test_scores_of_one_class_and_of_nothing(spark):
    rows = [("a", 1, 0.9), ("a", 1, 0.2), ("a", 0, 0.2), ("b", 0, 0.1), ("b", 0, 0.2), ("b", None, 0.9), (None, 1, 0.9)]
    df = spark.createDataFrame(rows, "label string, truth int, prob double")
    got = {(r.scope, r.label): (r.precision, r.recall, r.auc) for r in score.probability_scores(df).collect()}
    assert got["label", "a"] == (1.0, 0.5, 0.75)
    assert got["label", "b"] == (0.0, 0.0, None)
    assert got["macro", ""] == (0.5, 0.25, 0.75)
    assert got["micro", ""][:2] == (1.0, 0.5) and round(got["micro", ""][2], 6) == round((3 + 2) / 6, 6)
    full = {r.label: r.precision for r in score.probability_scores(df, empty=1.0).where("scope = 'label'").collect()}
    assert full == {"a": 1.0, "b": 1.0}


def test_copies_meet_once(spark):
    """Three copies of one text, one near it, one apart: each lists the others by likeness, then id."""
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base)] * 3 + [" ".join([*base[:-1], "end"]), "quite another text", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in link.lsh_link(df, df, k=2, itself=False).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.match_id)
    assert got == {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: [0, 1]}


def test_signatures_as_in_columns(spark):
    df = spark.createDataFrame([(1, " ".join(f"v{i * 7 % 5003}" for i in range(9000))), (2, "a b")], "id int, text string")
    sets = T.shingles(F.split("text", " "), 3)
    want = {tuple(r[0]) for r in df.select(T.minhash(sets, 5)).collect()}
    assert {tuple(r.sig) for r in link.signatures(df, 5).collect()} == want
    assert re.fullmatch("[0-9a-f]{32}", link.signatures(df, 5).first().key)


def test_fuzzy_links(spark):
    """Equal sentences first; else the most similar of the sample, by the earliest sentence that has one; as a plain search finds them."""
    right = [(0, "The quick brown fox jumps. And rests"), (1, "A slow green turtle sleeps. And rests"), (2, "The quick brown fox jumped. Other"), (3, None), (4, "")]
    left = [(10, "Nothing here. and rests"), (11, "The quick brown fax jumps. x"), (12, "the quick brown fox jumpe"), (13, "zzz. yyy"), (14, None), (15, "A slow green turtle slept")]
    a, b = (spark.createDataFrame(x, "id long, text string") for x in (left, right))
    sentences = lambda t: [s.strip().lower() for s in (t or "").split(".") if s.strip()][:2]
    known = []
    for i, t in right:
        known += [(i, s) for s in sentences(t) if s not in [x for _, x in known]]
    for sample in (1000, 2):
        want = set()
        for i, t in left:
            hit = next((r for s in sentences(t) for r, k in known if k == s), None)
            if hit is not None:
                want.add((i, hit, 1.0, "exact"))
                continue
            for s in sentences(t):
                score, _, r = max((difflib.SequenceMatcher(None, s, k).ratio(), -n, r) for n, (r, k) in enumerate(known[:sample]))
                if score >= 0.8:
                    want.add((i, r, score, "fuzzy"))
                    break
        assert {tuple(r) for r in link.fuzzy_link(a, b, sample=sample).collect()} == want
    assert link.fuzzy_link(a, b.limit(0)).count() == 0 and link.fuzzy_link(a.limit(0), b).count() == 0


def test_heads(spark):
    tags = "OIBIIBOIB"
    df = spark.createDataFrame([(1, "X", i, i * 2, i * 2 + 1, t) for i, t in enumerate(tags)], "id int, head string, pos int, start int, end int, tag string")
    assert sorted((r.start, r.end) for r in spans.decode_heads(df, ["id"]).collect()) == [(4, 9), (10, 11), (16, 17)]


def test_collected_annotations(spark):
    tags = "array<struct<start:int,end:int,tag:string>>"
    rows = [("case-a--1", "t", [(0, 1, "SINTOMA")]), ("a--1", "t", [(0, 1, "SYMPTOM"), (2, 3, "X")]), ("b", "u", []), ("c", "u", None), ("d", "u", [(0, 1, None)]), ("d", "v", [(0, 1, "X")])]
    df = spark.createDataFrame(rows, f"id string, text string, tags {tags}")
    found = lambda same: {r.id: (r.text, [tuple(t) for t in r.tags]) for r in corpus.collect_annotations(df, ["case-"], same_text=same).collect()}
    assert found(True) == {"a-1": ("t", [(0, 1, "SYMPTOM"), (2, 3, "X")]), "b": ("u", []), "c": ("u", [])}
    assert found(False)["d"] == ("u", [(0, 1, None), (0, 1, "X")])
