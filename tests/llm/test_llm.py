"""The training-data operators against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import sys

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from spanloom.llm import bpe_automaton, exact_dedup, lm, mixture, ngram_join, queries, shards, token_counts, topk, toxicity, url_rules  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, key string, id long"
TEXTS = [None, "", "   ", "a", "a  b\tc d e", "a b c d e", "word " * 3000, "x" * 5000, "one two three four five six seven", "one two three four five six eight", "Ünïcode <|endoftext|> İΣσ 漢字", "same", "same", "same"]


@pytest.fixture(scope="module")
def documents():
    return [(r["doc_id"], r["text"]) for r in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rows = [(None if i == 3 else 11 if i == 12 else i, t, None, None if i % 3 == 0 else f"s{i % 2}", None, -1, False, "k", 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[-1:], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def test_token_counts(spark, documents, odd, none):
    t = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, SF).collect()}
    for i, text in documents:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 2048)
    counted = sorted(r.n_tokens for r in token_counts.count_tokens(odd, WORD).collect())
    assert counted == sorted(len(t.encode(x or "", add_special_tokens=False).ids) for x in TEXTS + TEXTS[-1:])
    assert token_counts.count_tokens(none, WORD).count() == 0


def test_merge_order_on_random_words():
    t, m, rng = Tokenizer.from_file(WORD), token_counts.MergeCounter(open(WORD, encoding="utf-8").read()), np.random.default_rng(1)
    for _ in range(1500):
        word = "".join(rng.choice(list("aabehinorst'é ")) for _ in range(rng.integers(1, 30)))
        assert m.count(word) == len(t.encode(word, add_special_tokens=False).ids)


def test_mixture(spark, documents, odd, none):
    got = queries.op2_mixture(spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()}
    size = {i: len(brute.WORD.findall(t or "")) for i, t in documents}
    total = {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    want, taken = brute.targets(total), dict.fromkeys(total, 0)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and r.taken <= 2 * r["size"]
        assert math.isclose(r.target, want[source[r.doc_id]], rel_tol=1e-9, abs_tol=1e-6)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = queries.op2_mixture(spark, SF).collect()
    assert got == again
    times = [r.position for r in got if r.position is not None]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1
    assert mixture.mix(odd).count() == len(TEXTS) + 1 and mixture.mix(none).count() == 0
    read = mixture.mixed_rows(odd)
    assert read.columns == odd.columns and mixture.mixed_rows(none).count() == 0


def test_mixture_does_not_depend_on_the_layout(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionAll(docs.where("doc_id % 7 = 0"))  # repeated rows
    want = sorted(map(tuple, mixture.mix(docs).collect()), key=repr)
    for other in (docs.repartition(5), docs.orderBy(F.col("doc_id").desc()).coalesce(1), docs.repartition(9, "source")):
        assert sorted(map(tuple, mixture.mix(other).collect()), key=repr) == want
    assert sorted(map(tuple, mixture.mix(odd.repartition(3)).collect()), key=repr) == sorted(map(tuple, mixture.mix(odd.coalesce(1)).collect()), key=repr)


def test_mixture_positions(spark):
    """Within a source, in the order of the positions, the integral of the schedule at a position is the share read up to there."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    names = sorted({r.source for r in docs.select("source").distinct().collect()}, key=lambda s: (s is None, (s or "").encode()))
    by = {}
    for r in mixture.mix(docs).collect():
        by.setdefault(r.source, []).append(r)
    for place, source in enumerate(names):
        a, b = mixture.COURSES[place % 3]
        want, at = round(by[source][0].target), 0
        first = sorted((r for r in by[source] if r.position is not None), key=lambda r: r.position)
        later = sorted((r for r in by[source] if r.later_position is not None), key=lambda r: r.later_position)
        assert [r.doc_id for r in later] == [r.doc_id for r in first][: len(later)]  # the second pass goes the same way
        for t, n in [(r.position, r["size"]) for r in first] + [(r.later_position, r["size"]) for r in later]:
            read = min(n, want - at)
            assert math.isclose(a * t + (b - a) * t * t / 2, (at + read / 2) / want * (a + b) / 2, rel_tol=1e-9)
            at += read
        assert at == want or at == 2 * by[source][0].source_size


def test_rows_keep_columns_whatever_their_names(spark):
    data = [(1, "a b c d e f", "s", 1, 2, 3, 4), (2, "a b c d e f", "s", 5, 6, 7, 8), (3, None, None, 9, 9, 9, 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, at int, n int, first int, row int")
    docs = docs.select("*", *[F.lit(n).alias(c) for n, c in enumerate(("__n", "__time", "__sha", "__stay_id", "stay_hash", "key", "copies", "time", "id", "hash", "position"))])
    for out, n in ((exact_dedup.drop_exact_copies(docs), 2), (ngram_join.keep_one_of_each(docs), 2), (mixture.mixed_rows(docs), 3)):
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
        assert out.select("doc_id").distinct().count() == n


def test_schedule_is_inverted():
    """A position is where the integral of the schedule reaches the share read so far."""
    a, b = 1.5, 0.5
    for u in (0.0, 0.2, 0.7, 1.0):
        full = u * (a + b) / 2
        t = (math.sqrt(a * a + 2 * (b - a) * full) - a) / (b - a)
        assert math.isclose(a * t + (b - a) * t * t / 2, full, abs_tol=1e-12)


def test_shards(spark, documents, odd, none):
    got = queries.op3_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in documents)
    size = {i: len((t or "").encode()) + 8 for i, t in documents}
    per, slots = [0] * 24, [[] for _ in range(24)]
    for r in got:
        assert r["size"] == size[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        per[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(per) - min(per) <= 2 * max(size.values()) and all(sorted(s) == list(range(len(s))) for s in slots)
    assert shards.shard(odd).count() == len(TEXTS) + 1 and shards.shard(none).count() == 0


def test_shards_split_a_group_over_the_mean(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = shards.shard(hot, shards=8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    n = [r.n for r in got]
    assert len(n) == 8 and max(n) <= 1.1 * min(n)


def test_shards_against_plain_placement(spark, odd):
    """Groups of equal texts lie in the order of their keys, each at its middle; however the rows are laid out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups: dict[int, list[tuple[int, int]]] = {}
    for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect():
        groups.setdefault(r.key, []).append((r.doc_id, r.n + 8))
    total, at, want = sum(n for g in groups.values() for _, n in g), 0, {}
    for _, group in sorted(groups.items()):
        size = sum(n for _, n in group)
        for i, n in sorted(group):
            at += n
            if size * 64 * 4 > total:
                want[i] = min(3, int((at - n / 2) * 4 / total))
        want |= {i: min(3, int((at - size / 2) * 4 / total)) for i, _ in group if i not in want}
    for laid in (docs, docs.repartition(5), docs.coalesce(1)):
        got = shards.shard(laid, shards=4, ranges_per_shard=4, sample_per_range=6)
        assert {r.doc_id: r.shard for r in got.select("doc_id", "shard").collect()} == want
    assert rows(shards.shard(odd), "doc_id", "size", "shard", "slot") == rows(shards.shard(odd.repartition(3)), "doc_id", "size", "shard", "slot")


def test_splitters_subdivide():
    assert shards._splitters([], 4) == []
    cut = shards._splitters(sorted([(5, i) for i in range(100)] + [(9, 0)]), 4)
    assert cut[0] == (5, shards.LEAST) and {k for k, _ in cut} == {5} and len(cut) == 3


def test_top_k(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pylist()]
    got = queries.op4_topk(spark, SF)
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(brute.top_k(vectors), key=repr)


def test_top_k_odd_vectors(spark):
    data = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (3, [1.0, 2.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [-1.0, 0.5]), (9, [1.0, 2.0, 3.0]), (100, [0.0, 0.0]), (150, []), (10, []), (200, [3e5, -2e5]), (11, [4e7, 1e7]), (8, [-1.0, 0.5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert rows(topk.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(brute.top_k(data), key=repr)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Small blocks and many pivots, vectors in tight clusters, so that bounds end the search early; extra columns clash with none of ours."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 7)
    random = np.random.default_rng(5)
    centres = random.normal(size=(6, 8)) * 4
    data = [(i, (centres[i % 6] + random.normal(size=8) / 50).round(3).tolist()) for i in range(1200)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in data], "vec_id long, embedding array<double>, dim int, q_ids string, id int")
    assert rows(topk.top_k(df.repartition(6)), "query_id", "rank", "vec_id", "score") == sorted(brute.top_k(data), key=repr)


def test_near_copies(spark, documents, none):
    got = queries.op5_ngram_join(spark, SF)
    assert rows(got, "doc_id", "class_id", "n_links") == sorted(brute.near(documents), key=repr)
    assert ngram_join.similar(none).count() == 0 and ngram_join.keep_one_of_each(none).count() == 0


def test_near_copies_in_a_large_group(spark):
    """A group of more texts than a block, each of which differs from the others."""
    base = [f"w{i}" for i in range(120)]
    texts = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1 :])) for i in range(600) for k in [i % 100 + 10]] + [(1000, "quite another text of seven words"), (1001, None), (1002, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(ngram_join.similar(df), "doc_id", "class_id", "n_links") == sorted(brute.near(texts), key=repr)
    assert ngram_join.keep_one_of_each(df).count() == 4


def test_near_copies_in_a_chain_of_groups(spark):
    """More texts than a block, each like its neighbours only: blocks meet where a trie node has texts of both."""
    words = [f"w{i}" for i in range(2300)]
    texts = [(i, " ".join(words[3 * i : 3 * i + 90])) for i in range(700)]
    got = ngram_join.similar(spark.createDataFrame(texts, "doc_id long, text string"))
    assert rows(got, "doc_id", "class_id", "n_links") == sorted(brute.near(texts), key=repr)


def test_near_copies_with_null_and_repeated_ids(spark):
    one, two = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(61))
    data = [(None, one)] * 300 + [(None, f"text number {i} of those without an id") for i in range(300)] + [(7, one), (7, two), (7, two)]
    got = ngram_join.similar(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == 603 and {r.class_id for r in got if r.n_links == 302} == {7} and sum(r.n_links == 302 for r in got) == 303
    assert sum(r.n_links == 0 for r in got) == 300 and sum(r.first_of_class for r in got) == 301


def test_near_copies_of_a_thousand_documents(spark):
    """Against all pairs that share a shingle."""
    sf = SF.replace("0.001", "0.01")
    texts = [(r["doc_id"], r["text"]) for r in ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()]
    assert rows(queries.op5_ngram_join(spark, sf), "doc_id", "class_id", "n_links") == sorted(brute.near_by_index(texts), key=repr)


def test_depth_follows_the_links():
    """Links that are nearly equal need no shorter prefix; links at the threshold do."""
    alike, apart = np.full(100, 0.999), np.full(100, 0.8)
    assert ngram_join.matched_depth(24, 0.8, 0.9999, apart) == ngram_join.matched_depth(24, 0.8, 0.9999) == 5
    assert ngram_join.matched_depth(24, 0.8, 0.9999, alike) == 6
    assert ngram_join.matched_depth(24, 0.8, 0.99, alike) == 8


def test_near_copies_right_at_the_threshold():
    """Similarity 4k of 5k is linked, one shingle less is not."""
    for k in [3, 54, *range(1, 400, 7)]:
        a, b = np.arange(4 * k, dtype=np.uint64), np.arange(5 * k, dtype=np.uint64)
        linked = ngram_join._verified(np.array([1, 2]), np.array([1, 1]), [a, b], np.zeros(2, int), 0.8)
        assert linked == [(1, 1, 1), (2, 1, 1)], k
        assert ngram_join._verified(np.array([1, 2]), np.array([1, 1]), [a[1:], b], np.zeros(2, int), 0.8) == []


def test_near_copies_odd(odd):
    got = ngram_join.similar(odd)
    assert got.count() == len(TEXTS) + 1
    assert got.where("first_of_class").count() == got.select(F.coalesce("class_id", F.lit(-1))).distinct().count()
    assert ngram_join.keep_one_of_each(odd).columns == odd.columns


def test_forest_finds_pairs_at_the_threshold():
    """Recall of the candidate step at the threshold, over random pairs."""
    depth = ngram_join.matched_depth(24, 0.8, 0.9999)
    assert 1 - (1 - 0.8**depth) ** 24 >= 0.9999
    rng, found = np.random.default_rng(2), 0
    forest = ngram_join.Forest(24, depth)
    for _ in range(200):
        x = rng.integers(0, 2**63, 90, dtype=np.uint64)
        a, b = np.unique(x[:80]), np.unique(np.r_[x[:71], x[81:90]])  # 71 of 89: under 0.8
        found += any(p == q for p, q in zip(forest.prefixes(a), forest.prefixes(b)))
    assert found >= 198


def test_url_rules(spark):
    data = [
        (1, "http://A.com/x"), (2, "https://example.com/en/1?a=b"), (3, "https://www.example.com/en/1#t"), (4, "http://b.net/fr/2"), (5, "http://net/es/"), (6, "nothing"), (7, None),
        (8, "http://a.com"), (9, "http://m.example.com/en/"), (10, "http://notexample.com/en/"), (11, ""), (12, "x://u.org/fr/9"), (1, "http://A.com/x"),
    ]
    got = rows(url_rules.judge(spark.createDataFrame(data, "page_id long, url string"), default="allow"), "page_id", "host", "path", "rule")
    want = [
        (1, "a.com", "/x", "com/"), (1, "a.com", "/x", "com/"), (2, "example.com", "/en/1", "example.com/en/"), (3, "www.example.com", "/en/1", "www.example.com/en/"), (4, "b.net", "/fr/2", "net/fr/"), (5, "net", "/es/", "net/es/"), (6, "", "", None), (7, "", "", None),
        (8, "a.com", "", None), (9, "m.example.com", "/en/", "example.com/en/"), (10, "notexample.com", "/en/", "com/"), (11, "", "", None), (12, "u.org", "/fr/9", None),
    ]
    assert got == sorted(want, key=repr)
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mined_rules_match_brute_force(spark):
    """Every kept rule has the confidence and support that counting gives, and a url goes to its most confident rule."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    host, path = url_rules.host_and_path(F.col("url"))
    lined = pages.select(url_rules.url_tokens(F.col("url"), host, path).alias("tokens"), url_rules.fitting_rule(host, path, url_rules.RULES)["verdict"].alias("verdict"))
    labelled = lined.where("verdict IS NOT NULL")
    data = [(set(r.tokens), r.verdict) for r in labelled.collect()]
    mined = url_rules.mine_rules(labelled)
    assert mined
    for have, verdict, confidence, support in mined:
        own = [v for t, v in data if have <= t]
        assert math.isclose(confidence, own.count(verdict) / len(own)) and math.isclose(support, own.count(verdict) / len(data)) and confidence >= 0.9
    for r in queries.op6_url_rules(spark, SF).join(pages, "page_id").withColumn("tokens", url_rules.url_tokens(F.col("url"), F.col("host"), F.col("path"))).collect():
        if r.rule is None:
            assert r.verdict == next((v for have, v, _, _ in mined if have <= set(r.tokens)), "allow")


def test_too_many_mined_rules_are_an_error(spark):
    labelled = spark.createDataFrame([(["a", "b"], "allow"), (["c"], "deny")], "tokens array<string>, verdict string")
    assert len(url_rules.mine_rules(labelled, most_rules=4)) == 3
    with pytest.raises(ValueError, match="more than 3 rules"):
        url_rules.mine_rules(labelled, most_rules=3)


def test_exact(spark, documents, odd, none):
    got = queries.op7_exact_dedup(spark, SF)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(documents), key=repr)
    out = exact_dedup.exact_dedup(odd)
    assert out.count() == len(TEXTS) + 1 and out.where("kept").count() == out.select("text_sha256").distinct().count()
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.count() == out.where("kept").count()
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0


def test_exact_with_a_hot_group(spark):
    hot = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, "hot  text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(hot, fan_in=2).where("group_size > 1").agg(F.count("*").alias("n"), F.min("keep_id").alias("a"), F.max("keep_id").alias("b"), F.max("group_size").alias("g")).first()
    assert (got.n, got.a, got.b, got.g) == (667, 1, 1, 667)


def test_encoding(spark, documents, odd, none):
    t = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in queries.op8_bpe_automaton(spark, SF).collect()}
    for i, text in documents:
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe_automaton.encode_rows(odd, BYTE)
    assert coded.where("round_trip").count() == len(TEXTS) + 1 and bpe_automaton.encode_rows(none, BYTE).count() == 0


def test_automaton_on_random_words():
    t, a, rng = Tokenizer.from_file(BYTE), bpe_automaton.Automaton(open(BYTE, encoding="utf-8").read()), np.random.default_rng(1)
    for _ in range(1500):
        text = "".join(rng.choice(list("aabehinorst' é\n<|>=-")) for _ in range(rng.integers(1, 40)))
        assert np.frombuffer(a.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert a.decode(np.array([t.token_to_id("Ã")], "<u4").tobytes()) == "\ufffd"


def test_toxicity_held_out(spark, odd, none):
    """English documents of the held-out fold: precise, and most of the toxic ones found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang = 'en'").collect()
    hit = [r.toxic for r in got if r.predicted]
    assert sum(hit) >= 0.8 * len(hit) and sum(hit) >= 0.6 * sum(r.toxic for r in got)
    assert toxicity.score(odd, model).count() == len(TEXTS) + 1 and toxicity.score(none, model).count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    blank = toxicity.train(docs.limit(0), labels.limit(0))
    assert {r.score for r in toxicity.score(odd, blank).collect()} == {0.0}


def test_toxicity_held_out_in_every_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    hit = [r.toxic for r in got if r.predicted]
    assert sum(hit) >= 0.8 * len(hit)
    for lang in ("en", "de", "es", "fr"):
        toxic = [r.predicted for r in got if r.lang == lang and r.toxic]
        assert sum(toxic) >= 0.6 * len(toxic), lang


def test_language_model(spark, documents, odd, none):
    want = brute.kneser_ney([t for i, t in documents if not brute.held(i, 7, 2)], documents)
    for r in queries.op10_lm(spark, SF).collect():
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.held(r.doc_id, 7, 2))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    plan = lm.build(odd)
    assert lm.score(odd, plan).where("score < 0").count() == len(TEXTS) + 1 and lm.score(none, plan).count() == 0
    assert {r.n_known for r in lm.score(odd, lm.build(none)).collect()} == {0}


def test_language_model_by_copies_of_tables(spark, tmp_path, monkeypatch):
    """Tables in a store that can't be mapped in place: read through the store's own file system, they give the same scores."""
    plan = lm.build(spark.createDataFrame([("a b a c",), ("b b c a d",), (None,), ("a b",)], "text string"))
    asked = [[w.encode() for w in t.split()] for t in ("a b", "b c d x", "", "a")]
    mapped = lm.Tables(plan).score(asked)
    monkeypatch.setattr(lm, "_local", lambda uri: None)
    assert all(np.array_equal(x, y) for x, y in zip(lm.Tables(plan).score(asked), mapped, strict=True))
    for array in (np.arange(5, dtype="<u8"), np.empty(0, "<u8")):
        lm.save(f"file://{tmp_path}/new", "t", array)
        assert np.array_equal(lm.load(f"file://{tmp_path}/new", "t", "<u8"), array)


@pytest.mark.parametrize("mounted", [True, False])
def test_language_model_holds_no_files_open(spark, monkeypatch, mounted):
    """A model of many shards has more files than a process may hold open."""
    monkeypatch.setattr(lm, "LEAST_SHARDS", 64)
    plan = lm.build(spark.createDataFrame([("a b a c",), ("b b c a d",)], "text string"))
    if not mounted:
        monkeypatch.setattr(lm, "_local", lambda uri: None)
    before = len(os.listdir("/proc/self/fd"))
    tables = lm.Tables(plan)
    assert len(tables.pairs) == 64 and len(os.listdir("/proc/self/fd")) < before + 10
    assert tables.score([[b"a", b"b"]])[1].tolist() == [3]


def test_language_model_sums_to_one(spark):
    """What follows a word: all known words, the end and an unknown word together have probability 1."""
    train = spark.createDataFrame([("a b a c",), ("b b c a d",), (None,), ("a b",)], "text string")
    tables = lm.Tables(lm.build(train))
    score = lambda *w: tables.score([[x.encode() for x in w]])[3][0]
    for before in ("a", "b", "unknown"):
        # P(before, w, end) / P(w, end) * P(w | start) / P(before | start) = P(w | before) with the same ends
        total, first = 0.0, brute_first(tables, before)
        for w in ("a", "b", "c", "d", "unknown"):
            total += 10.0 ** (score(before, w) - score(w) + brute_first(tables, w) - first)
        total += 10.0 ** (score(before) - first)
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def brute_first(tables, w):
    """log10 P(w | start), from the plain model over the same texts."""
    known = brute.kneser_ney(["a b a c", "b b c a d", None, "a b"], [(0, w), (1, f"{w} {w}"), (2, f"{w} {w} {w}")])
    step = known[2][4] - known[1][4]
    end = brute_end(w)
    return known[1][4] - step - end


def brute_end(w):
    """log10 P(end | w), from the counts."""
    return brute.end_after(["a b a c", "b b c a d", None, "a b"], w)
