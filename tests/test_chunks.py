"""Chunks, tags and numbers on arrays against plain Python."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import numeric
from spanloom.operators import chunks, corpus, records


def cut(tokens, most, level=0):
    """Pieces of tokens, cut level by level as far as they are too long."""
    ends = (lambda t: bool(re.match(r"[^\n]*\n\n", t)), lambda t: re.sub(r"\n\n+", "", t).count("\n") == 1, lambda t: t[0] in ".!?")
    if level and len(tokens) <= most:
        return [tokens]
    if level == 3:
        return [[t] for t in tokens]
    pieces, now = [], []
    for t in tokens:
        now.append(t)
        if ends[level](t):
            pieces.append(now)
            now = []
    return [x for p in [*pieces, now] if p for x in cut(p, most, level + 1)]


def test_splits_and_chunks(spark):
    pick = random.Random(3)
    docs = {i: [pick.choice(["a", "b", "c", "\n", "\n\n", "\n\n\n", ".", "!x", "d\n\ne", "f\n"]) for _ in range(pick.choice([0, 1, 5, 60]))] for i in range(40)}
    rows = spark.createDataFrame([(i, n, t) for i, d in docs.items() for n, t in enumerate(d)], "id int, pos int, word string")
    got = {}
    for r in chunks.hierarchical_splits(rows, "id", 4).orderBy("id", "split").collect():
        got.setdefault(r.id, []).append((r.start, r.size))
    for i, d in docs.items():
        pieces = cut(d, 4)
        assert got.get(i, []) == list(zip(itertools.accumulate([0, *map(len, pieces)][:-1]), map(len, pieces), strict=True)) if pieces else i not in got
    all_chunks = chunks.paragraph_chunks(rows, "id", 12, 1).collect()
    assert sum(r.size for r in all_chunks) == sum(map(len, docs.values())) and max(r.size for r in all_chunks) <= 12
    few = chunks.paragraph_chunks(rows, "id", 12, 8).collect()
    assert {(r.id, r.chunk, r.start) for r in few} == {(r.id, r.chunk, r.start) for r in all_chunks if r["size"] >= 8}


def test_line_tokens(spark):
    df = spark.createDataFrame([(1, "a b.\n\nc\nd!"), (2, ""), (3, None)], "id int, text string")
    assert [r.word for r in chunks.line_tokens(df, "id").orderBy("pos").collect()] == ["a", "b", ".", "\n\n", "c", "\n", "d", "!"]


def widened(inside, first, after, size):
    n = len(inside)
    left, right = max(0, first - size // 2), min(n, after + size // 2)
    while left > 0 and inside[left] and right - left < 2 * size:
        left -= 1
    while right < n and inside[right - 1] and right - left < 2 * size:
        right += 1
    return left, min(right, left + 2 * size)


def test_widened_chunks(spark):
    pick = random.Random(5)
    cases = []
    for _ in range(300):
        inside = [pick.random() < 0.6 for _ in range(pick.randint(1, 25))]
        first = pick.randrange(len(inside))
        cases.append((inside, first, pick.randint(first, len(inside))))
    df = spark.createDataFrame(cases, "inside array<boolean>, first int, after int")
    got = df.select("inside", "first", "after", chunks.widened_chunk(F.col("inside"), F.col("first"), F.col("after"), 4).alias("c")).collect()
    assert all((r.c.start, r.c.stop) == widened(r.inside, r.first, r.after, 4) for r in got)


@pytest.mark.parametrize(
    ("span", "want"),
    [("ab cd ef", [("B-X", 5, 7), ("I-X", 8, 13)]), ("ab", [("B-X", 5, 7)]), (" ab ", [("B-X", 6, 8)]), ("ab\n c", [("B-X", 5, 7), ("I-X", 9, 10)]), ("", []), ("  ", []), (None, [])],
)
def test_first_and_rest(spark, span, want):
    df = spark.createDataFrame([(span, 5, "X")], "s string, at int, l string")
    got = df.select(chunks.first_and_rest(F.col("s"), F.col("at"), F.col("l"))).first()[0]
    assert [(p.tag, p.start, p.end) for p in got or []] == want


def test_one_hot_and_padding(spark):
    df = spark.createDataFrame([(["a", "c"],), ([],), (None,), (["z"],)], "t array<string>")
    assert [r[0] for r in df.select(chunks.one_hot(F.col("t"), ["O", "a", "b", "c"])).collect()] == [[0, 1, 0, 1], [1, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0]]
    values, mask = chunks.pad(F.col("t"), 2, F.lit("-"))
    got = [(r.v, r.m) for r in df.where("t IS NOT NULL").select(values.alias("v"), mask.alias("m")).collect()]
    assert got == [(["a", "c"], [1, 1]), (["-", "-"], [0, 0]), (["z", "-"], [1, 0])]


def test_chains_sum_over_all_paths(spark):
    pick = random.Random(7)
    moves, starts, ends = [[pick.uniform(-2, 2) for _ in range(3)] for _ in range(3)], [0.3, -0.2, -1e9], [0.1, 0.5, -0.4]
    scores = [[pick.uniform(-3, 3) for _ in range(3)] for _ in range(4)]

    def score(path):
        return starts[path[0]] + sum(scores[i][t] for i, t in enumerate(path)) + sum(moves[a][b] for a, b in itertools.pairwise(path)) + ends[path[-1]]

    df = spark.createDataFrame([(scores, [0, 1, 2, 0]), ([], [])], "s array<array<double>>, t array<int>")
    got = df.select(numeric.chain_score(F.col("s"), F.col("t"), moves, starts, ends).alias("one"), numeric.chain_normaliser(F.col("s"), moves, starts, ends).alias("all")).collect()
    assert math.isclose(got[0].one, score([0, 1, 2, 0])) and got[1].one is None and got[1]["all"] is None
    assert math.isclose(got[0]["all"], math.log(sum(math.exp(score(p)) for p in itertools.product(range(3), repeat=4))))


def test_arcs(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [3.0, 0.0])], "a array<double>, b array<double>")
    got = [[round(x, 9) for x in r[0]] for r in df.select(numeric.slerp(F.col("a"), F.col("b"), 0.5)).collect()]
    assert got == [[round(math.sqrt(0.5), 9)] * 2, [1.0, 0.0], [2.0, 0.0]]


def test_mean_on_the_sphere(spark):
    """Of vectors on one circle the mean is at the mean angle, which the mean direction is not; vectors without a length are left out."""
    angles = [0.0, 0.1, 1.4]
    rows = [("a", [2 * math.cos(x), 2 * math.sin(x)]) for x in angles] + [("a", [0.0, 0.0]), ("b", [0.0, 3.0])]
    got = {(r.k, r.pos): r.x for r in corpus.spherical_means(spark.createDataFrame(rows, "k string, v array<double>"), "k").collect()}
    assert math.isclose(got["a", 0], 2 * math.cos(0.5), rel_tol=1e-6) and math.isclose(got["a", 1], 2 * math.sin(0.5), rel_tol=1e-6)
    assert abs(got["b", 0]) < 1e-9 and math.isclose(got["b", 1], 3.0)


def test_pairs_need_lists_of_one_length(spark):
    one, two = spark.createDataFrame([("m2",), ("m1",)], "m string"), spark.createDataFrame([("f1",)], "f string")
    with pytest.raises(Exception, match="differ in length"):
        records.paired(one, two, "m", "f").collect()
