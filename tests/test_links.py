"""Links that look at few pairs, against all pairs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.functions import kernels
from spanloom.operators import link


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def strings(n):
    """Words with up to 14 edits of one another, copies, short and empty ones, letters beyond ASCII."""
    rng, out = random.Random(3), ["", None, "a", "İß", "é" * 40, "e" * 41]
    while len(out) < n:
        s = list(rng.choice([x for x in out if x]) if rng.random() < 0.6 else "".join(rng.choices("abcdeE tülo.", k=rng.randint(1, 60))))
        for _ in range(rng.choice((0, 1, 3, 8, 11, 14))):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "E", "ü"])
        out.append("".join(s))
    return out


def test_nearest_strings_of_all_pairs(spark):
    rows = [(i, f"b{i % 2}" if i % 7 else "b0", s) for i, s in enumerate(strings(150))]
    side = spark.createDataFrame(rows, "id long, block string, s string")
    other = [(i * 3 % 151, b, s) for i, b, s in rows]
    for earlier, right in ((True, rows), (False, other), (True, other)):
        want = {}
        for i, b, s in rows:
            near = [(distance(s, t), j) for j, c, t in right if s and t and b == c and (j < i or not earlier)]
            d, j = min(((d, j) for d, j in near if d <= 10), default=(None, None))
            want[i] = (j, d, j is not None)
        got = link.levenshtein_link(side, spark.createDataFrame(right, side.schema), earlier=earlier)
        assert {r.id: (r.match_id, r.distance, r.matched) for r in got.collect()} == want


def test_letter_counts_bound_distances(spark):
    texts = [s for s in strings(80) if s]
    df = spark.createDataFrame([(s,) for s in texts], "s string").select("s", F.array(*link.letter_counts(F.col("s"))).alias("n"))
    n = {r.s: [x & (2**64 - 1) for x in r.n] for r in df.collect()}
    over = 0
    for a in texts:
        for b in texts:
            d, bits = distance(a, b), sum((x & ~y).bit_count() for x, y in zip(n[a], n[b], strict=True))
            assert bits <= d
            over += bits > 10
    assert over > len(texts)


def test_cosines_of_all_pairs(spark):
    """Copies tie, one vector has a null, one is zero, one is null; two queries have no cosine."""
    rng = np.random.default_rng(4)
    base = rng.integers(-3, 4, (30, 5)).astype(float)
    base[:, 0] = 1.0
    vectors = {i: base[i % 30].tolist() for i in range(120)} | {120: [1.0, None, 0.0, 0.0, 0.0], 121: [0.0] * 5, 122: None}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    asked = df.where("id % 10 = 0 OR id = 121")
    want = {}
    for q in (*range(0, 121, 10), 121):
        every = []
        for c, y in vectors.items():
            x = vectors[q]
            if c != q:
                none = x is None or y is None or None in x or None in y or not any(x) or not any(y)
                score = None if none else round(sum(a * b for a, b in zip(x, y, strict=True)) / (math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))), 6)
                every.append((score is None, -(score or 0), c, score))
        want |= {(q, n): (c, score) for n, (_, _, c, score) in enumerate(sorted(every)[:4], 1)}
    got = {(r.qid, r.rank): (r.cid, r.score) for r in link.cosine_top(asked, df, blocks=3, k=4).collect()}
    assert got == want
    few = df.where("id IN (0, 1, 121, 122)")
    assert [(r.cid, r.score is None) for r in link.cosine_top(few.where("id = 0"), few, blocks=1, k=3).orderBy("rank").collect()] == [(1, False), (121, True), (122, True)]


def test_cosines_tile_by_tile(monkeypatch):
    monkeypatch.setattr(kernels.Cosines, "SLICE", 7)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(20, 8)), 5, 0)
    ids = rng.permutation(100)
    held = kernels.Cosines(ids[:10], x[:10], 3)
    for at in range(0, 100, 9):
        held.meet(ids[at : at + 9], x[at : at + 9])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    for n in range(10):
        every = sorted((-round(float(unit[n] @ unit[j]), 6), int(ids[j])) for j in range(100) if j != n)
        assert [(-s, c) for s, c in zip(held.score[held.at == n].tolist(), held.cid[held.at == n].tolist(), strict=True)] == every[:3]
    assert kernels.six_places(np.array([0.1234565, -0.1234565, -1e-9])).tolist() == [0.123457, -0.123457, 0.0]
