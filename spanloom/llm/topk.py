"""Exact top-k inner-product search by pivot-table elimination.

Vectors become integers (floor of scale * component). The distances of every candidate to many pivots are computed once and lie in
the candidate blocks. For a query q and a candidate c, the largest |d(q, p) - d(c, p)| over the pivots is a lower bound of their
distance, and as <q, c> = (|q|^2 + |c|^2 - d^2) / 2 it bounds the score from above. Candidates are evaluated in the order of this
bound until the k-th score so far is above the next bound, so the result is exact. Queries and candidates are packed into blocks of
bounded size, components in the narrowest integers that hold them and distances in single precision (the bound allows for its
rounding); each query block meets each candidate block once, and the best of a query block are carried from block to block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES, PIVOTS, PIVOT_SAMPLE = 4096, 4096, 32, 512


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<long>); rows without an id or with a null, NaN or infinite component take no part."""
    one = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = F.col("id").isNotNull() & F.col("x").isNotNull()
    sound &= F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return one.where(sound).select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _pivots(sample: list[list[int]]) -> dict[int, np.ndarray]:
    """Far-apart vectors of a bounded sample, by dimension."""
    out = {}
    for dim in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == dim], np.float64)
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < min(PIVOTS, len(x)):
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
            if far.max() == 0:
                break
            chosen.append(int(far.argmax()))
        out[dim] = x[chosen]
    return out


def _distances(x: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    if pivots is None:
        return np.zeros((len(x), 1))
    x = x.astype(np.float64)
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest of three types."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


class _Side:
    """A block as it is searched: ids, components, distances to the pivots, squared norms, the largest component."""

    def __init__(self, ids: bytes, x: bytes, d: bytes, width: int) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(x, f"i{width}").reshape(len(self.ids), -1)
        self.real = self.x.astype(np.float64)
        self.d = np.frombuffer(d, np.float32).reshape(len(self.ids), -1)
        self.norms = (self.real**2).sum(1)
        self.most, self.reach = float(np.abs(self.real).max(initial=0)), float(self.d.max(initial=0))


def _best(q: _Side, n: int, c: _Side, held: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best (-score, id) of those held and of a block's candidates, for the n-th query."""
    low = np.abs(c.d - q.d[n]).max(1).astype(np.float64)
    lengths = np.sqrt(c.norms) + math.sqrt(q.norms[n])
    bound = (q.norms[n] + c.norms - low * low) / 2
    bound += 2.0**-20 * lengths * (lengths + c.reach + q.reach) + 0.5  # beyond what rounding can do; the scores are whole numbers
    order = np.arange(len(bound)) if len(held) < k else np.flatnonzero(bound >= -held[-1][0])
    order = order[np.argsort(-bound[order])]
    wide = q.most * c.most * q.x.shape[1] >= 2**52
    at, step = 0, 64
    while at < len(order):
        if len(held) == k and bound[order[at]] < -held[-1][0]:
            break
        part = order[at : at + step]
        if len(held) == k:
            part = part[bound[part] >= -held[-1][0]]
        if wide:
            score = (c.x[part].astype(np.int64) * q.x[n].astype(np.int64)).sum(1)
        elif 4 * len(part) > len(bound):  # most of the block: quicker without picking rows first
            score = np.rint((c.real @ q.real[n])[part]).astype(np.int64)
        else:
            score = np.rint(c.real[part] @ q.real[n]).astype(np.int64)
        own = c.ids[part]
        worth = own != q.ids[n]
        if len(held) == k:
            worth &= score >= -held[-1][0]
        score, own = score[worth], own[worth]
        if len(score) > k:
            keep = np.lexsort((own, -score))[:k]
            score, own = score[keep], own[keep]
        held = sorted([*held, *zip((-score).tolist(), own.tolist(), strict=True)])[:k]
        at, step = at + step, step * 4
    return held


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the candidate's id, score: for each query (id divisible by `every`) its k best, ties to smaller ids.

    Candidates are all rows but those with the query's own id; only vectors of the same length are compared (empty ones
    score 0 with one another). Rows that take no part, as in `quantised`, give nothing; neither does an empty table. Other columns
    than the two named are not read. Repeated rows of a candidate each count. Components are
    taken to fit 64-bit scores.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, id_col, vector_col)
    pivots = spark.sparkContext.broadcast(_pivots([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()]))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)

    def packed(most: int):
        def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            waiting: dict[int, list] = {}

            def block(dim: int) -> pd.DataFrame:
                held = waiting.pop(dim)
                x = np.array([v for _, v in held], np.int64)
                ids = np.array([i for i, _ in held], np.int64)
                narrow, d = _narrow(x), _distances(x, pivots.value.get(dim)).astype(np.float32)
                return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "x": [narrow.tobytes()], "d": [d.tobytes()], "width": [narrow.itemsize], "key": [int(ids.min() * 31 + len(ids))]})

            for part in parts:
                for i, v in zip(part["id"], part["v"], strict=True):
                    dim = len(v)
                    waiting.setdefault(dim, []).append((i, v))
                    if len(waiting[dim]) == most:
                        yield block(dim)
            for dim in list(waiting):
                yield block(dim)

        return pack

    kind = "dim int, ids binary, x binary, d binary, width int, key long"
    tasks = 4 * max(1, spark.sparkContext.defaultParallelism)
    lanes = max(1, asked.count() // QUERIES + 1)
    salts = max(1, -(-tasks // lanes))
    q = asked.repartition(lanes, "id").mapInPandas(packed(QUERIES), kind).select("dim", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("d").alias("q_d"), F.col("width").alias("q_width"), F.pmod(F.xxhash64("key"), F.lit(lanes)).alias("lane"))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    c = rows.mapInPandas(packed(BLOCK), kind).withColumn("salt", F.pmod(F.xxhash64("key", "dim"), F.lit(salts)).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    pairs = c.join(q, ["dim", "lane", "salt"]).sortWithinPartitions("dim", "lane", "salt", "q_ids").select("q_ids", "q_x", "q_d", "q_width", "ids", "x", "d", "width")

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}

        def done() -> pd.DataFrame:
            return pd.DataFrame([(q_id, i, -s) for (q_id, _), best in held.items() for s, i in best], columns=["q", "c", "s"])

        for part in parts:
            for r in part.itertuples(index=False):
                if r.q_ids != now:
                    if held:
                        yield done()
                    now, held = r.q_ids, {}
                    asking = _Side(r.q_ids, r.q_x, r.q_d, r.q_width)
                block = _Side(r.ids, r.x, r.d, r.width)
                for n, own in enumerate(asking.ids.tolist()):
                    held[own, n] = _best(asking, n, block, held.get((own, n), []), k)
        if held:
            yield done()

    found = pairs.mapInPandas(search, "q long, c long, s long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "c"))).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("query_id"), "rank", F.col("c").alias(id_col), F.col("s").alias("score"))
