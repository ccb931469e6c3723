"""Sharding by sampled splitters.

A sample of (key, id) pairs is drawn with a probability in proportion to a record's size; its quantiles are the splitters of the
ranges. The bytes of every range are then counted over all rows, and ranges that hold over twice the mean are subdivided with
splitters of a denser sample. The key is a hash of the text, so equal texts lie together. A splitter whose key occurs once in the
list is moved down to the start of that key; only a group of copies larger than a range keeps splitters inside it and is cut by id.
Exact running totals within the ranges then give each record its place in the whole order, from which follow shard and slot:
the law is `bytes`, so the shards are equal slices of the total size. A small group goes whole to the shard of its middle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, text_of

LEAST = -(2**63)


def _splitters(pairs: list[tuple[int, int]], count: int) -> list[tuple[int, int]]:
    """Quantiles of sorted pairs; one whose key is alone among them moves to the start of its key."""
    if not pairs:
        return []
    cut = sorted({pairs[len(pairs) * i // count] for i in range(1, count)})
    return sorted({(k, i if j and cut[j - 1][0] == k else LEAST) for j, (k, i) in enumerate(cut)})


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below a row's (key, ord): a binary search over literal arrays."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    keys, ids = F.lit([k for k, _ in splitters]), F.lit([i for _, i in splitters])
    steps = F.lit([1 << b for b in reversed(range(n.bit_length()))])

    def step(at: Column, by: Column) -> Column:
        to = at + by
        k, i = F.element_at(keys, F.least(to, F.lit(n))), F.element_at(ids, F.least(to, F.lit(n)))
        return F.when((to <= n) & ((k < F.col("key")) | ((k == F.col("key")) & (i <= F.col("ord")))), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 16, sample_per_range: int = 24, most_ranges: int = 16_384) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 8 and the checksum of the empty text. A null id sorts before every other. Repeated rows each get a slot.
    Texts of any length count whole. An empty table gives an empty result; columns other than the two named are not read, whatever
    their names. The samples that reach the driver hold about sample_per_range rows for each splitter (bounded by most_ranges):
    one sample of all rows, then one of all overfull ranges together in each round, until none is overfull or no sample splits any.
    """
    text = text_of(text_col)
    rows = checkpoint(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("key"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("ord"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(1, min(most_ranges, count, max(shards * ranges_per_shard, math.isqrt(count))))
    u = (F.shiftrightunsigned(F.xxhash64("key", "ord", "rid"), 11)) / F.lit(float(1 << 53))

    def sample(of: DataFrame, size: float, want: int) -> list[tuple[int, int]]:
        return sorted((r.key, r.ord) for r in of.where(u < F.col("size") * F.lit(want / max(1.0, size))).select("key", "ord").collect())

    splitters = _splitters(sample(rows, float(total), ranges * sample_per_range), ranges)
    while len(splitters) < 4 * most_ranges:
        placed = rows.withColumn("range", _range_of(splitters))
        heavy = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > F.lit(2.0 * total / ranges)) & (F.col("n") > 1))
        parts = {r.range: (min(64, math.ceil(r.bytes * ranges / total) * 2), r.bytes) for r in heavy.collect()}  # at most half as many as there are ranges
        if not parts:
            break
        # One stratified sample of all overfull ranges: their rates are at most half as many rows as there are ranges, so the broadcast is bounded.
        rates = docs.sparkSession.createDataFrame([(r, n * sample_per_range / b) for r, (n, b) in parts.items()], "range int, rate double")
        drawn: dict[int, list[tuple[int, int]]] = {r: [] for r in parts}
        for r in placed.join(F.broadcast(rates), "range").where(u < F.col("size") * F.col("rate")).select("range", "key", "ord").collect():
            drawn[r.range].append((r.key, r.ord))
        new = sorted(set(splitters).union(*(_splitters(sorted(pairs), parts[r][0]) for r, pairs in drawn.items())))
        if new == splitters:  # what is left is repeated rows
            break
        splitters = new

    placed = rows.withColumn("range", _range_of(splitters))
    per = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    at = per.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("at_bytes"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at_row"))
    order = Window.partitionBy("range").orderBy("key", "ord", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("upto", F.sum("size").over(order)).withColumn("row", F.row_number().over(Window.partitionBy("range").orderBy("key", "ord", "rid")))
    group = Window.partitionBy("range", "key")
    placed = placed.withColumn("end", F.max("upto").over(group)).withColumn("group", F.sum("size").over(group))
    # `at` has a row per range, a few times most_ranges at most: its broadcast is bounded.
    placed = placed.join(F.broadcast(at), "range")
    small = F.col("group") * F.lit(64 * shards) <= F.lit(total)
    middle = F.col("at_bytes") + F.when(small, F.col("end") - F.col("group") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    placed = checkpoint(
        placed.select(
            "id", "size", "crc", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(float(max(1, total))))).cast("int").alias("shard"), (F.col("at_row") + F.col("row") - 1).alias("row")
        )
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
