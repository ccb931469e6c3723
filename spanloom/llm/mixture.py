"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight that changes linearly over training time: weight * (a + (b - a) * time), time from 0 to 1. Its integral
over all of training is the source's share, from which its target in words follows (with a cap and the excess reshared). Within a
source, the documents lie one behind the other in the order of a hash of id and text, pass after pass; the words up to the target are taken. The
cumulative demand up to a time is the integral of the schedule, and its inverse gives each document's training position, by which
the result is range-sorted. Running totals are two-level (hash buckets, then rows in a bucket), so a source that holds a third of
all rows is spread like any other; the number of buckets is the square root of the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, checkpoint, text_of

WEIGHTS = (3.0, 1.0, 2.0)
#: Start and end of each weight's course relative to its mean.
COURSES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Equal rows that are numbered in one go.
PART = 4096


def _pick(values: Sequence[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at % len(values)).cast("int") + 1)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, courses=COURSES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From (source, source_size) rows: place by code point (null last), target and the course's start and end.

    The sources are sorted by cap over weight; in this order a source is capped as long as its part of what the earlier ones
    leave reaches its cap, and the level of the first that doesn't holds for all later ones.
    """
    one = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    mean = [(a + b) / 2 for a, b in courses]
    one = one.select(
        "source", "source_size", (_pick(weights, F.col("place")) * _pick(mean, F.col("place"))).alias("w"), _pick([a for a, _ in courses], F.col("place")).alias("a"), _pick([b for _, b in courses], F.col("place")).alias("b"),
        (F.col("source_size") * F.lit(float(cap))).alias("cap"), "place",
    )
    by = Window.orderBy(F.col("cap") / F.col("w"), "place")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    one = one.withColumn("level", level)
    free = F.max(F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level"))).over(everything)
    return one.select("source", "source_size", "a", "b", F.least(F.col("cap"), F.coalesce(F.col("w") * free, F.col("cap"))).alias("target"))


def _plan(docs: DataFrame, weights: Sequence[float], courses, share: float, cap: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per input row: id, source, key (a hash of the text), size, source_size, target, taken, passes, position, later_position.

    The order comes from id, source and text alone. Rows equal in all three are one row with a number until their place is known
    (`copies`, dealt in parts of PART), so they need no number of their own that another layout of the input would change.
    """
    if not 0 < cap <= 2:
        raise ValueError("cap must lie in (0, 2]")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("key"))
    rows = rows.withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    rows = checkpoint(rows.groupBy("none", "name", "id", "key", "size").agg(F.count(F.lit(1)).alias("copies")))
    buckets = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("h", F.xxhash64("none", "name", "id", "key", F.lit(seed)))
    rows = rows.withColumn("bucket", F.shiftright((F.shiftright(F.xxhash64("h"), 32) + F.lit(1 << 31)) * F.lit(buckets), 32))
    of, key = ["none", "name"], ["none", "name", "bucket"]
    sums = rows.groupBy(*key).agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    totals = sums.groupBy(*of).agg(F.sum("words").alias("source_size"))
    goals = source_targets(totals.select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size"), weights, courses, share, cap)
    goals = goals.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target", "a", "b")
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(Window.partitionBy(*of).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    rows = rows.join(starts.join(goals, of), key)
    upto = F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy(*key).orderBy("h", "id", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("begin", F.col("start") + upto - F.col("size") * F.col("copies")).withColumn("want", F.round("target").cast("long"))
    parts = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PART).cast("long")))).repartition("h", "from")
    rows = parts.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("copies"), F.col("from") + PART) - 1))).withColumn("offset", F.col("begin") + F.col("copy") * F.col("size"))

    def part(offset: Column) -> Column:
        return F.least(F.col("size"), F.greatest(F.lit(0), F.col("want") - offset))

    def time(offset: Column) -> Column:
        """The time at which the integral of the schedule reaches the middle of what is read from this offset on."""
        u = F.least(F.lit(1.0), (offset + part(offset) / 2) / F.col("want")) * (F.col("a") + F.col("b")) / 2
        d = F.col("b") - F.col("a")
        return F.when(F.abs(d) < 1e-12, u / F.col("a")).otherwise((F.sqrt(F.greatest(F.lit(0.0), F.col("a") * F.col("a") + 2 * d * u)) - F.col("a")) / F.when(F.abs(d) < 1e-12, F.lit(1.0)).otherwise(d))

    one, two = F.col("offset"), F.col("offset") + F.col("source_size")
    return rows.select(
        "id", F.when(~F.col("none"), F.col("name")).alias("source"), "key", "size", "source_size", "target", (part(one) + part(two)).cast("long").alias("taken"),
        (F.when(part(one) > 0, 1).otherwise(0) + F.when(part(two) > 0, 1).otherwise(0)).alias("passes"),
        F.when(part(one) > 0, time(one)).alias("position"), F.when(part(two) > 0, time(two)).alias("later_position"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, courses=COURSES, share: float = 1.5, cap: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, passes, position, later_position; sorted by position.

    `position` is the training time of a document's first reading, `later_position` that of its second (null if there is none). It
    depends on ids, sources and texts only, not on how the rows lie in files or partitions. A null text or one without words has
    size 0 and is never taken; a text of any length is counted whole. A null source is a source of its own, last; a null id is an
    id like others. Repeated rows count each. Ties in the order go by id and text. An empty table gives an empty result. `cap` is at
    most 2, the number of passes that are laid out. The sources are numbered in one task, a row each: their number must be that of
    sources, not of pages. Other columns are not read, whatever their names.
    """
    out = _plan(docs, weights, courses, share, cap, seed, id_col, text_col, source_col).withColumnRenamed("id", id_col).drop("key")
    return out.orderBy(F.col("position").asc_nulls_last(), id_col)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, courses=COURSES, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of `docs` once for each pass that reads them, range-sorted by training position, with their columns as they were.

    A pass that the target cuts short still reads its document whole. Documents without words are read once, at the start. Rows
    that share id, source and text are read alike, as the first of them is. Other cases as in `mix`; an empty table gives an empty
    one. Other columns travel packed, so no name can clash.
    """
    plan = _plan(docs, weights, courses, share, cap, seed, id_col, text_col, source_col)
    first = F.min(F.struct(F.col("position").isNull().alias("none"), "position", "later_position")).alias("first")
    plan = plan.groupBy(F.col("id").alias("plan_id"), F.col("source").alias("plan_source"), F.col("key").alias("plan_key"), F.col("size").alias("plan_size")).agg(first)
    times = F.when(F.col("plan_size") == 0, F.array(F.lit(0.0))).otherwise(F.filter(F.array("first.position", "first.later_position"), lambda x: x.isNotNull()))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_of(text_col)).alias("key"))
    same = (F.col("key") == F.col("plan_key")) & F.col("id").eqNullSafe(F.col("plan_id")) & F.col("source").eqNullSafe(F.col("plan_source"))
    read = packed.join(plan, same).withColumn("time", F.explode(times))
    return read.repartitionByRange("time", "id").sortWithinPartitions("time", "id").select("row.*")
