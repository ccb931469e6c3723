"""Exact deduplication by a tree merge of digest runs.

The rows are dealt into runs by a hash of their id, so that the copies of one text spread over all runs. Each run is reduced to
one entry per digest. Rounds then merge `fan_in` neighbouring runs at a time (binomial rounds, multiway for `fan_in` over two),
each keeping the smallest identifier and the number of rows of a digest, until one run is left. The way back down hands the
winner to the rows: at each level an entry meets at most `fan_in` entries of the level below, and a row meets the entry of its
own run, so no task ever gathers all copies of one text. A digest is the SHA-256 of the normalised text together with its length
and an independent 64-bit hash; all three must agree (the verification) before two rows count as equal.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, shuffle_partitions, text_of

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text_col: str):
    return F.regexp_replace(text_of(text_col), SPACES, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all empty texts are equal. A null id sorts after every other id; of rows with the same smallest
    id exactly one is kept, also among fully repeated rows. Texts of any length are compared whole. An empty table gives an empty
    result. Columns other than the two named are not read, whatever their names.
    """
    spark = docs.sparkSession
    levels = max(1, math.ceil(math.log(max(2, shuffle_partitions(spark)), fan_in)))
    shift = int(math.log2(fan_in))
    if 1 << shift != fan_in:
        raise ValueError("fan_in must be a power of two")
    named = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    rows = checkpoint(
        named.select(
            "id",
            F.struct(F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("len"), F.xxhash64("t").alias("check")).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
        )
    ).withColumn("run", F.pmod(F.xxhash64("id", "rid"), F.lit(fan_in**levels)))
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rid"))
    runs = [rows.groupBy("run", "digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))]
    for _ in range(levels):
        merged = runs[-1].withColumn("run", F.shiftright("run", shift))
        runs.append(merged.groupBy("run", "digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")))
    top = runs[-1]
    for below in reversed(runs[:-1]):
        up = top.select(F.col("run").alias("up"), "digest", "first", "n")
        down = below.select("run", "digest", F.shiftright("run", shift).alias("up"))
        top = down.join(up, ["up", "digest"]).select("run", "digest", "first", "n")
    return rows.join(top, ["run", "digest"]).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.lower(F.hex("digest.sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns as they were; one row of each group of equal texts.

    The decisions come from `exact_dedup`; texts travel once, by id. Of fully repeated rows (same id and text) one stays. Cases as
    there; other columns travel packed, so no name can clash.
    """
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("stay_id"), F.col("text_sha256").alias("stay_sha"))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("sha"))
    joined = packed.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("sha") == F.col("stay_sha")))
    once = joined.withColumn("n", F.row_number().over(Window.partitionBy("stay_id", "stay_sha").orderBy(F.lit(1))))
    return once.where("n = 1").select("row.*")
