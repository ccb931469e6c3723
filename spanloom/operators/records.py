"""Predicates, shares and roles of plain records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_contains(rows: DataFrame, fields: list[str], part: str, fold: bool = False) -> DataFrame:
    """Rows of which some field contains the part; `fold` ignores case. Null fields contain nothing."""
    case = F.lower if fold else (lambda c: c)
    hit = F.lit(False)
    for f in fields:
        hit |= F.coalesce(F.contains(case(F.col(f)), F.lit(part.lower() if fold else part)), F.lit(False))
    return rows.where(hit)


def first_filled(*fields: str) -> Column:
    """The first field that is not blank, trimmed; null if all are."""
    return F.coalesce(*[F.nullif(F.trim(F.col(f)), F.lit("")) for f in fields])


def first_match(pattern: str, *fields: str) -> Column:
    """What the pattern finds in the first field where it finds something; else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.col(f), pattern, 0), F.lit("")) for f in fields])


def low_quality(matches: DataFrame, threshold: float, similarity: str = "similarity") -> DataFrame:
    """Matches under the threshold; a missing similarity counts as 1."""
    return matches.where(F.coalesce(F.col(similarity), F.lit(1.0)) < threshold)


def shares(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, share) of all values; null is a value."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))).select(by, "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def split_roles(rows: DataFrame, name: str, first: Column) -> DataFrame:
    """(name, role) of the distinct names: `train` for the first batch, `test` and `validation` (the same names) for the other."""
    roles = F.when(first, F.array(F.lit("train"))).otherwise(F.array(F.lit("test"), F.lit("validation")))
    return rows.select(name, F.explode(roles).alias("role")).distinct()


def without_listed(rows: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not listed; a null key is never listed."""
    return rows.join(listed.select(on).distinct(), on, "left_anti")


def class_of(rows: DataFrame, key: str, classes: dict[str, list[str]]) -> DataFrame:
    """One row for each class that the key stands for; keys without a class go."""
    known = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumn("class", F.explode(F.try_element_at(known, F.col(key))))


def paired(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """(place, left_col, right_col) of two short lists of names by their sorted places; lists of different length are an error.

    Folds and models are few, so one task numbers them.
    """
    number = lambda rows, c: rows.select(c, F.row_number().over(Window.orderBy(c)).alias("place"))
    both = number(left, left_col).join(number(right, right_col), "place", "full")
    whole = F.col(left_col).isNotNull() & F.col(right_col).isNotNull()
    return both.select("place", F.when(whole, F.col(left_col)).otherwise(F.raise_error(F.lit("the lists differ in length"))).alias(left_col), right_col)


def benchmark_report(runs: DataFrame, target: float = 1e7) -> DataFrame:
    """One row from (method, items, seconds, memory, matches): the fastest, the leanest and the best method, and the hours that the fastest needs for `target` items."""
    rate = F.col("seconds") / F.col("items")
    key = lambda c: F.struct(c, F.col("method"))
    return runs.agg(
        F.min(key(F.col("seconds")))["method"].alias("fastest"), F.min(key(-F.col("matches")))["method"].alias("most_matches"),
        F.min(key(F.col("memory")))["method"].alias("lowest_memory"), (F.min_by(rate, key(F.col("seconds"))) * target / 3600).alias("hours_at_target"),
    )
