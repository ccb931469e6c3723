"""Writers; every one replaces what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def tsv(rows: DataFrame, path: str, by: str | None = None) -> None:
    """One table, or one folder for each value of `by`."""
    writer = rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "")
    (writer.partitionBy(by) if by else writer).csv(path)


def csv_fields(rows: DataFrame, path: str, fields: list[str]) -> None:
    rows.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def hashed_parquet(rows: DataFrame, path: str, key: str, parts: int = 20) -> None:
    """Parquet in `parts` folders by a hash of the key; the same row always goes to the same folder."""
    rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts))).write.mode("overwrite").partitionBy("part").parquet(path)


def every_n_lines(lines: DataFrame, path: str, n: int = 5_000_000) -> None:
    """Numbered folders of n lines each, from (line_num, text)."""
    rows = lines.withColumn("part", F.floor(F.col("line_num") / n)).repartitionByRange("part", "line_num").sortWithinPartitions("line_num")
    rows.select("part", "text").write.mode("overwrite").partitionBy("part").text(path)


def report_json(report: DataFrame, path: str) -> None:
    """A report of few rows as one JSON object a row."""
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def delimited(rows: DataFrame, path: str, fields: list[str]) -> None:
    rows.select(F.concat_ws("||", *fields).alias("value")).write.mode("overwrite").text(path)


def sorted_parquet(rows: DataFrame, path: str, key: str) -> None:
    rows.orderBy(key).write.mode("overwrite").parquet(path)
