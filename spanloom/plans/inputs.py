"""Tables and the spans that are derived from them by fixed rules, so that SQL can derive the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Gold spans from the order lines, and predictions that shift, widen or lack some of them.
GOLD_SQL = """
SELECT concat('doc', CAST(l_orderkey AS VARCHAR)) AS filename, CASE l_returnflag WHEN 'A' THEN 'DISEASE' WHEN 'N' THEN 'SYMPTOM' ELSE 'PROCEDURE' END AS label,
  CAST(l_partkey % 300 AS INTEGER) AS start, CAST(l_partkey % 300 + 1 + l_suppkey % 20 AS INTEGER) AS "end", CAST(l_linenumber AS INTEGER) AS ord
FROM lineitem"""
PRED_SQL = """
SELECT concat('doc', CAST(l_orderkey AS VARCHAR)) AS filename,
  CASE WHEN l_linenumber % 6 = 0 THEN 'OTHER' WHEN l_returnflag = 'A' THEN 'DISEASE' WHEN l_returnflag = 'N' THEN 'SYMPTOM' ELSE 'PROCEDURE' END AS label,
  CAST(l_partkey % 300 + l_partkey % 2 AS INTEGER) AS start, CAST(l_partkey % 300 + 1 + l_suppkey % 20 + l_orderkey % 3 AS INTEGER) AS "end", CAST(l_linenumber AS INTEGER) AS ord
FROM lineitem WHERE l_suppkey % 5 <> 0"""


def _spans(lines: DataFrame, label, start, end) -> DataFrame:
    return lines.select(F.concat(F.lit("doc"), F.col("l_orderkey").cast("string")).alias("filename"), label.alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.col("l_linenumber").cast("int").alias("ord"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", "DISEASE").when(F.col("l_returnflag") == "N", "SYMPTOM").otherwise("PROCEDURE")
    start = F.col("l_partkey") % 300
    return _spans(table(spark, sf_dir, "lineitem"), label, start, start + 1 + F.col("l_suppkey") % 20)


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("l_linenumber") % 6 == 0, "OTHER").when(F.col("l_returnflag") == "A", "DISEASE").when(F.col("l_returnflag") == "N", "SYMPTOM").otherwise("PROCEDURE")
    start = F.col("l_partkey") % 300
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") % 5 != 0)
    return _spans(rows, label, start + F.col("l_partkey") % 2, start + 1 + F.col("l_suppkey") % 20 + F.col("l_orderkey") % 3)


#: Tokens of conversation turns between spaces, with offsets; and one tag a turn.
TOKENS_SQL = """
SELECT conv_id, turn, pos, word, start, start + length(word) AS "end" FROM (
  SELECT conv_id, turn, pos, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT conv_id, turn, i - 1 AS pos, p[i] AS word FROM (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS p FROM conversations)))
) WHERE word <> ''"""
TAGS_SQL = "SELECT conv_id, turn, upper(role) AS label, CAST(conv_id % 20 AS INTEGER) AS s, CAST(conv_id % 20 + 12 + turn AS INTEGER) AS e FROM conversations"


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import spans

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(spans.tokens(F.col("text"))).alias("t"))
    return rows.select("conv_id", "turn", "t.pos", "t.word", "t.start", "t.end")


def turn_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    start = (F.col("conv_id") % 20).cast("int")
    return rows.select("conv_id", "turn", F.upper("role").alias("label"), start.alias("start"), (start + 12 + F.col("turn")).cast("int").alias("end"), F.lit(1).alias("ord"))
