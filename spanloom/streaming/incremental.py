"""Incremental exact linkage (an extension of our own): new documents against a fixed table of sentence hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.link import sentence_hashes


def link_stream(spark: SparkSession, folder: str, schema: str, index: DataFrame, out: str, checkpoint: str, id_col: str = "doc_id"):
    """Start a stream that links the documents of new Parquet files in `folder`; appends to `out`, resumes from `checkpoint`.

    A stream-static join: the index is cut to one row a hash, so a document gives at most three rows.
    """
    docs = spark.readStream.schema(schema).parquet(folder)
    best = index.groupBy("hash").agg(F.min("id").alias("match_id"))
    found = sentence_hashes(docs, id_col).join(best, "hash").select(F.col("id").alias(id_col), "pos", "match_id")
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def rate_by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window with a watermark; the same expression serves batch and stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def normalised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("norm", T.normalise(F.col(text_col)))
