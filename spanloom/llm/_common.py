"""Shared helpers of the training-data operators: table access, checkpoints and hashing that every worker repeats alike."""

from __future__ import annotations

import tempfile

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of all word-based operators: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own one only where none is named and everything runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs a reread and no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def text_of(col: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_made: list[tuple[str, str, object]] = []


def once(kind: str, key: str, make):
    """What `make` returns, kept in a worker for as long as the same kind and key are asked for.

    One object in all: a worker serves one stage after another, and what the last stage remembered must not lie beside the memory of the next.
    """
    if not _made or _made[0][:2] != (kind, key):
        _made.clear()
        _made.append((kind, key, make()))
    return _made[0][2]


class WordHashes:
    """64-bit hashes of words; at most `most` words are remembered, then the memory is emptied."""

    def __init__(self, most: int = 400_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and xor-shift), in place where it can be."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
