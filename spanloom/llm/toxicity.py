"""Toxicity by compression distance.

Texts are compressed as sequences of codes, one of eight bytes a word, so that only whole words match, whatever the language.
zstandard trains two dictionaries: one on windows of ordinary texts, one on toxic texts from which the words are cut that ordinary
texts have about as often (what both classes share would fill the dictionary and outweigh the few words that differ).
The toxic dictionary follows the ordinary one, so that shared wording costs both alike. A document is compressed window by window
with both; a window's gain is the number of bytes that the toxic dictionary saves. The threshold on gains is calibrated on ordinary
documents that no dictionary was trained on, and a logistic curve over a document's highest gains and its windows over the threshold
gives the score.

Dictionaries, threshold and curve are fitted on a bounded sample of labelled rows (MOST_TOXIC and MOST_ORDINARY rows, texts of at
most MOST_BYTES bytes, the smallest by a hash of the id; MOST_PIECES windows of them for the ordinary dictionary); what is scored is
never cut or sampled: every window of a text of any length counts.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import once, text_of

MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 1_200, 3_000, 16_384
WINDOW, STRIDE, CODE, LEVEL = 64, 40, 8, 3
DICTIONARY, TOXIC_DICTIONARY, MOST_PIECES = 16_384, 6_144, 40_000
#: A word of a toxic text is learned if so many toxic texts have it, and it is so many times as common there as in ordinary texts.
TOXIC_TEXTS, TIMES = 3, 8


class _Codes(dict):
    """The code of a word; the first MOST words met are remembered, others are hashed each time."""

    MOST = 1 << 18

    def __missing__(self, word: str) -> bytes:
        code = hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=CODE).digest()
        if len(self) < self.MOST:
            self[word] = code
        return code


_words = re.compile(r"\w+").findall


def plain(text: str) -> bytes:
    """The codes of the words in order; a text without words has one code of zeros."""
    return b"".join(map(once("codes", "", _Codes).__getitem__, _words(text.lower()))) or bytes(CODE)


def windows(raw: bytes) -> np.ndarray:
    """Start and length of the windows that cover the bytes."""
    n = max(1, -(-(len(raw) - WINDOW) // STRIDE) + 1)
    out = np.empty((n, 2), "<u8")
    out[:, 0] = np.arange(n) * STRIDE
    out[:, 1] = np.minimum(WINDOW, len(raw) - np.arange(n) * STRIDE)
    return out


@dataclass
class Model:
    """What scoring needs; about 50 kB."""

    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: int = 0
    mean: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    rate: float = 0.0


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        if model.toxic:
            self.by = [self._compressor(x) for x in (model.ordinary, model.toxic)]

    @staticmethod
    def _compressor(content: bytes):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def gains(self, raw: bytes) -> np.ndarray:
        parts = zstandard.BufferWithSegments(raw, windows(raw).tobytes())
        one, two = (np.fromiter(map(len, c.multi_compress_to_buffer(parts, threads=1)), np.int64) for c in self.by)
        return one - two

    @staticmethod
    def features(gains: np.ndarray, threshold: int) -> list[float]:
        top = np.sort(gains)[::-1][:4]
        top = np.concatenate([top, np.repeat(top[-1:], 4 - len(top))])
        over = int((gains >= threshold).sum())
        return [float(top[0]), float(np.log1p(over)), float(np.log(len(gains))), float(top[1:].mean()), float((gains >= threshold - 2).mean())]

    def score(self, text: str) -> float:
        m = self.model
        if not m.toxic:
            return m.rate
        x = (np.array(self.features(self.gains(plain(text)), m.threshold)) - m.mean) / m.spread
        z = m.weights[0] + float(np.dot(m.weights[1:], x))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _distinct(raw: bytes) -> set[bytes]:
    return {raw[i : i + CODE] for i in range(0, len(raw), CODE)}


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The dictionary that zstandard trains on the samples; where they are too few for it, the end of them."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=CODE).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _apart(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The toxic texts without the words that ordinary texts have about as often, or that hardly any toxic text has."""
    seen, other = Counter(x for b in toxic for x in _distinct(b)), Counter(x for b in ordinary for x in _distinct(b))
    learned = {x for x, n in seen.items() if n >= TOXIC_TEXTS and n / len(toxic) >= TIMES * (other[x] + 1) / len(ordinary)}
    cut = (b"".join(x for x in (b[i : i + CODE] for i in range(0, len(b), CODE)) if x in learned) for b in toxic)
    return [x for x in cut if x]


def fit(toxic: list[str], ordinary: list[str], seed: int = 5) -> Model:
    """Train on the driver from bounded samples. With a class missing the score is the rate of label 1."""
    rate = len(toxic) / max(1, len(toxic) + len(ordinary))
    pos, neg = [plain(x) for x in toxic], [plain(x) for x in ordinary]
    if len(set(pos)) < 5 or len(set(neg)) < 10:
        return Model(rate=rate)
    apart = _apart(sorted(set(pos)), sorted(set(neg)))
    if not apart:
        return Model(rate=rate)
    half = len(neg) // 2
    pieces = [b[i : i + WINDOW] for b in neg[:half] for i in range(0, len(b), STRIDE)]
    random.Random(seed).shuffle(pieces)
    base, own = _trained(pieces[:MOST_PIECES], DICTIONARY, 2 * WINDOW), _trained(apart, TOXIC_DICTIONARY, WINDOW)
    model = Model(base + bytes(len(own)), base + own, rate=rate)
    scorer = Scorer(model)
    gains = [scorer.gains(b) for b in pos], [scorer.gains(b) for b in neg[half:]]
    model.threshold = next(k for k in range(1, WINDOW + 2) if np.mean([g.max() >= k for g in gains[1]]) <= 0.03)
    x = np.array([Scorer.features(g, model.threshold) for part in gains for g in part])
    y = np.repeat([1.0, 0.0], [len(gains[0]), len(gains[1])])
    #: The sample holds more toxic rows than the table; rows count so that ordinary ones weigh as much as they did.
    w = np.where(y == 1, 1.0, max(1.0, len(neg) / len(gains[1])))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -50, 50)))
        beta += np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(beta)), z.T @ (w * (y - p)) - 0.05 * beta)
    model.mean, model.spread, model.weights = mean.tolist(), spread.tolist(), beta.tolist()
    return model


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out; eager.

    Null labels, ids and texts are left out, and texts over MOST_BYTES; empty texts count. An id with several labels is toxic if one
    says so. Ties in the order of the sample go to the smaller id. Other columns are not read, whatever their names. With an empty
    table, no labels or one class only, the score of every text is the rate of label 1.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & ~held_out("id"))
    marked = marked.groupBy("id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("id", F.lit(9)))
    chosen = [marked.where(F.col("label") == label).orderBy("order", "id").limit(most) for label, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY))]
    # The broadcast holds MOST_TOXIC + MOST_ORDINARY ids; what comes back is bounded by them times MOST_BYTES.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= MOST_BYTES))
    got = rows.join(F.broadcast(chosen[0].unionAll(chosen[1])), "id").select("order", "id", "label", "text").collect()
    got.sort(key=lambda r: (r.order, r.id, r.text))
    return fit([r.text for r in got if r.label == 1], [r.text for r in got if r.label == 0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted. No shuffle.

    A null text counts as empty; an empty text has one window without gain and so a low score. A text of any length is scored over
    all its windows. Null ids are kept and never held out. Repeated rows give repeated results; an empty table gives an empty result.
    Other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 50 kB
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(x.as_py()) for x in batch.column(1)], pa.float64())], ["id", "score"])

    out = rows.mapInArrow(scored, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with their columns as they were. No shuffle: the score is taken beside the row.

    Null and empty texts, null ids and repeated rows are judged as in `score`, each row by itself. An empty table gives an empty one.
    No column is added, so no name can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([scorer.score(x.as_py() or "") < 0.5 for x in text], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
