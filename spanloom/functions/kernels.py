"""Arrow functions for what has no built-in form: span cleaning, mojibake repair, fuzzy ratio, Viterbi, cosines."""

from __future__ import annotations

import difflib
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from .text import PRIME

#: Words that may be left hanging at the end of a span, by language (Dutch where none is known): fixed values.
CUTOFF = {
    "nl": ("van", "met", "in", "op", "door", "als"),
    "en": ("of", "with", "in", "on", "by", "as"),
    "sv": ("av", "med", "i", "på", "genom", "som"),
    "it": ("di", "con", "in", "su", "da", "come"),
    "ro": ("de", "cu", "în", "in", "pe", "prin", "ca"),
    "cz": ("z", "s", "v", "na", "přes", "pres", "jako"),
    "es": ("de", "con", "en", "sobre", "por", "como"),
}
PAIRS = {"(": ")", "[": "]", "{": "}"}
STOPS = ".,;:!?"


def clean_span(text: str, start: int, end: int, tag: str, lang: str | None = None) -> tuple[str, int, int] | None:
    """The cleaned span, or nothing if what is left is no entity."""
    hanging = CUTOFF.get((lang or "nl").lower(), CUTOFF["nl"])
    span = text[start:end]
    if span.count("(") > span.count(")") and (close := text.find(")", end)) >= 0:
        end = close + 1
    while True:
        span = text[start:end]
        kept = span.strip()
        if not kept:
            return None
        if kept != span:
            start += len(span) - len(span.lstrip())
            end = start + len(kept)
            continue
        last = kept[-1]
        if last in STOPS and "(" not in kept[:-1]:
            end -= 1
        elif last == ")" and "(" not in kept:
            end -= 1
        elif kept[0] == "(" and ")" not in kept:
            start += 1
        elif PAIRS.get(kept[0]) == last and len(kept) > 1:
            start, end = start + 1, end - 1
        elif m := re.search(rf"(?:(?:^|\s)(?:{'|'.join(hanging)}))+$", kept, re.I):
            end = start + m.start()
        else:
            break
    span = text[start:end]
    try:
        float(span)
        return None
    except ValueError:
        pass
    if re.fullmatch(r"\W+", span):
        return None
    coded = re.fullmatch(r"[A-Z0-9]+", span) and any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
    if coded and tag.upper() in ("PROCEDURE", "SYMPTOM", "DISEASE"):
        return None
    return span, start, end


@F.pandas_udf(StructType().add("text", StringType()).add("start", IntegerType()).add("end", IntegerType()))
def clean_spans(text: pd.Series, start: pd.Series, end: pd.Series, tag: pd.Series) -> pd.DataFrame:
    got = [None if t is None else clean_span(t, int(s), int(e), g or "") for t, s, e, g in zip(text, start, end, tag, strict=True)]
    return pd.DataFrame([x or (None, None, None) for x in got], columns=["text", "start", "end"]).astype({"start": "Int32", "end": "Int32"})


@F.pandas_udf(StringType())
def repair_encoding(text: pd.Series) -> pd.Series:
    """Text that was read as cp1252 instead of UTF-8, put right; any other text as it is."""

    def one(x: str | None) -> str | None:
        try:
            return x if x is None else x.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return x

    return text.map(one)


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def best_fuzzy(known: list[tuple[int, str]], threshold: float):
    """A function from texts to (place, ratio) of the most similar of the known texts, ties to the first; null under the threshold.

    What two texts have in common is at most what their letters have, so candidates are compared in the order of that bound until none can win.
    """
    bins = 64
    counts = lambda x: np.bincount(np.fromiter(map(ord, x), np.int64, len(x)) % bins, minlength=bins)
    table = np.array([counts(t) for _, t in known]).reshape(len(known), bins)
    lengths = np.array([len(t) for _, t in known])

    @F.pandas_udf(StructType().add("place", IntegerType()).add("ratio", DoubleType()))
    def best(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            top, place = 0.0, None
            if x and len(known):
                bound = 2 * np.minimum(table, counts(x)).sum(1) / (lengths + len(x))
                for i in np.argsort(-bound, kind="stable"):
                    if bound[i] < threshold or bound[i] < top:
                        break
                    ratio = difflib.SequenceMatcher(None, x, known[i][1]).ratio()
                    if ratio >= threshold and (ratio > top or (ratio == top and i < place)):
                        top, place = ratio, int(i)
            out.append((place, top if place is not None else None))
        return pd.DataFrame(out, columns=["place", "ratio"]).astype({"place": "Int32"})

    return best


def minhash_slots(slots: int):
    """For mapInPandas: (key, hashes) to (key, sig) with signatures as `text.minhash` makes them; in blocks of hashes, so that a long text takes no more memory."""
    i = np.arange(slots, dtype=np.int64)[:, None]

    def one(hashes) -> np.ndarray:
        h = np.asarray(hashes, dtype=np.int64)
        blocks = [(((7 * i + 13) * h[at : at + 4096] + (11 * i + 17)) % PRIME).min(axis=1) for at in range(0, len(h), 4096)]
        return np.min(blocks, axis=0) if blocks else np.zeros(slots, dtype=np.int64)

    def signed(frames):
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "sig": f["hashes"].map(one)})

    return signed


def viterbi(scores: list[list[float]], moves: list[list[float]], starts: list[float]) -> list[int]:
    """The best path through scores (step by tag) with transition and start scores."""
    if not scores:
        return []
    best, back = [s + e for s, e in zip(starts, scores[0], strict=True)], []
    for row in scores[1:]:
        choice = [max(range(len(best)), key=lambda i: best[i] + moves[i][j]) for j in range(len(row))]
        best = [best[i] + moves[i][j] + row[j] for j, i in enumerate(choice)]
        back.append(choice)
    path = [max(range(len(best)), key=best.__getitem__)]
    for choice in reversed(back):
        path.append(choice[path[-1]])
    return path[::-1]


#: Tags O, B, I: no text starts with I, and no I follows O.
FORBIDDEN = -1e9
BIO_MOVES = [[0.0, 0.0, FORBIDDEN], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
BIO_STARTS = [0.0, 0.0, FORBIDDEN]


@F.pandas_udf(ArrayType(IntegerType()))
def viterbi_bio(scores: pd.Series) -> pd.Series:
    return pd.Series([viterbi([list(map(float, r)) for r in x], BIO_MOVES, BIO_STARTS) for x in scores])


def packed_vectors(most: int, salts: int):
    """For mapInPandas over (id, v): blocks (dim, ids, x, salt) of at most `most` vectors of one length, dealt to salts in turn."""

    def pack(parts):
        waiting: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            held = waiting.pop(dim)
            ids, x = np.array([i for i, _ in held], np.int64), np.array([v for _, v in held], np.float64)
            return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "x": [x.tobytes()], "salt": [int((ids[0] * 31 + len(ids)) % salts)]})

        for part in parts:
            for i, v in zip(part["id"], part["v"], strict=True):
                own = waiting.setdefault(len(v), [])
                own.append((i, v))
                if len(own) == most:
                    yield block(len(v))
        for dim in list(waiting):
            yield block(dim)

    return pack


def six_places(x: np.ndarray) -> np.ndarray:
    """Rounded half up in decimal, as Spark's round does."""
    scaled = x * 1e6
    out = np.rint(scaled) / 1e6
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.rint(scaled)) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0


class Cosines:
    """The k best items so far of a block of queries: places of queries, scores, ids, in order."""

    HALF, SLICE = 5.1e-7, 65_536  # what rounding to six places and a matrix product may move; pairs that are scored at once

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.norms = self._sums(x * x) ** 0.5
        self.unit = x / self.norms[:, None]
        self.at, self.score, self.cid = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.low, self.worst = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)

    @staticmethod
    def _sums(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, 1)[:, -1]  # one after the other, as in the query language

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        norms = self._sums(x * x) ** 0.5
        near = self.unit @ (x / norms[:, None]).T
        least = self.low - self.HALF
        new = np.flatnonzero(np.isinf(self.low))
        if len(new) and len(ids) > self.k + 1:  # one of them may be the query itself
            place = len(ids) - self.k - 1
            least[new] = np.partition(near[new], place, 1)[:, place] - 2 * self.HALF
        i, j = np.nonzero(near >= least[:, None])
        keep = (self.ids[i] != ids[j]) & ((ids[j] < self.worst[i]) | (near[i, j] > self.low[i] + 5e-7 - 1e-8))
        i, j = i[keep], j[keep]
        for n in range(0, len(i), self.SLICE):
            a, b = i[n : n + self.SLICE], j[n : n + self.SLICE]
            self._add(a, six_places(self._sums(self.x[a] * x[b]) / (self.norms[a] * norms[b])), ids[b])

    def _add(self, at: np.ndarray, score: np.ndarray, cid: np.ndarray) -> None:
        at, score, cid = np.r_[self.at, at], np.r_[self.score, score], np.r_[self.cid, cid]
        order = np.lexsort((cid, -score, at))
        at, score, cid = at[order], score[order], cid[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        last = rank == self.k - 1
        self.low[at[last]], self.worst[at[last]] = score[last], cid[last]
        self.at, self.score, self.cid = at[rank < self.k], score[rank < self.k], cid[rank < self.k]


def best_cosines(k: int, tile: int):
    """For mapInPandas over (dim, q_ids, q_x, ids, x), equal blocks of queries next to one another: (qid, cid, score)."""

    def best(parts):
        now, held = None, None

        def done() -> pd.DataFrame:
            return pd.DataFrame({"qid": held.ids[held.at], "cid": held.cid, "score": held.score})

        for part in parts:
            for r in part.itertuples(index=False):
                if (r.dim, r.q_ids) != now:
                    if held is not None:
                        yield done()
                    now, held = (r.dim, r.q_ids), Cosines(np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_x).reshape(-1, r.dim), k)
                ids, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.x).reshape(-1, r.dim)
                for at in range(0, len(ids), tile):
                    held.meet(ids[at : at + tile], x[at : at + tile])
        if held is not None:
            yield done()

    return best
