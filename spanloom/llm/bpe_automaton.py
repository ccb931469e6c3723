"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token strings that the merges give. It starts as one state with an arc for each
byte; each merge (u, v) -> w then adds a gadget: the state that u leads to is copied without its v arc, the u arcs are led to the
copy, and every state with a u arc gets a w arc to where the v arc led. All arcs of one label lead to one state, so the table of
arc ends is one number a label. The copies that one label led to form a run, held as the step at which each lost its arc, so that
an arc is looked up run by run; looked-up arcs are kept in a transition table of bounded size. Texts are split into pre-tokens by the vocabulary file's pattern; a pre-token is encoded by
following the arcs whose labels spell it, one accepted prefix for each position. Decoding puts the labels of the arcs together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import once, text_of
from .token_counts import byte_symbols, python_pattern

#: The pre-token pattern of byte-level vocabularies whose file only says `use_regex`: a fixed value of the format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Automaton:
    def __init__(self, vocabulary: str, most: int = 300_000, longest: int = 64) -> None:
        spec = json.loads(vocabulary)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["end_of_word_suffix"]:
            raise ValueError("a kind of vocabulary that this automaton does not know")
        self.find = regex.compile(python_pattern(BYTE_LEVEL), regex.V0).findall
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        byte = {s: b for b, s in enumerate(byte_symbols())}
        vocab = model["vocab"]
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.label = [b""] * top
        for s, i in vocab.items():
            self.label[i] = bytes(byte[c] for c in s)
        for s, i in self.special.items():
            self.label[i] = s.encode()
        #: By label: the state its arcs lead to, its first part, the step that made it. By state: the label of its run,
        #: step. By label: the state under its run. By run and label: the step at which the arc was lost.
        self.to, self.first, self.made = [0] * top, [-1] * top, [0] * top
        self.run, self.born, self.under = [-1], [0], [0] * top
        self.lost: dict[int, int] = {}
        self.known_arcs: dict[int, bool] = {}
        self.arcs: dict[bytes, int] = {self.label[vocab[s]]: vocab[s] for s in byte if s in vocab}
        for step, (a, b) in enumerate(model["merges"], 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if not self.arc(self.to[u], v):
                continue  # u and v never stand side by side: the merge adds nothing
            end = self.to[v]
            self.run.append(u)
            self.born.append(2 * step)
            self.lost[u << 20 | v] = 2 * step
            self.to[u] = len(self.run) - 1
            self.to[w], self.first[w], self.made[w] = end, u, 2 * step + 1
            self.under[w] = end
            self.arcs[self.label[w]] = w
        self.known_arcs.clear()
        #: By the first three bytes: the length of the longest label that starts so. No longer one is looked for.
        self.reach: dict[bytes, int] = {}
        for label in self.arcs:
            if len(label) > self.reach.get(label[:3], 2):
                self.reach[label[:3]] = len(label)
        self.known: dict[str, bytes] = {}
        self.most, self.longest = most, longest

    def arc(self, state: int, label: int) -> bool:
        """Whether the state has an arc of this label."""
        key = state << 20 | label
        found = self.known_arcs.get(key)
        if found is None:
            u, t, upto = self.run[state], label, self.born[state]
            found = True
            while u >= 0:
                if (lost := self.lost.get(u << 20 | t)) is not None and lost <= upto:
                    found = False
                    break
                if self.made[u] > self.made[t]:
                    below = self.under[u]
                    u, upto = self.run[below], min(upto, self.born[below])
                elif self.first[t] >= 0:
                    t, upto = self.first[t], min(upto, self.made[t])
                else:
                    break
            if len(self.known_arcs) > 2_000_000:
                self.known_arcs.clear()
            self.known_arcs[key] = found
        return found

    def piece(self, word: str) -> bytes:
        """Follow arcs, longest label first. A prefix has one accepted token string, so a position that fails once is never
        tried again: after a failure the last arc gives way to the next shorter one."""
        raw = word.encode("utf-8")
        n, arcs, reach, to, arc, known = len(raw), self.arcs, self.reach.get, self.to, self.arc, self.known_arcs
        path: list[tuple[int, int, int]] = []
        at, state, end = 0, 0, min(n, reach(raw[:3], 2))
        while at < n:
            while end > at:
                t = arcs.get(raw[at:end])
                if t is not None:
                    ok = known.get(state << 20 | t)
                    if ok or (ok is None and arc(state, t)):
                        break
                end -= 1
            else:
                at, state, t = path.pop()
                end = at + len(self.label[t]) - 1
                continue
            path.append((at, state, t))
            at, state = end, to[t]
            end = at + reach(raw[at : at + 3], 2)
            if end > n:
                end = n
        return np.array([t for _, _, t in path], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The identifiers as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.most:
            self.known.clear()
        out, known = [], self.known
        for part in self.split(text) if self.split and "<" in text else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            words = self.find(part)
            try:
                out.append(b"".join(map(known.__getitem__, words)))
                continue
            except KeyError:
                pass
            for word in words:
                ids = known.get(word)
                if ids is None:
                    ids = self.piece(word)
                    if len(word) <= self.longest:
                        known[word] = ids
                out.append(ids)
        return b"".join(out)

    @cached_property
    def emit(self):
        return self.label.__getitem__

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.emit, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _automaton(df: DataFrame, path: str):
    """A function for workers that gives the automaton of a vocabulary file (of fixed size, about 2 MB)."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    key, shared = hashlib.sha256(content.encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(content)
    return lambda: once("automaton", key, lambda: Automaton(shared.value))


#: Rows of a batch that is handed back; keeps a worker's memory low where texts are long.
ROWS = 256


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (binary: little-endian unsigned 32-bit integers). No shuffle.

    A null text counts as empty and has no identifiers; a null id is kept. Repeated rows give repeated results; an empty table
    gives an empty result. Special strings inside a text become their own identifier.
    """
    automaton_of = _automaton(docs, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([automaton.encode(x.as_py()) for x in batch.column(1)], pa.binary())], ["id", "ids"])

    return rows.mapInArrow(encoded, f"id {rows.schema['id'].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, ids, decoded. Null identifiers decode to the empty text; bytes that are no UTF-8 to U+FFFD."""
    automaton_of = _automaton(encoded, vocabulary_path)
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([automaton.decode(x.as_py()) for x in batch.column(1)], pa.string())], ["id", "ids", "decoded"])

    return rows.mapInArrow(decoded, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded string").withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both ways in one pass, with one automaton a worker: id, ids, decoded. Cases as in `encode`."""
    automaton_of = _automaton(docs, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [automaton.encode(x.as_py()) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(automaton.decode, ids), pa.string())], ["id", "ids", "decoded"])

    return rows.mapInArrow(coded, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded string").withColumnRenamed("id", id_col)


def encode_rows(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding in one pass: id, ids, round_trip (whether the decoded text is the text). Cases as in `encode`."""
    automaton_of = _automaton(docs, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(1).to_pylist()
                ids = [automaton.encode(x) for x in texts]
                same = [automaton.decode(i) == x for i, x in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], ["id", "ids", "round_trip"])

    return rows.mapInArrow(coded, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, round_trip boolean").withColumnRenamed("id", id_col)
