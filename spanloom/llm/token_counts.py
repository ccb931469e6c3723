"""Token counts by byte-pair merging on a heap and a linked list.

A pre-token's symbols form a doubly linked list; a heap holds the ranks of its adjacent pairs. The pair of lowest rank (leftmost
first) is popped and merged again and again, and the count is the number of initial symbols less the number of merges. Symbols are
numbered for the merge table only; no token identifiers are made. Counts of short pre-tokens are remembered, in a memory of bounded
size. The vocabulary file is read on the driver and broadcast (it has a fixed size, about 2 MB).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import once, text_of


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def python_pattern(pattern: str) -> str:
    """A vocabulary file's pattern for the `regex` module, where white space is the Unicode property."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class MergeCounter:
    """Counts tokens as the given vocabulary file (word ends, lower case) asks."""

    def __init__(self, vocabulary: str, most: int = 400_000, longest: int = 64) -> None:
        spec = json.loads(vocabulary)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds not in (["NFC", "Replace", "Lowercase"], []) or model["dropout"] or model["continuing_subword_prefix"]:
            raise ValueError("a kind of vocabulary that this counter does not know")
        self.lower = bool(kinds)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.find = regex.compile(python_pattern(split["pattern"]["Regex"]), regex.V0).findall
        special = [regex.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        end = model["end_of_word_suffix"] or ""
        number: dict[str, int] = {}
        for s in byte_symbols():
            number.setdefault(s, len(number))
            number.setdefault(s + end, len(number))
        self.inner = [number[s] for s in byte_symbols()]
        self.last = [number[s + end] for s in byte_symbols()]
        #: Rank and made symbol, packed, by packed pair.
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            made = number.setdefault(a + b, len(number))
            self.pairs.setdefault(number[a] << 20 | number[b], rank << 20 | made)
        self.known: dict[str, int] = {}
        self.most, self.longest = most, longest

    def merges(self, symbols: list[int]) -> int:
        """The number of symbols that are left when no pair can be merged. A heap entry is a rank and, below it, a place."""
        n, get = len(symbols), self.pairs.get
        heap = []
        for i in range(n - 1):
            if (p := get(symbols[i] << 20 | symbols[i + 1])) is not None:
                heap.append(p >> 20 << 32 | i)
        if not heap:
            return n
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heapify(heap)
        left = n
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            a, j = symbols[i], after[i]
            if a < 0 or j < 0:
                continue
            p = get(a << 20 | symbols[j])
            if p is None or p >> 20 != entry >> 32:
                continue  # what stood here has been merged meanwhile
            symbols[i] = made = p & 0xFFFFF
            symbols[j] = -1
            left -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := get(made << 20 | symbols[k])) is not None:
                    heappush(heap, p >> 20 << 32 | i)
            h = before[i]
            if h >= 0 and (p := get(symbols[h] << 20 | made)) is not None:
                heappush(heap, p >> 20 << 32 | h)
        return left

    def piece(self, word: str) -> int:
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return self.merges(symbols)

    def count(self, text: str) -> int:
        total = 0
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        else:
            parts = [text]
        known = self.known
        if len(known) > self.most:
            known.clear()
        for part in parts:
            if self.lower:
                part = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
            words = self.find(part)
            try:
                total += sum(map(known.__getitem__, words))
                continue
            except KeyError:
                pass
            for word in words:
                n = known.get(word)
                if n is None:
                    n = self.piece(word)
                    if len(word) <= self.longest:
                        known[word] = n
                total += n
        return total


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. No shuffle.

    A null text counts as empty and has no tokens; a null id is kept. Repeated rows give repeated results; an empty table gives
    an empty result. Texts are counted whole; a pre-token of any length costs n log n.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    key, shared = hashlib.sha256(content.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(content)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once("merges", key, lambda: MergeCounter(shared.value))
        for batch in batches:
            text = batch.column(1)
            n = [counter.count(x.as_py()) for x in text]
            size = [x.as_buffer().size for x in text]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
