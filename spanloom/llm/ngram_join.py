"""N-gram Jaccard self-join by a MinHash LSH forest.

Texts become sets of hashed five-word shingles; equal sets are collapsed to one representative, so copies are never paired. Each
set has TREES signatures of DEEPEST min-hash slots, a byte a slot, packed in a long: the sorted signatures of a tree are its prefix
trie, and a node of depth d is the run of signatures with equal first d bytes. The matched prefix starts at DEEPEST slots. Links that
the deepest nodes of the first tree give are verified on a bounded sample; weighted by how likely each was found there, they tell the
recall of any depth, and the prefix is shortened until the target recall is reached (see `fitted_depth`).

The members of a node hang on its smallest one (never all pairs), and linked texts form candidate groups. The exact step computes the
Jaccard similarity of all pairs within a group, in blocks of bounded size as matrix products, so a large group of near copies costs
block pairs and no row for each pair. Classes are the connected sets of verified links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WordHashes, checkpoint, mix64, once, text_of

WORDS, THRESHOLD, TREES, DEEPEST, RECALL = 5, 0.8, 24, 8, 0.9999
#: Texts in a block of the exact step; texts that are packed to one task when their groups are small.
BLOCK, PACK = 256, 128
#: Pairs of texts that the depth is fitted on; the part of the estimate that stands for pairs right at the threshold.
SAMPLE, AT_THRESHOLD = 1_000, 0.1


def found_share(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """How likely pairs of these similarities share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def matched_depth(trees: int, threshold: float, recall: float, links: np.ndarray | None = None, deepest: int = DEEPEST) -> int:
    """Shorten the prefix until the target recall, estimated from the similarities of links that the deepest nodes of one tree gave.

    A link counts as often as links like it are missed there (the inverse of its chance). Links at the threshold itself, which deep
    prefixes miss most, always have AT_THRESHOLD of the weight; without any link they have all of it.
    """
    depth = deepest
    while depth > 1:
        share = found_share(np.array([threshold]), depth, trees)[0]
        if links is not None and len(links):
            share = AT_THRESHOLD * share + (1 - AT_THRESHOLD) * np.average(found_share(links, depth, trees), weights=links ** -float(deepest))
        if share >= recall:
            break
        depth -= 1
    return depth


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the n-word shingles; a shorter text with words is one shingle, one without has none."""
    words = once("hashes", "", WordHashes)(text.encode("utf-8", "surrogatepass").split())
    if not len(words):
        return words
    k = min(n, len(words))
    out = words[: len(words) - k + 1] + np.uint64(k)
    for i in range(1, k):
        out = mix64(out) + words[i : len(words) - k + 1 + i]
    return np.unique(mix64(out))


def _digest(sh: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(sh.tobytes()) if len(sh) else None


class Forest:
    """The signatures of sets, cut to `depth` slots: DEEPEST slots a tree, a byte each, the first slot in the highest byte."""

    def __init__(self, trees: int, depth: int = DEEPEST, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.cut = trees, np.uint64(8 * (DEEPEST - depth))
        self.a = (rng.integers(0, 2**31, trees * DEEPEST, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 2**32, trees * DEEPEST, dtype=np.uint32)

    def prefixes(self, sh: np.ndarray) -> list[int]:
        x = (sh >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, np.uint32)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            y = part[None] * self.a[:, None]
            y += self.b[:, None]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            np.minimum(low, y.min(1), out=low)
        slots = (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
        return slots.reshape(self.trees, DEEPEST).view(">u8").ravel().astype(np.uint64).__rshift__(self.cut).view(np.int64).tolist()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for (a, b) edges: the label is the smallest node of the connected set.

    Labels go to neighbours and then to the label's own label (pointer jumping) until nothing changes, with a checkpoint a round.
    """
    both = checkpoint(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        to = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = checkpoint(new.join(to, "label").select("node", "old", F.least("label", "further").alias("label")))
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, as products of incidence matrices over slices of the shared elements."""
    flat = np.concatenate([*one, *two])
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(shared), 4096):
        i, j = np.searchsorted(col, [at, at + 4096])
        held = np.zeros((len(one) + len(two), min(4096, len(shared) - at)), np.float32)
        held[row[i:j], col[i:j] - at] = 1
        out += held[: len(one)] @ held[len(one) :].T
    return out


def _verified(rep: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float, pair: bool = False) -> list[tuple[int, int, int]]:
    """(rep, links, root) within one block (not `pair`) or between two blocks (sides 0 and 1)."""
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if pair else one
    if not len(one) or not len(two):
        return []
    size = np.array([len(x) for x in sets])
    common = _overlaps([sets[i] for i in one], [sets[i] for i in two]).astype(np.int64)
    # In integers, so that a pair right at the threshold is linked.
    p, q = Fraction(str(threshold)).as_integer_ratio()
    linked = common * (p + q) >= p * (size[one][:, None] + size[two][None])
    if two is one:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(rep), np.int64)
    links[one] += linked @ copies[two]
    if two is not one:
        links[two] += linked.T @ copies[one]
    root = np.arange(len(rep))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = find(one[i]), find(two[j])
        if a != b:
            root[max(a, b, key=lambda k: rep[k])] = min(a, b, key=lambda k: rep[k])
    return [(int(rep[i]), int(links[i]), int(rep[find(i)])) for i in range(len(rep)) if links[i]]


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def fitted_depth(source: DataFrame, reps: DataFrame, words: int, threshold: float, trees: int, recall: float) -> int:
    """The depth from at most SAMPLE pairs (the smallest by a hash) that share a node of the first tree at the deepest level."""
    one = reps.select("rep", F.col("first.id").alias("id"), F.col("first.hash").alias("hash"), F.try_element_at("signatures", F.lit(1)).alias("node")).where("node IS NOT NULL")
    hubs = one.groupBy("node").agg(F.min(F.struct("rep", "id", "hash")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = one.join(hubs, "node").where("hub.rep <> rep").orderBy(F.xxhash64("rep", "hub.rep"), "rep").limit(SAMPLE)
    near = near.select(F.xxhash64("rep", "hub.rep").alias("pair"), F.explode(F.array(F.struct("id", "hash"), F.struct("hub.id", "hub.hash"))).alias("of"))
    # At most 2 * SAMPLE rows are broadcast.
    want = F.broadcast(checkpoint(near.select("pair", F.col("of.id").alias("want_id"), F.col("of.hash").alias("want_hash"))))
    texts = source.join(want, (F.col("hash") == F.col("want_hash")) & F.col("id").eqNullSafe(F.col("want_id"))).dropDuplicates(["pair", "hash"])

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(x, words) for x in part["text"]]
        return pd.DataFrame({"s": [_similarity(*sets)] if len(sets) == 2 else []}, dtype="float64")

    links = np.array([r.s for r in texts.select("pair", "text").groupBy("pair").applyInPandas(compare, "s double").collect()])
    return matched_depth(trees, threshold, recall, links[links >= threshold])


def similar(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class), n_links (rows, its copies too, at or over the threshold), first_of_class, text_hash.

    Words are split at space and U+0009 to U+000D. A text of fewer words than a shingle is one shingle; one without words (or
    null) links to nothing and is a class of its own, named by its own id. Texts of any length are compared whole. A null id sorts
    last; `first_of_class` is true for exactly one row of a class, also among repeated ids and fully repeated rows. Similarities
    are compared as whole numbers, so a pair right at the threshold is linked. An empty table gives an empty result. Other columns
    are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("hash"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(x.as_py(), words) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([_digest(x) for x in sets], pa.binary()), pa.array([forest.prefixes(x) if len(x) else [] for x in sets], pa.list_(pa.int64())), batch.column(2)], ["id", "digest", "signatures", "hash"]
                )

    rows = source.mapInArrow(signed, f"id {kind}, digest binary, signatures array<long>, hash long").withColumn("rid", F.monotonically_increasing_id())
    rows = checkpoint(rows.withColumn("set", F.coalesce("digest", F.encode(F.col("rid").cast("string"), "utf-8"))))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid", "hash")).alias("first")
    reps = checkpoint(rows.groupBy("set").agg(first, F.count(F.lit(1)).alias("copies"), F.first("signatures").alias("signatures"), F.first("digest").alias("digest")).withColumn("rep", F.col("first.rid")))
    depth = fitted_depth(source, reps, words, threshold, trees, recall)
    nodes = reps.select("rep", F.posexplode("signatures").alias("tree", "signature")).select("rep", "tree", F.shiftrightunsigned("signature", 8 * (DEEPEST - depth)).alias("prefix"))
    hubs = nodes.groupBy("tree", "prefix").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # A text hangs on the smallest of its hubs only, and its hubs (at most one a tree) on one another: the same connected sets with
    # about one edge a text.
    own = nodes.join(hubs, ["tree", "prefix"]).where("hub <> rep").groupBy("rep").agg(F.min("hub").alias("a"), F.collect_set("hub").alias("hubs"))
    edges = own.select("a", F.explode(F.array_append("hubs", F.col("rep"))).alias("b")).where("a <> b")
    groups = connected(edges)
    sizes = checkpoint(groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    packs = max(1, -(-groups.count() // PACK))
    members = groups.join(sizes, "label").join(reps.select(F.col("rep").alias("node"), "copies", "digest", F.col("first.id").alias("want_id"), F.col("first.hash").alias("want_hash")), "node")
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # fully repeated rows of a text are handed on once a task
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(x.as_py(), words) for x in batch.column(0)]
                keep = []
                for x, d, node in zip(sets, batch.column(1), batch.column(2), strict=True):
                    keep.append(node.as_py() not in seen and _digest(x) == d.as_py())
                    if keep[-1]:
                        seen.add(node.as_py())
                out = [pa.array([x.tobytes() for x in sets], pa.binary()), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(out, ["sh", *batch.schema.names[2:]]).filter(pa.array(keep, pa.bool_()))

    texts = source.join(members, (F.col("hash") == F.col("want_hash")) & F.col("id").eqNullSafe(F.col("want_id"))).select("text", "digest", "node", "copies", "label", "blocks")
    held = texts.mapInArrow(as_sets, "sh binary, node long, copies long, label long, blocks int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    large = F.col("blocks") > 1

    def pair(smaller: Column, larger: Column) -> Column:
        return F.struct(F.col("label").alias("g"), smaller.alias("p"), larger.alias("q"), F.when(smaller == larger, 0).when(own == larger, 1).otherwise(0).alias("side"))

    pairs = F.when(large, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: pair(F.least(own, j), F.greatest(own, j))))
    packed = F.array(F.struct(F.pmod(F.xxhash64("label"), F.lit(packs)).alias("g"), F.lit(-1).alias("p"), F.lit(-1).alias("q"), F.lit(0).alias("side")))
    held = held.withColumn("to", F.explode(F.coalesce(pairs, packed))).select("sh", "node", "copies", "label", "to.*")

    def check(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for _, one in part.drop_duplicates(["label", "node"]).groupby("label"):
            sets = [np.frombuffer(x, np.uint64) for x in one["sh"]]
            out += _verified(one["node"].to_numpy(), one["copies"].to_numpy(), sets, one["side"].to_numpy(), threshold, key[1] < key[2])
        frame = pd.DataFrame(out, columns=["rep", "links", "root"], dtype="int64")
        frame["whole"] = key[1] < 0
        return frame

    found = checkpoint(held.groupBy("g", "p", "q").applyInPandas(check, "rep long, links long, root long, whole boolean"))
    split = found.where("NOT whole AND rep <> root")
    roots = found.where("whole").select("rep", "root")
    if not split.isEmpty():
        roots = roots.unionAll(connected(split.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), F.col("label").alias("root")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    best = reps.select("rep", "set", "copies", "first").join(roots.distinct(), "rep", "left").join(links, "rep", "left")
    best = checkpoint(best.select("rep", "set", "first", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    names = checkpoint(best.groupBy("root").agg(F.min("first").alias("head")))
    named = checkpoint(best.join(names, "root").select("set", "head", "n_links"))
    return rows.select("id", "rid", "set", "hash").join(named, "set").select(
        F.col("id").alias(id_col), F.col("head.id").alias("class_id"), "n_links", (F.col("rid") == F.col("head.rid")).alias("first_of_class"), F.col("hash").alias("text_hash")
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each class (that of the smallest id), with their columns as they were.

    Rows are found again by id and text: of fully repeated rows one stays. Cases as in `similar`; other columns travel packed, so no
    name can clash.
    """
    stay = similar(docs, id_col=id_col, text_col=text_col).where("first_of_class").select(F.col(id_col).alias("stay_id"), F.col("text_hash").alias("stay_hash"))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("hash"))
    joined = packed.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("hash") == F.col("stay_hash")))
    numbered = joined.withColumn("n", F.row_number().over(Window.partitionBy("stay_id", "stay_hash").orderBy(F.lit(1))))
    return numbered.where("n = 1").select("row.*")
