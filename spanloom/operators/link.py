"""Text linkage: exact hashes, MinHash bands, length blocks, Levenshtein, cosine; each is a blocked equi-join with an exact residual."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import text as T


def sentence_hashes(docs: DataFrame, id_col: str, text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, pos, hash) of the first n normalised sentences; sentences that normalise to nothing are left out."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(T.leading_sentences(F.col(text_col), n)).alias("pos", "s"))
    rows = rows.withColumn("norm", T.normalise(F.col("s"))).where("norm <> ''")
    return rows.select("id", "pos", F.md5("norm").alias("hash"))


def exact_link(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left id the match of its earliest sentence, then the smallest right id, then the earliest sentence there.

    Both sides are (id, pos, hash). The right side is cut to its best row for each hash first, so a sentence that many rows share
    joins to one row and the result grows with the left side only.
    """
    best = right.groupBy("hash").agg(F.min(F.struct("id", "pos")).alias("r"))
    hit = left.join(best, "hash").groupBy("id").agg(F.min(F.struct(F.col("pos"), F.col("r.id").alias("rid"), F.col("r.pos").alias("rpos"))).alias("m"))
    return hit.select("id", F.col("m.rid").alias("match_id"), F.col("m.pos").alias("sentence"), F.lit(1.0).alias("similarity"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key that equal ones share; null and empty texts are left out, as they would all be alike."""
    return docs.where("text <> ''").withColumn("key", F.md5("text"))


def signatures(docs: DataFrame, slots: int = 128, k: int = 3) -> DataFrame:
    """(key, sig) of the different normalised texts of (id, text)."""
    hashes = F.transform(T.shingles(F.split("text", " "), k), T.small_hash)
    rows = _keyed(docs).select("key", hashes.alias("hashes")).mapInPandas(kernels.minhash_slots(slots), "key string, sig array<long>")
    return rows.groupBy("key").agg(F.first("sig").alias("sig"))


def lsh_link(left: DataFrame, right: DataFrame, slots: int = 128, threshold: float = 0.7, k: int = 5, itself: bool = True) -> DataFrame:
    """Candidates share a band; the share of equal slots is the similarity; the k best at or over the threshold, ties to smaller ids.

    Sides are normalised texts (id, text). Equal texts meet once: of right rows with the same text only the smallest ids can be among the k best, and
    left rows with the same text share their result. `itself` is false where both sides are one table: no row is its own match then.
    """
    bands, most = T.band_count(slots, threshold), k if itself else k + 1
    rows = slots // bands

    def texts(side: DataFrame, name: str) -> DataFrame:
        return signatures(side, slots).withColumnsRenamed({"key": name + "key", "sig": name + "sig"})

    def banded(side: DataFrame, name: str) -> DataFrame:
        buckets = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice(name + "sig", b * rows + 1, rows)))
        return side.select(name + "key", F.posexplode(buckets).alias("band", "bucket"))

    def best(by: str, *order) -> Column:
        return F.row_number().over(Window.partitionBy(by).orderBy(*order))

    a, b = texts(left, "l"), texts(right, "r")
    pairs = banded(a, "l").join(banded(b, "r"), ["band", "bucket"]).select("lkey", "rkey").distinct()
    same = F.size(F.filter(F.zip_with("lsig", "rsig", lambda x, y: x == y), lambda x: x))
    scored = pairs.join(a, "lkey").join(b, "rkey").select("lkey", "rkey", (same / slots).alias("similarity")).where(F.col("similarity") >= threshold)
    members = _keyed(right).select(F.col("key").alias("rkey"), F.col("id").alias("match_id")).withColumn("n", best("rkey", "match_id")).where(F.col("n") <= most).drop("n")
    near = scored.join(members, "rkey").withColumn("n", best("lkey", F.col("similarity").desc(), "match_id")).where(F.col("n") <= most).drop("n", "rkey")
    found = _keyed(left).select("id", F.col("key").alias("lkey")).join(near, "lkey").drop("lkey")
    found = found if itself else found.where("id <> match_id")
    return found.withColumn("rank", best("id", F.col("similarity").desc(), "match_id")).where(F.col("rank") <= k)


def length_jaccard_link(left: DataFrame, right: DataFrame, tolerance: float = 0.1, bucket: int = 100, most: int | None = None, threshold: float = 0.5) -> DataFrame:
    """Word-set Jaccard among texts whose length differs by the tolerance at most.

    Sides are (id, text). The best candidate at or over the threshold wins, ties to the smaller bucket and id. `most` looks at the
    first so many candidates by bucket and id only; without it, all are compared.
    """
    a = left.select("id", F.char_length("text").alias("len"), F.array_distinct(T.words(F.col("text"))).alias("w"))
    low, high = F.floor(F.col("len") * (1 - tolerance)), F.floor(F.col("len") * (1 + tolerance))
    a = a.withColumn("low", low).withColumn("high", high).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))))
    b = right.select(F.col("id").alias("rid"), F.char_length("text").alias("rlen"), F.array_distinct(T.words(F.col("text"))).alias("rw")).withColumn("bucket", F.floor(F.col("rlen") / bucket))
    pairs = a.join(b, "bucket").where("rlen BETWEEN low AND high")
    if most is not None:
        pairs = pairs.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("bucket", "rid"))).where(F.col("n") <= most)
    scored = pairs.select("id", "rid", "bucket", T.jaccard(F.col("w"), F.col("rw")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("id").agg(F.min_by(F.struct("rid", "similarity"), F.struct(-F.col("similarity"), F.col("bucket"), F.col("rid"))).alias("m"))
    return best.select("id", F.col("m.rid").alias("match_id"), F.col("m.similarity").alias("similarity"))


#: Letters whose counts bound edit distances, the more frequent first.
LETTERS = " etaonirshdlucmgfpbwyvkzjxq.,"


def letter_counts(s: Column) -> list[Column]:
    """Longs whose bits count letters of s, A-Z as a-z, one bit an occurrence, up to 16 of the first twelve letters and 8 of the others.

    An edit adds at most one bit in all and takes away at most one, so strings within n edits have at most n bits each that the other has not.
    """
    s = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def bits(letter: str, width: int) -> Column:
        n = F.least(F.char_length(s) - F.char_length(F.replace(s, F.lit(letter), F.lit(""))), F.lit(width))
        return F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1

    sized = [(x, 16) for x in LETTERS[:12]] + [(x, 8) for x in LETTERS[12:]]
    out, at = [F.lit(0).cast("long")], 0
    for letter, width in sized:
        if at + width > 64:
            out.append(F.lit(0).cast("long"))
            at = 0
        out[-1] = out[-1].bitwiseOR(F.shiftleft(bits(letter, width), at))
        at += width
    return out


def levenshtein_link(left: DataFrame, right: DataFrame, most: int = 10, earlier: bool = False) -> DataFrame:
    """Sides (id, block, s): the nearest right row of the same block by edit distance of s, if at most `most`; left-outer result.

    Ties go to the smaller id. `earlier` looks at right rows of smaller ids only, for a table against itself. Empty and null s match nothing.

    Of right rows with the same s only the smallest id can win, so they meet as one, and left rows with an equal one are done. The others meet
    strings of like length (equal or neighbouring ranges of most + 1); distances are computed where the counts of letters leave it possible.
    """
    one = right.where("s <> ''").groupBy("block", "s").agg(F.min("id").alias("rid"))
    equal = F.col("rid").isNotNull() & ((F.col("rid") < F.col("id")) if earlier else F.lit(True))
    met = left.where("s <> ''").select("id", "block", "s").join(one, ["block", "s"], "left").withColumn("equal", equal)
    counts, size = letter_counts(F.col("s")), F.char_length("s")
    span = F.floor(size / (most + 1))
    a = met.where("NOT equal").select("id", "block", "s", size.alias("size"), F.struct(*counts).alias("n"), F.explode(F.array(span - 1, span, span + 1)).alias("span"))
    b = one.select("rid", "block", F.col("s").alias("rs"), size.alias("rsize"), F.struct(*counts).alias("rn"), span.alias("span"))
    can = (F.col("rid") < F.col("id")) if earlier else F.lit(True)
    can &= F.abs(F.col("size") - F.col("rsize")) <= most
    for x, y in (("n", "rn"), ("rn", "n")):
        can &= sum(F.bit_count(F.col(f"{x}.col{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}.col{i}")))) for i in range(1, len(counts) + 1)) <= most
    near = a.join(b, ["block", "span"]).withColumn("d", F.when(can, F.levenshtein("s", "rs", most)).otherwise(-1)).where("d >= 0")
    found = met.where("equal").select("id", F.lit(0).alias("d"), "rid").unionAll(near.select("id", "d", "rid"))
    best = found.groupBy("id").agg(F.min(F.struct("d", "rid")).alias("m"))
    return left.select("id").join(best, "id", "left").select("id", F.col("m.rid").alias("match_id"), F.col("m.d").alias("distance"), F.col("m").isNotNull().alias("matched"))


def fuzzy_link(left: DataFrame, right: DataFrame, n: int = 2, sample: int = 1000, threshold: float = 0.8) -> DataFrame:
    """Sides (id, text): the match of an equal one of the n leading sentences, else of the most similar of the first `sample` different sentences on the right.

    Of an id's sentences the earliest that has a match at or over the threshold decides. Those first sentences, by id and place, are the
    method's own sample: they come to the driver and go to all workers, so their number is the bound. Gives (id, match_id, similarity, kind).
    """
    a, b = ((side.select("id", F.posexplode(T.leading_sentences(F.col("text"), n)).alias("pos", "s")).withColumn("norm", T.normalise(F.col("s"))).where("norm <> ''")) for side in (left, right))
    hashed = [x.select("id", "pos", F.md5("norm").alias("hash")) for x in (a, b)]
    exact = exact_link(*hashed).select("id", "match_id", "similarity", F.lit("exact").alias("kind"))
    firsts = b.groupBy("norm").agg(F.min(F.struct("id", "pos")).alias("at")).orderBy("at").limit(sample).collect()
    best = kernels.best_fuzzy([(r["at"]["id"], r["norm"]) for r in firsts], threshold)
    rest = a.join(exact.select("id"), "id", "left_anti").withColumn("m", best("norm")).where("m.place IS NOT NULL")
    rest = rest.groupBy("id").agg(F.min_by("m", "pos").alias("m"))
    ids = F.lit([r["at"]["id"] for r in firsts]) if firsts else F.array().cast("array<long>")
    return exact.unionByName(rest.select("id", F.get(ids, F.col("m.place")).alias("match_id"), F.col("m.ratio").alias("similarity"), F.lit("fuzzy").alias("kind")))


def cascade(stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], left: DataFrame) -> DataFrame:
    """One row per left id: the match of the first stage that has one; unmatched ids stay with nulls.

    A stage takes the left rows that no earlier stage matched and gives (id, match_id, similarity). Its matches are kept (memory, then
    disk; recomputed if an executor goes), since the result and the next stage's input both read them.
    """
    rest, parts = left, []
    for name, stage in stages:
        found = stage(rest).select("id", "match_id", "similarity", F.lit(name).alias("stage")).persist()
        parts.append(found)
        rest = rest.join(found, "id", "left_anti")
    return reduce(DataFrame.unionByName, [*parts, rest.select("id").withColumns({"match_id": F.lit(None).cast("long"), "similarity": F.lit(None).cast("double"), "stage": F.lit("none")})])


def idf(docs: DataFrame, id_col: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) with ln(N / (1 + df)), and (id, term, tf)."""
    terms = docs.select(F.col(id_col).alias("id"), F.explode(T.words(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(F.col("n") / (1 + F.col("df"))).alias("idf")), terms  # n is one row


def top_terms(docs: DataFrame, id_col: str, k: int = 5, text_col: str = "text") -> DataFrame:
    weights, terms = idf(docs, id_col, text_col)
    one = terms.join(weights, "term").withColumn("weight", F.round(F.col("tf") * F.col("idf"), 9))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("weight").desc(), "term"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "term", "tf", "df")


#: Rows of a packed block of vectors, and of a tile of them that is scored at once.
VECTORS, TILE = 4096, 1024


def cosine_top(queries: DataFrame, items: DataFrame, blocks: int, k: int = 5) -> DataFrame:
    """Sides (id, v): the k items of highest cosine, to six places, by blocks of queries; each item row meets each block once.

    Vectors are packed in blocks and scored as matrix products; the best of a block of queries are carried from block to block of items and
    scored once more by the sum in the order of the components. There are `blocks` ranges of queries, more where one would hold over VECTORS.
    An item's id is never its own query's match. Vectors with null or non-finite components or of length zero have no cosine: they are matches
    without a score, after all others. Only vectors of as many components are compared.
    """
    spark = queries.sparkSession

    def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        df = df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
        return df.where(sound), df.where(~sound).select("id")

    (q, q_rest), (c, c_rest) = sides(queries), sides(items)
    ranges = max(blocks, -(-q.count() // VECTORS))
    salts = max(1, -(-4 * spark.sparkContext.defaultParallelism // ranges))
    kind = "dim int, ids binary, x binary, salt int"
    packed_q = q.repartition(ranges, "id").mapInPandas(kernels.packed_vectors(VECTORS, 1), kind).drop("salt").withColumnsRenamed({"ids": "q_ids", "x": "q_x"})
    packed_q = packed_q.withColumn("block", F.pmod(F.xxhash64("q_ids"), F.lit(ranges))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    packed_c = c.mapInPandas(kernels.packed_vectors(VECTORS, salts), kind).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))))
    pairs = packed_q.join(packed_c, ["dim", "block", "salt"]).sortWithinPartitions("dim", "block", "salt", "q_ids").select("dim", "q_ids", "q_x", "ids", "x")
    scored = pairs.mapInPandas(kernels.best_cosines(k, TILE), "qid long, cid long, score double")
    # What has no score: k + 1 ids are enough for any query.
    firsts = lambda df: F.broadcast(df.orderBy("id").limit(k + 1).select(F.col("id").alias("cid")))
    unscored = q.select("id").crossJoin(firsts(c_rest)).unionAll(q_rest.crossJoin(firsts(items.select(F.col("id").cast("long").alias("id")))))
    scored = scored.unionAll(unscored.select(F.col("id").alias("qid"), "cid", F.lit(None).cast("double").alias("score")).where("qid <> cid"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "cid"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
