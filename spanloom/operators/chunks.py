"""Chunks of tokens along paragraphs, lines and sentences, and wide windows around spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import greedy_chunks

#: Runs of line ends, sentence ends, and all else between white space: so line ends are tokens.
TOKEN = r"\n+|[.!?]|[^\x20\x09-\x0D.!?]+"
SPACE = r"[\x20\x09-\x0D]"


def line_tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, word) of texts, with runs of line ends as tokens of their own; null and empty texts have none."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), 0)).alias("pos", "word"))


def hierarchical_splits(tokens: DataFrame, key: str, most: int) -> DataFrame:
    """Tokens (key, pos, word) in pieces: (key, split, start, size), `split` from 0 in each document.

    A document is cut after blank lines; pieces of over `most` tokens after single line ends, what is still too long after tokens that
    begin with a sentence end, and what is then too long into tokens. A document is dealt with in one task, never more than one.
    """
    cuts = (("p", F.col("word").rlike(r"^[^\n]*\n\n")), ("l", F.regexp_replace("word", r"\n\n+", "").rlike(r"^[^\n]*\n[^\n]*$")), ("s", F.col("word").rlike(r"^[.!?]")))
    rows, by = tokens.withColumn("long", F.lit(True)), [key]
    for name, cut in cuts:
        before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(name, F.when(F.col("long"), F.coalesce(F.sum(cut.cast("int")).over(before), F.lit(0))).otherwise(0))
        by = [*by, name]
        rows = rows.withColumn("long", F.count(F.lit(1)).over(Window.partitionBy(*by)) > most)
    pieces = rows.groupBy(*by, F.when(F.col("long"), F.col("pos")).otherwise(-1).alias("w")).agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("size"))
    return pieces.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1).alias("split"), "start", "size")


def paragraph_chunks(tokens: DataFrame, key: str, most: int, least: int = 8) -> DataFrame:
    """Hierarchical splits put together up to `most` tokens: (key, chunk, start, size); chunks under `least` tokens are left out, numbers keep their gaps."""
    sizes = hierarchical_splits(tokens, key, most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("split", "size")))["size"].alias("sizes"))
    rows = sizes.select(key, F.posexplode(greedy_chunks(F.col("sizes"), most)).alias("chunk", "size"))
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int")).where(F.col("size") >= least)


def widened_chunk(inside: Column, first: Column, after: Column, size: int) -> Column:
    """(start, stop) of half of `size` tokens on either side of the tokens `first` to `after` (exclusive), moved out of entities.

    `inside` says of each token whether some label goes on from the token before. Either end moves outwards, off such tokens, until the
    chunk has 2 * size tokens; a longer one loses its right end.
    """
    n = F.size(inside)
    left, right = F.greatest(first - size // 2, F.lit(0)), F.least(after + size // 2, n)
    clear = lambda low, high: F.filter(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda i: ~F.get(inside, i))
    start = F.least(left, F.greatest(F.coalesce(F.array_max(clear(F.lit(0), left)), F.lit(0)), right - 2 * size))
    stop = F.least(n, F.coalesce(F.array_min(clear(right - 1, n - 1)) + 1, n), F.greatest(right, start + 2 * size))
    return F.struct(start.alias("start"), F.least(stop, start + 2 * size).alias("stop"))


def head_tags(token_rows: DataFrame, spans: DataFrame, key: list[str], types: list[str]) -> DataFrame:
    """A map `heads` from each type to B, I or O for every token; spans of other types are ignored, of a type's overlapping spans the last (by ord) decides."""
    s = spans.where(F.col("label").isin(types)).select(*key, F.col("start").alias("s"), F.col("end").alias("e"), "label", "ord")
    hit = token_rows.join(s, key).where("end > s AND start < e").withColumn("first", F.min("pos").over(Window.partitionBy(*key, "ord")))
    one = hit.groupBy(*key, "pos", "label").agg(F.max_by(F.when(F.col("pos") == F.col("first"), "B").otherwise("I"), "ord").alias("tag"))
    found = one.groupBy(*key, "pos").agg(F.map_from_entries(F.collect_list(F.struct("label", "tag"))).alias("found"))
    heads = F.map_from_entries(F.transform(F.lit(types), lambda t: F.struct(t, F.coalesce(F.try_element_at("found", t), F.lit("O")))))
    return token_rows.join(found, [*key, "pos"], "left").withColumn("heads", heads).drop("found")


def one_hot(tags: Column, vocabulary: list[str], null: str = "O") -> Column:
    """0 and 1 for each entry of the vocabulary; `null` is 1 where no other is."""
    known = F.array_intersect(F.coalesce(tags, F.array().cast("array<string>")), F.lit([v for v in vocabulary if v != null]))
    return F.transform(F.lit(vocabulary), lambda v: F.when(v == null, F.size(known) == 0).otherwise(F.array_contains(known, v)).cast("int"))


def pad(values: Column, n: int, filler: Column) -> tuple[Column, Column]:
    """An array cut or filled up to n, and its mask: 1 for what was there."""
    have = F.least(F.size(values), F.lit(n))
    return F.slice(F.concat(values, F.array_repeat(filler, n)), 1, n), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i <= have).cast("int"))


def first_and_rest(span: Column, start: Column, label: Column) -> Column:
    """The B- piece of a span, its first word, and, if more words follow, the I- piece: structs (tag, start, end, text). White space in front is in neither; without words there is no piece."""
    lead = F.char_length(F.regexp_extract(span, rf"^{SPACE}*", 0))
    head = F.regexp_extract(span, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", 1)
    skip = F.char_length(F.regexp_extract(span, r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]+", 0))
    rest = F.when(skip > 0, F.substr(span, skip + 1)).otherwise("")
    piece = lambda tag, at, text: F.struct(F.concat(F.lit(tag), label).alias("tag"), at.cast("int").alias("start"), (at + F.char_length(text)).cast("int").alias("end"), text.alias("text"))
    return F.filter(F.array(piece("B-", start + lead, head), piece("I-", start + skip, rest)), lambda p: p["text"] != "")


def token_range(tokens: Column, start: Column, end: Column) -> Column:
    """(first, after): the first token that ends after a span's start, and the first that starts at or after its end (their number if none); null if all end before."""
    first = F.array_position(F.transform(tokens, lambda t: t["end"] > start), True).cast("int") - 1
    after = F.array_position(F.transform(tokens, lambda t: t["start"] >= end), True).cast("int") - 1
    return F.when(first >= 0, F.struct(first.alias("first"), F.when(after >= 0, after).otherwise(F.size(tokens)).alias("after")))


def word_scores(pieces: DataFrame, key: list[str], values: list[str], how: str, order: str = "sub") -> DataFrame:
    """Scores of words from those of their pieces: of the first, of the last, or their mean."""
    make = {"first": lambda c: F.min_by(c, order), "last": lambda c: F.max_by(c, order), "mean": F.avg}[how]
    return pieces.groupBy(*key).agg(*[make(c).alias(c) for c in values])
