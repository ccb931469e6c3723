"""Span operators: overlap joins, token labels, decoding, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_spans(spans: DataFrame, order: str = "ord") -> DataFrame:
    """The first row of each (filename, label, start, end)."""
    w = Window.partitionBy("filename", "label", "start", "end").orderBy(order)
    return spans.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def overlaps(spans: DataFrame, key: str = "filename", row: str = "ord") -> DataFrame:
    """Pairs of different rows of a document whose half-open, non-empty spans overlap, in both directions."""
    a, b = spans.alias("a"), spans.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{row}") != F.col(f"b.{row}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    full = (F.col("a.start") < F.col("a.end")) & (F.col("b.start") < F.col("b.end"))
    return a.join(b, on).where(full).select(F.col(f"a.{key}").alias(key), F.col(f"a.{row}").alias("row"), F.col(f"b.{row}").alias("other"), F.col("a.label").alias("label"), F.col("b.label").alias("other_label"), F.col("a.start").alias("start"), F.col("a.end").alias("end"))


def greedy_matches(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(filename, label, tp): gold spans take, in their order, the first unused predicted span that overlaps or touches them."""
    key = ["filename", "label"]
    g = gold.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end"))).alias("g"))
    p = pred.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end"))).alias("p"))

    def take(used: Column, one: Column) -> Column:
        places = F.sequence(F.lit(1), F.size("p"))
        free = F.filter(places, lambda i: (F.element_at("p", i)["start"] <= one["end"]) & (one["start"] <= F.element_at("p", i)["end"]) & ~F.array_contains(used, i))
        return F.when(F.size(free) > 0, F.array_append(used, F.array_min(free))).otherwise(used)

    return g.join(p, key).select(*key, F.size(F.aggregate("g", F.array().cast("array<int>"), take)).alias("tp"))


def tokens(text: Column) -> Column:
    """Tokens between single spaces as structs (pos, word, start, end), end exclusive."""
    parts = F.split(text, " ")
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,word:string,start:int,end:int>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        one = F.struct(F.size(s["out"]).alias("pos"), w.alias("word"), s["at"].alias("start"), (s["at"] + F.char_length(w)).alias("end"))
        return F.struct((s["at"] + F.char_length(w) + 1).alias("at"), F.array_append(s["out"], one).alias("out"))

    return F.filter(F.aggregate(parts, init, step)["out"], lambda t: t["start"] < t["end"])


def label_tokens(token_rows: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """IOB labels: the first token that a span overlaps gets B-, the others I-; where spans overlap the last one (by ord) decides."""
    s = spans.select(*key, F.col("start").alias("s"), F.col("end").alias("e"), "label", "ord")
    hit = token_rows.join(s, key).where("end > s AND start < e")
    hit = hit.withColumn("first", F.min("pos").over(Window.partitionBy(*key, "ord")))
    tagged = hit.groupBy(*key, "pos").agg(F.max(F.struct("ord", F.concat(F.when(F.col("pos") == F.col("first"), "B-").otherwise("I-"), F.col("label")).alias("tag")))["tag"].alias("tag"))
    return token_rows.join(tagged, [*key, "pos"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def repair_tags(tag: Column, before: Column) -> Column:
    """An I- whose predecessor is O, missing or of another type becomes B-."""
    kind, was = F.substring(tag, 3, 1000), F.substring(F.coalesce(before, F.lit("O")), 3, 1000)
    return F.when(tag.startswith("I-") & ((F.coalesce(before, F.lit("O")) == "O") | (kind != was)), F.concat(F.lit("B-"), kind)).otherwise(tag)


def decode(tagged: DataFrame, key: list[str]) -> DataFrame:
    """Entities of IOB-tagged tokens: islands of B- and the I- of its type that follow."""
    w = Window.partitionBy(*key).orderBy("pos")
    one = tagged.withColumn("tag", repair_tags(F.col("tag"), F.lag("tag").over(w)))
    one = one.withColumn("island", F.sum(F.when(F.startswith("tag", F.lit("B-")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return one.where("tag <> 'O'").groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.substring(F.min("tag"), 3, 1000).alias("label"), F.count(F.lit(1)).alias("n_tokens")).drop("island")


def decode_heads(tagged: DataFrame, key: list[str]) -> DataFrame:
    """Entities (key, head, start, end) of each head's B, I and O by token: B begins one, I goes on with one that has begun, O ends it; an I after O is none."""
    w = Window.partitionBy(*key, "head").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    part = F.substring("tag", 1, 1)
    rows = tagged.withColumn("n__", F.sum((part != "I").cast("int")).over(w))
    found = rows.groupBy(*key, "head", "n__").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max((part == "B").cast("int")).alias("b"))
    return found.where("b = 1").select(*key, "head", "start", "end")


def entity_scores(entities: Column, threshold: float, least: float = 0.1) -> Column:
    """Whether token scores keep an entity: median at or over the threshold and every one over `least`."""
    n = F.size(entities)
    s = F.sort_array(entities)
    half = F.floor((n - 1) / 2).cast("int") + 1
    other = F.floor(n / 2).cast("int") + 1
    return (n > 0) & ((F.try_element_at(s, half) + F.try_element_at(s, other)) / 2 >= threshold) & (F.array_min(entities) > least)


def standard_chunks(tags: Column, size: int, hard: int | None = None) -> Column:
    """Chunks (id, start, stop) of `size` tokens that grow while the next token is I-, up to `hard`; id = start // size."""
    hard = hard or 2 * size
    init = F.array().cast("array<struct<id:int,start:int,stop:int>>")

    def step(out: Column, i: Column) -> Column:
        start = F.when(F.size(out) > 0, F.element_at(out, -1)["stop"]).otherwise(F.lit(0))
        length = i - start
        grow = F.startswith(F.coalesce(F.try_element_at(tags, i + 1), F.lit("O")), F.lit("I-"))
        done = (i == F.size(tags)) | ((length >= size) & (~grow | (length >= hard)))
        return F.when(done & (length > 0), F.array_append(out, F.struct(F.floor(start / size).cast("int").alias("id"), start.alias("start"), i.alias("stop")))).otherwise(out)

    return F.aggregate(F.when(F.size(tags) > 0, F.sequence(F.lit(1), F.size(tags))).otherwise(F.array().cast("array<int>")), init, step)


def centered_chunk(pos: Column, n: Column, size: int) -> tuple[Column, Column]:
    """A window of `size` tokens around a token, shifted inwards at the edges of the document."""
    start = F.greatest(F.lit(0), F.least(pos - size // 2, n - size))
    return start, F.least(n, start + size)


def greedy_chunks(lengths: Column, most: int) -> Column:
    """Neighbouring pieces put together up to `most`; a piece over it stands alone. Array of chunk sizes."""
    init = F.array().cast("array<int>")

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = last.isNotNull() & (last + x <= most)
        return F.when(joins, F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), last + x)).otherwise(F.array_append(out, x))

    return F.aggregate(lengths, init, step)


def label_tokens_multi(token_rows: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """All IOB labels of a token (`tags`, in the order of the spans): B- on the first token that a span overlaps, I- on the others."""
    s = spans.select(*key, F.col("start").alias("s"), F.col("end").alias("e"), "label", "ord")
    hit = token_rows.join(s, key).where("end > s AND start < e")
    hit = hit.withColumn("first", F.min("pos").over(Window.partitionBy(*key, "ord")))
    tag = F.concat(F.when(F.col("pos") == F.col("first"), "B-").otherwise("I-"), F.col("label"))
    tagged = hit.groupBy(*key, "pos").agg(F.array_sort(F.collect_list(F.struct("ord", tag.alias("tag"))))["tag"].alias("tags"))
    return token_rows.join(tagged, [*key, "pos"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def label_vocabulary(spans: DataFrame) -> DataFrame:
    """(tag, number): O is 0, then B- and I- of all labels in order. One row a tag, so one task numbers them."""
    tags = F.array(F.concat(F.lit("B-"), F.col("label")), F.concat(F.lit("I-"), F.col("label")))
    rows = spans.select(F.explode(tags).alias("tag")).distinct()
    rows = rows.unionAll(rows.sparkSession.range(1).select(F.lit("O").alias("tag")))
    return rows.select("tag", (F.row_number().over(Window.orderBy(F.col("tag") != "O", "tag")) - 1).alias("number"))


def keep_types(tag: Column, types: list[str]) -> Column:
    """The tag if its type is one of these, whatever the case; else O. Tokens are never dropped."""
    kind = F.lower(F.substring(tag, 3, 1000))
    return F.when((tag == "O") | kind.isin([t.lower() for t in types]), tag).otherwise("O")


def subword_tag(tag: Column, sub: Column) -> Column:
    """The label of a word's piece: the word's own on the first piece, B- becomes I- on the others."""
    return F.when((sub > 0) & tag.startswith("B-"), F.concat(F.lit("I-"), F.substring(tag, 3, 1000))).otherwise(tag)


def shift(spans: DataFrame, at: str) -> DataFrame:
    """Spans with offsets moved by a column."""
    return spans.withColumns({c: F.col(c) + F.col(at) for c in ("start", "end")})


def without_repeats(values: Column) -> Column:
    """An array without the elements that equal the one before."""
    return F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(values, i - 1)))


ENTITY = "struct<label:string,start:int,end:int,scores:array<double>>"


def merged_entities(tokens: Column, text: Column, threshold: float = 0.5, least: float = 0.1) -> Column:
    """Entities (label, start, end, score) of the IOB-tagged tokens (tag, start, end, score) of one chunk, in order.

    A B- starts an entity, but goes on with one of its type that it touches or that only white space parts from it. An I- goes on with an
    entity of its type; one of another type is passed over, with its score, where the next token is an I- of the entity's type, and else starts
    one. O ends an entity. Of these stay what `entity_scores` keeps and what isn't symbols only; the score is the mean. No tokens, no entities.
    """
    some = F.filter(tokens, lambda t: t["tag"].isNotNull())
    rows = F.transform(some, lambda t, i: F.struct(t["tag"].alias("tag"), t["start"].alias("start"), t["end"].alias("end"), t["score"].alias("score"), F.get(some["tag"], i + 1).alias("next")))
    start = F.struct(F.array().cast(f"array<{ENTITY}>").alias("done"), F.lit(None).cast(ENTITY).alias("now"))

    def step(s: Column, t: Column) -> Column:
        now, kind = s["now"], F.substring(t["tag"], 3, 1000)
        inside, begins = t["tag"].startswith("I-"), t["tag"].startswith("B-")
        between = F.substring(text, now["end"] + 1, t["start"] - now["end"])
        same = now.isNotNull() & (now["label"] == kind)
        grows = same & (inside | (begins & ((now["end"] == t["start"]) | between.rlike(r"^\s+$"))))
        passed = now.isNotNull() & ~same & inside & F.coalesce(t["next"] == F.concat(F.lit("I-"), now["label"]), F.lit(False))
        fresh = F.struct(kind.alias("label"), t["start"].alias("start"), t["end"].alias("end"), F.array(t["score"]).alias("scores")).cast(ENTITY)
        longer = F.struct(now["label"].alias("label"), now["start"].alias("start"), t["end"].alias("end"), F.array_append(now["scores"], t["score"]).alias("scores")).cast(ENTITY)
        then = F.when(grows, longer).when(passed, now).when(begins | inside, fresh)
        return F.struct(F.when(now.isNotNull() & ~grows & ~passed, F.array_append(s["done"], now)).otherwise(s["done"]).alias("done"), then.alias("now"))

    found = F.aggregate(rows, start, step, lambda s: F.when(s["now"].isNotNull(), F.array_append(s["done"], s["now"])).otherwise(s["done"]))
    worth = F.filter(found, lambda e: entity_scores(e["scores"], threshold, least) & ~F.trim(F.substring(text, e["start"] + 1, e["end"] - e["start"])).rlike(r"^[^\p{L}\p{N}_]+$"))
    mean = lambda e: F.aggregate(e["scores"], F.lit(0.0), lambda a, x: a + x) / F.size(e["scores"])
    return F.transform(worth, lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"), mean(e).alias("score")))


#: White space within a character class, in Java and in RE2.
SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
#: Numbers with a decimal part and a sign, words with hyphens, brackets, other single signs: a fixed value but for SPACE.
WORD = rf"\p{{N}}+[.,]?\p{{N}}*[{SPACE}]*[%$€]?|\p{{L}}+(?:-\p{{L}}+)*|[()\[\]{{}}]|[^\p{{L}}\p{{N}}{SPACE}]"


def word_tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, word, start, end) of all words, numbers and signs of whole texts; null and empty texts have none.

    What the pattern leaves out is split off by the same pattern, so offsets are running sums of both.
    """
    t = F.col(text)
    parts = F.arrays_zip(F.regexp_extract_all(t, F.lit(WORD), 0).alias("word"), F.slice(F.split(t, WORD, -1), 1, F.regexp_count(t, F.lit(WORD))).alias("gap"))
    rows = docs.select(key, F.posexplode(parts).alias("pos", "p")).select(key, "pos", "p.word", F.char_length("p.gap").alias("gap"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("word")).over(before).cast("int")
    return rows.withColumn("end", end).select(key, "pos", "word", (F.col("end") - F.char_length("word")).alias("start"), "end")


def override_o(scores: Column, threshold: float) -> Column:
    """The tag of the highest score, from a map of tags; where that is O and its score is under the threshold, the best other tag. Ties go to the smaller tag."""
    best = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("tag"))))
    top = F.try_element_at(best(scores), F.lit(1))
    other = F.try_element_at(best(F.map_filter(scores, lambda k, _: k != "O")), F.lit(1))
    return F.when((top["tag"] == "O") & (-top["s"] < threshold), F.coalesce(other["tag"], top["tag"])).otherwise(top["tag"])


def word_tags(pieces: DataFrame, key: list[str], order: str = "sub") -> DataFrame:
    """Of the pieces of a word, the tag of the first one."""
    return pieces.groupBy(*key).agg(F.min_by("tag", order).alias("tag"))
