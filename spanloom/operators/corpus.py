"""Corpus operators: merging, inspecting, comparing, ontology mapping, licences, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def merge_annotations(rows: DataFrame) -> DataFrame:
    """(id, text, tags) with the tags of all rows of an id; ids with different texts are left out, no tags give null."""
    merged = rows.groupBy("id").agg(F.count_distinct(F.md5("text")).alias("n"), F.min("text").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    return merged.where("n = 1").select("id", "text", F.when(F.size("tags") > 0, F.col("tags")).alias("tags"))


#: Spanish names of entity types and their English ones: fixed values.
TYPES = {"ENFERMEDAD": "DISEASE", "FARMACO": "MEDICATION", "SINTOMA": "SYMPTOM", "PROCEDIMIENTO": "PROCEDURE"}


def renamed_type(tag: Column, names: dict[str, str] = TYPES) -> Column:
    """A type by its other name, if it has one."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, tag), tag)


def collect_annotations(rows: DataFrame, drop: list[str], names: dict[str, str] = TYPES, same_text: bool = False) -> DataFrame:
    """(id, text, tags) of (id, text, tags) rows by cleaned id, types renamed, each (tag, start, end) once.

    The smallest text stands for an id; with `same_text`, ids with different texts are left out.
    """
    clean = rows.withColumn("id", T.clean_id(F.col("id"), drop))
    one = clean.select("id", "text", F.explode_outer("tags").alias("t")).select("id", "text", F.when(F.col("t").isNotNull(), F.struct(F.col("t.start"), F.col("t.end"), renamed_type(F.col("t.tag"), names).alias("tag"))).alias("t"))
    merged = one.groupBy("id").agg(F.min("text").alias("text"), F.max("text").alias("last"), F.array_sort(F.collect_set("t")).alias("tags"))
    return (merged.where("text = last") if same_text else merged).select("id", "text", "tags")


def inspect(spans: DataFrame, by: list[str]) -> DataFrame:
    """Number, mean and median length of spans."""
    size = F.col("end") - F.col("start")
    return spans.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean_length"), F.median(size).alias("median_length"), F.count_distinct("filename").alias("documents"))


def invalid_spans(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans outside their text, empty ones, and those of unknown documents, with the reason."""
    rows = spans.join(texts.select("filename", F.char_length("text").alias("size")), "filename", "left")
    why = F.when(F.col("size").isNull(), "no text").when(F.col("start") < 0, "negative start").when(F.col("end") <= F.col("start"), "empty").when(F.col("end") > F.col("size"), "beyond the end")
    return rows.withColumn("why", why).where("why IS NOT NULL")


def combine(parts: list[DataFrame]) -> DataFrame:
    """Rows of all tables without repetition, by filename, start and end as numbers (others last), label, text."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    number = lambda c: F.col(c).try_cast("long").asc_nulls_last()
    return out.distinct().orderBy("filename", number("start_span"), number("end_span"), "label", "text", "start_span", "end_span")


def compare_sets(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Numbers of common and one-sided ids, their Jaccard similarity and rates; one row."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    n = lambda c: F.count_if(c)
    out = both.agg(n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), n(F.col("b").isNull()).alias("only_1"), n(F.col("a").isNull()).alias("only_2"))
    total = F.col("common") + F.col("only_1") + F.col("only_2")
    return out.withColumn("jaccard", F.when(total > 0, F.col("common") / total).otherwise(0.0))


def compare_files(rows: DataFrame, folders: list[str]) -> DataFrame:
    """(folder, name, hash) rows as one status a name: missing, mismatch or ok; missing comes before mismatch."""
    per = rows.groupBy("name").agg(F.count_distinct("folder").alias("folders"), F.count_distinct("hash").alias("hashes"))
    return per.select("name", F.when(F.col("folders") < len(folders), "missing").when(F.col("hashes") > 1, "mismatch").otherwise("ok").alias("status"))


def statistics(rows: DataFrame, value: str, id_col: str) -> DataFrame:
    """Number, distinct ids, mean, median, population deviation, extremes and quartiles; one row."""
    p = lambda q: F.percentile(value, F.lit(q))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids"), F.avg(value).alias("mean"), p(0.5).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest"), p(0.25).alias("q25"), p(0.75).alias("q75")
    )


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal bins of [0, 1], the last closed on the right; every bin has a row, values outside are left out."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    n = rows.where(F.col(value).between(0, 1)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, with the number; null and empty keys are no keys."""
    return rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def flags(overlap_pairs: DataFrame, spans: DataFrame, labels: list[str]) -> DataFrame:
    """For each distinct (filename, start, end) whether a span with it overlaps one of each label."""
    hit = overlap_pairs.groupBy("filename", "start", "end").agg(*[F.bool_or(F.col("other_label") == x).alias(f"with_{x}") for x in labels])
    keys = spans.select("filename", "start", "end").distinct().join(hit, ["filename", "start", "end"], "left")
    return keys.select("filename", "start", "end", *[F.coalesce(f"with_{x}", F.lit(False)).alias(f"with_{x}") for x in labels])


def boundary_errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Predicted spans that start with a gold one and end elsewhere; error > 0: too long."""
    p = pred.select("filename", "start", F.col("end").alias("end_pred"), F.col("label").alias("label_pred"), F.col("ord").alias("ord_pred"))
    return gold.join(p, ["filename", "start"]).where("end <> end_pred").select("filename", "start", "ord", "ord_pred", (F.col("end_pred") - F.col("end")).alias("error"))


def with_default(left: DataFrame, right: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Left join in which a missing value is `default`."""
    return left.join(right, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def mean_vectors(rows: DataFrame, by: str, vector: str = "v") -> DataFrame:
    """(by, pos, arithmetic, harmonic, chordal) of vectors by key: chordal is the mean direction times the mean length."""
    length = F.sqrt(F.aggregate(F.transform(vector, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    one = rows.withColumn("norm", length).select(by, "norm", F.posexplode(vector).alias("pos", "x"))
    cell = one.groupBy(by, "pos").agg(
        F.avg("x").alias("arithmetic"), F.when(F.min(F.abs("x")) > 0, F.count("x") / F.sum(1 / F.when(F.col("x") != 0, F.col("x")))).alias("harmonic"), F.avg(F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0)).alias("direction"), F.avg("norm").alias("norm")
    )
    size = F.sqrt(F.sum(F.col("direction") * F.col("direction")).over(Window.partitionBy(by)))
    return cell.select(by, "pos", "arithmetic", "harmonic", F.when(size > 0, F.col("direction") / size * F.col("norm")).otherwise(0.0).alias("chordal"))


def spherical_means(rows: DataFrame, by: str, vector: str = "v", rounds: int = 10) -> DataFrame:
    """(by, pos, x): the Karcher mean of the vectors' directions, from the mean direction on, times their mean length.

    Each round is one aggregation by (by, pos), pre-aggregated before its shuffle; only a key's mean, of the vectors' length, is ever one row.
    Vectors without a length have no direction and are left out; keys whose directions cancel out give nothing.
    """
    length = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    times = lambda v, f: F.transform(v, lambda x: x * f)
    units = rows.withColumn("n__", length(vector)).where("n__ > 0").select(by, times(vector, F.try_divide(F.lit(1.0), F.col("n__"))).alias("u"), "n__")

    def gathered(cells: DataFrame) -> DataFrame:
        cells = cells.groupBy(by, "pos").agg(F.avg("x").alias("x"), F.first("m").alias("m"), F.avg("n__").alias("n"))
        both = cells.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "x", "m"))).alias("a"), F.max("n").alias("n"))
        return both.select(by, F.col("a.x").alias("x"), F.col("a.m").alias("m"), "n")

    mean = gathered(units.select(by, F.posexplode("u").alias("pos", "x"), F.lit(0.0).alias("m"), "n__")).where(length("x") > 1e-12).select(by, times("x", F.try_divide(F.lit(1.0), length("x"))).alias("m"), "n")
    for _ in range(rounds):
        near = units.join(mean.select(by, "m"), by).withColumn("c", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), T.dot(F.col("m"), F.col("u")))))
        away = near.withColumn("away", F.zip_with("u", "m", lambda x, y: x - F.col("c") * y)).withColumn("far", length("away"))
        logs = times("away", F.when((F.col("far") >= 1e-12) & (F.acos("c") >= 1e-7), F.acos("c") / F.col("far")).otherwise(0.0))
        moved = gathered(away.select(by, F.posexplode(F.arrays_zip(logs.alias("x"), F.col("m"))).alias("pos", "p"), "n__").select(by, "pos", "p.x", "p.m", "n__"))
        step = moved.withColumn("l", length("x")).withColumn("x", F.zip_with("x", "m", lambda x, y: F.cos("l") * y + F.when(F.col("l") > 0, F.sin("l") / F.col("l") * x).otherwise(0.0)))
        mean = step.select(by, times("x", F.try_divide(F.lit(1.0), length("x"))).alias("m"), "n")
    return mean.select(by, F.posexplode(times("m", F.col("n"))).alias("pos", "x"))


def group_folds(rows: DataFrame, gid: str, k: int, seed: int = 42) -> DataFrame:
    """Rows with a fold by a seeded hash of their group; a group is never split."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(gid).cast("string"), F.lit(f"-{seed}"))), 1, 7), 16, 10).cast("long"), F.lit(k)).cast("int"))


def links(html: Column) -> Column:
    """Targets of `<a href="...">`, without folders, absolute urls and the parent folder."""
    return F.filter(F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), 1), lambda x: (x != "") & ~x.endswith("/") & ~x.startswith("http") & ~x.startswith("../"))
